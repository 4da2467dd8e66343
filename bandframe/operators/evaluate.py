"""Statistics, confusion counts, threshold sweeps, losses, rankings and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandframe.functions.columns import binary_metrics

#: Decision thresholds of a sweep by default (fixed values).
THRESHOLDS = (
    0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.56, 0.57, 0.58, 0.59, 0.60, 0.61, 0.62, 0.63, 0.64, 0.65, 0.66, 0.67, 0.68, 0.69, 0.70, 0.75, 0.80,
)
COUNTS = ("tp", "fp", "tn", "fn")
METRICS = ("precision", "recall", "water_iou", "dice", "accuracy", "jaccard")


def first_names(records: DataFrame, n: int, name: str = "name") -> DataFrame:
    """The first ``n`` names in order."""
    return records.select(name).distinct().orderBy(name).limit(n)


def band_stats(pixels: DataFrame, n_bands: int, names: DataFrame | None = None, max_files: int = 256, key: str = "tile", bands: str = "bands") -> DataFrame:
    """Mean and population std per band over the first ``max_files`` tiles in name order: band, mean, std.

    The variance is floored at 1e-8. A pixel stays one row, a vector whose moments are summed by task;
    only those sums shuffle. Bands must not be null: clean them first (``clean_bands``).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    if names is not None:
        pixels = pixels.join(F.broadcast(first_names(names, max_files, key)), key, "left_semi")  # at most max_files rows
    vector = array_to_vector(F.slice(bands, 1, n_bands).cast("array<double>"))
    sums = pixels.select(vector.alias("v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    n = F.col("s.count")
    sums = sums.select(n.alias("n"), F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")).alias("r")).where("n > 0")
    out = sums.select("n", F.posexplode("r").alias("band", "r"))
    return out.select("band", "r.mean", F.sqrt(F.greatest(F.col("r.variance") * (F.col("n") - 1) / F.col("n"), F.lit(1e-8))).alias("std"))


def confusion_columns(pred: Column, truth: Column) -> list[Column]:
    """Counts tp, fp, tn, fn of water; anything but 1 is other."""
    p, t = F.coalesce(pred == 1, F.lit(False)), F.coalesce(truth == 1, F.lit(False))
    return [F.count_if(c).alias(n) for n, c in zip(COUNTS, (p & t, p & ~t, ~p & ~t, ~p & t))]


def confusion(df: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """Confusion counts over all rows, in one pass."""
    return df.agg(*confusion_columns(pred, truth))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Counts with their metrics."""
    return counts.select("*", *(c.alias(n) for n, c in binary_metrics(*map(F.col, COUNTS)).items()))


def water_iou(df: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """Intersection over union of water over all rows; 0 without water."""
    c = confusion(df, pred, truth)
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return c.select(F.when(union > 0, F.col("tp") / union).otherwise(0.0).alias("water_iou"))


def reaches(prob: Column, threshold: float | Column) -> Column:
    """Whether a probability reaches a threshold. Neither null nor NaN does, though NaN is above all numbers to Spark."""
    return F.coalesce(~F.isnan(prob.cast("double")) & (prob >= threshold), F.lit(False))


def apply_thresholds(probs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, prob: str = "prob") -> DataFrame:
    """Each pixel beside each threshold, with its decision: for looking at few pixels.

    ``threshold_sweep`` gives the counts without these rows.
    """
    each = F.explode(F.array(*map(F.lit, thresholds)))
    return probs.withColumn("threshold", each).withColumn("pred", reaches(F.col(prob), F.col("threshold")).cast("int"))


def threshold_sweep(probs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, mode: str = "plain", prob: str = "prob", truth: str = "label", tiled: bool = False) -> DataFrame:
    """Counts and metrics per threshold; water is ``prob >= threshold``.

    A pixel adds to one bucket, the number of thresholds that it reaches. Counts at a threshold are
    sums over the buckets above: a window over as many rows as there are thresholds, so the pixels
    are read once and not repeated. Pixels whose probability is null or NaN, or without label, count as other.
    """
    cuts = sorted(set(thresholds))
    reached = sum((reaches(F.col(prob), F.lit(t)).cast("int") for t in cuts), F.lit(0))
    water = F.coalesce(F.col(truth) == 1, F.lit(False))
    buckets = probs.select(reached.alias("bucket"), water.alias("water")).groupBy("bucket").agg(F.count_if("water").alias("pos"), F.count_if(~F.col("water")).alias("neg"))
    table = F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(float(t)).alias("threshold")) for i, t in enumerate([-1.0, *cuts])))
    steps = probs.sparkSession.range(1).select(F.inline(table))
    rows = steps.join(F.broadcast(buckets), "bucket", "left").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("bucket", "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    counts = rows.where("bucket > 0").select("threshold", "tp", "fp", (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))
    return with_metrics(counts).select(F.lit(mode).alias("eval_mode"), "threshold", F.lit(tiled).alias("used_tiled_inference"), *METRICS, *COUNTS)


def tile_metrics(probs: DataFrame, threshold: float, mode: str = "plain", prob: str = "prob", truth: str = "label", tile: str = "tile", tiled: bool = False) -> DataFrame:
    """Counts, metrics and water pixels per tile at one threshold."""
    pred = reaches(F.col(prob), F.lit(threshold)).cast("int")
    counts = probs.groupBy(tile).agg(*confusion_columns(pred, F.col(truth)))
    rows = with_metrics(counts)
    return rows.select(
        F.col(tile).alias("tile_name"), F.lit(mode).alias("eval_mode"), F.lit(threshold).alias("threshold"), F.lit(tiled).alias("used_tiled_inference"),
        (F.col("tp") + F.col("fn")).alias("water_pixels"), *METRICS, *COUNTS,
    )


def scene_summary(probs: DataFrame, keys: tuple[str, ...] = ("scene_id",), prob: str = "prob", exact: bool = True) -> DataFrame:
    """Pixels and probability statistics per scene; probabilities are null where invalid.

    The 95th percentile is interpolated; with ``exact=False`` it is approximate and spares a shuffle
    of distinct values. Without valid pixels the statistics are 0. Keys are not null.
    """
    six = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 6)
    more = [] if exact else [F.percentile_approx(prob, 0.95, 10_000).alias("p95")]
    rows = probs.groupBy(*keys).agg(
        F.count("*").alias("total_pixels"), F.count(prob).alias("valid_pixels"),
        F.bround(1 - F.count(prob) / F.greatest(F.count("*"), F.lit(1)), 6).alias("nodata_fraction"),
        six(F.avg(prob)).alias("mean_probability"), six(F.max(prob)).alias("max_probability"), *more,
    )
    rows = rows.join(quantile(probs, 0.95, keys, prob).withColumnRenamed("value", "p95"), list(keys), "left") if exact else rows
    return rows.select(*keys, "total_pixels", "valid_pixels", "nodata_fraction", "mean_probability", six(F.col("p95")).alias("p95_probability"), "max_probability")


#: Rows of a table that is sent to all tasks, at most.
SENT_ROWS = 20_000


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A table of a row per group, broadcast if it is found to have ``rows`` at most; else it joins by a shuffle."""
    found = df.limit(rows + 1).collect()
    return df if len(found) > rows else F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def bounds(df: DataFrame, q: float, keys: tuple[str, ...], value: str, accuracy: int = 10_000) -> DataFrame:
    """Values of each group between which the quantile lies for sure: keys, total, low, high.

    A sketch of each group gives the values 2 / ``accuracy`` below and above the wanted rank, whose own
    ranks are off by 1 / ``accuracy`` at most. Groups of up to ten times ``accuracy`` values have none.
    """
    margin = 2 / accuracy
    near = df.groupBy(*keys).agg(F.count(value).alias("total"), F.percentile_approx(value, [max(q - margin, 0.0), min(q + margin, 1.0)], accuracy).alias("_near"))
    small = F.col("total") <= 10 * accuracy
    low = F.when(small | F.lit(q <= margin), float("-inf")).otherwise(F.get("_near", F.lit(0)))
    high = F.when(small | F.lit(q >= 1 - margin), float("inf")).otherwise(F.get("_near", F.lit(1)))
    return near.where("total > 0").select(*keys, "total", low.alias("low"), high.alias("high"))


def quantile(df: DataFrame, q: float, keys: tuple[str, ...], value: str, accuracy: int = 10_000) -> DataFrame:
    """The exact quantile of each group, between its two neighbours: keys, value.

    ``bounds`` tells between which values it lies, however narrow they are. Values below are counted in
    the tasks, those above dropped, and only the few between are exchanged, counted once each and put in
    order, so no task holds or sorts a large group. Keys aren't null.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    marked = rows.join(sent(bounds(rows, q, keys, "v", accuracy)), list(keys)).where("v <= high")
    counts = marked.groupBy(*keys, "total", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v"))
    first = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.select(*keys, "v", "n", first.alias("_first"), (q * (F.col("total") - 1)).alias("_rank"))
    lo, hi = F.floor("_rank"), F.ceil("_rank")
    holds = lambda k: F.max(F.when((F.col("_first") <= k) & (F.col("_first") + F.col("n") > k), F.col("v")))
    ends = ranked.groupBy(*keys, "_rank").agg(holds(lo).alias("a"), holds(hi).alias("b"))
    return ends.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("_rank") - lo)).alias("value"))


def audit(pixels: DataFrame, tile: str = "tile", split: str = "split", label: str = "label") -> DataFrame:
    """Per split: tiles, greatest height and width, and the distinct label values."""
    return pixels.groupBy(split).agg(
        F.countDistinct(tile).alias("tiles"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.array_sort(F.collect_set(label)).alias("label_values")
    )


def projection_norms(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Euclidean norms of weights (proj, band, w) by projected band and by source band."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    return weights.groupBy("proj").agg(norm), weights.groupBy("band").agg(norm)


def check_projection(weights: DataFrame, n_proj: int, n_bands: int) -> None:
    """Refuse weights that aren't exactly ``n_proj`` x ``n_bands``."""
    got = weights.agg(F.count("*"), F.countDistinct("proj"), F.countDistinct("band")).first()
    if tuple(got) != (n_proj * n_bands, n_proj, n_bands):
        raise ValueError(f"{n_proj} x {n_bands} weights are expected; rows, projections and bands are {tuple(got)}")


def top_weights(weights: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` greatest absolute weights per projected band: proj, rank, band, weight."""
    order = Window.partitionBy("proj").orderBy(F.desc(F.abs("w")), "band")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("proj", "rank", "band", F.bround(F.abs("w"), 6).alias("weight"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The best row of each mode and of all (``scope`` is the mode, or ``best_eval``).

    By water_iou, then dice, both falling, then the lower threshold; values are rounded.
    """
    order = [F.desc("water_iou"), F.desc("dice"), F.asc("threshold")]
    per = sweep.withColumn("_n", F.row_number().over(Window.partitionBy("eval_mode").orderBy(*order))).where("_n = 1")
    best = per.orderBy(*order, "eval_mode").limit(1)
    out = per.select(F.col("eval_mode").alias("scope"), "*").unionByName(best.select(F.lit("best_eval").alias("scope"), "*"))
    return out.select("scope", "eval_mode", F.bround("threshold", 4).alias("threshold"), *(F.bround(c, 6).alias(c) for c in ("water_iou", "dice", "precision", "recall")))


def top_rows_per_mode(sweep: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of each mode by water_iou and precision, falling, then threshold."""
    order = Window.partitionBy("eval_mode").orderBy(F.desc("water_iou"), F.desc("precision"), "threshold")
    return sweep.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def worst_tiles(metrics: DataFrame, n: int = 25) -> DataFrame:
    """The tiles with the least water_iou, precision, recall, then by name."""
    return metrics.orderBy("water_iou", "precision", "recall", "tile_name").limit(n)


#: Ranges of drawn order in which records are ranked apart.
RANGES = 4096


def _ranked(records: DataFrame, seed: int) -> DataFrame:
    """Records with their place in an order drawn from seed and name.

    The drawn hash falls into ``RANGES`` ranges; a range's records are ranked by themselves and start
    behind those of the ranges before it, whose counts are all that comes together.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), "name"))
    rows = records.withColumn("_draw", drawn).withColumn("_range", (F.conv(F.substring("_draw", 1, 7), 16, 10).cast("bigint") * RANGES / (1 << 28)).cast("int"))
    counts = rows.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_draw", "name"))
    return rows.join(F.broadcast(starts), "_range").withColumn("_rank", own + F.col("_start")).drop("_draw", "_range", "_start")


def split_train_valid(records: DataFrame, valid_pct: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation records, both in name order.

    Validation gets ``max(1, round(n * pct))`` with halves to even. An empty side is an error.
    """
    n = records.count()
    if not n:
        raise ValueError("there is no record to split")
    k = max(1, round(n * valid_pct))
    if k >= n:
        raise ValueError("no record is left for training; lower valid_pct")
    ranked = _ranked(records, seed)
    part = lambda c: ranked.where(c).drop("_rank").orderBy("name")
    return part(F.col("_rank") > k), part(F.col("_rank") <= k)


def cap_records(records: DataFrame, n: int | None, seed: int) -> DataFrame:
    """A drawn part of the records, of ``n`` at most, in name order."""
    if n is None:
        return records
    if n <= 0:
        raise ValueError("the number of records is positive")
    return _ranked(records, seed).where(F.col("_rank") <= n).drop("_rank").orderBy("name")


def subset_records(records: DataFrame, max_batches: int | None, batch_size: int) -> DataFrame:
    """The first records in name order that fill ``max_batches`` batches, one at least."""
    return records if max_batches is None else records.orderBy("name").limit(batch_size * max(1, max_batches))


def union_sweeps(*sweeps: DataFrame) -> DataFrame:
    """Rows of several sweeps."""
    out = sweeps[0]
    for s in sweeps[1:]:
        out = out.unionByName(s)
    return out


def threshold_list(ranges: list[tuple[float, float, float]]) -> tuple[float, ...]:
    """Distinct sorted thresholds of several (first, last, step), to two digits."""
    out = set()
    for first, last, step in ranges:
        for i in range(int(round((last - first) / step)) + 1):
            out.add(round(first + i * step, 2))
    return tuple(sorted(out))


def lovasz_softmax(df: DataFrame, by: list[str] | None = None, prob: str = "prob", truth: str = "label", buckets: int | None = None) -> DataFrame:
    """Lovasz-Softmax loss of two classes: mean over the classes present, 0 if none is (Berman et al., 2018).

    Errors are sorted falling; an error weighs as much as it moves the Jaccard loss. With ``by`` the loss
    of each group (a tile, say), else that of all rows. Pixels without probability or label don't count.

    Equal errors become one row, which changes nothing, and the rows of a group and class are dealt into
    ``buckets`` ranges (a power of 2; 64 by group, else 1024) of about equal size, cut at approximate
    quantiles of their own. Sums over the ranges above carry into a range, so no task sorts a whole group,
    and a model that is sure of most pixels fills no range more than others.
    """
    by, group = by or [], [*(by or []), "class"]
    buckets = buckets or (64 if by else 1024)
    if buckets & (buckets - 1):
        raise ValueError("the number of ranges is a power of 2")
    p = F.when(F.col("class") == 1, F.col(prob)).otherwise(1 - F.col(prob))
    rows = df.select(*by, F.col(prob), F.col(truth), F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    fg = (F.col(truth) == F.col("class")).cast("int")
    rows = rows.select(*group, fg.alias("fg"), F.abs(fg - p).alias("err"))
    equal = rows.where("err IS NOT NULL").groupBy(*group, "err").agg(F.sum("fg").alias("f"), F.count("*").alias("n"))
    shares = [k / buckets for k in range(1, buckets)]
    cuts = sent(equal.groupBy(*group).agg(F.percentile_approx("err", shares, 10 * buckets).alias("cuts"))) if buckets > 1 else None
    steps = F.array(*(F.lit(buckets >> k) for k in range(1, buckets.bit_length())))  # halving from half of them to 1
    place = F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get("cuts", i + step - 1) <= F.col("err"), i + step).otherwise(i))
    equal = equal.join(cuts, group).withColumn("_b", place).drop("cuts") if cuts is not None else equal.withColumn("_b", F.lit(0))
    sums = equal.groupBy(*group, "_b").agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
    above = Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*group, "_b", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in "fn"), F.sum("f").over(Window.partitionBy(*group)).alias("gts"))
    equal = equal.join(carry, [*group, "_b"])
    w = Window.partitionBy(*group, "_b").orderBy(F.desc("err")).rowsBetween(Window.unboundedPreceding, 0)
    equal = equal.withColumn("_f", F.sum("f").over(w) + F.col("f0")).withColumn("_n", F.sum("n").over(w) + F.col("n0"))
    grad = _jaccard_loss(F.col("_f"), F.col("_n")) - _jaccard_loss(F.col("_f") - F.col("f"), F.col("_n") - F.col("n"))
    losses = equal.where("gts > 0").groupBy(*group).agg(F.sum(F.col("err") * grad).alias("loss"))
    if not by:
        return losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))
    mean = losses.groupBy(*by).agg(F.avg("loss").alias("loss"))
    return df.select(*by).distinct().join(mean, by, "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))


def _jaccard_loss(f: Column, n: Column) -> Column:
    """The loss after the ``n`` greatest errors, ``f`` of them on the class, of ``gts`` pixels of it."""
    return F.when(n > 0, 1 - (F.col("gts") - f) / (F.col("gts") + n - f)).otherwise(0.0)


def _soft_dice(p: Column, y: Column, smooth: float) -> Column:
    return 1 - (2 * F.sum(p * y) + smooth) / (F.sum(p) + F.sum(y) + smooth)


def segmentation_loss(df: DataFrame, name: str, by: list[str] | None = None, prob: str = "prob", truth: str = "label", alpha: float = 1.0, smooth: float = 1.0, gamma: float = 2.0, eps: float = 1e-7) -> DataFrame:
    """``ce_dice``, ``focal_dice`` or ``lovasz`` per group, or over all rows.

    The first part is a mean over pixels: cross entropy, or the focal loss (Lin et al., 2017). The
    second is ``alpha`` times the soft Dice loss (Milletari et al., 2016) summed over both classes.
    """
    if name == "lovasz":
        return lovasz_softmax(df, by, prob, truth)
    if name not in ("ce_dice", "focal_dice"):
        raise ValueError(f"unknown loss: {name}")
    p, y = F.col(prob), (F.col(truth) == 1).cast("double")
    pt = F.greatest(F.when(F.col(truth) == 1, p).otherwise(1 - p), F.lit(eps))
    ce = -F.log(pt)
    first = F.avg(ce if name == "ce_dice" else F.pow(1 - pt, F.lit(gamma)) * ce)
    dice = _soft_dice(p, y, smooth) + _soft_dice(1 - p, 1 - y, smooth)
    loss = (first + alpha * dice).alias("loss")
    return df.groupBy(*by).agg(loss) if by else df.agg(loss)


def ce_dice_loss(df: DataFrame, by: list[str] | None = None, **more: float) -> DataFrame:
    """``segmentation_loss`` with cross entropy."""
    return segmentation_loss(df, "ce_dice", by, **more)


def focal_dice_loss(df: DataFrame, by: list[str] | None = None, **more: float) -> DataFrame:
    """``segmentation_loss`` with the focal loss."""
    return segmentation_loss(df, "focal_dice", by, **more)


def mean_tile_loss(df: DataFrame, name: str = "ce_dice", tile: str = "tile") -> DataFrame:
    """Mean over tiles of the loss of each."""
    return segmentation_loss(df, name, [tile]).agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("tiles"))
