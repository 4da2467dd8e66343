"""The registered queries over the raster operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandframe.functions import columns as C
from bandframe.functions.projection import between, utm
from bandframe.operators import evaluate as E
from bandframe.operators import grid as G
from bandframe.operators import joins as J
from bandframe.operators.score import compare_features, score_blocks, score_pixels, tta_average
from bandframe.plans.fixtures import view, workdir
from bandframe.sources import files as S
from bandframe.streaming import incremental as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
H, W, N_BANDS = 30, 50, 67
#: Weights of the linear head of the queries: one row per class.
HEAD = tuple([(((c * 13 + i * 7) % 11) - 5) / 50 for i in range(N_BANDS)] for c in range(2))


def query(f: Query) -> Query:
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel fixture with the names of the operators: tile, row, col, s1, prob, label."""
    px = view(spark, sf_dir, "px").withColumnsRenamed({"tile_no": "tile", "row_i": "row", "col_i": "col"})
    s1 = F.array("vv", "vh", "angle")
    return px.withColumn("s1", s1).withColumn("prob", F.col("p_milli") / F.lit(1000.0)).withColumn("label", C.remap_class(F.col("dw_class")))


def banded(px: DataFrame) -> DataFrame:
    """Pixels with all bands, cleaned."""
    return px.withColumn("bands", C.clean_bands(C.stack_bands(F.col("s1"), F.col("aef"))))


def is_valid() -> Column:
    return C.validity(F.col("s1"), F.col("s1_mask"), F.col("aef"), nodata=-128.0)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets of the file fixture with their status."""
    files = view(spark, sf_dir, "tile_files")
    sides = {k: S.index_by_name(files.where(F.col("kind") == k), root="/d/", strict=False) for k in ("s1", "aef", "label")}
    return J.pair_triplets(sides["s1"], sides["aef"], sides["label"])


@query
def q01_discover_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "scene_paths")
    return S.scene_manifest(S.discover_scenes(files, years=[1993, 1995, 1996], max_scenes=100, strict=False), "s1aef", "/d/aef.tif")


@query
def q02_pair_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query
def q03_manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.shape_manifest(view(spark, sf_dir, "manifest"), sample_id="a", strict=False)
    return S.missing_paths(rows, view(spark, sf_dir, "tile_files"))


@query
def q04_read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all tiles from a store that was written before."""
    root = workdir(spark)
    px = pixels(spark, sf_dir).select(F.col("tile").cast("string").alias("scene_id"), "row", "col", "px_id", "p_milli", "s1", "aef")
    S.write_pixels(px, f"{root}/pixels", block=8)
    rows = S.read_window(S.read_pixels(spark, f"{root}/pixels"), 5, 10, 10, 20, block=8)
    return rows.select("px_id", F.col("scene_id").cast("bigint").alias("tile"), "row", "col", "p_milli")


@query
def q05_split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = pairs(spark, sf_dir).where("status = 'paired'").withColumn("sample_id", F.lit("all"))
    train, valid = E.split_train_valid(records, 0.2, 42)
    return S.split_manifest(E.cap_records(train, 300, 42), E.subset_records(valid, 10, 8))


@query
def q06_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.year_counts(S.scene_dates(view(spark, sf_dir, "scene_paths")))


@query
def q07_clean_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("px_id", F.round(C.clean_nonfinite(F.col("vv")) * 100).cast("bigint").alias("vv_centi"))


@query
def q08_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("px_id", "label", C.binarize_label(F.col("label")).alias("mask"), C.binarize_label(F.col("vv")).alias("bright"))


@query
def q09_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("px_id", is_valid().alias("valid"))


@query
def q10_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = banded(pixels(spark, sf_dir))
    rows = J.attach_stats(px, E.band_stats(px, N_BANDS))
    rows = rows.withColumn("bands", C.normalize(C.fill_invalid(F.col("bands"), is_valid(), F.col("mean")), F.col("mean"), F.col("std")))
    sums = rows.groupBy("tile").agg(*(F.sum(F.get("bands", F.lit(i))).alias(f"b{i}") for i in SHOWN))
    return sums.select("tile", *((F.round(f"b{i}", 4) + 0.0).alias(f"b{i}") for i in SHOWN))


@query
def q11_align_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    on = ("tile", "row", "col")
    s1, aef = px.select(*on, "p_milli"), px.where("px_id % 13 <> 0").select(*on, F.size("aef").alias("n_aef"))
    rows = J.align_pixels(s1, aef, px.where("px_id % 7 <> 0").select(*on, "label"), on, strict=False)
    return rows.groupBy("tile").agg(F.count("*").alias("n"), F.sum("p_milli").alias("p_milli"), F.sum("label").alias("water"), F.sum("n_aef").alias("n_aef"))


@query
def q12_project_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "proj_w").orderBy("proj", "band").collect()  # 16 x 64 weights
    weights = [[r["w"] for r in rows if r["proj"] == p] for p in range(16)]
    both = C.stack_bands(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("embedding"))
    out = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("b", both)
    s1, aef = C.split_bands(F.col("b"), 3)
    out = out.select("vec_id", F.posexplode(F.concat(s1, C.project_bands(aef, weights))).alias("band", "value"))
    return out.select("vec_id", "band", (F.round("value", 5) + 0.0).alias("value"))


@query
def q13_regrid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onto a finer grid of the same zone, and onto one of the next zone, whose axes are turned a little."""
    px = pixels(spark, sf_dir).select("tile", "row", "col", "p_milli")
    src = {"a": 10.0, "b": 0.0, "c": 740000.0, "d": 0.0, "e": -10.0, "f": 4600000.0}
    same = {"a": 5.0, "b": 0.0, "c": 739987.5, "d": 0.0, "e": -5.0, "f": 4600007.5, "width": 104, "height": 64}
    other = same | {"c": 239295.0, "f": 4600710.0}
    grids = {"same": (same, None), "other": (other, between(utm(15), utm(16)))}
    parts = [J.regrid_nearest(px, src, dst, ["p_milli"], to_src, keys=("tile",)).withColumn("zone", F.lit(zone)) for zone, (dst, to_src) in grids.items()]
    out = parts[0].unionByName(parts[1])
    return out.groupBy("zone", "tile", "row").agg(F.count("*").alias("cells"), F.count("p_milli").alias("inside"), F.coalesce(F.sum(F.col("p_milli") * (F.col("col") + 1)), F.lit(0)).alias("weighted"))


@query
def q14_window_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.assign_windows(pixels(spark, sf_dir), 16, 4, H, W)
    rows = rows.withColumn("logit0", F.col("top") * 0.01 - F.col("prob")).withColumn("logit1", F.col("prob") + F.col("left") * 0.02)
    out = G.stitch(rows, ("tile",))
    return out.select("tile", "row", "col", F.round(C.softmax_water(F.col("logit0"), F.col("logit1")), 6).alias("prob"))


@query
def q15_check_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.check_grid(view(spark, sf_dir, "grid_headers"))


@query
def q16_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "scene_paths")
    plan = S.scene_dates(files).select("path", "year").distinct()
    work, report = J.skip_existing(plan, files.where("file_id % 4 = 0").select("path").distinct(), "path")
    return work.withColumn("status", F.lit("to-do")).unionByName(report.drop("seconds"))


@query
def q17_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.threshold_sweep(pixels(spark, sf_dir), prob="p_raw"))


def rounded(sweep: DataFrame) -> DataFrame:
    """Metrics to six digits."""
    return sweep.select(*(F.round(c, 6).alias(c) if c in E.METRICS else F.col(c) for c in sweep.columns))


@query
def q18_tile_metrics_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = rounded(E.tile_metrics(pixels(spark, sf_dir), 0.55, prob="p_raw"))
    worst = E.worst_tiles(tiles, 25)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    records = parts.select(F.col("p_partkey").alias("name"), F.concat(F.lit("/d/s1/tile_"), "p_partkey").alias("s1_path"))
    return J.label_tiles(worst, records).withColumnRenamed("tile_name", "tile")


@query
def q19_score_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_pixels(banded(pixels(spark, sf_dir)), HEAD)
    prob = C.mask_probability(C.softmax_water(F.col("logit0"), F.col("logit1")), is_valid())
    return rows.select("px_id", F.round(prob, 5).alias("prob"))


@query
def q20_scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).withColumn("prob", C.mask_probability(F.col("prob"), is_valid()))
    return E.scene_summary(rows, ("tile",))


@query
def q21_band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = banded(pixels(spark, sf_dir))
    out = E.band_stats(px, N_BANDS, px.select("tile"), max_files=256)
    return out.select("band", (F.round("mean", 6) + 0.0).alias("mean"), F.round("std", 6).alias("std"))


@query
def q22_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    pred = C.argmax_water(1 - F.col("prob"), F.col("prob"))
    counts = rounded(E.with_metrics(E.confusion(px, pred, F.col("label"))))
    return counts.crossJoin(F.broadcast(E.water_iou(px, pred, F.col("label")).select(F.round("water_iou", 6).alias("iou_metric"))))


@query
def q23_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("split", F.when(F.col("tile") % 5 == 0, "valid").otherwise("train"))
    return E.audit(px).withColumn("label_values", F.array_join(F.col("label_values").cast("array<string>"), ","))


@query
def q24_projection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = view(spark, sf_dir, "proj_w")
    E.check_projection(w, 16, 64)
    by_proj, by_band = E.projection_norms(w)
    top = E.top_weights(w).select(F.lit("top").alias("kind"), "proj", "band", "rank", F.col("weight").alias("value"))
    norm = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), (F.col("proj") if key == "proj" else F.lit(-1)).cast("bigint").alias("proj"), (F.col("band") if key == "band" else F.lit(-1)).cast("bigint").alias("band"), F.lit(0).alias("rank"), F.round("norm", 6).alias("value"))
    return top.unionByName(norm(by_proj, "proj_norm", "proj")).unionByName(norm(by_band, "band_norm", "band"))


@query
def q25_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("prob", F.least(F.greatest(F.col("prob"), F.lit(0.001)), F.lit(0.999)))
    ce, focal = E.ce_dice_loss(px, ["tile"]), E.focal_dice_loss(px, ["tile"])
    rows = ce.withColumnRenamed("loss", "ce_dice").join(focal.withColumnRenamed("loss", "focal_dice"), "tile")
    mean = F.broadcast(E.mean_tile_loss(px).select("mean_loss"))  # one row
    return rows.crossJoin(mean).select("tile", *(F.round(c, 5).alias(c) for c in ("ce_dice", "focal_dice", "mean_loss")))


@query
def q26_lovasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lovasz_softmax(pixels(spark, sf_dir), ["tile"]).select("tile", F.round("loss", 6).alias("loss"))


@query
def q27_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    other = px.withColumn("prob", F.least(F.col("p_milli") + F.col("px_id") % 60, F.lit(1000)) / F.lit(1000.0))
    both = E.union_sweeps(E.threshold_sweep(px, mode="plain", prob="p_raw"), E.threshold_sweep(other, mode="tta"))
    best = E.best_threshold(both).select(F.lit("best").alias("kind"), "scope", "eval_mode", "threshold", F.lit(1).alias("rank"), "water_iou")
    top = E.top_rows_per_mode(both).select(F.lit("top").alias("kind"), F.col("eval_mode").alias("scope"), "eval_mode", "threshold", "rank", F.bround("water_iou", 6).alias("water_iou"))
    return best.unionByName(top)


@query
def q28_plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plan_windows(view(spark, sf_dir, "grid_headers"), 16, 4).select("raster_id", "top", "left", "h", "w")


def looks_left(px: DataFrame) -> DataFrame:
    """A scorer that adds half of its left neighbour's value."""
    left = F.lag("prob").over(Window.partitionBy("tile", "flip", "row").orderBy("col"))
    parts = int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, so that small compressed parts aren't merged to one large sort
    px = px.repartition(parts, "tile", "flip", "row")
    return px.withColumn("logit1", F.col("prob") * 2 + F.coalesce(left, F.lit(0.0)) / 2).withColumn("logit0", F.lit(1.0))


@query
def q29_flips_tta(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).select("tile", "row", "col", "prob")
    both = tta_average(px, looks_left, ("logit_mean", "prob_mean"), H, W)
    return both.select("tile", "row", "col", F.round("logit_mean", 6).alias("logit_mean"), F.round("prob_mean", 6).alias("prob_mean"))


@query
def q30_crop_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).select("tile", "row", "col", "px_id", F.array("vh", "angle", "prob").alias("bands"), "label")
    rows = G.random_crop(px, 16, 7, 1, H, W)
    rows = G.radar_jitter(G.random_flip_rot(rows, 7, 16), 0.1, 0.5, 7, n_s1=2)
    return rows.select("tile", "row", "col", "px_id", "label", *(F.round(F.get("bands", F.lit(i)), 5).alias(f"b{i}") for i in range(3)))


@query
def q31_pairing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.pairing_report(pairs(spark, sf_dir))
    return out.select("pairs", "missing_aef_count", "missing_label_count", *(F.array_join(c, ",").alias(c) for c in ("missing_aef_examples", "missing_label_examples")))


@query
def q32_lovasz_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lovasz_softmax(pixels(spark, sf_dir), buckets=512).select(F.round("loss", 6).alias("loss"))


#: Weights of the embedding bands in the block scorer of the queries.
SEEN = [(k % 5) - 2 for k in range(64)]


def sees_left(blocks: np.ndarray) -> np.ndarray:
    """A block scorer of 67 bands that adds half of the left neighbour's value."""
    first = blocks[:, 0].astype(float)
    left = np.zeros_like(first)
    left[:, :, 1:] = first[:, :, :-1]
    return np.stack([np.ones_like(left), first * 2 + left / 2 + np.einsum("nkrc,k->nrc", blocks[:, 3:], np.array(SEEN, float))], 1)


def blockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with 67 bands that float32 holds exactly."""
    px = pixels(spark, sf_dir)
    return px.select("tile", "row", "col", C.stack_bands(F.array("p_milli", F.col("px_id") % 7, F.lit(1)), F.col("aef")).alias("bands"))


@query
def q33_blocks_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = G.assign_windows(blockwise(spark, sf_dir), 16, 4, H, W)
    out = G.stitch(score_blocks(windows, sees_left, 16, N_BANDS, overlap=4, keys=("tile",)), ("tile",))
    return out.select("tile", "row", "col", F.round("logit1", 4).alias("logit1"), "failed", "error")


@query
def q45_packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as they are stored, and what is in them."""
    blocks = G.to_blocks(G.assign_windows(blockwise(spark, sf_dir), 16, 4, H, W), 16, N_BANDS, ("tile",))
    names = ["tile", "top", "left", "cells", *(f"b{k}" for k in (0, 1, 2, 3, 66))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                planes, there = G.unpack_block(row["block"], row["cells"], 16, N_BANDS)
                corner = [float(planes[k].astype(float).sum()) for k in (0, 1, 2, 3, 66)]
                values = (row["tile"], row["top"], row["left"], int(there.sum()), *corner)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

    sums = blocks.mapInArrow(looked_at, "tile long, top int, left int, cells long, b0 double, b1 double, b2 double, b3 double, b66 double")
    return sums.select("tile", "top", "left", "cells", *((F.round(f"b{k}", 3) + 0.0).alias(f"b{k}") for k in (0, 1, 2, 3, 66)))


#: Bands that queries over all 67 show.
SHOWN = (0, 1, 2, 3, 34, 66)


def cropped(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """One crop per tile with all bands."""
    px = banded(pixels(spark, sf_dir)).select("tile", "row", "col", "bands", "label")
    return G.random_crop(px, size, 7, 1, H, W)


def shown(rows: DataFrame) -> DataFrame:
    """Some bands to five digits; weights of whole fractions end in a 5 behind them, which goes up."""
    return rows.select("tile", "row", "col", "label", *((F.round(F.get("bands", F.lit(i)) + 1e-9, 5) + 0.0).alias(f"b{i}") for i in SHOWN))


@query
def q34_scale_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(G.scale_jitter(cropped(spark, sf_dir, 30), 30, 0.8, 1.25, 7))


@query
def q35_rotate_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(G.rotate_small(cropped(spark, sf_dir, 16), 16, 5.0, 0.7, 7))


@query
def q36_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("prob", C.mask_probability(F.col("prob"), is_valid()))
    root = workdir(spark)
    S.write_probability(px.select(F.concat(F.lit("tile_"), "tile").alias("scene_id"), (F.col("tile") % 3 + 2000).cast("int").alias("year"), "row", "col", "prob"), root)
    return S.read_probability(spark, root).select("scene_id", "year", "row", "col", F.round(F.col("prob").cast("double"), 4).alias("prob"))


@query
def q37_run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = view(spark, sf_dir, "grid_headers").orderBy("raster_id").select("crs", "width", "height")
    out = S.run_config(S.scene_dates(view(spark, sf_dir, "scene_paths")), {"tile_size": "512", "overlap": "64"}, grid)
    return out.select(F.to_json("settings").alias("settings"), "scene_count", F.to_json("by_year").alias("by_year"), F.to_json("grid").alias("grid"))


@query
def q38_distinct_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_samples(view(spark, sf_dir, "manifest")).select(F.array_join("sample_ids", ",").alias("sample_ids"))


@query
def q39_apply_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = E.threshold_list([(0.30, 0.50, 0.05), (0.55, 0.70, 0.01), (0.75, 0.80, 0.05)])
    rows = E.apply_thresholds(pixels(spark, sf_dir).select("px_id", "p_raw"), thresholds, prob="p_raw")
    return rows.groupBy("threshold").agg(F.count("*").alias("pixels"), F.sum("pred").alias("water"))


@query
def q40_stored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, px = workdir(spark), banded(pixels(spark, sf_dir))
    S.resolve_band_stats(spark, f"{root}/stats", N_BANDS, lambda: E.band_stats(px, N_BANDS))
    out = S.resolve_band_stats(spark, f"{root}/next", N_BANDS, lambda: E.band_stats(px, N_BANDS), parent=f"{root}/stats")
    return out.select("band", (F.round("mean", 6) + 0.0).alias("mean"), F.round("std", 6).alias("std"))


@query
def q41_eval_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, root = pixels(spark, sf_dir), workdir(spark)
    sweep, tiles = E.threshold_sweep(px, prob="p_raw"), E.tile_metrics(px, 0.55, prob="p_raw")
    S.write_eval_artifacts(root, sweep, tiles, E.worst_tiles(tiles, 25), E.best_threshold(sweep))
    read = lambda name, df: spark.read.csv(f"{root}/{name}", header=True, schema=df.schema)
    worst = rounded(read("worst_tiles", tiles)).select(F.lit("worst").alias("kind"), F.col("tile_name").alias("key"), "water_iou", "tp", "fn")
    both = rounded(read("threshold_sweep", sweep)).select(F.lit("sweep").alias("kind"), F.round(F.col("threshold") * 100).cast("bigint").alias("key"), "water_iou", "tp", "fn")
    return worst.unionByName(both)


@query
def q42_stream_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes in three files each; some have a wrong pixel in one of them, and the scorer fails on one scene."""
    root = workdir(spark)
    wrong = (F.col("tile") % 10 == 3) & (F.col("row") == 4) & (F.col("col") == 7)
    px = pixels(spark, sf_dir).withColumn("s1", F.when(wrong, F.array("vv")).otherwise(F.col("s1")))
    px = px.select(F.concat(F.lit("tile_"), "tile").alias("scene_id"), F.lit(2025).alias("year"), "row", "col", "s1", "aef", "s1_mask", "prob")
    px.repartition(3, "col").write.parquet(f"{root}/in")  # a file at a time
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stuck = (F.col("scene_id") == "tile_6") & (F.col("row") == 5) & (F.col("col") == 11)
    prob = F.when(stuck, F.raise_error(F.lit("cannot score tile_6")).cast("double")).otherwise(C.mask_probability(F.col("prob"), is_valid()))
    X.score_new_scenes(stream, f"{root}/out", lambda df: df.withColumn("prob", prob), f"{root}/checkpoint").awaitTermination()
    rows = X.read_summary(spark, f"{root}/out")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_pixels", "valid_pixels")]
    error = F.when(F.contains("error", F.lit("cannot score tile_6")), "scorer").otherwise(F.col("error")).alias("error")
    return rows.select("scene", "year", "status", *counts, *(F.round(c, 3).alias(c) for c in ("mean_probability", "max_probability")), error)


#: Statistics of the three bands of the training tables.
THREE = ([-15.0, 37.0, 0.5], [8.0, 4.0, 0.3])


def three_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with three bands."""
    return pixels(spark, sf_dir).select("tile", "row", "col", F.array("vh", "angle", "prob").alias("bands"), "label")


@query
def q43_training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch with every step: crop, flips, scale, rotation, radar jitter, noise, normalising."""
    more = {"scale": (0.8, 1.25), "rotate": (5.0, 0.7), "radar": (0.1, 0.5), "noise": (0.05, 0.5)}
    rows = G.training_table(three_bands(spark, sf_dir), THREE, size=30, h=H, w=W, seed=7, epoch=1, **more)
    return rows.select("tile", "row", "col", "label", *((F.round(F.get("bands", F.lit(i)), 4) + 0.0).alias(f"b{i}") for i in range(3)))


@query
def q46_validation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.validation_table(three_bands(spark, sf_dir).where("tile % 5 = 0"), THREE)
    return rows.select("tile", "row", "col", "label", *((F.round(F.get("bands", F.lit(i)), 5) + 0.0).alias(f"b{i}") for i in range(3)))


@query
def q44_pixel_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out strips of tiles by a classifier with radar alone and with the embedding: sweeps and best thresholds."""
    px = banded(pixels(spark, sf_dir)).where("label IS NOT NULL").select("bands", "label", ((F.col("tile") * 3 + F.floor(F.col("row") / 10)) % 5 == 0).alias("held"))
    sweep, best = compare_features(px.where("NOT held"), px.where("held"), model="gaussian")
    rows = sweep.select(F.lit("sweep").alias("part"), "eval_mode", F.round("threshold", 2).alias("threshold"), *E.COUNTS)
    best = best.where("scope <> 'best_eval'").select("eval_mode", F.round("threshold", 2).alias("threshold"))
    return rows.unionByName(rows.join(F.broadcast(best), ["eval_mode", "threshold"]).withColumn("part", F.lit("best")))
