"""Pairing of files, alignment of pixels, and checks of grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = ("crs", "a", "b", "c", "d", "e", "f", "width", "height")


def pair_triplets(s1: DataFrame, aef: DataFrame | None, label: DataFrame) -> DataFrame:
    """Radar files with their embedding and label by name: name, the paths, and status.

    ``status`` is ``paired``, ``missing_aef`` or ``missing_label``; the embedding is looked at first.
    Each side has one row per name.
    """
    rows = s1.select("name", F.col("path").alias("s1_path"))
    if aef is None:
        rows = rows.withColumn("aef_path", F.lit(None).cast("string"))
    else:
        rows = rows.join(aef.select("name", F.col("path").alias("aef_path")), "name", "left")
    rows = rows.join(label.select("name", F.col("path").alias("label_path")), "name", "left")
    no_aef = F.lit(False) if aef is None else F.col("aef_path").isNull()
    return rows.withColumn("status", F.when(no_aef, "missing_aef").when(F.col("label_path").isNull(), "missing_label").otherwise("paired"))


def paired(rows: DataFrame) -> DataFrame:
    """The complete triplets, or an error if there is none."""
    found = rows.where("status = 'paired'").drop("status")
    if found.isEmpty():
        raise FileNotFoundError(f"no triplet: {pairing_report(rows).first().asDict()}")
    return found


def pairing_report(rows: DataFrame, examples: int = 3) -> DataFrame:
    """One row: counts of pairs and rejects, and the first rejects by name."""
    kinds = ("missing_aef", "missing_label")
    named = rows.groupBy("status").agg(F.count("*").alias("n"))
    firsts = None
    for kind in kinds:  # top-k by kind, never a list of all names
        top = rows.where(F.col("status") == kind).orderBy("name").limit(examples).select(F.lit(kind).alias("status"), "name")
        firsts = top if firsts is None else firsts.unionByName(top)
    counts = named.agg(*(F.coalesce(F.sum(F.when(F.col("status") == k, F.col("n"))), F.lit(0)).alias(a) for k, a in (("paired", "pairs"), ("missing_aef", "missing_aef_count"), ("missing_label", "missing_label_count"))))
    lists = firsts.agg(*(F.array_sort(F.collect_list(F.when(F.col("status") == k, F.col("name")))).alias(f"{k}_examples") for k in kinds))
    return counts.crossJoin(F.broadcast(lists))


def align_pixels(s1: DataFrame, aef: DataFrame, label: DataFrame, on: tuple[str, ...] = ("tile", "row", "col"), strict: bool = True) -> DataFrame:
    """The three layers of each pixel by position.

    ``strict`` refuses tiles whose layers differ in shape, naming some; else pixels without all three
    layers are left out.
    """
    if strict and (bad := shape_mismatches({"s1": s1, "aef": aef, "label": label}, on[0]).orderBy(on[0]).limit(5).collect()):
        raise ValueError(f"layers differ in shape in tiles {[r[on[0]] for r in bad]}")
    return s1.join(aef, list(on)).join(label, list(on))


def shape_mismatches(layers: dict[str, DataFrame], tile: str = "tile") -> DataFrame:
    """Tiles whose layers differ in height, width or number of pixels."""
    sizes = None
    for name, df in layers.items():
        one = df.groupBy(tile).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.count("*").alias("n")).withColumn("layer", F.lit(name))
        sizes = one if sizes is None else sizes.unionByName(one)
    same = sizes.groupBy(tile).agg(F.countDistinct("h", "w", "n").alias("shapes"), F.count("*").alias("layers"))
    return same.where((F.col("shapes") > 1) | (F.col("layers") < len(layers)))


#: Target cells whose source cells, found once for all keys, are sent to all tasks; larger grids are crossed by partitions.
SENT_CELLS = 1 << 16


def regrid_nearest(source: DataFrame, src_grid: dict[str, float], dst_grid: dict[str, float], values: list[str], to_src: Callable[[Column, Column], tuple[Column, Column]] | None = None, targets: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The source pixel nearest to each target pixel; outside of the source the values are null.

    Grids have an affine transform a to f, width and height. The centre of a target pixel goes to
    map coordinates, through ``to_src`` if the reference systems differ, and back to a source row
    and column, which makes the join an equi-join. ``source`` and ``targets`` have row and col and
    the columns ``keys`` (a tile, say); without ``targets`` the whole target grid is made, for each
    of the keys that the source has.

    The whole grid is projected once and not once for a key, and each source cell is joined once: the
    target cells that it serves come out of it afterwards.
    """
    spark = source.sparkSession
    pixels = source.select(*keys, F.col("row").alias("src_row"), F.col("col").alias("src_col"), *values)
    if targets is not None:
        at = _source_cells(targets, src_grid, dst_grid, to_src)
        return at.join(pixels, [*keys, "src_row", "src_col"], "left").select(*keys, "row", "col", *values)
    w = int(dst_grid["width"])
    n = w * int(dst_grid["height"])
    cells = spark.range(n).select((F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col"))
    lots = _source_cells(cells, src_grid, dst_grid, to_src).groupBy("src_row", "src_col").agg(F.collect_list(F.struct("row", "col")).alias("_cells"))
    if keys:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few keys make many rows: not left to one task
        every = source.select(*keys).distinct().repartition(parts, *keys)
        lots = every.crossJoin(F.broadcast(lots) if n <= SENT_CELLS else lots)
    rows = lots.join(pixels, [*keys, "src_row", "src_col"], "left")
    return rows.select(*keys, *values, F.inline("_cells")).select(*keys, "row", "col", *values)


def _source_cells(targets: DataFrame, src_grid: dict[str, float], dst_grid: dict[str, float], to_src: Callable[[Column, Column], tuple[Column, Column]] | None) -> DataFrame:
    """``targets`` with the source cell, src_row and src_col, that holds the centre of each."""
    g, s = dst_grid, src_grid
    x = g["a"] * (F.col("col") + 0.5) + g["b"] * (F.col("row") + 0.5) + g["c"]
    y = g["d"] * (F.col("col") + 0.5) + g["e"] * (F.col("row") + 0.5) + g["f"]
    if to_src:
        x, y = to_src(x, y)
    det = s["a"] * s["e"] - s["b"] * s["d"]
    u, v = x - s["c"], y - s["f"]
    return targets.withColumn("src_col", F.floor((s["e"] * u - s["b"] * v) / det).cast("int")).withColumn("src_row", F.floor((s["a"] * v - s["d"] * u) / det).cast("int"))


def attach_stats(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """The statistics of all bands as two arrays, ``mean`` and ``std``, beside every pixel.

    They are one row, whose length the bands bound, so it is broadcast.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct("band", "mean", "std")))
    row = stats.agg(sorted_.alias("s")).select(F.col("s.mean").alias("mean"), F.col("s.std").alias("std"))
    return pixels.crossJoin(F.broadcast(row))


def check_grid(grids: DataFrame, expected_bands: int = 3, order: str = "raster_id") -> DataFrame:
    """Rasters whose band count or grid differs from the first raster's: raster_id, problem.

    Nulls compare as values. The first raster is the least in ``order``.
    """
    first = grids.orderBy(order).limit(1).select(*(F.col(c).alias(f"first_{c}") for c in GRID))
    same = F.lit(True)
    for c in GRID:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    rows = grids.crossJoin(F.broadcast(first))
    problem = F.when(F.coalesce(F.col("bands") != expected_bands, F.lit(True)), "bands").when(~same, "grid")
    return rows.select(order, problem.alias("problem")).where("problem IS NOT NULL")


def require_grid(grids: DataFrame, expected_bands: int = 3) -> DataFrame:
    """``grids``, or an error naming the first raster that differs."""
    if bad := check_grid(grids, expected_bands).orderBy("raster_id").limit(5).collect():
        raise ValueError("rasters differ: " + ", ".join(f"{r['raster_id']} ({r['problem']})" for r in bad))
    return grids


def skip_existing(plan: DataFrame, done: DataFrame, key: str = "scene") -> tuple[DataFrame, DataFrame]:
    """Scenes to score, and a report of those already written."""
    work = plan.join(done.select(key), key, "left_anti")
    report = plan.join(done.select(key), key, "left_semi").withColumn("status", F.lit("skipped-existing")).withColumn("seconds", F.lit(0.0))
    return work, report


def label_tiles(metrics: DataFrame, records: DataFrame, tile: str = "tile_name") -> DataFrame:
    """Metrics, as ``tile_metrics`` gives them, with the record of their tile, by name."""
    return metrics.join(records, metrics[tile] == records["name"]).drop("name")
