"""Listings, manifests, pixel tables and result files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandframe.functions.columns import NODATA, file_name, hidden_path

#: Columns of the summary and of the split manifest (fixed values of the file formats).
SUMMARY_COLUMNS = (
    "date", "year", "scene", "s1_path", "prob_path", "status", "seconds", "total_pixels", "valid_pixels",
    "nodata_fraction", "mean_probability", "p95_probability", "max_probability", "error",
)
MANIFEST_COLUMNS = ("split", "sample_id", "name", "s1_path", "aef_path", "label_path")


def list_files(spark: SparkSession, root: str, glob: str = "*.tif") -> DataFrame:
    """Paths, sizes and times of files below ``root``; their contents aren't read.

    Spark leaves out hidden files and folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def some_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``, or an error if it has no row."""
    if df.isEmpty():
        raise FileNotFoundError(message)
    return df


def scene_dates(files: DataFrame) -> DataFrame:
    """Files named ``s1_<date>.tif`` with date, year and scene; other names are left out.

    Day and month may have one digit, the year has four.
    """
    name = F.substring_index("path", "/", -1)
    named = files.where(name.startswith("s1_") & name.endswith(".tif")).select("path", F.substring_index(name, ".tif", 1).alias("scene"), name.alias("_name"))
    named = named.where(F.length("_name") == F.length("scene") + 4)  # a name may hold .tif once more
    found = named.withColumn("date", scene_date(F.col("scene"))).where("date IS NOT NULL")
    return found.select("path", F.date_format("date", "yyyy-MM-dd").alias("date"), F.year("date").alias("year"), "scene")


def scene_date(scene: Column) -> Column:
    """The date that a scene's name holds, null if none."""
    text = F.replace(scene, F.lit("s1_"), F.lit(""))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("y-M-d")).cast("date"))


def filter_years(scenes: DataFrame, years: list[int] | None) -> DataFrame:
    """Scenes of the given years."""
    return scenes if years is None else scenes.where(F.col("year").isin([int(y) for y in years]))


def discover_scenes(files: DataFrame, years: list[int] | None = None, max_scenes: int | None = None, output_dir: str = "out", strict: bool = True) -> DataFrame:
    """The scenes to score: date, year, scene, s1_path, prob_path, in the order of path parts.

    ``max_scenes`` keeps the first in that order, in which ``a/b`` comes before ``a-b``.
    """
    scenes = filter_years(scene_dates(files), years)
    prob = F.concat(F.lit(f"{output_dir}/probabilities/"), F.col("year").cast("string"), F.lit("/"), F.col("scene"), F.lit("_prob.tif"))
    scenes = scenes.select("date", "year", "scene", F.col("path").alias("s1_path"), prob.alias("prob_path"))
    scenes = scenes.orderBy(F.split("s1_path", "/"))
    scenes = scenes if max_scenes is None else scenes.limit(max_scenes)
    return some_rows(scenes, "no scene matches") if strict else scenes


def index_by_name(files: DataFrame, root: str = "", strict: bool = True) -> DataFrame:
    """One row per file name: name, path (the first), copies. Paths with a hidden part don't count.

    ``strict`` refuses names that occur in several folders, and an empty index.
    """
    seen = files.where(~hidden_path(F.substring("path", len(root) + 1, 1 << 20)))
    index = seen.groupBy(file_name(F.col("path")).alias("name")).agg(F.min("path").alias("path"), F.count("*").alias("copies"))
    if strict:
        if twice := [r["name"] for r in index.where("copies > 1").orderBy("name").limit(5).collect()]:
            raise RuntimeError(f"file names occur in several folders, such as {twice}")
        some_rows(index, "no embedding file")
    return index


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def distinct_samples(rows: DataFrame) -> DataFrame:
    """One row: the sorted distinct sample ids that aren't empty."""
    return rows.agg(F.array_sort(F.collect_set(F.when(_or_empty("sample_id") != "", F.col("sample_id")))).alias("sample_ids"))


def missing_columns(rows: DataFrame, expect_aef: bool) -> list[str]:
    """Columns that a manifest needs and hasn't."""
    return sorted({"s1_path", "label_path", *(["aef_path"] if expect_aef else [])} - set(rows.columns))


def filter_sample(rows: DataFrame, sample_id: str | None) -> DataFrame:
    """Rows of one sample, or all."""
    return rows if sample_id is None else rows.where(_or_empty("sample_id") == sample_id)


def shape_manifest(rows: DataFrame, sample_id: str | None = None, expect_aef: bool = True, strict: bool = True) -> DataFrame:
    """Manifest rows as triplets: name, s1_path, aef_path, label_path, sample_id, in name order.

    The name is tile_name, else name, else the radar file's name; empty text counts as none.
    """
    if gone := missing_columns(rows, expect_aef):
        raise ValueError(f"the manifest has no columns {', '.join(gone)}")
    for c in ("sample_id", "tile_name", "name", "aef_path"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    if strict and sample_id is None:
        ids = distinct_samples(rows).first()["sample_ids"]
        if len(ids) > 1:
            raise ValueError(f"the manifest has several samples, choose one of {ids[:5]}")
    name = F.coalesce(F.nullif(F.col("tile_name"), F.lit("")), F.nullif(F.col("name"), F.lit("")), file_name(F.col("s1_path")))
    aef = F.nullif(F.col("aef_path"), F.lit("")) if expect_aef else F.lit(None).cast("string")
    out = filter_sample(rows, sample_id).select(
        name.alias("name"), "s1_path", aef.alias("aef_path"), "label_path", F.coalesce("sample_id", F.lit(sample_id or "")).alias("sample_id")
    )
    if strict and expect_aef and (bad := out.where("aef_path IS NULL").limit(5).collect()):
        raise FileNotFoundError(f"rows without an embedding path: {[r['name'] for r in bad]}")
    return some_rows(out, f"no manifest row for sample {sample_id or 'any'}").orderBy("name") if strict else out.orderBy("name")


def read_manifest(spark: SparkSession, path: str, sample_id: str | None = None, expect_aef: bool = True) -> DataFrame:
    """``shape_manifest`` of a CSV file with a header."""
    return shape_manifest(spark.read.csv(path, header=True), sample_id, expect_aef)


def missing_paths(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths named in a manifest that no file has: name, kind, path."""
    sides = manifest.select("name", F.expr("stack(3, 's1', s1_path, 'aef', aef_path, 'label', label_path) AS (kind, path)"))
    return sides.where("path IS NOT NULL").join(files.select("path"), "path", "left_anti").select("name", "kind", "path")


#: Side of the square blocks of pixels that a store keeps together, and the bytes of a group of rows in its files.
BLOCK, GROUP_BYTES = 64, 8 << 20


def block_number(row: Column, col: Column, block: int = BLOCK) -> Column:
    """The place of a pixel's block on a Morton curve: the bits of both block coordinates, 16 each, in turns."""

    def spread(x: Column) -> Column:
        x = F.floor(x / block).cast("bigint").bitwiseAND(0xFFFF)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return x

    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def block_ranges(top: int, left: int, bottom: int, right: int, most: int = 32) -> list[tuple[int, int]]:
    """Ranges of Morton numbers that cover a rectangle of blocks (both ends included), ``most`` at most.

    A quadrant of the curve inside the rectangle is one range; of too many ranges those with the
    smallest gaps between them are joined, so nothing is left out.
    """
    found: list[tuple[int, int]] = []

    def visit(level: int, r: int, c: int, number: int) -> None:
        side = 1 << level
        if r > bottom or c > right or r + side <= top or c + side <= left:
            return
        if top <= r and left <= c and r + side - 1 <= bottom and c + side - 1 <= right:
            first, last = number << 2 * level, ((number + 1) << 2 * level) - 1
            if found and found[-1][1] + 1 == first:
                found[-1] = found[-1][0], last
            else:
                found.append((first, last))
            return
        half = side >> 1
        for k in range(4):
            visit(level - 1, r + half * (k >> 1), c + half * (k & 1), 4 * number + k)

    visit(16, 0, 0, 0)
    while len(found) > most:
        k = min(range(len(found) - 1), key=lambda i: found[i + 1][0] - found[i][1])
        found[k : k + 2] = [(found[k][0], found[k + 1][1])]
    return found


def read_pixels(spark: SparkSession, path: str, scenes: list[str] | None = None, aef: bool = True) -> DataFrame:
    """The pixel table; only the folders of ``scenes``, and without ``aef`` not its column."""
    pixels = spark.read.parquet(path)
    pixels = pixels.withColumn("scene_id", F.col("scene_id").cast("string")) if scenes is None else pixels.where(F.col("scene_id").isin(scenes))
    return pixels if aef else pixels.drop("aef", "aef_mask")


def write_pixels(pixels: DataFrame, path: str, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> None:
    """Store pixels so that readers skip scenes by folder and what lies far from a window by statistics.

    The rows of a scene lie along a Morton curve over square blocks, whose number is the column ``block``:
    a group of rows, and a page within it, is about a square, and its least and greatest number tell
    readers which. Rows and columns are below 65,536 blocks.
    """
    n = max(1, int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("scene_id", "block", "row", "col")
    rows = pixels.withColumn("block", block_number(F.col("row"), F.col("col"), block)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows.write.option("parquet.block.size", group_bytes).partitionBy("scene_id").parquet(path)


def read_window(pixels: DataFrame, top: int, left: int, h: int, w: int, row: str = "row", col: str = "col", block: int = BLOCK) -> DataFrame:
    """The pixels of one window. Of a store (``write_pixels``) only what may hold them is read.

    The window becomes ranges of block numbers, which reach the scan; ``block`` is the store's.
    """
    inside = F.col(row).between(top, top + h - 1) & F.col(col).between(left, left + w - 1)
    if "block" not in pixels.columns:
        return pixels.where(inside)
    near = F.lit(False)
    for first, last in block_ranges(max(top, 0) // block, max(left, 0) // block, (top + h - 1) // block, (left + w - 1) // block):
        near = near | F.col("block").between(first, last)
    return pixels.where(near & inside).drop("block")


def split_manifest(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Both parts with a ``split`` column, missing paths as empty text."""
    parts = [p.select(F.lit(s).alias("split"), *(F.col(c) for c in MANIFEST_COLUMNS[1:])) for p, s in ((train, "train"), (valid, "valid"))]
    return parts[0].unionByName(parts[1]).na.fill("", list(MANIFEST_COLUMNS))


def write_csv(rows: DataFrame, path: str, *order: Column | str) -> None:
    """One CSV file with a header, its rows in the given order; for listings and reports, which are small.

    What makes the rows runs in as many tasks as it would; one task sorts and writes.
    """
    one = rows.repartition(1)
    one = one.sortWithinPartitions(*order) if order else one
    one.write.csv(path, header=True, mode="overwrite", emptyValue="")


def write_split_manifest(train: DataFrame, valid: DataFrame, path: str) -> None:
    """``split_manifest`` as CSV."""
    write_csv(split_manifest(train, valid), path, "split", "name")


def scene_manifest(scenes: DataFrame, model_kind: str, aef_path: str | None = None) -> DataFrame:
    """The plan of a run: date, year, model_kind, s1_path, aef_path, prob_path."""
    aef = F.lit(aef_path if model_kind == "s1aef" and aef_path else "")
    return scenes.select("date", "year", F.lit(model_kind).alias("model_kind"), "s1_path", aef.alias("aef_path"), "prob_path")


def write_scene_manifest(scenes: DataFrame, model_kind: str, path: str, aef_path: str | None = None) -> None:
    """``scene_manifest`` as CSV."""
    write_csv(scene_manifest(scenes, model_kind, aef_path), path, F.split("s1_path", "/"))


def shape_scene_summary(rows: DataFrame) -> DataFrame:
    """The fixed columns of a summary, in order, as text; what is missing is empty."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in SUMMARY_COLUMNS))


def write_scene_summary(rows: DataFrame, path: str) -> None:
    """``shape_scene_summary`` as CSV."""
    write_csv(shape_scene_summary(rows), path, "date", "scene")


def write_probability(probs: DataFrame, root: str) -> None:
    """Probabilities by year and scene, missing as -9999; scenes written before are replaced whole.

    With a column ``batch`` each scene has a folder per batch, and only those of the same batch are replaced.
    Rows are dealt out by scene and a range of 256 rows of pixels first, so that a scene has a file per
    range at most and not one from every task.
    """
    out = probs.withColumn("prob", F.coalesce("prob", F.lit(NODATA)).cast("float"))
    out = out.withColumn("_band", F.floor(F.col("row") / 256)).repartition("year", "scene_id", "_band").drop("_band")
    out.write.partitionBy("year", "scene_id", *(["batch"] if "batch" in probs.columns else [])).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/probabilities")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if nothing is there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_probability(spark: SparkSession, root: str) -> DataFrame | None:
    """What ``write_probability`` wrote, missing as null; None if it wrote nothing."""
    found = read_table(spark, f"{root}/probabilities")
    return found and found.withColumn("scene_id", F.col("scene_id").cast("string")).withColumn("prob", F.nullif(F.col("prob"), F.lit(NODATA).cast("float")))


#: Characters that Spark writes as %XX in names of partition folders (fixed values of the file format).
ESCAPED = frozenset(map(chr, range(1, 32))) | set("\"#%'*/:=?\\{[]^\x7f")
PROBABILITY = "row int, col int, prob float, year int, scene_id string, batch long"


def partition_folder(name: str, value: str) -> str:
    """The folder of a partition."""
    return f"{name}=" + "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value)


def read_some(spark: SparkSession, base: str, folders: list[str], schema: str) -> DataFrame:
    """Some folders of a partitioned table; others aren't even listed, and those that aren't there have no rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [f"{base}/{f}" for f in folders if system.exists(path(f"{base}/{f}"))]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*there)


def _scene_folders(scenes: list[tuple[int, str]]) -> list[str]:
    return [f"year={year}/{partition_folder('scene_id', scene)}" for year, scene in scenes]


def read_scenes(spark: SparkSession, root: str, scenes: list[tuple[int, str]]) -> DataFrame:
    """Probabilities of some scenes (year, scene_id) as ``write_probability`` with batches wrote them, missing as null."""
    found = read_some(spark, f"{root}/probabilities", _scene_folders(scenes), PROBABILITY)
    return found.withColumn("prob", F.nullif(F.col("prob"), F.lit(NODATA).cast("float")))


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of a run, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_scenes(spark: SparkSession, root: str, scenes: list[tuple[int, str]]) -> None:
    """Take back the probabilities of some scenes (year, scene_id)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in _scene_folders(scenes):
        at = path(f"{root}/probabilities/{folder}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save_band_stats(stats: DataFrame, path: str, source: str = "computed") -> None:
    """Store band statistics with where they come from."""
    stats.select("band", "mean", "std", F.lit(source).alias("source")).coalesce(1).write.mode("overwrite").parquet(path)


def load_band_stats(spark: SparkSession, path: str, expected_bands: int) -> DataFrame:
    """Stored statistics; bands are 0 to ``expected_bands`` - 1, and a std that isn't positive is 1."""
    stats = spark.read.parquet(path).select("band", "mean", F.when(F.col("std") <= 0, 1.0).otherwise(F.col("std")).alias("std"))
    n, low, high = stats.agg(F.countDistinct("band"), F.min("band"), F.max("band")).first()
    if (n, low, high) != (expected_bands, 0, expected_bands - 1):
        raise ValueError(f"{expected_bands} bands are expected; there are {n}, from {low} to {high}")
    return stats


def copy_band_stats(spark: SparkSession, source: str, path: str, expected_bands: int) -> DataFrame:
    """Take the statistics of another run, noting its path."""
    save_band_stats(load_band_stats(spark, source, expected_bands), path, source)
    return load_band_stats(spark, path, expected_bands)


def resolve_band_stats(spark: SparkSession, path: str, expected_bands: int, compute: Callable[[], DataFrame], source: str | None = None, parent: str | None = None) -> DataFrame:
    """The statistics of a run, stored at ``path``.

    Those at ``source`` if given, else those stored already, else those of the run ``parent`` if it
    has any, else computed; copies and computed ones are stored with where they come from.
    """
    if source:
        return copy_band_stats(spark, source, path, expected_bands)
    if read_table(spark, path) is None:
        if parent and read_table(spark, parent) is not None:
            return copy_band_stats(spark, parent, path, expected_bands)
        save_band_stats(compute(), path)
    return load_band_stats(spark, path, expected_bands)


def year_counts(scenes: DataFrame) -> DataFrame:
    """Scenes per year, in order."""
    return scenes.groupBy("year").agg(F.count("*").alias("scenes")).orderBy("year")


def run_config(scenes: DataFrame, settings: dict[str, str], grid: DataFrame | None = None) -> DataFrame:
    """One row: settings, scene_count, counts by year and, if given, the grid as a struct."""
    years = year_counts(scenes).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), "scenes")))).alias("by_year"), F.coalesce(F.sum("scenes"), F.lit(0)).alias("scene_count"))
    pairs = [F.lit(str(x)) for kv in sorted(settings.items()) for x in kv]
    out = years.select((F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("settings"), "scene_count", "by_year")
    return out if grid is None else out.crossJoin(F.broadcast(grid.limit(1).select(F.struct("*").alias("grid"))))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON file of small results. Only the writing is one task."""
    rows.repartition(1).write.json(path, mode="overwrite")


def write_eval_artifacts(root: str, sweep: DataFrame, tiles: DataFrame, worst: DataFrame, summary: DataFrame, projection: DataFrame | None = None) -> None:
    """The files of an evaluation: sweep, tile metrics, worst tiles, summary and projection report."""
    write_csv(sweep, f"{root}/threshold_sweep", "eval_mode", "threshold")
    write_csv(tiles, f"{root}/tile_metrics", "tile_name")
    write_csv(worst, f"{root}/worst_tiles", "water_iou", "precision", "recall", "tile_name")
    write_json(summary, f"{root}/summary")
    if projection is not None:
        write_json(projection, f"{root}/projection_report")
