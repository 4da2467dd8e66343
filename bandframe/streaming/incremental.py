"""Scoring scenes as they arrive: each pixel once, failures kept apart, reruns without effect."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from bandframe.operators.evaluate import scene_summary
from bandframe.sources.files import delete_folder, delete_scenes, read_scenes, read_some, scene_date, write_probability

#: Folders of the ledger; a batch reads those that its scenes fall into.
LEDGER_BUCKETS = 64
LEDGER = "scene_id string, year int, pixels long, status string, error string, bucket int, batch long"
#: Folders of neighbouring scenes that a batch is split into when its scorer fails.
SPLITS = 128
PLACE = ("scene_id", "row", "col")
Scorer = Callable[[DataFrame], DataFrame]


def scene_status(pixels: DataFrame, n_s1: int = 3, n_aef: int | None = None, key: str = "scene_id", shape: tuple[int, int] | None = None, more: Iterable[Column] = ()) -> DataFrame:
    """Per scene ``ok`` or ``error`` and what is wrong: band counts, missing places, places off a grid of ``shape``.

    ``more`` are aggregates to have beside them.
    """
    bad = F.size("s1") != n_s1
    if n_aef is not None:
        bad = bad | (F.size("aef") != n_aef)
    some = lambda c: F.max(F.coalesce(c, F.lit(True)).cast("int")) == 1
    error = F.when(some(bad), "unexpected number of bands").when(some(F.col("row").isNull() | F.col("col").isNull()), "pixel without a place")
    if shape:
        error = error.when(some(~(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1))), "pixel off the grid")
    return pixels.groupBy(key).agg(error.alias("error"), *more).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def isolate_failures(pixels: DataFrame, n_s1: int = 3, n_aef: int | None = None, key: str = "scene_id", shape: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pixels of the scenes that can be scored, and a row for each that can't."""
    status = scene_status(pixels, n_s1, n_aef, key, shape)
    failed = status.where("status = 'error'")
    return pixels.join(failed.select(key), key, "left_anti"), failed


def append_summary(rows: DataFrame, root: str, batch: int) -> None:
    """Add the summary of one batch under its number; the same batch again replaces it."""
    rows.withColumn("batch", F.lit(batch)).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/summary")


def read_summary(spark: SparkSession, root: str) -> DataFrame:
    """The last row of each scene; a later batch brings the scene's pixels and failures of all batches so far."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/summary")
    last = rows.groupBy("scene_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["scene_id", "batch"])


def bucket_of(scene: str) -> int:
    """The folder of the ledger that holds a scene."""
    return zlib.crc32(scene.encode()) % LEDGER_BUCKETS


def read_ledger(spark: SparkSession, root: str, scenes: Iterable[str] | None = None) -> DataFrame:
    """What each batch did with each scene: the columns of ``LEDGER``. With ``scenes`` only their folders are looked at."""
    numbers = range(LEDGER_BUCKETS) if scenes is None else sorted({bucket_of(s) for s in scenes})
    return read_some(spark, f"{root}/ledger", [f"bucket={n}" for n in numbers], LEDGER)


def _append_ledger(spark: SparkSession, root: str, rows: list[tuple], batch: int) -> None:
    table = spark.createDataFrame([(*r, bucket_of(r[0]), batch) for r in rows], LEDGER)
    table.repartition("bucket").write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/ledger")


def _only(pixels: DataFrame, scenes: list[str]) -> DataFrame:
    """The pixels of some scenes of a batch; their names, at most as many as the batch has scenes, are broadcast."""
    names = pixels.sparkSession.createDataFrame([(s,) for s in scenes], "scene_id string")
    return pixels.join(F.broadcast(names), "scene_id", "left_semi")


def _message(e: Exception) -> str:
    lines = [line for line in str(e).splitlines() if line.strip()]
    return f"{type(e).__name__}: {lines[0] if lines else ''}"[:2000]


def _write_scored(work: DataFrame, scorer: Scorer, root: str, batch: int) -> dict[str, str]:
    """Score pixels and write their probabilities; the errors that the scorer told as rows, by scene."""
    spark, scored = work.sparkSession, scorer(work)
    told: dict[str, str] = {}
    if "error" in scored.columns:  # kept until it is known which scenes are whole
        path = f"{root}/staged/batch={batch}"
        scored.select("year", *PLACE, "prob", "error").write.mode("overwrite").parquet(path)
        scored = spark.read.parquet(path)
        bad = scored.where("error IS NOT NULL").groupBy("scene_id").agg(F.min("error").alias("error"))
        told = {r["scene_id"]: r["error"] for r in bad.collect()}
        scored = scored.join(F.broadcast(spark.createDataFrame(list(told.items()), "scene_id string, error string")), "scene_id", "left_anti") if told else scored
    write_probability(scored.select("year", *PLACE, "prob", F.lit(batch).cast("bigint").alias("batch")), root)
    return told


def _score_apart(work: DataFrame, scenes: list[str], scorer: Scorer, root: str, batch: int) -> dict[str, str]:
    """Score scenes together; if that fails, each half alone, down to the scenes that fail: their errors.

    The others are written. When they fail together their pixels are written once in ``SPLITS`` folders of
    neighbouring scenes, so that a half reads its own folders: a failing scene costs as much as scoring all
    scenes about twice again, in two jobs for each halving.
    """
    try:
        return _write_scored(work, scorer, root, batch)
    except Exception as e:
        if len(scenes) == 1:
            return {scenes[0]: _message(e)}
    path = f"{root}/split/batch={batch}"
    names = work.sparkSession.createDataFrame([(s, k * SPLITS // len(scenes)) for k, s in enumerate(scenes)], "scene_id string, _split int")
    rows = work.join(F.broadcast(names), "scene_id").repartition("_split")
    rows.write.partitionBy("_split").mode("overwrite").parquet(path)
    try:
        return _score_halves(_Split(path, work, scenes), scenes, scorer, root, batch)
    finally:
        delete_folder(work.sparkSession, path)


@dataclass(frozen=True)
class _Split:
    """The pixels of a batch in folders of neighbouring scenes."""

    path: str
    work: DataFrame
    scenes: list[str]

    def of(self, first: int, last: int) -> DataFrame:
        """The pixels of the scenes from number ``first`` up to ``last``, left out, in the columns of ``work``."""
        n, spark = len(self.scenes), self.work.sparkSession
        folders = sorted({k * SPLITS // n for k in range(first, last)})
        kept = StructType([StructField(f.name, f.dataType) for f in self.work.schema])
        rows = spark.read.schema(kept).parquet(*(f"{self.path}/_split={k}" for k in folders))
        whole = all(k * SPLITS // n not in folders for k in (first - 1, last) if 0 <= k < n)
        return rows if whole else _only(rows, self.scenes[first:last])


def _score_halves(split: _Split, scenes: list[str], scorer: Scorer, root: str, batch: int, first: int = 0) -> dict[str, str]:
    """The halves of scenes that failed together; ``first`` is the number of the first."""
    errors: dict[str, str] = {}
    half = len(scenes) // 2
    for at, part in ((first, scenes[:half]), (first + half, scenes[half:])):
        try:
            errors |= _write_scored(split.of(at, at + len(part)), scorer, root, batch)
        except Exception as e:
            errors |= {part[0]: _message(e)} if len(part) == 1 else _score_halves(split, part, scorer, root, batch, at)
    return errors


def score_batch(pixels: DataFrame, root: str, scorer: Scorer, batch: int, n_s1: int = 3, n_aef: int | None = None, shape: tuple[int, int] | None = None) -> None:
    """Score the pixels of a batch that no other batch has written.

    ``pixels`` has scene_id, year, row, col, s1, what ``scorer`` needs, and perhaps s1_path; the scorer
    adds prob, null where invalid, and perhaps error, whose texts fail a scene. A scene may come in several
    batches: each adds its pixels, and the summary is that of all of them.

    A scene fails if a pixel of it is wrong (``scene_status``) or the scorer fails on it; the others are
    scored all the same. ``error`` absorbs: a scene that failed in any batch stays failed, has no
    probabilities (those written before are taken back) and isn't scored again. ``forgive`` ends that.

    The ledger tells what became of each scene, in folders by a hash of the scene, so a batch looks only
    at the ledger of its own scenes, and at probabilities only of scenes that came before: its cost
    grows with the batch, not with all that was written. The driver holds a row per scene of the batch.
    A pixel that comes twice within one batch is written twice. ``seconds`` is the time of the batch by its
    scenes, ``finished`` the end as ISO text in UTC.
    """
    spark, began = pixels.sparkSession, time.monotonic()
    path = F.max("s1_path" if "s1_path" in pixels.columns else F.lit(None).cast("string")).alias("s1_path")
    status = scene_status(pixels, n_s1, n_aef, shape=shape, more=(F.max("year").alias("year"), path, F.count("*").alias("pixels")))
    scenes: dict[str, Row] = {r["scene_id"]: r for r in status.where("scene_id IS NOT NULL").collect()}
    if not scenes:
        return
    past = _only(read_ledger(spark, root, scenes), list(scenes)).where(F.col("batch") != batch)
    past = {r["scene_id"]: r for r in past.groupBy("scene_id").agg(F.min_by("error", F.when(F.col("status") == "error", F.col("batch"))).alias("error"), F.count_if(F.col("status") == "ok").alias("ok"), F.collect_set("year").alias("years")).collect()}
    errors = {s: r["error"] for s, r in scenes.items() if r["error"]} | {s: r["error"] for s, r in past.items() if r["error"]}
    good = [s for s in scenes if s not in errors]
    again = [s for s in good if s in past and past[s]["ok"]]
    folders = lambda names: [(y, s) for s in names for y in {scenes[s]["year"], *(past[s]["years"] if s in past else ())}]
    if good:
        work = pixels if len(good) == len(scenes) else _only(pixels, good)
        if again:
            done = read_scenes(spark, root, folders(again)).where(F.col("batch") != batch)
            work = work.join(done.select(*PLACE), list(PLACE), "left_anti")
        errors |= _score_apart(work, good, scorer, root, batch)
    delete_scenes(spark, root, folders([s for s in errors if s in past and past[s]["ok"] or s in good]))
    good = [s for s in good if s not in errors]
    _append_ledger(spark, root, [(s, r["year"], r["pixels"], "error" if s in errors else "ok", errors.get(s)) for s, r in scenes.items()], batch)
    own = spark.createDataFrame([(s, r["year"], r["s1_path"], "error" if s in errors else "ok", errors.get(s)) for s, r in scenes.items()], "scene_id string, year int, s1_path string, status string, error string")
    rows = own.join(scene_summary(read_scenes(spark, root, folders(good))), "scene_id", "left") if good else own
    rows = rows.withColumn("scene", F.col("scene_id")).withColumn("date", F.date_format(scene_date(F.col("scene_id")), "yyyy-MM-dd"))
    rows = rows.withColumn("prob_path", F.concat_ws("/", F.lit(root), F.lit("probabilities"), F.col("year").cast("string"), "scene_id"))
    rows = rows.withColumn("seconds", F.lit(round((time.monotonic() - began) / len(scenes), 3)))
    append_summary(rows.withColumn("finished", F.lit(datetime.now(UTC).isoformat(timespec="seconds"))), root, batch)


def forgive(spark: SparkSession, root: str, scenes: list[str]) -> None:
    """Forget the failures of some scenes, so that their pixels are scored when they come again."""
    names = spark.createDataFrame([(s,) for s in scenes], "scene_id string")
    rows = read_ledger(spark, root, scenes).join(F.broadcast(names), "scene_id").where("status = 'error'")
    batches = {r[0] for r in rows.select("batch").distinct().collect()}
    left = read_ledger(spark, root, scenes).where(F.col("batch").isin(list(batches))).withColumn("_named", F.col("scene_id").isin(scenes))
    left = left.withColumn("status", F.when(F.col("_named"), "forgiven").otherwise(F.col("status"))).withColumn("error", F.when(~F.col("_named"), F.col("error")))
    kept = [tuple(r) for r in left.select(*(c.split()[0] for c in LEDGER.split(", "))).collect()]  # rows of the named scenes' folders in those batches
    if kept:
        spark.createDataFrame(kept, LEDGER).repartition("bucket").write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/ledger")


def score_new_scenes(stream: DataFrame, root: str, scorer: Scorer, checkpoint: str, n_s1: int = 3, n_aef: int | None = None, shape: tuple[int, int] | None = None) -> StreamingQuery:
    """Score what a stream of pixel files brings and stop when it is used up.

    The checkpoint takes each file once; ``score_batch`` writes each pixel once, so a scene that comes
    again, or a batch that runs again after a crash, changes nothing, and a scene whose files come in
    several batches ends up whole, or failed if any of them failed.
    """
    work = lambda df, batch: score_batch(df, root, scorer, batch, n_s1, n_aef, shape)
    return stream.writeStream.foreachBatch(work).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
