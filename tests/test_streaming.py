"""Scenes over several batches: what fails, what stays, and what a batch looks at."""

import pytest
from pyspark.sql import functions as F

from bandframe.operators import evaluate as E
from bandframe.operators import grid as G
from bandframe.operators.score import score_blocks
from bandframe.sources import files as S
from bandframe.streaming import incremental as X


def scene(spark, name, rows=range(3), cols=range(4), bands=3, year=2025):
    data = [(name, year, r, c, [float(r)] * bands, (r * 10 + c) / 100) for r in rows for c in cols]
    return spark.createDataFrame(data, "scene_id string, year int, row int, col int, s1 array<double>, prob double")


def told(spark, root):
    return {r["scene_id"]: (r["status"], r["total_pixels"], r["error"]) for r in X.read_summary(spark, root).collect()}


def test_an_error_stays(spark, tmp_path):
    """One scene in three batches, the second wrong: the third doesn't hide it."""
    root, same = str(tmp_path), lambda d: d
    for batch, (rows, bands) in enumerate([([0], 3), ([1], 2), ([2], 3)]):
        X.score_batch(scene(spark, "bad", rows, bands=bands).unionByName(scene(spark, "good", rows)), root, same, batch)
        assert told(spark, root)["good"] == ("ok", 4 * (batch + 1), None)
        assert told(spark, root)["bad"][0] == ("ok" if batch == 0 else "error")
    assert told(spark, root)["bad"] == ("error", None, "unexpected number of bands")
    assert {r[0] for r in S.read_probability(spark, root).select("scene_id").distinct().collect()} == {"good"}
    X.forgive(spark, root, ["bad"])
    X.score_batch(scene(spark, "bad"), root, same, 3)
    assert told(spark, root)["bad"] == ("ok", 12, None) and told(spark, root)["good"] == ("ok", 12, None)


def test_a_batch_again_changes_nothing(spark, tmp_path):
    root, same = str(tmp_path), lambda d: d
    for batch in (0, 1, 1, 0):
        X.score_batch(scene(spark, "s", range(batch + 1)), root, same, batch)
    assert S.read_probability(spark, root).groupBy("row", "col").count().where("count > 1").isEmpty()
    assert told(spark, root)["s"] == ("ok", 8, None) and X.read_ledger(spark, root).count() == 2


@pytest.mark.parametrize("eager", [True, False])
def test_a_failing_scorer_fails_its_scene_alone(spark, tmp_path, eager):
    """Whether it fails while it plans or while it runs."""
    frames = [scene(spark, f"s{i}") for i in range(6)]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)

    def scorer(df):
        if eager:
            if not df.where("scene_id IN ('s2', 's5')").isEmpty():
                raise ValueError("no idea\nmore")
            return df
        return df.withColumn("prob", F.when(F.col("scene_id").isin("s2", "s5"), F.raise_error(F.lit("no idea")).cast("double")).otherwise(F.col("prob")))

    X.score_batch(every, str(tmp_path), scorer, 0)
    rows = told(spark, str(tmp_path))
    assert {k for k, v in rows.items() if v[0] == "error"} == {"s2", "s5"} and all("no idea" in rows[k][2] for k in ("s2", "s5"))
    assert all(rows[k][:2] == ("ok", 12) for k in ("s0", "s1", "s3", "s4"))
    if eager:
        assert rows["s2"][2] == "ValueError: no idea"
    assert S.read_probability(spark, str(tmp_path)).count() == 4 * 12


@pytest.mark.parametrize("splits", [2, 4, 128])
def test_halves_of_a_failing_batch_read_their_own_pixels(spark, tmp_path, monkeypatch, splits):
    monkeypatch.setattr(X, "SPLITS", splits)
    every = spark.range(16 * 12).select(F.concat(F.lit("s"), F.floor(F.col("id") / 12)).alias("scene_id"), F.lit(2025).alias("year"), F.floor(F.col("id") % 12 / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.array(*[F.lit(1.0)] * 3).alias("s1"), F.lit(0.5).alias("prob"))
    every.repartition(1).write.parquet(f"{tmp_path}/in")

    @F.udf("double")
    def judged(name, prob):
        if name == "s5":
            raise ValueError("no idea")
        return prob

    root = f"{tmp_path}/out"
    inputs = []
    X.score_batch(spark.read.parquet(f"{tmp_path}/in"), root, lambda d: inputs.append(d.inputFiles()) or d.withColumn("prob", judged("scene_id", "prob")), 0)
    rows = told(spark, root)
    assert {k: v[:2] for k, v in rows.items()} == {f"s{i}": ("error", None) if i == 5 else ("ok", 12) for i in range(16)} and "PythonException" in rows["s5"][2]
    assert S.read_probability(spark, root).count() == 15 * 12
    again = [f for fs in inputs[1:] for f in fs]
    assert again and not any("/in/" in f for f in again)  # the batch itself is scored from once
    assert not (tmp_path / "out" / "split" / "batch=0").exists()


def test_failed_blocks_fail_their_scene(spark, tmp_path):
    def numbers(blocks):
        if (blocks > 900).any():
            raise RuntimeError("too bright")
        return blocks[:, :1].repeat(2, 1)

    def scorer(df):
        px = df.withColumn("bands", F.array(F.when((F.col("scene_id") == "b") & (F.col("row") == 2), 1000.0).otherwise(F.col("prob"))))
        out = score_blocks(G.assign_windows(px, 2, 0, 3, 4), numbers, 2, 1, keys=("scene_id", "year"))
        return G.stitch(out, ("scene_id", "year")).withColumn("prob", F.col("logit1"))

    X.score_batch(scene(spark, "a").unionByName(scene(spark, "b")), str(tmp_path), scorer, 0)
    rows = told(spark, str(tmp_path))
    assert rows["a"] == ("ok", 12, None) and rows["b"][0] == "error" and "too bright" in rows["b"][2]
    assert {r[0] for r in S.read_probability(spark, str(tmp_path)).select("scene_id").distinct().collect()} == {"a"}


def test_new_scenes_look_at_nothing_written_before(spark, tmp_path, monkeypatch):
    root, same, seen = str(tmp_path), lambda d: d, []
    for batch in range(3):
        X.score_batch(scene(spark, f"old {batch}:%"), root, same, batch)
    read = lambda s, base, folders, schema, own=S.read_some: seen.append((base, folders)) or own(s, base, folders, schema)
    monkeypatch.setattr(S, "read_some", read)
    monkeypatch.setattr(X, "read_some", read)
    plans = []
    X.score_batch(scene(spark, "new"), root, lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or d, 3)
    assert [f for base, f in seen if base.endswith("/probabilities")] == [["year=2025/scene_id=new"]]
    assert [f for base, f in seen if base.endswith("/ledger")] == [[f"bucket={X.bucket_of('new')}"]]
    assert "probabilities" not in plans[0] and "Join" not in plans[0]
    seen.clear()
    X.score_batch(scene(spark, "old 1:%", range(2, 5)), root, same, 4)
    assert {tuple(f) for base, f in seen if base.endswith("/probabilities")} == {("year=2025/scene_id=old 1%3A%25",)}
    assert told(spark, root)["old 1:%"] == ("ok", 20, None)


def test_scenes_off_the_grid(spark, tmp_path):
    X.score_batch(scene(spark, "a").unionByName(scene(spark, "b", range(4))), str(tmp_path), lambda d: d, 0, shape=(3, 4))
    assert told(spark, str(tmp_path)) == {"a": ("ok", 12, None), "b": ("error", None, "pixel off the grid")}
    X.score_batch(scene(spark, "c").limit(0), str(tmp_path), lambda d: d, 1)
    good, failed = X.isolate_failures(scene(spark, "a").unionByName(scene(spark, "c", bands=1)), 3)
    assert good.count() == 12 and [r["scene_id"] for r in failed.collect()] == ["c"]


def test_neither_null_nor_nan_reaches_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"), 0), (0.9, 1), (0.1, 0), (None, 1), (0.5, 1)], "prob double, label int").withColumn("tile", F.lit(1))
    row = E.threshold_sweep(df, (0.5,)).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (2, 0, 2, 1)
    tile = E.tile_metrics(df, 0.5).first()
    assert (tile["tp"], tile["fp"], tile["tn"], tile["fn"]) == (2, 0, 2, 1)
    assert E.apply_thresholds(df, (0.5,)).agg(F.sum("pred"), F.count("pred")).first() == (2, 5)
