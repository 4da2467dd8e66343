"""Golden cases and properties of the raster operators."""

import hashlib
import math
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandframe.functions import columns as C
from bandframe.operators import evaluate as E
from bandframe.operators import grid as G
from bandframe.operators import joins as J
from bandframe.operators.score import compare_features, fit_pixel_classifier, predict_pixels, score_blocks, tta_average
from bandframe.plans.fixtures import view
from bandframe.plans.queries import looks_left, pixels
from bandframe.sources import files as S
from bandframe.streaming import incremental as X

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def window_starts(n, size, overlap):
    step = max(1, size - overlap)
    return sorted({*range(0, max(n - size, 0) + 1, step), max(n - size, 0)})


@pytest.mark.parametrize("n,size,overlap,wanted", [(512, 512, 64, [0]), (513, 512, 64, [0, 1]), (960, 512, 64, [0, 448]), (961, 512, 64, [0, 448, 449]), (300, 512, 64, [0]), (7, 3, 2, [0, 1, 2, 3, 4])])
def test_window_starts(spark, n, size, overlap, wanted):
    assert value(spark, G.starts(F.lit(n), size, overlap)) == wanted == window_starts(n, size, overlap)


@pytest.mark.parametrize("n,size,overlap", [(30, 16, 4), (7, 3, 2), (10, 16, 4), (17, 5, 0), (31, 8, 7)])
def test_window_membership(spark, n, size, overlap):
    rows = spark.range(n).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"))
    got = {(r["row"], r["top"]) for r in G.assign_windows(rows, size, overlap, n, 1).collect()}
    assert got == {(i, s) for i in range(n) for s in window_starts(n, size, overlap) if s <= i < s + size}


def test_no_nested_loops_and_no_python(spark):
    px = pixels(spark, SF)
    for df in (G.assign_windows(px, 16, 4, 30, 50), E.threshold_sweep(px), E.tile_metrics(px, 0.5), E.lovasz_softmax(px, ["tile"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan


def test_radar_alone_leaves_the_embedding_unread(spark, tmp_path):
    px = pixels(spark, SF).select(F.col("tile").cast("string").alias("scene_id"), "row", "col", "s1", "aef", "s1_mask")
    S.write_pixels(px, str(tmp_path / "px"))
    rows = S.read_window(S.read_pixels(spark, str(tmp_path / "px"), ["0"], aef=False), 0, 0, 5, 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "aef" not in plan and "PartitionFilters" in plan and rows.count() == 25


def test_ties_and_cleaning(spark):
    df = spark.createDataFrame([(0.5, 1)], "prob double, label int")
    assert E.confusion(df, C.argmax_water(1 - F.col("prob"), F.col("prob")), F.col("label")).first()["fn"] == 1
    assert E.threshold_sweep(df, (0.5,)).first()["tp"] == 1
    assert value(spark, C.binarize_label(F.lit(math.nan))) == 0 and value(spark, C.binarize_label(F.lit(0.6))) == 1
    assert value(spark, C.clean_nonfinite(F.lit(-math.inf))) == 0.0
    assert [value(spark, C.remap_class(F.lit(x).cast("int"))) for x in (0, 3, None)] == [1, 0, None]
    assert value(spark, C.clean_bands(F.array(F.lit(math.nan), F.lit(2.0), F.lit(math.inf)))) == [0.0, 2.0, 0.0]


def test_metrics(spark):
    rows = spark.createDataFrame([(8, 2, 85, 5), (0, 0, 10, 0), (0, 0, 0, 0)], "tp long, fp long, tn long, fn long")
    a, b, c = E.with_metrics(rows).collect()
    assert a["precision"] == 0.8 and a["water_iou"] == 8 / 15
    assert a["dice"] == pytest.approx((16 / 23 + 170 / 177) / 2) and a["jaccard"] == pytest.approx((8 / 15 + 85 / 92) / 2)
    assert b["precision"] == b["recall"] == 0 and b["dice"] == 0.5 and [c[m] for m in E.METRICS] == [0] * 6


def test_validity_and_fill(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], 255, [0.5], 1), ([math.nan, 2.0], 255, [0.5], 1), ([1.0, 2.0], 0, [0.5], 1), ([1.0, 2.0], 255, [-128.0], 1), ([1.0, 2.0], 255, [0.5], 0), ([1.0, None], 255, [0.5], 1)],
        "s1 array<double>, m int, aef array<double>, am int",
    )
    valid = C.validity(F.col("s1"), F.col("m"), F.col("aef"), F.col("am"), nodata=-128.0)
    mean = F.array(*map(F.lit, (7.0, 8.0, 9.0)))
    out = df.select(valid.alias("v"), C.normalize(C.fill_invalid(C.stack_bands(F.col("s1"), F.col("aef")), valid, mean), mean, F.array(*map(F.lit, (2.0, 2.0, 2.0)))).alias("b")).collect()
    assert [r["v"] for r in out] == [True] + [False] * 5
    assert out[0]["b"] == [-3.0, -3.0, -4.25] and all(r["b"] == [0.0] * 3 for r in out[1:])


def test_band_stats_against_numpy(spark, tmp_path):
    px = pixels(spark, SF).withColumn("bands", C.clean_bands(F.col("s1")))
    got = np.array([tuple(r) for r in E.band_stats(px, 3).orderBy("band").collect()])
    x = np.array([r[0] for r in px.select("bands").collect()])
    assert np.allclose(got[:, 1], x.mean(0)) and np.allclose(got[:, 2], x.std(0))
    flat = spark.createDataFrame([([5.0],)] * 3, "bands array<double>")
    assert E.band_stats(flat, 1).first()["std"] == pytest.approx(1e-4)
    S.save_band_stats(E.band_stats(px, 3), str(tmp_path / "a"))
    assert S.copy_band_stats(spark, str(tmp_path / "a"), str(tmp_path / "b"), 3).count() == 3
    with pytest.raises(ValueError):
        S.load_band_stats(spark, str(tmp_path / "a"), 67)


def test_scene_listing(spark, tmp_path):
    for name in ("a-b/s1_2024-03-01.tif", "a/s1_2025-1-5.tif", "a/s1_2025-02-30.tif", "a/s1_2025-01-05_v2.tif", "a/x.tif", ".h/s1_2025-01-07.tif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = S.list_files(spark, str(tmp_path))
    assert "content" not in files.columns
    rows = S.discover_scenes(files).collect()
    assert [r["date"] for r in rows] == ["2025-01-05", "2024-03-01"]  # a before a-b
    assert [r["year"] for r in S.discover_scenes(files, max_scenes=1).collect()] == [2025]
    with pytest.raises(FileNotFoundError):
        S.discover_scenes(files, years=[1999])
    S.write_scene_manifest(S.discover_scenes(files), "s1", str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["date", "year", "model_kind", "s1_path", "aef_path", "prob_path"]
    config = S.run_config(S.discover_scenes(files), {"tile": "512"}).first()
    assert config["scene_count"] == 2 and config["by_year"] == {"2024": 1, "2025": 1}


def test_pairing(spark):
    side = lambda *n: spark.createDataFrame([(x, f"/{x}") for x in n] or [], "name string, path string")
    rows = J.pair_triplets(side("a", "b", "c", "d"), side("a", "c"), side("a", "b"))
    assert {r["name"]: r["status"] for r in rows.collect()} == {"a": "paired", "b": "missing_aef", "c": "missing_label", "d": "missing_aef"}
    report = J.pairing_report(rows).first()
    assert report["missing_aef_examples"] == ["b", "d"] and report["pairs"] == 1
    assert {r["status"] for r in J.pair_triplets(side("a"), None, side("a")).collect()} == {"paired"}
    with pytest.raises(FileNotFoundError):
        J.paired(J.pair_triplets(side("a"), side("b"), side("a")))
    files = spark.createDataFrame([("/r/x/t.tif",), ("/r/y/t.tif",), ("/r/.z/u.tif",)], "path string")
    with pytest.raises(RuntimeError, match="t.tif"):
        S.index_by_name(files, "/r/")


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("sample_id,tile_name,s1_path,aef_path,label_path\na,,/s/t1.tif,/e/1.tif,/l/1.tif\nb,two,/s/t2.tif,,/l/2.tif\n")
    assert [r["name"] for r in S.read_manifest(spark, str(path), "a").collect()] == ["t1.tif"]
    with pytest.raises(ValueError, match="several"):
        S.read_manifest(spark, str(path))
    with pytest.raises(FileNotFoundError, match="two"):
        S.read_manifest(spark, str(path), "b")
    assert S.read_manifest(spark, str(path), "b", expect_aef=False).count() == 1
    path.write_text("s1_path\n/x\n")
    with pytest.raises(ValueError, match="label_path"):
        S.read_manifest(spark, str(path))


def test_split(spark):
    records = spark.createDataFrame([(f"t{i:02}",) for i in range(25)], "name string")
    train, valid = E.split_train_valid(records, 0.1, 3)
    a, b = ({r["name"] for r in x.collect()} for x in (train, valid))
    assert len(b) == 2 and not a & b and len(a | b) == 25  # 2.5 is rounded to even
    assert E.split_train_valid(records.repartition(7), 0.1, 3)[1].collect() == valid.collect()
    assert E.cap_records(train, 5, 3).count() == 5 and E.subset_records(train, 0, 4).count() == 4
    for bad in (lambda: E.split_train_valid(records.limit(1), 0.5, 3), lambda: E.split_train_valid(records.limit(0), 0.5, 3), lambda: E.cap_records(train, 0, 3)):
        with pytest.raises(ValueError):
            bad()


def test_sweep_is_monotonous_and_complete(spark):
    px = pixels(spark, SF)
    rows = E.threshold_sweep(px).orderBy("threshold").collect()
    assert len(rows) == len(E.THRESHOLDS) == 23 and {r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in rows} == {px.count()}
    assert all(x["tp"] >= y["tp"] and x["fp"] >= y["fp"] for x, y in zip(rows, rows[1:]))
    assert E.threshold_list([(0.3, 0.5, 0.05), (0.55, 0.7, 0.01), (0.75, 0.8, 0.05)]) == E.THRESHOLDS
    naive = E.apply_thresholds(px.limit(50), (0.5, 0.6))
    assert naive.count() == 100


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([("s", None), ("s", None)], "scene_id string, prob double")
    r = E.scene_summary(df).first()
    assert (r["total_pixels"], r["valid_pixels"], r["nodata_fraction"], r["mean_probability"], r["p95_probability"], r["max_probability"]) == (2, 0, 1.0, 0.0, 0.0, 0.0)
    p = [0.1, 0.4, 0.35, 0.8]
    r = E.scene_summary(spark.createDataFrame([("s", x) for x in p], "scene_id string, prob double")).first()
    assert r["p95_probability"] == pytest.approx(np.percentile(p, 95))


def test_rankings(spark):
    sweep = spark.createDataFrame([("a", 0.5, 0.7, 0.6, 0.9, 0.1), ("a", 0.4, 0.7, 0.6, 0.8, 0.1), ("b", 0.6, 0.7, 0.5, 1.0, 0.1)], "eval_mode string, threshold double, water_iou double, dice double, precision double, recall double")
    best = {r["scope"]: r["threshold"] for r in E.best_threshold(sweep).collect()}
    assert best == {"a": 0.4, "b": 0.6, "best_eval": 0.4}
    assert E.top_rows_per_mode(sweep, 1).where("eval_mode = 'a'").first()["threshold"] == 0.5
    w = spark.createDataFrame([(0, 0, 0.5), (0, 1, -0.5), (0, 2, 0.1)], "proj int, band int, w double")
    assert [r["band"] for r in E.top_weights(w, 2).orderBy("rank").collect()] == [0, 1]
    with pytest.raises(ValueError):
        E.check_projection(w, 2, 3)


def test_lovasz_without_groups(spark):
    px = pixels(spark, SF)
    p, y = (np.array([r[i] for r in px.orderBy("px_id").select("prob", "label").collect()], float) for i in (0, 1))
    losses = []
    for c in (0, 1):
        fg = (y == c).astype(float)
        err = abs(fg - (p if c else 1 - p))
        order = np.argsort(-err, kind="stable")
        f = fg[order].cumsum()
        jac = 1 - (fg.sum() - f) / (fg.sum() + np.arange(1, len(f) + 1) - f)
        losses.append((err[order] * np.diff(np.concatenate([[0], jac]))).sum())
    assert E.lovasz_softmax(px, buckets=16).first()["loss"] == pytest.approx(np.mean(losses))
    assert E.segmentation_loss(px.limit(0), "lovasz").first()["loss"] == 0.0
    with pytest.raises(ValueError):
        E.segmentation_loss(px, "hinge")


def test_flips_and_turns(spark):
    px = spark.createDataFrame([(r, c) for r in range(4) for c in range(6)], "row int, col int")
    for _, dims in G.FLIPS:
        assert set(map(tuple, G.flip(G.flip(px, dims, 4, 6), dims, 4, 6).collect())) == set(map(tuple, px.collect()))
    sq = spark.createDataFrame([(r, c, r * 3 + c) for r in range(3) for c in range(3)], "row int, col int, v int")
    turned = np.zeros((3, 3), int)
    for r in G.rot90(sq, 1, 3, 3).collect():
        turned[r["row"], r["col"]] = r["v"]
    assert (turned == np.rot90(np.arange(9).reshape(3, 3))).all()


def test_tta_modes_differ(spark):
    px = pixels(spark, SF).where("tile = 0").select("tile", "row", "col", "prob")
    a, b = (tta_average(px, looks_left, m, 30, 50).orderBy("row", "col").toPandas()["prob"] for m in ("logit_mean", "prob_mean"))
    assert len(a) == 1500 and not np.allclose(a, b)


def cube(spark, n, bands=1):
    rows = [("t", r, c, [float(10 * r + c + b) for b in range(bands)], int(r > c)) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "tile string, row int, col int, bands array<double>, label int")


def test_crops_and_augmentation(spark):
    tile = cube(spark, 40)
    crop = G.random_crop(tile, 32, 1, 0, 40, 40)
    assert crop.count() == 1024 and crop.agg(F.max("row"), F.max("col")).first() == (31, 31)
    with pytest.raises(ValueError):
        G.random_crop(tile, 41, 1, 0, 40, 40)
    same = G.scale_jitter(crop, 32, 1.0, 1.0, 1)
    key = lambda df: {(r["row"], r["col"]): (round(r["bands"][0], 6), r["label"]) for r in df.collect()}
    assert key(same) == key(crop) == key(G.rotate_small(crop, 32, 5.0, 0.0, 1))
    assert G.scale_jitter(crop, 32, 1.3, 1.3, 1).count() == 1024
    small = key(G.scale_jitter(G.random_crop(tile, 40, 1, 0, 40, 40), 40, 0.8, 0.8, 1))
    assert len(small) == 1600
    turned = key(G.rotate_small(crop, 32, 5.0, 1.0, 1))
    assert len(turned) == 1024 and turned != key(crop)
    noisy = G.add_noise(crop, 0.1, 1.0, 1)
    assert key(noisy) == key(G.add_noise(crop.repartition(5), 0.1, 1.0, 1)) != key(crop)
    spread = [a[0] - key(crop)[k][0] for k, a in key(noisy).items()]
    assert abs(np.mean(spread)) < 0.02 and 0.08 < np.std(spread) < 0.12
    stats = ([5.0], [2.0])
    one = G.training_table(tile, stats, size=32, h=40, w=40, seed=1, epoch=2, radar=(0.1, 0.1), noise=(0.1, 0.5))
    assert one.count() == 1024 and G.validation_table(tile, stats).where("row = 0 and col = 0").first()["bands"] == [-2.5]


def test_resize_against_numpy(spark):
    got = {(r["row"], r["col"]): r["bands"][0] for r in G.scale_jitter(cube(spark, 64), 64, 0.5, 0.5, 3).collect()}
    assert len(got) == 4096  # a 32 x 32 picture, mirrored around
    inner = {round(v, 6) for v in got.values()}
    half = {round((10 * (2 * r + 0.5) + 2 * c + 0.5), 6) for r in range(32) for c in range(32)}
    assert inner <= half


def test_regrid(spark):
    src = spark.createDataFrame([(r, c, r * 4 + c) for r in range(4) for c in range(4)], "row int, col int, v int")
    g = {"a": 20.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -20.0, "f": 80.0, "width": 4, "height": 4}
    t = g | {"a": 10.0, "e": -10.0, "width": 9, "height": 8}
    got = {(r["row"], r["col"]): r["v"] for r in J.regrid_nearest(src, g, t, ["v"]).collect()}
    assert len(got) == 72 and got[(0, 0)] == got[(1, 1)] == 0 and got[(7, 7)] == 15 and got[(3, 8)] is None
    moved = J.regrid_nearest(src, g, t, ["v"], to_src=lambda x, y: (x + 20, y))
    assert moved.where("row = 0 and col = 0").first()["v"] == 1


def test_grid_checks(spark):
    rows = view(spark, SF, "grid_headers")
    assert J.check_grid(rows.limit(1)).count() == 0
    with pytest.raises(ValueError):
        J.require_grid(view(spark, "/root/testdata/sf0.01", "grid_headers"))
    odd = cube(spark, 3)
    assert J.shape_mismatches({"a": odd, "b": odd.where("row < 2")}).count() == 1


def test_blocks(spark):
    px = cube(spark, 10, 2).withColumn("scene_id", F.lit("s"))
    windows = G.assign_windows(px, 6, 2, 10, 10)
    fn = lambda x: np.stack([x[:, 0], x[:, 1]], 1)
    for each in (1, 3):
        out = G.stitch(score_blocks(windows, fn, 6, 2, tta="logit_mean", overlap=2, batch=each))
        assert {(r["row"], r["col"]): (r["logit0"], r["logit1"]) for r in out.collect()} == {(r["row"], r["col"]): tuple(r["bands"]) for r in px.collect()}
        assert out.where("failed <> 0 OR error IS NOT NULL").isEmpty()
    wide = score_blocks(G.assign_windows(px, 16, 4, 10, 10), fn, 16, 2)
    assert wide.count() == 100


def test_pixels_of_failed_blocks_stay(spark):
    """10 x 10 pixels in four windows of 6, one of which fails: its own 16 pixels have no logits, the seam is marked."""
    px = cube(spark, 10, 2).withColumn("scene_id", F.lit("s"))

    def fails(x):
        if x[:, 0, 0, 0].min() == 0:
            raise RuntimeError("broken")
        return x[:, :2]

    windows = G.assign_windows(px, 6, 2, 10, 10)
    rows = score_blocks(windows, fails, 6, 2, overlap=2)
    assert rows.where("error IS NOT NULL").count() == 36 and rows.where("row IS NULL").isEmpty() and rows.count() == windows.count()
    out = G.stitch(rows)
    assert out.count() == 100 and out.where("logit0 IS NULL").count() == 16 and out.where("failed = 1").count() == 36
    assert {r[0] for r in out.where("failed = 1").select("error").distinct().collect()} == {"RuntimeError: broken"}
    short = windows.withColumn("bands", F.when((F.col("row") == 9) & (F.col("col") == 9), F.array(F.lit(1.0))).otherwise(F.col("bands")))
    odd = score_blocks(short, lambda x: x[:, :2], 6, 2, overlap=2)
    assert odd.where("error = 'unexpected number of bands'").count() == 36


def test_packed_blocks(spark):
    px = cube(spark, 10, 2)
    rows = G.to_blocks(G.assign_windows(px, 6, 2, 10, 10), 6, 2, ("tile",)).collect()
    assert sorted((r["top"], r["left"]) for r in rows) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    for r in rows:
        planes, there = G.unpack_block(r["block"], r["cells"], 6, 2)
        assert there.all() and planes[0].tolist() == [[float(10 * (r["top"] + i) + r["left"] + j) for j in range(6)] for i in range(6)]
    [one] = G.to_blocks(G.assign_windows(px.where("row < 4 AND col < 3"), 6, 2, 4, 3), 6, 2, ("tile",)).collect()
    planes, there = G.unpack_block(one["block"], one["cells"], 6, 2)
    assert there.sum() == 12 and there[:4, :3].all() and planes[:, ~there].sum() == 0


def test_default_windows_fit_a_worker(spark):
    """Four windows of 512 x 512 pixels with 67 bands at a time; the scorer tells the worker's peak in MB."""
    n = 960
    px = spark.range(n * n).select(F.lit("s").alias("scene_id"), (F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    px = px.withColumn("bands", F.transform(F.sequence(F.lit(1), F.lit(67)), lambda k: (F.col("row") + k).cast("float")))

    def peak(x):
        assert x.shape[1:] == (67, 512, 512)
        used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        return np.full((len(x), 2, 512, 512), [[[used]], [[float(len(x))]]])

    out = score_blocks(G.assign_windows(px, 512, 64, n, n), peak, 512, 67, overlap=64).groupBy("top").agg(F.max("logit0"), F.max("logit1"), F.count("*")).collect()
    assert [r[2] for r in out] == [2.0, 2.0] and all(r[3] == 2 * 512 * 512 for r in out)
    assert max(r[1] for r in out) < 1500


def test_gathering_needs_one_shuffle_after_the_join(spark):
    crop = G.random_crop(cube(spark, 40), 32, 1, 0, 40, 40)
    wanted = crop.select("tile", "row", "col", (F.col("row") * 0.9).alias("y"), (F.col("col") * 0.9).alias("x"))
    plan = G.gather(crop, wanted).select("tile", "bands")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and plan.count("Exchange hashpartitioning") <= 3  # two sides of the join, one grouping


def test_augmentation_moves_a_crop_once_for_a_step_and_joins_nothing(spark):
    one = G.training_table(cube(spark, 40), ([5.0], [2.0]), size=32, h=40, w=40, seed=1, epoch=2, scale=(0.8, 1.25), rotate=(5.0, 0.7))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_scale_jitter_with_ragged_null_and_absent_bands(spark):
    rows = [("t", 0, 0, [1.0], 1), ("t", 0, 1, [2.0, 5.0], 1), ("t", 1, 0, [3.0, None], 0)]  # nothing at (1, 1), too few at (0, 0)
    crop = spark.createDataFrame(rows, "tile string, row int, col int, bands array<double>, label int")
    got = {(r["row"], r["col"]): (r["bands"], r["label"]) for r in G.rotate_small(crop, 2, 0.0, 1.0, 1).collect()}
    assert got == {(0, 0): ([1.0, None], 1), (0, 1): ([2.0, 5.0], 1), (1, 0): ([3.0, None], 0), (1, 1): ([0.0, 0.0], 0)}
    for n in (1, 2):
        step = G.scale_jitter(crop.repartition(n), 2, 16.0, 16.0, 1)
        assert "Join" not in step._jdf.queryExecution().executedPlan().toString() and 0 < step.count() <= 4


def test_rotate_small_holds_one_crop(spark):
    tiles = spark.range(40 * 64).select((F.col("id") / 64).cast("int").cast("string").alias("tile"), (F.col("id") % 64 / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.array(F.col("id").cast("double")).alias("bands"), F.lit(1).alias("label"))
    turned = G.rotate_small(tiles, 8, 5.0, 1.0, 3)
    plan = turned._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert turned.groupBy("tile").count().where("count = 64").count() == 40


@pytest.mark.parametrize("step", ["scale", "rotate", "both"])
def test_crops_are_dealt_out_by_their_pixels(spark, monkeypatch, step):
    monkeypatch.setattr(G, "PART_PIXELS", 256, raising=False)
    tiles = spark.range(40 * 64).select((F.col("id") / 64).cast("int").cast("string").alias("tile"), (F.col("id") % 64 / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.array(F.col("id").cast("double")).alias("bands"), F.lit(1).alias("label"))
    steps = {"scale": lambda: G.scale_jitter(tiles, 8, 1.0, 1.0, 3), "rotate": lambda: G.rotate_small(tiles, 8, 5.0, 1.0, 3)}
    both = lambda: G.training_table(tiles, ([5.0], [2.0]), size=8, h=8, w=8, seed=1, epoch=2, scale=(0.8, 1.25), rotate=(5.0, 0.7))
    rows = steps.get(step, both)()
    dealt = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(tile" in line]
    assert len(dealt) == (2 if step == "both" else 1) and all(", 10), REPARTITION_BY_NUM" in line for line in dealt)
    held = rows.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("tile").alias("tiles")).collect()
    assert sum(r["tiles"] for r in held) == 40 and len(held) > 4  # shuffles of 4 parts, merged to fewer, before


def test_crops_are_dealt_out_without_a_sort_by_part(spark, monkeypatch):
    assert G.crop_parts(spark.range(2560)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(G, "PART_PIXELS", 10)
    assert G.crop_parts(spark.range(1500)) == 150 and G.crop_parts(spark.range(2560)) == 200  # 256 would be sorted in memory


def test_regrid_projects_a_grid_once_for_all_keys(spark, monkeypatch):
    src = spark.createDataFrame([(t, r, c, t * 100 + r * 4 + c) for t in (1, 2) for r in range(4) for c in range(4) if (t, r, c) != (2, 1, 1)], "tile int, row int, col int, v int")
    g = {"a": 20.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -20.0, "f": 80.0, "width": 4, "height": 4}
    fine = g | {"a": 10.0, "e": -10.0, "c": -10.0, "width": 10, "height": 8}
    told = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def moved(x):
        told.add(1)
        return x

    wanted = {(t, r, c): t * 100 + (r // 2) * 4 + (c - 1) // 2 if 1 <= c <= 8 and (t, r // 2, (c - 1) // 2) != (2, 1, 1) else None for t in (1, 2) for r in range(8) for c in range(10)}
    for sent in (1 << 16, 0):
        monkeypatch.setattr(J, "SENT_CELLS", sent)
        rows = J.regrid_nearest(src, g, fine, ["v"], lambda x, y: (x, y), keys=("tile",)).collect()
        assert len(rows) == 160 and {tuple(r)[:3]: r["v"] for r in rows} == wanted
    monkeypatch.undo()
    J.regrid_nearest(src, g, fine, ["v"], lambda x, y: (moved(x), y), keys=("tile",)).collect()
    assert told.value == 80  # the cells of one grid, not of two tiles


def test_lines_to_look_left_in_are_not_merged_to_one_sort(spark):
    px = pixels(spark, SF).select("tile", "row", "col", "prob")
    plan = tta_average(px, looks_left, "logit_mean", 30, 50)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(tile" in line and "flip" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]


def test_classifier(spark):
    px = pixels(spark, SF).withColumn("bands", F.array((F.col("label") * 2 + F.col("p_milli") / 1000.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)))
    for kind in ("logistic", "trees", "gaussian"):
        out = predict_pixels(fit_pixel_classifier(px, "s1", model=kind), px)
        assert E.water_iou(out, (F.col("prob") >= 0.5).cast("int"), F.col("label")).first()[0] > 0.8
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "UDF" not in plan and "Python" not in plan
    with pytest.raises(ValueError):
        fit_pixel_classifier(px, "s1", model="other")
    with pytest.raises(ValueError, match="both classes"):
        fit_pixel_classifier(px.where("label = 1"), "s1", model="gaussian")


def test_fitted_models_as_columns_equal_mllib(spark):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    px = pixels(spark, SF).withColumn("bands", F.array(F.col("vh"), F.col("angle"), F.col("prob"), F.col("vh") * F.col("prob"))).select("px_id", "bands", "label")
    rows = px.select("px_id", array_to_vector("bands").alias("features"), F.col("label").cast("double").alias("label"))
    for kind, learner in (("logistic", LogisticRegression(maxIter=30, regParam=1e-3)), ("trees", GBTClassifier(seed=0, maxIter=10))):
        theirs = {r[0]: r[1][1] for r in learner.fit(rows).transform(rows).select("px_id", vector_to_array("probability")).collect()}
        ours = {r[0]: r[1] for r in predict_pixels(fit_pixel_classifier(px, model=kind), px).select("px_id", "prob").collect()}
        assert set(theirs) == set(ours) and max(abs(theirs[k] - ours[k]) for k in ours) < 1e-9


def test_features_are_compared(spark):
    px = pixels(spark, SF).withColumn("bands", F.array(F.lit(1.0), F.lit(2.0), F.col("prob"), F.col("label") * 1.0 + F.col("prob")))
    sweep, best = compare_features(px.where("px_id % 2 = 0"), px.where("px_id % 2 = 1"))
    assert sweep.count() == 2 * len(E.THRESHOLDS)
    rows = {r["scope"]: r["water_iou"] for r in best.collect()}
    assert rows["s1aef"] > rows["s1"] and rows["best_eval"] == rows["s1aef"]


def test_windows_read_their_share_of_a_store(spark, tmp_path):
    """A narrow, tall window: only the row groups of its blocks are read, where rows alone would prune none."""
    import pyarrow.parquet as pq

    n, side = 256, 8
    px = spark.range(n * n).select(F.lit("a b").alias("scene_id"), (F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), F.sha2(F.col("id").cast("string"), 256).alias("filling"))
    S.write_pixels(px, str(tmp_path / "px"), block=side, group_bytes=1 << 15)
    window = (0, 96, n, 6)
    got = S.read_window(S.read_pixels(spark, str(tmp_path / "px"), ["a b"]), *window, block=side)
    assert got.count() == n * 6 and got.columns == ["row", "col", "filling", "scene_id"]
    assert "PushedFilters" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "block" in plan.split("PushedFilters")[1]
    ranges = S.block_ranges(0, 96 // side, (n - 1) // side, 101 // side)
    groups = [g for f in (tmp_path / "px").rglob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(i) for i in range(m.num_row_groups))]
    names = [groups[0].column(i).path_in_schema for i in range(groups[0].num_columns)]
    reach = lambda g, c: (g.column(names.index(c)).statistics.min, g.column(names.index(c)).statistics.max)
    hit = sum(any(a <= reach(g, "block")[1] and reach(g, "block")[0] <= b for a, b in ranges) for g in groups)
    assert len(groups) > 60 and hit <= 0.15 * len(groups)


@pytest.mark.parametrize("rectangle", [(0, 0, 0, 0), (3, 5, 9, 6), (0, 0, 7, 7), (1, 1, 30, 30), (100, 7, 131, 7)])
def test_block_ranges(spark, rectangle):
    top, left, bottom, right = rectangle
    cells = [(r, c) for r in range(top, bottom + 1) for c in range(left, right + 1)]
    frame = spark.createDataFrame(cells, "row int, col int").select("row", "col", S.block_number(F.col("row"), F.col("col"), 1).alias("k"))
    numbers = {r["k"] for r in frame.collect()}
    assert numbers == {sum((r >> i & 1) << 2 * i + 1 | (c >> i & 1) << 2 * i for i in range(16)) for r, c in cells}
    exact = S.block_ranges(*rectangle, most=1 << 20)
    assert numbers == {k for a, b in exact for k in range(a, b + 1)}
    few = S.block_ranges(*rectangle, most=3)
    assert len(few) <= 3 and all(any(a <= k <= b for a, b in few) for k in numbers)


def test_noise_is_normal_and_by_band(spark):
    rows = spark.range(2000).select(G.normals(F.lit(7), "seed", F.col("id").cast("string")).alias("z"))
    z = np.array([r["z"] for r in rows.collect()])
    assert z.shape == (2000, 7) and abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    assert np.abs(np.corrcoef(z.T) - np.eye(7)).max() < 0.1
    assert spark.range(1).select(F.size(G.normals(F.lit(1), "s"))).first()[0] == 1


def test_stream_scores_each_scene_once(spark, tmp_path):
    px = pixels(spark, SF).where("px_id < 60").select(
        F.concat(F.lit("s"), (F.col("px_id") % 3).cast("string")).alias("scene_id"), F.lit(2025).alias("year"), "row", "col", "s1", "prob"
    )
    bad = px.where("scene_id = 's2'").withColumn("s1", F.array(F.lit(1.0)))
    drops = str(tmp_path / "drops")
    good = px.where("scene_id <> 's2'")
    good.unionByName(bad).coalesce(1).write.parquet(drops)
    score = lambda d: d
    stream = lambda: spark.readStream.schema(px.schema).parquet(drops)
    root = str(tmp_path / "out")
    for turn in range(2):
        X.score_new_scenes(stream(), root, score, str(tmp_path / "ck")).awaitTermination()
        good.where("scene_id = 's0'").coalesce(1).write.mode("append").parquet(drops)
        assert spark.read.parquet(f"{root}/probabilities").count() == good.count()
    summary = X.read_summary(spark, root)
    assert {(r["scene_id"], r["status"]) for r in summary.collect()} == {("s0", "ok"), ("s1", "ok"), ("s2", "error")} and summary.count() == 3
    work, report = J.skip_existing(px.select("scene_id").distinct(), S.read_probability(spark, root).select("scene_id").distinct(), "scene_id")
    assert [r[0] for r in work.collect()] == ["s2"] and report.count() == 2
    S.write_scene_summary(summary, str(tmp_path / "csv"))
    rows = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert rows.columns == list(S.SUMMARY_COLUMNS) and rows.where("seconds IS NULL OR prob_path IS NULL").isEmpty()
    assert summary.first()["finished"].endswith("+00:00")


def test_scene_over_several_batches_is_whole(spark, tmp_path):
    px = pixels(spark, SF).where("tile = 0").select(
        F.lit("s1_2025-1-5").alias("scene_id"), F.lit(2025).alias("year"), "row", "col", "s1", "prob", F.lit("/a/s1_2025-1-5.tif").alias("s1_path")
    )
    drops, root = str(tmp_path / "drops"), str(tmp_path / "out")
    px.repartition(3, "col").write.parquet(drops)
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(drops)
    calls = []
    X.score_new_scenes(stream, root, lambda d: calls.append(1) or d, str(tmp_path / "ck")).awaitTermination()
    assert len(calls) == 3 and S.read_probability(spark, root).count() == px.count()
    row = X.read_summary(spark, root).collect()
    assert len(row) == 1 and row[0]["total_pixels"] == px.count()
    assert (row[0]["date"], row[0]["s1_path"], row[0]["status"]) == ("2025-01-05", "/a/s1_2025-1-5.tif", "ok")


def test_stats_are_reused(spark, tmp_path):
    stats = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 0.0)], "band int, mean double, std double")
    made = []
    find = lambda path, **more: S.resolve_band_stats(spark, str(tmp_path / path), 2, lambda: made.append(path) or stats, **more)
    for _ in range(2):
        assert [r["std"] for r in find("a").orderBy("band").collect()] == [2.0, 1.0] and made == ["a"]
    assert find("b", parent=str(tmp_path / "a")).count() == 2 and find("c", parent=str(tmp_path / "none")).count() == 2
    assert find("a", source=str(tmp_path / "b")).count() == 2 and made == ["a", "c"]


def test_layers_of_other_shapes_are_refused(spark):
    px = pixels(spark, SF).where("tile < 2")
    layer = lambda c: px.select("tile", "row", "col", c)
    assert J.align_pixels(layer("prob"), layer("vv"), layer("label")).count() == px.count()
    with pytest.raises(ValueError, match="tiles \\[0\\]"):
        J.align_pixels(layer("prob"), layer("vv").where("row > 0"), layer("label"))


def test_quantile_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 999), (3, 400)) for v in (rng.random(n) if k < 3 else rng.integers(0, 4, n) * 0.3)] + [(4, None)]
    got = {r["k"]: r["value"] for r in E.quantile(spark.createDataFrame(rows, "k int, v0 double"), 0.95, ("k",), "v0").collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, v in got.items():
        assert abs(v - np.percentile([x for i, x in rows if i == k], 95)) < 1e-12


def test_artifacts(spark, tmp_path):
    px = pixels(spark, SF)
    sweep, tiles = E.threshold_sweep(px), E.tile_metrics(px, 0.5)
    S.write_eval_artifacts(str(tmp_path / "art"), sweep, tiles, E.worst_tiles(tiles), E.best_threshold(sweep), E.projection_norms(view(spark, SF, "proj_w"))[0])
    assert {p.name for p in (tmp_path / "art").iterdir()} == {"threshold_sweep", "tile_metrics", "worst_tiles", "summary", "projection_report"}


def test_percentile_of_a_sure_scene(spark):
    """300,000 values below 0.0009 and a small scene: exact, and next to nothing is put in order."""
    n = 300_000
    rows = spark.range(n).select(F.lit("sure").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40) * 9e-4).alias("v"))
    few = spark.createDataFrame([("few", 0.1), ("few", 0.2), ("few", None), ("one", 0.7)], "k string, v double")
    rows = rows.unionByName(few).unionByName(rows.where("v < 8.9e-4").limit(1000).select(F.lit("equal").alias("k"), F.lit(0.25).alias("v")))
    got = {r["k"]: r["value"] for r in E.quantile(rows, 0.95, ("k",), "v").collect()}
    assert set(got) == {"sure", "few", "one", "equal"}
    assert got["few"] == pytest.approx(0.195) and got["one"] == 0.7 and got["equal"] == 0.25
    values = np.array([r[0] for r in rows.where("k = 'sure'").select("v").collect()])
    assert got["sure"] == np.percentile(values, 95)
    near = {r["k"]: r for r in E.bounds(rows, 0.95, ("k",), "v").collect()}["sure"]
    assert 0 < ((values >= near["low"]) & (values <= near["high"])).sum() < n / 100
    for q in (0.0, 0.5, 1.0):
        assert {r["k"]: r["value"] for r in E.quantile(rows, q, ("k",), "v").collect()}["sure"] == np.percentile(values, q * 100)


def test_lovasz_ranges_of_a_large_tile_are_even(spark):
    """A model that is sure of 200,000 pixels: the ranges that tasks sort hold 2 percent each at most."""
    n = 200_000
    px = spark.range(n).select(F.lit(1).alias("tile"), (F.pow(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30), 9.0)).alias("prob"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    loss = E.lovasz_softmax(px, ["tile"])
    assert loss.first()["loss"] == pytest.approx(E.lovasz_softmax(px).first()["loss"]) == pytest.approx(E.lovasz_softmax(px, ["tile"], buckets=1).first()["loss"])
    assert "_b" in loss._jdf.queryExecution().executedPlan().toString()
    rows = px.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "prob", "label").select("class", F.abs((F.col("label") == F.col("class")).cast("int") - F.when(F.col("class") == 1, F.col("prob")).otherwise(1 - F.col("prob"))).alias("err"))
    cuts = rows.groupBy("class").agg(F.percentile_approx("err", [k / 64 for k in range(1, 64)], 640).alias("cuts"))
    shares = rows.join(cuts, "class").groupBy("class", F.size(F.filter("cuts", lambda c: c <= F.col("err"))).alias("b")).count()
    assert shares.agg(F.max("count")).first()[0] <= 0.02 * n


def test_records_are_ranked_in_ranges(spark):
    records = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("name"))
    got = {r["name"]: r["_rank"] for r in E._ranked(records, 7).collect()}
    want = sorted(got, key=lambda x: (hashlib.md5(f"7:{x}".encode()).hexdigest(), x))
    assert [got[x] for x in want] == list(range(1, 3001))
    plan = E._ranked(records, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1 and "_range" in plan.split("Window [row_number")[1].split("]")[1]
