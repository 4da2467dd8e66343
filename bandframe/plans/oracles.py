"""DuckDB SQL for the raster queries, written another way wherever there is one: plain cross joins,
range joins and window functions in place of buckets and computed explodes."""

from __future__ import annotations

from bandframe.functions.projection import FORWARD, INVERSE, LATITUDE, utm
from bandframe.operators.evaluate import THRESHOLDS
from bandframe.plans.fixtures import duckdb_with
from bandframe.plans.queries import HEAD, N_BANDS, SEEN, SHOWN, THREE

PX = duckdb_with("px")
P = "(p_milli / CAST(1000 AS DOUBLE))"
LABEL = "(CASE WHEN dw_class = 0 THEN 1 WHEN dw_class IS NOT NULL THEN 0 END)"
FINITE = "CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) THEN 0.0 ELSE {0} END"
BANDS = f"list_concat([{', '.join(FINITE.format(c) + '::DOUBLE' for c in ('vv', 'vh', 'angle'))}], list_transform(aef, lambda x: ({FINITE.format('x')})::DOUBLE))"
VALID = "(s1_mask <> 0 AND NOT (isnan(vv) OR isinf(vv) OR isnan(vh) OR isinf(vh) OR isnan(angle) OR isinf(angle)) AND len(list_filter(aef, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR x = -128)) = 0)"
METRICS = """
round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS precision,
round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS recall,
round(tp / CAST(greatest(tp + fp + fn, 1) AS DOUBLE), 6) AS water_iou,
round((2 * tn / CAST(greatest(2 * tn + fp + fn, 1) AS DOUBLE) + 2 * tp / CAST(greatest(2 * tp + fp + fn, 1) AS DOUBLE)) / 2, 6) AS dice,
round((tp + tn) / CAST(greatest(tp + fp + tn + fn, 1) AS DOUBLE), 6) AS accuracy,
round((tn / CAST(greatest(tn + fp + fn, 1) AS DOUBLE) + tp / CAST(greatest(tp + fp + fn, 1) AS DOUBLE)) / 2, 6) AS jaccard,
tp, fp, tn, fn"""
COUNTS = """
count(*) FILTER (WHERE {pred} AND {y} = 1) AS tp, count(*) FILTER (WHERE {pred} AND {y} <> 1) AS fp,
count(*) FILTER (WHERE NOT {pred} AND {y} <> 1) AS tn, count(*) FILTER (WHERE NOT {pred} AND {y} = 1) AS fn"""
REACHES = "coalesce({0} >= {1} AND NOT isnan({0}), false)"
RAW = COUNTS.format(pred=REACHES.format("p_raw", "CAST(0.55 AS DOUBLE)"), y=LABEL)
DAY = r"""
SELECT *, string_split(path, '/')[-1] AS file, replace(replace(string_split(path, '/')[-1], '.tif', ''), 's1_', '') AS d FROM scene_paths"""
DATED = f"""{duckdb_with("scene_paths")}, named AS ({DAY}), dated AS (
  SELECT *, CASE WHEN regexp_full_match(d, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST(
    split_part(d, '-', 1) || '-' || lpad(split_part(d, '-', 2), 2, '0') || '-' || lpad(split_part(d, '-', 3), 2, '0') AS DATE) END AS day
  FROM named), good AS (SELECT *, CAST(year(day) AS INT) AS year FROM dated WHERE day IS NOT NULL)"""
SIDES = f"""{duckdb_with("tile_files")}, seen AS (
  SELECT kind, path, string_split(path, '/')[-1] AS name FROM tile_files
  WHERE len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.'))) = 0
), side AS (SELECT kind, name, min(path) AS path FROM seen GROUP BY ALL), trip AS (
  SELECT s.name, s.path AS s1_path, a.path AS aef_path, l.path AS label_path,
         CASE WHEN a.path IS NULL THEN 'missing_aef' WHEN l.path IS NULL THEN 'missing_label' ELSE 'paired' END AS status
  FROM (SELECT * FROM side WHERE kind = 's1') s LEFT JOIN (SELECT * FROM side WHERE kind = 'aef') a USING (name)
  LEFT JOIN (SELECT * FROM side WHERE kind = 'label') l USING (name))"""
SWEEP = f"""t AS (SELECT CAST(unnest([{", ".join(map(str, THRESHOLDS))}]) AS DOUBLE) AS threshold),
counted AS (SELECT eval_mode, threshold, {COUNTS.format(pred=REACHES.format("p", "threshold"), y="y")} FROM probs CROSS JOIN t GROUP BY ALL),
sweep AS (SELECT eval_mode, threshold, {METRICS} FROM counted),
raw AS (SELECT eval_mode, threshold, tp / CAST(greatest(tp + fp + fn, 1) AS DOUBLE) AS water_iou, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS precision,
  (2 * tn / CAST(greatest(2 * tn + fp + fn, 1) AS DOUBLE) + 2 * tp / CAST(greatest(2 * tp + fp + fn, 1) AS DOUBLE)) / 2 AS dice FROM counted)"""
WINDOWS = "win AS (SELECT t AS top, l AS left_ FROM (SELECT unnest([0, 12, 14]) AS t) CROSS JOIN (SELECT unnest([0, 12, 24, 34]) AS l))"
CELLS = """cells AS (SELECT tile_no, CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col FROM (SELECT DISTINCT tile_no FROM px) CROSS JOIN range({n}) r CROSS JOIN range({n}) c)"""
#: Between four neighbours: from places (tile_no, row, col, y, x, ly, lx) and crops c (tile_no, r, c, bands, label).
BETWEEN = f"""corners AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(i, j)),
ask AS (SELECT tile_no, row, col, floor(y) + i AS r, floor(x) + j AS c, (CASE i WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE j WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS wt FROM places CROSS JOIN corners),
image AS (SELECT ask.tile_no, row, col, {", ".join(f"sum(bands[{i + 1}] * wt) AS v{i}" for i in SHOWN)} FROM ask JOIN c ON c.tile_no = ask.tile_no AND c.r = ask.r AND c.c = ask.c WHERE wt > 0 GROUP BY ALL)
SELECT p.tile_no AS tile, p.row, p.col, CAST(coalesce(l.label, 0) AS INT) AS label, {", ".join(f"round(coalesce(v{i}, 0) + 1e-9, 5) + 0.0 AS b{i}" for i in SHOWN)}
FROM places p LEFT JOIN image USING (tile_no, row, col) LEFT JOIN c l ON l.tile_no = p.tile_no AND l.r = p.ly AND l.c = p.lx"""
STARTS = "list_distinct(list_append(range(0, greatest({n} - 16, 0) + 1, 12), greatest({n} - 16, 0)))"


def drawn(seed: str, lot: str, key: str = "tile_no") -> str:
    """A draw from md5, as in ``columns.draw``."""
    return f"CAST(concat('0x', substr(md5('{seed}:{lot}:' || {key}), 1, 7)) AS BIGINT)"


def _list(values: list[float]) -> str:
    return "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "]"


STATS = """stats AS (SELECT band, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-8)) AS std
  FROM (SELECT unnest(bands) AS x, unnest(range(67)) AS band FROM b) GROUP BY band)"""


def _flipped(name: str) -> str:
    left = {"identity": "col_i - 1", "vertical": "col_i - 1", "horizontal": "col_i + 1", "both": "col_i + 1"}[name]
    return f"SELECT a.tile_no, a.row_i, a.col_i, 1.0 AS l0, {P.replace('p_milli', 'a.p_milli')} * 2 + coalesce({P.replace('p_milli', 'n.p_milli')}, 0) / 2 AS l1 FROM px a LEFT JOIN px n ON n.tile_no = a.tile_no AND n.row_i = a.row_i AND n.col_i = a.{left}"


def _moved(points: str, start: int, end: int) -> str:
    """Tables up to ``moved`` (row, col, east, north): points (row, col, x, y) of one UTM zone on the map of another."""
    a, b = utm(start), utm(end)
    e = (a.flattening * (2 - a.flattening)) ** 0.5
    n = a.third
    series = lambda rows, x, y, f, g, sign: "".join(f" {sign} {sum(c * n ** (i + 1) for i, c in enumerate(row))!r} * {f}({2 * j} * {x}) * {g}({2 * j} * {y})" for j, row in enumerate(rows, 1))
    return f"""plane AS (SELECT row, col, y / {a.radius!r} AS xi, (x - 500000) / {a.radius!r} AS eta FROM {points}),
      sphere AS (SELECT row, col, xi{series(INVERSE, "xi", "eta", "sin", "cosh", "-")} AS p, eta{series(INVERSE, "xi", "eta", "cos", "sinh", "-")} AS q FROM plane),
      conformal AS (SELECT row, col, asin(sin(p) / cosh(q)) AS chi, radians({a.meridian!r}) + atan2(sinh(q), cos(p)) AS lon FROM sphere),
      earth AS (SELECT row, col, lon - radians({b.meridian!r}) AS d, chi{"".join(f" + {sum(c * n ** (i + 1) for i, c in enumerate(row))!r} * sin({2 * j} * chi)" for j, row in enumerate(LATITUDE, 1))} AS lat FROM conformal),
      tangent AS (SELECT row, col, d, sinh(atanh(sin(lat)) - {e!r} * atanh({e!r} * sin(lat))) AS t FROM earth),
      onto AS (SELECT row, col, atan2(t, cos(d)) AS p, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) AS q FROM tangent),
      moved AS (SELECT row, col, 500000 + {b.radius!r} * (q{series(FORWARD, "p", "q", "cos", "sinh", "+")}) AS east, {b.radius!r} * (p{series(FORWARD, "p", "q", "sin", "cosh", "+")}) AS north FROM onto)"""


ORACLES: dict[str, str] = {
    "q01_discover_scenes": f"""{DATED} SELECT CAST(day AS VARCHAR) AS date, year, 's1aef' AS model_kind, path AS s1_path, '/d/aef.tif' AS aef_path,
        'out/probabilities/' || year || '/' || replace(file, '.tif', '') || '_prob.tif' AS prob_path
        FROM good WHERE year IN (1993, 1995, 1996) ORDER BY string_split(path, '/') LIMIT 100""",
    "q02_pair_triplets": f"{SIDES} SELECT * FROM trip",
    "q03_manifest_checks": f"""{duckdb_with("manifest", "tile_files")}, m AS (
        SELECT coalesce(nullif(tile_name, ''), string_split(s1_path, '/')[-1]) AS name, s1_path, nullif(aef_path, '') AS aef_path, label_path FROM manifest WHERE sample_id = 'a'
      ), named AS (SELECT name, 's1' AS kind, s1_path AS path FROM m UNION ALL SELECT name, 'aef', aef_path FROM m UNION ALL SELECT name, 'label', label_path FROM m)
      SELECT * FROM named WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tile_files f WHERE f.path = named.path)""",
    "q04_read_window": f"{PX} SELECT px_id, tile_no AS tile, row_i AS row, col_i AS col, p_milli FROM px WHERE row_i >= 5 AND row_i < 15 AND col_i >= 10 AND col_i < 30",
    "q05_split_manifest": f"""{SIDES}, r AS (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || name), name) AS k, count(*) OVER () AS n FROM trip WHERE status = 'paired'
      ), cut AS (SELECT *, k <= greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0)) AS held FROM r), parts AS (
        SELECT *, CASE WHEN held THEN 'valid' ELSE 'train' END AS split,
          row_number() OVER (PARTITION BY held ORDER BY md5('42:' || name), name) AS drawn, row_number() OVER (PARTITION BY held ORDER BY name) AS nth FROM cut)
      SELECT split, 'all' AS sample_id, name, s1_path, aef_path, label_path FROM parts WHERE (held AND nth <= 80) OR (NOT held AND drawn <= 300)""",
    "q06_year_counts": f"{DATED} SELECT year, count(*) AS scenes FROM good GROUP BY year",
    "q07_clean_nonfinite": f"{PX} SELECT px_id, CAST(round((CASE WHEN isnan(vv) OR isinf(vv) THEN 0 ELSE vv END) * 100) AS BIGINT) AS vv_centi FROM px",
    "q08_labels": f"{PX} SELECT px_id, CAST({LABEL} AS INT) AS label, CAST({LABEL} AS INT) AS mask, CAST(coalesce(CASE WHEN isnan(vv) OR isinf(vv) THEN 0 ELSE vv END > 0.5, false) AS INT) AS bright FROM px",
    "q09_validity": f"{PX} SELECT px_id, {VALID} AS valid FROM px",
    "q10_normalize": f"""{PX}, b AS (SELECT tile_no, {VALID} AS ok, {BANDS} AS bands FROM px), {STATS}, long AS (
        SELECT tile_no, ok, unnest(bands) AS x, unnest(range({N_BANDS})) AS band FROM b)
      SELECT tile_no AS tile, {", ".join(f"round(sum(CASE WHEN ok THEN (x - mean) / std ELSE 0 END) FILTER (WHERE band = {i}), 4) + 0.0 AS b{i}" for i in SHOWN)}
      FROM long JOIN stats USING (band) GROUP BY tile_no""",
    "q11_align_pixels": f"""{PX} SELECT tile_no AS tile, count(*) AS n, CAST(sum(p_milli) AS BIGINT) AS p_milli, CAST(sum({LABEL}) AS BIGINT) AS water, CAST(sum(len(aef)) AS BIGINT) AS n_aef
        FROM px WHERE px_id % 7 <> 0 AND px_id % 13 <> 0 GROUP BY tile_no""",
    "q12_project_bands": f"""{duckdb_with("proj_w")}, long AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS band FROM embeddings)
      SELECT vec_id, CAST(proj + 3 AS INT) AS band, round(sum(CAST(x AS DOUBLE) * w), 5) + 0.0 AS value FROM long JOIN proj_w USING (band) GROUP BY vec_id, proj
      UNION ALL SELECT vec_id, i, CAST(i + 1 AS DOUBLE) FROM embeddings CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INT) AS i)""",
    "q13_regrid_nearest": f"""{PX}, cells AS (
        SELECT tile, r.range AS row, c.range AS col FROM (SELECT DISTINCT tile_no AS tile FROM px) CROSS JOIN range(64) r CROSS JOIN range(104) c
      ), there AS (SELECT c.range AS col, r.range AS row, CAST(239295 + 5 * (c.range + 0.5) AS DOUBLE) AS x, CAST(4600710 - 5 * (r.range + 0.5) AS DOUBLE) AS y FROM range(64) r CROSS JOIN range(104) c
      ), {_moved("there", 16, 15)}, places AS (
        SELECT 'same' AS zone, *, floor(((col + 0.5) * 5 - 12.5) / 10) AS x, floor(((row + 0.5) * 5 - 7.5) / 10) AS y FROM cells
        UNION ALL SELECT 'other', cells.*, floor((east - 740000) / 10), floor((4600000 - north) / 10) FROM cells JOIN moved USING (row, col))
      SELECT zone, tile, CAST(row AS INT) AS row, count(*) AS cells, count(p_milli) AS inside, CAST(coalesce(sum(p_milli * (col + 1)), 0) AS BIGINT) AS weighted
      FROM places LEFT JOIN px ON tile = tile_no AND x = col_i AND y = row_i GROUP BY ALL""",
    "q14_window_blend": f"""{PX}, win AS (SELECT t AS top, l AS left_ FROM (SELECT unnest([0, 12, 14]) AS t) CROSS JOIN (SELECT unnest([0, 12, 24, 34]) AS l)), s AS (
        SELECT tile_no, row_i, col_i, avg(top * 0.01 - {P}) AS a, avg({P} + left_ * 0.02) AS b
        FROM px JOIN win ON row_i >= top AND row_i < top + 16 AND col_i >= left_ AND col_i < left_ + 16 GROUP BY ALL)
      SELECT tile_no AS tile, row_i AS row, col_i AS col, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS prob FROM s""",
    "q15_check_grid": f"""{duckdb_with("grid_headers")}, f AS (SELECT * FROM grid_headers ORDER BY raster_id LIMIT 1)
      SELECT g.raster_id, CASE WHEN g.bands <> 3 THEN 'bands' ELSE 'grid' END AS problem FROM grid_headers g, f
      WHERE g.bands <> 3 OR (g.crs, g.a, g.b, g.c, g.d, g.e, g.f, g.width, g.height) IS DISTINCT FROM (f.crs, f.a, f.b, f.c, f.d, f.e, f.f, f.width, f.height)""",
    "q16_skip_existing": f"""{DATED}, plan AS (SELECT DISTINCT path, year FROM good), done AS (SELECT DISTINCT path FROM scene_paths WHERE file_id % 4 = 0)
      SELECT path, year, CASE WHEN path IN (SELECT path FROM done) THEN 'skipped-existing' ELSE 'to-do' END AS status FROM plan""",
    "q17_threshold_sweep": f"{PX}, probs AS (SELECT 'plain' AS eval_mode, p_raw AS p, {LABEL} AS y FROM px), {SWEEP} SELECT *, false AS used_tiled_inference FROM sweep",
    "q18_tile_metrics_worst": f"""{PX}, c AS (SELECT tile_no AS tile, {RAW} FROM px GROUP BY tile_no),
      m AS (SELECT tile, {METRICS} FROM c), w AS (SELECT * FROM m ORDER BY water_iou, precision, recall, tile LIMIT 25)
      SELECT w.*, 'plain' AS eval_mode, CAST(0.55 AS DOUBLE) AS threshold, false AS used_tiled_inference, tp + fn AS water_pixels, '/d/s1/tile_' || p_partkey AS s1_path
      FROM w JOIN part ON p_partkey = tile""",
    "q19_score_pixels": f"""{PX}, l AS (SELECT px_id, {VALID} AS ok, list_inner_product({BANDS}, {_list(HEAD[0])}) AS a, list_inner_product({BANDS}, {_list(HEAD[1])}) AS b FROM px)
      SELECT px_id, CASE WHEN ok THEN round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 5) END AS prob FROM l""",
    "q20_scene_summary": f"""{PX}, v AS (SELECT tile_no, CASE WHEN {VALID} THEN {P} END AS p FROM px)
      SELECT tile_no AS tile, count(*) AS total_pixels, count(p) AS valid_pixels, round_even(1 - count(p) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS nodata_fraction,
        round_even(coalesce(avg(p), 0), 6) AS mean_probability, round_even(coalesce(quantile_cont(p, 0.95), 0), 6) AS p95_probability, round_even(coalesce(max(p), 0), 6) AS max_probability
      FROM v GROUP BY tile_no""",
    "q21_band_stats": f"""{PX}, b AS (SELECT {BANDS} AS bands FROM px WHERE tile_no IN (SELECT DISTINCT tile_no FROM px ORDER BY tile_no LIMIT 256)), {STATS}
      SELECT CAST(band AS INT) AS band, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM stats""",
    "q22_confusion": f"""{PX}, c AS (SELECT {COUNTS.format(pred=f"({P} > 1 - {P})", y=LABEL)} FROM px)
      SELECT {METRICS}, round(CASE WHEN tp + fp + fn > 0 THEN tp / CAST(tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS iou_metric FROM c""",
    "q23_audit": f"""{PX} SELECT CASE WHEN tile_no % 5 = 0 THEN 'valid' ELSE 'train' END AS split, count(DISTINCT tile_no) AS tiles, max(row_i) + 1 AS height, max(col_i) + 1 AS width,
        string_agg(DISTINCT CAST({LABEL} AS VARCHAR), ',' ORDER BY CAST({LABEL} AS VARCHAR)) AS label_values FROM px GROUP BY 1""",
    "q24_projection_report": f"""{duckdb_with("proj_w")}, r AS (SELECT *, row_number() OVER (PARTITION BY proj ORDER BY abs(w) DESC, band) AS k FROM proj_w)
      SELECT 'top' AS kind, proj, band, CAST(k AS INT) AS rank, round_even(abs(w), 6) AS value FROM r WHERE k <= 5
      UNION ALL SELECT 'proj_norm', proj, -1, 0, round(sqrt(sum(w * w)), 6) FROM proj_w GROUP BY proj
      UNION ALL SELECT 'band_norm', -1, band, 0, round(sqrt(sum(w * w)), 6) FROM proj_w GROUP BY band""",
    "q25_losses": f"""{PX}, v AS (SELECT tile_no AS tile, least(greatest({P}, CAST(0.001 AS DOUBLE)), CAST(0.999 AS DOUBLE)) AS p, CAST({LABEL} AS DOUBLE) AS y FROM px),
      w AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pt FROM v), l AS (
        SELECT tile, avg(-ln(pt)) AS ce, avg((1 - pt) * (1 - pt) * -ln(pt)) AS focal,
          1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1) + 1 - (2 * sum((1 - p) * (1 - y)) + 1) / (sum(1 - p) + sum(1 - y) + 1) AS dice FROM w GROUP BY tile)
      SELECT tile, round(ce + dice, 5) AS ce_dice, round(focal + dice, 5) AS focal_dice, round((SELECT avg(ce + dice) FROM l), 5) AS mean_loss FROM l""",
    "q26_lovasz": f"""{PX}, e AS (
        SELECT tile_no AS tile, px_id, c, CAST({LABEL} = c AS INT) AS fg, abs(CAST({LABEL} = c AS INT) - CASE c WHEN 1 THEN {P} ELSE 1 - {P} END) AS err
        FROM px CROSS JOIN (SELECT unnest([0, 1]) AS c)
      ), o AS (SELECT *, sum(fg) OVER w AS f, row_number() OVER w AS n, sum(fg) OVER (PARTITION BY tile, c) AS g FROM e WINDOW w AS (PARTITION BY tile, c ORDER BY err DESC, px_id)),
      j AS (SELECT *, 1 - (g - f) / CAST(g + n - f AS DOUBLE) AS jac FROM o WHERE g > 0),
      d AS (SELECT tile, c, err * (jac - coalesce(lag(jac) OVER (PARTITION BY tile, c ORDER BY n), 0)) AS part FROM j),
      s AS (SELECT tile, c, sum(part) AS loss FROM d GROUP BY tile, c)
      SELECT t.tile, round(coalesce(avg(loss), 0), 6) AS loss FROM (SELECT DISTINCT tile_no AS tile FROM px) t LEFT JOIN s USING (tile) GROUP BY t.tile""",
    "q27_best_threshold": f"""{PX}, probs AS (
        SELECT 'plain' AS eval_mode, p_raw AS p, {LABEL} AS y FROM px
        UNION ALL SELECT 'tta', least(p_milli + px_id % 60, 1000) / CAST(1000 AS DOUBLE), {LABEL} FROM px), {SWEEP},
      b AS (SELECT *, row_number() OVER (PARTITION BY eval_mode ORDER BY water_iou DESC, dice DESC, threshold) AS k,
        row_number() OVER (PARTITION BY eval_mode ORDER BY water_iou DESC, precision DESC, threshold) AS top,
        row_number() OVER (ORDER BY water_iou DESC, dice DESC, threshold, eval_mode) AS every FROM raw)
      SELECT 'best' AS kind, eval_mode AS scope, eval_mode, threshold, 1 AS rank, round_even(water_iou, 6) AS water_iou FROM b WHERE k = 1
      UNION ALL SELECT 'best', 'best_eval', eval_mode, threshold, 1, round_even(water_iou, 6) FROM b WHERE every = 1
      UNION ALL SELECT 'top', eval_mode, eval_mode, threshold, CAST(top AS INT), round_even(water_iou, 6) FROM b WHERE top <= 5""",
    "q28_plan_windows": f"""{duckdb_with("grid_headers")}, t AS (SELECT *, unnest({STARTS.format(n="height")}) AS top FROM grid_headers), l AS (SELECT *, unnest({STARTS.format(n="width")}) AS left_ FROM t)
      SELECT raster_id, CAST(top AS INT) AS top, CAST(left_ AS INT) AS left, CAST(least(16, height) AS INT) AS h, CAST(least(16, width) AS INT) AS w FROM l""",
    "q29_flips_tta": f"""{PX}, v AS ({" UNION ALL ".join(_flipped(n) for n in ("identity", "horizontal", "vertical", "both"))}),
      m AS (SELECT tile_no, row_i, col_i, avg(l0) AS a, avg(l1) AS b, avg(exp(l1) / (exp(l0) + exp(l1))) AS pm FROM v GROUP BY ALL)
      SELECT tile_no AS tile, row_i AS row, col_i AS col, round(exp(b) / (exp(a) + exp(b)), 6) AS logit_mean, round(pm, 6) AS prob_mean FROM m""",
    "q30_crop_augment": f"""{PX}, d AS (
        SELECT *, {drawn("7:1", "top")} % 15 AS t, {drawn("7:1", "left")} % 35 AS l, {drawn("7", "flip")} % 2 AS m, {drawn("7", "turns")} % 4 AS k,
          1 + ({drawn("7", "gain")} / CAST(268435456 AS DOUBLE) * 2 - 1) * CAST(0.1 AS DOUBLE) AS g, ({drawn("7", "bias")} / CAST(268435456 AS DOUBLE) * 2 - 1) * CAST(0.5 AS DOUBLE) AS b FROM px
      ), c AS (SELECT *, row_i - t AS r, CASE m WHEN 1 THEN 15 - (col_i - l) ELSE col_i - l END AS c FROM d WHERE row_i BETWEEN t AND t + 15 AND col_i BETWEEN l AND l + 15)
      SELECT tile_no AS tile, CAST(CASE k WHEN 1 THEN 15 - c WHEN 2 THEN 15 - r WHEN 3 THEN c ELSE r END AS INT) AS row, CAST(CASE k WHEN 1 THEN r WHEN 2 THEN 15 - c WHEN 3 THEN 15 - r ELSE c END AS INT) AS col,
        px_id, CAST({LABEL} AS INT) AS label, round(vh * g + b, 5) AS b0, round(angle * g + b, 5) AS b1, round({P}, 5) AS b2 FROM c""",
    "q31_pairing_report": f"""{SIDES} SELECT count(*) FILTER (WHERE status = 'paired') AS pairs, count(*) FILTER (WHERE status = 'missing_aef') AS missing_aef_count,
        count(*) FILTER (WHERE status = 'missing_label') AS missing_label_count,
        array_to_string(list_sort(list(name) FILTER (WHERE status = 'missing_aef'))[1:3], ',') AS missing_aef_examples,
        array_to_string(list_sort(list(name) FILTER (WHERE status = 'missing_label'))[1:3], ',') AS missing_label_examples FROM trip""",
}
ORACLES["q32_lovasz_all"] = ORACLES["q26_lovasz"].replace("tile_no AS tile", "1 AS tile").replace("SELECT t.tile, round", "SELECT round")


def _unit(seed: str, lot: str) -> str:
    return f"({drawn(seed, lot)} / CAST(268435456 AS DOUBLE))"


def _crop(size: int, rows: int, cols: int) -> str:
    return f"""d AS (SELECT *, {drawn("7:1", "top")} % {rows} AS t, {drawn("7:1", "left")} % {cols} AS l FROM px),
      c AS (SELECT tile_no, row_i - t AS r, col_i - l AS c, {BANDS} AS bands, {LABEL} AS label FROM d WHERE row_i BETWEEN t AND t + {size - 1} AND col_i BETWEEN l AND l + {size - 1})"""


ORACLES |= {
    "q33_blocks_stitch": f"""{PX}, {WINDOWS} SELECT a.tile_no AS tile, a.row_i AS row, a.col_i AS col, CAST(0 AS INT) AS failed, CAST(NULL AS VARCHAR) AS error,
        round(avg(a.p_milli * 2 + coalesce(n.p_milli, 0) / CAST(2 AS DOUBLE) + list_inner_product(CAST(a.aef AS DOUBLE[]), {_list(SEEN)})), 4) AS logit1
      FROM px a JOIN win ON a.row_i >= top AND a.row_i < top + 16 AND a.col_i >= left_ AND a.col_i < left_ + 16
      LEFT JOIN px n ON n.tile_no = a.tile_no AND n.row_i = a.row_i AND n.col_i = a.col_i - 1 AND n.col_i >= left_ GROUP BY ALL""",
    "q45_packed_blocks": f"""{PX}, {WINDOWS} SELECT tile_no AS tile, CAST(top AS INT) AS top, CAST(left_ AS INT) AS left, count(*) AS cells, round(sum(p_milli), 3) + 0.0 AS b0,
        round(sum(px_id % 7), 3) + 0.0 AS b1, count(*) + 0.0::DOUBLE AS b2, round(sum(CAST(aef[1] AS DOUBLE)), 3) + 0.0 AS b3, round(sum(CAST(aef[64] AS DOUBLE)), 3) + 0.0 AS b66
      FROM px JOIN win ON row_i >= top AND row_i < top + 16 AND col_i >= left_ AND col_i < left_ + 16 GROUP BY ALL""",
    "q34_scale_jitter": f"""{PX}, {_crop(30, 1, 21)}, {CELLS.format(n=30)},
      f AS (SELECT *, greatest(32, round_even((CAST(0.8 AS DOUBLE) + {_unit("7", "scale")} * CAST({1.25 - 0.8!r} AS DOUBLE)) * 30, 0)) AS side FROM cells),
      o AS (SELECT *, row + {drawn("7", "jitter_top")} % CAST(side - 29 AS BIGINT) AS iy, col + {drawn("7", "jitter_left")} % CAST(side - 29 AS BIGINT) AS ix, CAST(30 AS DOUBLE) / side AS ratio FROM f),
      places AS (SELECT *, least(greatest((iy + CAST(0.5 AS DOUBLE)) * ratio - 0.5, 0), 29) AS y, least(greatest((ix + CAST(0.5 AS DOUBLE)) * ratio - 0.5, 0), 29) AS x,
        least(floor(iy * ratio), 29) AS ly, least(floor(ix * ratio), 29) AS lx FROM o), {BETWEEN}""",
    "q35_rotate_small": f"""{PX}, {_crop(16, 15, 35)}, {CELLS.format(n=16)},
      f AS (SELECT *, radians(CASE WHEN {_unit("7", "turn_p")} < CAST(0.7 AS DOUBLE) THEN ({_unit("7", "angle")} * 2 - 1) * CAST(5 AS DOUBLE) ELSE 0 END) AS a, row - CAST(7.5 AS DOUBLE) AS dy, col - CAST(7.5 AS DOUBLE) AS dx FROM cells),
      g AS (SELECT tile_no, row, col, round(sin(a) * dx + cos(a) * dy + 7.5, 9) AS y, round(cos(a) * dx - sin(a) * dy + 7.5, 9) AS x FROM f),
      places AS (SELECT *, round_even(y, 0) AS ly, round_even(x, 0) AS lx FROM g), {BETWEEN}""",
    "q36_probabilities": f"{PX} SELECT 'tile_' || tile_no AS scene_id, CAST(tile_no % 3 + 2000 AS INT) AS year, row_i AS row, col_i AS col, CASE WHEN {VALID} THEN round({P}, 4) END AS prob FROM px",
    "q37_run_config": f"""{DATED}, g AS (SELECT crs, width, height FROM grid_headers ORDER BY raster_id LIMIT 1), y AS (SELECT year, count(*) AS n FROM good GROUP BY year)
      SELECT '{{"overlap":"64","tile_size":"512"}}' AS settings, CAST(sum(n) AS BIGINT) AS scene_count, '{{' || string_agg('"' || year || '":' || n, ',' ORDER BY year) || '}}' AS by_year,
        (SELECT '{{"crs":"' || crs || '","width":' || width || ',"height":' || height || '}}' FROM g) AS grid FROM y""".replace("WITH scene_paths AS", f"{duckdb_with('grid_headers')}, scene_paths AS", 1),
    "q38_distinct_samples": f"{duckdb_with('manifest')} SELECT string_agg(DISTINCT sample_id, ',' ORDER BY sample_id) AS sample_ids FROM manifest WHERE sample_id <> ''",
    "q39_apply_thresholds": f"""{PX}, t AS (SELECT CAST(unnest([{", ".join(map(str, THRESHOLDS))}]) AS DOUBLE) AS threshold)
      SELECT threshold, count(*) AS pixels, count(*) FILTER (WHERE {REACHES.format("p_raw", "threshold")}) AS water FROM px CROSS JOIN t GROUP BY threshold""",
    "q40_stored_stats": f"{PX}, b AS (SELECT {BANDS} AS bands FROM px), {STATS} SELECT CAST(band AS INT) AS band, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM stats",
    "q41_eval_artifacts": f"""{PX}, probs AS (SELECT 'plain' AS eval_mode, p_raw AS p, {LABEL} AS y FROM px), {SWEEP},
      n AS (SELECT tile_no AS tile, {RAW} FROM px GROUP BY tile_no), m AS (SELECT tile, {METRICS} FROM n),
      x AS (SELECT tile, tp / CAST(greatest(tp + fp + fn, 1) AS DOUBLE) AS a, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS b, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS c FROM n ORDER BY a, b, c, tile LIMIT 25)
      SELECT 'worst' AS kind, tile AS key, water_iou, tp, fn FROM m JOIN x USING (tile)
      UNION ALL SELECT 'sweep', CAST(round(threshold * 100) AS BIGINT), water_iou, tp, fn FROM sweep""",
    "q42_stream_scenes": f"""{PX}, v AS (SELECT tile_no, row_i, col_i, CASE WHEN {VALID} THEN {P} END AS p FROM px), s AS (
        SELECT tile_no, count(*) AS n, count(p) AS valid, round(avg(p), 3) AS mean, round(max(p), 3) AS top,
          CASE WHEN tile_no % 10 = 3 AND bool_or(row_i = 4 AND col_i = 7) THEN 'unexpected number of bands' WHEN tile_no = 6 AND bool_or(row_i = 5 AND col_i = 11) THEN 'scorer' END AS error FROM v GROUP BY tile_no)
      SELECT 'tile_' || tile_no AS scene, CAST(2025 AS INT) AS year, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error,
        CASE WHEN error IS NULL THEN n ELSE 0 END AS total_pixels, CASE WHEN error IS NULL THEN valid ELSE 0 END AS valid_pixels,
        CASE WHEN error IS NULL THEN mean END AS mean_probability, CASE WHEN error IS NULL THEN top END AS max_probability FROM s""",
}


def _gathered(name: str, places: str, source: str) -> str:
    """Tables ``name``: three bands between four neighbours of ``source`` at ``places``, and its nearest labels."""
    return f"""{name}_ask AS (SELECT tile_no, row, col, floor(y) + i AS r, floor(x) + j AS c, (CASE i WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE j WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS wt FROM {places} CROSS JOIN corners),
      {name}_image AS (SELECT a.tile_no, a.row, a.col, sum(s.b0 * wt) AS b0, sum(s.b1 * wt) AS b1, sum(s.b2 * wt) AS b2 FROM {name}_ask a JOIN {source} s ON s.tile_no = a.tile_no AND s.row = a.r AND s.col = a.c WHERE wt > 0 GROUP BY ALL),
      {name} AS (SELECT p.tile_no, p.row, p.col, coalesce(l.label, 0) AS label, coalesce(i.b0, 0) AS b0, coalesce(i.b1, 0) AS b1, coalesce(i.b2, 0) AS b2
        FROM {places} p LEFT JOIN {name}_image i USING (tile_no, row, col) LEFT JOIN {source} l ON l.tile_no = p.tile_no AND l.row = p.ly AND l.col = p.lx)"""


def _normal(i: int) -> str:
    """The noise of band ``i`` of three: one md5 a pixel, its first two draws a pair."""
    unit = lambda k: f"((CAST(concat('0x', substr(h, {1 + 7 * k}, 7)) AS BIGINT) + 0.5::DOUBLE) / 268435456)"
    return f"sqrt(-2 * ln({unit(i // 2 * 2)})) * {('cos', 'sin')[i % 2]}(2 * pi() * {unit(i // 2 * 2 + 1)})"


_SIDE = "greatest(32, round_even((CAST(0.8 AS DOUBLE) + {unit} * CAST({span!r} AS DOUBLE)) * 30, 0))".format(unit=_unit("7:1", "scale"), span=1.25 - 0.8)
ORACLES |= {
    "q43_training_table": f"""{PX}, d AS (SELECT *, 0 AS t, {drawn("7:1", "left")} % 21 AS l, {drawn("7:1", "flip")} % 2 AS m, {drawn("7:1", "turns")} % 4 AS k FROM px),
      c AS (SELECT tile_no, row_i - t AS r, CASE m WHEN 1 THEN 29 - (col_i - l) ELSE col_i - l END AS c, k, vh AS b0, angle AS b1, {P} AS b2, {LABEL} AS label FROM d WHERE col_i BETWEEN l AND l + 29),
      turned AS (SELECT tile_no, CASE k WHEN 1 THEN 29 - c WHEN 2 THEN 29 - r WHEN 3 THEN c ELSE r END AS row, CASE k WHEN 1 THEN r WHEN 2 THEN 29 - c WHEN 3 THEN 29 - r ELSE c END AS col, b0, b1, b2, label FROM c),
      corners AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(i, j)), {CELLS.format(n=30)},
      f AS (SELECT *, {_SIDE} AS side FROM cells),
      o AS (SELECT *, row + {drawn("7:1", "jitter_top")} % CAST(side - 29 AS BIGINT) AS iy, col + {drawn("7:1", "jitter_left")} % CAST(side - 29 AS BIGINT) AS ix, CAST(30 AS DOUBLE) / side AS ratio FROM f),
      zoom AS (SELECT *, least(greatest((iy + CAST(0.5 AS DOUBLE)) * ratio - 0.5, 0), 29) AS y, least(greatest((ix + CAST(0.5 AS DOUBLE)) * ratio - 0.5, 0), 29) AS x,
        least(floor(iy * ratio), 29) AS ly, least(floor(ix * ratio), 29) AS lx FROM o), {_gathered("scaled", "zoom", "turned")},
      a AS (SELECT *, radians(CASE WHEN {_unit("7:1", "turn_p")} < CAST(0.7 AS DOUBLE) THEN ({_unit("7:1", "angle")} * 2 - 1) * CAST(5 AS DOUBLE) ELSE 0 END) AS a, row - CAST(14.5 AS DOUBLE) AS dy, col - CAST(14.5 AS DOUBLE) AS dx FROM cells),
      g AS (SELECT tile_no, row, col, round(sin(a) * dx + cos(a) * dy + 14.5, 9) AS y, round(cos(a) * dx - sin(a) * dy + 14.5, 9) AS x FROM a),
      spin AS (SELECT *, round_even(y, 0) AS ly, round_even(x, 0) AS lx FROM g), {_gathered("rotated", "spin", "scaled")},
      n AS (SELECT *, 1 + ({_unit("7:1", "gain")} * 2 - 1) * CAST(0.1 AS DOUBLE) AS gain, ({_unit("7:1", "bias")} * 2 - 1) * CAST(0.5 AS DOUBLE) AS bias,
        CASE WHEN {_unit("7:1", "noise_p")} < CAST(0.5 AS DOUBLE) THEN CAST(0.05 AS DOUBLE) ELSE 0 END AS std, md5('7:1:noise:' || tile_no || ':' || row || ':' || col || ':0') AS h FROM rotated)
      SELECT tile_no AS tile, row, col, CAST(label AS INT) AS label, {", ".join(f"round((b{i} * gain + bias + std * {_normal(i)} - CAST({m} AS DOUBLE)) / CAST({s} AS DOUBLE), 4) + 0.0 AS b{i}" for i, (m, s) in enumerate(zip(*THREE)))} FROM n""",
    "q46_validation_table": f"""{PX} SELECT tile_no AS tile, row_i AS row, col_i AS col, CAST({LABEL} AS INT) AS label, {", ".join(f"round(({x} - CAST({m} AS DOUBLE)) / CAST({s} AS DOUBLE), 5) + 0.0 AS b{i}" for i, (x, m, s) in enumerate(zip(("vh", "angle", P), *THREE)))}
      FROM px WHERE tile_no % 5 = 0""",
    "q44_pixel_classifier": f"""{PX}, b AS (SELECT px_id, (tile_no * 3 + row_i // 10) % 5 = 0 AS held, {LABEL} AS y, {BANDS} AS bands FROM px WHERE dw_class IS NOT NULL),
      long AS (SELECT px_id, held, y, unnest(bands) AS x, unnest(range({N_BANDS})) AS band FROM b),
      fit AS (SELECT y, band, avg(x) AS mean, greatest(var_pop(x), 1e-6) AS var, count(*) AS n FROM long WHERE NOT held GROUP BY ALL),
      prior AS (SELECT y, ln(n / CAST(sum(n) OVER () AS DOUBLE)) AS prior FROM (SELECT y, any_value(n) AS n FROM fit GROUP BY y)),
      part AS (SELECT px_id, long.y, fit.y AS c, band, -0.5 * ln(var) - (x - mean) * (x - mean) / (2 * var) AS part FROM long JOIN fit USING (band) WHERE held),
      side AS (SELECT px_id, part.y, c, mode AS eval_mode, sum(part) + any_value(prior) AS side FROM part JOIN prior ON prior.y = c JOIN (VALUES ('s1', 3), ('s1aef', {N_BANDS})) AS m(mode, most) ON band < most GROUP BY ALL),
      probs AS (SELECT px_id, y, eval_mode, 1 / (1 + exp(sum(CASE c WHEN 0 THEN side ELSE -side END))) AS p FROM side GROUP BY ALL), {SWEEP},
      best AS (SELECT *, row_number() OVER (PARTITION BY eval_mode ORDER BY water_iou DESC, dice DESC, threshold) AS k FROM raw),
      told AS (SELECT eval_mode, round(threshold, 2) AS threshold, tp, fp, tn, fn FROM counted)
      SELECT 'sweep' AS part, * FROM told UNION ALL SELECT 'best', told.* FROM told JOIN best USING (eval_mode) WHERE k = 1 AND round(best.threshold, 2) = told.threshold""",
}
