"""Pixel tables, listings and weights as views over the given tables, in Spark SQL and DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "embeddings", "part", "supplier")

_PX = """
SELECT o.o_orderkey AS px_id,
       CAST(FLOOR(o.o_orderkey / 1500) AS BIGINT) AS tile_no,
       CAST(FLOOR((o.o_orderkey % 1500) / 50) AS INT) AS row_i,
       CAST(o.o_orderkey % 50 AS INT) AS col_i,
       CASE WHEN o.o_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN o.o_orderkey % 101 = 0 THEN CAST('Infinity' AS DOUBLE)
            ELSE ((o.o_orderkey * 37) % 2500) / CAST(-100 AS DOUBLE) END AS vv,
       ((o.o_orderkey * 53) % 3000) / CAST(-100 AS DOUBLE) AS vh,
       CAST(30 AS DOUBLE) + (o.o_custkey % 1500) / CAST(100 AS DOUBLE) AS angle,
       CASE WHEN o.o_orderkey % 83 = 0 THEN {nodata} ELSE e.embedding END AS aef,
       CASE WHEN o.o_orderkey % 89 = 0 THEN 0 ELSE 255 END AS s1_mask,
       e.label AS dw_class,
       CASE WHEN e.label = 0 THEN 400 + (o.o_orderkey * 7919) % 601
            ELSE (o.o_orderkey * 7919) % 751 END AS p_milli,
       CASE WHEN o.o_orderkey % 61 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN o.o_orderkey % 67 <> 0 THEN p_milli / CAST(1000 AS DOUBLE) END AS p_raw
FROM (SELECT *, o_orderkey % (SELECT COUNT(*) FROM embeddings) AS vec FROM orders) o JOIN embeddings e ON e.vec_id = o.vec
"""
PX = _PX.format(nodata="array_repeat(CAST(-128 AS FLOAT), 64)")
PX_DUCKDB = _PX.format(nodata="list_resize(CAST([] AS FLOAT[]), 64, CAST(-128 AS FLOAT))")

SCENE_PATHS = """
SELECT CONCAT('/scenes/', CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a-b' ELSE 'c' END,
         '/s1_', CASE WHEN o_orderkey % 17 = 0
           THEN CONCAT(CAST(EXTRACT(YEAR FROM o_orderdate) AS INT), '-',
                       CAST(EXTRACT(MONTH FROM o_orderdate) AS INT), '-',
                       CAST(EXTRACT(DAY FROM o_orderdate) AS INT))
           WHEN o_orderkey % 19 = 0 THEN '2025-02-30'
           ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END,
         CASE WHEN o_orderkey % 13 = 0 THEN '_v2' ELSE '' END, '.tif') AS path,
       o_orderkey AS file_id
FROM orders
"""

TILE_FILES = """
SELECT 's1' AS kind, CONCAT('/d/s1/tile_', p_partkey, '.tif') AS path FROM part
UNION ALL SELECT 'aef', CONCAT('/d/aef/r1/tile_', p_partkey, '.tif') FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'aef', CONCAT('/d/aef/r2/tile_', p_partkey, '.tif') FROM part WHERE p_partkey % 110 = 1
UNION ALL SELECT 'aef', CONCAT('/d/aef/.tmp/tile_', p_partkey, '.tif') FROM part WHERE p_partkey % 50 = 2
UNION ALL SELECT 'label', CONCAT('/d/labels/tile_', p_partkey, '.tif') FROM part WHERE p_partkey % 5 <> 0
"""

MANIFEST = """
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS sample_id,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CONCAT('tile_', p_partkey) END AS tile_name,
       CONCAT('/d/s1/tile_', p_partkey, '.tif') AS s1_path,
       CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CONCAT('/d/aef/r1/tile_', p_partkey, '.tif') END AS aef_path,
       CONCAT('/d/labels/tile_', p_partkey, '.tif') AS label_path
FROM part
"""

GRID_HEADERS = """
SELECT CONCAT('scene_', s_suppkey) AS raster_id,
       CASE WHEN s_suppkey % 37 = 5 THEN 4 ELSE 3 END AS bands,
       CASE WHEN s_suppkey % 41 = 7 THEN 'EPSG:32616' ELSE 'EPSG:32615' END AS crs,
       CAST(10 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(500000 AS DOUBLE) AS c,
       CAST(0 AS DOUBLE) AS d, CAST(-10 AS DOUBLE) AS e, CAST(4600000 AS DOUBLE) AS f,
       CAST(50 AS INT) AS width,
       CAST(CASE WHEN s_suppkey % 43 = 9 THEN 31 ELSE 30 END AS INT) AS height
FROM supplier
"""

#: Weights of 16 projections of 64 bands: the means of the embeddings whose ids leave each rest.
_PROJ_W = """
SELECT vec_id % 16 AS proj, CAST(band AS BIGINT) AS band, ROUND(AVG(CAST(x AS DOUBLE)), 6) AS w
FROM {bands} GROUP BY vec_id % 16, band
"""
PROJ_W = _PROJ_W.format(bands="(SELECT vec_id, POSEXPLODE(embedding) AS (band, x) FROM embeddings) b")
PROJ_W_DUCKDB = _PROJ_W.format(bands="(SELECT vec_id, UNNEST(embedding) AS x, UNNEST(range(64)) AS band FROM embeddings) b")

VIEWS = {"px": PX, "scene_paths": SCENE_PATHS, "tile_files": TILE_FILES, "manifest": MANIFEST, "grid_headers": GRID_HEADERS, "proj_w": PROJ_W}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture over the tables of a folder."""
    tables = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t) for t in TABLES if f" {t}" in VIEWS[name]}
    return spark.sql(_bound(VIEWS[name], tables), **tables)


#: What the fixtures read of a table whose rows are dealt out anew, and the key.
NARROW = {"orders": ("o_orderkey", "o_custkey", "o_orderdate")}


def spread(df: DataFrame, table: str) -> DataFrame:
    """A small table in one split would leave all work on it to one core: its few columns are dealt out.

    A table of as many splits as there are cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if table not in NARROW or df.rdd.getNumPartitions() >= cores:
        return df
    return df.select(*NARROW[table]).repartition(cores, NARROW[table][0])


def workdir(spark: SparkSession) -> str:
    """A fresh folder for what a query writes, below ``spark.checkpoint.dir``.

    Where that is unset a local folder serves if all tasks run in the driver; else it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/queries/{uuid.uuid4().hex}"


def _bound(sql: str, tables: dict[str, DataFrame]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return sql


def duckdb_with(*names: str) -> str:
    """The fixtures as the beginning of a DuckDB statement."""
    own = VIEWS | {"px": PX_DUCKDB, "proj_w": PROJ_W_DUCKDB}
    return "WITH " + ", ".join(f"{n} AS ({own[n]})" for n in names)
