"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised, a row's cell is its index on the Hilbert curve through
the quantised grid, and the shards are runs of the curve. Neighbours on the curve are neighbours in
every dimension, so each shard covers a narrow range of all of them and a reader can skip shards by
the minima and maxima in ``manifest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandframe.llm.store import cut

LAWS = ("rows", "bytes")


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Step tables of the n-dimensional Hilbert curve.

    A state is the entry corner and the direction of a subcube, numbered ``corner * n + direction``.
    For ``state * 2**n + corner`` of a point they give the digit on the curve and the next state
    (Hamilton and Rau-Chaplin, 2008).
    """
    full = (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & full

    def entry(w: int) -> int:
        k = 2 * ((w - 1) // 2)
        return k ^ (k >> 1) if w else 0

    def direction(w: int) -> int:
        if w == 0:
            return 0
        w = w if w & 1 else w - 1
        return (((w + 1) & ~w).bit_length() - 1) % n

    digits, states = [], []
    for corner in range(1 << n):
        for d in range(n):
            for point in range(1 << n):
                code = turn(point ^ corner, n - (d + 1))
                w = 0
                for k in range(n):
                    w ^= code >> k
                digits.append(w)
                states.append((corner ^ turn(entry(w), d + 1)) * n + (d + direction(w) + 1) % n)
    return digits, states


def curve_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point whose coordinates are integers of ``bits`` bits."""
    n = len(cells)
    digits, states = curve_tables(n)
    at = lambda table, key: F.element_at(F.array(*map(F.lit, table)), key + 1)
    corner = lambda k: sum((F.getbit(c, F.lit(k)).cast("int") * (1 << i) for i, c in enumerate(cells)), F.lit(0))
    corners = F.array(*(corner(k) for k in reversed(range(bits))))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("index"))
    step = lambda acc, p: F.struct(
        at(states, acc["state"] * (1 << n) + p).alias("state"),
        (acc["index"] * (1 << n) + at(digits, acc["state"] * (1 << n) + p)).alias("index"),
    )
    return F.aggregate(corners, start, step, lambda acc: acc["index"])


def _ordered_keys(rows: DataFrame, dims: dict[str, str]) -> dict[str, Column]:
    """A number per dimension whose order is the order of the values.

    Text counts by the seven bytes that follow the longest start shared by all values.
    """
    texts = [d for d, kind in dims.items() if kind == "string"]
    ends = rows.agg(F.lit(0).alias("_"), *(f(F.substring(d, 1, 256)).alias(f"{g}_{d}") for d in texts for f, g in ((F.min, "lo"), (F.max, "hi")))).first()
    keys = {}
    for d, kind in dims.items():
        if kind != "string":
            keys[d] = F.coalesce(F.col(d).cast("double"), F.lit(-1.0))
            continue
        lo, hi = ((ends[f"{g}_{d}"] or "").encode() for g in ("lo", "hi"))
        same = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
        seven = F.rpad(F.hex(F.substring(F.encode(F.col(d), "UTF-8"), same + 1, 7)), 14, "0")
        keys[d] = F.coalesce(F.conv(seven, 16, 10).cast("double"), F.lit(-1.0))
    return keys


def hilbert_shards(
    docs: DataFrame,
    *,
    n_shards: int = 16,
    dims: tuple[str, ...] = ("lang", "source", "size"),
    law: str = "rows",
    bits: int = 5,
    salts: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Assign every row to one of ``n_shards`` runs of the Hilbert curve through ``dims``.

    Returns id, size, text_crc32, law, shard, slot (position within the shard, from 0) and curve.
    ``size`` as a dimension is the UTF-8 length of the text plus 1. Each dimension is cut into
    ``2**bits`` ranges at its approximate quantiles, at most ``2**bits - 1`` numbers on the driver.

    ``law="rows"`` cuts runs whose row counts differ by at most one; ``law="bytes"`` cuts at equal
    running sums of size, so a shard misses the mean by at most one row's size.

    Rows of one cell (a hot source may hold a third of all) are dealt over ``salts`` groups by a
    hash of the id, and ranks are the sum of three prefix sums: over cells (at most
    ``2**(bits*len(dims))`` rows), over the groups of a cell, and within a group.

    Null text has size 1 and the checksum of no bytes. Null or equal dimensions share a cell. Rows
    with equal ids are kept and ordered by checksum. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    if law not in LAWS or n_shards < 1 or bits * len(dims) > 30:
        raise ValueError(f"law is one of {LAWS}; n_shards is positive; bits * dims is at most 30")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = (F.octet_length(raw) + 1).cast("bigint")
    kinds = {d: "bigint" if d == "size" else docs.schema[d].dataType.simpleString() for d in dims}
    named = {f"dim{i}": kinds[d] for i, d in enumerate(dims)}
    rows = docs.select(
        F.col(id_col).alias("id"), size.alias("size"), F.crc32(raw).alias("crc"),
        *((size if d == "size" else F.col(d)).alias(f"dim{i}") for i, d in enumerate(dims)),
    )
    keys = _ordered_keys(rows, named)
    parts = F.array(*(F.lit(k / 2**bits) for k in range(1, 2**bits)))
    edges = rows.agg(*(F.percentile_approx(k, parts, 10_000).alias(d) for d, k in keys.items())).first()
    cells = [sum(((keys[d] > F.lit(float(e))).cast("int") for e in edges[d] or []), F.lit(0)) for d in named]
    rows = cut(
        rows.select("id", "size", "crc", curve_index(cells, bits).alias("curve"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")),
        "cells",
    )

    weight = F.lit(1) if law == "rows" else F.col("size")
    bins = cut(rows.groupBy("curve", "salt").agg(F.sum(weight).alias("w"), F.count("*").alias("n")), "bins")
    total = bins.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()["w"]
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    cells = bins.groupBy("curve").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    cells = cells.select("curve", *(F.coalesce(F.sum(c).over(before.orderBy("curve")), F.lit(0)).alias(f"cell_{c}") for c in ("w", "n")))
    in_cell = before.partitionBy("curve").orderBy("salt")
    starts = bins.join(cells, "curve").select(
        "curve", "salt", *((F.col(f"cell_{c}") + F.coalesce(F.sum(c).over(in_cell), F.lit(0))).alias(f"start_{c}") for c in ("w", "n"))
    )
    starts = cut(starts, "starts")
    in_bin = before.partitionBy("curve", "salt").orderBy("id", "crc", "size")
    placed = rows.join(starts, ["curve", "salt"]).select(
        "id", "size", "crc", "curve",
        *((F.col(f"start_{c}") + F.coalesce(F.sum(x).over(in_bin), F.lit(0))).alias(c) for c, x in (("w", weight), ("n", F.lit(1)))),
    )
    middle = "w" if law == "rows" else "(w + size div 2)"
    placed = placed.withColumn("shard", F.expr(f"least({middle} * {n_shards}L div {max(total, 1)}L, {n_shards - 1}L)").cast("int"))
    if law == "rows":  # the first rank of shard s is the least r with r * n_shards >= s * total
        first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    else:
        placed = cut(placed, "placed")
        firsts = placed.groupBy("shard").agg(F.min("n").alias("first"))  # one row per shard
        placed, first = placed.join(F.broadcast(firsts), "shard"), F.col("first")
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"),
        "shard", (F.col("n") - first).cast("bigint").alias("slot"), "curve",
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, one folder per shard, each sorted along the curve.

    Ids must be unique here. The rows are dealt out by range of (shard, slot), so no task gets more
    than its part of one shard and a hot shard spreads over several files.
    """
    place = assigned.select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.drop("shard", "slot").join(place, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
    rows = rows.withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def manifest(shards: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Per shard the rows and the least and greatest value of each dimension, for pruning."""
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), *(f(d).alias(f"{g}_{d}") for d in dims for f, g in ((F.min, "min"), (F.max, "max"))))
