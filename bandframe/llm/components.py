"""Connected components and the linking of bucket members, both free of pairs within a group."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandframe.llm.store import cut, drop


def _mark(edges: DataFrame) -> tuple:
    """A checksum of the rows, in any order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """The least node that each node of ``edges`` (u, v) can reach: rows (node, component).

    The least node of a component has no row of its own. ``edges`` is a written table.

    Alternating large-star and small-star (Kiveris et al., 2014). Minima are found by
    pre-aggregation and joined back, so a node with very many neighbours is never one task's list:
    the join can be split at it. Loops and repeated edges do no harm; nodes are not null.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mark, old = _mark(now), []
    while True:
        # Large star: every neighbour above u goes to the least of u and its neighbours.
        both = now.union(now.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # Small star: u and every neighbour below it go to the least of those.
        below = cut(large.groupBy("u").agg(F.min("v").alias("m")), "below")
        moved = large.join(below, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(moved.union(below.select("u", F.col("m").alias("v"))).distinct(), "small")
        seen = _mark(small)
        for table in (*old, least, large, below):
            drop(table)
        if seen == mark:  # stars, each node with the one edge to its component's least
            return small.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, mark, old = small, seen, [small]


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) of different components, with these as cu and cv."""
    name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = pairs.join(name("u"), "u", "left").join(name("v"), "v", "left")
    return ends.withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")}).where("cu <> cv")


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` after more links (u, v): only the components that they connect are worked on."""
    ends = _apart(links, found).select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
    moved = components(cut(ends, "contracted"))
    of = moved.select(F.col("node").alias("component"), F.col("component").alias("least"))
    kept = found.join(of, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return kept.union(moved)


def _hub_links(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components by the true ones of ``pairs`` (u, v, place), a written table that is deleted.

    ``place`` numbers the pairs of each v from 1. The first of each come first, then eight times as many a v each
    time, all that are left once they are no more than the first: always only those whose ends aren't connected yet.
    """
    found, upto, many = None, 1, pairs.where("place = 1").count()
    while True:
        links = cut(verify(pairs.where(F.col("place") <= upto).select("u", "v")), "links")
        if found is None:
            found = components(links)
        elif not links.isEmpty():
            old, found = found, cut(joined_components(found, links), "components")
            drop(old)
        drop(links)
        old, pairs = pairs, cut(_apart(pairs.where(F.col("place") > upto), found).select("u", "v", "place"), "apart")
        drop(old)
        left, most = pairs.agg(F.count("*"), F.max("place")).first()
        if not left:
            drop(pairs)
            return found
        upto = 8 * upto if left > many else most


#: Members of a bucket that one task compares at a time, members that it compares them with, and the
#: bytes of sketches of either.
CHUNK, HUBS, WEIGHT = 1024, 1024, 16 << 20
PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compared(hubs: pa.Table, members: pa.Table, candidates: Callable) -> pa.Table:
    """Pairs of a hub and a member of another component that may be true, each once."""
    if not hubs.num_rows or not members.num_rows:
        return PAIRS.empty_table()
    part = hubs["part"][0].as_py()
    h, hc = (hubs[c].to_numpy() for c in ("node", "c"))
    m, mc, also = (members[c].to_numpy() for c in ("node", "c", "hub"))
    sketches = members["sketch"].to_pylist()
    us, vs = [], []
    for k in range(0, len(h), 64):
        open_ = (hc[k : k + 64, None] != mc) & (~also | (m > h[k : k + 64, None]))
        i, j = np.nonzero(open_ & candidates(hubs["sketch"][k : k + 64].to_pylist(), sketches, part))
        us.append(h[k + i])
        vs.append(m[j])
    u, v = np.concatenate(us), np.concatenate(vs)
    return pa.table([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=PAIRS)


def link_buckets(members: DataFrame, sketch: Callable[[DataFrame], DataFrame], candidates: Callable, verify: Callable[[DataFrame], DataFrame], small: int = 0, begin: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Components of all nodes that share a bucket and are true pairs: rows (node, component).

    ``members`` has rows (bucket, part, node, weight); ``part`` numbers the table of the bucket, and
    ``weight`` is about the bytes of the node's sketch. ``verify``
    takes pairs (u, v), u < v, and returns the true ones; ``begin`` is called before with the nodes (node) that
    share a bucket with another. ``sketch`` gives for rows (node) a binary each, (node, sketch), and
    ``candidates(sketches of hubs, sketches of members, part)`` the matrix of pairs worth a test,
    where it may leave a pair to another part that both share.

    First each bucket pairs its least node with the others. Near copies share many buckets, each with another
    least node, so these pairs are tested by place: of each node first the one that shares the most buckets
    with it, and then only pairs that aren't connected yet (``_hub_links``). In what follows only
    buckets count whose members are in several components. All their members outside the largest
    component (or a share of them by a hash of the node and the round, about ``HUBS`` or ``WEIGHT`` a
    round) are hubs: they are compared with the members by sketch, ``CHUNK`` or ``WEIGHT`` at a time and
    within the task, so that rows arise for likely pairs only; then they leave the bucket. Each round
    draws anew: a hash of the node alone would find its residue classes emptied by the hubs that left
    before. A bucket is done when its members lie in one component:
    every pair of it was then compared or is connected by others. Tables of a round are deleted when the
    next one has what it needs of them. Buckets of at most ``small`` members give
    a row for each such pair instead, which costs no sketch. Nodes in no true pair are absent
    from the result.
    """
    ends = members.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("top")).where("least < top")
    hubs = cut(ends.select("bucket", "least"), "hubs")
    open_ = cut(members.join(hubs, "bucket").where("node > least"), "open")
    pairs = open_.groupBy(F.col("least").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("n"), "u"))
    pairs = cut(pairs.select("u", "v", place.alias("place")), "pairs")
    if begin:
        begin(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    found, before = _hub_links(pairs, verify), [hubs, open_]
    for turn in count(2):  # 1 salts the chunks
        named = open_.select("bucket", "part", "node", "weight").join(found, "node", "left")
        named = cut(named.select("bucket", "part", "node", "weight", F.coalesce("component", "node").alias("c")), "named")
        for table in before:
            drop(table)
        sizes = named.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "c")).alias("most")).where("n > most.n")
        few = F.ceil(F.greatest((F.col("n") - F.col("most.n")) / HUBS, (F.col("w") - F.col("most.w")) / WEIGHT))
        chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("w") / WEIGHT))
        mixed = cut(mixed.select("bucket", "n", F.col("most.c").alias("most"), few.alias("lots"), chunks.alias("chunks")), "mixed")
        if mixed.isEmpty():
            drop(named)
            return found
        hub = (F.col("c") != F.col("most")) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.col("lots")) == 0)
        chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
        rest = named.join(mixed, "bucket").select("bucket", "part", "node", "weight", "c", "chunks", (F.col("n") <= small).alias("small"), hub.alias("hub"), chunk.alias("chunk"))
        rest = cut(rest, "rest")
        drop(named)
        drop(mixed)
        large = rest.where("NOT small")
        large = cut(large.join(sketch(large.select("node").distinct()), "node"), "large")
        ask = large.where("hub").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        likely = ask.groupBy("bucket", "chunk").cogroup(large.groupBy("bucket", "chunk")).applyInArrow(lambda h, m: _compared(h, m, candidates), "u long, v long")
        if small:
            one, two = (rest.where(w).select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "c", "hub"))) for x, w in (("u", "small AND hub"), ("v", "small")))
            both = one.join(two.hint("merge"), "bucket").where("c_u <> c_v AND (NOT hub_v OR node_v > node_u)")
            likely = likely.union(both.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")))
        more = cut(verify(likely.distinct()), "links")
        drop(large)
        if not more.isEmpty():
            old, found = found, cut(joined_components(found, more), "components")
            drop(old)
        drop(more)
        open_, before = rest.where("NOT hub").select("bucket", "part", "node", "weight"), [rest]
