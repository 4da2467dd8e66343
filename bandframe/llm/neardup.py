"""MinHash near-dedup with banding, signature checks, exact confirmation and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandframe.llm.components import link_buckets
from bandframe.llm.shingles import shingle_sets
from bandframe.llm.store import cut, tidy

U = np.uint64
SIGNED = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("sig", pa.binary())])


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of n universal hash functions (a*x + b) mod 2**64 >> 32 on 32 bits."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 64, (2, n), U)
    return a | U(1), b


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set; the set is not empty."""
    x = shingles >> U(32)
    least = np.full(len(a), np.iinfo(U).max, U)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k : k + 512, None] * a + b).min(axis=0), out=least)
    return (least >> U(32)).astype("<u4")


@tidy
def _signed(batches: Iterator[pa.RecordBatch], n_hashes: int, seed: int) -> Iterator[pa.RecordBatch]:
    a, b = hash_family(n_hashes, seed)
    for batch in batches:
        n, prints, sigs = [], [], []
        for s in shingle_sets(batch.column("text").to_pylist()):
            n.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s, a, b).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], schema=SIGNED)


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in the given part of all places at least."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sig_u", "sig_v"))
            yield batch.select(["u", "v"]).filter(pa.array((one == two).mean(axis=1) >= least))


@tidy
def _sketched(batches: Iterator[pa.RecordBatch], n_hashes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per node the signature and, behind it, the set as sorted 32-bit hashes."""
    a, b = hash_family(n_hashes, seed)
    for batch in batches:
        sets = shingle_sets(batch.column(1).to_pylist())
        out = [signature(s, a, b).tobytes() + np.unique(s >> U(32)).astype("<u4").tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "sketch"])


def likely_pairs(one: list[bytes], two: list[bytes], part: int, n_hashes: int, rows: int, least: float, percent: int) -> np.ndarray:
    """Which sketches are those of similar sets, or nearly so.

    Their signatures agree in enough places, and in no band before ``part``: each pair counts in the
    first band that both share. Then their sets of short hashes decide.
    """
    hubs, members = ([np.frombuffer(x, "<u4") for x in side] for side in (one, two))
    sigs = np.stack([m[:n_hashes] for m in members])
    out = np.zeros((len(hubs), len(members)), bool)
    for i, hub in enumerate(hubs):
        same = sigs == hub[:n_hashes]
        near = np.flatnonzero(same.mean(axis=1) >= least)
        near = near[same[near].reshape(len(near), n_hashes // rows, rows).all(axis=2).argmax(axis=1) == part]
        for j in near:
            x, y = hub[n_hashes:], members[j][n_hashes:]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i, j] = 100 * both >= (percent - 2) * (len(x) + len(y) - both)
    return out


@tidy
def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    last: dict[int, np.ndarray] = {}
    for batch in batches:
        keep = []
        for u, v, text_u, text_v in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v"))):
            sets = []
            for node, text in ((u, text_u), (v, text_v)):
                if node not in last:
                    last[node] = next(shingle_sets([text]))
                    if len(last) > 64:
                        last.pop(next(iter(last)))
                sets.append(last[node] if node in last else next(shingle_sets([text])))
            one, two = sets
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * both >= percent * (len(one) + len(two) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(
    docs: DataFrame,
    *,
    percent: int = 75,
    bands: int = 32,
    rows: int = 4,
    slack: float = 0.16,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more. Returns id, n_shingles, component_id, kept (id = component_id).

    Documents with equal sets are one class, told by a 128-bit hash of the whole set, and its least
    id stands for it. The signature has ``bands * rows`` minima of universal hash functions. Two
    classes that agree in a whole band share a bucket; a pair at exactly 0.75 is missed by all of 32
    bands of 4 with a chance of 5 in a million. Pairs of a bucket are tested in rounds of hubs (see
    ``link_buckets``): first the signatures, which may fall short of ``percent`` by ``slack`` (over four
    standard deviations), then the full sets.

    Joins that grow with the data are sort-merge joins at every size. Shuffled are 32 bucket rows and the signature of each class, and the texts once, to keep those
    that share a bucket. No task holds the members of a class, bucket or component.

    Null or wordless text has an empty set: no links, its own component. Rows with equal ids are one
    node; where their texts differ, those whose class the id stands for are told apart by a hash of the
    text, and the least links for all of them. Rows with a null id have no links, a null component, and are kept. An empty table gives an
    empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    signs = cut(docs.mapInArrow(lambda x: _signed(x, bands * rows, seed), "id long, mark long, n long, print binary, sig binary"), "signs")
    classes = cut(signs.where("n > 0 AND id IS NOT NULL").groupBy("print").agg(F.min("id").alias("rep")), "classes")
    own = signs.withColumnRenamed("id", "rep").join(classes, ["rep", "print"], "left_semi")
    own = own.groupBy(F.col("rep").alias("node")).agg(F.min("mark").alias("mark"), F.min_by("n", "mark").alias("n"), F.min_by("sig", "mark").alias("sig"))
    own = cut(own, "own")
    pieces = [F.xxhash64(F.lit(b), F.substring("sig", 4 * rows * b + 1, 4 * rows)) for b in range(bands)]
    members = own.select(F.posexplode(F.array(*pieces)).alias("part", "bucket"), "node", (4 * (F.col("n") + bands * rows)).alias("weight"))
    least = percent / 100 - slack
    texts: list[DataFrame] = []

    def begin(nodes: DataFrame) -> None:
        nodes = own.join(nodes.hint("merge"), "node").select(F.col("node").alias("id"), "mark")
        texts.append(cut(docs.join(nodes.hint("merge"), ["id", "mark"]).select("id", "text").dropDuplicates(["id"]), "texts"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        one, two = (own.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "uv")
        near = pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
        near = cut(near.select("u", "v", "sig_u", "sig_v").mapInArrow(lambda x: _alike(x, least), "u long, v long"), "near")
        one, two = (texts[0].select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "uv")
        return near.join(two.hint("merge"), "v").join(one.hint("merge"), "u").select("u", "v", "text_u", "text_v").mapInArrow(lambda x: _confirmed(x, percent), "u long, v long")

    def sketch(nodes: DataFrame) -> DataFrame:
        rows_ = texts[0].join(nodes.withColumnRenamed("node", "id").hint("merge"), "id").select("id", "text")
        return rows_.mapInArrow(lambda x: _sketched(x, bands * rows, seed), "node long, sketch binary")

    likely = lambda one, two, part: likely_pairs(one, two, part, bands * rows, rows, least, percent)
    found = link_buckets(members, sketch, likely, verify, begin=begin).withColumnRenamed("node", "rep")
    named = cut(classes.join(found, "rep", "left").select("print", F.coalesce("component", "rep").alias("component")), "named")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signs.select("id", "n", "print").join(named, "print", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
