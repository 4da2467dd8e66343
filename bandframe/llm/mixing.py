"""Mixing sources to target weights, by blocks of words and pseudorandom permutations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandframe.llm.store import cut, tidy

WORD = r"[^\x20\x09-\x0D]+"
#: Slots of one row before the second explode.
CHUNK = 4096
#: Slots that a task makes, about.
TASK_SLOTS = 1 << 20
ROUNDS = 6
#: Documents of a group at most, about, where there are more than ``groups`` of them.
ROWS = 1 << 18


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Element i of a pseudorandom permutation of 0..n-1 chosen by ``key``; ``back`` inverts it.

    A Feistel network over the least even number of bits that holds n, applied again while the
    result is n or more.
    """
    i, n, key = (np.asarray(x, np.uint64).copy() for x in (i, n, key))
    half = np.ones(len(i), np.uint64)
    while (short := (np.uint64(1) << (np.uint64(2) * half)) < n).any():
        half[short] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(i))
    while len(todo):
        left, right, k, h, m = i[todo] >> half[todo], i[todo] & mask[todo], key[todo], half[todo], mask[todo]
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            x = (left if back else right) + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = (x ^ (x >> np.uint64(31))) & m
            left, right = (right ^ x, left) if back else (right, left ^ x)
        i[todo] = (left << h) | right
        todo = todo[i[todo] >= n[todo]]
    return i.astype(np.int64)


def seed_of(*parts: object) -> int:
    """A number of 63 bits from a text form of the parts."""
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little") >> 1


def targets(sizes: list[int], weights: tuple[float, ...], share: float, most: float) -> list[float]:
    """Words that each source is to give: ``share`` of all, by weight, ``most`` times a size at most.

    What a source can't give is shared out again by weight among the others until none is above.
    """
    out, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    rest = share * sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        total = sum(weight[i] for i in sorted(open_))
        above = {i for i in open_ if rest * weight[i] / total > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = rest * weight[i] / total
            break
        for i in sorted(above):
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ -= above
    return out


@dataclass(frozen=True)
class Quota:
    """How many slots a source fills: ``slots`` blocks, the last cut to ``last`` words."""

    slots: int
    last: int


def quota(size: int, target: float, block: int, seed: int, number: int) -> Quota:
    """Slots for ``round(target)`` words of a source, passes over all its blocks counted."""
    words, n = int(round(target)), -(-size // block)
    if not words or not n:
        return Quota(0, 0)
    full, rest = divmod(words, size)
    if not rest:
        full, rest = full - 1, size
    missing = n * block - size  # the last block of the source is shorter by so many words
    at = int(permute([n - 1], [n], [seed_of(seed, number, full)], back=True)[0])
    before = lambda m: m * block - (missing if at < m else 0)
    m = -(-rest // block)
    m += before(m) < rest
    return Quota(full * n + m, rest - before(m - 1))


def draw(slots: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Per shard the slots of each source: multinomial draws over what the sources have left."""
    rng = np.random.default_rng(seed)
    left, out, total = np.array(slots, np.int64), [], sum(slots)
    for shard in range(n_shards):
        want = total * (shard + 1) // n_shards - total * shard // n_shards
        got = np.zeros_like(left)
        while (missing := want - int(got.sum())) > 0:
            free = left - got
            got += np.minimum(rng.multinomial(missing, free / free.sum()), free)
        left -= got
        out.append(got.tolist())
    return out


@tidy
def _blocks_of_slots(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number, n, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "n_blocks", "k"))
        pairs, where = np.unique(np.stack([number, k // n]), axis=1, return_inverse=True)
        keys = np.array([seed_of(seed, *map(int, p)) for p in pairs.T], np.uint64)[where.ravel()]
        block = permute(k % n, n, keys)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=[*batch.schema.names, "block"])


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 128,
    n_shards: int = 16,
    seed: int = 0,
    groups: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Choose the words of a mix of all sources. Returns (documents, pieces).

    documents: id, mark (a hash of the text), size (words), source, source_size, target, number (of the
    source), at (place in the source). pieces: number, at, id, source, mark, size, shard, k (slot of the source),
    turn (pass over the source), from_word, words: a run of words of one document that one slot takes. A
    document without words has no piece; number and at name a document with words.

    Sources in code point order, null last, get ``weights`` in turn; see ``targets``. The documents
    of a source, in the order of (hash group of id and text, id, hash of the text), are one stream of words, packed into
    blocks of ``block`` words. Output shards of near equal slot counts draw multinomial source
    counts; slot k of a source takes block ``permutation(k mod n)`` of its pass ``k div n``, so no
    word is taken more than ``ceil(most)`` times; the last slot of a source is cut to its target.
    All draws depend on ``seed`` and the data alone, so reruns agree.

    The driver holds one row per source and shard. A source may hold any part of the rows: its
    stream is the sum of separately ordered groups, ``groups`` or one for ``ROWS`` documents. Null text
    has size 0. Documents with equal or null ids are separate. Empty sources take no part. An empty table gives empty results; other
    columns are ignored.
    """
    if not 0 < share <= most:
        raise ValueError("share is above 0 and no more than most")
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark"))
    sized = cut(sized.select("id", "source", key.alias("key"), "mark", "size"), "sized")
    groups = max(groups, sized.count() // ROWS)
    sized = sized.withColumn("group", F.pmod(F.xxhash64("id", "mark"), F.lit(groups)).cast("int"))
    bins = cut(sized.groupBy("key", "source", "group").agg(F.sum("size").alias("words")), "bins")
    rows = bins.groupBy("key", "source").agg(F.sum("words").alias("size")).collect()  # a row per source
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    goals = targets(sizes, weights, share, most)
    quotas = [quota(s, t, block, seed, i) for i, (s, t) in enumerate(zip(sizes, goals))]
    table = [(r["key"], i, r["size"], goals[i]) for i, r in enumerate(rows)]
    sources = spark.createDataFrame(table, "key string, number int, source_size long, target double")
    before = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("key", "group", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")).join(sources, "key")
    in_group = Window.partitionBy("key", "group").orderBy("id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(cut(starts, "starts"), ["key", "group"]).select(
        "id", "mark", "size", "source", "source_size", "target", "number", (F.col("start") + F.coalesce(F.sum("size").over(in_group), F.lit(0))).alias("at")
    )
    placed = cut(placed, "placed")

    runs, done = [], [0] * len(rows)
    for shard, counts in enumerate(draw([q.slots for q in quotas], n_shards, seed_of(seed, "shards") % 2**32)):
        for i, n in enumerate(counts):
            if n:
                runs.append((shard, i, -(-sizes[i] // block), done[i], done[i] + n, quotas[i].slots, quotas[i].last, sizes[i]))
                done[i] += n
    runs = spark.createDataFrame(runs, "shard int, number int, n_blocks long, lo long, hi long, slots long, last long, source_size long")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(done) // TASK_SLOTS)  # Spark would merge the few rows of chunks into one task if it chose
    chunks = runs.select("*", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(CHUNK).cast("bigint"))).alias("from")).repartition(tasks, "number", "from")
    slots = chunks.select("*", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK, "hi") - 1)).alias("k"))
    kinds = "shard int, number int, n_blocks long, slots long, last long, source_size long, k long"
    slots = slots.select("shard", "number", "n_blocks", "slots", "last", "source_size", "k").mapInArrow(lambda x: _blocks_of_slots(x, seed), f"{kinds}, block long")
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    slots = slots.select("shard", "number", "k", F.expr("k div n_blocks").alias("turn"), "block", F.when(F.col("k") == F.col("slots") - 1, F.col("last")).otherwise(length).alias("taken"))

    covered = F.sequence(F.expr(f"at div {block}L"), F.expr(f"(at + size - 1) div {block}L"))
    parts = placed.where("size > 0").select("id", "source", "mark", "size", "number", "at", F.explode(covered).alias("block"))
    lo, hi = F.greatest("at", F.col("block") * block), F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("taken"))
    pieces = parts.join(slots.hint("merge"), ["number", "block"]).where(hi > lo)  # both grow with the data
    pieces = pieces.select("number", "at", "id", "source", "mark", "size", "shard", "k", "turn", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("words"))
    placed = placed.withColumnsRenamed({"id": id_col, "source": source_col})
    return placed, pieces.withColumnsRenamed({"id": id_col, "source": source_col})


def taken_words(placed: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the words that the mix takes, repeats counted; null and repeated ids included."""
    taken = pieces.groupBy("number", F.col("at").alias("place")).agg(F.sum("words").alias("taken"))
    rows = placed.withColumn("place", F.when(F.col("size") > 0, F.col("at")))  # an empty document has no place of its own
    return rows.join(taken, ["number", "place"], "left").select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def cut_words(text: str, runs: list[tuple[int, int]]) -> list[str]:
    """The text from the first to the last word of each run (first word, number of words)."""
    ends = [m.span() for m in re.finditer(WORD, text)]
    return [text[ends[a][0] : ends[a + n - 1][1]] for a, n in runs]


def joined_runs(pieces: list[dict]) -> list[tuple[int, int]]:
    """Pieces (turn, from_word, words) in order, as runs: those that follow each other in a turn are one."""
    runs: list[list[int]] = []
    for p in pieces:
        if runs and runs[-1][0] == p["turn"] and runs[-1][1] + runs[-1][2] == p["from_word"]:
            runs[-1][2] += p["words"]
        else:
            runs.append([p["turn"], p["from_word"], p["words"]])
    return [(a, n) for _, a, n in runs]


@tidy
def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column(batch.num_columns - 1).to_pylist()
        texts = ["\n".join(cut_words(t, joined_runs(ps))) for t, ps in zip(batch.column(at).to_pylist(), pieces)]
        columns = batch.columns[:-1]
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def mixed_documents(docs: DataFrame, pieces: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them: per pass over the source the words taken, in their order, a
    line end where some are left out between and after each pass.

    Rows meet their pieces by id, source and a hash of the text, null or not; rows alike in all of
    these take the pieces of their places in turn, each its own, in the order of a hash of all their columns, so that a
    rerun gives each the same. Documents of which nothing is taken
    are absent. Columns are those of ``docs``; ``n_chars``, where present, counts the new text.
    """
    names = docs.columns

    def key(mark: Column) -> Column:
        source = F.col(source_col).cast("string")
        return F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), mark.cast("string"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)))

    order = F.array_sort(F.collect_list(F.struct("turn", "from_word", "words")))
    taken = pieces.groupBy("at", key(F.col("mark")).alias("_mix_key")).agg(order.alias("pieces"))
    places = F.array_sort(F.collect_list(F.struct("at", "pieces")))
    taken = taken.groupBy("_mix_key").agg(places["pieces"].alias("_mix_pieces"))
    rows = docs.withColumn("_mix_key", key(F.xxhash64(text_col)))
    hashed = F.xxhash64(*(f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))  # maps have no hash
    rows = rows.withColumn("_mix_nth", F.row_number().over(Window.partitionBy("_mix_key").orderBy(hashed)))
    own = F.get("_mix_pieces", F.col("_mix_nth") - 1).alias("_mix_pieces")
    joined = rows.join(taken.hint("merge"), "_mix_key").select(*names, own).where("_mix_pieces IS NOT NULL")
    out = joined.mapInArrow(lambda x, at=names.index(text_col): _texts(x, at), docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def mixed_blocks(docs: DataFrame, pieces: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The output: per shard and slot the source number and the words of the block, one space between.

    Pieces meet their texts by id and a hash of the text. A slot's words come from neighbours in the
    stream, so a group is one block.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).dropDuplicates(["id", "mark"])
    own = pieces.withColumnsRenamed({id_col: "piece_id", "mark": "piece_mark"})
    rows = rows.join(own, F.col("id").eqNullSafe(F.col("piece_id")) & (F.col("mark") == F.col("piece_mark")))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("from_word").cast("int") + 1, F.col("words").cast("int")), " ")
    blocks = rows.select("shard", "number", "k", F.struct("at", "from_word", words.alias("words")).alias("piece"))
    blocks = blocks.groupBy("shard", "number", "k").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return blocks.select("shard", "number", "k", F.array_join(F.col("pieces.words"), " ").alias("text"))
