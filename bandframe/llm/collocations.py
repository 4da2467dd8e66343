"""Collocations by Toivonen's method: a sample proposes phrases, full passes count them and their border."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandframe.llm.linededup import BUCKET, bit_rows, filter_of, places
from bandframe.llm.shingles import BASE, U, mix
from bandframe.llm.store import cut, tidy

#: Bytes of text that are counted in one go.
LOT = 5 << 20
#: Rows that a task sends at a time.
ROWS = 1 << 16
#: Lots of a language's phrases that are ranked apart first.
LOTS = 16
_UPPER = bytes(range(65, 91))
_BREAKS, _BLANKS = b".,;:!?\n\v\f\r", b"\t"
#: A-Z to lower case, what ends a piece to a newline, blanks to a blank.
_PLAIN = bytes.maketrans(_UPPER + _BREAKS + _BLANKS, _UPPER.lower() + b"\n" * len(_BREAKS) + b" ")


@dataclass(frozen=True)
class Members:
    """A set of hashes as a Bloom filter: never wrong about a member, rarely about others."""

    packed: bytes
    bits: int

    def opened(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed), np.uint8)


def holds(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter holds each hash."""
    at = places(hashes, len(filled) * 8)
    return ((filled[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1).all(axis=0)


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """The hashes of phrases from those of their words."""
    h = words[0]
    for w in words[1:]:
        h = mix(h * U(BASE) + w)
    return h


def word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of words, other ones in other languages."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), U, len(words))


def _cut_long(text: bytes) -> Iterator[bytes]:
    """A text in parts of about a lot, cut where a piece ends."""
    while len(text) > LOT:
        at = text.rfind(b"\n", 0, LOT)
        at = at if at > 0 else text.find(b"\n", LOT)
        if at < 0:
            break
        yield text[:at]
        text = text[at + 1 :]
    yield text


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and text of several documents, in plain form."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            for part in _cut_long((text.as_py() or "").encode().translate(_PLAIN)):
                held.setdefault(lang.as_py(), []).append(part)
                size += len(part) + 1
                if size >= LOT:
                    yield from ((k, b"\n".join(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


class Lot:
    """The words of a lot as numbers; a break between pieces is -1."""

    def __init__(self, lang: str, text: bytes):
        parts = pc.split_pattern(pa.array([text.replace(b"\n", b" \n ")], pa.large_binary()), b" ").flatten()
        coded = parts.filter(pc.greater(pc.binary_length(parts), 0)).dictionary_encode()
        self.lang = lang.encode()
        self.codes, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        words = self.words.to_pylist()
        self.hashes = word_hash(lang, words)
        if b"\n" in words:
            self.codes[self.codes == words.index(b"\n")] = -1

    def phrases(self, at: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases of ``size`` words that begin at given places as keys, and how often each does."""
        keys = self.codes[at]
        for k in range(1, size):
            if k > 1:
                keys = np.unique(keys, return_inverse=True)[1]
            keys = keys * len(self.words) + self.codes[at + k]
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        words = [self.words.take(pa.array(self.codes[at[first] + k])) for k in range(size)]
        joined = pc.binary_join_element_wise(*words, pa.scalar(b"\t" + self.lang, pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.binary()).cast(pa.string()), n


#: A key is a phrase, a blank and a tab, and its language; words hold neither, so the first tab parts them.
DDL = "key string, n long"


def _slices(keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, n), some at a time: Spark holds a batch outside its heap."""
    for k in range(0, len(n), ROWS):
        yield pa.RecordBatch.from_arrays([keys[k : k + ROWS], pa.array(n[k : k + ROWS])], names=["key", "n"])


@tidy
def _count(batches: Iterator[pa.RecordBatch], now: Members | None, before: Members | None, most: int) -> Iterator[pa.RecordBatch]:
    """Counts by lot of the phrases whose parts ``now`` holds, and without a filter of all.

    With ``before``, the filter of the first pass, it is the expansion: what that pass counted is left out,
    and a phrase counted here counts as a part that ``now`` holds. A first pass counts all words too, and
    all places of words as those of the empty phrase.
    """
    filters = [m.opened() for m in (now, before) if m]
    for lang, text in _lots(batches):
        lot = Lot(lang, text)
        codes = lot.codes
        if not before:
            at = np.flatnonzero(codes >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([" \t" + lang]), pa.array([len(at)])], names=["key", "n"])
            yield from _slices(*lot.phrases(at, 1))
        own = lot.hashes[codes]
        hashes, fits = own, codes >= 0
        inside = [holds(f, lot.hashes)[codes] & fits for f in filters]
        for size in range(2, most + 1):
            fits = fits[:-1] & (codes[size - 1 :] >= 0)
            inside = [x[:-1] & x[1:] & fits for x in inside]  # both parts are in the filter
            counted = inside[0] if now else fits
            if before:
                counted = counted & ~inside[1]
            if len(at := np.flatnonzero(counted)):
                yield from _slices(*lot.phrases(at, size))
            if size == most:
                break
            hashes = mix(hashes[:-1] * U(BASE) + own[size - 1 :])
            for k, f in enumerate(filters):
                at = np.flatnonzero(inside[k])
                inside[k] = np.zeros(len(fits), bool)
                inside[k][at] = holds(f, hashes[at])
            if before:
                inside[0] |= counted


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of rows (lang, phrase)."""
    out = np.zeros(batch.num_rows, U)
    for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        words = word_hash(lang, phrase.encode().split(b" "))
        out[i] = phrase_hash([words[k : k + 1] for k in range(len(words))])[0]
    return out


def members(phrases: DataFrame, max_bits: int) -> Members:
    """The filter of rows (lang, phrase): 16 bits each, ``max_bits`` at most."""
    phrases = phrases.select("lang", "phrase")
    bits = max(BUCKET, min(1 << (16 * max(phrases.count(), 1) - 1).bit_length(), max_bits))
    rows = phrases.mapInArrow(lambda x: (bit_rows(_hashes(b), bits) for b in x), "bucket long, bit long")
    return Members(filter_of(rows, bits), bits)


def _strangers(batches: Iterator[pa.RecordBatch], known: Members) -> Iterator[pa.RecordBatch]:
    filled = known.opened()
    for batch in batches:
        yield batch.filter(pa.array(~holds(filled, _hashes(batch))))


def sampled_least(least: int, every: int) -> int:
    """The bound in a sample of one document in ``every``: two deviations below the expected number, 2 at least."""
    expected = least / every
    return max(2, int(expected - 2 * expected**0.5))


def phrase_counts(docs: DataFrame, *, least: int = 10, most: int = 3, every: int = 8, max_bits: int = 1 << 29, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    r"""All phrases of 1 to ``most`` words with ``least`` places or more: lang, size, phrase, n.

    Texts, A-Z lower-cased, are split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words
    ``[^\x20\x09]+``; a phrase lies within a piece, and all its places count, also where they overlap.
    Everything is by language; a null language is ``und``. A row of size 0 has the number of all words
    of its language.

    Toivonen (1996). One document in ``every``, drawn by a hash of its row, proposes phrases with a lowered
    bound. A pass over all documents counts, beside all words, every phrase whose two parts one word
    shorter were proposed: the proposed phrases and their negative border, as far as it occurs. Words or
    phrases of the border that turn out frequent although they were not proposed are failures. If there
    are any, an expansion pass counts all that they make possible and the first pass left out: phrases
    whose parts are frequent or are candidates of this pass themselves, which closes the border. The
    counts are exact and complete whatever the sample is.

    What a pass looks for is a Bloom filter of ``max_bits`` at most (64 MB). A phrase that it holds by
    mistake, or because it is full, is counted as well; that costs time and changes no result, as the
    same filter decides what was counted and what failed. Tasks count lots of texts by exact numbers of
    words, and only the counts shuffle, combined in each task.

    Null and empty texts have no word. A null id is an id like others, repeated rows are documents of
    their own. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_draw"))
    every_row = rows.select("lang", "text")
    sample = rows.where(F.pmod("_draw", F.lit(every)) == 0).select("lang", "text")
    phrase = F.substring_index("key", " \t", 1)
    size = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
    lang = F.expr("substring(key, instr(key, '\t') + 1)")

    def counted(df: DataFrame, now: Members | None, before: Members | None, words: int, bound: int) -> DataFrame:
        sums = df.mapInArrow(lambda x: _count(x, now, before, words), DDL).groupBy("key").agg(F.sum("n").alias("n"))
        return cut(sums.where((F.col("n") >= bound) | F.col("key").startswith(" ")).select(lang.alias("lang"), size.alias("size"), phrase.alias("phrase"), "n"), "counted")

    parts = F.col("size").between(1, most - 1)
    proposed = counted(sample, None, None, most - 1, sampled_least(least, every)).where(parts)
    first = members(proposed, max_bits)
    found = counted(every_row, first, None, most, least)
    failed = found.where(parts).select("lang", "phrase").mapInArrow(lambda x: _strangers(x, first), "lang string, phrase string")
    if failed.isEmpty():
        return found
    frequent = members(found.where(parts), max_bits)
    return found.unionByName(counted(every_row, frequent, first, most, least))


def _scores(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), with numbers of up to 38 digits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", wide(a, 15) * wide(a, 15) * million, wide(left, 18) * wide(right, 18)).cast("bigint")


def collocations(docs: DataFrame, *, least: int = 10, most: int = 3, top: int = 2000, within: int = 50, **more: object) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to ``most`` words with ``least`` places or more. Cutting one after its first k
    words gives l and r, the places of both parts, and the score floor(1000000 a a / (l r)); the cut
    with the lowest score counts, of several the first. A candidate that lies inside a longer one with
    at least ``within`` percent of its places is dropped. The first ``top`` of each language by score and
    a, both falling, and phrase are kept: first those of each of ``LOTS`` lots of a language's phrases, so
    one task sees ``LOTS`` times ``top`` rows of a language at most.

    The rules for odd rows are those of ``phrase_counts``, which takes ``more``.
    """
    counts = cut(phrase_counts(docs, least=least, most=most, **more), "phrases")
    totals = counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = counts.where("size > 0").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("words", k + 1, F.col("size") - k), " ").alias("tail")))
    many = phrases.where("size > 1").withColumn("words", words)
    parted = many.select("lang", "size", "phrase", "a", F.inline(cuts))
    side = lambda name, part: phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    scored = parted.join(side("l", "head"), ["lang", "head"]).join(side("r", "tail"), ["lang", "tail"])
    scored = scored.withColumn("score", _scores(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every shorter phrase of two words or more inside a candidate, once.
    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))))
    longer = many.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < within * F.col("a")))
    order = (F.desc("best.score"), F.desc("a"), "phrase")
    place = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))
    kept = kept.withColumn("_lot", F.pmod(F.xxhash64("phrase"), F.lit(LOTS)))
    ranked = kept.withColumn("rank", place("_lot")).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", place()).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
