"""Line dedup: two Bloom filters pick suspects, and only suspects shuffle for an exact answer."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandframe.llm.store import cut, drop, tidy

SPACE = b" \t\n\v\f\r"
#: Bits of a filter that are shuffled and merged together, and hash functions per key.
SEGMENT, PROBES = 1 << 16, 4


def keys_of(text: str | None, least: int) -> dict[bytes, list[int]]:
    """The keys of a text that count, each with the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode().lower().split(b"\n")):  # bytes.lower knows A-Z alone
        key = line.strip(SPACE)
        if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
            found.setdefault(key, []).append(i)
    return found


def places(hashes: np.ndarray, bits: int, probes: int = PROBES) -> np.ndarray:
    """The filter positions of each hash, a row for each probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(probes)])


def _segments(hashes: np.ndarray, bits: int, probes: int = PROBES) -> dict[int, bytes]:
    """Set positions by segment, as offsets of two bytes."""
    at = np.unique(places(hashes, bits, probes))
    number, start = np.unique(at // SEGMENT, return_index=True)
    return {int(n): x.astype("<u2").tobytes() for n, x in zip(number, np.split(at % SEGMENT, start[1:]))}


PART = pa.schema([("segment", pa.int64()), ("salt", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
PART_DDL = "segment long, salt int, once binary, twice binary"
#: Parts of a segment that are merged first by themselves, and hashes that a part sums up at most.
SALTS, HELD = 64, 1 << 19


def _part(hashes: np.ndarray, bits: int, probes: int = PROBES) -> Iterator[pa.RecordBatch]:
    """What of a filter some hashes set, by segment."""
    from pyspark import TaskContext

    values, counts = np.unique(hashes, return_counts=True)
    if len(values):
        once, twice = _segments(values, bits, probes), _segments(values[counts > 1], bits, probes)
        salt = TaskContext.get().partitionId() % SALTS
        columns = {"segment": list(once), "salt": [salt] * len(once), "once": list(once.values()), "twice": [twice.get(n, b"") for n in once]}
        yield pa.RecordBatch.from_pydict(columns, schema=PART)


@tidy
def _local_filters(batches: Iterator[pa.RecordBatch], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    hashes: list[int] = []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            hashes += map(xxhash.xxh3_64_intdigest, keys_of(text, least))
    yield from _part(np.array(hashes, np.uint64), bits)


@tidy
def _number_filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy().view(np.uint64))
        n += len(held[-1])
        if n >= HELD:
            yield from _part(np.concatenate(held), bits, 1)
            held, n = [], 0
    if held:
        yield from _part(np.concatenate(held), bits, 1)


def _merge(table: pa.Table, last: bool) -> pa.Table:
    """Combine the filters of one segment: a bit seen by two parts is a bit seen twice.

    The last time over, the twice-seen bits come as they are in the filter, not as offsets.
    """
    once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
    for a, b in zip(table["once"].to_pylist(), table["twice"].to_pylist()):
        more = np.zeros(SEGMENT, bool)
        more[np.frombuffer(a, "<u2")] = True
        twice |= once & more
        twice[np.frombuffer(b, "<u2")] = True
        once |= more
    pack = lambda x: np.flatnonzero(x).astype("<u2").tobytes()
    out = {"segment": table["segment"][:1], "once": [b"" if last else pack(once)], "twice": [np.packbits(twice, bitorder="little").tobytes() if last else pack(twice)]}
    return pa.table(out, schema=pa.schema([("segment", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]))


def line_count(docs: DataFrame, text_col: str) -> int:
    """The lines of all texts."""
    text = F.col(text_col)
    return docs.agg(F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1), F.lit(1)).alias("n")).first()["n"]


def twice_filter(docs: DataFrame, text_col: str, least: int, lines: int) -> tuple[bytes, int]:
    """The filter of hashes seen in two rows or more (compressed), and its size in bits: 8 for each of ``lines``."""
    bits = max(SEGMENT, 1 << (8 * lines - 1).bit_length())
    return _packed(_merged(docs.select(text_col).mapInArrow(lambda x: _local_filters(x, bits, least), PART_DDL)), bits), bits


def _merged(parts: DataFrame) -> DataFrame:
    """The filter of hashes seen twice from the parts of all tasks, a row (segment, twice) for each segment."""
    merged = "segment long, once binary, twice binary"
    parts = parts.groupBy("segment", "salt").applyInArrow(lambda t: _merge(t, False), merged)
    return parts.groupBy("segment").applyInArrow(lambda t: _merge(t, True), merged).select("segment", "twice")


def _packed(segments: DataFrame, bits: int) -> bytes:
    """The filter in one piece (compressed)."""
    twice, step = bytearray(bits // 8), SEGMENT // 8
    for row in segments.toLocalIterator():
        twice[row["segment"] * step : (row["segment"] + 1) * step] = row["twice"]
    return zlib.compress(twice, 1)


def repeated_numbers(rows: DataFrame, column: str, max_filter_bits: int = 1 << 30) -> DataFrame:
    """The rows whose number in a column (long, not null) another row has too, and a few others.

    A filter of all numbers, 16 bits each and ``max_filter_bits`` at most, tells in the tasks which rows may be
    repeated, so few of the single ones are exchanged. Each number sets one bit: that exchanges two bytes a number,
    a quarter of what four bits take, and lets at most 6% of the single ones through (none is lost), more if the
    filter has its greatest size. The numbers are hashes. ``rows`` is read twice: it is a written table.
    """
    bits = min(max(SEGMENT, 1 << (16 * max(rows.count(), 1) - 1).bit_length()), max_filter_bits)
    segments = cut(_merged(rows.select(column).mapInArrow(lambda x: _number_filters(x, bits), PART_DDL)), "segments")
    packed = _packed(segments, bits)
    drop(segments)
    sent, at = rows.sparkSession.sparkContext.broadcast(packed), rows.columns.index(column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for batch in batches:
            spots = places(batch.column(at).to_numpy().view(np.uint64), bits, 1)
            yield batch.filter(pa.array(((filled[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)))

    return rows.mapInArrow(kept, rows.schema)


#: Bits of a bucket of Spark's bitmaps.
BUCKET = 8 * 4096


def filter_of(places_: DataFrame, bits: int) -> bytes:
    """A filter (compressed) from rows (bucket, bit) of set bits: they come together in Spark's bitmaps of
    4 KB, and the driver puts ``bits`` / 8 bytes in a row."""
    filled = bytearray(bits // 8)
    for row in places_.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).toLocalIterator():
        filled[row["bucket"] * BUCKET // 8 : (row["bucket"] + 1) * BUCKET // 8] = row["map"]
    return zlib.compress(filled, 1)


def bit_rows(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (bucket, bit) of the filter positions of hashes."""
    at = np.unique(places(hashes, bits)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(at // BUCKET), pa.array(at % BUCKET)], names=["bucket", "bit"])


@tidy
def _line_hashes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = [], []
        for i, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = list(map(xxhash.xxh3_64_intdigest, keys_of(text, least))) if i is not None else []
            ids += [i] * len(own)
            hashes += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64))], names=["id", "hash"])


def repeated_filter(docs: DataFrame, least: int, max_filter_bits: int) -> tuple[bytes, int]:
    """The filter of hashes that two ids hold, for more lines than a filter of all has room for.

    The hashes and ids of all lines are exchanged, combined in each task, but no text; only repeated ones
    come into the filter, 16 bits each, so unique lines don't fill it however many there are.
    """
    pairs = docs.select("id", "text").mapInArrow(lambda x: _line_hashes(x, least), "id long, hash long")
    ends = pairs.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    found = cut(ends.select("hash"), "repeated")
    bits = max(BUCKET, min(1 << (16 * max(found.count(), 1) - 1).bit_length(), max_filter_bits))
    rows = found.mapInArrow(lambda x: (bit_rows(b.column(0).to_numpy().view(np.uint64), bits) for b in x), "bucket long, bit long")
    return filter_of(rows, bits), bits


@tidy
def _suspects(batches: Iterator[pa.RecordBatch], packed: bytes, bits: int, least: int) -> Iterator[pa.RecordBatch]:
    filled = np.frombuffer(zlib.decompress(packed), np.uint8)
    for batch in batches:
        ids, keys, lines = [], [], []
        for i, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
            if i is not None:
                found = keys_of(text, least)
                ids += [(i, mark)] * len(found)
                keys += found
                lines += found.values()
        if not ids:
            continue
        at = places(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
        hit = np.flatnonzero(((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0))
        yield pa.RecordBatch.from_pydict(
            {"id": [ids[i][0] for i in hit], "mark": [ids[i][1] for i in hit], "key": [keys[i] for i in hit], "lines": [lines[i] for i in hit]},
            schema=pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("key", pa.binary()), ("lines", pa.list_(pa.int32()))]),
        )


def dedup_lines(docs: DataFrame, *, least: int = 10, max_filter_bits: int = 1 << 30, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Drop lines that another document with a smaller id holds too.

    A text is split at \n. The key of a line is the line without ``[\x20\x09-\x0D]`` at both ends,
    A-Z lower-cased. Keys of at least ``least`` code points found in two documents or more lose all
    their lines except those of the smallest id that holds them.

    Returns id, text (the lines that stay, joined by \n), n_lines (before), n_dropped, and the columns
    named in ``carry``.

    Each task notes which hashes it saw once and which twice; merged over all tasks, bits set by two
    tasks count as twice. The filter of twice-seen hashes, of at most ``max_filter_bits`` (128 MB),
    is broadcast, and only lines that it holds shuffle: their least and greatest id is found by
    pre-aggregation, so a line in a third of all documents is a row per task, and the join that
    follows can be split at such a line. If 8 bits a line are more than ``max_filter_bits`` the hashes of
    all lines are exchanged first and the filter holds those of repeated lines only (``repeated_filter``);
    what it holds by mistake is refused by the text as before.

    Null text counts as one empty line. Rows with equal ids are one document to the count. Rows with a null id keep all lines and count for nobody.
    An empty table gives an empty result; other columns are ignored.
    """
    more = {f"carried{i}": c for i, c in enumerate(carry)}
    whole = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in more.items()))
    docs = whole.select("id", "mark", "text")
    lines = line_count(docs, "text")
    packed, bits = twice_filter(docs, "text", least, lines) if 8 * lines <= max_filter_bits else repeated_filter(docs, least, max_filter_bits)
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    suspects = cut(docs.mapInArrow(lambda x: _suspects(x, sent.value, bits, least), "id long, mark long, key binary, lines array<int>"), "suspects")
    first = suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    lost = suspects.join(cut(first, "first"), "key").where("id > first")
    lost = lost.groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lost"))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), "lost")
    return (
        whole.join(lost, ["id", "mark"], "left")
        .select("id", "text", lines.alias("line"), "lost", *more)
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get("line", i)), "\n")).alias("text"),
            F.size("line").cast("bigint").alias("n_lines"),
            F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("bigint").alias("n_dropped"),
            *(F.col(k).alias(c) for k, c in more.items()),
        )
    )
