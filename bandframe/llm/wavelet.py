"""Token ids on disk as wavelet matrices: one compressed file per shard, with rank and select."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = 16
MAGIC = b"WVM2"
#: Bits of a plane that are compressed together; the rank directory has an entry for each.
CHUNK = 1 << 16
#: A file is closed once it holds so many ids, at a document's end.
FILE_IDS = 1 << 21
#: Bytes of input that one task sorts and writes at most, about.
PART_BYTES = 128 << 20
#: Words whose ids a worker keeps, and the longest of them in bytes.
CACHE, CACHED_BYTES = 1 << 20, 64

_encoders: dict[str, Encoder] = {}


def pack(ids: np.ndarray) -> bytes:
    """The file of a sequence of ids below 2**16.

    Magic, number of ids, the zeros of each level; then the rank directory: per level and chunk the ones
    before it, and the length of the zstd-compressed chunk; then the chunks. Level l holds bit
    ``15 - l`` of the ids in the order in which the levels above have stably parted zeros from ones.
    """
    zeros, ones, chunks, now = [], [], [], np.ascontiguousarray(ids, np.uint16)
    squeeze = zstandard.ZstdCompressor(level=1)
    for level in range(LEVELS):
        bit = (now & np.uint16(1 << (LEVELS - 1 - level))) != 0
        plane = np.packbits(bit, bitorder="little")
        parts = [plane[k : k + CHUNK // 8] for k in range(0, len(plane), CHUNK // 8)]
        chunks += [squeeze.compress(p.tobytes()) for p in parts]
        ones += np.concatenate([[0], np.cumsum([np.bitwise_count(p).sum(dtype=np.int64) for p in parts])[:-1]])[: len(parts)].tolist()
        low = now[~bit]
        zeros.append(len(low))
        now = np.concatenate([low, now[bit]])
    directory = np.array([ones, [len(c) for c in chunks]], "<u8").tobytes()
    return struct.pack(f"<4sQ{LEVELS}Q", MAGIC, len(ids), *zeros) + directory + b"".join(chunks)


class WaveletMatrix:
    """A file made by ``pack``: access, rank (count), select (occurrence) and the whole sequence.

    Chunks are expanded when they are first touched: access and rank touch two a level at most.
    """

    def __init__(self, file: bytes):
        magic, self.n, *self.zeros = struct.unpack_from(f"<4sQ{LEVELS}Q", file)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.file, self.per, self.open = file, -(-self.n // CHUNK), {}
        at, count = struct.calcsize(f"<4sQ{LEVELS}Q"), LEVELS * self.per
        ones, sizes = np.frombuffer(file, "<u8", 2 * count, at).astype(np.int64).reshape(2, count)
        self.ones = ones.reshape(LEVELS, self.per)
        self.starts = at + 16 * count + np.concatenate([[0], np.cumsum(sizes)])
        self.expand = zstandard.ZstdDecompressor().decompress

    def _chunk(self, level: int, number: int) -> np.ndarray:
        key = level * self.per + number
        if key not in self.open:
            self.open[key] = np.frombuffer(self.expand(self.file[self.starts[key] : self.starts[key + 1]]), np.uint8)
        return self.open[key]

    def ids(self) -> np.ndarray:
        """The whole sequence, from the last level to the first."""
        now = np.zeros(self.n, np.uint16)
        for level in reversed(range(LEVELS)):
            plane = b"".join(self.expand(self.file[self.starts[k] : self.starts[k + 1]]) for k in range(level * self.per, (level + 1) * self.per))
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[~bit] = now[: self.zeros[level]]
            up[bit] = now[self.zeros[level] :] | np.uint16(1 << (LEVELS - 1 - level))
            now = up
        return now

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a level."""
        number, rest = divmod(i, CHUNK)
        if number == self.per:  # behind the last full chunk
            return self.n - self.zeros[level]
        if not rest:
            return int(self.ones[level, number])
        chunk, (whole, bits) = self._chunk(level, number), divmod(rest, 8)
        tail = int(chunk[whole] & ((1 << bits) - 1)).bit_count() if bits else 0
        return int(self.ones[level, number]) + int(np.bitwise_count(chunk[:whole]).sum(dtype=np.int64)) + tail

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(LEVELS):
            ones = self._ones(level, i)
            number, rest = divmod(i, CHUNK)
            bit = int(self._chunk(level, number)[rest >> 3] >> (rest & 7)) & 1
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _run(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of a value in the first i places lie below the last level."""
        lo, hi = 0, i
        for level in range(LEVELS):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = value >> (LEVELS - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often a value occurs in the first i places."""
        lo, hi = self._run(value, i)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """The place of occurrence k of a value, from 0; -1 if there are fewer."""
        lo, hi = self._run(value, self.n)
        return int(self._up(value, np.array([lo + k]))[0]) if 0 <= k < hi - lo else -1

    def places(self, value: int) -> np.ndarray:
        """The places of all occurrences of a value, rising."""
        return self._up(value, np.arange(*self._run(value, self.n)))

    def _up(self, value: int, at: np.ndarray) -> np.ndarray:
        """From places below the last level to those in the sequence, rising, a level at a time.

        The directory tells the chunk that holds the wanted one or zero; only those chunks are read.
        """
        for level in reversed(range(LEVELS)):
            one = value >> (LEVELS - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            before = self.ones[level] if one else np.arange(self.per) * CHUNK - self.ones[level]
            number, at = np.searchsorted(before, want, "right") - 1, np.empty_like(at)
            for k in np.unique(number):
                own = number == k
                bits = np.unpackbits(self._chunk(level, k), bitorder="little", count=min(CHUNK, self.n - k * CHUNK))
                at[own] = k * CHUNK + np.flatnonzero(bits == one)[want[own] - before[k]]
        return at


#: The tokenizer's own split rule, with its white space written out (fixed values).
#: What a tokenizer file says of its normaliser, split and word ends where this rule holds (fixed values).
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: itself if it prints, else one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in shown else next(other)) for b in range(256)}


class Encoder:
    """Ids of a text by the tokenizers library, two bytes each, with a memory for words and pieces.

    No token and no rule of the tokenizer reaches over an ASCII white space, so a word's ids are
    those it has alone. A word not met before is normalised, split by the tokenizer's rule, and its
    pieces go to the library's model unless they are known. What the rule can't see alone (words
    that may hold a special token) goes through the library whole, and so do all texts if the file's
    rules aren't ``RULES``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in own["added_tokens"])
        self.known = special and all(own[k] == v for k, v in RULES.items())
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.letters = byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        out = struct.pack(f"<{len(ids)}H", *ids)
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        if len(piece) <= CACHED_BYTES:
            self.pieces[piece] = out
        return out

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        plain = text.isascii()
        text = text.lower() if plain else self.normalizer.normalize_str(text)
        pieces = [text] if plain and text.isalpha() else SPLIT.findall(text)
        out = b"".join([self.pieces.get(p) or self._piece(p) for p in pieces])
        if len(self.words) >= CACHE:
            self.words.clear()
        if len(word) <= CACHED_BYTES:
            self.words[word] = out
        return out

    def encode(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8."""
        if not self.known:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u2").tobytes()
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILES = pa.schema(
    [("part", pa.int32()), ("number", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("file", pa.binary())]
)
FILES_DDL = "part int, number int, start long, n_ids long, docs array<long>, ends array<long>, file binary"


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, start, docs, ends, ids, n = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
    end, encode = struct.pack("<H", end_id), encoder(path).encode

    def close() -> pa.RecordBatch:
        file = pack(np.frombuffer(b"".join(ids), "<u2"))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, number, start, n, docs, ends, file), FILES.types)], schema=FILES)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(encode(text or b"") + end)
            n += len(ids[-1]) // 2
            docs.append(doc)
            ends.append(n)
            if n >= FILE_IDS:
                yield close()
                number, start, docs, ends, ids, n = number + 1, start + n, [], [], [], 0
    if docs:
        yield close()


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every document and write the ids as wavelet matrix files, in ascending order of id.

    Rows are dealt out by range of id and sorted; each task (``part``) writes files of about
    ``FILE_IDS`` ids, each a row of the Parquet table at ``path``, so Spark's commit guards against
    lost tasks: part, number, start (ids of the part before the file), n_ids, docs and ends (where
    each document ends in the file, ``end_id`` included), file.

    Null and empty texts have the end id alone. Rows with equal ids are all kept, in any order; a
    null id comes first. A document longer than a file gets a file of its size. An empty table
    writes no row. Other columns are ignored. The tokenizer's ids must be below 2**16.
    """
    from tokenizers import Tokenizer

    if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) > 1 << LEVELS:
        raise ValueError("ids don't fit in 16 bits")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # Spark's estimate; far above any table if it has none
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES if size < 1 << 50 else 0)
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    files = rows.mapInArrow(lambda x: _write(x, tokenizer, end_id), FILES_DDL)
    files.write.option("compression", "none").parquet(path)  # the planes are compressed


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files written by ``write_tokens``, with ``first``, the ids of all files before each."""
    files = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # A row per part, and as many parts as shuffle partitions at most: small enough to send to all.
    return files.join(F.broadcast(parts), "part").withColumn("first", F.col("before") + F.col("start")).drop("before")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of files one at a time: a file has some MB."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        ids, start, out = WaveletMatrix(row["file"]).ids().astype("<u4"), 0, []
        for doc, end in zip(row["docs"], row["ends"]):
            out.append((doc, row["first"] + start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start = end
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_documents(files: DataFrame) -> DataFrame:
    """Per document, read back: doc_id, start, n_tokens, ids_crc32 (ids as 32-bit little-endian)."""
    return files.select("first", "docs", "ends", "file").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _found(batches: Iterator[pa.RecordBatch], value: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        matrix, ends = WaveletMatrix(row["file"]), np.array(row["ends"], np.int64)
        at = matrix.places(value)
        doc = np.searchsorted(ends, at, "right")
        ids = [row["docs"][d] for d in doc]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at - np.concatenate([[0], ends])[doc])], names=["doc_id", "place"])


def occurrences(files: DataFrame, value: int) -> DataFrame:
    """Every place of an id: rows (doc_id, place in the document), by rank and select alone."""
    return files.select("docs", "ends", "file").mapInArrow(lambda x: _found(x, value), "doc_id long, place long")


def _counts(batches: Iterator[pa.RecordBatch], values: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0):
            matrix = WaveletMatrix(file.as_py())
            yield pa.RecordBatch.from_pydict({"id": values, "n": [matrix.rank(v, matrix.n) for v in values]}, schema=pa.schema([("id", pa.int64()), ("n", pa.int64())]))


def token_counts(files: DataFrame, values: list[int]) -> DataFrame:
    """How often each of the given ids occurs, by rank alone: rows (id, n)."""
    return files.select("file").mapInArrow(lambda x: _counts(x, values), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
