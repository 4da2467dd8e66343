"""SentencePiece encoding and decoding: a relational lattice of pieces, folded by Spark."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandframe.llm.store import give_back, small_batches, tidy, wide_groups

BLANK = "▁"
#: A word is what no piece reaches across: leading blanks with letters or with other signs; a line end.
WORD = regex.compile(rf"{BLANK}*[\p{{L}}\p{{M}}]+|{BLANK}*[^\p{{L}}\p{{M}}{BLANK}\n]+|{BLANK}+|\n")
#: Characters of text of which a block is made; each block brings its words once.
BLOCK = 2 << 20
#: Words of so many characters have their boundaries in one 64-bit number; longer ones in an array.
SHORT = 61
#: The number that stands for an edge has 22 bits of rank, 31 of the end, 5 of the length, and 5 that
#: tell pieces of equal rank apart. Ranks from ``STRANGE`` on are the code points of characters without a piece.
RANK_AT, END_AT, LENGTH_AT, STRANGE = 41, 10, 5, 1 << 21


@dataclass(frozen=True)
class PieceTable:
    """The pieces of a model: text, id and score, with what stands for unknown characters."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes_from: int | None
    unknown: int
    kind: str

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @cached_property
    def ranked(self) -> list[tuple[str, int, float]]:
        """The pieces by falling score."""
        return sorted(self.pieces, key=lambda p: (-p[2], p[1]))

    @cached_property
    def places(self) -> list[tuple[str, int]]:
        """Per piece the parts of an edge that name it: the rank, and what to add for the place in
        ``ranked``. Merges of equal scores share a rank, so that their order is that of the text."""
        out, first = [], 0
        for k, (p, _, s) in enumerate(self.ranked):
            first = first if self.kind == "bpe" and k and s == self.ranked[k - 1][2] else k
            out.append((p, (first << RANK_AT) + k - first))
        return out

    @cached_property
    def texts(self) -> list[bytes]:
        """The bytes that each id stands for."""
        out = [b""] * (1 + max(max(i for _, i, _ in self.pieces), (self.bytes_from or 0) + 255, self.unknown))
        for p, i, _ in self.pieces:
            out[i] = p.replace(BLANK, " ").encode()
        if self.bytes_from is not None:
            for b in range(256):
                out[self.bytes_from + b] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        return out


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number and value, bytes for what has a length."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = raw[at], at + 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield field, raw[at : at + size]
            at += size


def model_kind(path: str) -> str:
    """What a model file says of itself: "unigram" or "bpe" (fields 2 and, in it, 3 of the format)."""
    with open(path, "rb") as file:
        trainer = next((v for k, v in _fields(file.read()) if k == 2), b"")
    number = next((v for k, v in _fields(trainer) if k == 3), 1)
    if number not in (1, 2):
        raise ValueError(f"a model of kind {number}: only unigram (1) and BPE (2) have a lattice")
    return "unigram" if number == 1 else "bpe"


def merges(piece: str, scores: dict[str, float]) -> list[float]:
    """The scores of the merges that BPE makes within a text, in its order."""
    parts, made = list(piece), []
    while True:
        pairs = [(scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not pairs:
            return made
        score, k = max(pairs)
        made.append(score)
        parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]


@lru_cache(maxsize=4)
def load_pieces(path: str) -> PieceTable:
    """Read a model file.

    The words of ``WORD`` must be safe: no piece may reach over two of them. In a BPE model each piece
    must come about by merges whose scores don't rise: then the order of merges in any word is that of
    the scores, and a fold over the edges in this order is exact (``merged``).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, first = [], None
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            first = i if first is None else first
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            rows.append((sp.id_to_piece(i), i, sp.get_score(i)))
    table = PieceTable(tuple(rows), first, sp.unk_id(), model_kind(path))
    if bad := [p for p, _, _ in rows if WORD.findall(p) != [p]]:
        raise ValueError(f"pieces reach over words: {bad[:5]}")
    if table.kind == "bpe":
        check_merges(table)
    return table


def check_merges(table: PieceTable) -> None:
    """An error if the merges of a model don't come in the order of their scores."""
    scores = {p: s for p, _, s in table.pieces}
    if bad := [p for p, _, _ in table.pieces if len(p) > 1 and any(a < b for a, b in pairwise(merges(p, scores)))]:
        raise ValueError(f"merges don't follow the scores: {bad[:5]}")
    if table.longest > 31 or any(place & 1023 > 31 for _, place in table.places) or len(table.pieces) > STRANGE:
        raise ValueError("pieces of over 31 characters, over 32 of one score, or too many")


def lattice(words: DataFrame, table: PieceTable) -> DataFrame:
    """Edges of words (key, word): rows (key, n, edges), the edges of a word as sorted numbers.

    Substrings no longer than the longest piece are exploded and equi-joined to the piece table,
    which the model bounds and which is broadcast; edges are grouped by word. An edge is the rank of
    its piece, then its end and length, so the best edge comes first. A character without a piece
    keeps an edge whose rank is ``STRANGE`` and its code point. Words are cut to overlapping runs
    first: no row but the first holds more than a run, however long the word.
    """
    run, longest = 64, table.longest
    pieces = words.sparkSession.createDataFrame(table.places, "piece string, place long")
    size = F.length("word")
    runs = words.select("key", F.explode(F.sequence(F.lit(0), size - 1, F.lit(run))).alias("s"), "word")
    runs = runs.select("key", "s", F.substring("word", F.col("s") + 1, F.lit(run + longest - 1)).alias("run"), F.least(F.lit(run), size - F.col("s")).alias("begins"))
    begins = runs.select("key", "s", "run", F.explode(F.sequence(F.lit(1), F.col("begins"))).alias("i"))
    begins = begins.select("key", (F.col("s") + F.col("i") - 1).alias("i"), F.substring("run", F.col("i"), F.lit(longest)).alias("rest"))
    spans = begins.select("key", "i", "rest", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("k"))
    spans = spans.select("key", "i", "k", F.substring("rest", F.lit(1), F.col("k")).alias("piece"))
    edges = spans.join(F.broadcast(pieces), "piece", "left").where("place IS NOT NULL OR k = 1")
    place = F.coalesce("place", F.shiftleft((F.ascii("piece") + STRANGE).cast("bigint"), RANK_AT))
    edge = place + F.shiftleft((F.col("i") + F.col("k")).cast("bigint"), END_AT) + F.shiftleft("k", LENGTH_AT)
    grouped = edges.groupBy("key").agg(F.max("i").alias("n"), F.collect_list(edge).alias("edges"))
    return grouped.select("key", (F.col("n") + 1).alias("n"), F.sort_array("edges").alias("edges"))


#: Parts of an edge ``e`` in SQL, and the boundaries that it must have at its ends.
END, SIZE = f"cast(shiftright(e, {END_AT}) & {(1 << 31) - 1} AS int)", f"cast(shiftright(e, {LENGTH_AT}) & 31 AS int)"
BEGIN, RANK = f"({END} - {SIZE})", f"shiftright(e, {RANK_AT})"
#: The place of an edge's piece in ``PieceTable.ranked``, or from ``STRANGE`` on a code point.
PLACE = f"cast({RANK} + (e & 31) AS int)"
ENDS = f"(shiftleft(1L, {SIZE}) + 1)"


def merged() -> Column:
    """The edges that stay as BPE's symbols of a word.

    All places are boundaries at first. The fold takes the edges in rank order, of equal ones the first
    to end and then the shortest; an edge of two symbols (its ends and one place between are boundaries) joins them. The boundaries ``m``
    are the bits of a number, or for long words of numbers of 32 bits each with one more after them,
    of which a step changes two. Edges whose ends alone are boundaries stay.
    """
    many = f"filter(edges, e -> {SIZE} > 1)"
    place, number = f"({BEGIN} & 31)", f"shiftright({BEGIN}, 5)"
    inner = f"(shiftleft(2L, {SIZE}) - 1)"
    short = f"(shiftright(m, {BEGIN}) & {inner})"
    long = f"(shiftright(m[{number}] + shiftleft(m[{number} + 1], 32), {place}) & {inner})"
    two = lambda seen: f"({seen} & {ENDS}) = {ENDS} AND bit_count({seen}) = 3"
    stay = lambda fold, seen: f"transform(array({fold}), m -> filter(edges, e -> {seen} = {ENDS}))[0]"
    bits = f"aggregate({many}, shiftleft(1L, n + 1) - 1, (m, e) -> IF({two(short)}, m - shiftleft({short} - {ENDS}, {BEGIN}), m))"
    gone = f"shiftleft({long} - {ENDS}, {place})"
    new = f"array(m[{number}] - ({gone} & {(1 << 32) - 1}L), m[{number} + 1] - shiftright({gone}, 32))"
    changed = f"concat(slice(m, 1, {number}), {new}, slice(m, {number} + 3, size(m)))"
    full = "transform(sequence(0, shiftright(n, 5) + 1), q -> shiftleft(1L, greatest(0, least(32, n + 1 - 32 * q))) - 1)"
    arrays = f"aggregate({many}, {full}, (m, e) -> IF({two(long)}, {changed}, m))"
    return F.expr(f"IF(n <= {SHORT}, {stay(bits, short)}, {stay(arrays, long)})")


def viterbi(table: PieceTable) -> Column:
    """The edges on the path with the highest sum of scores; a tie goes to the longest last piece.

    The fold takes the edges by their ends; it keeps for each end done the best sum and the last edge,
    and for the end at hand the best so far. A second fold walks back.
    """
    scores = ",".join(repr(s) for _, _, s in table.ranked)
    score = f"coalesce(get(cast(split('{scores}', ',') AS array<double>), {PLACE}), {table.ranked[-1][2] - 10.0}D)"
    entry = "named_struct('s', a.s, 'e', a.e)"
    done = f"size(a.best) >= {END}"
    arrival = f"coalesce(get(a.best, {BEGIN}).s, a.s) + {score}"
    kept = f"IF({done}, a.best, concat(a.best, array({entry})))"
    step = f"IF({done} AND {arrival} <= a.s, a, named_struct('best', {kept}, 's', {arrival}, 'e', e))"
    by_end = f"transform(sort_array(transform(edges, e -> named_struct('end', {END}, 'begin', {BEGIN}, 'e', e))), x -> x.e)"
    start = "named_struct('best', array(named_struct('s', 0D, 'e', 0L)), 's', double('-infinity'), 'e', 0L)"
    best = f"aggregate({by_end}, {start}, (a, e) -> {step}, a -> concat(a.best, array({entry})))"
    back = f"IF(a.at = j, transform(array(best[j].e), e -> named_struct('at', {BEGIN}, 'path', concat(array(e), a.path)))[0], a)"
    walk = f"aggregate(sequence(n, 1, -1), named_struct('at', n, 'path', array_repeat(0L, 0)), (a, j) -> {back}, a -> a.path)"
    return F.expr(f"transform(array({best}), best -> {walk})[0]")


def codes_of(table: PieceTable) -> Column:
    """The ids of the edges in column path, by their begins."""
    placed = f"sort_array(transform(path, e -> shiftleft(cast({BEGIN} AS bigint), 32) + {PLACE}))"
    own = f"cast(split('{','.join(str(i) for _, i, _ in table.ranked)}', ',') AS array<int>)"
    rank = f"cast(x & {(1 << 32) - 1} AS int)"
    if table.bytes_from is None:
        strange = f"array({table.unknown})"
    else:
        last = lambda c: f"128 + ({c} & 63)"
        utf8 = (
            "CASE WHEN c < 128 THEN array(c)"
            f" WHEN c < 2048 THEN array(192 + shiftright(c, 6), {last('c')})"
            f" WHEN c < 65536 THEN array(224 + shiftright(c, 12), {last('shiftright(c, 6)')}, {last('c')})"
            f" ELSE array(240 + shiftright(c, 18), {last('shiftright(c, 12)')}, {last('shiftright(c, 6)')}, {last('c')}) END"
        )
        strange = f"transform(transform(array({rank} - {STRANGE}), c -> {utf8})[0], b -> b + {table.bytes_from})"
    ids = f"IF(exists(p, x -> {rank} >= {STRANGE}), flatten(transform(p, x -> IF({rank} < {STRANGE}, array(get({own}, {rank})), {strange}))), transform(p, x -> get({own}, {rank})))"
    return F.expr(f"transform(array({placed}), p -> {ids})[0]")


def fold_words(words: DataFrame, table: PieceTable) -> DataFrame:
    """The ids of words (key, word), not empty and with a key each: rows (key, code).

    ``kind`` of the table chooses the fold: "unigram" takes the Viterbi path; "bpe" applies merges
    in score order, since a BPE model's scores are ranks of merges and no sum of them gives its
    segmentation.
    """
    path = viterbi(table) if table.kind == "unigram" else merged()
    return lattice(words, table).select("key", path.alias("path")).select("key", codes_of(table).alias("code"))


UNIT = regex.compile(f"{BLANK}+[^{BLANK}]*")
#: What parts the words of a unit without blanks while it is cut.
CUT = "\0"


def units_of(text: str) -> list[str]:
    """A text cut before blanks; each unit without the one blank that the model writes before it."""
    return [u[1:] for u in UNIT.findall((BLANK + text).replace(" ", BLANK))] if text else []


def unit_words(units: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of units, one after the other, and how many each unit has.

    Where letters and other signs meet and around line ends a mark is set, at which the unit is cut;
    units that hold more blanks or the mark itself are cut by ``WORD``.
    """
    odd = pc.or_(pc.match_substring(units, BLANK), pc.match_substring(units, CUT)).to_numpy(zero_copy_only=False)
    marked = pc.binary_join_element_wise(BLANK, units.filter(pa.array(~odd)), "")
    marked = pc.replace_substring_regex(marked, r"([\pL\pM])([^\pL\pM])", rf"\1{CUT}\2")
    marked = pc.replace_substring_regex(marked, rf"([^\pL\pM{BLANK}])([\pL\pM])", rf"\1{CUT}\2")
    lists = pc.split_pattern(pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}"), CUT)
    full = pc.not_equal(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
    others = [WORD.findall(BLANK + u) for u in units.filter(pa.array(odd)).to_pylist()]
    many = np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])])
    sizes = np.zeros(len(units), np.int64)
    sizes[~odd], sizes[odd] = many, [len(ws) for ws in others]
    words = [lists.flatten().filter(pa.array(full)), pa.array([w for ws in others for w in ws], pa.string())]
    if odd.any():  # back in the order of the units
        place = np.empty(int(sizes.sum()), np.int64)
        kind = np.repeat(odd, sizes)
        place[~kind], place[kind] = np.arange(many.sum()), many.sum() + np.arange(sizes[odd].sum())
        return pa.concat_arrays(words).take(pa.array(place)), sizes
    return words[0], sizes


@dataclass
class Block:
    """Texts as numbers of units, units as numbers of words; words and units are distinct."""

    rows: np.ndarray  # which row of the block each text is
    units: np.ndarray  # the unit numbers of all texts
    ends: np.ndarray  # where those of each text end
    parts: np.ndarray  # the word numbers of all distinct units
    part_ends: np.ndarray
    words: pa.Array


def _offsets(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, 4 * array.offset)


def read_block(texts: pa.Array) -> Block:
    """The units and words of texts. Texts of single blanks between their units are cut by Arrow alone."""
    none = pc.fill_null(pc.equal(pc.binary_length(texts), 0), True)
    odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | $|{BLANK}"), none)
    odd = pc.fill_null(odd, True)
    plain = texts.filter(pc.invert(odd))
    lists = pc.split_pattern(plain, " ")
    others = [units_of(t or "") for t in texts.filter(odd).to_pylist()]
    flat = pa.concat_arrays([lists.flatten(), pa.array([u for us in others for u in us], pa.string())])
    ends = np.concatenate([_offsets(lists)[1:] - _offsets(lists)[0], np.cumsum([len(us) for us in others], dtype=np.int64) + len(lists.flatten())]).astype(np.int64)
    coded = flat.dictionary_encode()
    found, odd = coded.dictionary, odd.to_numpy(zero_copy_only=False)
    letters = pc.utf8_is_alpha(found).to_numpy(zero_copy_only=False)
    whole = pc.binary_join_element_wise(BLANK, found.filter(pa.array(letters)), "")
    mixed, many = unit_words(found.filter(pa.array(~letters)))
    words = pa.concat_arrays([whole, mixed]).dictionary_encode()
    # Word numbers lie by unit, first those of units of letters, one each.
    sizes = np.ones(len(found), np.int64)
    sizes[~letters] = many
    part_ends = np.cumsum(sizes)
    parts = np.zeros(int(sizes.sum()), np.int32)
    numbers, one = words.indices.to_numpy(), np.repeat(letters, sizes)
    parts[one], parts[~one] = numbers[: len(whole)], numbers[len(whole) :]
    return Block(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), coded.indices.to_numpy(), ends, parts, part_ends, words.dictionary)


def _joined(values: pa.Array, take: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings put together: those of the numbers before each end, after the end before."""
    taken = values.take(pa.array(take))
    offsets = np.concatenate([[0], _offsets(taken)[ends] if len(taken) else np.zeros(len(ends), np.int32)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), taken.buffers()[2] or pa.py_buffer(b"")])


def encode_block(texts: pa.Array, codes: pa.Array, block: Block) -> pa.Array:
    """The codes of whole texts, in their rows' order, from the codes of the block's words."""
    units = _joined(codes, block.parts, block.part_ends)
    out = _joined(units, block.units, block.ends)
    return out.take(pa.array(np.argsort(block.rows)))


#: Blocks of a task and words of a block at most, for one number that names a word of a block.
PER_TASK, PER_BLOCK = 1 << 16, 1 << 24
BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("body", pa.binary())])


@tidy
def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks of about ``BLOCK`` bytes, the texts compressed."""
    from pyspark import TaskContext

    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    squeeze = zstandard.ZstdCompressor(level=3)

    def block() -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(0) for b in held])
        texts = [b.column(1) for b in held]
        sizes = np.concatenate([pc.fill_null(pc.binary_length(t), -1).to_numpy() for t in texts]).astype("<i8")
        body = b"".join(bytes(memoryview(t.buffers()[2])[_offsets(t)[0] : _offsets(t)[-1]]) if t.buffers()[2] else b"" for t in texts if len(t))
        one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([part * PER_TASK + number]), one, pa.array([sizes.tobytes()], pa.binary()), pa.array([squeeze.compress(body)], pa.binary())], schema=BLOCKS)

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, base + BLOCK - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if size >= BLOCK:
                yield block()
                number, held, size = number + 1, [], 0
    if held:
        yield block()


def _block_texts(sizes: bytes, body: bytes) -> pa.Array:
    """The texts of a block, null where the size is below 0."""
    n, raw = np.frombuffer(sizes, "<i8"), zstandard.ZstdDecompressor().decompress(body)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a text of over 2 GB")
    texts = pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))
    return pc.if_else(pa.array(n >= 0), texts, None) if (n < 0).any() else texts


@tidy
def _block_words(batches: Iterator[pa.RecordBatch], common: pa.Array) -> Iterator[pa.RecordBatch]:
    """The words of blocks that are not common, each with the number that names it, as text.

    A word of over ``SHORT`` characters is named by a hash and follows its number.
    """
    for batch in batches:
        for block, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "body"))):
            words = read_block(_block_texts(sizes, body)).words
            rare = words.filter(pc.invert(pc.is_in(words, common)))
            ref = pa.array(block * PER_BLOCK + np.arange(len(rare))).cast(pa.string())
            if (long := pc.greater(pc.utf8_length(rare), SHORT)).true_count:
                ref = pc.if_else(long, pc.binary_join_element_wise(ref, rare, " "), ref)
                keys = [hashlib.sha256(w.encode()).hexdigest() for w in rare.filter(long).to_pylist()]
                rare = pc.replace_with_mask(rare, long, pa.array(keys, pa.string()))
            for k in range(0, len(rare), 20_000):
                yield pa.RecordBatch.from_arrays([rare.slice(k, 20_000), ref.slice(k, 20_000)], names=["key", "ref"])


CODES = pa.schema([("block", pa.int64()), ("gaps", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])
ENCODED = pa.schema([("id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("text", pa.string())])
DECODED_SQL = "id long, n_tokens long, ids_crc32 long, text string"


@tidy
def _packed_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes (ref, code) that come by block, packed: a row for each run of a block in a batch."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        if not batch.num_rows:
            continue
        ref, code = batch.column("ref").to_numpy(), batch.column("code")
        size, flat = code.value_lengths().to_numpy(), code.flatten().to_numpy()
        ends, block = np.cumsum(size), ref // PER_BLOCK
        for k in np.split(np.arange(len(ref)), np.flatnonzero(np.diff(block)) + 1):
            a, b = k[0], k[-1] + 1
            raw = (np.diff(ref[a:b] % PER_BLOCK, prepend=0), size[a:b], flat[ends[a] - size[a] : ends[b - 1]])
            packed = [squeeze.compress(x.astype("<u4").tobytes()) for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block[a], *packed), CODES.types)], schema=CODES)


def _routed(coded: pa.Table, n: int) -> pa.Array:
    """The codes sent to a block, by the numbers of its words; a word without one is an error."""
    expand = zstandard.ZstdDecompressor().decompress
    rows = [[np.frombuffer(expand(x), "<u4") for x in row] for row in zip(*(coded[c].to_pylist() for c in ("gaps", "sizes", "codes")))]
    number = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(g.astype(np.int64)) for g, _, _ in rows)])
    if len(number) != n or not (np.bincount(number, minlength=n) == 1).all():
        raise ValueError("a block came back with other words than it was numbered by")
    offsets = np.concatenate([[0], 4 * np.cumsum(np.concatenate([np.zeros(0, np.int64), *(s.astype(np.int64) for _, s, _ in rows)]))])
    data = b"".join(c.tobytes() for _, _, c in rows)
    codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return codes.take(pa.array(np.argsort(number)))


def _encoded(texts: pa.Table, coded: pa.Table, common: pa.Table, pieces: pa.Array | None) -> pa.Table:
    """The ids of every text of a block, four bytes each, from the codes of its words; or, with the
    bytes of all pieces, what ``_decoded`` reads from them."""
    out = []
    for k in range(texts.num_rows):
        raw = _block_texts(texts["sizes"][k].as_py(), texts["body"][k].as_py())
        block = read_block(raw)
        place = pc.index_in(block.words, common["word"].combine_chunks())
        rare = pc.is_null(place).to_numpy(zero_copy_only=False)
        codes = pa.concat_arrays([common["code"].combine_chunks(), _routed(coded, int(rare.sum()))])
        number = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        number[rare] = common.num_rows + np.arange(rare.sum())
        ids = encode_block(raw, codes.take(pa.array(number)), block)
        out.append(pa.RecordBatch.from_arrays([texts["ids"].combine_chunks()[k].values, ids], schema=ENCODED))
    if pieces is not None:
        result = pa.Table.from_batches(list(_decoded(iter(out), pieces)), DECODED)
    else:
        result = pa.Table.from_batches(out, ENCODED)
    give_back()
    return result


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task's texts and how often they occur, by batch."""
    for batch in batches:
        block = read_block(batch.column(0))
        units = np.bincount(block.units, minlength=len(block.part_ends))
        sizes = np.diff(block.part_ends, prepend=0)
        n = np.bincount(block.parts, np.repeat(units, sizes), len(block.words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([block.words, pa.array(n)], names=["word", "n"])


def common_words(rows: DataFrame, table: PieceTable, most: int, sample: int) -> pa.Table:
    """The codes of the most frequent words of about ``sample`` rows: at most ``most`` of them."""
    total = rows.count()
    if not total or not most:
        return pa.table([pa.array([], pa.string()), pa.array([], pa.binary())], names=["word", "code"])
    part = rows.sample(min(1.0, sample / total), seed=1).select("text")
    counts = part.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = counts.where(F.length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(most).select(F.col("word").alias("key"), "word")
    found = fold_words(words, table).toArrow()
    size = found["code"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
    data = found["code"].combine_chunks().flatten().to_numpy().astype("<u4").tobytes()
    offsets = np.concatenate([[0], 4 * np.cumsum(size)]).astype(np.int32)
    codes = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.table([found["key"].combine_chunks().cast(pa.string()), codes], names=["word", "code"])


def encode_documents(docs: DataFrame, table: PieceTable, *, common: int = 1 << 17, sample: int = 20_000, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every text by the model: rows (id, ids), ids a binary of 32-bit little-endian numbers.

    With ``decode`` the tasks decode the ids of a block at once and return what ``decode_documents``
    returns for them: a round trip of which no ids leave the task.

    Tasks gather their rows to blocks, which move once, compressed; from there the distinct words of
    each block go through the lattice, each word of all blocks once, and its code returns to the blocks
    that hold it, packed. No task holds more than a block of about ``BLOCK`` bytes or one text. The
    ``common`` words that are most frequent in about ``sample`` rows skip that way back and forth:
    their codes, from the same lattice, are sent to all tasks (a few MB at most, whatever the input).
    The sample decides on the way of a word alone, never on its code. A word without a code is an
    error, never a gap.

    Null and empty texts have no ids. Rows with equal or null ids are all kept. An empty table gives
    an empty result; other columns are ignored. A word may have any length. ``docs`` should read
    files: rows that come in another order when an executor is lost make other blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wide_groups(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    frequent = common_words(rows, table, common, sample)
    sent = spark.sparkContext.broadcast((frequent, pa.array(table.texts, pa.binary()) if decode else None))
    blocks = rows.mapInArrow(_block_rows, "block long, ids array<long>, sizes binary, body binary").repartition("block")
    pairs = blocks.mapInArrow(lambda x: _block_words(x, sent.value[0]["word"].combine_chunks()), "key string, ref string").where("key IS NOT NULL").repartition("key")
    # All that read the blocks or the words read all columns, so that each has one exchange.
    words = pairs.groupBy("key").agg(F.max("ref").alias("ref"))
    words = words.select("key", F.when(F.length("key") <= SHORT, F.col("key")).otherwise(F.expr("substring(ref, instr(ref, ' ') + 1)")).alias("word"))
    codes = pairs.join(fold_words(words, table).hint("merge"), "key")
    codes = codes.select(F.substring_index("ref", " ", 1).cast("bigint").alias("ref"), "code").sortWithinPartitions("ref").mapInArrow(_packed_codes, "block long, gaps binary, sizes binary, codes binary")
    both = blocks.groupBy("block").cogroup(codes.groupBy("block"))
    return both.applyInArrow(lambda a, b: _encoded(a, b, *sent.value), DECODED_SQL if decode else "id long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(ids: bytes, texts: list[bytes]) -> str:
    """The text of ids: the bytes of their pieces, without the model's blank before the text."""
    raw = b"".join([texts[i] for i in np.frombuffer(ids, "<u4").tolist()])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decoded_texts(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """The texts of many rows of ids; bytes that are no text become U+FFFD."""
    ends = (_offsets(ids)[1:] - _offsets(ids)[0]) // 4
    flat = np.frombuffer(ids.buffers()[2], "<u4", int(ends[-1]) if len(ends) else 0, int(_offsets(ids)[0])) if ids.buffers()[2] and len(ids) else np.zeros(0, "<u4")
    raw = _joined(texts, flat.astype(np.int64), ends)
    offsets, data = _offsets(raw), np.frombuffer(raw.buffers()[2], np.uint8)
    blank = np.zeros(len(raw), bool)
    full = np.flatnonzero(np.diff(offsets))
    blank[full] = data[offsets[full]] == 32
    offsets = (offsets - np.concatenate([[0], np.cumsum(blank)])).astype(np.int32)
    data = np.delete(data, _offsets(raw)[:-1][blank])
    raw = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


@tidy
def _decoded(batches: Iterator[pa.RecordBatch], texts: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.divide(pc.binary_length(ids), 4).cast(pa.int64()), pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64()), decoded_texts(ids, texts)],
            schema=DECODED,
        )


def decode_documents(encoded: DataFrame, table: PieceTable, *, id_col: str = "doc_id") -> DataFrame:
    """Texts from ids: rows (id, n_tokens, ids_crc32, text). The pieces are sent to all tasks: the
    model bounds them. Blank signs (U+2581) of a text come back as blanks, as in the library."""
    sent = encoded.sparkSession.sparkContext.broadcast(pa.array(table.texts, pa.binary()))
    out = encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(lambda x: _decoded(x, sent.value), DECODED_SQL)
    return out.withColumnRenamed("id", id_col)
