"""Tokens of two tokenizers side by side: common ends cut groups, overlapping tokens are linked."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandframe.llm.store import cut, tidy
from bandframe.llm.wavelet import byte_letters

#: Bytes of text that are encoded and aligned in one go.
LOT = 1 << 20
#: Units that are encoded in one go: the tokenizers library holds a kilobyte for each.
NEW = 1 << 12
#: A worker forgets its units when it knows so many, or so many characters of them.
UNITS, UNIT_CHARS = 1 << 19, 8 << 20
#: Bits of an id of the second tokenizer in the code of a pair.
B_BITS = 15
#: Pairs whose counts are sent to all tasks: the most frequent. The others' counts come by a join.
SENT = 1 << 18

#: What Unicode or Python calls white space, blank and newline left out.
OTHER_SPACE = "\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(r"[ \n]+[^ \n]*")
_ODD = re.compile(f"[{OTHER_SPACE}]")


def units_of(text: str) -> list[str]:
    """A text cut before each run of blanks and newlines that follows something else than white space.

    Neither tokenizer has a token over such a place, so units are encoded one by one.
    """
    found = _UNIT.findall(text)
    if not _ODD.search(text):
        return found
    whole: list[str] = []
    for unit in found:
        if whole and (_ODD.match(whole[-1][-1])):
            whole[-1] += unit
        else:
            whole.append(unit)
    return whole


class Coder:
    """Ids of units by both libraries, kept for units met before.

    ``a`` is a byte-level model of the tokenizers library, ``b`` a SentencePiece model that writes a
    blank before each text. Special tokens in texts are plain text.
    """

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if size_b > 1 << B_BITS or size_a > 1 << (31 - B_BITS):
            raise ValueError("too many ids for the code of a pair")
        bytes_of = {c: b for b, c in byte_letters().items()}
        shown = (self.a.id_to_token(i) for i in range(size_a))
        self.bytes_a = [bytes(bytes_of[c] for c in t) if t and all(c in bytes_of for c in t) else (t or "").encode() for t in shown]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(size_b)]
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        crossing = re.compile(f"[^▁{OTHER_SPACE}][▁ \n]")
        self.by_unit = not any(crossing.search(self.b.id_to_piece(i)) for i in range(size_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.right = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of texts that begin with a blank, and how many each text has."""
        if len(self.known) > UNITS or self.held > UNIT_CHARS:
            self.forget()
        known, flat, counts, new = self.known, [], [], []
        for text in texts:
            units = units_of(text) if self.by_unit else [text] if text else []
            for unit in units:
                if (code := known.get(unit)) is None:
                    code = known[unit] = len(known)
                    new.append(unit)
                flat.append(code)
            counts.append(len(units))
        for k in range(0, len(new), NEW):
            self._learn(new[k : k + NEW])
        return np.array(flat, np.int64), np.array(counts, np.int64)

    def _learn(self, units: list[str]) -> None:
        """Encode new units; one is right if both tokenizers' bytes are its own."""
        self.held += sum(map(len, units))
        broken = [u[0] == "\n" for u in units]  # the blank that ``b`` adds is a token of its own before a newline
        coded = [[e.ids for e in self.a.encode_batch(units, add_special_tokens=False)], self.b.encode([u if n else u[1:] for u, n in zip(units, broken)], num_threads=1)]
        coded[1] = [x[1:] if n else x if u != " " else [self.b.piece_to_id("▁")] for x, n, u in zip(coded[1], broken, units)]
        own = [u.encode() for u in units]
        right = [b"".join([self.bytes_a[i] for i in x]) == o == b"".join([self.bytes_b[i] for i in y]) for x, y, o in zip(*coded, own)]
        self.right = np.concatenate([self.right, right])
        for k, lists in enumerate(coded):
            self.ids[k] = np.concatenate([self.ids[k], np.fromiter((i for x in lists for i in x), np.int64)])
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum([len(x) for x in lists])])

    def tokens(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after the other, and how many each unit has."""
        sizes = np.diff(self.starts[k])[codes]
        return self.ids[k][runs(self.starts[k][codes], sizes)], sizes


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of several ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each number of the shorter rising list how many of the longer one are less.

    Each search starts at a guess, doubles its step until the place is enclosed, and halves from there;
    all searches go in step. The last numbers of both lists are equal.
    """
    low, high = guess.copy(), guess.copy()  # long[low - 1] < x <= long[high]
    step, ahead = 1, np.flatnonzero(long[guess] < short)
    behind = np.flatnonzero(long[guess] >= short)
    while len(ahead):
        low[ahead] = high[ahead] + 1
        high[ahead] = np.minimum(high[ahead] + step, len(long) - 1)
        ahead, step = ahead[long[high[ahead]] < short[ahead]], 2 * step
    step = 1
    behind = behind[(low[behind] > 0)]
    behind = behind[long[low[behind] - 1] >= short[behind]]
    while len(behind):
        high[behind] = low[behind] - 1
        low[behind] = np.maximum(low[behind] - step, 0)
        behind = behind[low[behind] > 0]
        behind, step = behind[long[low[behind] - 1] >= short[behind]], 2 * step
    while len(wide := np.flatnonzero(low < high)):
        middle = (low[wide] + high[wide]) // 2
        less = long[middle] < short[wide]
        low[wide[less]] = middle[less] + 1
        high[wide[~less]] = middle[~less]
    return low


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches that end before ``ends``."""
    total = np.concatenate([[0], np.cumsum(values)])[ends]
    return np.diff(total, prepend=0)


def digits(n: int) -> np.ndarray:
    """The decimal digits of the numbers below ``n``, a row of bytes each, zeros behind them."""
    text = np.array([str(i).encode() for i in range(n)])
    return text.view(np.uint8).reshape(n, -1)


class Aligned:
    """Token lists of several documents whose bytes agree: ids, counts by document, groups and links."""

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray], sizes: list[np.ndarray]):
        self.ids, self.counts = ids, counts
        self.ends = [np.cumsum(table[x]) for table, x in zip(sizes, ids)]
        short = 0 if len(ids[0]) <= len(ids[1]) else 1
        a, b = self.ends[short], self.ends[1 - short]
        first, own = (np.cumsum(c) - c for c in (counts[1 - short], counts[short]))
        within = np.arange(len(a)) - np.repeat(own, counts[short])
        guess = np.repeat(first, counts[short]) + within * np.repeat(counts[1 - short], counts[short]) // np.repeat(np.maximum(counts[short], 1), counts[short])
        rank = gallop(a, b, np.minimum(guess, len(b) - 1))
        common = b[rank] == a
        self.cuts = [common, np.zeros(len(b), bool)]
        self.cuts[1][rank[common]] = True
        # A token overlaps those from where the one before it ended to where it ends itself.
        begin = np.concatenate([[0], rank[:-1] + common[:-1]])
        n = rank - begin + 1
        self.links = [np.repeat(np.arange(len(a)), n), runs(begin, n)]
        self.n_links = sums(n, np.cumsum(counts[short]))
        self.n_groups = sums(common, np.cumsum(counts[short]))
        if short:
            self.cuts.reverse()
            self.links.reverse()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, code and number of occurrences of each linked pair of ids of each document."""
        doc = np.repeat(np.arange(len(self.counts[0])), self.counts[0])[self.links[0]]
        code = (self.ids[0][self.links[0]] << B_BITS) | self.ids[1][self.links[1]]
        keys, times = np.unique((doc << 31) | code, return_counts=True)
        return keys >> 31, keys & ((1 << 31) - 1), times

    def texts(self, tables: list[np.ndarray]) -> list[bytes]:
        """The groups of each document: ``a1,a2|b1;a3|b2,b3`` in decimal ids."""
        group = [np.cumsum(c) - c for c in self.cuts]
        begin_b = np.concatenate([[0], np.flatnonzero(self.cuts[1]) + 1])
        end_a = np.flatnonzero(self.cuts[0]) + 1
        places = [np.arange(len(group[0])) + begin_b[group[0]], np.arange(len(group[1])) + end_a[group[1]]]
        width = max(t.shape[1] for t in tables)
        out = np.zeros((len(places[0]) + len(places[1]), width + 1), np.uint8)
        for place, ids, table, cut_, mark in zip(places, self.ids, tables, self.cuts, b"|;"):
            out[place, : table.shape[1]] = table[ids]
            out[place, width] = np.where(cut_, mark, ord(","))
        ends = np.cumsum(self.counts[0] + self.counts[1])
        out[ends - 1, width] = 0  # nothing behind a document's last group
        full = out != 0
        bytes_, stops = out[full].tobytes(), np.cumsum(sums(full.sum(axis=1), ends))
        return [bytes_[i:j] for i, j in zip([0, *stops[:-1].tolist()], stops.tolist())]


_coders: dict[tuple[str, str], tuple[Coder, list[np.ndarray]]] = {}
_LIST = pa.list_(pa.int32())
OUT = pa.schema(
    [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string())] + [(c, _LIST) for c in ("pairs", "times", "seen", "in_docs")]
)


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values sorted by document as a list for each."""
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _lot(texts: list[str | None], coder: Coder, tables: list[np.ndarray]) -> list[pa.Array]:
    n = len(texts)
    codes, counts = coder.codes([" " + t if t else "" for t in texts])
    right = (sums(~coder.right[codes], np.cumsum(counts)) == 0) & (counts > 0)
    codes = codes[np.repeat(right, counts)]
    ends = np.cumsum(counts[right])
    numbers = np.zeros((4, n), np.int64)
    groups: list[str] = [""] * n
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids, sizes = zip(*(coder.tokens(codes, k) for k in (0, 1)))
    tokens = [sums(s, ends) for s in sizes]
    for leads in (tokens[0] <= tokens[1], tokens[0] > tokens[1]):  # the shorter list leads in each document
        if not leads.any():
            continue
        docs = np.flatnonzero(right)[leads]
        own = [i[np.repeat(leads, t)] for i, t in zip(ids, tokens)]
        lists = Aligned(own, [t[leads] for t in tokens], coder.sizes)
        numbers[:, docs] = (tokens[0][leads], tokens[1][leads], lists.n_groups, lists.n_links)
        for doc, text in zip(docs.tolist(), lists.texts(tables)):
            groups[doc] = text.decode()
        doc, code, times = lists.pairs()
        parts.append((docs[doc], code, times))
    doc, code, times = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
    order = np.argsort(doc, kind="stable")
    doc, code, times = doc[order], code[order], times[order]
    seen, in_docs = np.unique(code, return_counts=True)
    once = lambda x: pa.array([x.astype(np.int32)] + [None] * (n - 1), _LIST)
    return [*map(pa.array, numbers), pa.array(groups, pa.string()), _lists(doc, code, n), _lists(doc, times, n), once(seen), once(in_docs)]


@tidy
def _align(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    if (a, b) not in _coders:
        coder = Coder(a, b)
        _coders[a, b] = coder, [digits(len(t)) for t in (coder.bytes_a, coder.bytes_b)]
    coder, tables = _coders[a, b]
    for batch in batches:
        begin, size, texts = 0, 0, []
        for i, value in enumerate(batch.column(1)):
            texts.append(value.as_py())
            size += len(texts[-1] or "")
            if size >= LOT or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), *_lot(texts, coder, tables)], names=["id", *OUT.names])
                begin, size, texts = i + 1, 0, []


def align_tokens(docs: DataFrame, *, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts by two tokenizers, aligned: id, n_a, n_b, n_groups, n_links, groups, pairs, times, seen, in_docs.

    ``a`` is a file of the tokenizers library (byte-level), which gets a blank before each text; ``b`` is
    a SentencePiece model, which adds one itself. Byte offsets where tokens of both end cut them into
    groups, told as ``groups`` (``a1,a2|b1;a3|b2,b3`` in decimal ids). Tokens whose byte ranges overlap
    are linked: ``pairs`` are the codes (a << 15 | b) of a document's linked pairs of ids, ``times`` how
    often each is linked. ``seen`` and ``in_docs``, null in most rows, sum up many documents at once:
    codes, and how many of these documents hold each.

    The shorter list of a document's token ends leads a galloping search into the longer; the ranks that
    it finds give the common ends and, from one token to the next, the range that a token overlaps.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens:
    zeros, an empty ``groups`` and no pairs. Every row gives a row, whatever its id; repeated rows count
    as documents of their own. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, " + ", ".join(f"{c} array<int>" for c in OUT.names[5:])
    return rows.mapInArrow(lambda x: _align(x, a, b), ddl).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of each pair of ids in how many documents it is linked: pair, n, and whether ``n`` is the highest of its first id."""
    seen = aligned.where("seen IS NOT NULL").select(F.inline(F.arrays_zip("seen", "in_docs")))
    counts = cut(seen.groupBy(F.col("seen").alias("pair")).agg(F.sum("in_docs").alias("n")), "pairs")
    a = F.shiftright("pair", B_BITS).alias("a")
    best = counts.groupBy(a).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary, 65,536 at most
    return counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _known(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, n: np.ndarray, best: np.ndarray, rest: bool) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs whose counts were sent; or, for ``rest``, a row for each other pair."""
    for batch in batches:
        lists = batch.column(1)
        code, times = (c.flatten().to_numpy().astype(np.int64) for c in batch.columns[1:3])
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
        hit = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
        if rest:
            row = np.repeat(batch.column(0).to_numpy(), np.diff(ends, prepend=0))[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(code[~hit].astype(np.int32)), pa.array(times[~hit])], names=["row", "pair", "times"])
        else:
            at = at[hit]
            weight = np.zeros((2, len(code)), np.int64)
            weight[:, hit] = times[hit] * best[at], times[hit] * n[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sums(w, ends)) for w in weight)], names=["row", "n_best", "count_sum"])


def link_statistics(aligned: DataFrame, *, sent: int = SENT) -> DataFrame:
    """Rows of ``align_tokens`` without the lists, with n_best and count_sum from counts over all rows.

    ``n_best`` is the number of links whose pair of ids has the highest count of its first id, ties
    included; ``count_sum`` the sum of the counts over the links. The ``sent`` most frequent pairs are
    broadcast (13 bytes each); links of other pairs become rows, join their counts and are summed by
    document, so a pair in a third of all documents is never a key of a join.
    """
    spark = aligned.sparkSession
    rows = cut(aligned.withColumn("row", F.monotonically_increasing_id()), "links")
    counts = cut(pair_counts(rows), "counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(sent).toArrow().sort_by("pair")  # ``sent`` rows at most
    table = spark.sparkContext.broadcast(tuple(top[c].to_numpy().astype(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool))))
    lists = rows.select("row", "pairs", "times")
    most = lists.mapInArrow(lambda x: _known(x, *table.value, False), "row long, n_best long, count_sum long")
    others = lists.mapInArrow(lambda x: _known(x, *table.value, True), "row long, pair int, times long").join(counts, "pair")
    others = others.select("row", (F.col("times") * F.col("best").cast("int")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    totals = most.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times", "seen", "in_docs").join(totals, "row").drop("row")
