"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bandframe.llm.store import tidy

#: Symbols: no letter, ``OTHERS`` for letters outside the alphabet by code point, then the alphabet;
#: after it the break between two texts learned from, and the filler behind the end of a segment.
BLANK, OTHERS = 0, 32
FIRST = 1 + OTHERS
#: Symbols parsed in one go: a parse starts anew so often.
SEGMENT = 512
#: Segments that advance together.
LANES = 4096

_classes: dict[str, np.ndarray] = {}


def classes(alphabet: str) -> np.ndarray:
    """The symbol of each code point, cases alike."""
    if alphabet not in _classes:
        table = np.zeros(0x110000, np.uint8)
        number = {c: FIRST + i for i, c in enumerate(alphabet)}
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                table[point] = number.get(c.lower(), 1 + ord(c.lower()[0]) % OTHERS)
        _classes[alphabet] = table
    return _classes[alphabet]


def symbols(text: str, alphabet: str) -> np.ndarray:
    """A text as symbols, runs of what is no letter as one blank."""
    out = classes(alphabet)[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    return out[(out != BLANK) | (np.concatenate([[FIRST], out[:-1]]) != BLANK)]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Edges of the least automaton that accepts every substring of ``text``; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return edges


@dataclass(frozen=True)
class LanguageModel:
    """What was learned: the alphabet and per language the edges (from, symbol, to) and bits a phrase."""

    alphabet: str
    languages: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    bits: tuple[float, ...]

    def tables(self) -> list[np.ndarray]:
        """Per language the step table: for ``state * width + symbol`` the next state and the phrases
        that end, as ``next * width * 4 + phrases``. A step that the text learned from doesn't have
        ends the phrase and starts the next at the symbol."""
        width = len(self.alphabet) + FIRST + 2
        out = []
        for e in self.edges:
            states = int(e[:, [0, 2]].max(initial=0)) + 1
            to, phrases = np.zeros((states, width), np.int32), np.zeros((states, width), np.int32)
            root = e[e[:, 0] == 0]
            known = np.zeros(width, bool)
            known[root[:, 1]] = True
            to[:, root[:, 1]] = root[:, 2]
            phrases[1:] = 1
            phrases[:, ~known] += 1
            to[e[:, 0], e[:, 1]], phrases[e[:, 0], e[:, 1]] = e[:, 2], 0
            to[:, -1], phrases[:, -1] = np.arange(states), 0  # the filler
            out.append((to * width * 4 + phrases).ravel())
        return out


def learn(samples: dict[str, list[str]], max_letters: int = 60, max_chars: int = 32768) -> LanguageModel:
    """Fit a model on texts by language; of each language ``max_chars`` symbols at most, the last text cut.

    The alphabet is the ``max_letters`` most frequent letters of all languages; other letters share
    ``OTHERS`` symbols by their code points, so scripts beyond the alphabet can still be told apart.
    """
    count = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
    alphabet = "".join(sorted(sorted(count, key=lambda c: (-count[c], c))[:max_letters]))
    stop = len(alphabet) + FIRST
    languages, edges, bits = [], [], []
    for language in sorted(samples):
        text: list[int] = []
        for t in samples[language]:
            more = symbols(t, alphabet)[: max(0, max_chars - len(text) - 1)].tolist()
            if more:
                text += [*more, stop]
        if text:
            automaton = suffix_automaton(text)
            edges.append(np.array([(s, c, t) for s, e in enumerate(automaton) for c, t in e.items()], np.int32))
            languages.append(language)
            bits.append(math.log2(len(text) + 1))
    return LanguageModel(alphabet, tuple(languages), tuple(edges), tuple(bits))


def phrase_counts(parts: list[np.ndarray], tables: list[np.ndarray], width: int) -> np.ndarray:
    """Phrases of each text (rows) against each language (columns).

    Texts are cut into segments of ``SEGMENT`` symbols. A phrase is the longest run of symbols, one
    at least, that the text learned from holds; many segments take each step at the same time.
    """
    number = np.array([-(-len(p) // SEGMENT) for p in parts], np.int64)
    grid = np.full((int(number.sum()), SEGMENT), width - 1, np.int32)
    flat, at = grid.reshape(-1), 0
    for p, n in zip(parts, number.tolist()):
        flat[at : at + len(p)] = p
        at += n * SEGMENT
    found = np.zeros((len(grid), len(tables)), np.int64)
    for k in range(0, len(grid), LANES):
        steps = np.ascontiguousarray(grid[k : k + LANES].T)
        for i, table in enumerate(tables):
            state, ended = np.zeros(steps.shape[1], np.int32), np.zeros(steps.shape[1], np.int32)
            for step in steps:
                state += step
                state = table.take(state)
                ended += state & 3
                state >>= 2
            found[k : k + LANES, i] = ended + (state > 0)
    sums = np.concatenate([np.zeros((1, len(tables)), np.int64), np.cumsum(found, axis=0)])
    ends = np.cumsum(number)
    return sums[ends] - sums[ends - number]


@tidy
def _predicted(batches: Iterator[pa.RecordBatch], model: LanguageModel, at: int) -> Iterator[pa.RecordBatch]:
    tables, width, bits = model.tables(), len(model.alphabet) + FIRST + 2, np.array(model.bits)
    for batch in batches:
        texts, names, scores = batch.column(at), [], []
        for k in range(0, batch.num_rows, 512):
            parts = [symbols(t or "", model.alphabet) for t in texts.slice(k, 512).to_pylist()]
            cost = phrase_counts(parts, tables, width) * bits
            for p, c in zip(parts, cost):
                if not len(bits) or not (p != BLANK).any():
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(c.argmin())
                rest = np.delete(c, best)
                names.append(model.languages[best])
                scores.append(float(1 - c[best] / rest.min()) if len(rest) else 1.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, *, rows: int = 48, max_chars: int = 32768, passage: int = 4096, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from a bounded sample of the labelled documents that are not held out.

    Of each language about ``4 * rows`` documents are drawn by a hash of their id (in proportion to
    its count, so a frequent language is no burden), and the first ``rows`` of them in hash order come
    to the driver, of a longer text a passage of ``passage`` characters from a place drawn by the same
    hash; they are learned from until ``max_chars`` symbols are reached. So every language with a
    labelled letter is learned. Rows without id, text or language take no part. Rows with equal ids
    are drawn together, each with its own text; what is drawn doesn't depend on their order.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = dict(own.groupBy("lang").count().collect())  # a row per language
    if not counts:
        return LanguageModel("", (), (), ())
    lot = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 40))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int((1 << 40) * min(1.0, 4 * rows / n)))))
    drawn = own.withColumn("lot", lot).where(F.col("lot") < F.element_at(share, F.col("lang")))
    start = F.pmod(F.col("lot"), F.greatest(F.lit(1), F.length("text") - passage + 1)).cast("int") + 1
    drawn = drawn.select("lang", "lot", F.substring("text", start, F.lit(passage)).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("lot", "text"))
    samples: dict[str, list[str]] = {k: [] for k in counts}
    for row in drawn.withColumn("first", first).where(F.col("first") <= rows).orderBy("lang", "first").collect():
        samples[row["lang"]].append(row["text"])
    return learn(samples, max_chars=max_chars)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, in place of columns of these names.

    A text is read whole as symbols: letters of the alphabet with cases alike, other letters by code
    point, each run of anything else as one blank. For each language it is parsed greedily into the
    longest phrases found in the text learned from (Ziv and Merhav, 1993), and the language with the
    fewest phrases wins, each weighed by the bits that point to a place of that text. ``score`` is 1
    less the quotient of the best and the second cost. Equal costs go to the first language in order.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned. Ids, labels and sources are not looked at. No shuffle: one pass over the rows.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lambda x, at=docs.columns.index(text_col): _predicted(x, sent.value, at), fields)
