"""Licence notices in texts, with a few errors: exact seeds find places, bounded-error matching judges them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandframe.llm.store import tidy

#: Label and words of each notice (fixed values: names and opening words of public licences).
#: Notices that differ little from others are here so that they win their own places.
NOTICES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
    ("mit", "permission is hereby granted free of charge to any person"),
    ("apache-1", "apache license version 1"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("bsd", "under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("isc", "under the isc license"),
    ("mpl", "under the mpl license"),
    ("mpl", "mozilla public license"),
    ("gpl", "under the gpl license"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("unlicense", "free and unencumbered software released into the public domain"),
)
#: The notices whose exact places are the base of ``labels`` (the first of ``NOTICES``).
BASE = (0, 1, 2)
#: One byte a code point: a-z and 0-9 stay, A-Z become small, other ASCII is a blank, all else one letter.
_PLAIN = bytes(
    b if chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 if b < 128 else 128 for b in range(256)
)
_TAILS = bytes(range(128, 192))


def allowed_errors(words: str) -> int:
    """Edits that a notice may have: one for 8 characters, and one more for every 16."""
    return (len(words) + 8) // 16


def plain(text: str | None) -> tuple[bytes, int]:
    """A text's words between single blanks, one also before and behind them, and their number.

    Every letter beyond ASCII becomes the same byte: no notice has one, so distances stay as they are.
    """
    words = (text or "").encode().translate(_PLAIN, _TAILS).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" ", len(words)


@dataclass(frozen=True)
class Searcher:
    """Notices ready to be searched for."""

    notices: tuple[tuple[str, str], ...]

    @cached_property
    def seeds(self) -> dict[bytes, list[tuple[int, int]]]:
        """Pieces of the notices, each with (notice, offset).

        A notice with k errors at most is cut into k + 1 pieces: one of them is untouched.
        """
        found: dict[bytes, list[tuple[int, int]]] = {}
        for i, (_, words) in enumerate(self.notices):
            n = allowed_errors(words) + 1
            cuts = [len(words) * j // n for j in range(n + 1)]
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(words[a:b].encode(), []).append((i, a))
        return found

    @cached_property
    def patterns(self) -> list[regex.Pattern]:
        return [regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(w.encode(), literal_spaces=True), allowed_errors(w))) for _, w in self.notices]

    def runs(self, text: bytes) -> dict[tuple[int, int], dict[int, int]]:
        """Runs of whole words within reach of a notice: (begin, end) to the errors of each notice."""
        found: dict[tuple[int, int], dict[int, int]] = {}
        tried = set()
        for seed, owners in self.seeds.items():
            at = text.find(seed)
            while at >= 0:
                for i, offset in owners:
                    size, k = len(self.notices[i][1]), allowed_errors(self.notices[i][1])
                    for a in range(max(1, at - offset - k), at - offset + k + 1):
                        if text[a - 1] != 32:
                            continue
                        for b in range(a + max(1, size - k), min(len(text) - 1, a + size + k) + 1):
                            if text[b] != 32 or (a, b, i) in tried:
                                continue
                            tried.add((a, b, i))
                            if m := self.patterns[i].fullmatch(text, a, b):
                                found.setdefault((a, b), {})[i] = sum(m.fuzzy_counts)
                at = text.find(seed, at + 1)
        return found

    def spans(self, text: bytes) -> list[tuple[str, int, int, int, int]]:
        """What is found: (label, notice, first word, words, errors), in the order of the text.

        A run belongs to the notice with the fewest errors, and to none if two labels are as near.
        Of runs of one label that overlap, the nearest stays.
        """
        best: dict[str, list[tuple[int, int, int, int]]] = {}
        for (a, b), errors in self.runs(text).items():
            least = min(errors.values())
            nearest = [i for i in sorted(errors) if errors[i] == least]
            if len({self.notices[i][0] for i in nearest}) == 1:
                best.setdefault(self.notices[nearest[0]][0], []).append((least, a, b, nearest[0]))
        if not best:
            return []
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        out = []
        for label, places in best.items():
            taken: list[tuple[int, int, int, int]] = []  # by place
            for place in sorted(places):  # fewest errors first
                k = bisect_left(taken, place[1], key=lambda t: t[1])
                if (k == len(taken) or taken[k][1] >= place[2]) and (k == 0 or taken[k - 1][2] <= place[1]):
                    taken.insert(k, place)
            for errors, a, b, i in taken:
                first, last = np.searchsorted(blanks, (a, b)).tolist()
                out.append((label, i, first - 1, last - first + 1, errors))
        return sorted(out, key=lambda s: (s[2], s[3], s[0]))


SPAN = pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32())])
SPAN_DDL = "array<struct<label string, notice int, first_word long, n_words long, errors int>>"


@tidy
def _scan(batches: Iterator[pa.RecordBatch], notices: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    searcher = Searcher(notices)
    for batch in batches:
        sizes, spans = [], []
        for value in batch.column(1):
            text, n = plain(value.as_py())
            sizes.append(n)
            spans.append([dict(zip(("label", "notice", "first_word", "n_words", "errors"), s)) for s in searcher.spans(text)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(SPAN))], names=["id", "n_words", "spans"])


def scan_notices(docs: DataFrame, *, notices: Sequence[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Notices in whole texts, with a bounded number of edits: id, n_words, spans.

    Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lower-cased. A run of whole words, joined by
    blanks, is a place of a notice if the Levenshtein distance to it is at most ``allowed_errors``; it
    goes to the notice with the fewest errors, and to none if two labels are as near. A span has label,
    notice (its number in ``notices``), first_word (from 0), n_words and errors; of overlapping runs of
    one label only the nearest is told.

    A notice with k errors at most is cut into k + 1 pieces; one of them occurs untouched at every place,
    within k characters of where it belongs (pigeonhole). Only there do patterns of the regex library
    with bounded errors look, at the few runs that begin and end where the notice may.

    Null and empty texts have no word and no span. Every row gives a row, whatever its id; repeated rows
    are repeated. An empty table gives an empty result; other columns are ignored. Notices are made of
    a-z, 0-9 and single blanks, and of 8 characters or more.
    """
    notices = tuple((label, words) for label, words in notices)
    if bad := [w for _, w in notices if not regex.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", w) or len(w) < 8]:
        raise ValueError(f"not words of a notice: {bad[:3]}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda x: _scan(x, notices), f"id {kind}, n_words long, spans {SPAN_DDL}").withColumnRenamed("id", id_col)


def license_labels(scanned: DataFrame, *, notices: Sequence[tuple[str, str]] = NOTICES, base: Sequence[int] = BASE) -> DataFrame:
    """Digest of ``scan_notices``: exact places of the base notices, all labels, and a score.

    ``score`` is the greatest share of a notice that is untouched: 1 for an exact place, 0 without any.
    """
    exact = F.filter("spans", lambda s: (s["errors"] == 0) & s["notice"].isin(*base))
    sizes = F.array(*(F.lit(float(len(w))) for _, w in notices))
    near = F.transform("spans", lambda s: 1 - s["errors"] / F.get(sizes, s["notice"]))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    rows = scanned.withColumn("_exact", exact).withColumn("_at", F.transform("_exact", lambda s: s["first_word"]))
    return rows.select(
        *(c for c in scanned.columns if c != "spans"), F.size("_exact").cast("bigint").alias("n_base"), F.array_min("_at").alias("first_word"), F.array_max("_at").alias("last_word"),
        names(F.col("_exact")).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(near), F.lit(0.0)).alias("score"),
    )
