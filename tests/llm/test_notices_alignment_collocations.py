"""Notices, aligned tokenizers and collocations against brute force, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandframe.llm import alignment, collocations, notices
from bandframe.llm.queries import op11_license_notices, op12_token_alignment, op13_collocations, tokenizer_path
from bandframe.llm.store import cut
from tests.llm.test_llm import EDGES, SF, docs, edges  # noqa: F401

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_runs(text, known):
    """(first word, words) of runs to the errors of each notice within reach."""
    words = WORDS.findall((text or "").translate(SMALL))
    found = {}
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 20) + 1):
            run = " ".join(words[i:j])
            for number, (_, notice) in enumerate(known):
                k = notices.allowed_errors(notice)
                if abs(len(run) - len(notice)) <= k and (d := distance(run, notice)) <= k:
                    found.setdefault((i, j - i), {})[number] = d
    return len(words), found


def runs_of(text, known):
    searcher = notices.Searcher(known)
    plain, n = notices.plain(text)
    ends = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    at = lambda a, b: (int(np.searchsorted(ends, a)) - 1, int(np.searchsorted(ends, b) - np.searchsorted(ends, a)) + 1)
    return n, {at(a, b): e for (a, b), e in searcher.runs(plain).items()}


# 11


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.sampled_from([w for _, w in notices.NOTICES[:12]]), st.lists(st.tuples(st.integers(0, 70), st.sampled_from("idx"), st.sampled_from("abmit 2é.-")), max_size=3)), max_size=3))
def test_runs_within_reach_are_all_found(parts):
    words = []
    for notice, edits in parts:
        for at, kind, c in edits:
            at %= len(notice) + 1
            notice = notice[:at] + ("" if kind == "d" else c) + notice[at + (kind != "i") :]
        words += [notice, "and"]
    text = " ".join(words)
    assert runs_of(text, notices.NOTICES) == brute_runs(text, notices.NOTICES)


def test_nearest_notice_wins():
    labels = lambda text: {s[0] for s in notices.Searcher(notices.NOTICES).spans(notices.plain(text)[0])}
    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("CC BY-ND") == {"cc-by-nd"} and labels("CC BY-NX") == set()  # as near to nc as to nd
    assert labels("under teh mit licens") == set() and labels("under the mlt license") == {"mit"}
    assert labels("Apache License, Version 3") == set() and labels("Apache Licence, Version 2.0") == {"apache-2"}


def test_spans_of_one_label_do_not_overlap():
    spans = notices.Searcher(notices.NOTICES).spans(notices.plain("x cc by nc cc by nc s cc by nc under the mit license")[0])
    assert [(s[0], s[2], s[3], s[4]) for s in spans] == [("cc-by-nc", 1, 3, 0), ("cc-by-nc", 4, 3, 0), ("cc-by-nc", 8, 3, 0), ("mit", 11, 4, 0)]


def test_notices_of_odd_rows(spark, edges):  # noqa: F811
    more = spark.createDataFrame([(50, "CC-BY-NC, " * 3000 + "under the mit license", "en", "a")], "doc_id long, text string, lang string, source string")
    rows = op11(edges.unionByName(more, allowMissingColumns=True))
    got = Counter(map(tuple, rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()))
    want = Counter()
    for i, text, *_ in EDGES:
        n = len(WORDS.findall((text or "").translate(SMALL)))
        want[i, n, 0, None, None, "", "", 0.0] += 1
    want[50, 9004, 3001, 0, 9000, "cc-by-nc,mit", "cc-by-nc,mit", 1.0] += 1
    assert got == want
    assert op11(edges.limit(0)).count() == 0
    with pytest.raises(ValueError, match="not words of a notice"):
        notices.scan_notices(edges, notices=[("x", "CC-BY")])


def op11(frame):
    return notices.license_labels(notices.scan_notices(frame))


def test_notices_of_documents(spark, docs):  # noqa: F811
    rows = op11_license_notices(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts) and any(r["n_base"] for r in rows)
    for r in rows:
        joined = " " + " ".join(WORDS.findall((texts[r["doc_id"]] or "").translate(SMALL))) + " "
        base = {notices.NOTICES[i][0]: len(re.findall(f"(?= {notices.NOTICES[i][1]} )", joined)) for i in notices.BASE}
        assert r["n_base"] == sum(base.values()) and r["base_labels"] == ",".join(sorted(k for k, n in base.items() if n))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


# 12


def aligner():
    return alignment.Coder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def brute_alignment(coder, text):
    """Counts, groups and links of a text by the libraries and nested loops."""
    nothing = (0, 0, 0, 0, "", Counter())
    if not text:
        return nothing
    ids = coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)
    parts = [[table[i] for i in x] for table, x in zip((coder.bytes_a, coder.bytes_b), ids)]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return nothing
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    groups, low = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(i) for i, e in zip(x, own) if low < e <= end) for x, own in zip(ids, ends)))
        low = end
    links = Counter((a << 15) | b for a, i, j in zip(ids[0], [0, *ends[0]], ends[0]) for b, k, m in zip(ids[1], [0, *ends[1]], ends[1]) if k < j and i < m)
    return len(ids[0]), len(ids[1]), len(groups), sum(links.values()), ";".join(groups), links


ODD = ["", None, " ", "  ", "\n", "a  b ", "x\t y", "a▁b", "<|endoftext|> <s></s> <0x41>", "é  b 　c", "日本語 テ\n\n\n  z", "\U0001f600!!  \n\t\r\n foo", "it's\x1c x\x1c\x1f y", "a\x00b"]


def test_alignment_against_the_libraries():
    coder, rng = aligner(), random.Random(3)
    assert coder.by_unit
    letters = "ab  \n\t.'1é ▁\x1c日 <>|s"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(400)] + [e[1] for e in EDGES if len(e[1] or "") < 1000]
    tables = [alignment.digits(len(t)) for t in (coder.bytes_a, coder.bytes_b)]
    for whole in (True, False):  # by units, and as for a model whose pieces reach over blanks
        coder.by_unit = whole
        coder.forget()
        columns = [c.to_pylist() for c in alignment._lot(texts, coder, tables)]
        for i in range(len(columns[0])):
            got = (*(c[i] for c in columns[:5]), Counter(dict(zip(columns[5][i], columns[6][i]))))
            assert got == brute_alignment(coder, texts[i]), repr(texts[i])


@given(st.sets(st.integers(0, 300), max_size=60), st.sets(st.integers(0, 300), max_size=60), st.integers(0, 1000))
def test_gallop(a, b, seed):
    a, b = np.array(sorted({*a, 301})), np.array(sorted({*b, 301}))
    guess = np.random.default_rng(seed).integers(0, len(b), len(a))
    assert alignment.gallop(a, b, guess).tolist() == np.searchsorted(b, a).tolist()


@pytest.mark.parametrize("sent", [0, 40, 1 << 18])
def test_link_statistics(spark, edges, docs, sent):  # noqa: F811
    frame = edges.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) < 5000).unionByName(docs.where("length(text) < 1500").select("doc_id", "text"))
    coder = aligner()
    rows = [(r["doc_id"], brute_alignment(coder, r["text"])) for r in frame.collect()]
    counts = Counter(k for _, r in rows for k in r[5])
    most = defaultdict(int)
    for k, n in counts.items():
        most[k >> 15] = max(most[k >> 15], n)
    want = Counter((i, *r[:5], sum(m for k, m in r[5].items() if counts[k] == most[k >> 15]), sum(m * counts[k] for k, m in r[5].items())) for i, r in rows)
    aligned = alignment.align_tokens(frame, a=tokenizer_path("byte_bpe_50k.json"), b=tokenizer_path("piece_bpe_32k.model"))
    got = alignment.link_statistics(aligned, sent=sent)
    assert Counter(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect())) == want
    assert alignment.link_statistics(aligned.limit(0), sent=sent).count() == 0


def test_alignment_query(spark):
    rows = op12_token_alignment(spark, SF).collect()
    assert len(rows) == 200 and all(len(r["groups_sha256"]) == 64 * (r["n_a"] > 0) for r in rows) and any(r["n_a"] for r in rows)


# 13


def brute_collocations(rows, least, top=2000, within=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(SMALL)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    best = defaultdict(list)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        score, k = min((10**6 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words)))
        inside = [b for q, b in candidates.items() if len(q) > len(p) and q[0] == lang and words in (q[1:3], q[2:4])] if len(words) == 2 else []
        if not any(100 * b >= within * a for b in inside):
            best[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return {(lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, found in best.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize(("every", "max_bits"), [(1, 1 << 20), (3, 1 << 15), (10_000, 1 << 20)])
def test_collocations(spark, docs, every, max_bits):  # noqa: F811
    """Whatever the sample proposes (everything, a part, nothing) and however full the filter is."""
    frame = docs.select("doc_id", "text", "lang").where("length(text) < 4000")
    frame = frame.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    want = brute_collocations([(r["lang"], r["text"]) for r in frame.collect()], 6)
    got = collocations.collocations(frame, least=6, every=every, max_bits=max_bits)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want and want


def test_failures_of_the_border_are_expanded(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(collocations, "members", lambda *x, own=collocations.members: passes.append(1) or own(*x))
    frame = spark.createDataFrame([(i, "alpha beta gamma, delta", "en") for i in range(12)], "doc_id long, text string, lang string")
    got = {(r["phrase"], r["n"]) for r in collocations.phrase_counts(frame, least=10, every=1 << 40).collect()}
    assert got == {("", 48), ("alpha", 12), ("beta", 12), ("gamma", 12), ("delta", 12), ("alpha beta", 12), ("beta gamma", 12), ("alpha beta gamma", 12)}
    assert len(passes) == 2  # nothing is proposed, so words fail and all that they make possible is counted
    passes.clear()
    assert {(r["phrase"], r["n"]) for r in collocations.phrase_counts(frame, least=10, every=1).collect()} == got
    assert len(passes) == 1  # nothing fails


def test_collocations_of_odd_rows(spark, edges):  # noqa: F811
    rows = [(e[2], e[1]) for e in EDGES]
    got = collocations.collocations(edges, least=2, every=2)
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, 2)
    assert collocations.collocations(edges.limit(0)).count() == 0


def test_long_texts_are_cut_where_pieces_end(spark, monkeypatch):
    text = ("one two three, four five! " * 400).encode().translate(collocations._PLAIN)
    monkeypatch.setattr(collocations, "LOT", 100)
    parts = list(collocations._cut_long(text))
    assert b"\n".join(parts) == text and max(map(len, parts)) <= 100
    assert list(collocations._cut_long(b"x" * 300)) == [b"x" * 300]


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a long, l long, r long")
    assert row.select(collocations._scores(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * 3**2 // (4 * 5)


def test_phrases_of_four_words(spark):
    frame = spark.createDataFrame([(i, "a b c d e", "en") for i in range(4)], "doc_id long, text string, lang string")
    got = {r["phrase"]: r["n"] for r in collocations.phrase_counts(frame, least=2, most=4).collect()}
    assert got["a b c d"] == 4 and got["b c d e"] == 4 and len(got) == 1 + 5 + 4 + 3 + 2
    best = collocations.collocations(frame, least=2, most=4).collect()
    assert [(r["phrase"], r["score"]) for r in best] == [("a b c d", 10**6), ("b c d e", 10**6)]


def test_collocation_query(spark):
    assert cut(op13_collocations(spark, SF), "collocations").columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
