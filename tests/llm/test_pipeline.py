"""The pipeline's stages on the smallest documents."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from bandframe.llm import neardup
from bandframe.llm.queries import tokenizer_path
from bandframe.llm.store import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    line = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    near = [(9004, f"{line} first", "en", "x", 1), (9005, f"{line} second", "en", "x", 1)]
    odd = spark.createDataFrame([*near, (9001, None, None, None, None), (9002, "12 34", "en", "x", 5), (9003, "", "en", "x", 0)], docs.schema)
    out = [cut(docs.unionByName(odd), "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_effects(stages):
    start, language, lines, dedup, mix, last = stages
    for df in (language, lines, dedup, mix):
        assert df.columns == start.columns
    assert {r[0] for r in start.select("doc_id").collect()} - {r[0] for r in language.select("doc_id").collect()} == {9001, 9002, 9003}
    assert lines.count() == language.count() and lines.where(F.length("text") != F.col("n_chars")).count() == 0
    assert neardup.near_duplicates(dedup).where("NOT kept").count() == 0
    assert {9004} == {r[0] for r in dedup.where("doc_id IN (9004, 9005)").select("doc_id").collect()}
    assert last.count() == mix.count() == mix.select("doc_id").distinct().count()


def test_last_stage_is_the_library_s(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in stages[-2].collect()}
    assert all(r["n_tokens"] == len(np.array(sp.encode(texts[r["doc_id"]]))) for r in stages[-1].collect())


def test_odd_rows(spark):
    """Nulls in every column, rows and ids repeated, a very long text, ties, and columns of the stages' own names."""
    text = lambda k: " ".join(f"word{chr(97 + (i * k) % 26)}{chr(97 + i % 23)}" for i in range(60))
    rows = [(1, text(1), "en", "a"), (1, text(1), "en", "a"), (2, text(1), "en", "a"), (3, text(3), "en", None), (3, text(5), None, "b"), (None, text(7), "de", "b"), (None, text(7), "de", "b"),
            (4, None, None, None), (5, "", "en", "a"), (6, "1 2\n\n3", "en", "a"), (7, " ".join([text(9)] * 900), "de", "b"), (8, "a tie\na tie\na line to tie on", "de", ""), (9, "a line to tie on", "en", "")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("lang_pred", "score", "lost", "mark", "id", "node", "word", "key", "size", "block", "pieces", "carried0", "number")
    docs = cut(docs.withColumns({c: F.lit(f"own {c}") for c in clash}), "odd")
    names = docs.columns
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == names and docs.where(" OR ".join(f"{c} <> 'own {c}' OR {c} IS NULL" for c in clash)).isEmpty()
        ids.append(sorted((r[0] for r in docs.select("doc_id").collect()), key=str))
    assert ids[0] == sorted([1, 1, 2, 3, 3, None, None, 7, 8, 9], key=str) == ids[1]
    assert ids[2] == ids[1]  # line dedup left nothing of the words of 2, 8 lost a line
    assert set(ids[3]) <= set(ids[2])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("n_tokens = 0").count() == docs.where("text = ''").count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.count() == 0
