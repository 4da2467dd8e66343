"""The corpus pipeline: stages that each take documents and pass documents on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandframe.llm import langid, linededup, mixing, neardup, queries
from bandframe.llm.store import cut

#: SQL has no suffix automata, permutations or lattices; the stages are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the language found into ``lang``; documents of no language (no letter, no text) go.

    Null ids stay; rows alike are judged alike; a tie between languages goes to the first in order.
    Columns of any names pass unchanged.
    """
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = langid.identify(docs.withColumnsRenamed(own), langid.fit(docs)).where("lang_pred <> 'und'")
    found = found.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score")
    return found.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a document with a smaller id holds; ``n_chars`` counts what stays.

    All documents stay, those that lose every line with an empty text. Rows of one id are one document:
    none loses a line to the other. Rows with a null id lose no line. Null text becomes empty. Other
    columns pass unchanged.
    """
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = linededup.dedup_lines(docs, least=10, carry=more)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least id of each group of near duplicates.

    Documents without words have no group and stay, as do rows with a null id. Rows of one id stay or
    go together. Columns pass unchanged.
    """
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, twice where it takes them twice.

    Documents of which it takes nothing go, so do those without words. Null and repeated ids and rows
    alike each keep their own words; a null source is a source. Columns pass unchanged.
    """
    _, pieces = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0, block=128, n_shards=16)
    return mixing.mixed_documents(docs, pieces)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and checksum of each document, and the hash of the text decoded from them.

    Null and empty texts have no tokens; every row stays, whatever its id.
    """
    return queries.encoded_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and reread as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
