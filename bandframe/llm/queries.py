"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandframe.llm import alignment, chat, collocations, images, langid, linededup, mixing, neardup, notices, pieces, quality, sharding, wavelet
from bandframe.llm.store import documents, scratch


#: Folder of public vocabulary files; by default that of the installed package.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as wavelet matrices and read back."""
    path = scratch(spark, "tokens")
    wavelet.write_tokens(documents(spark, sf_dir, "doc_id", "text"), path, tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=2)
    return wavelet.token_documents(wavelet.open_tokens(spark, path))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), percent=75)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 runs of a Hilbert curve over language, source and size."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return sharding.hilbert_shards(docs, n_shards=16).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    model = langid.fit(documents(spark, sf_dir, "doc_id", "text", "lang"))
    found = langid.identify(documents(spark, sf_dir, "doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that a document with a smaller id holds."""
    kept = linededup.dedup_lines(documents(spark, sf_dir, "doc_id", "text"), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def encoded_digest(docs: DataFrame) -> DataFrame:
    """Per document of ``docs`` what its encoding and the decoding of that are."""
    table = pieces.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    decoded = pieces.encode_documents(docs, table, decode=True)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a lattice of pieces, and decoded."""
    return encoded_digest(documents(spark, sf_dir, "doc_id", "text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, rendered and read back."""
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_conversations(chat.format_conversations(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of all documents and the verdict of rules learned from ``labels``."""
    return quality.judge(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among pictures drawn from all embeddings, every fourth with an edited copy."""
    return images.image_copies(images.pictures(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return mixing.taken_words(*mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0, block=128, n_shards=16))


def op11_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents, exact and with a few errors."""
    return notices.license_labels(notices.scan_notices(documents(spark, sf_dir, "doc_id", "text")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by two tokenizers: groups, links, and how common the linked pairs are."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    aligned = alignment.align_tokens(docs, a=tokenizer_path("byte_bpe_50k.json"), b=tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment.link_statistics(aligned.withColumn("groups", digest)).withColumnRenamed("groups", "groups_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.collocations(documents(spark, sf_dir, "doc_id", "text", "lang"), least=10, most=3, top=2000, within=50)


QUERIES = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_image_copies": op9_image_copies,
    "op10_source_mix": op10_source_mix,
    "op11_license_notices": op11_license_notices,
    "op12_token_alignment": op12_token_alignment,
    "op13_collocations": op13_collocations,
}

LINE_DEDUP_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM cut
), keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT keyed.doc_id, i, line, first_doc IS NOT NULL AND keyed.doc_id <> first_doc AS lost
  FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5
           THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM w
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
"""

#: Control strings as in ``chat.CONTROLS``; a mark is doubled, and one mark more breaks each string.
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>')) AS n,
         length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>')) AS r
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE r + 21 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

NOTICES_SQL = rf"""
WITH ws AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), notice AS (
  SELECT *, (length(words) + 8) // 16 AS k FROM (VALUES {", ".join(f"({i}, '{label}', '{words}')" for i, (label, words) in enumerate(notices.NOTICES))}) AS v(number, label, words)
), sized AS (SELECT *, unnest(range(length(words) - k, length(words) + k + 1)) AS size FROM notice
), start AS (SELECT row, ws, unnest(range(len(ws))) AS i FROM ws
), run AS (
  SELECT row, i, j, regexp_replace(array_to_string(ws[i + 1:i + j], ' '), '[^\x00-\x7F]', '?', 'g') AS run
  FROM start CROSS JOIN (SELECT unnest(range(1, 16)) AS j) WHERE i + j <= len(ws)
), near AS (
  SELECT row, i, j, number, label, words, levenshtein(run, words) AS errors FROM run JOIN sized ON length(run) = size WHERE levenshtein(run, words) <= k
), nearest AS (SELECT *, min(errors) OVER (PARTITION BY row, i, j) AS least FROM near
), won AS (
  SELECT row, i, j, min(label) AS label, max(CASE WHEN number < 3 AND errors = 0 THEN label END) AS base, max(1 - errors / CAST(length(words) AS DOUBLE)) AS score
  FROM nearest WHERE errors = least GROUP BY ALL HAVING min(label) = max(label)
), told AS (
  SELECT row, count(base) AS n_base, min(i) FILTER (WHERE base IS NOT NULL) AS first_word, max(i) FILTER (WHERE base IS NOT NULL) AS last_word,
         string_agg(DISTINCT base, ',' ORDER BY base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM won GROUP BY row
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM ws LEFT JOIN told USING (row)
"""

COLLOCATIONS_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), word AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM piece
), start AS (SELECT lang, ws, unnest(range(len(ws))) AS i FROM word
), f AS (
  SELECT lang, k, array_to_string(ws[i + 1:i + k], ' ') AS phrase, count(*) AS f
  FROM start CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE i + k <= len(ws) GROUP BY ALL
), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
), cut AS (
  SELECT lang, phrase, ws, f AS a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail
  FROM cand CROSS JOIN (SELECT unnest([1, 2]) AS j) WHERE j < k
), scored AS (
  SELECT cut.*, h.f AS l, t.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = cut.head JOIN f t ON t.lang = cut.lang AND t.phrase = cut.tail
), least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored
), kept AS (
  SELECT * FROM least s WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM cand c WHERE c.k = 3 AND len(s.ws) = 2 AND c.lang = s.lang AND (c.ws[1:2] = s.ws OR c.ws[2:3] = s.ws) AND 100 * c.f >= 50 * s.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op11_license_notices": NOTICES_SQL, "op13_collocations": COLLOCATIONS_SQL, "op7_chat_format": CHAT_SQL, "op2_near_duplicates": NEAR_DUPLICATES_SQL, "op5_line_dedup": LINE_DEDUP_SQL}
