"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, ctph, length_buckets, near_vectors, ngram_lm, repeats, shingle_join, toxicity, warc
from .common import fold, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC records, reads the archives back, and tells what each record holds."""
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    back = warc.read_warc(spark, path)
    response = F.col("warc_type") == "response"
    return back.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_headers")["content-length"].cast("bigint")).alias("payload_bytes"),
        F.when(response, warc.sha1_base32(F.col("payload"))).otherwise(F.replace(F.col("headers")["warc-payload-digest"], F.lit("sha1:"), F.lit(""))).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        warc.page_of(F.col("headers")["warc-refers-to"]).alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(x, CAST((k // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links near-duplicate embeddings of a label and names their components."""
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, and one whose texts are made of control strings; reads turns and loss text back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    laid = chat.format_chats(turns.unionByName(extra))
    back = laid.select(
        "conv_id", "n_blocks", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.char_length("formatted").alias("chars")
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").cast("bigint").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS joined,
    replace(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'), '<part/>', '<\part/>') AS safe,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'), '<part/>', '<\part/>'), ':', '\:') AS safe_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN joined THEN 7 ELSE length(safe_role) + 14 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups all documents by links of word-shingle likeness 4/5 or more."""
    return shingle_join.near_duplicate_groups(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every text and its edited text, and compares them with each other and with the next document."""
    return ctph.compare_edited(_table(spark, sf_dir, "documents")).drop("next_id")


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text by a trigram model learnt from the ids that are not held out."""
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text by a public vocabulary, and decodes the ids again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decode(F.col("token_ids"), byte_bpe.load_ranks(path)), 256).alias("decoded_sha256"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into batches of a token budget within length buckets of least padding."""
    return length_buckets.pack(_table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """A model fitted on the labels of ids whose crc32 modulo 5 is not 0."""
    labels = _table(spark, sf_dir, "labels").where(F.coalesce(fold("doc_id") != 0, F.lit(False))).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text; labels of held-out ids are never read."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.add_score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every byte of a 200-byte string that starts anywhere else too."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, s: total + s["to"] - s["from"])
    return out.select(
        "doc_id",
        (F.octet_length("kept") + lost).alias("n_bytes"),
        lost.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_warc": op1_warc,
    "op2_near_vectors": op2_near_vectors,
    "op3_chat_format": op3_chat_format,
    "op4_shingle_join": op4_shingle_join,
    "op5_fingerprints": op5_fingerprints,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_repeats": op10_repeats,
}

ORACLE_SQL = {
    "op1_warc": OP1_SQL,
    "op2_near_vectors": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op4_shingle_join": OP4_SQL,
}
