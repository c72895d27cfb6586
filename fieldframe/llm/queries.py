"""The corpus operators as registered queries: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, fingerprints, minhash_dedup, packing, quality, sampling, secret_scan, sharding, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at four-word shingles and similarity 0.8."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.near_duplicates(docs, 4, 80)


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all documents, whether they spell the text, and a digest of the text decoded from them again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    read = sampling.decoded(sampling.encoded(docs))
    return read.withColumn("decoded_sha256", F.sha2("text", 256)).drop("text")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted; digests are read back from the output."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.formatted(given.unionByName(extra)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal weight."""
    return sharding.sharded(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that share template windows, judged by their slots."""
    return decontaminate.matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), sentence_names=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op9_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprinted(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, with a lexicon from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the four leading components of their distinct vectors, each with unit variance."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language from one another, and the terms that tell each from its language."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_texts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("loss_tokens")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_minhash_dedup,
            op2_sentencepiece_sampling,
            op3_chat_formatting,
            op4_rendezvous_sharding,
            op5_quality_classifier,
            op6_template_decontamination,
            op7_secret_scan,
            op8_warc,
            op9_minhash_fingerprints,
            op10_toxicity_grammar,
            op11_embedding_whitening,
            op12_source_divergence,
            op13_vector_packing,
        )
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express at a bearable cost; the others are tested against brute force."""
    return {"op3_chat_formatting": OP3, "op7_secret_scan": OP7, "op8_warc": OP8, "op12_source_divergence": OP12}


# formatted_chars follows from the template: its marks, and a character for every escaped one
OP3 = r"""
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(text, '(\\|<(/?s>|<SYS>>|</SYS>>|\|turn\|>|\|text\|>|\|end\|>)|\[(/?INST\]))', '\1#', 'g')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19 ELSE 24 + length(role) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""

# positions come from splitting at the matches: the text between them and they themselves add up
_SPANS = r"""
  SELECT doc_id, {order} AS o, '{kind}' AS kind, s AS "start", s + length(m) AS "end", regexp_extract(m, '{pattern}', {group}) AS g FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(found) + 1), lambda i: found[i])) AS m,
           unnest(list_transform(range(1, len(found) + 1), lambda i: CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS gaps FROM t)
  )
"""
_RULES = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 1),
    ("hex", r"[0-9a-f]{24,}", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
)
OP7 = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ("
    + " UNION ALL ".join(f"SELECT * FROM ({_SPANS.format(order=i, kind=k, pattern=p, group=g)}) WHERE length(g) >= {n}" for i, (k, p, g, n) in enumerate(_RULES))
    + """), joined AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", o) FILTER (o < 3) AS base,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", o) AS spans
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined USING (doc_id)
"""
)

# base32 of a SHA-1: 160 bits, 32 groups of five
OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS h FROM p),
f AS (SELECT h, max(page_id) AS response FROM d GROUP BY h),
bits AS (SELECT page_id, h, list_reduce(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, CAST(i AS INT), 1)) - 1) + 1, 4)), lambda a, b: a || b) AS b FROM d),
b32 AS (SELECT page_id, list_reduce(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(b, CAST(5 * g + j + 1 AS INT), 1) = '1' THEN 16 >> CAST(j AS INT) ELSE 0 END)) AS INT), 1)), lambda a, b: a || b) AS payload_digest FROM bits)
SELECT d.page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN d.page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = response THEN NULL ELSE response END AS refers_to
FROM d JOIN f USING (h) JOIN b32 ON b32.page_id = d.page_id
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce("source", '') AS "source", coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, "source", unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
occurs AS (SELECT lang, "source", term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM w) GROUP BY ALL HAVING count(*) >= 3),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, "source" FROM d),
cells AS (SELECT g.lang, g."source", k.term, coalesce(o.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN occurs o ON o.lang = g.lang AND o."source" = g."source" AND o.term = k.term),
p AS (SELECT lang, "source", term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(sum(n) OVER (PARTITION BY lang, "source") + v AS HUGEINT) AS p FROM cells JOIN size USING (lang)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(sum(n) OVER (PARTITION BY lang) + v AS HUGEINT) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) JOIN size USING (lang)),
pairs AS (SELECT a.lang, a."source", b."source" AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a."source" <> b."source" GROUP BY ALL),
every AS (
  SELECT a.lang, a."source", 'pair' AS part, b."source" AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a."source" <> b."source" LEFT JOIN pairs ON pairs.lang = a.lang AND pairs."source" = a."source" AND pairs.item = b."source"
  UNION ALL SELECT lang, "source", 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, "source", part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, "source", part ORDER BY value DESC, encode(item)) AS rank FROM every)
WHERE part = 'pair' OR rank <= 200
"""
