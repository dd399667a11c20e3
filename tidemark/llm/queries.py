"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, langid, nearest, periodic_runs, pii, quality, sentencepiece_codec, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from .common import read


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS p FROM d WHERE length(x) >= 400)),
r AS (SELECT doc_id, p FROM h SEMI JOIN (SELECT m FROM h GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 200 THEN 0 ELSE 1 END AS starts FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
e AS (SELECT doc_id, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next FROM s),
k AS (SELECT doc_id, min(lo) AS first, sum(hi - lo) AS n, count(*) AS spans, string_agg(substr(x, 2 * hi + 1, 2 * (coalesce(next, length(x) // 2) - hi)), '' ORDER BY lo) AS rest FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE substr(x, 1, 2 * first) || rest END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH t AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[^\x20\x09-\x0D]+') AS w FROM t WHERE text IS NOT NULL),
b AS (SELECT id AS item_id, w, least(13, len(w)) AS n FROM w WHERE side = 1 AND len(w) >= 5),
bw AS (SELECT item_id, n, w[i:i + n - 1] AS a FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
vocabulary AS (SELECT DISTINCT unnest(w) AS word FROM b),
known AS (SELECT id, p, word, v.word IS NOT NULL AS k FROM (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w WHERE side = 0) LEFT JOIN vocabulary v USING (word)),
runs AS (SELECT k.id, k.p, s.n, sum(CAST(k.k AS INT)) OVER (PARTITION BY k.id, s.n ORDER BY k.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS upto FROM known k, (SELECT DISTINCT n FROM bw) s),
dw AS (SELECT r.id AS doc_id, r.n, r.p - r.n AS pos, w.w[r.p - r.n + 1:r.p] AS a FROM runs r JOIN w ON w.side = 0 AND w.id = r.id WHERE r.p >= r.n AND r.upto >= ceil(0.8 * r.n)),
m AS (SELECT doc_id, item_id, pos, n FROM (SELECT DISTINCT d.doc_id, b.item_id, d.pos, d.n, len(list_filter(range(1, d.n + 1), lambda i: d.a[i] = b.a[i])) AS same
  FROM dw d JOIN bw b ON d.n = b.n) WHERE same >= ceil(0.8 * n))
SELECT doc_id, item_id, CAST(count(DISTINCT pos) AS BIGINT) AS n_windows, CAST(min(pos) AS INT) AS first_token, CAST(max(pos + n - 1) AS INT) AS last_token FROM m GROUP BY doc_id, item_id
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("virtual_slot")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = substring_dedup.dedup(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE lo < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the packed ids and of the decoded text."""
    tokens = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sentencepiece_codec.encode(read(spark, sf_dir, "documents"), model_path()))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(read(spark, sf_dir, "conversations"), damage=True)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[of(kind) for kind in pii.BASE], F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(read(spark, sf_dir, "documents"), damage=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_quality": op3_quality,
        "op4_decontamination": op4_decontamination,
        "op5_sharding": op5_sharding,
        "op6_simhash": op6_simhash,
        "op7_language_id": op7_language_id,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_nearest": op10_nearest,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_pii": op12_pii,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op4_decontamination": OP4_SQL, "op8_substring_dedup": OP8_SQL}
