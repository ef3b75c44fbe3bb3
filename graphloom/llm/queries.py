"""The registered queries of this subpackage: thin digests of what the operators return, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html, itq, langid, lexical, lm, mixing, pieces, pq, recipes, simhash, urls
from .common import table


def _remainder(of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(_remainder(3) != 1))
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs, net, ["doc_id"]).select("doc_id", held_out, "lang_pred", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), _remainder(7) != 2, held_out=_remainder(7) == 2)
    return scored.withColumnRenamed("id", "doc_id")


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts
), means AS (
  SELECT source, greatest(1, ceil(rate / 500))::INT AS pieces, rate / greatest(1, ceil(rate / 500)) AS mean FROM rates
), cdf AS (
  SELECT source, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM means, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 20)::BIGINT + 1)) AS t(k)
), cdfs AS (
  SELECT source, list(c) AS cs FROM cdf GROUP BY source
), u AS (
  SELECT d.doc_id, d.source, p,
         ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '') || '|' || p), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d
  JOIN means m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(1, m.pieces + 1)) AS t(p)
), drawn AS (
  SELECT u.doc_id, u.source, sum(len(list_filter(cs, lambda c: c <= u.u)))::INT AS n_copies
  FROM u JOIN cdfs ON u.source IS NOT DISTINCT FROM cdfs.source GROUP BY ALL
)
SELECT d.*, k::INT AS copy_number, n_copies, md5('17/order|' || coalesce(d.doc_id::VARCHAR, '') || '|' || k) AS mix_key
FROM documents d JOIN drawn ON d.doc_id IS NOT DISTINCT FROM drawn.doc_id AND d.source IS NOT DISTINCT FROM drawn.source,
     unnest(range(1, n_copies + 1)) AS t(k)
"""

#: The rules of the contract: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = urls.judged(table(spark, sf_dir, "pages"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH rules(rule_host, rule_path, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), met AS (
  SELECT r, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, v DESC) AS nth
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN met ON p.r = met.r AND nth = 1
"""


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=3, words64=1, most_bits=3)
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recipes.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.read_back(chat.formatted(turns.unionByName(more)))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 'q', row_number() OVER (), item_id, text FROM benchmark
), w AS (
  SELECT kind, r, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM t
), s AS (
  SELECT count(*) AS big_n, sum(len(ts))::BIGINT AS big_l FROM w WHERE kind = 'd' AND len(ts) > 0
), tf AS (
  SELECT kind, r, id, n, term, count(*) AS tf FROM (SELECT kind, r, id, len(ts) AS n, unnest(ts) AS term FROM w) GROUP BY ALL
), d AS (
  SELECT r, id, n, term, tf, count(*) OVER (PARTITION BY term) AS df FROM tf WHERE kind = 'd'
), i AS (
  SELECT r, id, term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l)))) AS impact
  FROM d, s
), scored AS (
  SELECT q.r AS q, q.id AS item_id, i.r, i.id AS doc_id, sum(q.tf * i.impact)::BIGINT AS score
  FROM tf q JOIN i USING (term) WHERE q.kind = 'q' GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.encoded(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """Assignment and means of each round, spelled out."""

    def assigned(n: int) -> str:
        return f"""a{n} AS (
  SELECT r, vec_id, p, arg_min(e, d2 * 64 + e) AS e, min(d2) AS d2 FROM (
    SELECT x.r, x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d2
    FROM x JOIN b{n} b ON x.p = b.p) GROUP BY r, vec_id, p
)"""

    rounds = ""
    for n in range(2):
        rounds += f"""{assigned(n)}, m{n} AS (
  SELECT p, e, list(f ORDER BY i) AS v FROM (
    SELECT x.p, a.e, i, floor(sum(x.v[i])::DOUBLE / count(*))::BIGINT AS f
    FROM x JOIN a{n} a ON x.r = a.r AND x.p = a.p, unnest(range(1, len(x.v) + 1)) AS t(i) GROUP BY x.p, a.e, i) GROUP BY p, e
), b{n + 1} AS (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e
), """
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS (
  SELECT r, vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM k, unnest(range(0, 16)) AS t(p)
), b0 AS (
  SELECT p, r - 1 AS e, v FROM x WHERE r <= 64
), {rounds}{assigned(2)}, s AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2
), c AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d2)::BIGINT AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM c JOIN k USING (r), s
"""


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_chat_format": op9_chat_format,
    "op10_html_extraction": op10_html_extraction,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLES = {"op4_mixing": OP4_SQL, "op5_url_filter": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op11_lexical_search": OP11_SQL, "op12_vector_codes": _op12_sql()}
