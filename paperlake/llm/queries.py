"""The queries of this subpackage, each a thin use of one operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    plan = mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighed
  WINDOW b AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(most::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
planned AS (
  SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 8))::BIGINT / 4294967296.0
                                     < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM rated)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies * size AS taken, copies FROM planned
"""


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled page outcomes: the number in a page's path is the id of the document it shows, which labels may judge."""
    item = F.regexp_extract("url", r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1).try_cast("long")
    pages = _table(spark, sf_dir, "pages").select("url", item.alias("doc_id")).where("doc_id IS NOT NULL")
    marks = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return pages.join(marks, "doc_id").select("url", "good")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    judged = judge_urls(_table(spark, sf_dir, "pages"), page_labels(spark, sf_dir))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH rows AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{1,18})', 1) AS BIGINT) AS item FROM pages),
known AS (
  SELECT host, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM rows JOIN labels ON doc_id = item WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY host),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
         coalesce(n, 0) AS n, coalesce(good, 0) AS good FROM (SELECT DISTINCT host FROM rows) LEFT JOIN known USING (host)),
base AS (SELECT (sum(good) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE AS m FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS m FROM hosts, base GROUP BY suffix),
sk AS (SELECT sum(CASE WHEN n > 1 THEN pow(good - n * m, 2) / n - m * (1 - m) END) AS more, sum(CASE WHEN n > 1 THEN (n - 1) * m * (1 - m) END) AS full_ FROM s0),
s1 AS (SELECT suffix, (good + k * m) / (n + k) AS sm FROM s0, (SELECT CASE WHEN coalesce(full_, 0) = 0 THEN 10.0 ELSE 1 / least(greatest(more / full_, 1.0 / 1001), 0.5) - 1 END AS k FROM sk)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(sm) AS m FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix),
dk AS (SELECT sum(CASE WHEN n > 1 THEN pow(good - n * m, 2) / n - m * (1 - m) END) AS more, sum(CASE WHEN n > 1 THEN (n - 1) * m * (1 - m) END) AS full_ FROM d0),
d1 AS (SELECT domain, (good + k * m) / (n + k) AS dm FROM d0, (SELECT CASE WHEN coalesce(full_, 0) = 0 THEN 10.0 ELSE 1 / least(greatest(more / full_, 1.0 / 1001), 0.5) - 1 END AS k FROM dk)),
h0 AS (SELECT host, n, good, dm AS m FROM hosts JOIN d1 USING (domain)),
hk AS (SELECT sum(CASE WHEN n > 1 THEN pow(good - n * m, 2) / n - m * (1 - m) END) AS more, sum(CASE WHEN n > 1 THEN (n - 1) * m * (1 - m) END) AS full_ FROM h0),
h1 AS (SELECT host, good + k * m AS a, n + k - (good + k * m) AS b FROM h0, (SELECT CASE WHEN coalesce(full_, 0) = 0 THEN 10.0 ELSE 1 / least(greatest(more / full_, 1.0 / 1001), 0.5) - 1 END AS k FROM hk)),
h2 AS (SELECT host, least(1.0, a / (a + b) + 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1)))) AS upper FROM h1)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM rows) r
LEFT JOIN h2 ON r.host = h2.host
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM members x JOIN members y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS to_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.to_id),
lows AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lows USING (doc_id)
"""

def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"), "crc32(cast(doc_id AS string)) % 5 <> 0")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op9_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_tokens import digest

    return digest(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import top_inner

    return top_inner(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5
"""


def op7_nearest_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import nearest_cosine

    return nearest_cosine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


#: crc32 of a text's bytes in SQL: the usual table from its polynomial, then one step a byte.
CRC_SQL = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS i))"""
OP11_SQL = f"""
WITH {CRC_SQL},
own AS MATERIALIZED (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns, any_value(conv_id)::VARCHAR AS name
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(name) + 1), lambda i: ascii(name[i]))::BIGINT[]),
                                  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc_table),
seqs AS MATERIALIZED (
  SELECT x.conv_id, list_concat(coalesce(y.turns[:x.h], []), x.turns[x.h + 1:]) AS seq
  FROM hashed x LEFT JOIN own y ON y.conv_id = x.conv_id - x.conv_id % 100),
members AS (SELECT conv_id, len(seq) AS n, d, seq[:d] AS p FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT d, p, p[:d - 1] AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[d].text) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY d, p),
children AS (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, p)),
subtrees AS (
  SELECT a AS d, p[:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM full_nodes x JOIN subtrees s ON s.d = x.d AND s.p = x.p LEFT JOIN nodes u ON u.d = x.d - 1 AND u.p = x.up
"""


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH {CRC_SQL},
texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark),
words AS MATERIALIZED (
  SELECT r, doc_id, own, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
hashed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
                            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w, hex(encode(w)) AS x FROM words), crc_table),
counted AS MATERIALIZED (SELECT r, own, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY ALL),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t FROM counted GROUP BY bucket)),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE own),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import digest

    return digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_secret_scan": op6_secret_scan,
    "op7_nearest_cosine": op7_nearest_cosine,
    "op8_language_model": op8_language_model,
    "op9_piece_tokens": op9_piece_tokens,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance_resample": op12_importance_resample,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op2_url_filter": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op5_exact_top_k": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op12_importance_resample": OP12_SQL}
