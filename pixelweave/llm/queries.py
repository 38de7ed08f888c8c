"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import (
    centroids,
    conversations,
    covertree,
    decontaminate,
    extract,
    linededup,
    minhash,
    mixing,
    quality,
    rules,
    surrogates,
    urltrees,
    warc,
)

QUERIES, ORACLES = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


@_query
def op3_quality_classifier(spark, sf_dir):
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


@_query
def op7_quality_rules(spark, sf_dir):
    return rules.judge(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 6).alias("host_rate"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


@_query
def op10_url_filter(spark, sf_dir):
    return urltrees.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


@_query
def op2_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10).drop("text_stamp")


@_query
def op5_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@_query
def op4_html_extraction(spark, sf_dir):
    return extract.extract(_read(spark, sf_dir, "pages"))


@_query
def op11_conversation_repair(spark, sf_dir):
    raw = _read(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(raw), raw)


@_query
def op12_embedding_near_dedup(spark, sf_dir):
    return covertree.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.95)


ORACLES["op12_embedding_near_dedup"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
         WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id)
"""


@_query
def op13_centroid_clustering(spark, sf_dir):
    return centroids.cluster(_read(spark, sf_dir, "embeddings")).drop("n_distances")


def _rounds(rounds: int) -> str:
    """The common table expressions of the rounds: p are the centroids (c, v) and a the choices of a round."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS (SELECT vec_id, q, unnest(best) FROM (
  SELECT vec_id, q, min({{'distance': list_sum(list_transform(list_zip(q, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'cluster': c}}) AS best
  FROM q, p{i} GROUP BY vec_id, q))""")
        if i < rounds:
            out.append(f"""m{i} AS (SELECT cluster, list(floor(s / n)::BIGINT ORDER BY i) AS v
  FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM a{i}) GROUP BY ALL) GROUP BY cluster),
p{i + 1} AS (SELECT c, coalesce(m{i}.v, p{i}.v) AS v FROM p{i} LEFT JOIN m{i} ON cluster = c)""")
    return ",\n".join(out)


ORACLES["op13_centroid_clustering"] = f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS c, q AS v FROM q ORDER BY c LIMIT 16),
{_rounds(3)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a3 JOIN p3 ON c = cluster
"""


MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}}


def with_domain(docs: DataFrame) -> DataFrame:
    """``docs`` with the domain of their source: by the number it ends in, books, code or (0, or none) web."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    return docs.withColumn("domain", F.element_at(F.array(*map(F.lit, ("web", "books", "code"))), (number % 3 + 1).cast("int")))


@_query
def op8_source_mixing(spark, sf_dir):
    return mixing.mix(with_domain(_read(spark, sf_dir, "documents")), MIX_LEVELS, weights=MIX_WEIGHTS, budget_percent=60, epochs=2, seed=8)


ORACLES["op8_source_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS tokens,
         ['web', 'books', 'code'][(coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT), 0) % 3 + 1)::INT] AS domain
  FROM documents),
r AS (SELECT * FROM d WHERE tokens > 0),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM r GROUP BY ALL),
c1 AS (SELECT domain, (sum(tokens) * 2)::BIGINT AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END::BIGINT AS weight,
              ((SELECT sum(tokens) FROM leaf) * 60 // 100)::BIGINT AS amount FROM leaf GROUP BY domain),
w1 AS (SELECT *, cap / weight AS need, amount - coalesce(sum(cap) OVER (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opn FROM c1),
l1 AS (SELECT min({'need': need, 'name': domain, 'lft': lft, 'opn': opn}) FILTER (WHERE cap * opn > lft * weight) AS lv FROM w1),
g1 AS (SELECT domain, (CASE WHEN cap * opn <= lft * weight THEN cap ELSE lv.lft * weight // lv.opn END)::BIGINT AS given FROM w1, l1),
c2 AS (SELECT leaf.domain, lang, (sum(tokens) * 2)::BIGINT AS cap, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END::BIGINT AS weight, any_value(given) AS amount
       FROM leaf JOIN g1 USING (domain) GROUP BY leaf.domain, lang),
w2 AS (SELECT *, cap / weight AS need, amount - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opn FROM c2),
l2 AS (SELECT domain, min({'need': need, 'name': lang, 'lft': lft, 'opn': opn}) FILTER (WHERE cap * opn > lft * weight) AS lv FROM w2 GROUP BY domain),
g2 AS (SELECT domain, lang, (CASE WHEN cap * opn <= lft * weight THEN cap ELSE lv.lft * weight // lv.opn END)::BIGINT AS given FROM w2 JOIN l2 USING (domain)),
c3 AS (SELECT domain, lang, source, tokens, tokens * 2 AS cap, 1::BIGINT AS weight, given AS amount FROM leaf JOIN g2 USING (domain, lang)),
w3 AS (SELECT *, cap / weight AS need, amount - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opn FROM c3),
l3 AS (SELECT domain, lang, min({'need': need, 'name': source, 'lft': lft, 'opn': opn}) FILTER (WHERE cap * opn > lft * weight) AS lv FROM w3 GROUP BY domain, lang),
g3 AS (SELECT domain, lang, source, tokens AS leaf_tokens, (CASE WHEN cap * opn <= lft * weight THEN cap ELSE lv.lft * weight // lv.opn END)::BIGINT AS given
       FROM w3 JOIN l3 USING (domain, lang)),
p AS (SELECT r.*, given // leaf_tokens AS whole, given % leaf_tokens AS part, md5('8:' || (given // leaf_tokens) || ':' || doc_id) AS place
      FROM r JOIN g3 USING (domain, lang, source)),
q AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM p),
t AS (SELECT doc_id, domain, lang, source, tokens, (whole + CASE WHEN upto <= part THEN 1 ELSE 0 END)::BIGINT AS copies FROM q)
SELECT * FROM t WHERE copies > 0
"""


@_query
def op6_warc_derivatives(spark, sf_dir):
    records = warc.derive(warc.responses(_read(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"))
    return records.select("page_id", "type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest_ok",
                          F.length("block").cast("long").alias("block_length"), F.sha2("record", 256).alias("record_sha256"))


@_query
def op9_pii_surrogates(spark, sf_dir):
    return surrogates.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), key="pixelweave-demo-key")


_WORD_LIST = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLES["op7_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORD_LIST} AS w FROM documents),
e AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
g AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM g WHERE z IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS l FROM d),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM b GROUP BY source),
t AS (SELECT sum(n) AS n, sum(k) / sum(n) AS mean, count(*) AS hosts, sum(n * n) AS nn FROM s),
v AS (SELECT any_value(t.n) AS n, any_value(mean) AS mean,
             greatest(0, (sum(s.n * pow(s.k / s.n - mean, 2)) - (any_value(hosts) - 1) * any_value(mean) * (1 - any_value(mean)))
                         / nullif(any_value(t.n) - any_value(nn) / any_value(t.n), 0)) AS between_hosts FROM s, t),
p AS (SELECT mean, CASE WHEN coalesce(between_hosts, 0) > 0 THEN greatest(0, mean * (1 - mean) / between_hosts - 1) ELSE n END AS weight FROM v),
r AS (SELECT source, (k + mean * weight) / (n + weight) AS host_rate FROM s, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept,
       round(host_rate, 6) AS host_rate
FROM b LEFT JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""

ORACLES["op2_decontamination"] = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM w WHERE side = 'b' AND len(w) > 0),
windows AS (SELECT DISTINCT id AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM items),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM w, sizes WHERE side = 'd' AND len(w) >= n),
hits AS (SELECT docs.id, docs.i, docs.n, item_id FROM docs JOIN windows ON windows.n = docs.n AND s = array_to_string(w[i:i + docs.n - 1], ' ')),
words AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY id),
named AS (SELECT id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
          FROM (SELECT DISTINCT id, item_id FROM hits) GROUP BY id)
SELECT w.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN words USING (id) LEFT JOIN named USING (id) WHERE side = 'd'
"""

ORACLES["op5_line_dedup"] = """
WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS raw, unnest(lines) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
c AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM l),
p AS (SELECT doc_id, raw, t, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM c WHERE t <> ''),
w AS (SELECT a.doc_id, a.pos, least(a.n, 3) AS size, sha256(string_agg(b.t, chr(10) ORDER BY b.pos)) AS h
      FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + least(a.n, 3) - 1
      WHERE a.pos <= a.n - least(a.n, 3) + 1 GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY h, size ORDER BY doc_id, pos) AS turn FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM f WHERE turn > 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.raw) AS text FROM l LEFT JOIN p USING (doc_id, raw)
         WHERE NOT EXISTS (FROM gone WHERE gone.doc_id = l.doc_id AND gone.pos = p.pos) GROUP BY l.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id)::BIGINT AS n_lines,
       (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
e AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x, len(w) AS n FROM d),
g AS (SELECT doc_id, n, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', x, y, z) AS s FROM g WHERE z IS NOT NULL
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM i JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * i.n >= 85 * (ca.n + cb.n - i.n)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.least AS component_id, d.doc_id = m.least AS kept
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) m USING (doc_id)
"""
