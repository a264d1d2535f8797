"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, filteraudit, hostrules, jaccard, licenses, packing, sharding, substrings, suffixes, toxicity, urlfilter, veccodes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the hosts themselves: a digest of the domain fixes who is listed, when, and until when."""
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domains = hosts.select("host").union(hosts.select(F.regexp_replace("host", "^[^.]*[.]", ""))).distinct().toDF("domain")
    d = domains.withColumn("h", F.md5("domain"))
    byte = lambda at: F.conv(F.substring("h", at, 2), 16, 10).cast("int")
    day = lambda at: F.expr("date '2024-01-01'") + byte(at)
    add = d.where(byte(1) < 96).select("domain", F.when(byte(3) < 128, "spam").otherwise("malware").alias("category"), F.lit("add").alias("action"), day(5).alias("on"))
    off = d.where((byte(1) < 96) & (byte(7) < 128)).select("domain", F.when(byte(3) < 128, "spam").otherwise("malware").alias("category"), F.lit("remove").alias("action"), F.expr("date_add(date '2024-01-01', cast(conv(substring(h, 5, 2), 16, 10) as int) + 1 + cast(conv(substring(h, 9, 2), 16, 10) as int))").alias("on"))
    return add.union(off).select("domain", "category", "action", F.col("on").cast("timestamp").alias("listed_at"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("cast(date_add(date '2024-01-01', cast(pmod(page_id * 7919, 365) as int)) as timestamp)").alias("fetched_at"))
    return urlfilter.filter_urls(captures, url_list(pages)).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd"))


_HOST = "nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '[.]?(:[0-9]*)?$', ''), '')"
_BYTE = "('0x' || substr(h, {}, 2))::INT"
OP1_SQL = f"""
WITH hosts AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE {_HOST} IS NOT NULL),
domains AS (SELECT host AS domain FROM hosts UNION SELECT regexp_replace(host, '^[^.]*[.]', '') FROM hosts),
d AS (SELECT domain, md5(domain) AS h FROM domains),
spans AS (
  SELECT domain, CASE WHEN {_BYTE.format(3)} < 128 THEN 'spam' ELSE 'malware' END AS category,
         DATE '2024-01-01' + {_BYTE.format(5)} AS lo,
         CASE WHEN {_BYTE.format(7)} < 128 THEN DATE '2024-01-01' + ({_BYTE.format(5)} + 1 + {_BYTE.format(9)}) END AS hi
  FROM d WHERE {_BYTE.format(1)} < 96),
caps AS (SELECT row_number() OVER () AS rid, page_id, url, DATE '2024-01-01' + ((page_id * 7919) % 365)::INT AS day, {_HOST} AS host FROM pages),
hits AS (
  SELECT rid, category, domain, row_number() OVER (PARTITION BY rid ORDER BY length(domain) DESC, category, domain) AS rn
  FROM caps JOIN spans ON (host = domain OR ends_with(host, '.' || domain)) AND lo <= day AND (hi IS NULL OR day < hi))
SELECT c.page_id, c.url, strftime(c.day, '%Y-%m-%d') AS fetched_at, c.host, h.rid IS NOT NULL AS blocked, h.category, h.domain AS matched_domain
FROM caps c LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h USING (rid)
"""


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


_text = lambda t: "'" + t.replace("'", "''") + "'"
_KNOWN_SQL = f"""known AS (SELECT digest, min(n) AS license FROM (
  SELECT sha256({licenses.canonical_sql("t")}) AS digest, n FROM (VALUES {", ".join(f"('{n}', {_text(t)})" for n, t in licenses.KNOWN)}) v(n, t)
  UNION ALL SELECT digest, n FROM (VALUES {", ".join(f"('{n}', '{d}')" for n, d in licenses.DIGESTS)}) w(n, digest)) GROUP BY 1)"""
OP2_SQL = f"""
WITH {_KNOWN_SQL}, docs AS (SELECT doc_id, sha256({licenses.canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, docs.digest AS canonical_sha256, license FROM docs LEFT JOIN known USING (digest)
"""


def license_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document after the built-in licences in turn, as authors alter them: capitals, a copyright line, wrapping, or a text that goes on."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.pmod("doc_id", F.lit(4)).alias("form"), F.pmod("doc_id", F.lit(len(licenses.KNOWN))).alias("k"))
    known = F.array(*[F.lit(t) for _, t in licenses.KNOWN])
    text = F.element_at(known, (F.col("k") + 1).cast("int"))
    head = F.concat(F.lit("Copyright (c) 2024 "), "source", F.lit("\n"))
    forms = F.when(F.col("form") == 0, F.upper(text)).when(F.col("form") == 1, F.concat(head, text)).when(F.col("form") == 2, F.concat(F.regexp_replace(text, " ", "\n"), F.lit("\nAll rights reserved."))).otherwise(F.concat(text, F.lit(" And so on.")))
    return licenses.scan_licenses(docs.select("doc_id", forms.alias("text")))


LICENSE_FORMS_SQL = f"""
WITH {_KNOWN_SQL}, forms AS (
  SELECT doc_id, doc_id % 4 AS form, source, ([{", ".join(_text(t) for _, t in licenses.KNOWN)}])[doc_id % {len(licenses.KNOWN)} + 1] AS t FROM documents),
made AS (SELECT doc_id, CASE form WHEN 0 THEN upper(t) WHEN 1 THEN 'Copyright (c) 2024 ' || source || chr(10) || t
  WHEN 2 THEN replace(t, ' ', chr(10)) || chr(10) || 'All rights reserved.' ELSE t || ' And so on.' END AS text FROM forms),
docs AS (SELECT doc_id, sha256({licenses.canonical_sql("text")}) AS digest FROM made)
SELECT doc_id, docs.digest AS canonical_sha256, license FROM docs LEFT JOIN known USING (digest)
"""


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(_table(spark, sf_dir, "documents")).drop("spans")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find_passages(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), n_shards=8)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 80 * (s.n + t.n - k)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON r.y = b.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1),
sigs AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS sig FROM grams GROUP BY 1),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS class_id, sig FROM sigs),
deg AS (SELECT c.class_id AS x, count(DISTINCT d.class_id) AS n_links FROM pairs JOIN class c ON c.doc_id = x JOIN class d ON d.doc_id = y WHERE c.class_id <> d.class_id GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(class_id, doc_id) AS class_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN comp USING (doc_id) LEFT JOIN class USING (doc_id) LEFT JOIN deg ON deg.x = class_id
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
OP11_SQL = f"""
WITH RECURSIVE orders(o) AS (
  SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE NOT contains(o, l)),
docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
tests AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e
  FROM docs),
fails AS (SELECT doc_id, part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
  || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS f FROM tests),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
counts AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
steps AS (
  SELECT part, o AS filter_order, step::INT AS step, o[step:step] AS l, f, n, good, toxic,
         contains(f, o[step:step]) AS own, len(regexp_replace(f, '[^' || o[1:step - 1] || '_]', '', 'g')) > 0 AS earlier
  FROM counts, (SELECT o FROM orders WHERE length(o) = 5), range(1, 6) r(step)),
found AS (
  SELECT part, filter_order, step, any_value(l) AS l,
         coalesce(sum(n) FILTER (WHERE NOT own AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE own AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE f = l), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM found
"""


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(_table(spark, sf_dir, "documents"))


_RATE = """{r}_prior AS (
  SELECT CASE WHEN s > 0 AND f > 0 AND f < s AND s - q / s - (h - 1) > 0 THEN (w - s * m * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (s - q / s - (h - 1))) END AS rho, m
  FROM (SELECT count(*)::DOUBLE AS h, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS q, sum({r})::DOUBLE AS f, sum({r}::DOUBLE * {r} / n) AS w, sum({r})::DOUBLE / sum(n) AS m FROM hosts)),
{r}_rate AS (
  SELECT host, CASE WHEN rho > 0 THEN ({r} + m * k) / (n + k) ELSE m END AS rate
  FROM hosts, (SELECT rho, m, greatest(1 / least(rho, 1) - 1, 1e-6) AS k FROM {r}_prior))"""
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows),
cover AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, range(3) r(o) WHERE c > 1 GROUP BY 1),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
measured AS (
  SELECT rid, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM docs JOIN lines USING (rid) LEFT JOIN cover USING (rid)),
hosts AS (SELECT host, count(*) AS n, {", ".join(f"sum(({c})::INT) AS {r}" for r, c in hostrules.RULES.items())} FROM measured WHERE host IS NOT NULL GROUP BY 1),
{", ".join(_RATE.format(r=r) for r in hostrules.RULES)},
worst AS (SELECT host, max(rate) AS rate FROM ({" UNION ALL ".join(f"SELECT * FROM {r}_rate" for r in hostrules.RULES)}) GROUP BY 1)
SELECT doc_id, {", ".join(hostrules.MEASURES)}, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM (SELECT *, {" OR ".join(f"({hostrules.RULES[r]})" for r in hostrules.BASE)} AS base_failed, coalesce(rate > {hostrules.LIMIT}, false) AS host_failed
      FROM measured LEFT JOIN worst USING (host))
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compress(_table(spark, sf_dir, "embeddings"))


def _codebook_sql() -> str:
    """Start, six rounds of assigning and replacing, and the last assignment, for vectors of one width."""
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({veccodes.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {veccodes.PARTS}) + 1:(p + 1) * (len(v) // {veccodes.PARTS})] AS x FROM kept, range({veccodes.PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS y FROM parts WHERE rid <= {veccodes.ENTRIES})"""
    for k in range(veccodes.ROUNDS + 1):
        sql += f""",
near{k} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS b
  FROM (SELECT rid, p, x, e, list_sum([(x[i] - y[i]) * (x[i] - y[i]) for i in range(1, len(x) + 1)])::BIGINT AS d FROM parts JOIN book{k} USING (p)) GROUP BY 1, 2)"""
        if k < veccodes.ROUNDS:
            sql += f""",
mean{k} AS (
  SELECT p, e, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS y
  FROM (SELECT p, b.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k}, range(1, 1025) r(i) WHERE i <= len(x) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, o.y) AS y FROM book{k} o LEFT JOIN mean{k} m USING (p, e))"""
    last = veccodes.ROUNDS
    return (
        sql
        + f""",
coded AS (SELECT rid, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM near{last} GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), book
"""
    )


OP13_SQL = _codebook_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"license_forms": license_forms}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op2_license_scans": OP2_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_host_rules": OP12_SQL, "op13_vector_codes": OP13_SQL, "license_forms": LICENSE_FORMS_SQL}
