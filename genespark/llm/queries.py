"""The operators as named queries over the driver tables, with their fixed production parameters."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F

from genespark.llm import collocations, decontaminate, exact_dedup, html_text, near_dedup, packing, periodic, quality_lm, quality_rules, secrets, substring_dedup, token_file, url_filter
from genespark.llm.common import documents, shared_folder

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


@query
def op2_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.fit(secrets.count_documents(docs)))


@query
def op3_quality_lm(spark, sf_dir):
    return quality_lm.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query
def op5_decontaminate(spark, sf_dir):
    found = decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("hash")


@query
def op6_token_file(spark, sf_dir):
    return token_file.round_trip(documents(spark, sf_dir), f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")


@query
def op7_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality_rules.judged(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op8_url_filter(spark, sf_dir):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLES["op8_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT *,
         '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') AS a,
         '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') AS b,
         '.' || host LIKE '%.org' AND starts_with(path, '/fr/') AS c,
         '.' || host LIKE '%.net' AND starts_with(path, '/') AS d
  FROM parts)
SELECT page_id, host, path,
       CASE WHEN a THEN 'example.net/en/' WHEN b THEN 'example.com/de/' WHEN c THEN 'org/fr/' WHEN d THEN 'net/' END AS rule,
       CASE WHEN a THEN 'allow' WHEN b THEN 'block' WHEN c THEN 'allow' WHEN d THEN 'block' ELSE 'allow' END AS verdict
FROM fits"""


@query
def op9_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(documents(spark, sf_dir))


@query
def op10_html_text(spark, sf_dir):
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


ORACLES["op11_exact_dedup"] = r"""
WITH plain AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
sets AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256, CAST(strlen(t) AS BIGINT) AS n_bytes
FROM plain JOIN sets USING (t)"""


@query
def op12_collocations(spark, sf_dir):
    return collocations.top_phrases(collocations.phrases(documents(spark, sf_dir)))


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(generate_series(1, k)) AS i FROM candidates), (SELECT unnest([2, 3]) AS m)
  WHERE m < k AND i + m - 1 <= k),
longest AS (SELECT lang, phrase, max(a) AS over FROM inner_parts GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN longest USING (lang, phrase) JOIN total USING (lang)
WHERE over IS NULL OR 100 * over < 80 * a
QUALIFY rank <= 2000"""


def periodic_tail(doc_id, n):
    """Of every tenth document by the checksum of its id, which word stands at each place once its tail repeats."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


@query
def op13_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(documents(spark, sf_dir), rewrite=periodic_tail)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", periodic.longest_exponent())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
