"""Queries that put several operators together: evaluation, calibration, verification, manifests, comparisons (C of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series
from .registry import query, table

KEYS = 5


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 8 AS symbol FROM lineitem),
h AS (SELECT l_orderkey, k, count(*) AS n, count(*) FILTER (symbol = (l_linenumber * (k + 1)) % 8) AS hits FROM r, range({KEYS}) AS t(k) GROUP BY ALL),
b AS (SELECT l_orderkey, n, hits, k FROM h QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY hits DESC, k) = 1)
SELECT CASE WHEN hits > 0 THEN k END AS answer_key, count(*) AS runs, sum(n)::BIGINT AS tokens, sum(hits)::BIGINT AS right_tokens, count(*) FILTER (hits = n) AS whole_runs FROM b GROUP BY ALL"""
)
def key_identification(spark, sf_dir):
    """Runs (orders) are read against several answer keys; the key with most hits is taken, of equals the first, and none without a hit. One pass, no row for each key."""
    symbol = F.col("l_partkey") % 8
    hits = [F.count_if(symbol == (F.col("l_linenumber") * (k + 1)) % 8).alias(f"h{k}") for k in range(KEYS)]
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), *hits)
    best = F.greatest(*(f"h{k}" for k in range(KEYS)))
    key = F.array_position(F.array(*(f"h{k}" for k in range(KEYS))), F.col("hits")) - 1
    told = runs.withColumn("hits", best).select("n", "hits", F.when(F.col("hits") > 0, key).alias("answer_key"))
    return told.groupBy("answer_key").agg(
        F.count("*").alias("runs"), F.sum("n").alias("tokens"), F.sum("hits").alias("right_tokens"), F.count_if(F.col("hits") == F.col("n")).alias("whole_runs")
    )


_MAY_CALIBRATE = ("click", "purchase")


@query(
    f"""SELECT event_type AS corpus, count(value) AS n, CASE WHEN event_type IN {_MAY_CALIBRATE} THEN 'CALIBRATED' ELSE 'REFUSED' END AS status,
CASE WHEN event_type IN {_MAY_CALIBRATE} THEN (quantile_cont(value, 0.25) * 0.5)::DECIMAL(18, 6)::VARCHAR END AS floor,
CASE WHEN event_type IN {_MAY_CALIBRATE} THEN sha256('{{"corpus":"' || event_type || '","floor":' || (quantile_cont(value, 0.25) * 0.5)::DECIMAL(18, 6)::VARCHAR || '}}') END AS profile_sha256
FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def calibrated_floor(spark, sf_dir):
    """Half the lower quartile of each corpus that may be calibrated on, with the digest of its profile; other corpora are refused. Null values don't count."""
    events = table(spark, sf_dir, "events").where("value is not null")
    lower = series.quantiles(events, "event_type", "value", {"q": 0.25})
    counts = events.groupBy("event_type").agg(F.count("value").alias("n"))
    may = F.col("corpus").isin(*_MAY_CALIBRATE)
    made = counts.join(lower, "event_type").select(F.col("event_type").alias("corpus"), "n", (F.col("q") * 0.5).cast("decimal(18,6)").cast("string").alias("floor"))
    profile = F.concat(F.lit('{"corpus":"'), "corpus", F.lit('","floor":'), "floor", F.lit("}"))
    return made.select("corpus", "n", F.when(may, "CALIBRATED").otherwise("REFUSED").alias("status"), F.when(may, F.col("floor")).alias("floor"), F.when(may, F.sha2(profile, 256)).alias("profile_sha256"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, regexp_extract(url, '^[a-z]*://[^/?#]*/([a-z][a-z])/', 1) AS url_lang,
trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \t\n\r\f]+', ' ', 'g')) AS title, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[ \t\n\r\f]+', ' ', 'g')) AS heading FROM pages)
SELECT page_id, lang, url_lang, title = heading AS text_match, CASE WHEN lang IS NULL OR lang = '' THEN 'NO_LANGUAGE' WHEN title = '' THEN 'NO_TITLE' WHEN title <> heading THEN 'TEXT' WHEN url_lang <> lang THEN 'URL_LANGUAGE' ELSE 'OK' END AS status FROM p"""
)
def page_verification(spark, sf_dir):
    """Declared facts of a page parsed by pattern, visible texts compared with white space evened out, and the first check that fails."""
    even = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1), r"[ \t\n\r\f]+", " "))
    facts = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), F.regexp_extract("url", "^[a-z]*://[^/?#]*/([a-z][a-z])/", 1).alias("url_lang"),
        even("title").alias("title"), even("h1").alias("heading"),
    )
    status = F.expr("CASE WHEN lang IS NULL OR lang = '' THEN 'NO_LANGUAGE' WHEN title = '' THEN 'NO_TITLE' WHEN title <> heading THEN 'TEXT' WHEN url_lang <> lang THEN 'URL_LANGUAGE' ELSE 'OK' END")
    return facts.select("page_id", "lang", "url_lang", (F.col("title") == F.col("heading")).alias("text_match"), status.alias("status"))


_RECORD = "concat_ws(';', l_linenumber::VARCHAR, l_partkey::VARCHAR, l_quantity::BIGINT::VARCHAR, sha256(concat_ws(';', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR)))"


@query(
    f"""SELECT l_orderkey, count(*) AS records, sum(l_quantity)::BIGINT AS bytes,
CASE WHEN min(l_quantity) < 2 THEN 'EMPTY_OUTPUT' WHEN max(l_quantity) > 48 THEN 'OVER_BOUND' WHEN min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*) THEN 'SEQUENCE' ELSE 'COMPLETE' END AS status,
sha256(string_agg({_RECORD}, chr(10) ORDER BY l_linenumber, {_RECORD})) AS manifest_sha256 FROM lineitem GROUP BY l_orderkey"""
)
def capture_manifest(spark, sf_dir):
    """A session (order) of captures (its few lines) as an ordered manifest: each record's digest, the first rule that is broken and the digest of the whole."""
    t = F.col
    digest = F.sha2(F.concat_ws(";", t("l_orderkey").cast("string"), t("l_partkey").cast("string"), t("l_suppkey").cast("string")), 256)
    record = F.concat_ws(";", t("l_linenumber").cast("string"), t("l_partkey").cast("string"), t("l_quantity").cast("long").cast("string"), digest)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.struct("l_linenumber", record.alias("record")).alias("r"))
    whole = line.groupBy("l_orderkey").agg(
        F.count("*").alias("records"), F.sum("l_quantity").cast("long").alias("bytes"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"),
        F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.sort_array(F.collect_list("r")).alias("rs"),
    )
    gaps = (t("first") != 1) | (t("last") != t("records")) | (F.size(F.array_distinct(t("rs")["l_linenumber"])) != t("records"))
    status = F.when(t("least") < 2, "EMPTY_OUTPUT").when(t("most") > 48, "OVER_BOUND").when(gaps, "SEQUENCE").otherwise("COMPLETE")
    return whole.select("l_orderkey", "records", "bytes", status.alias("status"), F.sha2(F.array_join(t("rs")["record"], "\n"), 256).alias("manifest_sha256"))


@query(
    """WITH g AS (SELECT lang, length(text) / (length(text) - length(replace(text, chr(10), '')) + 1.0)::DOUBLE AS ratio FROM documents WHERE text IS NOT NULL AND length(text) > 0)
SELECT lang, count(*) AS n, min(ratio) AS ratio_min, max(ratio) AS ratio_max, quantile_cont(ratio, 0.5) AS ratio_median, quantile_cont(ratio, 0.05) AS ratio_p5, quantile_cont(ratio, 0.95) AS ratio_p95
FROM g WHERE ratio >= 4 AND lang IS NOT NULL GROUP BY lang"""
)
def geometry_ratios(spark, sf_dir):
    """Characters a line of each plausible text (4 or more), and their distribution by language; exact quantiles by place."""
    chars = F.length("text")
    lines = chars - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1.0
    ratios = table(spark, sf_dir, "documents").where("text is not null and length(text) > 0 and lang is not null").select("lang", (chars / lines).alias("ratio")).where("ratio >= 4")
    spread = series.quantiles(ratios, "lang", "ratio", {"ratio_median": 0.5, "ratio_p5": 0.05, "ratio_p95": 0.95})
    return ratios.groupBy("lang").agg(F.count("*").alias("n"), F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max")).join(spread, "lang")


@query(
    """WITH s AS (SELECT l_returnflag AS d, stat, v FROM (SELECT l_returnflag, l_quantity::DOUBLE AS quantity, l_discount::DOUBLE AS discount, l_extendedprice::DOUBLE AS price FROM lineitem WHERE l_returnflag IN ('A', 'R')) UNPIVOT (v FOR stat IN (quantity, discount, price))),
q AS (SELECT stat, count(*) FILTER (d = 'A') AS n_a, count(*) FILTER (d = 'R') AS n_b, quantile_cont(v, 0.5) FILTER (d = 'A') AS median_a, quantile_cont(v, 0.5) FILTER (d = 'R') AS median_b,
quantile_cont(v, 0.05) FILTER (d = 'A') AS p5_a, quantile_cont(v, 0.95) FILTER (d = 'A') AS p95_a FROM s GROUP BY stat)
SELECT q.*, median_b - median_a AS shift, (SELECT count(*) FROM s WHERE s.stat = q.stat AND d = 'R' AND v < p5_a) AS b_below_floor FROM q"""
)
def domain_comparison(spark, sf_dir):
    """Two sets of windows by several measures: medians, their shift, and how much of the second lies below the first's floor."""
    both = table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").select(
        F.col("l_returnflag").alias("d"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_extendedprice").cast("double").alias("price")
    )
    told = both.unpivot(["d"], ["quantity", "discount", "price"], "stat", "v").where("v is not null").withColumn("g", F.concat_ws(":", "d", "stat"))
    spread = series.quantiles(told, "g", "v", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    of = lambda side, what: F.max(F.when(F.col("g").startswith(side + ":"), F.col(what)))
    sides = spread.groupBy(F.substring_index("g", ":", -1).alias("stat")).agg(of("A", "median").alias("median_a"), of("R", "median").alias("median_b"), of("A", "p5").alias("p5_a"), of("A", "p95").alias("p95_a"))
    counts = told.join(F.broadcast(sides.select("stat", "p5_a")), "stat").groupBy("stat").agg(  # a row for each measure
        F.count_if(F.col("d") == "A").alias("n_a"), F.count_if(F.col("d") == "R").alias("n_b"), F.count_if((F.col("d") == "R") & (F.col("v") < F.col("p5_a"))).alias("b_below_floor")
    )
    return counts.join(sides, "stat").withColumn("shift", F.col("median_b") - F.col("median_a"))


@query(
    """WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, count(*) AS n, avg(v) AS mean FROM c GROUP BY label, pos)
SELECT label, pos, n, mean, avg(mean) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS soft, avg(mean) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS softer FROM m"""
)
def template_variants(spark, sf_dir):
    """A class's mean vector and two smoothed variants of it (3 and 5 places, cut off at the ends), a row for each place."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = parts.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("mean"))
    near = Window.partitionBy("label").orderBy("pos")  # as many rows as a vector has places
    return means.withColumns({"soft": F.avg("mean").over(near.rowsBetween(-1, 1)), "softer": F.avg("mean").over(near.rowsBetween(-2, 2))})
