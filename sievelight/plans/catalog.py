"""All registered queries: name -> callable, and name -> equivalent SQL.

Each query applies an operator to whole tables; the SQL beside it states the same result for another engine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks, reed_solomon, strings
from ..operators import fits, folds, gates, matching, scoring, sequences
from ..operators import series as orders
from ..sources import documents as sources
from .registry import ORACLE as ORACLE
from .registry import QUERIES as QUERIES
from .registry import query, seconds, table

FLOOR, GAP = 0.28, 0.01


# --- evaluation of labelled vectors -------------------------------------------------------------------------------

_RECORDS = f"""
WITH s AS (SELECT vec_id, embedding AS v, label, vec_id % 5 AS grp FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS nn FROM s),
c AS (SELECT q.vec_id AS qid, q.label, q.grp, b.label AS cls,
        max(list_inner_product(q.v::DOUBLE[], b.v::DOUBLE[]) / (q.nn * b.nn)) AS score
      FROM n q JOIN n b ON q.grp <> b.grp GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nx FROM c WINDOW w AS (PARTITION BY qid ORDER BY score DESC, cls DESC)),
rec AS (SELECT qid, label, grp, cls AS pred, score AS conf, score - coalesce(nx, -1) AS margin,
        CASE WHEN score < {FLOOR} OR score - coalesce(nx, -1) < {GAP} THEN 'erased' WHEN cls = label THEN 'correct' ELSE 'wrong' END AS outcome
        FROM r WHERE rn = 1)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "embeddings").withColumn("grp", F.col("vec_id") % 5)
    return scoring.holdout(samples, id_col="vec_id", vec_col="embedding", label_col="label", group_col="grp", floor=FLOOR, gap=GAP)


@query(_RECORDS + "SELECT grp, count(*) AS n, count_if(outcome='correct')::BIGINT AS correct, count_if(outcome='erased')::BIGINT AS erased, count_if(outcome='wrong')::BIGINT AS wrong FROM rec GROUP BY grp")
def holdout_outcomes(spark, sf_dir):
    return scoring.fold_counts(_records(spark, sf_dir))


@query(
    _RECORDS
    + """, f AS (SELECT grp, count_if(outcome='correct') AS c, count_if(outcome='wrong') AS w FROM rec GROUP BY grp)
SELECT count(*) AS n_groups, round(avg(c / greatest(1, c + w)), 6) AS fold_mean, round(sum(c) / greatest(1, sum(c + w)), 6) AS pooled,
CASE WHEN count(*) < 2 THEN 'NEED_AT_LEAST_2_GROUPS' ELSE 'OK' END AS status FROM f"""
)
def holdout_pooled_vs_foldmean(spark, sf_dir):
    return scoring.pooled_and_fold_mean(_records(spark, sf_dir))


@query(_RECORDS + "SELECT label, pred, count(*) AS n, round(median(conf), 6) AS median_conf, round(median(margin), 6) AS median_margin FROM rec WHERE outcome = 'wrong' GROUP BY ALL")
def confusion_pairs(spark, sf_dir):
    return scoring.confusion_pairs(_records(spark, sf_dir))


@query(_RECORDS + "SELECT label, CASE WHEN outcome = 'erased' THEN '?' ELSE pred::VARCHAR END AS shown, count(*) AS n FROM rec GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return scoring.confusion_matrix(_records(spark, sf_dir))


@query(
    _RECORDS
    + """, b AS (SELECT label, count(*) AS bank FROM embeddings GROUP BY label),
h AS (SELECT label, count_if(outcome='correct')::BIGINT AS correct, count_if(outcome='erased')::BIGINT AS erased FROM rec GROUP BY label)
SELECT coalesce(b.label, h.label) AS label, coalesce(bank, 0) AS bank, coalesce(correct, 0) AS correct, coalesce(erased, 0) AS erased FROM b FULL JOIN h ON b.label = h.label"""
)
def per_class_health(spark, sf_dir):
    bank = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("bank"))
    held = _records(spark, sf_dir).groupBy("label").agg(F.count_if(F.col("outcome") == "correct").alias("correct"), F.count_if(F.col("outcome") == "erased").alias("erased"))
    return bank.join(held, "label", "full").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bank", "correct", "erased")))


@query("SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS rank FROM embeddings) WHERE rank <= 12")
def bank_capped(spark, sf_dir):
    return scoring.capped_bank(table(spark, sf_dir, "embeddings"), "label", ["vec_id"], 12).select("label", "vec_id", "rank")


@query("SELECT label, (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY ALL")
def class_mean_template(spark, sf_dir):
    return scoring.class_means(table(spark, sf_dir, "embeddings"), "embedding", "label").select("label", "pos", F.round("mean", 5).alias("mean"))


_TRANSFER = """
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nn FROM embeddings),
c AS (SELECT q.vec_id AS qid, q.label, b.label AS cls, max(list_inner_product(q.v, b.v) / (q.nn * b.nn)) AS score
      FROM n q, n b WHERE q.vec_id % 2 = 1 AND b.vec_id % 2 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nx FROM c WINDOW w AS (PARTITION BY qid ORDER BY score DESC, cls DESC)),
rec AS (SELECT qid % 3 AS condition, CASE WHEN score < 0.28 OR score - coalesce(nx, -1) < 0.01 THEN 'erased' WHEN cls = label THEN 'correct' ELSE 'wrong' END AS outcome FROM r WHERE rn = 1)
SELECT coalesce(condition::VARCHAR, 'all') AS condition, count(*) AS n, count_if(outcome = 'correct')::BIGINT AS correct, count_if(outcome = 'erased')::BIGINT AS erased
FROM rec GROUP BY GROUPING SETS ((), (condition))"""


@query(_TRANSFER)
def transfer_by_condition(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scores = scoring.class_scores(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0"), id_col="vec_id", vec_col="embedding", label_col="label", group_col=None)
    best = scoring.top2(scores, ["qid", "label"]).withColumn("outcome", scoring.outcome(F.col("label"), F.col("pred"), F.col("conf"), F.col("margin"), FLOOR, GAP))
    sets = best.withColumn("condition", F.col("qid") % 3).groupingSets([[], ["condition"]], "condition")
    out = sets.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "correct").alias("correct"), F.count_if(F.col("outcome") == "erased").alias("erased"))
    return out.withColumn("condition", F.coalesce(F.col("condition").cast("string"), F.lit("all")))


# --- quantiles, gates, funnels ------------------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(median(l_extendedprice), 4) AS p50,
round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(quantile_cont(l_extendedprice, 0.25) * 0.5, 4) AS floor_from_p25 FROM lineitem GROUP BY 1"""
)
def score_percentiles(spark, sf_dir):
    found = orders.quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    named = {p: F.col(p) for p in ("p5", "p25", "p50", "p75", "p95")} | {"iqr": F.col("p75") - F.col("p25"), "floor_from_p25": F.col("p25") * 0.5}
    return found.select("l_returnflag", *(F.round(v, 4).alias(k) for k, v in named.items()))


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[((count(*) - 1) * 3 // 4 + 1)::INT] AS q3_lower FROM orders GROUP BY 1")
def lower_quantile(spark, sf_dir):
    return orders.lower_quantile(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 3, 4).withColumnRenamed("o_totalprice", "q3_lower")


_RULES = [gates.Rule("n_chars", ">=", 200, "TOO_SHORT"), gates.Rule("n_lines", ">=", 2, "ONE_LINE"), gates.Rule("digit_ratio", "<=", 0.02, "DIGITS"), gates.Rule("mark_ratio", "<=", 0.05, "MARKS")]
_METRICS = """WITH m AS (SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) AS digit_ratio, length(regexp_replace(text, '[^#$%&*!|]', '', 'g')) / length(text) AS mark_ratio FROM documents),
g AS (SELECT doc_id, list_filter([CASE WHEN NOT n_chars >= 200 THEN 'TOO_SHORT' END, CASE WHEN NOT n_lines >= 2 THEN 'ONE_LINE' END, CASE WHEN NOT digit_ratio <= 0.02 THEN 'DIGITS' END,
CASE WHEN NOT mark_ratio <= 0.05 THEN 'MARKS' END], lambda x: x IS NOT NULL) AS reasons FROM m)
"""


def _gated(spark, sf_dir):
    text = F.col("text")
    n = F.length(text)
    measured = table(spark, sf_dir, "documents").select(
        "doc_id", n.alias("n_chars"), (n - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / n).alias("digit_ratio"), (F.length(F.regexp_replace(text, r"[^#$%&*!|]", "")) / n).alias("mark_ratio"),
    )
    return gates.gate(measured, _RULES)


@query(_METRICS + "SELECT doc_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'ACCEPT' ELSE 'RECAPTURE' END AS status FROM g")
def gate_reasons(spark, sf_dir):
    return _gated(spark, sf_dir).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "status")


@query(_METRICS + "SELECT reason, count(*) AS n, min(doc_id) AS first_id FROM (SELECT unnest(reasons) AS reason, doc_id FROM g) GROUP BY reason")
def gate_reason_counts(spark, sf_dir):
    return gates.reason_counts(_gated(spark, sf_dir), "doc_id")


@query("SELECT d.o_orderstatus, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) d(o_orderstatus) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) c ON d.o_orderstatus = c.o_orderstatus")
def status_zero_fill(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return gates.zero_filled(counts, "o_orderstatus", ["F", "O", "P", "X"])


_FUNNEL = ["signup", "view", "click", "purchase"]


@query(
    """WITH r AS (SELECT user_id, max(CASE event_type WHEN 'signup' THEN 1 ELSE 0 END) AS a, max(CASE event_type WHEN 'view' THEN 1 ELSE 0 END) AS b,
max(CASE event_type WHEN 'click' THEN 1 ELSE 0 END) AS c, max(CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END) AS d FROM events GROUP BY 1),
k AS (SELECT user_id, a + a * b + a * b * c + a * b * c * d AS depth FROM r)
SELECT s.stage, count_if(depth >= s.pos)::BIGINT AS reached FROM k, (VALUES ('signup', 1), ('view', 2), ('click', 3), ('purchase', 4)) s(stage, pos) GROUP BY 1"""
)
def stage_funnel(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.max(F.when(F.col("event_type") == s, 1).otherwise(0)).alias(s) for s in _FUNNEL))
    depth, chain = F.lit(0), F.lit(1)
    for s in _FUNNEL:
        chain = chain * F.col(s)
        depth = depth + chain
    counts = seen.select(depth.alias("depth")).agg(*(F.count_if(F.col("depth") > k).alias(s) for k, s in enumerate(_FUNNEL)))
    return counts.unpivot([], _FUNNEL, "stage", "reached")


@query(
    """SELECT l_returnflag AS fam, l_linenumber AS sev, count(*) AS tokens, sum(l_quantity)::BIGINT AS c, count_if(l_discount > 0.05)::BIGINT AS e, count_if(l_tax > 0.06)::BIGINT AS w
FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1, 2"""
)
def fam_sev_rollup(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'")
    return kept.groupBy(F.col("l_returnflag").alias("fam"), F.col("l_linenumber").alias("sev")).agg(
        F.count("*").alias("tokens"), F.sum("l_quantity").cast("long").alias("c"), F.count_if(F.col("l_discount") > 0.05).alias("e"), F.count_if(F.col("l_tax") > 0.06).alias("w")
    )


@query(
    """SELECT coalesce(o_orderpriority, '*') AS copy, coalesce(n_name, '*') AS page, coalesce(o_orderstatus, '*') AS condition, count(*) AS n,
round(count_if(o_totalprice > 200000) / greatest(1, count(*)), 6) AS rate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((), (o_orderpriority), (n_name), (o_orderstatus))"""
)
def pooled_grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    keys = ["o_orderpriority", "n_name", "o_orderstatus"]
    out = joined.groupingSets([[], *([k] for k in keys)], *keys).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("o_totalprice") > 200000) / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"))
    return out.select(*(F.coalesce(k, F.lit("*")).alias(a) for k, a in zip(keys, ("copy", "page", "condition"), strict=True)), "n", "rate")


# --- comparing runs, bans, bindings -------------------------------------------------------------------------------

_RUNS = """WITH a AS (SELECT o_custkey, o_orderpriority, count_if(o_orderstatus = 'F') > 0 AS ok FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
b AS (SELECT o_custkey, o_orderpriority, count_if(o_orderstatus = 'F') > 0 AS ok FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
g AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, a.ok AS run_a, b.ok AS run_b
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority)
"""


def _run(spark, sf_dir, parity):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == parity)
    return o.groupBy("o_custkey", "o_orderpriority").agg((F.count_if(F.col("o_orderstatus") == "F") > 0).alias("ok"))


@query(_RUNS + "SELECT o_custkey, o_orderpriority, run_a, run_b, run_a IS DISTINCT FROM run_b AS changed FROM g")
def run_compare_grid(spark, sf_dir):
    return matching.compare_runs(_run(spark, sf_dir, 0), _run(spark, sf_dir, 1), ["o_custkey", "o_orderpriority"], "ok")


@query(_RUNS + "SELECT run_a, run_b, count(*) AS n FROM g WHERE run_a IS DISTINCT FROM run_b GROUP BY ALL")
def run_flips(spark, sf_dir):
    return run_compare_grid(spark, sf_dir).where("changed").groupBy("run_a", "run_b").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, 'a' AS path, (2 * l_quantity + l_linenumber)::BIGINT AS load FROM lineitem WHERE 2 * l_quantity + l_linenumber > 100 AND l_returnflag = 'R'
UNION ALL SELECT l_orderkey, l_linenumber, 'b', (2 * l_quantity + l_linenumber)::BIGINT FROM lineitem WHERE 2 * l_quantity + l_linenumber > 100 AND l_returnflag = 'A'"""
)
def failures_union_tagged(spark, sf_dir):
    load = (2 * F.col("l_quantity") + F.col("l_linenumber")).cast("long")
    rows = table(spark, sf_dir, "lineitem").where(2 * F.col("l_quantity") + F.col("l_linenumber") > 100)
    tagged = lambda flag, tag: rows.where(F.col("l_returnflag") == flag).select("l_orderkey", "l_linenumber", F.lit(tag).alias("path"), load.alias("load"))
    return tagged("R", "a").unionByName(tagged("A", "b"))


@query("SELECT DISTINCT doc_id FROM documents d WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def ban_list_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    ban = docs.groupBy("digest").count().where("count > 1")
    return matching.banned(docs, ban, "digest")[0].select("doc_id").distinct()


@query("SELECT doc_id FROM documents d WHERE md5(text) NOT IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def clean_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    ban = docs.groupBy("digest").count().where("count > 1")
    return matching.banned(docs, ban, "digest")[1].select("doc_id")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    """WITH a AS (SELECT doc_id, length(text) AS len, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0),
c AS (SELECT doc_id, length(text) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS len, md5(text || CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END) AS h FROM documents)
SELECT c.doc_id, CASE WHEN a.doc_id IS NULL THEN 'UNKNOWN_MEMBER' WHEN a.len <> c.len THEN 'LENGTH_MISMATCH' WHEN a.h <> c.h THEN 'HASH_MISMATCH' ELSE 'OK' END AS binding FROM c LEFT JOIN a ON a.doc_id = c.doc_id"""
)
def member_binding(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    actual = d.where("doc_id % 7 <> 0").select("doc_id", F.length("text").alias("len"), F.md5("text").alias("h"))
    mark = F.when(F.col("doc_id") % 13 == 0, "x").otherwise("")
    claimed = d.select("doc_id", (F.length("text") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("len"), F.md5(F.concat("text", mark)).alias("h"))
    return matching.bind_members(claimed, actual, "doc_id", "len", "h")


_SECONDS = "epoch_us(ts) // 1000000"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds("ts").alias("s"))


@query(
    f"""WITH l AS (SELECT user_id AS lid, min({_SECONDS}) AS lo, max({_SECONDS}) + 1 AS hi FROM events GROUP BY 1),
r AS (SELECT event_id AS rid, {_SECONDS} AS lo, {_SECONDS} + 3600 * (1 + event_id % 5) AS hi FROM events WHERE event_type = 'signup'),
p AS (SELECT lid, rid, least(l.hi, r.hi) - greatest(l.lo, r.lo) AS overlap FROM l JOIN r ON l.lo < r.hi AND r.lo < l.hi)
SELECT lid, rid, overlap FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY overlap DESC, rid) AS rn FROM p) WHERE rn = 1"""
)
def interval_best_overlap_all(spark, sf_dir):
    """Each user's span over all of their events against the hours that follow signups."""
    e = _events(spark, sf_dir)
    left = e.groupBy(F.col("user_id").alias("lid")).agg(F.min("s").alias("lo"), (F.max("s") + 1).alias("hi"))
    right = e.where("event_type = 'signup'").select(F.col("event_id").alias("rid"), F.col("s").alias("lo"), (F.col("s") + 3600 * (1 + F.col("event_id") % 5)).alias("hi"))
    return matching.best_overlap(left, right, left_id="lid", right_id="rid", lo="lo", hi="hi")


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, {_SECONDS} AS s FROM events),
p AS (SELECT a.event_id AS purchase_id, b.event_id AS click_id, abs(a.s - b.s) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND abs(a.s - b.s) <= 7200)
SELECT purchase_id, click_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY purchase_id ORDER BY distance, click_id) AS rn FROM p) WHERE rn = 1"""
)
def nearest_within_tol(spark, sf_dir):
    e = _events(spark, sf_dir)
    a = e.where("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id")
    b = e.where("event_type = 'click'").withColumnRenamed("event_id", "click_id")
    return matching.nearest(a, b, by=["user_id"], left_id="purchase_id", right_id="click_id", at="s", tolerance=7200)


@query()
def nearest_exclusive_greedy(spark, sf_dir):
    e = _events(spark, sf_dir)
    a = e.where("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id")
    b = e.where("event_type = 'click'").withColumnRenamed("event_id", "click_id")
    return matching.nearest_exclusive(a, b, by="user_id", left_id="purchase_id", right_id="click_id", at="s", tolerance=7200)


@query(
    """WITH p AS (SELECT p_partkey, p_name AS a, substr(p_name, 1 + p_partkey % 3) AS b FROM part),
s AS (SELECT p_partkey, sh, len(list_filter(range(1, length(a) + 1), lambda k: k + sh >= 1 AND k + sh <= length(b) AND substr(a, k, 1) = substr(b, k + sh, 1))) AS agree FROM p, unnest([-2, -1, 0, 1, 2]) t(sh))
SELECT p_partkey, agree::INT AS agree, sh AS shift FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY agree DESC, abs(sh), sh DESC) AS rn FROM s) WHERE rn = 1"""
)
def shift_agreement(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.substr("p_name", (F.lit(1) + F.col("p_partkey") % 3).cast("int")).alias("b"))
    return p.select("p_partkey", matching.best_shift(F.col("a"), F.col("b"), 2).alias("m")).select("p_partkey", "m.agree", "m.shift")


@query(
    """SELECT r_name AS lineage, n_name AS profile, realization, CASE WHEN (r_regionkey + n_nationkey + realization) % 2 = 0 THEN 'A' ELSE 'B' END AS template
FROM region, nation, unnest([0, 1, 2]) AS t(realization)"""
)
def experiment_plan(spark, sf_dir):
    plan = table(spark, sf_dir, "region").crossJoin(F.broadcast(table(spark, sf_dir, "nation"))).withColumn("realization", F.explode(F.sequence(F.lit(0), F.lit(2))))
    even = (F.col("r_regionkey") + F.col("n_nationkey") + F.col("realization")) % 2 == 0
    return plan.select(F.col("r_name").alias("lineage"), F.col("n_name").alias("profile"), "realization", F.when(even, "A").otherwise("B").alias("template"))


# --- sequences ----------------------------------------------------------------------------------------------------

_ISLANDS = """WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f),
g AS (SELECT user_id, event_type, island::BIGINT AS island, count(*) AS length, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY ALL)
"""


@query(_ISLANDS + "SELECT user_id, event_type, island, length, first, last FROM g")
def islands_runs(spark, sf_dir):
    return sequences.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query(_ISLANDS + "SELECT user_id, event_type, length, first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) AS rn FROM g) WHERE rn = 1")
def longest_run(spark, sf_dir):
    runs = islands_runs(spark, sf_dir)
    best = runs.groupBy("user_id").agg(F.max(F.struct("length", -F.col("first"), "event_type")).alias("m"))
    return best.select("user_id", "m.event_type", "m.length", (-F.col("m.col2")).alias("first"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_SECONDS} AS s FROM events),
g AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap FROM e),
m AS (SELECT user_id, median(gap) AS med FROM g GROUP BY 1),
c AS (SELECT g.event_id, g.user_id, g.s, CASE WHEN gap > med * 3.0 THEN 1 ELSE 0 END AS cut FROM g JOIN m USING (user_id))
SELECT event_id, user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY s, event_id)::BIGINT AS session FROM c"""
)
def gap_sessions(spark, sf_dir):
    return sequences.gap_sessions(_events(spark, sf_dir).select("event_id", "user_id", "s"), ["user_id"], "s", "event_id", 3.0).select("event_id", "user_id", "session")


_DAILY = "WITH d AS (SELECT (epoch_us(o_orderdate) // 86400000000)::BIGINT AS day, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY day) AS i, day, n FROM d)"


def _daily(spark, sf_dir):
    day = F.floor(seconds("o_orderdate") / 86400).cast("long")
    daily = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("i", F.row_number().over(Window.orderBy("day")))


@query(
    _DAILY
    + """SELECT day, round(avg(n) OVER w, 6) AS roll_mean, round(quantile_cont(n, 0.5) OVER w, 6) AS roll_median, min(n) OVER w AS roll_min, max(n) OVER w AS roll_max
FROM i WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""
)
def rolling_baseline_outliers(spark, sf_dir):
    rolled = sequences.rolling(_daily(spark, sf_dir), [], "day", "n", 3)
    return rolled.select("day", F.round("roll_mean", 6).alias("roll_mean"), F.round("roll_median", 6).alias("roll_median"), "roll_min", "roll_max")


@query(_DAILY + ", x AS (SELECT i, n - (SELECT avg(n) FROM i) AS x FROM i) SELECT lag::INT AS lag, round(sum(a.x * b.x), 3) AS r FROM x a, unnest(range(1, 15)) t(lag), x b WHERE b.i = a.i + lag GROUP BY lag")
def autocorr_lags(spark, sf_dir):
    return sequences.autocorrelation(_daily(spark, sf_dir), "i", "n", 14).select("lag", F.round("r", 3).alias("r"))


@query(
    _DAILY
    + """, w AS (SELECT i, n, lag(n) OVER (ORDER BY i) AS a, lead(n) OVER (ORDER BY i) AS c, max(n) OVER () AS top FROM i)
SELECT i::INT AS i, n, round(i + CASE WHEN a - 2 * n + c = 0 THEN 0.0 ELSE 0.5 * (a - c) / (a - 2 * n + c) END, 6) AS refined FROM w WHERE n > a AND n >= c AND n >= top * 0.6"""
)
def local_maxima(spark, sf_dir):
    return sequences.local_maxima(_daily(spark, sf_dir), "i", "n", 0.6).select("i", "n", F.round("refined", 6).alias("refined"))


@query(_DAILY + "SELECT round(regr_slope(n, day), 8) AS slope, round(regr_intercept(n, day), 4) AS intercept, round(regr_r2(n, day), 8) AS r2 FROM d")
def trend_fit(spark, sf_dir):
    return _daily(spark, sf_dir).agg(F.round(F.regr_slope("n", "day"), 8).alias("slope"), F.round(F.regr_intercept("n", "day"), 4).alias("intercept"), F.round(F.regr_r2("n", "day"), 8).alias("r2"))


@query(_DAILY + "SELECT round(var_pop(2 * n - a - c), 6) AS laplacian_var, round(avg(abs(c - a)), 6) AS edge_energy FROM (SELECT n, lag(n) OVER (ORDER BY i) AS a, lead(n) OVER (ORDER BY i) AS c FROM i)")
def laplacian_var_1d(spark, sf_dir):
    w = Window.orderBy("i")
    near = _daily(spark, sf_dir).select("n", F.lag("n").over(w).alias("a"), F.lead("n").over(w).alias("c"))
    return near.agg(F.round(F.var_pop(2 * F.col("n") - F.col("a") - F.col("c")), 6).alias("laplacian_var"), F.round(F.avg(F.abs(F.col("c") - F.col("a"))), 6).alias("edge_energy"))


@query(
    """WITH h AS (SELECT greatest(0, least(63, floor(l_extendedprice / (100000.0 / 64))))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin)::DOUBLE AS w0, sum(n * bin) OVER (ORDER BY bin)::DOUBLE AS s0, (SELECT sum(n)::DOUBLE FROM h) AS w, (SELECT sum(n * bin)::DOUBLE FROM h) AS s FROM h),
v AS (SELECT bin, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) AS between_ FROM c WHERE w0 < w) SELECT bin FROM v ORDER BY between_ DESC, bin LIMIT 1"""
)
def otsu_threshold(spark, sf_dir):
    return sequences.otsu(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 100000.0, 64).select("bin")


# --- text and codes -----------------------------------------------------------------------------------------------

_A = strings.ALPHABET


@query(f"SELECT page_id, len(r)::INT AS n_runs, coalesce(list_max(list_transform(r, lambda x: length(x))), 0)::INT AS longest FROM (SELECT page_id, regexp_extract_all(regexp_replace(lower(url), '\\s', '', 'g'), '[{_A}]+') AS r FROM pages)")
def token_runs(spark, sf_dir):
    r = strings.runs(strings.squeeze(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", r.alias("r")).select("page_id", F.size("r").alias("n_runs"), F.coalesce(F.array_max(F.transform("r", F.length)), F.lit(0)).alias("longest"))


@query("SELECT doc_id, ceil(length(text) / 48.0)::INT AS n_lines, substr(text, 1, 48) AS first_line FROM documents")
def wrap48(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.wrap(F.col("text"), 48).alias("w")).select("doc_id", F.size("w").alias("n_lines"), F.col("w")[0].alias("first_line"))


@query("SELECT doc_id, array_to_string(list_transform(range(0, 8), lambda k: substr(md5(text), 1 + 4 * k, 4)), '-') AS code FROM documents")
def group4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.grouped(F.md5("text")).alias("code"))


@query()
def word_wrap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.wrapped_lines(F.col("text"), 60).alias("n_lines"))


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) WHERE ch <> '' GROUP BY ch")
def class_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, regexp_extract(c_name, '(\\d+)$', 1) AS ordinal, nullif(regexp_extract(c_name, '^([A-Za-z]+)', 1), '') AS family FROM customer")
def regex_name_parts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).alias("ordinal"), F.nullif(F.regexp_extract("c_name", r"^([A-Za-z]+)", 1), F.lit("")).alias("family"))


@query(
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
b AS (SELECT doc_id, h, array_to_string(list_transform(range(1, 65), lambda k: lpad(bin(('0x' || substr(h, k::INT, 1))::INT), 4, '0')), '') || '0000' AS bits FROM h)
SELECT doc_id, array_to_string(list_transform(range(0, 52), lambda k: substr('"""
    + _A
    + """', (1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, (1 + 5 * k + j)::INT, 1)::INT * (16 >> j::INT))))::INT, 1)), '') AS token FROM b"""
)
def bech32_pack_all(spark, sf_dir):
    """All 32 bytes of the digest, zero bits behind the last."""
    return table(spark, sf_dir, "documents").select("doc_id", strings.symbols(strings.five_bits(F.sha2("text", 256), 32)).alias("token"))


@query()
def bech32_checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.polymod(strings.five_bits(F.sha2("text", 256), 32)).alias("polymod"))


@query("SELECT n_nationkey, list_sort(list_distinct(list_filter([5 * n_nationkey // 8, (5 * n_nationkey + 4) // 8, 5 * (n_nationkey + 3) // 8, (5 * (n_nationkey + 3) + 4) // 8], lambda b: b < 12)))::VARCHAR AS bytes FROM nation")
def erasure_bytes(spark, sf_dir):
    chars = F.array(F.col("n_nationkey"), F.col("n_nationkey") + 3)
    b = strings.touched_bytes(chars, 12)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("["), F.array_join(b, ", "), F.lit("]")).alias("bytes"))


@query()
def rs_roundtrip(spark, sf_dir):
    @F.pandas_udf("ok boolean, load int")
    def trip(h: pd.Series) -> pd.DataFrame:
        raw = h.map(bytes.fromhex)
        return reed_solomon.round_trip(raw.map(lambda b: b + b[:17]), raw.map(lambda b: b[: b[31] % 20]), raw.map(lambda b: b[20 : 20 + b[30] % 12]), 34)

    out = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).select("doc_id", trip("h").alias("r"))
    return out.select("doc_id", "r.ok", "r.load", (F.col("r.ok") == (F.col("r.load") <= 34)).alias("as_promised"))


@query()
def seqmatch_accuracy(spark, sf_dir):
    @F.pandas_udf(T.LongType())
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([blocks.matched_size(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    damaged = F.translate(text, "ea", "?")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(text).alias("n"), matched(text, damaged).alias("matched"))
    return rows.withColumn("accuracy", F.round(F.col("matched") / F.greatest(F.lit(1), F.col("n")), 6))


@query()
def strict_manifest_report(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    twice = F.when(F.col("n_nationkey") % 5 == 0, F.lit(',"id":1')).otherwise(F.lit(""))
    more = F.when(F.col("n_nationkey") % 7 == 0, F.lit(',"extra":true')).otherwise(F.lit(""))
    raw = n.select("n_nationkey", F.concat(F.lit('{"id":'), F.col("n_nationkey"), F.lit(',"name":"'), F.col("n_name"), F.lit('"'), twice, more, F.lit("}")).alias("raw"))
    return sources.strict_report(raw, "raw", {"id": "int", "name": "str"}).select("n_nationkey", "ok", "reason")


@query("SELECT r_regionkey, sha256('{\"key\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' || chr(10)) AS digest FROM region")
def canonical_digest(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", sources.canonical_digest(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("digest"))


@query(
    """WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS a, median(c_acctbal) AS b, count(*) AS c FROM customer GROUP BY 1), r AS (SELECT avg(a) AS a, median(b) AS b, avg(c) AS c FROM m)
SELECT c_nationkey, array_to_string(list_filter([CASE WHEN abs(m.a - r.a) > 300 THEN 'mean' END, CASE WHEN abs(m.b - r.b) > 400 THEN 'median' END, CASE WHEN abs(m.c - r.c) > 5 THEN 'count' END], lambda x: x IS NOT NULL), ',') AS failures FROM m, r"""
)
def tolerance_checks(spark, sf_dir):
    m = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.median("c_acctbal").alias("b"), F.count("*").alias("c"))
    r = m.agg(F.avg("a").alias("ra"), F.median("b").alias("rb"), F.avg("c").alias("rc"))
    bad = gates.tolerance_failures([("mean", F.col("a"), F.col("ra"), 300), ("median", F.col("b"), F.col("rb"), 400), ("count", F.col("c").cast("double"), F.col("rc"), 5)])
    return m.crossJoin(F.broadcast(r)).select("c_nationkey", F.array_join(bad, ",").alias("failures"))


# --- robust fits, folds over a page, tiles, base 32 ----------------------------------------------------------------


@query()
def consensus_line_fit(spark, sf_dir):
    got = fits.consensus_line(table(spark, sf_dir, "part").withColumn("x", F.col("p_partkey") % 100), "p_brand", "x", "p_retailprice", tolerance=300.0)
    return got.select("p_brand", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n_kept")


@query()
def huber_line_fit(spark, sf_dir):
    got = fits.huber_line(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice")
    return got.select("p_brand", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


def _order_lines(spark, sf_dir, *cols):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items"))


@query()
def adjacent_collapse(spark, sf_dir):
    lines = _order_lines(spark, sf_dir, F.floor(seconds("l_shipdate") / 86400).alias("day"), "l_linenumber", "l_quantity")
    kept = folds.collapse_adjacent(F.col("items"), lambda a, b: b["day"] - a["day"] <= 10, lambda b, a: b["l_quantity"] > a["l_quantity"])
    return lines.select("l_orderkey", F.explode(kept).alias("i")).select("l_orderkey", "i.*")


@query()
def diverse_top_k(spark, sf_dir):
    tags = F.array(F.concat(F.lit("f"), "l_returnflag"), F.concat(F.lit("s"), "l_linestatus"), F.concat(F.lit("m"), F.month("l_shipdate")))
    lines = _order_lines(spark, sf_dir, (-F.col("l_extendedprice")).alias("worth"), "l_linenumber", "l_quantity", tags.alias("tags"))
    kept = folds.diverse_top(F.col("items"), 5, lambda a, b: (F.size(F.array_intersect(a["tags"], b["tags"])) >= 2) & (a["l_quantity"] >= b["l_quantity"]))
    return lines.select("l_orderkey", F.posexplode(kept).alias("place", "i")).select("l_orderkey", "place", "i.l_linenumber")


@query(
    """WITH RECURSIVE g AS (SELECT DISTINCT c_nationkey AS n, c_custkey % 256 AS p FROM customer),
r(n, a, b) AS (SELECT n, p, p FROM g UNION SELECT r.n, r.a, g.p FROM r JOIN g ON g.n = r.n AND (abs(g.p - r.b) = 16 OR (g.p = r.b + 1 AND g.p % 16 <> 0) OR (g.p = r.b - 1 AND r.b % 16 <> 0))),
c AS (SELECT n, a, min(b) AS c FROM r GROUP BY ALL), s AS (SELECT n, c, count(*) AS k FROM c GROUP BY ALL)
SELECT n AS c_nationkey, count(*) AS components, max(k) AS largest, sum(k)::BIGINT AS total FROM s GROUP BY n"""
)
def components_grid(spark, sf_dir):
    held = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set(F.col("c_custkey") % 256).alias("held"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.array_contains("held", k.cast("long")).cast("int"))
    return held.select("c_nationkey", folds.grid_components(cells, F.lit(16)).alias("g")).select("c_nationkey", "g.*")


@query(
    """WITH h AS (SELECT p_partkey, sha256(p_name) AS h FROM part),
b AS (SELECT p_partkey, h, array_to_string(list_transform(range(1, 65), lambda k: lpad(bin(('0x' || substr(h, k::INT, 1))::INT), 4, '0')), '') || '0000' AS bits FROM h)
SELECT p_partkey, h AS back, array_to_string(list_transform(range(0, 52), lambda k: substr('"""
    + strings.BASE32
    + """', (1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, (1 + 5 * k + j)::INT, 1)::INT * (16 >> j::INT))))::INT, 1)), '') AS code FROM b"""
)
def base32_roundtrip_all(spark, sf_dir):
    """All 32 bytes of a digest, written and read."""
    coded = table(spark, sf_dir, "part").select("p_partkey", strings.symbols(strings.five_bits(F.sha2("p_name", 256), 32), strings.BASE32).alias("code"))
    return coded.withColumn("back", strings.from_base32(F.col("code"), 32))


# --- streams (an extension) ---------------------------------------------------------------------------------------


@query(f"SELECT ({_SECONDS}) // 21600 * 21600 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    from ..streaming import windows

    return windows.drained(spark, table(spark, sf_dir, "events").schema, sf_dir, "events", lambda s: windows.tumbling(s.withColumn("ts", F.timestamp_seconds(seconds("ts"))), "ts", "6 hours", ["event_type"], "value"), "complete").select(
        F.unix_seconds("start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total")
    )


@query("SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL")
def stream_first(spark, sf_dir):
    from ..streaming import windows

    return windows.drained(spark, table(spark, sf_dir, "events").schema, sf_dir, "events", lambda s: s.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id")), "complete")


# queries of the other modules register themselves
from . import codec, composites, policies, signals  # noqa: E402, F401
