"""Queries of gates, policies, plans, reports, sources and sinks (F, SRC, SNK and C of the survey)."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from ..functions import imaging
from ..operators import gates
from ..sources import documents, files
from .registry import query, table

# --- predicates and policies --------------------------------------------------------------------------------------


@query("SELECT s_suppkey, round_even(s_acctbal / 7, 6) AS seventh FROM supplier")
def rounded_floats(spark, sf_dir):
    """Six decimals, halves to even."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.bround(F.col("s_acctbal") / 7, 6).alias("seventh"))


@query("SELECT n_nationkey, s_suppkey, s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000")
def null_metadata(spark, sf_dir):
    """What isn't known stays null; nothing is filled in."""
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    return table(spark, sf_dir, "nation").select("n_nationkey").join(rich, "n_nationkey", "left")


_ASSERTIONS = {"QUANTITY_RANGE": "l_quantity BETWEEN 1 AND 50", "DISCOUNT_MAX": "l_discount <= 0.09", "TAX_MAX": "l_tax <= 0.08", "LINE_SET": "l_linenumber IN (1, 2, 3, 4, 5, 6)", "FLAG_SET": "l_returnflag IN ('A', 'N', 'R')"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS violations, (SELECT count(*) FROM lineitem) AS checked FROM lineitem WHERE NOT ({v}) HAVING count(*) > 0" for k, v in _ASSERTIONS.items()))
def structure_assertions(spark, sf_dir):
    """One row for each rule that is violated, from one pass."""
    counts = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("checked"), *(F.count_if(F.expr(f"NOT ({v})")).alias(k) for k, v in _ASSERTIONS.items()))
    return counts.unpivot(["checked"], list(_ASSERTIONS), "rule", "violations").where("violations > 0").select("rule", "violations", "checked")


@query("SELECT p_partkey, len(list_filter([10, 24, 33], lambda w: (p_size / w > 0.85 AND p_size / w < 1.2) OR (p_size / w > 1.8 AND p_size / w < 2.2))) > 0 AS plausible FROM part")
def layout_plausible(spark, sf_dir):
    """A width is near one of the expected ones, or near its double."""
    near = lambda r: ((r > 0.85) & (r < 1.2)) | ((r > 1.8) & (r < 2.2))
    return table(spark, sf_dir, "part").select("p_partkey", F.exists(F.array(*map(F.lit, (10, 24, 33))), lambda w: near(F.col("p_size") / w)).alias("plausible"))


@query(
    """WITH f AS (SELECT c_custkey, c_mktsegment AS purpose, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 = 1 END AS tuning, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS validation FROM customer)
SELECT c_custkey, CASE WHEN tuning IS NULL THEN 'MISSING' WHEN tuning THEN 'ALLOWED' ELSE 'REFUSED' END AS tuning, CASE WHEN validation IS NULL THEN 'MISSING' WHEN validation THEN 'ALLOWED' ELSE 'REFUSED' END AS validation,
purpose IN ('BUILDING', 'MACHINERY') AS listed, CASE WHEN purpose NOT IN ('BUILDING', 'MACHINERY') THEN 'PURPOSE' WHEN validation IS NULL OR NOT validation THEN 'REPLAY_ONLY' WHEN tuning THEN 'MAY_TUNE' ELSE 'VALIDATE' END AS run_kind FROM f"""
)
def flag_policy(spark, sf_dir):
    """Flags in a map, some missing: three states of each, an allow-list of purposes, and the kind of run they permit."""
    entry = lambda name, known, value: F.when(known, F.struct(F.lit(name).alias("k"), value.alias("v")))
    c = F.col("c_custkey")
    given = F.filter(F.array(entry("tuning", c % 3 != 0, c % 3 == 1), entry("validation", c % 5 != 0, c % 2 == 0)), lambda e: e.isNotNull())
    flagged = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("purpose"), F.map_from_entries(given).alias("flags"))
    states = flagged.select("c_custkey", "purpose", gates.policy("flags", "tuning").alias("tuning"), gates.policy("flags", "validation").alias("validation"), F.col("purpose").isin("BUILDING", "MACHINERY").alias("listed"))
    kind = gates.first_reason([(~F.col("listed"), "PURPOSE"), (F.col("validation") != "ALLOWED", "REPLAY_ONLY"), (F.col("tuning") == "ALLOWED", "MAY_TUNE")], "VALIDATE")
    return states.select("c_custkey", "tuning", "validation", "listed", kind.alias("run_kind"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-z ]*') AND length(p_name) <= 20 AS ok FROM part")
def charset_check(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_name").rlike("^[a-z ]*$") & (F.length("p_name") <= 20)).alias("ok"))


@query("SELECT o_orderpriority, CASE WHEN share >= 0.5 THEN 'ADOPT' WHEN share < 0.48 THEN 'REJECT' ELSE 'REVIEW' END AS decision FROM (SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) AS share FROM orders GROUP BY 1)")
def decision_rule(spark, sf_dir):
    share = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    return share.select("o_orderpriority", F.when(F.col("share") >= 0.5, "ADOPT").when(F.col("share") < 0.48, "REJECT").otherwise("REVIEW").alias("decision"))


@query("SELECT doc_id, CASE WHEN len(m) = 1 THEN m[1] END AS hint FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]{4,}')) AS m FROM documents)")
def pinned_hint(spark, sf_dir):
    """A number named in the text is a hint only if it is the only one."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("m")).select("doc_id", F.when(F.size("m") == 1, F.col("m")[0]).alias("hint"))


_RULES = [("quantity", ">=", 5.0, "FEW"), ("discount", "<=", 0.08, "CHEAP"), ("tax", "<=", 0.06, "TAXED"), ("quantity", "<=", 45.0, "MANY")]


@query(
    "WITH r AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, '{m}', '{op}', {limit}, '{reason}')" for k, (m, op, limit, reason) in enumerate(_RULES))
    + """) AS t(k, metric, op, bound, reason)), l AS (SELECT l_orderkey, l_linenumber, metric, v FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, discount, tax INTO NAME metric VALUE v)),
f AS (SELECT reason, l_orderkey, l_linenumber FROM l JOIN r USING (metric) WHERE NOT CASE op WHEN '>=' THEN v >= bound ELSE v <= bound END)
SELECT reason, count(*) AS n, count(DISTINCT l_orderkey) AS orders, min(l_orderkey * 10 + l_linenumber) AS first FROM f GROUP BY 1"""
)
def rule_table_gate(spark, sf_dir):
    """Thresholds as a broadcast table in long form, against unpivoted metrics; reasons with their rows."""
    rules = spark.createDataFrame(_RULES, "metric string, op string, bound double, reason string")
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = wide.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "metric", "v").join(F.broadcast(rules), "metric")
    failed = long.where(~F.when(F.col("op") == ">=", F.col("v") >= F.col("bound")).otherwise(F.col("v") <= F.col("bound")))
    return failed.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))


@query("SELECT (SELECT count(*) FROM (SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0 INTERSECT SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0)) AS shared, true AS disjoint, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0) AS test, (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0) AS train")
def fold_disjoint(spark, sf_dir):
    """A test fold and its training folds share no row, and neither is empty."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5 == 0).alias("test"))
    sides = e.groupBy("vec_id").agg(F.count_if("test").alias("a"), F.count_if(~F.col("test")).alias("b"))
    sums = sides.agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"), F.sum("a").alias("test"), F.sum("b").alias("train"))
    return sums.select("shared", ((F.col("shared") == 0) & (F.col("test") > 0) & (F.col("train") > 0)).alias("disjoint"), "test", "train")


# --- plans and validation -----------------------------------------------------------------------------------------

#: Lineages, profiles and number of cells of the comparison plan.
LINEAGES, PROFILES, CELLS = ("T0", "T1", "T2", "T3", "T4", "T5"), ("Rs72_60", "Rs76_60", "Rs80_60"), 29

_PLAN = f"""WITH p AS (SELECT l // 3 AS lo, l % 3 AS po, l AS q FROM range(0, 18) AS t(l)), n AS (SELECT q, {list(LINEAGES)}[lo + 1] AS lineage, {list(PROFILES)}[po + 1] AS profile FROM p),
plan AS (SELECT 'c' || lpad(c::VARCHAR, 2, '0') AS cell, lineage, lineage || '-' || profile || '-c' || lpad(c::VARCHAR, 2, '0') || '-r' || r AS member_id, lineage || '-' || profile AS payload_id, profile, q, r AS realization,
CASE WHEN (q + c) % 2 = 0 THEN 'recipe' ELSE 'travel' END AS template, c FROM n, range(0, {CELLS}) AS u(c), range(0, 3) AS v(r))
"""


def _plan(spark):
    payloads = spark.range(len(LINEAGES) * len(PROFILES)).withColumnRenamed("id", "q")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    payloads = payloads.select("q", pick(LINEAGES, F.floor(F.col("q") / len(PROFILES))).alias("lineage"), pick(PROFILES, F.col("q") % len(PROFILES)).alias("profile"))
    cells = payloads.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long")))).withColumn("realization", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    cell, payload = F.concat(F.lit("c"), F.lpad(F.col("c").cast("string"), 2, "0")), F.concat_ws("-", "lineage", "profile")
    template = F.when((F.col("q") + F.col("c")) % 2 == 0, "recipe").otherwise("travel")
    member = F.concat_ws("-", payload, cell, F.concat(F.lit("r"), F.col("realization").cast("string")))
    return cells.select("c", cell.alias("cell"), "lineage", member.alias("member_id"), payload.alias("payload_id"), "profile", "q", "realization", template.alias("template"))


@query(_PLAN + "SELECT * EXCLUDE (c) FROM plan")
def comparison_plan(spark, sf_dir):
    """Payloads by cells by realisations: 1,566 rows, every member once."""
    return _plan(spark).drop("c")


@query(
    _PLAN
    + """SELECT count(*) AS n, count(DISTINCT member_id) AS members, (SELECT count(*) FROM (SELECT 1 FROM plan GROUP BY lineage, cell, realization HAVING count(DISTINCT profile) <> 3)) AS unpaired,
sha256('[' || string_agg('{"cell":"' || cell || '","lineage":"' || lineage || '","member_id":"' || member_id || '","payload_id":"' || payload_id || '","profile":"' || profile || '","q":' || q || ',"realization":' || realization || ',"template":"' || template || '"}', ',' ORDER BY q, c, realization) || ']') AS digest FROM plan"""
)
def plan_digest(spark, sf_dir):
    """Size, pairing of all profiles, and the digest of the plan as canonical JSON in its order."""
    plan = _plan(spark)
    row = F.to_json(F.struct("cell", "lineage", "member_id", "payload_id", "profile", "q", "realization", "template"))
    whole = plan.agg(F.count("*").alias("n"), F.countDistinct("member_id").alias("members"), F.array_sort(F.collect_list(F.struct("q", "c", "realization", row.alias("j")))).alias("l"))
    unpaired = plan.groupBy("lineage", "cell", "realization").agg(F.countDistinct("profile").alias("k")).agg(F.count_if(F.col("k") != len(PROFILES)).alias("unpaired"))
    return whole.crossJoin(unpaired).select("n", "members", "unpaired", F.sha2(F.concat(F.lit("["), F.array_join("l.j", ","), F.lit("]")), 256).alias("digest"))


@query(
    """WITH m AS (SELECT c_nationkey AS cell, c_custkey % 4 AS run, count(*)::BIGINT AS n, round(avg(c_acctbal))::BIGINT AS level, CASE WHEN count_if(c_acctbal > 9800) > 0 THEN round(avg(c_custkey) FILTER (c_acctbal > 9800))::BIGINT ELSE -1 END AS spot FROM customer GROUP BY ALL),
s AS (SELECT cell, list_sort(list(n))[2] AS n, list_sort(list(level))[2] AS level, list_sort(list(spot))[2] AS spot FROM m WHERE run > 0 GROUP BY 1 HAVING count(*) = 3)
SELECT a.cell, array_to_string(list_filter([CASE WHEN abs(s.n - a.n) > 3 THEN 'Count' END, CASE WHEN abs(s.level - a.level) > 600 THEN 'Level' END,
CASE WHEN (s.spot >= 0) <> (a.spot >= 0) THEN 'SpotPresence' WHEN s.spot >= 0 AND abs(s.spot - a.spot) > 200 THEN 'SpotPlace' END], lambda x: x IS NOT NULL), ',') AS failures FROM m a JOIN s USING (cell) WHERE a.run = 0"""
)
def cell_validation(spark, sf_dir):
    """An anchor's metrics against the middle of three realisations: named failures; presence on one side alone is one of its own."""
    spot = F.avg(F.when(F.col("c_acctbal") > 9800, F.col("c_custkey")))
    m = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cell"), (F.col("c_custkey") % 4).alias("run")).agg(
        F.count("*").alias("n"), F.round(F.avg("c_acctbal")).cast("long").alias("level"), F.coalesce(F.round(spot).cast("long"), F.lit(-1)).alias("spot")
    )
    names = ("n", "level", "spot")
    middle = m.where("run > 0").groupBy("cell").agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in names)).where("size(n) = 3").select("cell", *(F.col(c)[1].alias(f"m_{c}") for c in names))
    both = m.where("run = 0").join(middle, "cell")
    absent = lambda c: F.when(F.col(c) >= 0, F.col(c))  # noqa: E731  -1 stands for none
    far = gates.tolerance_failures([("Count", F.col("m_n"), F.col("n"), 3), ("Level", F.col("m_level"), F.col("level"), 600)])
    place = F.when(absent("m_spot").isNull() != absent("spot").isNull(), F.array(F.lit("SpotPresence"))).when(F.abs(absent("m_spot") - absent("spot")) > 200, F.array(F.lit("SpotPlace"))).otherwise(F.array().cast("array<string>"))
    return both.select("cell", F.array_join(F.concat(far, place), ",").alias("failures"))


@query(
    """WITH a AS (UNPIVOT (SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region, length(n_name)::VARCHAR AS size FROM nation) ON name, region, size INTO NAME field VALUE v),
b AS (UNPIVOT (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END AS name, n_regionkey::VARCHAR AS region, n_nationkey::VARCHAR AS key FROM nation) ON name, region, key INTO NAME field VALUE v)
SELECT n_nationkey, field, a.v AS expected, b.v AS found, a.v IS NOT DISTINCT FROM b.v AS equal FROM a FULL JOIN b USING (n_nationkey, field)"""
)
def field_conformance(spark, sf_dir):
    """Two records field by field; a field that one side lacks differs."""
    n = table(spark, sf_dir, "nation")
    text = lambda c: F.col(c).cast("string")
    a = n.select("n_nationkey", F.col("n_name").alias("name"), text("n_regionkey").alias("region"), F.length("n_name").cast("string").alias("size")).unpivot("n_nationkey", ["name", "region", "size"], "field", "expected")
    name = F.when(F.col("n_nationkey") % 6 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    b = n.select("n_nationkey", name.alias("name"), text("n_regionkey").alias("region"), text("n_nationkey").alias("key")).unpivot("n_nationkey", ["name", "region", "key"], "field", "found")
    return a.join(b, ["n_nationkey", "field"], "full").withColumn("equal", F.col("expected").eqNullSafe(F.col("found")))


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("SELECT '{\"customers\":' || (SELECT count(*) FROM customer) || ',\"orders\":' || (SELECT count(*) FROM orders) || ',\"tables\":[\"customer\",\"orders\"]}' AS report")
def sorted_report(spark, sf_dir):
    """One JSON document with its keys in order."""
    counts = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers")).crossJoin(table(spark, sf_dir, "orders").agg(F.count("*").alias("orders")))
    return counts.select(F.to_json(F.struct("customers", "orders", F.array(F.lit("customer"), F.lit("orders")).alias("tables"))).alias("report"))


@query("SELECT sha256(n_name) || '  ' || n_name AS value FROM nation")
def manifest_lines(spark, sf_dir):
    """Digests and names, written as lines of text and read again."""
    path = files.scratch(spark, "manifest")
    table(spark, sf_dir, "nation").select(F.concat_ws("  ", F.sha2("n_name", 256), "n_name").alias("value")).write.text(path)
    return spark.read.text(path)


@query("SELECT n_nationkey, n_name, n_regionkey, true AS complete FROM nation")
def tsv_roundtrip(spark, sf_dir):
    """Written with tabs and a header, read with a declared schema; the number of rows must be that written."""
    path, given = files.scratch(spark, "tsv"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    given.write.csv(path, sep="\t", header=True)
    back = documents.read_tsv(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    counts = back.agg(F.count("*").alias("b")).crossJoin(given.agg(F.count("*").alias("g"))).select((F.col("b") == F.col("g")).alias("complete"))
    return back.crossJoin(F.broadcast(counts))


@query("SELECT r_regionkey::VARCHAR AS key, r_name AS name FROM region")
def pairs_scan(spark, sf_dir):
    path = files.scratch(spark, "pairs")
    table(spark, sf_dir, "region").select(F.format_string("key=%d;name=%s", "r_regionkey", "r_name").alias("value")).write.text(path)
    return documents.read_pairs(spark, path).select(F.col("pairs")["key"].alias("key"), F.col("pairs")["name"].alias("name"))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT sha256(p_name)) AS keys FROM part GROUP BY 1")
def cached_results(spark, sf_dir):
    """A cache by content filled in two runs: the second adds only what the first lacks."""
    path = files.scratch(spark, "cache")
    results = table(spark, sf_dir, "part").select("p_partkey", F.sha2("p_name", 256).alias("input"), "p_brand")
    files.write_cache(spark, results.where("p_size <= 25"), path, ["p_partkey", "input"])
    both = files.write_cache(spark, results, path, ["p_partkey", "input"])
    return both.groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("input").alias("keys"))


@query("SELECT conv_id, text AS found FROM conversations WHERE turn = 1")
def nested_search(spark, sf_dir):
    """Turns as nested JSON documents, searched for those with id 1."""
    turns = F.array(F.struct(F.col("turn").alias("id"), "text")).alias("turns")
    raw = table(spark, sf_dir, "conversations").select("conv_id", F.to_json(F.struct(F.struct(turns).alias("body"))).alias("raw"))
    inner = F.from_json("raw", "body struct<turns: array<struct<id: long, text: string>>>")
    return raw.select("conv_id", F.explode(inner["body"]["turns"]).alias("t")).where("t.id = 1").select("conv_id", F.col("t.text").alias("found"))


@query("SELECT n_nationkey, 'npy' AS format, (n_nationkey + 1)::BIGINT AS width, 3::BIGINT AS height, (n_nationkey + 1)::BIGINT AS n_columns, n_nationkey::DOUBLE AS mean FROM nation")
def numpy_files(spark, sf_dir):
    """Arrays written as .npy, sniffed and read."""

    @F.pandas_udf("binary")
    def made(key):
        out = []
        for k in key:
            stream = io.BytesIO()
            np.save(stream, np.full((3, int(k) + 1), float(k)))
            out.append(stream.getvalue())
        return key.__class__(out)

    found = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("path"), made("n_nationkey").alias("content"))
    told = files.sniffed(found).join(files.arrays(found), "path")
    return told.select("n_nationkey", "format", "width", "height", "n_columns", "mean")


# --- images -------------------------------------------------------------------------------------------------------


def _pages(spark, sf_dir):
    """A small gray page for each nation: lines of marks, some with a light or a dark spot, as PNG."""

    @F.pandas_udf("binary")
    def drawn(key):
        return key.__class__([files.encode_png(imaging.specimen(int(k))) for k in key])

    return table(spark, sf_dir, "nation").select("n_nationkey", drawn("n_nationkey").alias("content"))


@query()
def image_quality(spark, sf_dir):
    """Sharpness, exposure, glare, ink, line candidates and periodicity of each page, and the gate's reasons."""
    measured = imaging.measured(_pages(spark, sf_dir), "content")
    rules = [gates.Rule("sharpness", ">=", 20.0, "BLURRED"), gates.Rule("mean", ">=", 90.0, "DARK"), gates.Rule("glare", "<=", 0.05, "GLARE"), gates.Rule("lines", ">=", 4, "FEW_LINES")]
    return gates.gate(measured, rules).select("n_nationkey", *(F.round(c, 6).alias(c) for c in imaging.METRICS), "status", F.array_join("reasons", ",").alias("reasons"))


@query()
def image_formats(spark, sf_dir):
    return files.sniffed(_pages(spark, sf_dir)).select("n_nationkey", "format", "width", "height")
