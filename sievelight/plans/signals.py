"""Queries of windows, order statistics, sets and top-k over series (W, A, T, U and J of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series
from .catalog import _DAILY, _daily
from .registry import query, seconds, table

# --- daily and hourly series --------------------------------------------------------------------------------------


@query(
    _DAILY
    + """, m AS (SELECT avg(n) AS mean FROM d), f AS (SELECT day, n >= mean * 1.5 AS s, n >= mean * 1.1 AS l FROM d, m),
r AS (SELECT *, sum(CASE WHEN l AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (ORDER BY day) AS run FROM (SELECT *, lag(l) OVER (ORDER BY day) AS p FROM f))
SELECT min(day) AS first, max(day) AS last, count(*) AS length, count_if(s) AS seeds FROM r WHERE l GROUP BY run HAVING count_if(s) > 0"""
)
def hysteresis_growth(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    both = daily.crossJoin(F.broadcast(daily.agg(F.avg("n").alias("mean"))))
    return series.hysteresis(both, "day", F.col("n") >= F.col("mean") * 1.5, F.col("n") >= F.col("mean") * 1.1)


@query(
    """WITH g AS (SELECT l_quantity::BIGINT AS x, round(l_discount * 100)::BIGINT AS y, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT a.x, a.y, a.n, ((2 * sum(b.n) + count(*)) // (2 * count(*)))::BIGINT AS mean FROM g a JOIN g b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL"""
)
def box_mean_2d(spark, sf_dir):
    """The grid of quantity and discount, whose every cell has rows."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y")).agg(F.count("*").alias("n"))
    return series.box_mean(cells, "x", "y", "n", 2)


@query(_DAILY + "SELECT a.i::BIGINT AS i, sum(b.n)::BIGINT AS mass FROM i a JOIN i b ON b.i BETWEEN a.i AND a.i + 6 GROUP BY a.i HAVING count(*) = 7")
def range_mass(spark, sf_dir):
    return series.range_mass(_daily(spark, sf_dir).withColumn("i", F.col("i").cast("long")), "i", "n", 7)


@query(
    _DAILY
    + """, r AS (SELECT day, n, n - quantile_cont(n, 0.5) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS residual FROM d),
m AS (SELECT median(residual) AS m FROM r), a AS (SELECT median(abs(residual - m)) * 1.4826 AS mad FROM r, m)
SELECT day, n, residual::DOUBLE AS residual, abs(residual - m) > mad * 3.0 AS outlier FROM r, m, a"""
)
def mad_outliers(spark, sf_dir):
    return series.mad_outliers(_daily(spark, sf_dir), "day", "n", 7, 3.0)


@query(
    """WITH m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN abs(p_retailprice - m) > abs(m) * 0.2 THEN CASE WHEN p_retailprice < m THEN 'BELOW_MEDIAN' ELSE 'ABOVE_MEDIAN' END END AS reason FROM part JOIN m USING (p_brand)"""
)
def median_reject(spark, sf_dir):
    return series.median_reject(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 0.2).select("p_partkey", "reason")


@query(
    """WITH m AS (SELECT s_nationkey, median(s_acctbal) AS m FROM supplier GROUP BY 1),
c AS (SELECT s_suppkey, s_acctbal AS x, m, unnest([s_acctbal / 2, s_acctbal, s_acctbal * 2]) AS c FROM supplier JOIN m USING (s_nationkey)),
b AS (SELECT s_suppkey, x, m, (arg_min(c, (abs(c - m), c))) AS near FROM c GROUP BY ALL)
SELECT s_suppkey, round(CASE WHEN abs(x - m) > m * 0.15 THEN near ELSE x END, 4) AS selected FROM b"""
)
def neighbour_agreement(spark, sf_dir):
    """Half, whole and double of a balance stand for the pitches between which a reader may err."""
    x = F.col("s_acctbal")
    rows = table(spark, sf_dir, "supplier").withColumn("c", F.array(x / 2, x, x * 2))
    return series.agree_with_neighbours(rows, "s_nationkey", "s_acctbal", "c", 0.15).select("s_suppkey", F.round("selected", 4).alias("selected"))


_HOURLY = "WITH e AS (SELECT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS hour FROM events), z AS (SELECT event_type, hour - (SELECT min(hour) FROM e) AS hour FROM e), h AS (SELECT event_type, hour, count(*) AS n FROM z GROUP BY ALL), a AS (SELECT hour, sum(n)::BIGINT AS n FROM h GROUP BY 1)\n"


def _hourly(spark, sf_dir):
    hours = table(spark, sf_dir, "events").select("event_type", F.floor(seconds("ts") / 3600).cast("long").alias("hour"))
    first = hours.agg(F.min("hour").alias("first"))
    return hours.crossJoin(F.broadcast(first)).groupBy("event_type", (F.col("hour") - F.col("first")).alias("hour")).agg(F.count("*").alias("n"))


@query(
    _HOURLY
    + """SELECT s.start::BIGINT AS start, count(*) AS n, round(atan2(sum(a.n * sin(hour * 2 * pi() / 24)), sum(a.n * cos(hour * 2 * pi() / 24))), 6) AS phase,
round(sqrt(pow(sum(a.n * sin(hour * 2 * pi() / 24)), 2) + pow(sum(a.n * cos(hour * 2 * pi() / 24)), 2)), 6) AS weight
FROM a, range(0, 100000, 24) AS s(start) WHERE hour >= s.start AND hour < s.start + 48 GROUP BY 1"""
)
def hopping_phase(spark, sf_dir):
    total = _hourly(spark, sf_dir).groupBy("hour").agg(F.sum("n").alias("n"))
    return series.hopping_phase(total, "hour", "n", size=48, hop=24, period=24).select("start", "n", F.round("phase", 6).alias("phase"), F.round("weight", 6).alias("weight"))


@query()
def smoothed_series(spark, sf_dir):
    return series.smooth(_hourly(spark, sf_dir), "event_type", "hour", "n", 4.0)


_DEPTH = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


@query(
    f"""WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AND value > 150 AS ok, {_DEPTH} AS depth FROM events)
SELECT user_id, coalesce(min(event_id) FILTER (ok), arg_max(event_id, (depth, -event_id))) AS event_id, bool_or(ok) AS success FROM e GROUP BY 1"""
)
def first_success(spark, sf_dir):
    return series.first_success(table(spark, sf_dir, "events"), "user_id", "event_id", F.expr("event_type = 'purchase' AND value > 150"), F.expr(_DEPTH))


@query(
    """WITH d AS (SELECT (epoch_us(o_orderdate) // 86400000000)::BIGINT AS day, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
e AS (SELECT unnest(range((SELECT min(day) FROM d), (SELECT max(day) + 1 FROM d))) AS day),
f AS (SELECT e.day, d.n, max(d.day) OVER (ORDER BY e.day) AS a, min(d.day) OVER (ORDER BY e.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e LEFT JOIN d ON d.day = e.day)
SELECT f.day, round(coalesce(f.n::DOUBLE, x.n + (y.n - x.n) * (f.day - f.a) / (f.b - f.a)), 6) AS n, f.n IS NULL AS filled FROM f JOIN d x ON x.day = f.a JOIN d y ON y.day = f.b"""
)
def gap_fill(spark, sf_dir):
    day = F.floor(seconds("o_orderdate") / 86400).cast("long")
    daily = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return series.fill_gaps(daily, "day", "n").select("day", F.round("n", 6).alias("n"), "filled")


# --- aggregates ---------------------------------------------------------------------------------------------------

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"SELECT metric, round(quantile_cont(v, 0.25), 6) AS p25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75 FROM (UNPIVOT (SELECT {', '.join(_NUMBERS)} FROM lineitem) ON COLUMNS(*) INTO NAME metric VALUE v) GROUP BY 1")
def numeric_quartiles(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").select(*_NUMBERS).unpivot([], list(_NUMBERS), "metric", "v")
    found = series.quantiles(long, "metric", "v", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return found.select("metric", *(F.round(c, 6).alias(c) for c in ("p25", "median", "p75")))


@query("SELECT * FROM (SELECT p_type, p_brand, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS place FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)) WHERE place <= 3")
def top_common(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("n"), "p_brand")).cast("long")
    return counts.withColumn("place", place).where("place <= 3")


@query(
    """WITH e AS (SELECT label, unnest(range(1, 65)) AS k, unnest(list_transform(embedding, lambda v: round(v * 1000)::BIGINT + 4000)) AS v FROM embeddings)
SELECT label, (k - 1)::BIGINT AS k, ((2 * sum(v) + count(*)) // (2 * count(*)))::BIGINT - 4000 AS mean FROM e GROUP BY ALL"""
)
def class_mean_int(spark, sf_dir):
    """Integer templates: half-up means of scaled components, moved above zero for the division."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.round(F.col("v") * 1000).cast("long") + 4000)
    return parts.groupBy("label", F.col("k").cast("long").alias("k")).agg(F.sum("v").alias("s"), F.count("*").alias("n")).select("label", "k", F.expr("(2 * s + n) div (2 * n) - 4000").alias("mean"))


@query("SELECT n_regionkey, list_sort(list(a))[2] AS median_key, list_sort(list(b))[2] AS median_length FROM (SELECT n_regionkey, n_nationkey AS a, length(n_name) AS b, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) WHERE k <= 3 GROUP BY 1 HAVING count(*) = 3")
def median_of_three(spark, sf_dir):
    """Field by field over exactly three realisations, the first nations of a region; other groups are no result."""
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.length("n_name").cast("long").alias("length"), k.alias("k")).where("k <= 3")
    three = rows.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("a"), F.sort_array(F.collect_list("length")).alias("b")).where("size(a) = 3")
    return three.select("n_regionkey", F.col("a")[1].alias("median_key"), F.col("b")[1].alias("median_length"))


@query("SELECT l_shipdate::DATE::VARCHAR AS day, round(avg((l_quantity < 5)::INT), 6) AS low_tail, round(avg((l_quantity > 45)::INT), 6) AS high_tail FROM lineitem GROUP BY 1")
def tail_fractions(spark, sf_dir):
    share = lambda cond: F.round(F.avg(cond.cast("int")), 6)
    day = F.date_format(F.timestamp_seconds(seconds("l_shipdate")), "yyyy-MM-dd")
    return table(spark, sf_dir, "lineitem").groupBy(day.alias("day")).agg(share(F.col("l_quantity") < 5).alias("low_tail"), share(F.col("l_quantity") > 45).alias("high_tail"))


@query("SELECT l_returnflag, ((2 * sum(x) * 65536 + sum(w) * 50) // (2 * sum(w) * 50))::BIGINT AS x_q16, count(*) AS n FROM (SELECT l_returnflag, (l_quantity * l_linenumber)::BIGINT AS x, l_linenumber::BIGINT AS w FROM lineitem) GROUP BY 1")
def centroid_q16(spark, sf_dir):
    """Weighted centroid of quantity on a scale of 50, in 1/65536, half up."""
    w = F.col("l_linenumber").cast("long")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum((F.col("l_quantity") * w).cast("long")).alias("x"), F.sum(w).alias("w"), F.count("*").alias("n"))
    return sums.select("l_returnflag", F.expr("(2 * x * 65536 + w * 50) div (2 * w * 50)").alias("x_q16"), "n")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, count(*) = 12 AS balanced FROM customer GROUP BY ALL")
def design_balance(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).withColumn("balanced", F.col("n") == 12)


@query("SELECT sha256(string_agg(sha256(n_nationkey || ':' || n_name || ':' || n_regionkey), '' ORDER BY n_nationkey)) AS digest FROM nation")
def table_digest(spark, sf_dir):
    """A digest of the rows' digests in the order of the key."""
    row = F.sha2(F.concat_ws(":", "n_nationkey", "n_name", "n_regionkey"), 256)
    listed = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("h")))).alias("l"))
    return listed.select(F.sha2(F.array_join("l.h", ""), 256).alias("digest"))


@query("SELECT event_type, count(*) AS tests, count_if(value >= 50) AS passed, count_if(NOT value >= 50) AS failed, round(sum(value), 3) AS elapsed, bool_and(value >= 50) AS ok FROM events GROUP BY 1")
def group_rollup(spark, sf_dir):
    good = F.col("value") >= 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("tests"), F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"), F.round(F.sum("value"), 3).alias("elapsed"), F.bool_and(good).alias("ok")
    )


@query("SELECT s_nationkey, round(min(r), 6) AS least, round(median(r), 6) AS median, round(max(r), 6) AS greatest FROM (SELECT s_nationkey, s_acctbal / (1 + s_suppkey) AS r FROM supplier) GROUP BY 1")
def ratio_summary(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_acctbal") / (1 + F.col("s_suppkey"))).alias("r"))
    return r.groupBy("s_nationkey").agg(F.min("r").alias("a"), F.median("r").alias("b"), F.max("r").alias("c")).select("s_nationkey", *(F.round(x, 6).alias(y) for x, y in (("a", "least"), ("b", "median"), ("c", "greatest"))))


# --- top-k, sets, matches -----------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, (4 - k)::BIGINT AS line FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'click') WHERE k <= 3")
def last_three(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("k", k).where("k <= 3")
    return rows.select("user_id", "event_id", (4 - F.col("k")).cast("long").alias("line"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_scores(spark, sf_dir):
    """A report of the hundred greatest, ties by key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL),
b AS (SELECT a.p_brand, a.p_size, sum(x.n)::BIGINT AS members FROM c a JOIN c x ON a.p_brand = x.p_brand AND x.p_size BETWEEN a.p_size * 0.8 AND a.p_size * 1.25 GROUP BY ALL)
SELECT p_brand, p_size, members FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY members DESC, p_size) AS k FROM b) WHERE k = 1"""
)
def modal_band(spark, sf_dir):
    """The size whose band of ratios holds most parts of a brand; sizes are counted first, so the self-join is of counts."""
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    x = c.select("p_brand", F.col("p_size").alias("size"), F.col("n").alias("m"))
    band = c.join(x, "p_brand").where("size between p_size * 0.8 and p_size * 1.25").groupBy("p_brand", "p_size").agg(F.sum("m").alias("members"))
    return band.groupBy("p_brand").agg(F.max(F.struct("members", (-F.col("p_size")).alias("s"))).alias("m")).select("p_brand", (-F.col("m.s")).alias("p_size"), "m.members")


@query(
    _HOURLY
    + """, g AS (SELECT period, phase FROM range(6, 31, 6) AS p(period), range(0, 30) AS q(phase) WHERE phase < period),
s AS (SELECT period, phase, sum(n)::DOUBLE / count(*) AS score FROM g JOIN a ON hour % period = phase GROUP BY ALL)
SELECT period::BIGINT AS period, phase::BIGINT AS phase, round(score, 6) AS score FROM s ORDER BY score DESC, period, phase LIMIT 1"""
)
def grid_argmax(spark, sf_dir):
    """The period and phase of hours with the greatest mean count."""
    total = _hourly(spark, sf_dir).groupBy("hour").agg(F.sum("n").alias("n"))
    scored = total.withColumn("period", F.explode(F.expr("sequence(6L, 30L, 6L)"))).groupBy("period", (F.col("hour") % F.col("period")).alias("phase")).agg((F.sum("n") / F.count("*")).alias("score"))
    best = scored.agg(F.max(F.struct("score", (-F.col("period")).alias("p"), (-F.col("phase")).alias("q"))).alias("m"))
    return best.select((-F.col("m.p")).alias("period"), (-F.col("m.q")).alias("phase"), F.round("m.score", 6).alias("score"))


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, l_discount, -l_linenumber)) AS l_linenumber FROM lineitem GROUP BY 1")
def hypothesis_choice(spark, sf_dir):
    """The line with the greatest (quantity, discount), ties to the smaller number."""
    best = F.max_by("l_linenumber", F.struct("l_quantity", "l_discount", -F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("l_linenumber"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def keys_without_urgent_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct())


@query(
    """WITH u AS (SELECT user_id, event_type, 1 AS run, event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, 2, event_id, value FROM events WHERE event_id % 2 = 1)
SELECT user_id, event_type, arg_max(value, (run, event_id)) AS value FROM u GROUP BY ALL"""
)
def merge_last_wins(spark, sf_dir):
    """Two runs (even and odd ids) merged by key: the second run wins, within a run the later row."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    both = e.where("event_id % 2 = 0").withColumn("run", F.lit(1)).unionByName(e.where("event_id % 2 = 1").withColumn("run", F.lit(2)))
    return both.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("run", "event_id")).alias("value"))


@query("SELECT n_nationkey, min(s_suppkey) AS first_supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def first_match(spark, sf_dir):
    """A lookup that takes the first of several matches, by an explicit key."""
    first = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("first_supplier"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(first), "n_nationkey", "left")


@query(
    """WITH p AS (SELECT l_orderkey AS o, l_linenumber AS j, l_quantity AS q FROM lineitem)
SELECT a.o AS l_orderkey, a.j AS i, b.j AS j, c.j AS k FROM p a JOIN p b ON a.o = b.o AND a.j < b.j JOIN p c ON b.o = c.o AND b.j < c.j WHERE abs((c.q - b.q) - (b.q - a.q)) <= 1"""
)
def compatible_triples(spark, sf_dir):
    """Lines i < j < k of an order with even gaps of quantity; an order has few lines, so pairs stay few."""
    p = lambda x: table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias(x), F.col("l_quantity").alias(f"q{x}"))
    pairs = p("i").join(p("j"), "l_orderkey").where("i < j").join(p("k"), "l_orderkey").where("j < k")
    return pairs.where("abs((qk - qj) - (qj - qi)) <= 1").select("l_orderkey", "i", "j", "k")
