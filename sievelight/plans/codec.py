"""Queries of text codes, budgets and scalar functions (E of the survey, A22, A23, A30, C9, C10, C21)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import reed_solomon, strings
from .registry import ORACLE, query, seconds, table

_A = strings.ALPHABET
_BITS = "array_to_string(list_transform(range(1, 65), lambda k: lpad(bin(('0x' || substr(h, k::INT, 1))::INT), 4, '0')), '') || '0000'"
_VALUES = "list_transform(range(0, 52), lambda k: list_sum(list_transform(range(0, 5), lambda j: substr(bits, (1 + 5 * k + j)::INT, 1)::INT * (16 >> j::INT)))::BIGINT)"
_TOKENS = f"WITH b AS (SELECT doc_id, {_BITS} AS bits FROM (SELECT doc_id, sha256(text) AS h FROM documents)), v AS (SELECT doc_id, {_VALUES} AS v FROM b), t AS (SELECT doc_id, v, array_to_string(list_transform(v, lambda x: substr('{_A}', (1 + x)::INT, 1)), '') AS token FROM v)\n"


def _values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.five_bits(F.sha2("text", 256), 32).alias("v"))


_WRAPPED = "upper(substr(token, 1, 20)) || chr(10) || substr(token, 21)"
_PAGE = f"CASE doc_id % 4 WHEN 0 THEN 'ob cv0' || {_WRAPPED} WHEN 1 THEN '-- c?0' || {_WRAPPED} WHEN 2 THEN {_WRAPPED} || 'xyz' ELSE substr(token, 1, 40) END"


@query(
    _TOKENS
    + f""", p AS (SELECT doc_id, lower(regexp_replace({_PAGE}, '\\s', '', 'g')) AS s FROM t),
r AS (SELECT doc_id, unnest(regexp_extract_all(s, '[{_A}?]+')) AS r, generate_subscripts(regexp_extract_all(s, '[{_A}?]+'), 1) AS k FROM p),
x AS (SELECT *, list_filter(range(1, length(r) - 1), lambda i: substr(r, i::INT, 3) = 'cv0') AS e, list_filter(range(1, greatest(1, length(r) - 53)), lambda i: regexp_full_match(substr(r, i::INT, 3), '[c?][v?][0?]') AND substr(r, i::INT, 3) <> '???') AS l FROM r),
f AS (SELECT *, CASE WHEN len(e) > 0 THEN list_filter(e, lambda i: i <= length(r) - 54) ELSE l END AS pos FROM x),
m AS (SELECT doc_id, arg_min(substr(r, pos[1]::INT, 55), k) FILTER (len(pos) > 0) AS marked, arg_min(right(r, 55), k) FILTER (length(r) >= 55) AS tail FROM f GROUP BY 1)
SELECT doc_id, coalesce(marked, tail) AS token, CASE WHEN marked IS NOT NULL THEN 'sentinel' WHEN tail IS NOT NULL THEN 'length-run' END AS method FROM documents LEFT JOIN m USING (doc_id)"""
)
def token_extract(spark, sf_dir):
    """Tokens of the documents' digests, wrapped, behind a whole sentinel, one with an erasure, none, or too short."""
    token = strings.symbols(F.col("v"))
    wrapped = F.concat(F.upper(F.substring("t", 1, 20)), F.lit("\n"), F.expr("substr(t, 21)"))
    page = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("ob cv0"), wrapped)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("-- c?0"), wrapped))
    page = page.when(F.col("doc_id") % 4 == 2, F.concat(wrapped, F.lit("xyz"))).otherwise(F.substring("t", 1, 40))
    pages = _values(spark, sf_dir).select("doc_id", token.alias("t")).select("doc_id", page.alias("p"))
    return pages.select("doc_id", strings.extract_token(F.col("p"), "cv0", 55).alias("x")).select("doc_id", "x.token", "x.method")


def _step(c: str, v: str) -> str:
    """One step of the checksum in SQL."""
    out = f"xor(({c} & 33554431) << 5, {v})"
    for k, g in enumerate(strings.GENERATOR):
        out = f"xor({out}, ((({c} >> 25) >> {k}) & 1) * {g})"
    return out


_FOLD = f"list_reduce(list_prepend(1::BIGINT, {{}}), lambda c, x: {_step('c', 'x')})"
ORACLE["bech32_checksum"] = _TOKENS + f"SELECT doc_id, {_FOLD.format('v')} AS polymod FROM v"


@query(
    _TOKENS
    + f""", m AS (SELECT doc_id, v, xor({_FOLD.format("list_concat([3, 3, 0, 3, 22]::BIGINT[], list_concat(v, [0, 0, 0, 0, 0, 0]::BIGINT[]))")}, 1) AS m FROM v),
w AS (SELECT doc_id, list_concat(v, list_transform(range(0, 6), lambda k: (m >> (5 * (5 - k))::INT) & 31)) AS w FROM m)
SELECT doc_id, array_to_string(list_transform(w, lambda x: substr('{_A}', (1 + x)::INT, 1)), '') AS token,
{_FOLD.format("list_concat([3, 3, 0, 3, 22]::BIGINT[], w)")} = 1 AS holds, false AS damaged_holds FROM w"""
)
def bech32_token(spark, sf_dir):
    """Tokens with the checksum over the prefix; one changed symbol always breaks it."""
    coded = _values(spark, sf_dir).select("doc_id", strings.with_checksum(F.col("v"), "cv").alias("w"))
    spoilt = F.transform("w", lambda x, k: F.when(k == F.pmod(F.col("doc_id"), F.lit(58)), (x + 1) % 32).otherwise(x))
    return coded.select("doc_id", strings.symbols(F.col("w")).alias("token"), strings.checksum_holds(F.col("w"), "cv").alias("holds"), strings.checksum_holds(spoilt, "cv").alias("damaged_holds"))


@query(
    """WITH c AS (SELECT l_suppkey, year(l_shipdate)::INT AS year, ((l_orderkey * 7 + l_linenumber * 31) % 133)::BIGINT AS idx, CASE WHEN l_quantity <= 10 THEN 'e' WHEN l_discount >= 0.1 THEN 'w' ELSE 'c' END AS cls FROM lineitem),
b AS (SELECT DISTINCT l_suppkey, year, cls, unnest([idx * 5 // 8, (idx * 5 + 4) // 8]) AS byte FROM c WHERE cls <> 'c'),
s AS (SELECT l_suppkey, year, byte, bool_or(cls = 'e') AS erased FROM b WHERE byte < 83 GROUP BY ALL),
k AS (SELECT l_suppkey, year, count_if(cls = 'c') AS c, count_if(cls = 'e') AS e, count_if(cls = 'w') AS w FROM c GROUP BY ALL)
SELECT l_suppkey, year, c, e, w, coalesce(count_if(NOT erased), 0) AS err_bytes, coalesce(count_if(erased), 0) AS era_bytes, 2 * coalesce(count_if(NOT erased), 0) + coalesce(count_if(erased), 0) > 34 AS over
FROM k LEFT JOIN s USING (l_suppkey, year) GROUP BY l_suppkey, year, c, e, w"""
)
def budget_accounting(spark, sf_dir):
    """A supplier's line items of a year as the cells of a token: erased bytes, wrong bytes that aren't erased, and whether 2E + e passes 34."""
    cls, token = F.when(F.col("l_quantity") <= 10, "e").when(F.col("l_discount") >= 0.1, "w").otherwise("c"), ["l_suppkey", "year"]
    year = F.year(F.timestamp_seconds(seconds("l_shipdate")))
    cells = table(spark, sf_dir, "lineitem").select("l_suppkey", year.alias("year"), F.expr("(l_orderkey * 7 + l_linenumber * 31) % 133").alias("idx"), cls.alias("cls"))
    counts = cells.groupBy(*token).agg(*(F.count_if(F.col("cls") == x).alias(x) for x in "cew"))
    touched = cells.where("cls <> 'c'").select(*token, "cls", F.explode(strings.touched_bytes(F.array("idx"), 83)).alias("byte"))
    state = touched.groupBy(*token, "byte").agg(F.bool_or(F.col("cls") == "e").alias("erased"))
    sums = state.groupBy(*token).agg(F.count_if(~F.col("erased")).alias("err_bytes"), F.count_if("erased").alias("era_bytes"))
    out = counts.join(sums, token, "left").fillna(0, ["err_bytes", "era_bytes"])
    return out.withColumn("over", 2 * F.col("err_bytes") + F.col("era_bytes") > 34)


@query(
    _TOKENS
    + """, d AS (SELECT doc_id, v, list_transform(v, lambda x, k: CASE WHEN k - 1 = doc_id % 52 OR k - 1 = (doc_id * 7) % 52 THEN xor(x, 1 + doc_id % 31) ELSE x END) AS w FROM v),
y AS (SELECT doc_id, array_to_string(list_transform(v, lambda x: lpad(bin(x), 5, '0')), '') AS p, array_to_string(list_transform(w, lambda x: lpad(bin(x), 5, '0')), '') AS q FROM d)
SELECT doc_id, len(list_filter(range(0, 32), lambda k: substr(p, (8 * k + 1)::INT, 8) <> substr(q, (8 * k + 1)::INT, 8)))::INT AS exact,
len(list_distinct(list_filter(list_concat([(doc_id % 52) * 5 // 8, ((doc_id % 52) * 5 + 4) // 8], [((doc_id * 7) % 52) * 5 // 8, (((doc_id * 7) % 52) * 5 + 4) // 8]), lambda x: x < 32)))::INT AS nominal FROM y"""
)
def byte_audit(spark, sf_dir):
    """Bytes that truly differ after two symbols changed, and the upper bound from their places."""
    at = F.array(F.pmod("doc_id", F.lit(52)), F.pmod(F.col("doc_id") * 7, F.lit(52)))
    damaged = F.transform("v", lambda x, k: F.when(F.array_contains(at, k.cast("long")), x.bitwiseXOR((1 + F.col("doc_id") % 31).cast("int"))).otherwise(x))
    return _values(spark, sf_dir).select("doc_id", strings.differing_bytes(F.col("v"), damaged, 32).alias("exact"), F.size(strings.touched_bytes(at, 32)).alias("nominal"))


@query("SELECT doc_id, array_to_string(list_transform(range(0, 64), lambda k: substr(h, ((k * 9) % 64 + 1)::INT, 1)), '') AS mixed, true AS back FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def interleave_roundtrip(spark, sf_dir):
    letters = F.filter(F.split(F.sha2("text", 256), ""), lambda c: c != "")
    mixed = table(spark, sf_dir, "documents").select("doc_id", letters.alias("a")).withColumn("m", strings.interleaved(F.col("a"), 64))
    return mixed.select("doc_id", F.array_join("m", "").alias("mixed"), (strings.interleaved(F.col("m"), 64, back=True) == F.col("a")).alias("back"))


@query("SELECT p_partkey, ceil(0.3 * p_size)::BIGINT AS parity FROM part")
def legacy_parity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("(3 * p_size + 9) div 10").alias("parity"))


@query()
def damage_sweep(spark, sf_dir):
    """Share of decoded words by damage model, size of the damage and parity over 200 seeds; no model ever gives wrong data."""

    @F.pandas_udf("ok boolean, load long")
    def run(model: pd.Series, size: pd.Series, parity: pd.Series, seed: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"ok": False, "load": 0}, index=model.index)
        for p, rows in pd.DataFrame({"m": model, "s": size, "p": parity, "r": seed}).groupby("p"):
            n = 49 + int(p)
            data = np.stack([np.random.default_rng([int(r), 1]).integers(0, 256, 49) for r in rows.r])
            words, lost, bad = reed_solomon.encode_rows(data, int(p)), np.zeros((len(rows), n), bool), np.zeros((len(rows), n), bool)
            for k, (m, s, r) in enumerate(zip(rows.m, rows.s, rows.r, strict=True)):
                rng = np.random.default_rng([int(r), int(s), len(m)])
                if m == "scratch":  # one run of unreadable bytes
                    begin = int(rng.integers(0, n - s + 1))
                    lost[k, begin : begin + s] = True
                else:  # single bytes, unreadable or misread
                    (lost if m == "fade" else bad)[k, rng.choice(n, s, replace=False)] = True
            ok, back = reed_solomon.decode_rows(np.where(bad, words ^ 0x5A, words), lost, int(p))
            out.loc[rows.index, "ok"] = ok & (back == data).all(1)
            out.loc[rows.index, "load"] = 2 * bad.sum(1) + lost.sum(1)
        return out

    grid = spark.range(200).withColumnRenamed("id", "seed").withColumn("model", F.explode(F.array(*map(F.lit, ("scratch", "fade", "smudge")))))
    grid = grid.withColumn("size", F.explode(F.array(*map(F.lit, (4, 8, 16, 17, 24, 34))))).withColumn("parity", F.explode(F.array(F.lit(16), F.lit(34)))).repartition(8, "seed")
    done = grid.withColumn("r", run("model", "size", "parity", "seed"))
    return done.groupBy("model", "size", "parity").agg(F.avg(F.col("r.ok").cast("int")).alias("success"), F.max("r.load").alias("load"), F.count("*").alias("n"))


@query("SELECT t::BIGINT AS t, array_to_string(list_transform(range(0, 49), lambda j: lpad(lower(hex((16 * (t + 1) + j) % 256)), 2, '0')), '') AS pattern FROM range(0, 5) AS r(t)")
def pattern_tokens(spark, sf_dir):
    """Ground truth by byte pattern: (16 * (t + 1) + j) mod 256."""
    byte = lambda j: F.lower(F.lpad(F.hex(F.pmod((F.col("t") + 1) * 16 + j, F.lit(256))), 2, "0"))
    return spark.range(5).withColumnRenamed("id", "t").select("t", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(48)), byte), "").alias("pattern"))


# --- words, hashes, numbers ---------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), d AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '\\s+')) AS x FROM benchmark),
u AS (SELECT doc_id, count(DISTINCT x) AS unknown FROM (SELECT doc_id, unnest(w) AS x FROM w) LEFT JOIN d USING (x) WHERE d.x IS NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS words, round(CASE WHEN len(w) > 0 THEN 110.0::DOUBLE / len(w) END, 6) AS bits_a_word, len(w) = 24 AS is_24, coalesce(unknown, 0) AS unknown FROM w LEFT JOIN u USING (doc_id)"""
)
def word_stats(spark, sf_dir):
    """Words, bits a word of a payload of 110 bits, the check for 24 words, and different words that the list lacks."""
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", split(F.col("text")).alias("w"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(split(F.col("text"))).alias("x")).distinct().withColumn("known", F.lit(True))
    unknown = docs.select("doc_id", F.explode(F.array_distinct("w")).alias("x")).join(known, "x", "left_anti").groupBy("doc_id").agg(F.count("*").alias("unknown"))
    n = F.size("w").cast("long")
    made = docs.select("doc_id", n.alias("words"), F.round(F.try_divide(F.lit(110.0), n), 6).alias("bits_a_word"), (n == 24).alias("is_24"))
    return made.join(unknown, "doc_id", "left").fillna(0, ["unknown"])


@query("SELECT doc_id, substr(sha256(text), 1, 16) || '-' || substr(md5(text), 1, 8) || '-v1' AS key FROM documents")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", F.substring(F.sha2("text", 256), 1, 16), F.substring(F.md5("text"), 1, 8), F.lit("v1")).alias("key"))


@query("SELECT p_partkey, lower(hex(encode(p_name))) AS hexed, p_partkey % 3 <> 0 AS valid, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS back FROM part")
def hex_roundtrip(spark, sf_dir):
    """Strict hex: an odd number of digits or another letter is no value."""
    h = F.lower(F.hex(F.encode("p_name", "utf-8")))
    given = F.when(F.col("p_partkey") % 3 == 0, F.concat(h, F.lit("z"))).otherwise(h)
    valid = given.rlike("^([0-9a-f]{2})*$")
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("hexed"), valid.alias("valid"), F.when(valid, F.decode(F.unhex(given), "utf-8")).alias("back"))


@query("SELECT c_custkey, ('0x' || substr(sha256(c_name || ':0'), 1, 8))::BIGINT % 100 AS draw FROM customer WHERE ('0x' || substr(sha256(c_name || ':0'), 1, 8))::BIGINT < 4294967200 UNION ALL SELECT c_custkey, ('0x' || substr(sha256(c_name || ':1'), 1, 8))::BIGINT % 100 FROM customer WHERE ('0x' || substr(sha256(c_name || ':0'), 1, 8))::BIGINT >= 4294967200")
def counter_stream(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", strings.counted_int(F.col("c_name"), 100).alias("draw"))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('7:' || p_partkey), p_partkey) AS place FROM part")
def seeded_shuffle(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("p_partkey").cast("string")), 256), "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT c_custkey, floor((2 * x + 7) / 14.0)::BIGINT AS seventh, greatest(-5000, least(5000, x)) AS clamped, floor(sqrt(abs(x)::DOUBLE))::BIGINT AS root FROM (SELECT c_custkey, round(c_acctbal * 100)::BIGINT AS x FROM customer)")
def integer_math(spark, sf_dir):
    """Half-up division (of negatives, too), clamping, integer roots."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("x"))
    return rows.select("c_custkey", strings.half_up_div(F.col("x"), 7).alias("seventh"), strings.clamp(F.col("x"), -5000, 5000).alias("clamped"), strings.isqrt(F.abs("x")).alias("root"))


@query("SELECT p_brand, sum(floor(log2(n)))::BIGINT AS bits FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1")
def capacity_bits(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return counts.groupBy("p_brand").agg(F.sum(F.floor(F.log2("n"))).alias("bits"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS written, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS day FROM orders")
def dates(spark, sf_dir):
    """Days written as dd/mm/yyyy and read again; another order of the parts is no date."""
    written = F.date_format(F.timestamp_seconds(seconds("o_orderdate")), "dd/MM/yyyy")
    read = F.to_date(F.try_to_timestamp("written", F.lit("dd/MM/yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written")).select("o_orderkey", "written", F.unix_date(read).cast("long").alias("day"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS top, list_transform(embedding[1:3], lambda x: round(x::DOUBLE, 5))::VARCHAR = list_transform(embedding[1:3], lambda x: round(x::DOUBLE, 5))::VARCHAR AS same, 70 - len(embedding) AS padding FROM embeddings")
def array_ops(spark, sf_dir):
    """Index of the greatest, a slice, padding to 70."""
    padded = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 70 - F.size("embedding")))
    top = F.array_position("embedding", F.array_max("embedding")) - 1
    return table(spark, sf_dir, "embeddings").select("vec_id", top.alias("top"), (F.slice(padded, 1, 3) == F.slice("embedding", 1, 3)).alias("same"), F.size(F.slice(padded, F.size("embedding") + 1, 70)).cast("long").alias("padding"))


@query("SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS settings FROM (SELECT user_id, event_type, arg_max(event_id, event_id) AS v FROM events GROUP BY ALL) GROUP BY 1")
def map_last_wins(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("v"))
    made = last.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "v")))).alias("m"))
    return made.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ";").alias("settings"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k') IS NOT NULL AS has_k, (props->>'$.none') IS NOT NULL AS has_none FROM events")
def json_presence(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.try_to_number(k, F.lit("999999999")).cast("long").alias("k"), k.isNotNull().alias("has_k"), F.get_json_object("props", "$.none").isNotNull().alias("has_none"))


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: round(greatest(-1, least(1, v)) * 100)::BIGINT) AS q FROM embeddings),
t AS (SELECT label AS cls, k, floor((2 * sum(v) + count(*)) / (2.0 * count(*)))::BIGINT AS m FROM (SELECT label, unnest(range(1, 65)) AS k, unnest(q) AS v FROM e) GROUP BY ALL),
a AS (SELECT cls, list(m ORDER BY k) AS m FROM t GROUP BY 1),
d AS (SELECT vec_id, cls, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, a),
r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d)
SELECT vec_id, CASE WHEN count(*) = 1 THEN min(cls) END AS symbol, round(1 - min(d) / 64.0 / 65025, 9) AS confidence FROM r WHERE k = 1 GROUP BY 1"""
)
def template_confidence(spark, sf_dir):
    """The class whose integer template has the least mean squared error; an exact tie has no symbol. Templates: a row per class."""
    q = F.transform("embedding", lambda v: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))) * 100).cast("long"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", q.alias("q"))
    means = e.select("label", F.posexplode("q").alias("k", "v")).groupBy("label", "k").agg(F.floor((2 * F.sum("v") + F.count("*")) / (2 * F.count("*"))).alias("m"))
    templates = means.groupBy(F.col("label").alias("cls")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("t"))
    listed = templates.agg(F.collect_list(F.struct("cls", F.col("t.m").alias("m"))).alias("all"))
    error = lambda t: F.aggregate(F.zip_with("q", t.m, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    scored = e.crossJoin(F.broadcast(listed)).select("vec_id", F.transform("all", lambda t: F.struct(error(t).alias("d"), t.cls.alias("cls"))).alias("s"))
    best = F.filter("s", lambda x: x.d == F.array_min(F.transform("s", lambda y: y.d)))
    return scored.select("vec_id", best.alias("b")).select("vec_id", F.when(F.size("b") == 1, F.col("b")[0].cls).alias("symbol"), F.round(1 - F.col("b")[0].d / 64.0 / 65025, 9).alias("confidence"))


@query("SELECT doc_id, xor(a, b) AS other, xor(xor(a, b), b) = a AS rejoined FROM (SELECT doc_id, ('0x' || substr(sha256(text), 1, 12))::BIGINT AS a, ('0x' || substr(md5(text), 1, 12))::BIGINT AS b FROM documents)")
def xor_shares(spark, sf_dir):
    """A secret split into a pad and its exclusive or; both together give it back."""
    number = lambda h: F.conv(F.substring(h, 1, 12), 16, 10).cast("long")
    pair = table(spark, sf_dir, "documents").select("doc_id", number(F.sha2("text", 256)).alias("a"), number(F.md5("text")).alias("b"))
    other = F.col("a").bitwiseXOR(F.col("b"))
    return pair.select("doc_id", other.alias("other"), (other.bitwiseXOR(F.col("b")) == F.col("a")).alias("rejoined"))
