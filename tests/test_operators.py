import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import reed_solomon as rs
from sievelight.operators import gates, matching, scoring, series
from sievelight.sources.documents import check


def test_equality_passes(spark):
    df = spark.sql("select 0.5D score, 0.1D margin, 1 label, 1 pred")
    assert df.select(scoring.outcome(F.col("label"), F.col("pred"), F.col("score"), F.col("margin"), 0.5, 0.1)).first()[0] == "correct"


def test_single_class_has_a_runner_up_of_minus_one(spark):
    best = scoring.top2(spark.sql("select 1 qid, 7 cls, 0.4D score"), ["qid"]).first()
    assert best.pred == 7 and best.margin == pytest.approx(1.4)


def test_holdout_refuses_one_group(spark):
    rec = spark.sql("select 0 grp, 'correct' outcome")
    assert scoring.pooled_and_fold_mean(rec).first().status == "NEED_AT_LEAST_2_GROUPS"


def test_gate_keeps_the_order_of_reasons(spark):
    df = spark.sql("select 1D a, 9D b, cast(null as double) c")
    rules = [gates.Rule("b", "<=", 5, "B"), gates.Rule("a", ">=", 1, "A"), gates.Rule("c", ">=", 0, "C")]
    got = gates.gate(df, rules).first()
    assert got.reasons == ["B", "C"] and got.status == "RECAPTURE"


def test_policy_has_three_states(spark):
    df = spark.sql("select map('a', true, 'b', false) f")
    assert [df.select(gates.policy("f", k)).first()[0] for k in "abc"] == ["ALLOWED", "REFUSED", "MISSING"]


def test_lower_quantile_is_an_element(spark):
    df = spark.sql("select * from values ('a', 3.0), ('a', 1.0), ('a', 2.0), ('b', null), ('c', 5.0) t(g, v)")
    assert {(r.g, r.v) for r in series.lower_quantile(df, "g", "v", 3, 4).collect()} == {("a", 2.0), ("c", 5.0)}
    ranks = series.ranked(spark.range(1000).selectExpr("id % 3 g", "(id * 7919) % 1000 div 3 v"), "g", "v").collect()
    for g in range(3):
        own = sorted((r.place, r.v, r.n) for r in ranks if r.g == g)
        assert [p for p, *_ in own] == list(range(len(own))) and [v for _, v, _ in own] == sorted(v for _, v, _ in own) and {n for *_, n in own} == {len(own)}


def test_smooth_solves_the_system(spark):
    y = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(y)] + [("b", 0, 2.0)], "g string, i int, v double")
    got = {(r.g, r.i): r.smooth for r in series.smooth(df, "g", "i", "v", 2.0).collect()}
    path = np.diag([1.0, 2, 2, 2, 1]) - np.eye(5, k=1) - np.eye(5, k=-1)
    assert np.allclose([got["a", k] for k in range(5)], np.linalg.solve(np.eye(5) + 2 * path, y)) and got["b", 0] == pytest.approx(2.0)


def test_rows_of_code_words_decode_as_single_ones():
    r = np.random.default_rng(5)
    for parity in (4, 16, 34):
        data = r.integers(0, 256, (60, 20))
        words = rs.encode_rows(data, parity)
        assert all(bytes(w.tolist()) == rs.encode(bytes(d.tolist()), parity) for d, w in zip(data, words, strict=True))
        lost, bad = np.zeros(words.shape, bool), words.copy()
        for k in range(60):
            e = int(r.integers(0, parity + 2))
            lost[k, r.choice(words.shape[1], min(e, words.shape[1]), replace=False)] = True
            for p in r.choice(words.shape[1], int(r.integers(0, max(1, parity - e) // 2 + 2)), replace=False):
                bad[k, p] ^= int(r.integers(1, 256))
        ok, back = rs.decode_rows(bad, lost, parity)
        for k in range(60):
            want = rs.decode(bytes(bad[k].tolist()), parity, tuple(np.flatnonzero(lost[k]).tolist()))
            assert ok[k] == (want is not None) and (want is None or bytes(back[k].tolist()) == want)


def test_overlap_counts_a_pair_once(spark):
    left = spark.sql("select 1 lid, 0L lo, 100L hi")
    right = spark.sql("select * from values (5, 10L, 95L), (4, 0L, 85L), (6, 200L, 300L) t(rid, lo, hi)")
    rows = matching.best_overlap(left, right, left_id="lid", right_id="rid", lo="lo", hi="hi", width=10).collect()
    assert [(r.rid, r.overlap) for r in rows] == [(4, 85)]


def test_rs_bounds():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(93))
    word = rs.encode(data, 28)
    for erased, wrong in ((28, 0), (0, 14), (14, 7), (18, 5)):
        w, places = bytearray(word), r.sample(range(len(word)), erased + wrong)
        for p in places:
            w[p] ^= r.randrange(1, 256)
        assert rs.decode(bytes(w), 28, tuple(places[:erased])) == data
    w = bytearray(word)
    for p in r.sample(range(len(word)), 29):
        w[p] ^= 77
    assert rs.decode(bytes(w), 28) != data


def test_strict_json():
    kinds = {"id": "int", "name": "str"}
    assert check('{"id":1,"name":"x"}', kinds) == (True, "")
    assert check('{"id":1,"id":2,"name":"x"}', kinds)[1] == "DUPLICATE_KEY id"
    assert check('{"id":true,"name":"x"}', kinds)[1] == "TYPE id"
    assert check('{"id":1}', kinds)[1] == "KEY_SET" and check("{", kinds)[1] == "NOT_JSON" and check(None, kinds)[1] == "NOT_JSON"


@pytest.mark.parametrize("last_wins", [False, True])
def test_best_overlap_is_that_of_brute_force_in_blocks(spark, last_wins):
    import random

    r = random.Random(3)
    span = lambda most: (lambda a: (a, a + r.choice([0, 1, 3, 7, r.randint(1, most)])))(r.randint(-40, 200))
    lefts = [(k, *span(240)) for k in range(300)] + [(300, None, 5), (3, *span(50))]
    rights = [(k, *span(60)) for k in range(400)] + [(400 + k, 50, 50 + k % 20) for k in range(80)] + [(900, 7, None)]
    want = {}
    for i, lo, hi in lefts:
        for j, a, b in rights:
            if None not in (lo, hi, a, b) and lo < hi and a < b and (o := min(hi, b) - max(lo, a)) > 0:
                want[i] = max(want.get(i, (0, 0)), (o, j if last_wins else -j)) if i in want else (o, j if last_wins else -j)
    x, y = (spark.createDataFrame(rows, f"{n} long, lo long, hi long") for rows, n in ((lefts, "lid"), (rights, "rid")))
    for sizes in ({}, {"block": 50, "slice_": 40}):
        got = {q.lid: (q.overlap, q.rid if last_wins else -q.rid) for q in matching.best_overlap(x, y, left_id="lid", right_id="rid", lo="lo", hi="hi", last_wins=last_wins, **sizes).collect()}
        assert got == want
    assert matching.best_overlap(x, y.limit(0), left_id="lid", right_id="rid", lo="lo", hi="hi").count() == 0


def test_best_overlap_makes_no_pairs(spark):
    x = spark.range(30_000).select(F.col("id").alias("lid"), (F.col("id") % 50).alias("lo"), (F.lit(10_000_000) + F.col("id")).alias("hi"))
    y = spark.range(60_000).select(F.col("id").alias("rid"), (F.col("id") * 160).alias("lo"), (F.col("id") * 160 + 3600 + F.col("id") % 7).alias("hi"))
    got = matching.best_overlap(x, y, left_id="lid", right_id="rid", lo="lo", hi="hi", width=86400)  # 1.8 billion pairs
    assert {(r.rid, r.overlap) for r in got.collect()} == {(6, 3606)} and got.count() == 30_000
