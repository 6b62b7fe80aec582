"""Queries over whole tables, against brute force on small ones."""

import hashlib
import os

import duckdb
import pytest

from sievelight.functions import strings
from sievelight.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def rows_of(table, cols):
    return duckdb.sql(f"select {cols} from '{DIR}/{table}.parquet'").fetchall()


def test_best_overlap_takes_all_events(spark):
    events = rows_of("events", "event_id, user_id, event_type, epoch_us(ts) // 1000000")
    left, right = {}, []
    for i, u, kind, s in events:
        lo, hi = left.get(u, (s, s + 1))
        left[u] = (min(lo, s), max(hi, s + 1))
        if kind == "signup":
            right.append((i, s, s + 3600 * (1 + i % 5)))
    want = {}
    for u, (lo, hi) in left.items():
        best = max(((min(hi, b) - max(lo, a), -i) for i, a, b in right if lo < b and a < hi), default=None)
        if best:
            want[u] = (-best[1], best[0])
    got = {r.lid: (r.rid, r.overlap) for r in catalog.QUERIES["interval_best_overlap_all"](spark, DIR).collect()}
    assert got == want and len(got) > 0.9 * len(left)


def lines_of(text, budget):
    lines, used = 0, 0
    for w in (text or "").split():
        if lines and used + 1 + len(w) <= budget:
            used += 1 + len(w)
        else:
            lines, used = lines + 1, len(w)
    return lines


def test_word_wrap_takes_whole_documents(spark):
    want = {i: lines_of(t, 60) for i, t in rows_of("documents", "doc_id, text")}
    got = {r.doc_id: r.n_lines for r in catalog.QUERIES["word_wrap"](spark, DIR).collect()}
    assert got == want


def test_seqmatch_takes_whole_conversations(spark):
    from difflib import SequenceMatcher

    want = {}
    for c, k, t in rows_of("conversations", "conv_id, turn, text"):
        t = t or ""
        m = SequenceMatcher(None, t, t.translate(str.maketrans("e", "?", "a")), autojunk=False)
        want[c, k] = (len(t), sum(b.size for b in m.get_matching_blocks()))
    got = {(r.conv_id, r.turn): (r.n, r.matched) for r in catalog.QUERIES["seqmatch_accuracy"](spark, DIR).collect()}
    assert got == want


def test_matched_size_is_difflibs_and_takes_long_texts():
    import random
    import time
    from difflib import SequenceMatcher

    from sievelight.functions.blocks import matched_size

    r = random.Random(5)
    for k in range(3000):
        letters = ("ab", "abc e\0", "abcdefgh? ")[k % 3]
        a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in "ab")
        b = a.translate(str.maketrans("e", "?", "a")) if k % 2 else b
        assert matched_size(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), (a, b)
    a = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(4000))
    began = time.process_time()
    assert matched_size(a, a) == len(a) and 0.8 * len(a) < matched_size(a, a.translate(str.maketrans("e", "?", "a"))) < len(a)
    assert time.process_time() - began < 10  # difflib takes minutes for these 26,000 characters


def five_bits_of(raw):
    bits = "".join(f"{b:08b}" for b in raw)
    bits += "0" * (-len(bits) % 5)
    return [int(bits[k : k + 5], 2) for k in range(0, len(bits), 5)]


def polymod_of(values):
    c = 1
    for v in values:
        top, c = c >> 25, (c & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(strings.GENERATOR):
            c ^= g if top >> k & 1 else 0
    return c


def test_codes_take_the_whole_digest(spark):
    docs = {i: five_bits_of(hashlib.sha256(t.encode()).digest()) for i, t in rows_of("documents", "doc_id, text") if t is not None}
    sums = {r.doc_id: r.polymod for r in catalog.QUERIES["bech32_checksum"](spark, DIR).collect()}
    assert {i: sums[i] for i in docs} == {i: polymod_of(v) for i, v in docs.items()}
    packed = {r.doc_id: r.token for r in catalog.QUERIES["bech32_pack_all"](spark, DIR).collect()}
    assert {i: packed[i] for i in docs} == {i: "".join(strings.ALPHABET[x] for x in v) for i, v in docs.items()}
    parts = {i: hashlib.sha256(t.encode()).digest() for i, t in rows_of("part", "p_partkey, p_name")}
    got = {r.p_partkey: (r.code, r.back) for r in catalog.QUERIES["base32_roundtrip_all"](spark, DIR).collect()}
    assert got == {i: ("".join(strings.BASE32[x] for x in five_bits_of(d)), d.hex()) for i, d in parts.items()}


def test_exclusive_matches_are_the_greedy_ones(spark):
    events = rows_of("events", "event_id, user_id, event_type, epoch_us(ts) // 1000000")
    free, want = {}, {}
    for i, u, kind, s in events:
        if kind == "click":
            free.setdefault(u, []).append((s, i))
    for s, i, u in sorted((s, i, u) for i, u, kind, s in events if kind == "purchase"):
        near = [(abs(t - s), c, t) for t, c in free.get(u, []) if abs(t - s) <= 7200]
        if near:
            d, c, t = min(near)
            free[u].remove((t, c))
            want[i] = (c, d)
    got = {r.purchase_id: (r.click_id, r.distance) for r in catalog.QUERIES["nearest_exclusive_greedy"](spark, DIR).collect()}
    assert got == want and want


def test_plan_has_the_published_digest(spark):
    r = catalog.QUERIES["plan_digest"](spark, DIR).first()
    assert (r.n, r.members, r.unpaired, r.digest) == (1566, 1566, 0, "78fae2b81bd302b841f4ff620ff073efd79e2e17b98971fc7b7cbd70b09ce88a")


def test_damage_within_the_budget_is_always_mended(spark):
    rows = catalog.QUERIES["damage_sweep"](spark, DIR).collect()
    assert len(rows) == 36 and all((r.success == 1.0) if r.load <= r.parity else (r.success == 0.0) for r in rows)
