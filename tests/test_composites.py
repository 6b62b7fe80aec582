"""Composite queries on planted rows, every branch held against plain computations."""

import hashlib
import re

from sievelight.plans import catalog


def test_pages_are_told_apart(spark, tmp_path):
    url, head, body = "http://a.example/en/1", '<html lang="en"><title>Two  words</title>', "<h1> Two\nwords </h1>"
    rows = [
        (1, url, head + body, "OK"), (2, url, "<html><title>a</title><h1>a</h1>", "NO_LANGUAGE"), (3, url, None, "NO_LANGUAGE"), (4, url, "", "NO_LANGUAGE"),
        (5, url, '<html lang="en"><title> </title>' + body, "NO_TITLE"), (6, url, head + "<h1>Two wordz</h1>", "TEXT"), (7, "http://a.example/de/1", head + body, "URL_LANGUAGE"),
        (8, "http://a.example/other/de/1", head + body, "URL_LANGUAGE"), (9, None, head + body, "OK"), (10, url, '<html lang="en">', "NO_TITLE"),
    ]
    spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in catalog.QUERIES["page_verification"](spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {r[0]: r[3] for r in rows}
    assert got[1].text_match and not got[6].text_match and got[3].text_match is None


def test_manifests_follow_their_order(spark, tmp_path):
    lines = [(1, 11, 5, 2, 7.0), (1, 12, 6, 1, 9.0), (2, 11, 5, 1, 7.0), (2, 11, 5, 3, 7.0), (3, 11, 5, 1, 7.0), (3, 12, 5, 1, 7.0), (4, 11, 5, 1, 1.0), (5, 11, 5, 1, 50.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r for r in catalog.QUERIES["capture_manifest"](spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "COMPLETE", 2: "SEQUENCE", 3: "SEQUENCE", 4: "EMPTY_OUTPUT", 5: "OVER_BOUND"}
    for key, r in got.items():
        own = sorted((n, f"{n};{p};{int(q)};{hashlib.sha256(f'{o};{p};{s}'.encode()).hexdigest()}") for o, p, s, n, q in lines if o == key)
        assert (r.records, r.manifest_sha256) == (len(own), hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest())


def test_the_best_key_is_taken(spark, tmp_path):
    lines = [(1, 1 * 3, 1), (1, 2 * 3, 2), (2, 1, 1), (2, 4, 2), (3, 7, 1), (4, 2, 1), (4, 2, 2)]  # keys 2; a tie of 0 and 1; none; a tie of 0 and 1
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    best = {}
    for order in {r[0] for r in lines}:
        own = [(p % 8, n) for o, p, n in lines if o == order]
        hits = [sum(s == n * (k + 1) % 8 for s, n in own) for k in range(5)]
        key = hits.index(max(hits)) if max(hits) else None
        was = best.setdefault(key, [0, 0, 0, 0])
        best[key] = [a + b for a, b in zip(was, [1, len(own), max(hits), int(max(hits) == len(own))], strict=True)]
    got = {r.answer_key: [r.runs, r.tokens, r.right_tokens, r.whole_runs] for r in catalog.QUERIES["key_identification"](spark, str(tmp_path)).collect()}
    assert got == best and 2 in got and None in got


def test_only_listed_corpora_calibrate(spark, tmp_path):
    rows = [(k, v) for k in ("click", "view") for v in (4.0, 1.0, 2.0, 3.0, None)]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.corpus: r for r in catalog.QUERIES["calibrated_floor"](spark, str(tmp_path)).collect()}
    assert (got["click"].n, got["click"].floor, got["click"].status) == (4, "0.875000", "CALIBRATED")
    assert got["click"].profile_sha256 == hashlib.sha256(b'{"corpus":"click","floor":0.875000}').hexdigest()
    assert (got["view"].floor, got["view"].profile_sha256, got["view"].status) == (None, None, "REFUSED")


def test_empty_tables_give_no_rows(spark, tmp_path):
    for name, schema in {
        "pages": "page_id long, url string, html string", "events": "event_type string, value double", "documents": "doc_id long, text string, lang string",
        "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string", "embeddings": "label int, embedding array<float>",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in re.findall(r"^def (\w+)\(spark", open(catalog.composites.__file__).read(), re.M):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0, name
