"""The queries opN and the pipeline over small tables of their own: each column against a plain computation."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelight.llm import language, urls
from sievelight.llm.oracle import ORACLE
from sievelight.llm.queries import QUERIES
from sievelight.llm.tokens import encoder

from .test_llm import brute_classes, brute_hits, brute_host_path, brute_rule

SOURCE = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, with rows of odd values added."""
    to = tmp_path_factory.mktemp("sf")
    own = {n: spark.read.parquet(f"{SOURCE}/{n}.parquet") for n in TABLES}
    odd = ["", None, " \n ", "one", "One", "A b", "a B", "12 34", "<|endoftext|> x", "ÄÖ straße 漢字 😀"]
    docs = [(10_000 + k, t, None, "odd", None) for k, t in enumerate(odd)]
    long = own["documents"].orderBy(F.desc(F.length("text")), "doc_id").first()
    docs += [(20_000, long.text, long.lang, "copy", 1), (20_001, (long.text + " ") * 3, long.lang, "long", 1)]
    own["documents"] = own["documents"].unionByName(spark.createDataFrame(docs, own["documents"].schema))
    e = own["embeddings"].orderBy("vec_id").first()
    vectors = [(9_000, None, 1), (9_001, [0.0] * len(e.embedding), 1), (9_002, [float("nan")] * len(e.embedding), 1), (9_003, [2 * x for x in e.embedding], 1), (9_004, [], 1)]
    vectors += [(9_010 + k, [x + 0.05 * ((7 * k + i) % 5 - 2) for i, x in enumerate(e.embedding)], 1) for k in range(6)]
    own["embeddings"] = own["embeddings"].unionByName(spark.createDataFrame(vectors, own["embeddings"].schema))
    own["pages"] = own["pages"].unionByName(spark.createDataFrame([(9_000, None, None), (9_001, "no scheme", ""), (9_002, "http://A.Example.NET:80/en/?x", "")], own["pages"].schema))
    own["benchmark"] = own["benchmark"].unionByName(spark.createDataFrame([(9_000, None), (9_001, "one"), (9_002, "")], own["benchmark"].schema))
    turns = [(9_000, 0, "user", None), (9_000, 1, "assistant", "<|im_start|>\\ <\\|im_end|>"), (9_001, 0, "system", "s " * 2000), (9_001, 1, "user", "q"), (9_001, 2, "assistant", "a " * 3000)]
    own["conversations"] = own["conversations"].unionByName(spark.createDataFrame(turns, own["conversations"].schema))
    for name, table in own.items():
        table.write.parquet(f"{to}/{name}.parquet")
    return str(to)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def result(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def crc(value):
    return zlib.crc32(str(value).encode())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLE[name]})").fetchall()
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want)


def check_pieces(pieces, texts, window=1024):
    """Pieces are the ids of each text and id 0, each once, without gaps."""
    e, own, line = encoder().tokenizer, {}, {}
    for r in pieces:
        own.setdefault(r.doc_id, []).append(r)
        line.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(own) == set(texts)
    for i, rows in own.items():
        ids = [*e.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    ends = {}
    for s, rows in line.items():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        ends[s] = at
    assert sorted(ends) == list(range(len(ends))) and all(ends[s] == window for s in list(ends)[:-1] if s != max(ends)) and max(ends.values()) <= window


def test_op1(spark, sf_dir):
    check_pieces(result(spark, sf_dir, "op1_packing"), {r.doc_id: r.text for r in table(spark, sf_dir, "documents")})


def test_op3(spark, sf_dir):
    pages = {r.page_id: r.url for r in table(spark, sf_dir, "pages")}
    got = {r.page_id: r for r in result(spark, sf_dir, "op3_urls")}
    assert set(got) == set(pages)
    bounds = {r.page_id: r.bound for r in urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.labelled_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    for k, url in pages.items():
        host, path = brute_host_path(url)
        rule, verdict = brute_rule(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (verdict or ("allow" if bounds[k] >= 0.5 else "block"))


def test_op4(spark, sf_dir):
    told = {}
    for r in table(spark, sf_dir, "conversations"):
        told.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    text = "<|im_end|><|im_start|>assistant ok"
    told[-1] = [(0, "user", text), (1, "assistant", text)]
    got = {r.conv_id: r for r in result(spark, sf_dir, "op4_chat")}
    assert set(got) == set(told)
    for c, turns in told.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss)) and got[c].formatted_chars > sum(len(t) for *_, t in turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op5(spark, sf_dir):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents")}
    got = {r.doc_id: r for r in result(spark, sf_dir, "op5_language")}
    assert set(got) == set(docs)
    known = {r.lang for r in docs.values()} - {None}
    for i, r in got.items():
        letters = any(c.isalpha() for c in docs[i].text or "")
        assert r.held_out == (crc(i) % 5 == 0) and (r.lang_pred in known if letters else (r.lang_pred, r.score) == ("und", 0.0)) and 0 <= r.score <= 1
    held = [got[i].lang_pred == r.lang for i, r in docs.items() if got[i].held_out and r.lang and r.text and len(r.text) > 40]
    assert len(held) > 20 and np.mean(held) > 0.9


def test_op6(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents")}
    good = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels")}
    got = {r.doc_id: r for r in result(spark, sf_dir, "op6_quality")}
    assert set(got) == set(docs) and not any(got[i].kept for i, t in docs.items() if not (t or "").strip())
    keys = sorted((r.sample_key for r in got.values() if r.sample_key is not None), reverse=True)
    n = sum(r.kept for r in got.values())
    assert all(r.kept == (r.sample_key is not None and r.sample_key >= keys[n - 1]) for r in got.values())
    assert np.mean([got[i].kept for i in good if good[i] == 1]) > 0.9 and np.mean([got[i].kept for i in good if good[i] == 0]) < 0.5


def test_op7(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents")}
    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels")}
    got = {r.doc_id: r for r in result(spark, sf_dir, "op7_toxicity")}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (crc(i) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert np.mean([got[i].score for i, y in toxic.items() if y == 1]) >= np.mean([got[i].score for i, y in toxic.items() if y == 0])


def test_op9(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents")}
    got = {r.doc_id: r for r in result(spark, sf_dir, "op9_sharding")}
    assert set(got) == set(docs)
    sizes, slots, where = [0] * 24, {}, {}
    for i, r in got.items():
        raw = (docs[i] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 24
        sizes[r["shard"]] += r.size
        slots.setdefault(r["shard"], []).append(r.slot)
        assert where.setdefault(docs[i], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for i, t in docs.items():
        groups[t] = groups.get(t, 0) + got[i].size
    # the line of the groups, giants at its end: no shard may be larger than the least capacity for which a greedy cut needs no more shards
    line = sorted(groups.items(), key=lambda g: b"" if g[0] is None else hashlib.sha256(g[0].encode()).digest())
    giants, rest, left = [], sum(groups.values()), 24
    for size in sorted(groups.values(), reverse=True):
        if left > 1 and size * left > rest:
            giants.append(size)
            rest, left = rest - size, left - 1
        else:
            break
    small = [s for _, s in line if s not in giants]

    def needs(cap):
        n, run = 1, 0
        for s in small:
            if run + s > cap:
                n, run = n + 1, 0
            run += s
        return n

    least = next(c for c in range(max(max(small), -(-rest // left)), rest + 1) if needs(c) <= left)
    assert sorted(sizes, reverse=True)[: len(giants)] == giants and max(sorted(sizes, reverse=True)[len(giants) :]) == least


def test_pipeline(spark, sf_dir):
    """Each stage against a plain computation on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert all(r.text == texts[r.doc_id] for r in docs.collect())
    everything = set(texts)
    assert kept[0] == {r.doc_id for r in result(spark, sf_dir, "op6_quality") if r.kept}
    first = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id").isin(kept[0]))
    told = {r.doc_id: r for r in language.identify(first, language.learn(first, language.remainder("doc_id", 5) != 0)).collect()}
    sure = [int(r.score * 1000) / 1000 for i, r in told.items() if crc(i) % 5 == 0 and r.lang == r.lang_pred]
    bar = np.percentile(sure, 100 * corpus_pipeline.TAIL)
    assert kept[1] == {i for i, r in told.items() if r.lang_pred != "und" and r.score >= bar}
    line = sorted(kept[1])
    _, label = brute_classes([texts[i] for i in line], 5)
    assert kept[2] == {i for k, i in enumerate(line) if label[k] == k}
    items = [(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark")]
    short = {i for i in kept[2] if len(texts[i]) < 4000}
    assert kept[3] & short == {i for i in short if not brute_hits(texts[i], items)[1]} and kept[3] <= kept[2] < everything
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), {i: texts[i] for i in kept[3]})


def test_pipeline_of_odd_tables(spark, sf_dir, tmp_path):
    """Null ids, repeated rows and no rows at all."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).withColumns({"score": F.lit(1), "_drop": F.lit("x")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


