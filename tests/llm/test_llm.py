"""The ten operators on small tables, against brute force, exact round trips and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.llm import chat, decontamination, embeddings, graph, language, neardup, packing, quality, sharding, toxicity, urls
from sievelight.llm.tables import store
from sievelight.llm.text import ALNUM, NONSPACE, Words, distinct, raw
from sievelight.llm.tokens import encoder

rng = np.random.default_rng(4)
VOCAB = ["".join(rng.choice(list("abcdeéo"), rng.integers(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB, n))


BASE = [prose(int(n)) for n in rng.integers(20, 120, 25)]
NEAR = [" ".join(w if k != 7 else "changed" for k, w in enumerate(t.split())) for t in BASE[:6]]
ODD = [None, "", "   ", "one", "one", "A b", "a B", "×÷ 漢字 😀 don't", "x" * 3000, BASE[0], BASE[0], "\x1c\x00 é"]
TEXTS = BASE + NEAR + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else "fr", k) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_words int")


def test_words_and_shingles_are_those_of_the_patterns():
    data, offsets = raw(pa.array(TEXTS))
    for table, pattern in ((ALNUM, decontamination.WORD), (NONSPACE, re.compile("[^\x20\x09-\x0d]+"))):
        w = Words(data, offsets, 0, len(TEXTS), table)
        lower = [(t or "").translate(decontamination._LOWER) for t in TEXTS]
        assert w.counts().tolist() == [len(pattern.findall(t)) for t in lower]
    _, at = distinct(*w.shingles(2))
    sets = [{tuple(x[k : k + 2]) for k in range(max(1, len(x) - 1))} if x else set() for x in (pattern.findall(t) for t in lower)]
    assert np.diff(at).tolist() == [len(s) for s in sets]


def test_ids_are_the_tokenizers():
    texts = TEXTS + ["a  b\n\n c's 'tis don't 12ab__x  ", "<|endoftext|> y", " \t\n  x", "I'vex'd' we're"]
    e = encoder()
    for _ in range(2):
        ids, at = e.encode_column(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_of_a_doubling_pattern_stay_apart():
    """Strings that collide under every polynomial modulo a power of two."""
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    e = encoder()
    for n in (1024, 2048):
        ids, at = e.encode_column(pa.array([one[:n], other[:n]]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.tokenizer.encode(t[:n], add_special_tokens=False).ids for t in (one, other)]
        data, offsets = raw(pa.array([one[:n], other[:n]]))
        assert len(set(Words(data, offsets, 0, 2, NONSPACE).hashes.tolist())) == 2


def test_a_text_with_more_pre_tokens_than_the_cache_holds(monkeypatch):
    from sievelight.llm import tokens

    for name, value in (("TABLE_BITS", 6), ("POOL_IDS", 300), ("POOL_BYTES", 500)):
        monkeypatch.setattr(tokens, name, value)
    e = tokens.Encoder()
    words = lambda n: " ".join("".join(rng.choice(list("qxzjkv"), rng.integers(1, 9))) for _ in range(n))
    texts = [words(30), words(4000), None, words(60), words(5), words(4000)]
    for column in (texts, texts[3:], [texts[0]] * 2 + [texts[4]]):
        ids, at = e.encode_column(pa.array(column, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in column]


def test_packing(spark, docs, empty):
    pieces = packing.pack(docs, window=64).toPandas().sort_values(["sequence_id", "offset"])
    e = encoder().tokenizer
    for i, g in pieces[pieces.doc_id != 3].groupby("doc_id"):
        ids = b"".join(g.sort_values("start").ids)
        assert np.frombuffer(ids, "<u4").tolist() == e.encode(TEXTS[i] or "", add_special_tokens=False).ids + [0]
    sums = pieces.groupby("sequence_id").length.sum()
    assert (sums[:-1] == 64).all() and len(pieces[pieces.doc_id == 3][lambda d: d.start == 0]) == 2
    full = packing.sequences(packing.pack(docs, window=64), window=64).collect()
    assert all(len(r.ids) == 64 for r in full)
    assert packing.pack(empty).count() == 0


def brute_hits(text, items, window=10):
    w, hit, found = decontamination.words_of(text), set(), set()
    for name, t in items:
        v = decontamination.words_of(t)
        n = min(window, len(v))
        for s in range(len(v) - n + 1) if n else ():
            for k in range(len(w) - n + 1):
                if w[k : k + n] == v[s : s + n]:
                    hit.update(range(k, k + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def brute_longest(text, items):
    w, best, at = decontamination.words_of(text), 0, 0
    for t in items:
        v = decontamination.words_of(t)
        for k in range(len(w)):
            for s in range(len(v)):
                n = 0
                while k + n < len(w) and s + n < len(v) and w[k + n] == v[s + n]:
                    n += 1
                if n >= min(10, len(v)) and (n > best or n == best and k < at):
                    best, at = n, k
    return best, at


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 200])
def test_decontamination(spark, docs, empty, block):
    items = [("1", " ".join(BASE[0].split()[3:18]).upper().replace("É", "é")), ("2", BASE[1]), ("3", "ONE"), ("4", None), ("2", "A"), ("null", prose(12))]
    bench = spark.createDataFrame([(None if i == "null" else int(i), t) for i, t in items], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.find(docs.drop("n_words"), bench, block_bytes=block).collect()}
    assert got == {k: brute_hits(t, items) for k, t in enumerate(TEXTS)}
    for r in decontamination.find(docs, bench, block_bytes=block).collect():
        assert (r.longest_match, r.longest_at) == brute_longest(TEXTS[r.doc_id], [t for _, t in items])
    clean = decontamination.clean(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, v in got.items() if not v[1]}
    assert decontamination.clean(empty, bench).count() == 0 and decontamination.clean(docs, bench.limit(0)).count() == len(TEXTS) + 1


def brute_host_path(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def brute_rule(host, path):
    best = (None, None)
    for verdict, rule in urls.RULES:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


def brute_bounds(pages, level=0.05, weakest=2.0, strongest=1000.0):
    """pages: (host, domain, suffix, good or None). Per host: mean and the quantile by a fine sum over the density of the log odds."""

    def counts(of):
        out = {}
        for p in pages:
            n, s = out.get(of(p), (0, 0))
            out[of(p)] = (n + (p[3] is not None), s + (p[3] or 0))
        return out

    def strength(c):
        c = [x for x in c.values() if x[0]]
        if not c:
            return strongest
        total, m = sum(n for n, _ in c), sum(s for _, s in c) / sum(n for n, _ in c)
        free = total - sum(n * n for n, _ in c) / total
        between = (sum(n * (s / n - m) ** 2 for n, s in c) - (len(c) - 1) * m * (1 - m)) / free if free > 0 else 0
        return max(weakest, min(strongest, m * (1 - m) / between - 1)) if between > 0 else strongest

    hosts, domains, suffixes = counts(lambda p: p[:3]), counts(lambda p: p[1:3]), counts(lambda p: p[2])
    n, s = sum(x[0] for x in suffixes.values()), sum(x[1] for x in suffixes.values())
    mean_s = {k: (b + strength(suffixes) * (s + 1) / (n + 2)) / (a + strength(suffixes)) for k, (a, b) in suffixes.items()}
    mean_d = {k: (b + strength(domains) * mean_s[k[1]]) / (a + strength(domains)) for k, (a, b) in domains.items()}
    k, x, out = strength(hosts), np.linspace(-400, 400, 1_600_001), {}  # x: log odds
    for (h, d, u), (a, b) in hosts.items():
        log = -(b + k * mean_d[d, u]) * np.logaddexp(0, -x) - (a - b + k * (1 - mean_d[d, u])) * np.logaddexp(0, x)
        weight = np.cumsum(np.exp(log - log.max()))
        out[h] = 1 / (1 + np.exp(-x[np.searchsorted(weight, level * weight[-1])]))
    return out


def test_url_rules_and_reputation(spark):
    given = ["http://A.example.net/en/x?q", "https://x.net/", "http://a.org/fr/1#t", "http://example.com/de/", None, "nothing", "http://bad.info/1", "http://x.net", "http://h.co.uk:8080/a"]
    given += ["ftp://u@H1.good.com/7", "http://10.0.0.1/x", "://", "http://?q", "http://org/fr/", "http://myorg/fr/", "http://example.net/en", "http://É.example.net/EN/"]
    given += ["http://bad.info/2"] * 60 + [f"http://h{k % 5}.good.com/" for k in range(100)] + [f"http://www{k % 9}.mixed.co.uk/{k}" for k in range(90)] + ["http://other.co.uk/"] * 3
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit("clash"))
    good = {k: int("good" in u or k % 3 > 0 and "mixed" in u) for k, u in enumerate(given) if u and ("good" in u or "bad" in u or "mixed" in u)} | {0: None, 1: 5}
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame(list(good.items()), "page_id long, good int")).collect()}
    assert len(got) == len(given)
    parts = {k: brute_host_path(u) for k, u in enumerate(given)}
    level = {"bad.info": ("bad.info", "info"), "h.co.uk:8080": ("h.co.uk", "co.uk"), "other.co.uk": ("other.co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1",) * 2, "u@h1.good.com": ("good.com", "com")}
    level |= {h: (".".join(h.split(".")[-3:]), "co.uk") for h, _ in parts.values() if "mixed" in h}
    level = {h: level.get(h, (".".join(h.split(".")[-2:]), h.split(".")[-1])) for h, _ in parts.values()}
    bound = brute_bounds([(parts[k][0], *level[parts[k][0]], good.get(k) if good.get(k) in (0, 1) else None) for k in parts])
    for k, (host, path) in parts.items():
        rule, verdict = brute_rule(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].bound == pytest.approx(bound[host], abs=2e-4)
        assert got[k].verdict == (verdict or ("allow" if bound[host] >= 0.5 else "block"))
    assert got[6].verdict == "block" and got[len(given) - 100].verdict == "allow"
    none = spark.createDataFrame([], "page_id long, good int")
    assert urls.judge(pages.limit(0), none).count() == 0 and {r.verdict for r in urls.judge(pages, none).collect()} == {"allow", "block"}


def test_pages_of_labelled_documents(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/17?x=3"), (2, "http://a.b/en/18.html#t"), (3, "http://a.b/17/x"), (4, None), (5, "http://a.b/19/"), (6, "http://17"), (7, "http://a.b/en/17")], "page_id long, url string")
    labels = spark.createDataFrame([(17, 1), (18, 0), (19, None), (3, 1)], "doc_id long, quality int")
    assert {(r.page_id, r.good) for r in urls.labelled_pages(pages, labels).collect()} == {(1, 1), (2, 0), (5, None), (7, 1)}


@pytest.mark.parametrize("segment", [7, 1024])
def test_chat_round_trip(spark, segment):
    tricky = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\| \\n"
    told = {"1": [("system", prose(30)), ("user", tricky), ("assistant", tricky), ("user", prose(900)), ("assistant", prose(20))], "2": [(None, None), ("a\nb", "")]}
    told["3"] = [(("user", "assistant")[k % 2], prose(int(rng.integers(1, 60)))) for k in range(300)]
    told[None] = [("system", "of none"), *(("user", f"none {k} " + prose(40)) for k in range(40))]
    told["null"] = [("system", "of null"), *(("assistant", f"null {k} " + prose(40)) for k in range(40))]
    rows = [(c, k, r, t, "clash") for c, turns in told.items() for k, (r, t) in enumerate(turns)]
    conv = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, window string")
    made = chat.windows(conv, segment=segment)
    got = {r.conv: r for r in chat.read_back(made).collect()}
    for c, turns in told.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # the greedy spans, one turn after another
    size = lambda r, t: len(encoder().tokenizer.encode(chat.opening(r or "") + chat.escape(t or "") + chat.END, add_special_tokens=False).ids)
    windows = {(w.conv, w.window): w for w in made.collect()}
    want = {}
    for c, turns in told.items():
        tokens = [size(*t) for t in turns]
        head = next((k for k, t in enumerate(turns) if t[0] == "system"), None)
        left = 1024 - (0 if head is None else tokens[head])
        begin = 0
        while begin < len(turns):
            end = begin + 1
            while end < len(turns) and sum(tokens[begin : end + 1]) <= max(left - 256, left // 2, 1):
                end += 1
            again = head is not None and head < begin
            spare = min(256, 1024 - sum(tokens[begin:end]) - (tokens[head] if again else 0))
            old = [k for k in range(begin) if k != head and sum(tokens[k:begin]) <= spare]
            want[c, begin] = [*([head] if again else []), *old, *range(begin, end)], len(old) + again, sum(tokens[k] for k in [*([head] if again else []), *old, *range(begin, end)])
            begin = end
    assert set(windows) == set(want)
    for at, (turns, n, total) in want.items():
        w = windows[at]
        assert chat.parse(w.text) == [(told[at[0]][k][0] or "", told[at[0]][k][1] or "") for k in turns]
        assert (w.n_repeated, w.n_new, w.tokens) == (n, len(turns) - n, total) and (total <= 1024 or w.n_new == 1)
    assert chat.read_back(chat.windows(conv.limit(0))).count() == 0


def test_language_gradients_and_accuracy(spark, empty):
    net = language.Network(["a", "b", "c"], hidden=4)
    net.w = [w.astype(np.float64) for w in net.w]
    text, valid, label = rng.integers(97, 103, (6, 5)), rng.random((6, 5)) < 0.9, rng.integers(0, 3, 5)
    _, grads = net.gradients(text, valid, label)
    for k, at in ((0, (98, 1)), (1, (99, 2)), (2, (1, 2)), (3, (0, 3)), (6, (2, 1)), (8, (5, 1))):
        old, step = net.w[k][at], 1e-4
        losses = []
        for x in (old + step, old - step):
            net.w[k][at] = x
            losses.append(net.gradients(text, valid, label)[0])
        net.w[k][at] = old
        assert grads[k][at] == pytest.approx((losses[0] - losses[1]) / (2 * step), rel=0.05, abs=2e-4)
    make = lambda chars: " ".join("".join(rng.choice(list(chars), 5)) for _ in range(30))
    rows = [(k, make("abcdef") if k % 2 else make("uvwxyz"), "l1" if k % 2 else "l2") for k in range(400)] + [(900, None, None), (901, "12 34", "l1"), (902, make("uvwxyz") * 300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, language.learn(df, language.remainder("doc_id", 5) != 0, steps=60)).collect()}
    right = [got[k].lang_pred == rows[k][2] for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean(right) > 0.95 and got[902].lang_pred == "l2"
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")
    assert language.learn(empty, F.lit(True)) is None
    assert language.identify(df, None).where("lang_pred <> 'und'").count() == 0 and language.identify(empty, None).count() == 0


def brute_ratios(texts, target, buckets):
    """Log ratios by counting n-grams one after another, with the operator's own hash of each."""
    every, good = np.ones(buckets), np.ones(buckets)
    grams = []
    for t in texts:
        data, offsets = raw(pa.array([t], pa.string()))
        grams.append(quality._grams(data, offsets, 0, 1, buckets)[0].tolist())
    for k, own in enumerate(grams):
        for g in own:
            every[g] += 1
            good[g] += k in target
    return grams, np.log(good / good.sum()) - np.log(every / every.sum())


def test_quality(spark, docs, empty):
    rows = [(k, prose(60)) for k in range(200)] + [(k, "buy now!! $$$ " * 30) for k in range(200, 230)] + [(230, None), (231, ""), (232, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("log_weight", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(0, 230, 2)] + [(1, None), (3, 7), (None, 1)], "doc_id long, quality int")
    kept = quality.filter_documents(df, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and len(ids & set(range(200))) >= 190 and not ids & set(range(200, 233))
    # weights, keys and k against a plain computation
    sample = quality.labelled(labels).collect()
    assert {r._id for r in sample} == set(range(0, 230, 2)) and all(r._good == (r._id < 200) for r in sample)
    grams, ratios = brute_ratios([t for _, t in rows], {r._id for r in sample if r._fit}, quality.BUCKETS)
    half = quality.resample(df.drop("log_weight"), labels, keep=0.5).collect()
    noise = {r.doc_id: r.g for r in df.select("doc_id", quality.gumbel(F.col("doc_id").cast("string"), 11).alias("g")).collect()}
    keys = {}
    for r in half:
        own = grams[r.doc_id]
        assert r.n_grams == len(own) and (r.log_weight is None) == (not own)
        if own:
            weight = sum(ratios[g] for g in own) / (len(own) + quality.PRIOR)
            assert r.log_weight == pytest.approx(weight, abs=2e-6)
            keys[r.doc_id] = r.sample_key
            assert r.sample_key == pytest.approx(weight / quality.TEMPERATURE + noise[r.doc_id], abs=3e-4)
    assert {r.doc_id for r in half if r.kept} == set(sorted(keys, key=keys.get)[-115:])
    assert quality.filter_documents(empty, labels).count() == 0 and quality.filter_documents(docs, labels.limit(0)).count() == docs.where("length(trim(text)) > 0").count()


def test_quality_reads_all_labels(spark):
    labels = spark.range(50_000).select(F.col("id").cast("int").alias("doc_id"), F.lit(1).alias("quality"))
    known = quality.labelled(labels)
    assert known.count() == 50_000
    texts = {k: f"a{k % 7} b{k % 11}" for k in range(0, 50_000, 25)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    chosen = {r._id for r in known.where("_fit").collect()} & set(texts)
    _, want = brute_ratios(list(texts.values()), {n for n, k in enumerate(texts) if k in chosen}, 500)
    assert quality.fit(df, known, buckets=500) == pytest.approx(want)
    # one of three documents left out of the fit is the least; none of the three is beyond the tail
    scored = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.05), (5, None)], "doc_id long, log_weight double")
    seen = spark.createDataFrame([(1, True, False), (2, True, False), (3, True, False), (4, False, False), (5, True, False)], "_id long, _good boolean, _fit boolean")
    assert quality.share(scored, seen, id_col="doc_id") == 0.75


def test_quality_sample_has_the_chances_of_its_weights(spark):
    df = spark.createDataFrame([(k, f"{'good' if k % 2 else 'other'} word") for k in range(20)], "doc_id long, text string")
    weight = {0: -0.035, 1: 0.0}
    scored = df.select("doc_id", F.when(F.col("doc_id") % 2 == 1, weight[1]).otherwise(weight[0]).alias("log_weight"))
    first = {0: 0, 1: 0}
    for seed in range(60):
        keyed = quality._keyed(scored, "doc_id", 0.05, seed)
        first[keyed.orderBy(F.desc("sample_key")).first().doc_id % 2] += 1
    # the first of a sample is drawn in proportion to exp(weight / temperature): 2 to 1
    assert 28 <= first[1] <= 52


def test_a_short_word_and_many_exceptions(spark):
    rows = [(k, prose(20) + (" zog." if k % 4 == 0 else " zogging zo")) for k in range(400)]
    df = spark.createDataFrame([*rows, (900, "a zog"), (901, "zogs"), (902, "trash can " * 3000 + "trash zog")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    assert "zog " in model.lexicon
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert got[900].n_matches == 1 and got[901].n_matches == 0 and got[902].n_matches == 1 and got[900].score >= 0.7 > got[901].score


def test_toxicity(spark, empty):
    rows = [(k, prose(40) + (" you moron" if k % 4 == 0 else "")) for k in range(400)] + [(900, None), (901, ""), (902, prose(30) + " mоr0n"), (903, "a circus clown and a trash can")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[k] >= 0.7) == (k % 4 == 0) for k in range(300, 400)) and got[902] >= 0.7
    assert max(got[900], got[901], got[903]) < 0.5
    # scores against a matcher that tries every entry at every place
    for r in toxicity.score(df, model).where("doc_id % 7 = 0 or doc_id >= 900").collect():
        folded, spans, free = toxicity.fold(r.text or ""), [], []
        for phrase in map(toxicity.fold, model.exceptions):
            free += [(k, k + len(phrase)) for k in range(len(folded)) if folded.startswith(phrase, k)]
        for entry, weight in model.lexicon.items():
            e = entry.strip()
            for k in range(len(folded)):
                ends = not entry.endswith(" ") or not folded[k + len(e) : k + len(e) + 1].isalnum()
                if folded.startswith(e, k) and (k == 0 or not folded[k - 1].isalnum()) and ends and not any(a <= k and k + len(e) <= b for a, b in free):
                    spans.append(weight)
        density, (a, b, c) = sum(spans) * 1000 / (len(folded) + 200) if r.text else 0.0, model.weights
        assert r.n_matches == len(spans) and r.score == pytest.approx(1 / (1 + np.exp(-(a * np.log1p(density) + b * np.log1p(len(spans)) + c))), abs=1e-9)
    none = toxicity.learn(df, labels.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.0} and toxicity.score(empty, model).count() == 0


def brute_classes(texts, k, percent=80):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(decontamination._LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sets, label


@pytest.mark.parametrize("k", [2, 5])
def test_neardup(spark, docs, empty, k):
    sets, label = brute_classes(TEXTS, k)
    got = neardup.classes(docs, k=k).collect()
    assert len(got) == len(TEXTS) + 1
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, label, strict=True))}
    assert neardup.classes(empty).count() == 0
    named = docs.withColumns({"_drop": F.lit(1), "_place": F.lit("a"), "id": F.lit(0), "n": F.lit(None).cast("int")})
    kept = neardup.deduplicate(named, k=k)
    assert kept.columns == named.columns and {r.doc_id for r in kept.collect()} == {i for i, c in enumerate(label) if i == c}
    assert {(r._drop, r._place, r.id, r.n) for r in kept.collect()} == {(1, "a", 0, None)}


def test_a_group_of_near_copies_is_one_class(spark):
    base = prose(200).split()
    texts = []
    for _ in range(120):
        own = list(base)
        for at in rng.choice(200, 5, replace=False):
            own[at] = f"w{rng.integers(10**6)}"
        texts.append(" ".join(own))
    _, label = brute_classes(texts, 2)
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in got} == dict(enumerate(label))


def test_a_bucket_of_many_components_is_dealt_over_slices(spark, monkeypatch):
    """Pages of one template, too far from one another to link, but for some pairs."""
    monkeypatch.setattr(neardup, "SLICE", 4)
    base, texts = prose(140).split(), []
    for k in range(60):
        own = list(base)
        for at in range(0, 140, 7):
            own[at] = f"x{k}y{at}" if k % 5 else f"x{k // 10}y{at}"
        texts.append(" ".join(own))
    _, label = brute_classes(texts, 2)
    assert len(set(label)) == 50
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in got} == dict(enumerate(label))


def test_components_of_a_chain(spark):
    links = spark.range(0, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.sql("select 100L a, 99L b"))
    assert {r.v: r.c for r in graph.components(links).collect()} == {**dict.fromkeys(range(61), 0), 99: 99, 100: 99}


@pytest.mark.parametrize("hot", [False, True])
def test_sharding(spark, docs, empty, hot):
    more = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(400)).select((F.col("id") + 1000).alias("doc_id"), "text", "lang", "n_words")) if hot else docs
    rows = sharding.shard(more, shards=6).collect()
    text = {r.doc_id: r.text for r in more.collect()}
    sizes, where, slots = [0] * 6, {}, {}
    for r in rows:
        t = text[r.doc_id]
        assert (r.size, r.text_crc32) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        sizes[r["shard"]] += r.size
        assert where.setdefault(t, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r.slot)
    assert len(rows) == more.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in rows:
        groups[text[r.doc_id]] = groups.get(text[r.doc_id], 0) + r.size
    assert max(sizes) <= max(max(groups.values()), sum(sizes) / 6 + max(v for v in groups.values() if v < max(groups.values())))
    assert sharding.shard(empty).count() == 0


def test_minimax_is_least(spark):
    sizes = [int(x) for x in rng.integers(8, 900, 300)]
    ends = np.cumsum(sizes)
    df = spark.createDataFrame([(int(e),) for e in ends], "e long")
    cap, cuts = sharding.minimax_cuts(df, F.col("e"), int(ends[-1]), max(sizes), 7, intervals=20)

    def fits(c):
        n, run = 1, 0
        for s in sizes:
            if run + s > c:
                n, run = n + 1, 0
            run += s
        return n <= 7

    assert cap == min(c for c in range(max(sizes), int(ends[-1]) + 1) if fits(c))
    assert max(np.diff([0, *cuts])) <= cap and set(cuts) <= set(ends.tolist()) and len(cuts) == 7
    assert min(np.diff([0, *cuts])) >= ends[-1] / 7 - max(sizes), "no shard gets all the slack"


@pytest.mark.parametrize("seed", range(200))
def test_spread_keeps_the_least_capacity(seed):
    """Cuts at the given ends only, in order, none over the capacity, whatever the sizes; the line is used up."""
    r = np.random.default_rng(seed)
    ends = np.cumsum(r.integers(1, r.choice([3, 50, 5000]), int(r.integers(1, 60))))
    shards, total = int(r.integers(1, 12)), int(ends[-1])
    cap = sharding._least(total, shards, int(np.diff([0, *ends]).max()), ends, ends, False)
    cuts = sharding._spread(cap, total, shards, ends)
    assert len(cuts) == shards and cuts[-1] == total and cuts == sorted(cuts)
    assert max(np.diff([0, *cuts])) <= cap and set(cuts) <= {0, *ends.tolist()}


def test_the_grid_skips_blocks_and_loses_nothing():
    """Clusters in a space of few dimensions: most pairs of vectors aren't compared, all links are found."""
    centres = rng.normal(size=(40, 24)) * np.array([3.0] * 4 + [0.2] * 20)
    x = np.concatenate([c + rng.normal(scale=0.02, size=(50, 24)) for c in centres]).astype(np.float32)
    axes = np.eye(24)[:, : embeddings.BOX_DIMS]
    order = np.lexsort(np.floor(embeddings._place(x.astype(float), axes)[1][:, :6].T[::-1] / np.sqrt(0.2)))
    x = x[order]
    rows = pa.array([{"rank": k, "rep": k, "m": 1, "x": v.tobytes()} for k, v in enumerate(x)], pa.struct([("rank", pa.int64()), ("rep", pa.int64()), ("m", pa.int64()), ("x", pa.binary())]))
    a = embeddings._Side(rows, 24, axes, "<f4")
    _, compared = embeddings._join(a, a, True, 0.9, leaf=32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert a.count.tolist() == ((y @ y.T >= 0.9).sum(1) - 1).tolist()
    assert compared < 0.3 * len(x) ** 2 / 2


@pytest.mark.parametrize("block", [16, None])
def test_embeddings(spark, block):
    x = rng.normal(size=(120, 16))
    x[40:60] = x[:20] + rng.normal(scale=0.1, size=(20, 16))
    x[60:80] = x[60] + rng.normal(scale=0.15, size=(20, 16))
    x[80:90] = x[80]
    x[90] = 2 * x[80]
    rows = [(k, [float(np.float32(v)) for v in r], k) for k, r in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None], 1), (204, [1.0, 2.0], 1), (205, [2.0, 4.0], 1), (206, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    y = np.array([r[1] for r in rows[:120]])
    norm = np.linalg.norm(y, axis=1)
    link = (y @ y.T) / np.outer(norm, norm) >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(120)
    for _ in range(120):
        label = np.minimum(label, np.where(link, label[None], 999).min(1))
    want = {k: (int(link[k].sum()), int(label[k])) for k in range(120)} | {k: (0, k) for k in (200, 201, 202, 203, 206)} | {204: (1, 204), 205: (1, 204)}
    got = embeddings.classes(df, block=block).collect()
    assert {r.id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.id == r.component_id) for r in got)
    assert embeddings.classes(df.limit(0)).count() == 0
    wide = df.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), F.lit(1).alias("key"), F.lit(2).alias("id"))
    assert {r.id: (r.n_links, r.component_id) for r in embeddings.classes(wide, block=block).collect()} == want


def test_pipeline_stages_keep_the_columns(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(k, 1, 0) for k in range(0, 30, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, BASE[2])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        kept.append({r.doc_id for r in now.collect()})
    assert kept[0] >= set(range(len(BASE))) and not kept[1] & {25 + len(NEAR), 26 + len(NEAR), 27 + len(NEAR)}
    assert 2 in kept[2] and 2 not in kept[3] and kept[3] >= set(range(3, len(BASE)))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == kept[3]


def test_pipeline_learns_quality_from_labels_beyond_any_sample(spark, tmp_path):
    import corpus_pipeline

    # the documents are those whose labels come last in the order by which labels were once cut off at 40,000
    last = [r.id for r in spark.range(41_000).orderBy(F.xxhash64("id", F.lit("target")), "id").collect()[40_200:]]
    bad = set(last[::4])
    spark.range(41_000).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(bad), 0).otherwise(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(k, "buy now!! $$$ " * 30 if k in bad else prose(60)) for k in last]
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()}
    assert not kept & bad and len(kept) >= 590


def test_tables_of_ids_are_stored_in_few_files(spark):
    many = spark.range(0, 200, 1, 100)
    count = lambda df: len(df.inputFiles())
    few, all_ = store(many, "test", few=True), store(many, "test")
    assert count(few) <= 12 < count(all_) == 100 and sorted(r.id for r in few.collect()) == list(range(200))
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(100, "a")
    found = graph.components(links)
    assert count(found) <= 12 and {r.c for r in found.collect()} == {0}


def test_every_stage_of_the_pipeline_begins_with_heap_given_back(spark, docs, tmp_path, monkeypatch):
    import corpus_pipeline

    runtime, gateway = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    gateway.detach(gateway.new_array(spark._jvm.long, 40_000_000))  # garbage of 320 MB
    held = runtime.totalMemory()
    corpus_pipeline.give_back(spark)
    assert held > 320_000_000 and runtime.totalMemory() < held - 160_000_000

    spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, BASE[2])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    calls = []
    monkeypatch.setattr(corpus_pipeline, "give_back", calls.append)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path))
        assert len(calls) == k + 1, name


def test_a_handful_of_documents_gives_no_bar(spark):
    import corpus_pipeline

    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 5 == 0]
    told = lambda n: spark.createDataFrame([(k, "en", "en", 0.9 - 0.01 * i) for i, k in enumerate(ids[:n])], "doc_id long, lang string, lang_pred string, score double")
    assert corpus_pipeline.least_sure(told(0)) == corpus_pipeline.least_sure(told(29)) == 0
    assert corpus_pipeline.least_sure(told(30)) == pytest.approx(0.61, abs=0.002)
