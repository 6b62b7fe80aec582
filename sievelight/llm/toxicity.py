"""7. Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and full-width forms to Latin ones, digits and
signs that stand for letters to those letters, invisible characters dropped. The lexicon holds beginnings of words
(whole words, if short) with log odds as weights, learned from labelled rows. A match counts at the start of a word and
outside the exception phrases, which the same automaton finds. The weights of a text's matches, normalised by its length,
and their number go through a logistic function fitted on other labelled rows.

Learning uses at most `rows` labelled rows of either class, chosen by a hash (their ids are broadcast): one half of them
gives the lexicon, the other the logistic function. Candidates are all beginnings of SHORTEST to LONGEST characters and all
shorter words as a whole. The texts that hold a candidate are counted on executors, near copies (texts with the same
MinHash of their runs of five words) once; a candidate becomes an entry if LEAST_TEXTS toxic texts hold it, its odds are
high and too clear to be chance (likelihood ratio of EVIDENCE). The bound on rows is the only one.

Defined cases: a null or empty text scores as one without matches; without any label to learn from the score is 0; labels
other than 0 and 1 are ignored, a row labelled both counts as toxic; equal rows get equal scores; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import store

THRESHOLD = 0.7
ROWS = 10_000
SHORTEST, LONGEST = 4, 8
#: An entry must be in so many toxic texts at least, and in no more than that share of the others.
LEAST_TEXTS, CLEAN_SHARE = 3, 0.002
#: Least log odds of an entry, and the least statistic G of a likelihood ratio test: by chance one word in 2,000 reaches that.
LEAST_ODDS, EVIDENCE = 2.0, 12.0
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "circus clown", "pond scum", "stupid luck")
#: Look-alikes, by the Latin letter they are read as.
LOOKALIKES = {
    "a": "аαａ@4", "b": "ЬвβｂƄ8", "c": "сϲｃ", "d": "ԁｄ", "e": "еєεｅ3", "f": "ｆ", "g": "ɡｇ9", "h": "һｈ", "i": "іιｉ1!|", "j": "јｊ",
    "k": "кκｋ", "l": "ӏｌ", "m": "мｍ", "n": "пηｎ", "o": "оοσｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ$5", "t": "тτｔ7",
    "u": "υｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ2",
}
#: Invisible characters.
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = {ord(c): latin for latin, like in LOOKALIKES.items() for c in like} | dict.fromkeys(map(ord, INVISIBLE))


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def candidates(folded: str) -> tuple[set[str], int]:
    """Beginnings of words, and short words with a space behind; and the MinHash of the text."""
    words = "".join(c if c.isalpha() else " " for c in folded).split()
    out = {word[:n] for word in set(words) for n in range(SHORTEST, min(LONGEST, len(word)) + 1)}
    out.update(word + " " for word in set(words) if len(word) < SHORTEST)
    return out, min((zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))), default=0)


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    weights: tuple[float, float, float] | None  # of the length-normalised weight, of the number of matches, constant

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(fold(phrase), (len(fold(phrase)), None, False))
        for entry, weight in self.lexicon.items():
            if entry.strip() not in a:
                a.add_word(entry.strip(), (len(entry.strip()), weight, entry[-1] == " "))
        a.make_automaton()
        return a if len(a) else None

    def features(self, automaton, text: str | None) -> tuple[float, int]:
        """Weight a thousand characters, and the number of matches."""
        if not text or automaton is None:
            return 0.0, 0
        folded = fold(text)
        found, reach, free = [], -1, []
        for end, (size, weight, whole) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            elif (start == 0 or not folded[start - 1].isalnum()) and not (whole and folded[end + 1 : end + 2].isalnum()):
                found.append((start, end, weight))
        if free:  # a match lies in an exception if the furthest end of those that begin no later covers it
            free.sort()
            kept, k = [], 0
            for start, end, weight in sorted(found):
                while k < len(free) and free[k][0] <= start:
                    reach, k = max(reach, free[k][1]), k + 1
                if end > reach:
                    kept.append((start, end, weight))
            found = kept
        return sum(w for _, _, w in found) * 1000 / (len(folded) + 200), len(found)

    def probability(self, density: np.ndarray, matches: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(density))
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a * np.log1p(density) + b * np.log1p(matches) + c, -30, 30)))


def _fit(density: np.ndarray, matches: np.ndarray, label: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; classes weigh alike."""
    x = np.stack([np.log1p(density), np.log1p(matches), np.ones(len(label))], 1)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - label)) + ridge * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        w -= np.linalg.solve(curve, grad)
    w[:2] = np.maximum(w[:2], 0)  # more matches never make a text less toxic
    return float(w[0]), float(w[1]), float(w[2])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    hashed = known.withColumn("_h", F.xxhash64("_id", F.lit("tox")))
    chosen = None
    for y in (0, 1):
        some = hashed.where(F.col("_y") == y).orderBy("_h", "_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
    texts = store(texts.select("_t", "_y", (F.pmod("_h", F.lit(2)) == 0).alias("_first")).dropDuplicates(), "toxic_sample")
    sizes = {(r._first, r._y): r["count"] for r in texts.groupBy("_first", "_y").count().collect()}
    n_toxic, n_clean = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    if not n_toxic or not n_clean:
        return Model({}, exceptions, None)

    def count(only: frozenset[str] | None, least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: set[tuple[str, int]] = set()
                for t in batch.column(0).to_pylist():
                    own, text = candidates(fold(t or ""))
                    seen.update((e, text) for e in (own if only is None else own & only))
                yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int64())], names=["e", "t"])

        rows = texts.where("_first").where(F.col("_y") == (1 if only is None else 0)).select("_t").mapInArrow(run, "e string, t long")
        got = rows.distinct().groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        return {r.e: r.n for r in got.collect()}  # at most the beginnings of words in `rows` texts that are in several

    toxic = count(None, LEAST_TEXTS)
    clean = count(frozenset(toxic), 1)
    odds = {e: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(e, 0) + 0.5) / (n_clean + 1))) for e, n in toxic.items()}

    def evidence(n: int, c: int) -> float:
        share = n_toxic / (n_toxic + n_clean)
        return 2 * sum(x * np.log(x / ((n + c) * p)) for x, p in ((n, share), (c, 1 - share)) if x)

    good = {e for e in odds if evidence(toxic[e], clean.get(e, 0)) >= EVIDENCE and clean.get(e, 0) <= CLEAN_SHARE * n_clean and odds[e] > LEAST_ODDS}
    # of beginnings of one another the shortest that is good stays
    kept = {e: odds[e] for e in good if not any(e[:n] in good for n in range(SHORTEST, len(e)))}
    model = Model(dict(sorted(kept.items())), exceptions, None)

    rest = texts.where("not _first")
    if {y for first, y in sizes if not first} != {0, 1}:
        rest = texts
    measured = _features(rest.select("_t", "_y"), model, "_t").select("_y", "_density", "_matches").collect()
    label, density, matches = (np.array(c, float) for c in zip(*measured, strict=True))
    model.weights = _fit(density, matches, label)
    return model


def _features(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    names = [c for c in docs.columns if c not in ("_density", "_matches")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, automaton = shared.value, None
        for batch in batches:
            automaton = automaton or model.automaton()
            pairs = [model.features(automaton, t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.int64())], names=[*names, "_density", "_matches"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(run, f"{fields}, _density double, _matches long")


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with score and n_matches; clashing columns of docs are replaced."""
    names = [c for c in docs.columns if c not in ("score", "n_matches")]
    made = _features(docs.select(*names), model, text_col)
    if model.weights is None:
        p = F.lit(0.0)
    else:
        a, b, c = model.weights
        z = F.log1p("_density") * a + F.log1p("_matches") * b + c
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return made.withColumn("score", p).withColumnRenamed("_matches", "n_matches").drop("_density")
