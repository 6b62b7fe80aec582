"""6. Quality classifier by importance resampling.

Two generative models of hashed n-grams (single tokens and pairs, in `buckets` buckets): one of the target, labelled
good documents, one of the raw text, all documents. A document's weight is the log ratio of its probabilities under the
two for each n-gram, shrunk as if it had `PRIOR` more of ratio 1. Weights are divided by `temperature`, Gumbel noise is
added, and the k documents with the largest sums are kept: a sample without replacement with chances in proportion to
exp(weight / temperature).

k is ceil(keep * number of documents with n-grams). With keep None the share is that of the labelled documents whose
weight is no less than that which all but `TAIL` of the good ones left out of the fit reach (at least the lowest of them
does), so that k is about the number of documents that are like the target.

The noise of a document comes from a hash of its id, so a task that runs again gives the same sample. All labels are read:
four fifths of the good ones, by a hash of their ids, fit the target model, and all labelled documents but those fitted on
give the share; the raw model counts every document. Labels are never broadcast: of the texts only those that may be
fitted on are shuffled, to be counted for the target. Counts leave each partition as one row per bucket in use.

The k-th key is found by a global ranking of ids and keys alone; equal keys at that place are all kept.

Defined cases: a null or empty text, or one without n-grams, is never sampled (weight and key null); equal rows get equal keys and
stand or fall together; no documents, no rows; without any labels all weights are 0 and the share is 1; labels other
than 0 and 1 are ignored, a row labelled both counts as good; a null id has a noise of its own; other columns pass through
`filter_documents` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import matching
from .tables import bound_batches, prefix_sums, store
from .text import KINDS, TOKENS, Words, blocks, raw

BUCKETS = 10_000
KEEP: float | None = None
TEMPERATURE = 0.01
PRIOR = 16
TAIL = 0.002
SMOOTHING = 1.0


def _grams(data: np.ndarray, offsets: np.ndarray, i: int, j: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of documents i to j, and the document of each."""
    w = Words(data, offsets, i, j, TOKENS, KINDS)
    doc = w.doc_of()
    pairs, at = w.shingles(2, short=False)
    number = np.concatenate([w.hashes, pairs]) % np.uint64(buckets)
    return number.astype(np.int64), np.concatenate([doc, np.repeat(np.arange(j - i), np.diff(at))])


def labelled(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """All labelled ids, once each: _id, _good and _fit (a good one to fit on)."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) == 1).alias("_good"))
    return known.withColumn("_fit", F.col("_good") & (F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(5)) != 0))


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is in the only column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = raw(batch.column(0))
            for i, j in blocks(offsets):
                n += np.bincount(_grams(data, offsets, i, j, buckets)[0], minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    out = np.zeros(buckets)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket's probability in the target to that in the raw text; labels: see labelled()."""
    bound_batches(docs.sparkSession)
    chosen = labels.where("_fit").select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col))
    target = _counts(matching(docs.select(id_col, text_col), chosen, id_col).select(text_col), buckets)
    if not target.sum():
        return np.zeros(buckets)
    p, q = target + SMOOTHING, _counts(docs.select(text_col), buckets) + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def score(docs: DataFrame, ratios: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with log_weight (for each n-gram; null without any) and n_grams; clashing columns of docs are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = [c for c in docs.columns if c not in ("log_weight", "n_grams")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in batches:
            data, offsets = raw(batch.column(batch.schema.get_field_index(text_col)))
            weights, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for i, j in blocks(offsets):
                number, doc = _grams(data, offsets, i, j, len(ratios))
                weights.append(np.bincount(doc, ratios[number], minlength=j - i))
                sizes.append(np.bincount(doc, minlength=j - i))
            size = np.concatenate(sizes)
            weight = np.round(np.concatenate(weights) / (size + PRIOR), 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(weight, mask=size == 0), pa.array(size)], names=[*names, "log_weight", "n_grams"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(run, f"{fields}, log_weight double, n_grams long")


def gumbel(key: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _keyed(scored: DataFrame, id_col: str, temperature: float, seed: int) -> DataFrame:
    return scored.withColumn("sample_key", F.round(F.col("log_weight") / temperature + gumbel(F.col(id_col).cast("string"), seed), 6))


def _at_rank(values: DataFrame, column: str, order: Column, rank: int) -> float:
    """The value at a place, from 0 on, by a global ranking."""
    ranked = prefix_sums(values.select(column), [order], {"rank": F.lit(1)}, "ranks", few=True)
    return ranked.where(F.col("rank") == rank).first()[column]


def share(scored: DataFrame, labels: DataFrame, *, id_col: str, tail: float = TAIL) -> float:
    """The share of the labelled documents that were left out of the fit, and the bad ones, that are like the target."""
    seen = labels.select(F.col("_id").alias(id_col), "_good", "_fit")
    known = store(scored.where("log_weight is not null").select(id_col, "log_weight").join(seen, id_col).select("log_weight", "_good", "_fit"), "known", few=True)
    good, fitted, n = known.agg(F.count_if("_good"), F.count_if("_fit"), F.count("*")).first()
    if good == fitted:
        return 1.0
    left_out = F.col("_good") & ~F.col("_fit")
    low = _at_rank(known.where(left_out), "log_weight", F.asc("log_weight"), math.floor(tail * (good - fitted)))
    like_good, like_bad = known.where(F.col("log_weight") >= low).agg(F.count_if(left_out), F.count_if(~F.col("_good"))).first()
    return (good * like_good / (good - fitted) + like_bad) / n


def threshold(keyed: DataFrame, keep: float) -> float:
    """The k-th largest key, by a global ranking."""
    some = keyed.where("sample_key is not null")
    k = math.ceil(min(1.0, keep) * some.count())
    if not k:
        return math.inf
    return _at_rank(some, "sample_key", F.desc("sample_key"), k - 1)


def _sampled(docs: DataFrame, labels: DataFrame, keep: float | None, temperature: float, seed: int, id_col: str, text_col: str, label_col: str, buckets: int) -> tuple[DataFrame, float, np.ndarray]:
    known = store(labelled(labels, id_col=id_col, label_col=label_col), "labelled", few=True)
    ratios = fit(docs, known, id_col=id_col, text_col=text_col, buckets=buckets)
    scored = score(docs.select(id_col, text_col), ratios, id_col=id_col, text_col=text_col).drop(text_col)
    keyed = store(_keyed(scored, id_col, temperature, seed), "scores")
    return keyed, threshold(keyed, share(keyed, known, id_col=id_col) if keep is None else keep), ratios


def resample(docs: DataFrame, labels: DataFrame, *, keep: float | None = KEEP, temperature: float = TEMPERATURE, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """Per document: id, log_weight, n_grams, sample_key, kept."""
    keyed, key, _ = _sampled(docs, labels, keep, temperature, seed, id_col, text_col, label_col, buckets)
    return keyed.withColumn("kept", F.coalesce(F.col("sample_key") >= F.lit(key), F.lit(False)))


def filter_documents(docs: DataFrame, labels: DataFrame, *, keep: float | None = KEEP, temperature: float = TEMPERATURE, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """The sampled documents with their own columns; texts are read again rather than shuffled."""
    _, key, ratios = _sampled(docs, labels, keep, temperature, seed, id_col, text_col, label_col, buckets)
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    hidden = docs.select(*(F.col(c).alias(own[c]) for c in docs.columns))
    scored = _keyed(score(hidden, ratios, id_col=own[id_col], text_col=own[text_col]), own[id_col], temperature, seed)
    return scored.where(F.col("sample_key") >= F.lit(key)).select(*(F.col(own[c]).alias(c) for c in docs.columns))
