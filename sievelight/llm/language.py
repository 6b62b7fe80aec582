"""5. Language ID: a bidirectional gated recurrent network over UTF-8 bytes, in NumPy.

Each direction has one gate: f = sigmoid(A[b] + hU), c = tanh(B[b] + (f*h)V), h <- h + f*(c - h). The two states at a
byte give a distribution over the languages, so every position of the whole text is labelled; a document's
probabilities are the mean over its positions. Texts are read in chunks of `chunk` bytes, many at a time.

It is trained on the driver by backpropagation through time (Adam) on a bounded sample: about `per_language` documents of
each language, chosen by a hash of id and text (twice that in all at most), and of each `pieces` pieces of `piece_chars`
characters at hashed places. All languages are learned; their number sets the size of the sample. Within a chunk the states start anew.

Defined cases: a null or empty text, or one without any letter, is `und` with score 0; so is every text if there is
nothing to learn from; equal rows get equal answers; a null id hashes as an empty one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bound_batches
from .text import raw

PER_LANGUAGE = 400
PIECES, PIECE_CHARS = 3, 80


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


class Network:
    """names: the languages. Weights of the two directions (A, B, U, V each) and of the output (W, b)."""

    def __init__(self, names: list[str], hidden: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        n = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.names, self.hidden = names, hidden
        self.w = []
        for _ in range(2):
            self.w += [n(256, hidden, scale=0.5) - 1, n(256, hidden, scale=0.5), n(hidden, hidden, scale=0.3), n(hidden, hidden, scale=0.3)]
        self.w += [n(2 * hidden, len(names), scale=0.3), np.zeros(len(names), np.float32)]

    def _states(self, text: np.ndarray, side: int) -> tuple[np.ndarray, list]:
        """text: bytes [time, batch], already in reading order. States [time, batch, hidden] and what the backward pass needs."""
        A, B, U, V = self.w[4 * side : 4 * side + 4]
        h = np.zeros((text.shape[1], self.hidden), np.float32)
        out, kept = np.empty((*text.shape, self.hidden), np.float32), []
        for t, b in enumerate(text):
            f = _sigmoid(A[b] + h @ U)
            g = f * h
            z = np.tanh(B[b] + g @ V)
            kept.append((h, f, g, z))
            h = h + f * (z - h)
            out[t] = h
        return out, kept

    def gradients(self, text: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over valid positions of text [time, batch], and its gradients."""
        W, b = self.w[8:]
        forth, kept0 = self._states(text, 0)
        back, kept1 = self._states(text[::-1], 1)
        both = np.concatenate([forth, back[::-1]], 2)
        logits = both @ W + b
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        count = max(1, int(valid.sum()))
        right = np.take_along_axis(p, label[None, :, None], 2)[..., 0]
        loss = float(-(np.log(right + 1e-9) * valid).sum() / count)
        p -= np.eye(len(self.names), dtype=np.float32)[label]
        p *= (valid / count)[..., None].astype(np.float32)
        grads = [np.zeros_like(x) for x in self.w]
        grads[8] += np.einsum("tbh,tbk->hk", both, p)
        grads[9] += p.sum((0, 1))
        outer = p @ W.T
        for side, kept, d, own in ((0, kept0, outer[..., : self.hidden], text), (1, kept1, outer[::-1, :, self.hidden :], text[::-1])):
            A, B, U, V = self.w[4 * side : 4 * side + 4]
            gA, gB, gU, gV = grads[4 * side : 4 * side + 4]
            later = np.zeros_like(d[0])
            for t in range(len(own) - 1, -1, -1):
                h, f, g, z = kept[t]
                now = d[t] + later
                dc = now * f * (1 - z * z)
                dg = dc @ V.T
                da = (now * (z - h) + dg * h) * f * (1 - f)
                later = now * (1 - f) + dg * f + da @ U.T
                np.add.at(gA, own[t], da)
                np.add.at(gB, own[t], dc)
                gU += h.T @ da
                gV += g.T @ dc
        return loss, grads

    def train(self, text: np.ndarray, valid: np.ndarray, label: np.ndarray, *, steps: int = 150, batch: int = 192, rate: float = 0.02, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        m, v = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w]
        for step in range(1, steps + 1):
            some = r.integers(0, text.shape[1], batch)
            _, grads = self.gradients(text[:, some], valid[:, some], label[some])
            now = rate * (1 - 0.9 * step / steps)
            for k, g in enumerate(grads):
                np.clip(g, -1, 1, out=g)
                m[k] += np.float32(0.1) * (g - m[k])
                v[k] += np.float32(0.01) * (g * g - v[k])
                self.w[k] -= np.float32(now) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-7))

    def _run(self, text: np.ndarray, side: int) -> np.ndarray:
        """Logits [time, batch, languages] of one direction, without what training keeps."""
        A, B, U, V = self.w[4 * side : 4 * side + 4]
        half = self.w[8][side * self.hidden : (side + 1) * self.hidden]
        n = text.shape[1]
        h, f, z, m = (np.zeros((n, self.hidden), np.float32) for _ in range(4))
        out = np.empty((len(text), n, len(self.names)), np.float32)
        for t in range(len(text)):
            np.take(A, text[t], 0, out=f)
            np.matmul(h, U, out=m)
            f += m
            _sigmoid(f)
            np.multiply(f, h, out=m)
            np.take(B, text[t], 0, out=z)
            z += m @ V
            np.tanh(z, out=z)
            z -= h
            z *= f
            h += z
            np.matmul(h, half, out=out[t])
        return out

    def pooled(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 128, batch: int = 2048) -> np.ndarray:
        """Mean probabilities of each text over all its bytes."""
        size = np.diff(offsets)
        chunks = -(-size // chunk)
        doc = np.repeat(np.arange(len(size)), chunks)
        begin = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * chunk
        length = np.minimum(chunk, offsets[1:][doc] - begin)
        sums = np.zeros((len(doc), len(self.names)))
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            steps = np.arange(int(length[some[0]]))[:, None]
            inside = steps < length[some]
            text = np.where(inside, data[np.minimum(begin[some] + steps, len(data) - 1)], 32).astype(np.intp)
            last = length[some] - 1
            logits = self._run(text, 0)
            turned = np.take_along_axis(text, np.where(inside, last - steps, steps), 0)
            logits += np.take_along_axis(self._run(turned, 1), np.where(inside, last - steps, steps)[..., None], 0)
            logits += self.w[9]
            logits -= logits.max(2, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(2, keepdims=True)
            logits *= inside[..., None]
            sums[some] = logits.sum(0)
        out = np.zeros((len(size), len(self.names)))
        np.add.at(out, doc, sums)
        return out / np.maximum(size, 1)[:, None]


def learn(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, pieces: int = PIECES, piece_chars: int = PIECE_CHARS, length: int = 48, steps: int = 150) -> Network | None:
    """Learns from rows that are `usable` and have a language and a text."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = rows.groupBy("l").count().orderBy("l").collect()  # a row per language
    if not counts:
        return None
    rates = F.create_map(*(F.lit(x) for r in counts for x in (r.l, per_language / r["count"])))
    chance = lambda k: F.pmod(F.xxhash64("i", "t", F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    at = lambda k: (F.lit(1) + F.floor(chance(k) * F.greatest(F.lit(1), F.length("t") - piece_chars + 1))).cast("int")
    chosen = rows.where(chance(0) < F.element_at(rates, F.col("l"))).select("l", F.array(*(F.substring("t", at(k + 1), piece_chars) for k in range(pieces))).alias("p"))
    found = chosen.dropDuplicates().limit(2 * per_language * len(counts)).collect()
    names = sorted(r.l for r in counts)
    got = sorted((r.l, p) for r in found for p in set(r.p))
    text, valid = np.full((length, len(got)), 32, np.uint8), np.zeros((length, len(got)), bool)
    for k, (_, p) in enumerate(got):
        b = np.frombuffer(p.encode()[:length], np.uint8)
        text[: len(b), k], valid[: len(b), k] = b, True
    if not got:
        return None
    net = Network(names)
    net.train(text.astype(np.intp), valid, np.array([names.index(lang) for lang, _ in got]), steps=steps)
    return net


def identify(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; clashing columns of docs are replaced."""
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    ready = docs.select(*names, letters.alias("_letters" + "".join(names)))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            n = batch.num_rows
            told, score = ["und"] * n, np.zeros(n)
            some = batch.column(n_cols).to_numpy(zero_copy_only=False)
            if net is not None and some.any():
                data, offsets = raw(batch.column(batch.schema.get_field_index(text_col)))
                p = net.pooled(data, offsets)
                best = p.argmax(1)
                told = [net.names[b] if s else "und" for b, s in zip(best, some, strict=True)]
                score = np.where(some, np.clip(p[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(told, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    n_cols = len(names)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return ready.mapInArrow(run, f"{fields}, lang_pred string, score double")


def remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(k))
