"""1. Packing: concatenate and cut.

Pass one encodes every document and writes its ids with its place in its partition; the partitions' token totals give
each partition's global offset; pass two cuts the one long stream at multiples of the window. A document that crosses
a boundary leaves one record on either side. Only the last sequence needs padding.

Defined cases: a null or empty text is the end id alone; no documents, no pieces; equal rows and equal doc_ids are each
packed as they come; a text longer than a window spans as many as it needs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import store
from .tokens import DEFAULT_FILE, encoder


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_FILE, end_id: int = 0) -> DataFrame:
    """Per document: part, place (ids before it in its partition), id, doc_tokens (with the end id) and ids as unsigned 16-bit numbers; stored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part, enc = 0, TaskContext.get().partitionId(), encoder(tokenizer)
        for batch in batches:
            ids, at = enc.encode_column(batch.column(1))
            n = len(at) - 1
            at = at + np.arange(n + 1)
            ended = np.insert(ids, at[1:] - np.arange(1, n + 1), np.uint16(end_id))
            size = np.diff(at)
            column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((at * 2).astype(np.int64)), pa.py_buffer(ended)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(place + at[:-1]), batch.column(0), pa.array(size), column],
                names=["part", "place", id_col, "doc_tokens", "ids"],
            )
            place += int(at[-1])

    made = docs.select(id_col, text_col).mapInArrow(run, f"part int, place long, `{id_col}` {kind}, doc_tokens long, ids binary")
    return store(made, "tokens")


def pack(docs: DataFrame, *, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_FILE, end_id: int = 0) -> DataFrame:
    """Pieces: id, start (the document's ids before it), length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset, crosses (it goes on in the next sequence)."""
    tokens = encode(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id)
    kind = docs.schema[id_col].dataType.simpleString()
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # one row per input partition
    placed = tokens.join(F.broadcast(offsets), "part").select(id_col, (F.col("base") + F.col("place")).alias("at"), "doc_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pieces = (begin + size - 1) // window - begin // window + 1
            doc = np.repeat(np.arange(len(begin)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[doc] // window + nth
            low = np.maximum(begin[doc], sequence * window)
            high = np.minimum((begin + size)[doc], (sequence + 1) * window)
            ids = batch.column(3).cast(pa.large_binary())
            where = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            wide = np.frombuffer(ids.buffers()[2], np.uint8)[where[0] : where[-1]].view(np.uint16).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(high - low)]) * 4
            column = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(wide)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(low - begin[doc]), pa.array(high - low), column, pa.array(size[doc]), pa.array(sequence), pa.array(low - sequence * window), pa.array(high < (begin + size)[doc])],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "crosses"],
            )

    return placed.mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, crosses boolean")


def sequences(pieces: DataFrame, *, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids array<int> of exactly `window` ids, length without padding. A group has at most `window` ids."""
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("p"))
    text = F.array_join(F.col("p.ids"), "")
    n = (F.length(text) / 8).cast("int")
    number = lambda i: F.conv(F.concat(*(F.substring(text, i * 8 + k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<int>"))
    return joined.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(window) - n)).alias("ids"), n.alias("length"))
