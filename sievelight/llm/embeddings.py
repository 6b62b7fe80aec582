"""10. Embedding near-dedup by epsilon grid order join.

On unit vectors a cosine of at least t is a distance of at most eps = sqrt(2 - 2t). Vectors are projected on their leading
principal directions, laid on a grid of cells of width eps, and sorted by cell, dimension by dimension: the epsilon
grid order. The sequence is cut into intervals (blocks). Two blocks are joined only if they have cells next to each other
and their boxes aren't provably farther than eps apart; a join halves both sides and drops the halves that are too far
apart, down to leaves. A box holds the projections on `BOX_DIMS` directions and the length of what they leave of a vector:
the distance is at least that of the projections and the difference of those lengths together. Leaves are compared in
single precision first, and what comes within 1e-3 of the least cosine again in double precision.

Equal vectors are one class from the start. A join returns, for each class, with how many vectors of the other block
it links, and a spanning forest of the links; so a large group leaves as many rows as it has members. The directions come
from a sample of at most `sample` vectors; they only decide what can be skipped. On vectors without structure no box
is far from another, all pairs of blocks are compared and the time grows with the square of the rows; a block
holds an eighth of the rows, 2048 at least and 32768 at most, so rows are copied to few pairs.

Defined cases: vectors that are null, of no length, or hold null or non-finite components link with nothing, not even
their copies; vectors of different dimensions link with nothing between them; equal rows are vectors of their own;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import join_unique, prefix_sums, store, union_all

LEAF = 512
#: Directions of the grid, of the cells by which blocks are paired, and of boxes.
GRID_DIMS, KEY_DIMS, BOX_DIMS = 6, 3, 16
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 2_048, 32_768, 8
#: Single precision errs by far less than this on unit vectors.
SLACK = 1e-3


def _directions(classes: DataFrame, dim: int, sample: int) -> np.ndarray:
    got = classes.orderBy(F.xxhash64("rep", F.lit("pca")), "rep").limit(sample).select("vec").collect()
    x = np.array([r.vec for r in got], np.float64).reshape(-1, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, v = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))  # in ascending order
    return np.ascontiguousarray(v[:, ::-1][:, : min(BOX_DIMS, dim)])


def _place(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and coordinates of the unit vectors: projections, and the length of the rest."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    p = (x / norm[:, None]) @ axes
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p, p)))
    return norm, np.column_stack([p, rest])


class _Side:
    """One block in grid order."""

    def __init__(self, rows: pa.Array, dim: int, axes: np.ndarray, kind: str):
        rank = rows.field("rank").to_numpy()
        order = np.argsort(rank)
        self.rep = rows.field("rep").to_numpy()[order]
        self.m = rows.field("m").to_numpy()[order]
        packed = rows.field("x").cast(pa.large_binary())
        at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
        self.x = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(-1, dim)[order].astype(np.float64)
        self.norm, self.p = _place(self.x, axes)
        self.unit = (self.x / self.norm[:, None]).astype(np.float32)
        self.count = np.zeros(len(rank), np.int64)


def _join(a: _Side, b: _Side, same: bool, least: float, leaf: int = LEAF) -> tuple[list[tuple[int, int]], int]:
    """Adds to the counts of both sides; links of a spanning forest, and the number of pairs compared."""
    far = 2 - 2 * least + 1e-9
    n, compared = len(a.rep), 0
    label = np.arange(n + (0 if same else len(b.rep)))
    shift, forest = (0 if same else n), []
    todo = [(0, n, 0, len(b.rep))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or same and i >= m:
            continue
        gap = np.maximum(0, np.maximum(a.p[i:j].min(0) - b.p[k:m].max(0), b.p[k:m].min(0) - a.p[i:j].max(0)))
        if gap @ gap > far:
            continue
        if j - i > leaf or m - k > leaf:
            h, g = (i + j) // 2 if j - i > leaf else j, (k + m) // 2 if m - k > leaf else m
            todo += [(s, e, t, u) for s, e in ((i, h), (h, j)) for t, u in ((k, g), (g, m))]
            continue
        compared += (j - i) * (m - k)
        near = a.unit[i:j] @ b.unit[k:m].T >= np.float32(least - SLACK)
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            continue
        x, y = rows + i, cols + k
        hit = (a.x[x] @ b.x[y].T) / (a.norm[x][:, None] * b.norm[y]) >= least
        if same:  # each pair once
            hit &= x[:, None] < y
        if not hit.any():
            continue
        a.count[x] += hit @ b.m[y]
        b.count[y] += a.m[x] @ hit
        r, c = np.nonzero(hit)
        x, y = x[r], y[c]
        apart = label[x] != label[y + shift]
        x, y = x[apart], y[apart]
        while len(x):
            forest.append((int(a.rep[x[0]]), int(b.rep[y[0]])))
            label[label == label[y[0] + shift]] = label[x[0]]
            apart = label[x] != label[y + shift]
            x, y = x[apart], y[apart]
    return forest, compared


def _links(classes: DataFrame, dim: int, least: float, block: int | None, sample: int) -> DataFrame:
    """classes: rep, m, vec. Rows (a, n, null) for counts and (a, null, b) for links."""
    spark = classes.sparkSession
    axes = _directions(classes, dim, sample)
    shared, width = spark.sparkContext.broadcast(axes), float(np.sqrt(2 - 2 * least))
    kind = "<f4" if classes.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"
    g, d = min(GRID_DIMS, axes.shape[1]), axes.shape[1] + 1
    block = block or max(LEAST_BLOCK, min(MOST_BLOCK, -(-classes.count() // BLOCKS)))

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind)).reshape(-1, dim)
            p = _place(x.astype(np.float64), shared.value)[1]
            cells = np.floor(p[:, :g] / width).astype(np.int32)
            packed = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * x.strides[0]), pa.py_buffer(x)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed, *(pa.array(np.ascontiguousarray(c)) for c in cells.T), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], names=["rep", "m", "x", *(f"c{k}" for k in range(g)), *(f"p{k}" for k in range(d))])

    fields = ", ".join(["rep long, m long, x binary", *(f"c{k} int" for k in range(g)), *(f"p{k} double" for k in range(d))])
    placed = classes.select("rep", "m", "vec").mapInArrow(grid, fields)
    order = [*(F.col(f"c{k}") for k in range(g)), F.col("rep")]
    line = prefix_sums(placed, order, {"rank": F.lit(1)}, "order").withColumn("block", F.expr(f"rank div {block}"))
    boxes = store(line.groupBy("block").agg(*(f(f"p{k}").alias(f"{n}{k}") for k in range(d) for n, f in (("lo", F.min), ("hi", F.max)))), "boxes")
    blocks = store(line.groupBy("block").agg(F.collect_list(F.struct("rank", "rep", "m", "x")).alias("rows")), "blocks")  # of `block` rows at most
    keys = [f"c{k}" for k in range(min(KEY_DIMS, g))]
    cells = line.select("block", *keys).distinct()
    near = cells
    for c in keys:
        near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    pairs = near.withColumnRenamed("block", "i").join(cells.withColumnRenamed("block", "j"), keys).where("i <= j").select("i", "j").distinct()
    box = lambda s: boxes.select(F.col("block").alias(s), *(F.col(f"{n}{k}").alias(f"{s}{n}{k}") for k in range(d) for n in ("lo", "hi")))
    gap = [F.greatest(F.lit(0.0), F.col(f"ilo{k}") - F.col(f"jhi{k}"), F.col(f"jlo{k}") - F.col(f"ihi{k}")) for k in range(d)]
    pairs = pairs.join(box("i"), "i").join(box("j"), "j").where(sum((x * x for x in gap), F.lit(0.0)) <= 2 - 2 * least + 1e-9).select("i", "j")
    pairs = store(pairs, "block_pairs")
    n_pairs = pairs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                a = _Side(batch.column(2)[k].values, dim, axes, kind)
                b = a if i == j else _Side(batch.column(3)[k].values, dim, axes, kind)
                forest, _ = _join(a, b, i == j, least)
                rep = np.concatenate([s.rep[s.count > 0] for s in ([a] if i == j else [a, b])])
                count = np.concatenate([s.count[s.count > 0] for s in ([a] if i == j else [a, b])])
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(count), none(len(rep))], names=["a", "n", "b"])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in forest], pa.int64()), none(len(forest)), pa.array([y for _, y in forest], pa.int64())], names=["a", "n", "b"])

    other = blocks.select(F.col("block").alias("j"), F.col("rows").alias("y"))
    both = pairs.join(blocks.select(F.col("block").alias("i"), F.col("rows").alias("x")), "i").join(other, "j")
    both = both.select("i", "j", "x", "y").repartition(max(1, min(n_pairs, 100_000)), "i", "j")
    return store(both.mapInArrow(run, "a long, n long, b long"), "vector_links")


def classes(vectors: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None, sample: int = 5_000) -> DataFrame:
    """Per row: id, n_links, component_id, kept. Ids are numbers; block: rows of a block."""
    v = F.col(vec_col)
    kind = "float" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"
    sound = F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, F.transform(v, lambda x: x.cast(kind) + F.lit(0).cast(kind))).alias("vec"))
    key = F.concat_ws(":", F.size("vec"), F.xxhash64("vec"), F.hash("vec"))
    valid = rows.where("vec is not null").withColumn("key", key)
    groups = store(valid.groupBy("key", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("dim", F.size("vec")), "vectors")
    found = [_links(groups.where(F.col("dim") == r.dim), r.dim, least, block, sample) for r in groups.select("dim").distinct().collect()]
    own = groups.select("rep", (F.col("m") - 1).alias("n"))
    if found:
        links = union_all(found)
        joined = components(links.where("b is not null").select("a", "b"), "vector_components")
        own = own.unionByName(links.where("n is not null").select(F.col("a").alias("rep"), "n")).groupBy("rep").agg(F.sum("n").alias("n"))
        own = own.join(joined.select(F.col("v").alias("rep"), "c"), "rep", "left").select("rep", "n", F.coalesce("c", "rep").alias("c"))
    else:
        own = own.withColumn("c", F.col("rep"))
    told = groups.select("key", "rep", "m").join(own, "rep").select("key", "m", "n", "c")
    # vectors that never match stay out of the join
    out = join_unique(valid.select("id", "key"), told, "key", "m").select("id", "n", "c")
    out = out.unionByName(rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c")))
    return out.select("id", F.col("n").alias("n_links"), F.col("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))
