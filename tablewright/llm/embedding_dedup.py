"""Embedding near-dedup: PCA-ordered tiles, partial products bounded by suffix norms.

Unit vectors are rotated to their principal axes. Vectors whose cosine reaches the
threshold are at most sqrt(2 - 2 t) apart, so also on each leading axis: a grid of that
width over two axes gives tiles, and a tile meets itself and its neighbours only; a
large tile is cut along the third axis as well, and dealt into blocks.
Within a tile leading dimensions are accumulated first; a pair is given up as soon as
the product so far plus that of the norms of what is left can't reach the threshold.
Exact copies are one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import NULL_ID, connected_components, materialize, one_blas_thread, pick, public_id
from tablewright.llm.minhash_dedup import Forest, group_stream

THRESHOLD = 0.98
BLOCK_ROWS = 4096
STEPS = (8, 24)
_TILE = ["label", "dims", "c1", "c2"]
#: A pair of blocks of a tile: the cell on the third axis and the block in it, of each.
_GROUP = [*_TILE, "si", "i", "sj", "j"]
_SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near 1: no square under- or overflows, no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1))[1][..., None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=-1))[..., None]


def _second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of outer products of unit vectors, by length: one row for each length and axis a task saw."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for v in batch.column("vec").to_pylist():
            x = unit(np.array(v, float))
            held = sums.setdefault(len(x), np.zeros((len(x), len(x))))
            held += np.outer(x, x)
    rows = [(d, i, m[i].tolist()) for d, m in sums.items() for i in range(d)]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.float64()))], ["dims", "i", "sums"])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """A rotation for each vector length, leading axis first. Its size depends on the dimensions only."""
    parts = classes.select("vec").mapInArrow(_second_moments, "dims int, i int, sums array<double>")
    cells = parts.select("dims", "i", F.posexplode("sums").alias("j", "s")).groupBy("dims", "i", "j").agg(F.sum("s").alias("s")).collect()
    out: dict[int, np.ndarray] = {d: np.zeros((d, d)) for d in {c["dims"] for c in cells}}
    for c in cells:
        out[c["dims"]][c["i"], c["j"]] = c["s"]
    with one_blas_thread():
        return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in out.items()}


def _tiles(axes: dict[int, np.ndarray], width: float):
    """Each vector in its own tile, and as a visitor in half of the tiles around it."""
    around = [(0, 1), (1, -1), (1, 0), (1, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, cls, vec in zip(batch.column("label").to_pylist(), batch.column("cls").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                x = np.array(vec, float)
                d = len(x)
                p = unit(x) @ axes[d][:, : min(3, d)]
                c = [int(np.floor(v / width)) for v in p] + [0] * (3 - len(p))
                rows += [(label, d, c[0] + i, c[1] + j, c[2], i == j == 0, cls) for i, j in [(0, 0), *around]]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["label", "dims", "c1", "c2", "c3", "home", "cls"])

    return run


def linked_pairs(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, threshold: float, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with cosine(x[i], y[j]) >= threshold. ux, uy: their rotated unit vectors."""
    d = ux.shape[1]
    ends = sorted({min(s, d) for s in steps} | {d})
    rest = lambda u, e: np.sqrt(np.maximum((u[:, e:] ** 2).sum(axis=1), 0))
    e = ends[0]
    so_far = ux[:, :e] @ uy[:, :e].T
    i, j = np.nonzero(so_far + np.outer(rest(ux, e), rest(uy, e)) >= threshold - _SLACK)
    so_far = so_far[i, j]
    for a, e in zip(ends, ends[1:], strict=False):
        so_far = so_far + np.einsum("ij,ij->i", ux[i, a:e], uy[j, a:e])
        alive = so_far + rest(ux, e)[i] * rest(uy, e)[j] >= threshold - _SLACK
        i, j, so_far = i[alive], j[alive], so_far[alive]
    cosine = np.einsum("ij,ij->i", x[i], y[j]) / (np.sqrt((x * x).sum(axis=1))[i] * np.sqrt((y * y).sum(axis=1))[j])
    hit = cosine >= threshold
    return i[hit], j[hit]


def _compare(axes: dict[int, np.ndarray], threshold: float, slice_rows: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in group_stream(batches, _GROUP):
            cls, copies, home, cell, part = (group.column(c).to_numpy() for c in ("cls", "copies", "home", "cell", "part"))
            two = any(group.column(a)[0] != group.column(b)[0] for a, b in (("si", "sj"), ("i", "j")))
            x = scaled(np.array(group.column("vec").to_pylist(), float))
            u = unit(x) @ axes[x.shape[1]]
            links, forest = np.zeros(len(cls), np.int64), Forest(len(cls))
            # every pair once: home with home, home with visitor; of two blocks only pairs across
            first = np.flatnonzero(home)
            for s in range(0, len(first), slice_rows):
                rows = first[s : s + slice_rows]
                i, j = linked_pairs(x[rows], x, u[rows], u, threshold)
                i = rows[i]
                fit = (home[j] & (cls[i] < cls[j])) | ~home[j]
                if two:
                    fit &= (part[i] != part[j]) | (cell[i] != cell[j])
                i, j = i[fit], j[fit]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                cut = np.flatnonzero(i[1:] != i[:-1]) + 1
                for a, several in zip(i[np.concatenate([[0], cut])] if len(i) else (), np.split(j, cut), strict=False):
                    for b in several[np.unique(forest.root[several], return_index=True)[1]]:
                        forest.join(a, b)
            first_of = {}
            for k in np.flatnonzero(links):
                first_of.setdefault(forest.root[k], k)
            out = [(int(cls[k]), int(links[k]), int(cls[first_of[forest.root[k]]])) for k in np.flatnonzero(links)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cls", "links", "root"])

    return run


def embedding_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector.

    Vectors are compared where labels are equal and not null and lengths agree. Null, zero
    and empty vectors and those with null or non-finite components link with nothing;
    very large and very small components do no harm. Repeated ids are vectors of their
    own, equal vectors link whatever their ids; a null id is smaller than any other. Other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    vec = F.transform(F.col("vec"), lambda v: v.cast("double"))
    whole = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = pick(vectors, vec_id=id_col, vec=vec_col, label=label_col)
    rows = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), vec.alias("vec"), F.col("label").cast("long").alias("label"))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & whole & F.exists("vec", lambda v: v != 0)
    rows = materialize(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    good = rows.where("usable")
    # copies of a vector are one class; its smallest id is in its name's place
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cls", F.xxhash64("label", "vec")), "vector-classes")
    axes = principal_axes(classes)
    width = float(np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6)
    tiled = classes.select("label", "cls", "vec").mapInArrow(_tiles(axes, width), "label long, dims int, c1 int, c2 int, c3 int, home boolean, cls long")
    key, block_of = _TILE, lambda s, p: F.struct(F.col(s).alias("s"), F.col(p).alias("p"))
    tiled = materialize(tiled, "tiles")
    sizes = tiled.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where("homes > 0 and n > 1")
    # of large tiles, cells more than one apart on the third axis can't reach the threshold
    placed = tiled.join(sizes.select(*key, (F.col("n") > block_rows).alias("large")), key)
    placed = placed.withColumn("cell", F.when(F.col("large"), F.col("c3")).otherwise(0)).drop("c3")
    cells = placed.groupBy(*key, "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    dealt = placed.join(cells, [*key, "cell"]).withColumn("part", F.pmod("cls", "parts").cast("int")).drop("parts")
    near = F.when(F.col("large"), F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).otherwise(F.array(F.col("cell")))
    met = dealt.withColumn("other", F.explode(near)).join(cells.withColumnRenamed("cell", "other"), [*key, "other"])
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least(block_of("cell", "part"), block_of("other", "block")), F.greatest(block_of("cell", "part"), block_of("other", "block"))
    met = met.select(*key, low["s"].alias("si"), low["p"].alias("i"), high["s"].alias("sj"), high["p"].alias("j"), "cell", "part", "home", "cls")
    keyed = met.join(classes.select("cls", "copies", "vec"), "cls")
    found = keyed.select(*_GROUP, "cell", "part", "home", "cls", "copies", "vec").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "cls")
    found = materialize(found.mapInArrow(_compare(axes, threshold), "cls long, links long, root long"), "vector-links")
    components = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    direct = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "label", "vec", "copies", "least").join(components.select(F.col("node").alias("cls"), "component"), "cls", "left")
    named = named.join(direct, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = named.join(lowest, "component").select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.withColumn("cls", F.when(F.col("usable"), F.xxhash64("label", "vec"))).join(per_class, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        public_id("vec_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), public_id(component).alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
