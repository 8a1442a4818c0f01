"""Shared plumbing of the corpus operators: scratch tables, row keys, components.

Scratch tables live below the folder the cluster names in ``spark.checkpoint.dir``
so that every executor and the driver can read them; a lost executor therefore
never takes decisions with it.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.scratch import write as materialize

#: Stands in for a null id wherever ids are compared: smaller than any real one.
NULL_ID = -(2**63)


@contextlib.contextmanager
def one_blas_thread():
    """Linear algebra in the calling thread alone.

    The driver forks when it starts the JVM, and a BLAS library that has threads of its own
    can wait for ever for one of them afterwards. Where the library or its switch isn't
    found, nothing changes.
    """
    import numpy  # noqa: F401  loads the library

    put = got = None
    with contextlib.suppress(OSError):
        with open("/proc/self/maps") as maps:
            paths = {line.split(maxsplit=5)[5].strip() for line in maps if re.search(r"/lib[^/]*(openblas|mkl_rt)[^/]*\.so", line)}
        for path in sorted(paths):
            library = ctypes.CDLL(path)
            for prefix, suffix in (("scipy_openblas", "64_"), ("scipy_openblas", ""), ("openblas", "64_"), ("openblas", "")):
                put, got = getattr(library, f"{prefix}_set_num_threads{suffix}", None), getattr(library, f"{prefix}_get_num_threads{suffix}", None)
                if put and got:
                    break
            if put and got:
                break
    if not (put and got):
        yield
        return
    before = got()
    put(1)
    try:
        yield
    finally:
        put(before)


#: Bytes of a table, compressed as it lies, for one task: of tables up to FEW_TASKS tasks, and of larger ones.
TASK_BYTES, LARGE_TASK_BYTES, FEW_TASKS = 4 << 20, 64 << 20, 2000


def task_count(df: DataFrame) -> int:
    """Tasks enough for a table of its size, as Spark's plan tells that, and for the cluster's cores."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    many = -(-size // TASK_BYTES)
    many = many if many <= FEW_TASKS else max(FEW_TASKS, -(-size // LARGE_TASK_BYTES))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, many), 2**31 - 1)


def gathered(df: DataFrame) -> DataFrame:
    """A scan's rows in fewer partitions where those would be very small for a table of its size.

    What each task writes is a file, and each task starts a Python worker's work anew.
    Large tables stay as they are. Not for joins: a task would hold the hash tables of all
    partitions that it gathers.
    """
    return df.coalesce(task_count(df))


def position(df: DataFrame, name: str) -> int:
    """The column of that name: its exact spelling first, then any other case."""
    names = df.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 ...: names that clash or hold dots do no harm."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names, whatever other columns there are."""
    at = {new: position(df, old) for new, old in columns.items()}
    return numbered(df).select(*[F.col(f"c{k}").alias(new) for new, k in at.items()])


def row_keys(df: DataFrame, doc: Column, text: Column) -> DataFrame:
    """``df`` with the columns _doc and _rk, as keyed_texts() makes doc and rk."""
    df = df.withColumn("_doc", F.coalesce(doc.cast("long"), F.lit(NULL_ID)))
    return df.withColumn("_rk", F.xxhash64("_doc", F.coalesce(text.cast("string"), F.lit(""))))


def with_lengths(rows: DataFrame, docs: DataFrame, text_at: int, chars_col: str) -> DataFrame:
    """``rows`` (the numbered columns of ``docs``, texts changed) under the old names, lengths counted anew."""
    if any(n.lower() == chars_col.lower() for n in docs.columns):
        k = position(docs, chars_col)
        rows = rows.withColumn(f"c{k}", F.char_length(f"c{text_at}").cast(docs.schema[k].dataType))
    return rows.toDF(*docs.columns)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_text: bool = True) -> DataFrame:
    """(doc, rk, text): only what an operator needs, whatever other columns there are.

    ``doc`` is the id with null replaced by the smallest long; ``rk`` identifies the
    row's content, so rows that repeat an id with another text are kept apart and
    exact repeats share one decision. A null text becomes empty if ``null_text``.
    """
    text = F.col("text").cast("string")
    text = F.coalesce(text, F.lit("")) if null_text else text
    doc = F.coalesce(F.col("doc").cast("long"), F.lit(NULL_ID))
    rows = pick(docs, doc=id_col, text=text_col).select(doc.alias("doc"), text.alias("text"))
    return rows.select("doc", F.xxhash64("doc", "text").alias("rk"), "text")


def public_id(col: str | Column) -> Column:
    """The id as callers know it: the stand-in becomes null again."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col != F.lit(NULL_ID), col)


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); component is the smallest reachable node.

    Alternates large-star and small-star steps, each one grouped minimum and one
    join; hot nodes only meet partial aggregates and joins that can be split.
    Every round is written to the shared folder. An empty table gives no rows.
    """

    def print_of(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    seen = print_of(e)
    for _ in range(max_rounds if seen[0] else 0):
        # large star: every neighbour above u hangs on the least node around u
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lower neighbours hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = materialize(small, "star")
        now = print_of(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
