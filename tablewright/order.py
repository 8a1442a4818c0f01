"""Row numbers and row ids, without ever putting a table's rows into one task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import scratch
from tablewright.package import ROW_ID, Resource

_AT, _PART, _BASE, _ID, NUMBER = "__at", "__part", "__base", "__id", "__number"


def _placed(held: DataFrame) -> DataFrame:
    """A written table with its column __at (partition and place in it) turned into numbers 1 .. n.

    Only the sizes of its partitions go to the driver.
    """
    part = F.shiftright(_AT, 33)
    base, bases = 0, []
    for p, n in sorted(tuple(r) for r in held.groupBy(part.alias("p")).count().collect()):
        bases.append((p, base))
        base += n
    table = held.sparkSession.createDataFrame(bases, f"{_PART} long, {_BASE} long")
    df = held.withColumn(_PART, part).join(F.broadcast(table), _PART)
    return df.withColumn(NUMBER, F.col(_BASE) + F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(_AT, _PART, _BASE)


def numbers(res: Resource) -> DataFrame | None:
    """(__id, __number) of every row: ids alone are sorted and written, no other column.

    None where ids can't be told apart or may differ when they are computed again.
    """
    if not res.stable:
        return None
    ids = res.df.select(F.col(ROW_ID).alias(_ID))
    held = scratch.write(ids.repartitionByRange(_ID).sortWithinPartitions(_ID).withColumn(_AT, F.monotonically_increasing_id()), "ids")
    if not held.groupBy(_ID).count().where("count > 1").isEmpty():
        return None
    return _placed(held)


def numbered(res: Resource, pick: Callable[[DataFrame], DataFrame] | None = None) -> Resource:
    """The same rows with ids 1 .. n in order; only those that ``pick`` leaves, if it is given.

    Numbers come from sorted ids and are joined back, so columns and rows that nobody
    needs stay where they are. Rows whose ids aren't fit for that are range-partitioned,
    sorted and written once, whole.
    """
    whole, pick = pick is None, pick or (lambda df: df)
    if res.dense:
        return replace(res, df=pick(res.df))
    found = numbers(res)
    if found is not None:
        df = pick(res.df).join(found, F.col(ROW_ID).eqNullSafe(F.col(_ID)))
        df = df.withColumn(ROW_ID, F.col(NUMBER)).drop(_ID, NUMBER)
    else:
        in_order = res.df.repartitionByRange(F.col(ROW_ID)).sortWithinPartitions(ROW_ID)
        held = scratch.write(in_order.drop(ROW_ID).withColumn(_AT, F.monotonically_increasing_id()), "numbered")
        df = pick(_placed(held).withColumnRenamed(NUMBER, ROW_ID))
    return replace(res, df=df, dense=whole, stable=True)


def at_numbers(res: Resource, wanted: list[int]) -> tuple[Resource, int]:
    """(the table with one more column, its row number where that is among ``wanted``; how many rows there are)."""
    found = None if res.dense else numbers(res)
    if found is None:
        res = numbered(res)
        return replace(res, df=res.df.withColumn(NUMBER, F.col(ROW_ID))), res.df.agg(F.max(ROW_ID)).first()[0] or 0
    keys = res.df.sparkSession.createDataFrame([(k,) for k in wanted], f"{NUMBER} long")
    few = found.join(F.broadcast(keys), NUMBER)  # as many rows as the parameter has
    return replace(res, df=res.df.join(F.broadcast(few), F.col(ROW_ID).eqNullSafe(F.col(_ID)), "left").drop(_ID)), found.count()


def sorted_by(res: Resource, keys: list[Column]) -> Resource:
    """Rows in the order of ``keys``; ids are issued anew after one range-partitioned sort."""
    df = res.df.orderBy(*keys).withColumn(ROW_ID, F.monotonically_increasing_id())
    return replace(res, df=df, dense=False, stable=False)


def stacked(parts: list[Resource]) -> list[Column]:
    """A row id for each part under which all rows of one come before those of the next."""
    kinds = []
    for r in parts:
        if r.dtype(ROW_ID) not in kinds:
            kinds.append(r.dtype(ROW_ID))
    slots = lambda kind: [(F.col(ROW_ID) if kind == k else F.lit(None)).cast(k).alias(f"k{i}") for i, k in enumerate(kinds)]
    return [F.struct(F.lit(n).alias("part"), *slots(r.dtype(ROW_ID))) for n, r in enumerate(parts)]


def id_type(res: Resource) -> T.DataType:
    return res.dtype(ROW_ID)
