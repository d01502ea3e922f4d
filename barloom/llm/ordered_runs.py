"""Rows in order within their key, for keys of any size: no task ever holds a whole key.

Rows are dealt out by ranges of (key, order) and sorted, so a key is a run of neighbouring rows that may go on over several
partitions.  Each partition folds its own runs while it writes them.  What earlier partitions add to a partition's first run
is one small value a partition: those values, as many as there are partitions, are summed up by the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.steps import written
from barloom.plans.staging import ship_package

_ADDED = "_part int, _row long, _first boolean, _at long, _mark binary"


class Product(NamedTuple):
    """A monoid with values as bytes.  ``of`` makes the value of one row from its ``column``."""

    column: str
    of: Callable[[bytes], bytes]
    start: bytes
    join: Callable[[bytes, int, bytes], bytes]  # (value before, rows after, their value)


def ordered_runs(df: DataFrame, key: str, order: list[str], name: str, product: Product | None = None) -> DataFrame:
    """``df`` as a written table, with ``pos`` (from 1) within ``key`` by ``order``, nulls first, and with a product ``mark``,
    the product of the key's rows up to this one.  Rows that are equal in ``order`` are in no stated order among themselves."""
    spark, columns = df.sparkSession, df.columns
    ship_package(spark)
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(_ADDED).fields)

    def fold(batches):
        part, row, first, at, last, mark, begun = TaskContext.get().partitionId(), 0, True, 0, None, None, False
        for batch in batches:
            firsts, ats, marks = [], [], []
            values = batch.column(product.column).to_pylist() if product else None
            for i, k in enumerate(batch.column(key).to_pylist()):
                if not begun or k != last:
                    first, at, last, begun, mark = not begun, 0, k, True, product.start if product else None
                at += 1
                if product:
                    mark = product.join(mark, 1, product.of(values[i]))
                firsts.append(first)
                ats.append(at)
                marks.append(mark)
            n = len(ats)
            added = [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(firsts, pa.bool_())]
            row += n
            yield pa.record_batch([*batch.columns, *added, pa.array(ats, pa.int64()), pa.array(marks, pa.binary())], schema.names)

    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = written(dealt.mapInArrow(fold, schema), name)
    ends = rows.groupBy("_part").agg(
        F.min_by(F.struct(F.col(key).alias("key")), "_row").alias("begin"), F.max_by(F.struct(F.col(key).alias("key"), "_first", "_at", "_mark"), "_row").alias("end")
    )
    carry, held, before = [], None, (0, product.start if product else None)
    for part in ends.orderBy("_part").collect():  # one row a partition
        goes_on = held is not None and held[0] == part.begin.key
        if goes_on:
            carry.append((part["_part"], *before))
        end = part.end
        if goes_on and end["_first"]:
            before = (before[0] + end["_at"], product.join(before[1], end["_at"], bytes(end["_mark"])) if product else None)
        else:
            before = (end["_at"], bytes(end["_mark"]) if product else None)
        held = (end.key,)
    carried = spark.createDataFrame(carry, "_part int, _rows long, _before binary").withColumn("_first", F.lit(True))
    out = rows.join(F.broadcast(carried), ["_part", "_first"], "left")
    out = out.withColumn("pos", F.col("_at") + F.coalesce("_rows", F.lit(0)))
    if not product:
        return out.select(*columns, "pos")
    final = T.StructType(out.select(*columns, "pos").schema.fields + [T.StructField("mark", T.BinaryType())])

    def finish(batches):
        for batch in batches:
            marks = [
                product.join(b, at, m) if b is not None else m
                for b, at, m in zip(*(batch.column(c).to_pylist() for c in ("_before", "_at", "_mark")), strict=True)
            ]
            yield pa.record_batch([*[batch.column(c) for c in columns], batch.column("pos"), pa.array(marks, pa.binary())], final.names)

    return out.mapInArrow(finish, final)
