"""Window functions over one global order, spread over tasks.

The rows are dealt into ranges of the order, called parts, and numbered within them.  A window function is first computed
within the parts; then the rows at a part's edge are copied to the other parts that need them, where they stand for all rows
of their own part, and the function is computed once more with them.  All rows come through one flow: nothing is read twice,
and no task holds more than its parts and one row of each other part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewright.plans.frame import HIDDEN, Frame, estimated_bytes, fresh, quoted

_PART = f"{HIDDEN}_part"
#: Longest distance of ``prev`` and ``next``: so many rows of each part are copied.
REACH = 100
#: Estimated bytes of the input for each part; there are no more parts than the session's shuffle partitions.
PART_BYTES = 2 << 20


def is_spread(frame: Frame | None) -> bool:
    return frame is not None and frame.parts > 0 and bool(frame.order) and frame.order[0][0].startswith(_PART)


def spread(frame: Frame) -> Frame:
    """The frame with its rows dealt into parts; ties keep the order in which they are read."""
    if is_spread(frame):
        return frame
    spark = frame.df.sparkSession
    n = min(max(estimated_bytes(frame.df) // PART_BYTES, spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")))
    read, part, row = fresh("read"), fresh("part"), fresh("row")
    order = [*frame.ordering(), F.col(read)]
    df = frame.df.withColumn(read, F.monotonically_increasing_id()).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    df = _dealt(df, n, part).withColumn(row, F.row_number().over(Window.partitionBy(part).orderBy(*order))).drop(read)
    return frame.with_df(df, order=((part, True, True), (row, True, True)), parts=n)


def _dealt(df: DataFrame, n: int, part: str) -> DataFrame:
    """Each part in one task; twice as many tasks, so that few get several parts.  Spark does not join such tasks."""
    return df.repartition(2 * n, part)


def _copied(frame: Frame, df: DataFrame, edge: Column, back: bool = False) -> tuple[DataFrame, str, str]:
    """The rows, and copies of the rows at the edge in all later (earlier) parts; the names of the columns of the part
    where a row is and of that which it comes from.  Copies stand before (after) a part's own rows when sorted by the
    latter and the row.  The part has a new name, as the rows are not in order any more."""
    part, source, last = fresh("part"), fresh("source"), frame.parts - 1
    others = F.sequence(F.lit(0), F.col(source) - 1) if back else F.sequence(F.col(source) + 1, F.lit(last))
    some = F.col(source) > 0 if back else F.col(source) < last
    to = F.when(edge & some, F.concat(F.array(source), others)).otherwise(F.array(source))
    df = df.withColumnRenamed(frame.order[0][0], source).withColumn(part, F.explode(to))
    return _dealt(df, frame.parts, part), part, source


def _with_part(frame: Frame, df: DataFrame, part: str) -> Frame:
    return frame.with_df(df, order=((part, True, True), frame.order[1]))


def shifted(frame: Frame, value: Column, n: int) -> tuple[Frame, str]:
    """A column with ``value`` as field ``v`` of the n-th row before (after, if negative); null where there is none."""
    part, row = (o[0] for o in frame.order)
    v, edge, out = fresh("v"), fresh("edge"), fresh("shifted")
    move, other = (F.lag, F.lead) if n >= 0 else (F.lead, F.lag)
    k = abs(n)
    df = frame.df.withColumn(v, F.struct(value.alias("v"))).withColumn(edge, other(F.lit(1), k).over(Window.partitionBy(part).orderBy(row)).isNull())
    df, part, source = _copied(frame, df, F.col(edge), n < 0)
    df = df.withColumn(out, move(F.col(v), k).over(Window.partitionBy(part).orderBy(source, row))).where(F.col(source) == F.col(part))
    return _with_part(frame, df.drop(v, edge, source), part), out


def running(frame: Frame, value: Column, restart: Column | None = None, last: bool = False) -> tuple[Frame, str]:
    """A column with the sum (or the last value that is there) of ``value`` up to each row, from the last row on where
    ``restart`` holds."""
    part, row = (o[0] for o in frame.order)
    v, again, group, local, edge, out = (fresh(x) for x in ("v", "again", "group", "local", "edge", "running"))
    fold = (lambda c: F.last(c, ignorenulls=True)) if last else F.sum
    upto = lambda order, *keys: Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = frame.df.withColumn(v, value).withColumn(again, F.lit(0) if restart is None else F.coalesce(restart, F.lit(False)).cast("int"))
    keys = [] if restart is None else [group]
    df = df.withColumn(group, F.lit(0) if restart is None else F.sum(again).over(upto([row])))
    df = df.withColumn(local, fold(F.col(v)).over(upto([row], *keys))).withColumn(edge, F.lead(F.lit(1)).over(Window.partitionBy(part).orderBy(row)).isNull())
    kind = df.schema[local].dataType
    df, part, source = _copied(frame, df, F.col(edge))
    own = F.col(source) == F.col(part)
    # A copy stands for its part: the rows since the part's last restart, or all of them.
    df = df.withColumn(v, F.when(own, F.col(v).cast(kind)).otherwise(F.col(local))).withColumn(again, F.when(own, F.col(again)).otherwise((F.col(group) > 0).cast("int")))
    if restart is not None:
        df = df.withColumn(group, F.sum(again).over(upto([source, row])))
    df = df.withColumn(out, fold(F.col(v)).over(upto([source, row], *keys)).cast(kind)).where(own)
    return _with_part(frame, df.drop(v, again, group, local, edge, source), part), out


def in_order(frame: Frame) -> Frame:
    """Spread rows, sorted again."""
    order = [quoted(n) for n, _, _ in frame.order]
    return frame.with_df(frame.df.repartitionByRange(frame.parts, *order).sortWithinPartitions(*order))
