"""Exact quantiles per group without holding a group in one task.

``percentile`` keeps every value of a group in one aggregation buffer, so a
ticker with a third of all rows would sit in one task's memory. Here:

1. values collapse to (group, value, multiplicity) — map-side combined, so
   heavy ties (for example the zeros of a NULL fill) become one row;
2. the distinct rows are range-partitioned by (group, value) into parts of
   about RANGE_ROWS (``ranged``): Spark samples the cut points, so a group gets
   parts in proportion to its distinct values, however many there are;
3. the number of rows below each distinct value is a running sum inside its
   (group, part) plus the totals of the group's lower parts (a small table);
4. the rows at ranks floor(k) and floor(k) + 1, k = q * (n - 1), are picked
   and interpolated linearly (numpy's and Spark's ``percentile`` rule).

Every window holds at most one part of one group's distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.io import stage

RANGE_ROWS = 50_000   # rows of a part, about


def ranged(df: DataFrame, by: Sequence[str], name: str, out: str, parts: int | None = None,
           rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` stored in the order of ``by``, cut into parts of about ``rows`` rows
    whose number (rising with ``by``) is ``out``. Rows that agree in ``by`` lie in one
    part."""
    if parts is None:
        df = stage(df, name)
        parts = max(1, -(-df.count() // rows))
    return stage(df.repartitionByRange(parts, *by).withColumn(out, F.spark_partition_id()), name)


def below(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, part: str, out: str,
          inclusive: bool = False) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the group ``by`` that come
    before the row in ``order`` (and itself when ``inclusive``). ``df`` is the
    outcome of ``ranged`` with by + order, so a window holds one part."""
    by = list(by)
    d = df.withColumn("__w", weight)
    per = d.groupBy(*by, part).agg(F.sum("__w").alias("__pw"))
    off = F.sum("__pw").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(*by, part, F.coalesce(off, F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.join(per, [*by, part])
    return d.withColumn(out, F.col("__off") + F.coalesce(F.sum("__w").over(inner), F.lit(0))).drop("__w", "__off")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float],
                    ranges: int | None = None, out: str = "q") -> DataFrame:
    """(by..., n, q0, q1, ...) with q_i the exact ``qs[i]`` quantile of
    ``value`` (NULLs ignored) in each group."""
    by = list(by)
    d = (df.filter(F.col(value).isNotNull())
         .groupBy(*by, F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__c")))
    d = ranged(d, [*by, "__x"], "quantiles", "__r", ranges)
    total = d.groupBy(*by).agg(F.sum("__c").alias("__n"))
    d = below(d, by, ["__x"], F.col("__c"), "__r", "__lo").join(total, by)
    # this distinct value covers ranks [__lo, __lo + __c - 1]
    aggs = [F.first("__n").alias("n")]
    for i, q in enumerate(qs):
        k = F.lit(q) * (F.col("__n") - 1)
        r0 = F.floor(k)
        r1 = F.least(r0 + 1, F.col("__n") - 1)
        covers = lambda r: (F.col("__lo") <= r) & (r < F.col("__lo") + F.col("__c"))
        aggs += [F.max(F.when(covers(r0), F.col("__x"))).alias(f"__v0_{i}"),
                 F.max(F.when(covers(r1), F.col("__x"))).alias(f"__v1_{i}"),
                 F.max(k - r0).alias(f"__f_{i}")]
    res = d.groupBy(*by).agg(*aggs)
    return res.select(*by, "n", *[
        (F.col(f"__v0_{i}") + F.col(f"__f_{i}") * (F.col(f"__v1_{i}") - F.col(f"__v0_{i}"))).alias(f"{out}{i}")
        for i in range(len(qs))])
