"""Mutual information of continuous features and a class label by nearest
neighbours (F6), exact and without a feature's axis in one task.

The estimator (Ross 2014) compares, for every row, how many rows lie as near
as its k-th neighbour of the same class:

    I = psi(N) + mean( psi(k_i) - psi(n_class) - psi(m_i) ), at least 0

r_i is the distance to the k-th nearest other row of the class (k at most the
class size - 1), k_i the rows of the class and m_i all rows nearer than r_i,
the row itself included. Classes of one row are left out, of N too. Among ties,
r_i = 0, both count the rows of that very value; the published estimator adds
random noise there, which gives another result each time it is seeded anew.

1. Rows collapse to (feature, class, value, count) and are range-partitioned by
   (feature, value).
2. A part gets, per class, copies of the k values before it and the k after it
   (from a table of its neighbours' first and last k values), so the nearest
   values of every row are within k rows of it: lags and leads.
3. m_i is a difference of ranks on the axis: the ends of (x - r, x + r) are put
   among the rows, all is range-partitioned again, and a running count inside
   a part plus the totals of the parts before it ranks them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.quantiles import below, ranged

NEIGHBOURS = 3      # of the usual estimator
EULER = 0.5772156649015329
FEW = 100_000       # classes whose counts are broadcast


def digamma(n: Column) -> Column:
    """psi of a positive whole number: harmonic sums up to 15, beyond that the
    asymptotic series (error below 1e-14)."""
    small, h = [], 0.0
    for i in range(1, 16):
        small.append(F.lit(h - EULER))
        h += 1.0 / i
    x = n.cast("double")
    i2 = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - i2 * (1.0 / 12 - i2 * (1.0 / 120 - i2 * (1.0 / 252 - i2 * (1.0 / 240 - i2 / 132))))
    return F.when(n <= 15, F.try_element_at(F.array(*small), n.cast("int"))).otherwise(series)


def _ends(d: DataFrame, part: str, k: int) -> DataFrame:
    """Per class and part, its first and last ``k`` rows (value, count) in order."""
    w = Window.partitionBy("feature", "y", part)
    d = d.select("feature", "y", part, F.struct("x", "c").alias("v"),
                 F.row_number().over(w.orderBy("x")).alias("__up"), F.row_number().over(w.orderBy(F.desc("x"))).alias("__down"))
    return d.where(f"__up <= {k} or __down <= {k}").groupBy("feature", "y", part).agg(
        F.array_sort(F.collect_list(F.when(F.col("__up") <= k, F.col("v")))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("__down") <= k, F.col("v")))).alias("tail"))


def with_neighbours(d: DataFrame, part: str, k: int) -> DataFrame:
    """Adds ``near``: (distance, count) of the k values before and after each
    row within its class, sorted, over the borders of parts."""
    w = Window.partitionBy("feature", "y").orderBy(part)
    ends = _ends(d, part, k).select(
        "feature", "y", part,
        F.flatten(F.collect_list("tail").over(w.rowsBetween(-k, -1))).alias("before"),
        F.flatten(F.collect_list("head").over(w.rowsBetween(1, k))).alias("after"))
    halo = ends.select("feature", "y", part, F.explode(F.concat(
        F.slice(F.reverse(F.array_sort("before")), 1, k), F.slice(F.array_sort("after"), 1, k))).alias("v"))
    rows = d.select("feature", "y", part, "x", "c", F.lit(False).alias("halo")).unionByName(
        halo.select("feature", "y", part, "v.x", "v.c", F.lit(True).alias("halo")))
    order = Window.partitionBy("feature", "y", part).orderBy("x")
    around = []
    for i in range(1, k + 1):
        for far in (F.lag, F.lead):
            v = far(F.struct("x", "c"), i).over(order)
            around.append(F.when(v.isNotNull(), F.struct(F.abs(v["x"] - F.col("x")).alias("d"), v["c"].alias("c"))))
    return rows.withColumn("near", F.array_sort(F.array_compact(F.array(*around)))).where(~F.col("halo")).drop("halo")


def mutual_info_neighbours(df: DataFrame, cols: Sequence[str], label: str, k: int = NEIGHBOURS,
                           parts: int | None = None) -> DataFrame:
    """(feature, mi) of each of ``cols`` with the class ``label``; rows without a
    label are left out, NULL values count as 0. ``parts`` fixes the parts of
    the axes (tests); otherwise their number follows from the rows."""
    df = df.where(F.col(label).isNotNull())
    classes = df.groupBy(F.col(label).alias("cy")).agg(F.count(F.lit(1)).alias("ny")).where("ny > 1")
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.sum("ny").alias("total")).first()
    classes = classes.withColumn("total", F.lit(total["total"]).cast("long"))
    if total["n"] <= FEW:      # then rows of a class are many: a join by class would be skewed
        classes = F.broadcast(classes)
    long = df.select(F.col(label).alias("y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + 0.0).alias("x")) for c in cols])))
    d = long.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("c"))
    d = d.join(classes.select("cy"), F.col("y") == F.col("cy"), "left_semi")
    d = ranged(d, ["feature", "x"], "mutual_values", "__r", parts)

    # distance of the k-th other row of the class, and the class's rows within it
    ky = F.least(F.lit(k), F.col("ny") - 1)
    near = with_neighbours(d, "__r", k).join(classes, F.col("y") == F.col("cy")).drop("cy")
    start = F.struct((F.col("c") - 1).alias("have"), F.when(F.col("c") - 1 >= ky, 0.0).alias("r"), F.col("c").alias("inside"))

    def nearer(acc, v):
        have = acc["have"] + v["c"]
        found = acc["r"].isNotNull()
        r = F.when(found, acc["r"]).when(have >= ky, v["d"])
        return F.struct(have.alias("have"), r.alias("r"), acc["inside"].alias("inside"))

    near = near.withColumn("r", F.aggregate("near", start, nearer)["r"])
    inside = F.aggregate("near", F.col("c"), lambda a, v: a + F.when(v["d"] < F.col("r"), v["c"]).otherwise(0))
    near = near.select("feature", "y", "x", "c", "ny", "total", "r", inside.alias("ki"))

    # all rows nearer than r: ranks of x - r and x + r among all values
    tie = F.col("r") == 0
    marks = F.array(
        F.struct(F.col("x").alias("v"), F.lit(1).alias("at"), F.col("c").alias("w"), F.lit(0).alias("sign")),
        F.struct((F.col("x") + F.col("r")).alias("v"), F.when(tie, 2).otherwise(0).alias("at"), F.lit(0).alias("w"), F.lit(1).alias("sign")),
        F.struct((F.col("x") - F.col("r")).alias("v"), F.when(tie, 0).otherwise(2).alias("at"), F.lit(0).alias("w"), F.lit(-1).alias("sign")))
    sweep = near.select("feature", "y", "x", "c", "ny", "total", "ki", F.inline(marks))
    sweep = ranged(sweep, ["feature", "v", "at"], "mutual_marks", "__r", parts)
    ranks = below(sweep, ["feature"], ["v", "at"], F.col("w").cast("long"), "__r", "rank").where("sign <> 0")
    rows = ranks.groupBy("feature", "y", "x", "c", "ny", "total", "ki").agg(F.sum(F.col("sign") * F.col("rank")).alias("m"))
    term = F.col("c") * (digamma(F.col("ki")) - digamma(F.col("ny")) - digamma(F.col("m")))
    mi = rows.groupBy("feature").agg((digamma(F.first("total")) + F.sum(term) / F.first("total")).alias("mi"))
    return mi.select("feature", F.greatest("mi", F.lit(0.0)).alias("mi"))
