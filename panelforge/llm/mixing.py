"""Mixing sources to target weights by capped water-filling.

A source's share of the budget is proportional to its weight, but no source
is read more than ``max_epochs`` times; what a capped source cannot take is
reshared by weight among the rest. With caps c_i, weights w_i and budget T the
targets are min(c_i, L * w_i) for the one level L with sum T. Sorting sources
by c_i / w_i, L is (T - caps before) / (weights from here on) at the first
source that this level does not fill.

Documents then give whole repetitions, floor(target / size of the source),
and one fractional repetition: in the seeded order of an MD5 of seed and id,
documents are taken whole until the rest of the target is used up; the last
one is taken in part. The order is cut into buckets of about BUCKET_ROWS
documents: bucket totals give the running sums, in two levels, so no source,
however large, is sorted or summed in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import WORD
from panelforge.sources.io import stage

BUCKET_ROWS = 500
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, key: str, text: str, source: str, seed: int, carry: str | None = None) -> DataFrame:
    """Stored narrow table: id, src, size (words), h (seeded order), x (carried column)."""
    t = F.coalesce(F.col(text), F.lit(""))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), t)))
              .cast("binary"))
    return stage(docs.select(F.col(key).alias("id"), F.col(source).alias("src"),
                             F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), h.alias("h"),
                             (F.col(carry) if carry else F.lit(0)).alias("x")), "mix_sizes")


def water_fill(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(src, source_size) -> the same with ``target`` double.

    One row per source: a metadata-sized table, the only one sorted as a whole.
    Weights repeat over the sources in code-point order, null last.
    """
    n = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (n % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("src").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("ws", F.sum("w").over(after)))
    # the first source (in cap / weight order) that the level does not fill
    wide = "decimal(19,0)"
    opens = (F.col("left").cast(wide) * F.col("w").cast(wide)) <= (F.col("cap").cast(wide) * F.col("ws").cast(wide))
    pick = F.when(opens, F.struct((F.col("cap") / F.col("w")).alias("r"),
                                  F.col("src").isNull().alias("z"), F.col("src").alias("s"), "left", "ws"))
    s = s.withColumn("lv", F.min(pick).over(everything))
    level = F.col("lv.left") * F.col("w") / F.col("lv.ws")
    return s.select("src", "source_size", F.least(F.col("cap").cast("double"), level).alias("target"))


def offsets(buckets: DataFrame, digits: int) -> DataFrame:
    """(src, b, bs) -> the same with ``offset``, the words of the source's buckets
    before b. Two levels, by the first half of b's digits and within it, so
    no window holds more than about the square root of a source's buckets."""
    before = Window.unboundedPreceding, -1
    runs = F.substring("b", 1, (digits + 1) // 2)
    first = buckets.groupBy(F.col("src").alias("rs"), runs.alias("run")).agg(F.sum("bs").alias("total"))
    first = first.select("rs", "run", F.coalesce(F.sum("total").over(
        Window.partitionBy("rs").orderBy("run").rowsBetween(*before)), F.lit(0)).alias("first"))
    inside = F.sum("bs").over(Window.partitionBy("src", runs).orderBy("b").rowsBetween(*before))
    return (buckets.withColumn("inside", F.coalesce(inside, F.lit(0)))
            .join(first, F.col("src").eqNullSafe(F.col("rs")) & (runs == F.col("run")))
            .select("src", "b", "bs", (F.col("first") + F.col("inside")).alias("offset")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, max_epochs: int = 3, seed: int = 0,
        carry: str | None = None) -> DataFrame:
    """One row per input row: ``key``, size, source_size, target, taken (words
    the mix takes, repeats counted) and ``repeats`` (whole repetitions).

    size counts words (null text: 0). A null source is a source of its own,
    ranked last. Empty texts take 0 words. Rows that repeat a key are ordered
    by size and share the source's rest one after the other; rows with a null
    key are ordered by their text. Reruns agree: the order depends on seed and
    key alone. An empty table gives an empty result; other columns are not read
    but ``carry``, which passes through.
    """
    d = sizes(docs, key, text, source, seed, carry)
    rows = d.count()
    digits = 1  # hex digits of the order that name a bucket: 16**digits buckets
    while rows > BUCKET_ROWS * 16 ** digits:
        digits += 1
    d = d.withColumn("b", F.substring("h", 1, digits))
    buckets = stage(d.groupBy("src", "b").agg(F.sum("size").alias("bs")), "mix_buckets")
    src = water_fill(buckets.groupBy("src").agg(F.sum("bs").alias("source_size")), weights, max_epochs)
    src = (src.withColumn("repeats", F.when(F.col("source_size") > 0,
                                            F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
           .withColumn("rest", F.round(F.col("target")).cast("long") - F.col("repeats") * F.col("source_size"))
           .withColumnRenamed("src", "s"))
    buckets = (offsets(buckets, digits)
               .join(src, F.col("src").eqNullSafe(F.col("s"))).drop("s")
               .withColumnRenamed("src", "s").withColumnRenamed("b", "c"))
    j = d.join(buckets, F.col("src").eqNullSafe(F.col("s")) & (F.col("b") == F.col("c")))
    inside = Window.partitionBy("src", "b").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return j.select(F.col("id").alias(key), "size", "source_size", "target",
                    (F.col("repeats") * F.col("size") + part).alias("taken"), "repeats",
                    *([F.col("x").alias(carry)] if carry else []))
