"""Stages of ``corpus_pipeline``: (spark, docs, sf_dir) -> DataFrame.

Each works on all rows it gets and returns all columns of ``docs`` (the last
one the packed pieces). Columns that the stages add in between start with two
underscores and are dropped again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import exact_dedup as exact_op
from panelforge.llm import langid, minhash, mixing
from panelforge.llm.common import WORD, pick_rows, prepare, small_side, text_hash
from panelforge.llm.packing import pack
from panelforge.sources.io import stage

LEAST_COSINE = 0.05   # below this a text looks like none of the languages
NEAR_PERCENT = 80     # similarity of near copies in the pipeline (op9's own contract is 85)


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: ``und`` (null text or no letter),
    or a cosine under LEAST_COSINE with every language. All others stay."""
    prepare(spark)
    train = docs.where(F.col("doc_id").isNotNull() & ~langid.held_out("doc_id"))
    langs, protos = langid.learn(train)

    @F.pandas_udf("boolean")
    def has_language(text: pd.Series) -> pd.Series:
        pred, score = langid.classify(text.tolist(), langs, protos)
        return pd.Series([p != langid.UND and s >= LEAST_COSINE for p, s in zip(pred, score)], dtype=bool)

    return docs.where(has_language("text"))


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    fp = exact_op.fingerprints(docs)
    sus = exact_op.suspects(fp)
    cls = exact_op.verified_classes(docs, sus)
    dropped = sus.join(cls, sus["sha"] == cls["csha"]).where(F.col("uid") != F.col("keep_uid")).select(
        F.col("uid").alias("du"))
    left = fp.join(stage(dropped, "exact_dropped"), F.col("uid") == F.col("du"), "left_anti").select("uid", "id", "th")
    same = fp.groupBy("id", "th").agg(F.count(F.lit(1)).alias("copies"))
    return _picked(docs, left, same)


def near(spark, docs: DataFrame, sf_dir: str, percent: int = minhash.PERCENT) -> DataFrame:
    """One document of each component of near copies: the smallest id (null
    ids last), of rows that repeat it one."""
    prepare(spark)
    c = stage(minhash.near_components(docs, percent=percent), "near_rows")
    first = c.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "uid", "th")).alias("k"))
    left = first.select("k.uid", "k.id", "k.th")
    same = c.groupBy("id", "th").agg(F.count(F.lit(1)).alias("copies"))
    return _picked(docs, left, same)


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``near`` at the pipeline's own similarity."""
    return near(spark, docs, sf_dir, NEAR_PERCENT)


def _picked(docs: DataFrame, left: DataFrame, same: DataFrame) -> DataFrame:
    """Rows of docs that ``left`` (uid, id, th) names; ``same`` counts the rows
    of docs per (id, th)."""
    left = stage(left, "kept_rows")
    many = stage(same.where("copies > 1").select(F.col("id").alias("mi"), F.col("th").alias("mt"), "copies"), "kept_same")
    kept = left.join(small_side(many, 32), F.col("id").eqNullSafe(F.col("mi")) & (F.col("th") == F.col("mt")), "left")
    kept = stage(kept.select("id", "th", F.coalesce("copies", F.lit(1)).alias("copies")), "kept_names")
    return pick_rows(docs, kept)


def mixing_rows(docs: DataFrame) -> DataFrame:
    """Stored (id, th, size, taken) of the mix, one row per (id, th)."""
    m = mixing.mix(docs.withColumn("__th", text_hash("text")), carry="__th")
    return stage(m.groupBy(F.col("doc_id").alias("__id"), F.col("__th").alias("__mth"))
                 .agg(F.first("size").alias("__size"), F.first("taken").alias("__taken")), "mix_rows")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the last document of a
    source that is taken in part is cut to its first words (white space
    between them becomes one space). Texts without words have nothing to take
    and leave. Rows that repeat an id and a text share one decision."""
    prepare(spark)
    d = docs.withColumn("__th", text_hash("text"))
    m = small_side(mixing_rows(docs), 48)
    d = d.join(m, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__mth")))
    d = d.where("__taken > 0")
    whole = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    rest = (F.col("__taken") - whole * F.col("__size")).cast("int")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.slice(words, F.lit(1), rest), " ")
    full = d.where(whole > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), whole)))
    cut = d.where(rest > 0).withColumn("text", part)
    return full.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(
        cut.select(*[F.col(f"`{c}`") for c in docs.columns]))


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left."""
    prepare(spark)
    return pack(docs)
