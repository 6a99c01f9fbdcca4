"""Documents to packed training sequences, in stored stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``. All stages but the last return the columns of
``documents`` (extra columns pass through).
"""

from __future__ import annotations

from panelforge.llm import stages as S
from panelforge.llm.common import prepare
from panelforge.sources.io import stage

STAGES = [
    ("language_id", S.language_id),
    ("exact_dedup", S.exact),
    ("minhash_near_dedup", S.near_stage),
    ("source_mixing", S.mixing_stage),
    ("packing", S.packing),
]

# Language profiles and MinHash cannot be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; the pieces of the packed sequences."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, fn) in enumerate(STAGES):
        df = fn(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            df = stage(df, name)
    return df
