"""Forward returns and direction labels (W21, W22) with a label purge.

``mode="reference"`` reproduces ``(ret > 0).astype(int)``: an unknown future
is labelled 0. ``mode="strict"`` leaves it NULL so later ``dropna`` really
drops the unlabelled tail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.frames import PanelWindow
from panelforge.functions.nulls import div
from panelforge.operators.halo import FWD, with_halo

# Label horizons: name and trading rows ahead (fixed values).
HORIZONS = [("1d", 1), ("5d", 5), ("21d", 21), ("3m", 63), ("6m", 126), ("12m", 252)]

PW = PanelWindow()


def forward_returns(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close",
                    horizons: Sequence[tuple[str, int]] = HORIZONS) -> DataFrame:
    """x_{t+h} / x_t - 1."""
    return df.select("*", *[
        (div(pw.lead(price, h), F.col(price)) - 1).alias(f"target_return_{name}")
        for name, h in horizons])


def direction_col(ret: str, mode: str = "strict"):
    r = F.col(ret)
    if mode == "reference":
        return F.when(r > 0, 1).otherwise(0).cast("int")
    return F.when(r.isNotNull(), (r > 0).cast("int"))


def labels(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close",
           horizons: Sequence[tuple[str, int]] = HORIZONS, mode: str = "strict") -> DataFrame:
    """W21 + W22 laid out pairwise: target_return_h, target_direction_h."""
    base = list(df.columns)
    out = forward_returns(df, pw, price, horizons)
    out = out.select("*", *[direction_col(f"target_return_{n}", mode).alias(f"target_direction_{n}")
                            for n, _ in horizons])
    order = base + [c for n, _ in horizons for c in (f"target_return_{n}", f"target_direction_{n}")]
    return out.select(order)


def panel_labels(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close",
                 horizons: Sequence[tuple[str, int]] = HORIZONS, mode: str = "strict") -> DataFrame:
    """``labels`` on halo buckets: no series is one task."""
    return with_halo(df, lambda d, w: labels(d, w, price, horizons, mode), pw, 0, FWD)


def label_dates(df: DataFrame, pw: PanelWindow = PW,
                horizons: Sequence[tuple[str, int]] = HORIZONS) -> DataFrame:
    """The date each label looks at (NULL past the end of the series)."""
    return df.select("*", *[pw.lead(pw.time, h).alias(f"label_date_{n}") for n, h in horizons])


def purge_labels(df: DataFrame, cut: str, pw: PanelWindow = PW,
                 horizons: Sequence[tuple[str, int]] = HORIZONS) -> DataFrame:
    """Rows before ``cut`` with every label that looks at ``cut`` or later set
    to NULL (one pass for all horizons)."""
    c = F.lit(cut).cast("date")

    def frames(d: DataFrame, w: PanelWindow) -> DataFrame:
        return d.select("*", *[w.lead(w.time, h).alias(f"__ld_{n}") for n, h in horizons])

    d = with_halo(df, frames, pw, 0, max(h for _, h in horizons)).filter(F.col(pw.time) < c)
    of = {f"target_{k}_{n}": n for n, _ in horizons for k in ("return", "direction")}
    return d.select(*[F.when(F.col(f"__ld_{of[x]}") < c, F.col(x)).alias(x) if x in of else F.col(x)
                      for x in df.columns])


def purge(df: DataFrame, cut: str, horizon: str, pw: PanelWindow = PW) -> DataFrame:
    """Training rows whose label is fully known before ``cut``.

    A plain ``date < cut`` split lets a label read prices up to h rows past
    the cut; this keeps only rows whose label date is also before it.
    """
    h = dict(HORIZONS)[horizon]
    return (with_halo(df, lambda d, w: d.withColumn("__ld", w.lead(w.time, h)), pw, 0, h)
            .filter((F.col(pw.time) < F.lit(cut).cast("date")) & (F.col("__ld") < F.lit(cut).cast("date")))
            .drop("__ld"))
