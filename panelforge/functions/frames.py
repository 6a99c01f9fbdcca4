"""Window specifications for entity x time panels.

Row order carries meaning in a panel: lags and rolling frames count trading
rows, not calendar days. Spark has no row order, so every positional operator
is a window partitioned by the entity and ordered by time. ``PanelWindow``
holds those names once; the halo mode swaps in (entity, bucket) partitions
without touching the feature code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

_AGGS = {
    "avg": F.avg,
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "max": F.max,
    "min": F.min,
}
_SQL = {"mean": "avg", "std": "stddev_samp", "var": "var_samp"}


@dataclass(frozen=True)
class PanelWindow:
    key: str = "ticker"
    time: str = "date"
    extra: tuple[str, ...] = field(default_factory=tuple)
    lead_by: tuple[str, ...] = field(default_factory=tuple)   # sorts before time, rising with it

    @property
    def parts(self) -> list[str]:
        return [self.key, *self.extra]

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.lead_by, self.time)

    def rows(self, n: int) -> WindowSpec:
        """The last n rows up to and including the current one."""
        return self.ordered.rowsBetween(-(n - 1), 0)

    @property
    def running(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> WindowSpec:
        """All earlier rows, not the current one."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    def over(self, back: int | None = None) -> str:
        """The window as SQL text: its order, or the last ``back`` rows. One
        parsed expression costs one call to the JVM; a Column tree one a node."""
        rows = "" if back is None else f" ROWS BETWEEN {back - 1} PRECEDING AND CURRENT ROW"
        parts, order = ", ".join(f"`{c}`" for c in self.parts), ", ".join(f"`{c}`" for c in (*self.lead_by, self.time))
        return f"OVER (PARTITION BY {parts} ORDER BY {order}{rows})"

    def scan(self, backwards: bool = False, frame: bool = True) -> str:
        """``over`` of a running scan, from the first row on or from the last."""
        parts = ", ".join(f"`{c}`" for c in self.parts)
        order = ", ".join(f"`{c}`{' DESC' if backwards else ''}" for c in (*self.lead_by, self.time))
        rows = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if frame else ""
        return f"OVER (PARTITION BY {parts} ORDER BY {order}{rows})"

    def roll_sql(self, c: str, n: int, agg: str = "avg") -> str:
        """``roll`` of an SQL expression, as SQL."""
        w = self.over(n)
        return f"CASE WHEN count({c}) {w} = {n} THEN {_SQL.get(agg, agg)}({c}) {w} END"

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(c, n).over(self.ordered)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(c, n).over(self.ordered)

    def roll(self, c, n: int, agg: str = "avg") -> Column:
        return rolling(c, n, agg, self)


def rolling(c, n: int, agg: str, pw: PanelWindow) -> Column:
    """pandas ``rolling(n).<agg>()``: NULL unless all n rows are non-null.

    Spark's own window aggregates skip nulls and emit partial frames, so the
    full-frame rule is a count guard on the same frame.
    """
    c = F.col(c) if isinstance(c, str) else c
    w = pw.rows(n)
    return F.when(F.count(c).over(w) == n, _AGGS[agg](c).over(w))


def by_date(time: str = "date") -> WindowSpec:
    """The cross-section of one date."""
    return Window.partitionBy(time)
