"""State carried between periods: forward fill (P8), EMA (W12), MACD.

A forward fill or a recursion reaches back without bound, so a halo cannot
hold what it needs. Each period of a series (at most 366 rows, see ``halo``)
is folded into a summary: its last value, or the affine map

    value at its end = alpha * value received + beta

The summaries lie in the period table, one row per ticker and period, and are
scanned there: affine maps compose, so the values received by all periods
come from ceil(log2(periods)) levels, each of which composes a map with the
one 1, 2, 4, ... periods before it (a lag). No map is cut off, so any span
and any run of nulls is exact. The value that a period receives is joined to
its rows before their one exchange.

EMA is pandas ``ewm(span, adjust=False)``: y0 = x0, and after a gap of g rows
since the last observation

    y = (q**g * y_prev + a * x) / (q**g + a),   a = 2 / (span + 1), q = 1 - a

(g = 1 gives the usual q * y_prev + a * x); rows without an observation keep
the value. From the first observation of a period on, y = C * y_first + D; the
first one depends on the gap that reaches back into earlier periods, known
from the table. The rows of a period get C and D from running sums, since
D / C sums a * x / ((q**g + a) * C). C is q ** n for the n steps without a gap,
exact to the last digits, times exp of a sum of logarithms for the others; in
366 rows it stays far from underflow for spans from SHORTEST on.

MACD adds the signal line, an EMA of the line on every row. Its map follows
from the fold too: the signal at a period's end is linear in the signal, fast
and slow values received, so it needs no second pass over the panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.frames import PanelWindow
from panelforge.operators.halo import BUCKET, longest_series, with_halo

PW = PanelWindow()
SHORTEST = 1.7     # spans below it (but 1, a forward fill) are refused


# Windows over the periods of a series, as SQL text (one call to the JVM each).
SERIES = "OVER (PARTITION BY __k ORDER BY __per)"
BEFORE = "OVER (PARTITION BY __k ORDER BY __per ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _in_period(hw: PanelWindow, frame: str = "") -> str:
    """Window over the rows of one period of a bucket; it shares the frame's sort."""
    parts = ", ".join(f"`{c}`" for c in (*hw.parts, *hw.lead_by))
    rows = {"": "", "run": " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW",
            "before": " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"}[frame]
    return f"OVER (PARTITION BY {parts} ORDER BY `{hw.time}`{rows})"


def _keep(df: DataFrame, gone) -> list[str]:
    return [f"`{c}`" for c in df.columns if c not in gone]


class Fill:
    """Last non-null value of each source column so far, under a new name."""

    def __init__(self, names: dict[str, str]):
        self.names = names

    def aggs(self, time: str) -> list[Column]:
        return [F.expr(f"max_by(`{s}`, CASE WHEN `{s}` IS NOT NULL THEN `{time}` END) AS `__e_{t}`")
                for s, t in self.names.items()]

    def scan(self, t: DataFrame) -> DataFrame:
        return t.selectExpr("*", *[f"last(`__e_{o}`, true) {BEFORE} AS `__p_{o}`" for o in self.names.values()])

    def entry(self) -> list[str]:
        return [f"__p_{o}" for o in self.names.values()]

    def rows(self, d: DataFrame, hw: PanelWindow) -> DataFrame:
        run = _in_period(hw, "run")
        new = [f"coalesce(last(`{s}`, true) {run}, `__p_{o}`) AS `{o}`" for s, o in self.names.items()]
        return d.selectExpr(*_keep(d, {*self.entry(), *self.names.values()}), *new)


def affine_scan(t: DataFrame, maps: Sequence[tuple[str, str]], outs: Sequence[str], periods: int) -> DataFrame:
    """Adds, for each map (alpha, beta; SQL text) of a period, the value it
    receives: the maps of all periods before it, composed and applied to 0
    (NULL in the first period). ``periods`` bounds the rows of a series in
    ``t``."""
    names = [(f"__a{i}", f"__b{i}") for i in range(len(maps))]
    t = t.selectExpr("*", *[f"{v} AS {c}" for pair, cols in zip(maps, names) for v, c in zip(pair, cols)])
    base = _keep(t, {c for pair in names for c in pair})
    reach = 1
    while reach < periods:
        t = t.selectExpr(*base, *[x for a, b in names for x in (
            f"{a} * coalesce(lag({a}, {reach}) {SERIES}, 1.0D) AS {a}",
            f"{b} + {a} * coalesce(lag({b}, {reach}) {SERIES}, 0.0D) AS {b}")])
        reach *= 2
    return t.selectExpr(*base, *[f"lag({b}, 1) {SERIES} AS {o}" for (_, b), o in zip(names, outs)])


class Ema:
    """EMA of ``src`` for each span."""

    def __init__(self, src: str, spans: Sequence[float], outs: Sequence[str], tag: str = "e"):
        if any(s < SHORTEST for s in spans):
            raise ValueError(f"spans below {SHORTEST} are not supported (span 1 is a forward fill)")
        self.src, self.outs, self.tag = src, list(outs), tag
        self.rates = [2.0 / (s + 1) for s in spans]

    def _n(self, name: str, k: int | str = "") -> str:
        return f"__{self.tag}{name}{k}"

    # -- one period: SQL text of a fold's state, and of its next state ------
    def _start(self) -> dict[str, str]:
        acc = {"i": "0", "first": "-1", "last": "-1", "x1": "CAST(NULL AS DOUBLE)"}
        for k in range(len(self.rates)):
            acc |= {f"c{k}": "0.0D", f"d{k}": "0.0D"}
        return acc

    def _step(self) -> dict[str, str]:
        new = {"i": "s.i + 1", "first": "CASE WHEN r.x IS NULL OR s.first >= 0 THEN s.first ELSE s.i END",
               "last": "CASE WHEN r.x IS NULL THEN s.last ELSE s.i END",
               "x1": "CASE WHEN s.first >= 0 THEN s.x1 ELSE r.x END"}
        for k, a in enumerate(self.rates):
            p = f"pow({_num(1.0 - a)}, s.i - s.last)"
            new[f"c{k}"] = f"CASE WHEN r.x IS NULL THEN s.c{k} WHEN s.first >= 0 THEN s.c{k} * {p} / ({p} + {_num(a)}) ELSE 1.0D END"
            new[f"d{k}"] = (f"CASE WHEN r.x IS NULL THEN s.d{k} WHEN s.first >= 0 "
                            f"THEN (s.d{k} * {p} + {_num(a)} * r.x) / ({p} + {_num(a)}) ELSE 0.0D END")
        return new

    def aggs(self, time: str) -> list[Column]:
        """The fold of a period: its rows in order, at most 366 of them."""
        rows = f"array_sort(collect_list(named_struct('t', `{time}`, 'x', CAST(`{self.src}` AS DOUBLE))))"
        start = ", ".join(f"'{n}', {v}" for n, v in self._start().items())
        step = ", ".join(f"'{n}', {v}" for n, v in self._step().items())
        return [F.expr(f"aggregate({rows}, named_struct({start}), (s, r) -> named_struct({step})) AS {self._n('f')}")]

    # -- all periods of a series ------------------------------------------
    def scan(self, t: DataFrame) -> DataFrame:
        periods = longest_series(t)
        f = self._n("f")
        t = t.selectExpr("*", f"last(CASE WHEN {f}.first >= 0 THEN __c0 + {f}.last END, true) {BEFORE} AS __pl")
        maps, new = [], []
        for k, a in enumerate(self.rates):
            p, a, v = f"pow({_num(1.0 - a)}, __c0 + {f}.first - __pl)", _num(a), self._n("v", k)
            c, d, x1 = f"{f}.c{k}", f"{f}.d{k}", f"{f}.x1"
            maps.append((f"CASE WHEN {f}.first < 0 THEN 1.0D WHEN __pl IS NULL THEN 0.0D ELSE {c} * {p} / ({p} + {a}) END",
                         f"CASE WHEN {f}.first < 0 THEN 0.0D WHEN __pl IS NULL THEN {c} * {x1} + {d} "
                         f"ELSE {c} * {a} * {x1} / ({p} + {a}) + {d} END"))
            new += [f"CASE WHEN __pl IS NOT NULL THEN {v} END AS {self._n('in', k)}",
                    f"CASE WHEN __pl IS NULL THEN {x1} ELSE ({p} * {v} + {a} * {x1}) / ({p} + {a}) END AS {self._n('y', k)}"]
        values = [self._n("v", k) for k in range(len(maps))]
        t = affine_scan(t, maps, values, periods)
        return self._more(t.selectExpr(*_keep(t, values), *new), periods).drop("__pl")

    def _more(self, t: DataFrame, periods: int) -> DataFrame:
        return t

    def entry(self) -> list[str]:
        return [self._n(n, k) for k in range(len(self.rates)) for n in ("in", "y")]

    # -- rows --------------------------------------------------------------
    def rows(self, d: DataFrame, hw: PanelWindow) -> DataFrame:
        run, x, ks = _in_period(hw, "run"), f"CAST(`{self.src}` AS DOUBLE)", range(len(self.rates))
        d = d.selectExpr(*_keep(d, self.outs), f"row_number() {_in_period(hw)} - 1 AS __i")
        d = d.selectExpr("*", f"last(CASE WHEN {x} IS NOT NULL THEN __i END, true) {_in_period(hw, 'before')} AS __lo")
        step, gap = f"{x} IS NOT NULL AND __lo IS NOT NULL", "(__i - __lo)"
        rate = [_num(a) for a in self.rates]
        p = [f"pow({_num(1.0 - a)}, {gap})" for a in self.rates]
        decay = [f"pow({_num(1.0 - a)}, __dense) * exp(-__s{k})" for k, a in enumerate(self.rates)]
        d = d.selectExpr("*", f"count(CASE WHEN {step} AND {gap} = 1 THEN 1 END) {run} AS __dense", *[
            f"sum(CASE WHEN {step} AND {gap} > 1 THEN -ln({p[k]} / ({p[k]} + {rate[k]})) ELSE 0.0D END) {run} AS __s{k}"
            for k in ks])
        d = d.selectExpr("*", *[
            f"sum(CASE WHEN {step} THEN {rate[k]} * {x} / ({p[k]} + {rate[k]}) / ({decay[k]}) ELSE 0.0D END) {run} AS __c{k}"
            for k in ks])
        gone = {*self.entry(), "__lo", "__dense", *[f"__{n}{k}" for k in ks for n in "sc"]}
        if type(self) is Ema:
            gone.add("__i")
        return d.selectExpr(*_keep(d, gone), *[
            f"CASE WHEN {x} IS NOT NULL OR __lo IS NOT NULL THEN {decay[k]} * ({self._n('y', k)} + __c{k}) "
            f"ELSE {self._n('in', k)} END AS `{o}`" for k, o in zip(ks, self.outs)])


class Macd(Ema):
    """MACD line, signal line (EMA of the line) and histogram."""

    def __init__(self, price: str = "adj_close", fast: float = 12, slow: float = 26, signal: float = 9):
        super().__init__(price, [fast, slow], ["__fast", "__slow"], tag="m")
        self.rate = 2.0 / (signal + 1)
        if signal < SHORTEST:
            raise ValueError(f"spans below {SHORTEST} are not supported")

    def _start(self) -> dict[str, str]:
        # signal at the end = g * signal received + gm * line received
        #                     + gf * first fast value + gs * first slow value + g0
        return super()._start() | {"g": "1.0D", "gm": "0.0D", "gf": "0.0D", "gs": "0.0D", "g0": "0.0D"}

    def _step(self) -> dict[str, str]:
        new = super()._step()
        a, q, seen = _num(self.rate), _num(1.0 - self.rate), "(r.x IS NOT NULL OR s.first >= 0)"
        new["g"] = f"{q} * s.g"
        new["gm"] = f"{q} * s.gm + CASE WHEN {seen} THEN 0.0D ELSE {a} END"
        new["gf"] = f"{q} * s.gf + CASE WHEN {seen} THEN {a} * ({new['c0']}) ELSE 0.0D END"
        new["gs"] = f"{q} * s.gs - CASE WHEN {seen} THEN {a} * ({new['c1']}) ELSE 0.0D END"
        new["g0"] = f"{q} * s.g0 + CASE WHEN {seen} THEN {a} * (({new['d0']}) - ({new['d1']})) ELSE 0.0D END"
        return new

    def _more(self, t: DataFrame, periods: int) -> DataFrame:
        f, n = self._n("f"), self._n
        beta = (f"{f}.gm * coalesce({n('in', 0)} - {n('in', 1)}, 0.0D) + {f}.g0 "
                f"+ coalesce({f}.gf * {n('y', 0)}, 0.0D) + coalesce({f}.gs * {n('y', 1)}, 0.0D)")
        return affine_scan(t, [(f"{f}.g", beta)], [n("sig")], periods)

    def entry(self) -> list[str]:
        return [*super().entry(), self._n("sig")]

    def rows(self, d: DataFrame, hw: PanelWindow) -> DataFrame:
        had = _keep(d, {*self.entry(), "macd", "macd_signal", "macd_hist"})
        # Ema.rows drops what entered; the signal's own state stays beside it
        d = super().rows(d.selectExpr("*", f"coalesce({self._n('sig')}, 0.0D) AS __sig"), hw)
        a, q = _num(self.rate), _num(1.0 - self.rate)
        d = d.selectExpr("*", "__fast - __slow AS macd",
                         f"sum(coalesce(__fast - __slow, 0.0D) / pow({q}, __i)) {_in_period(hw, 'run')} AS __m")
        d = d.selectExpr(*had, "macd", f"CASE WHEN macd IS NOT NULL THEN pow({q}, __i) * ({q} * __sig + {a} * __m) END AS macd_signal")
        return d.selectExpr("*", "macd - macd_signal AS macd_hist")


def _num(x: float) -> str:
    """A double in SQL, to the last digit."""
    return f"{x!r}D"


def forward_fill(df: DataFrame, cols: Sequence[str] | dict[str, str], pw: PanelWindow = PW,
                 bucket: int = BUCKET) -> DataFrame:
    """Carry the last non-null value forward within each ticker, over any
    number of rows. A dict fills source columns into new ones."""
    names = cols if isinstance(cols, dict) else {c: c for c in cols}
    return with_halo(df, None, pw, 0, 0, bucket, [Fill(names)])


def ema(df: DataFrame, src: str, spans: Sequence[float], outs: Sequence[str],
        pw: PanelWindow = PW, bucket: int = BUCKET) -> DataFrame:
    """EMA(span) of ``src`` for each span, as pandas computes it."""
    ones = {src: o for s, o in zip(spans, outs) if s == 1}
    rest = [(s, o) for s, o in zip(spans, outs) if s != 1]
    states = ([Fill(ones)] if ones else []) + ([Ema(src, *zip(*rest))] if rest else [])
    out = with_halo(df, None, pw, 0, 0, bucket, states)
    return out.select(*[c for c in df.columns if c not in outs], *outs)


def macd(df: DataFrame, pw: PanelWindow = PW, price: str = "adj_close",
         fast: int = 12, slow: int = 26, signal: int = 9, bucket: int = BUCKET) -> DataFrame:
    """MACD line, signal line (EMA of the line) and histogram."""
    return with_halo(df, None, pw, 0, 0, bucket, [Macd(price, fast, slow, signal)])
