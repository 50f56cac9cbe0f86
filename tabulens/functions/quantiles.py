"""Exact interpolated quantiles without holding a column in one task.

``percentile`` keeps every distinct value of a column in one buffer, which no
executor can do for a continuous column of a very large table.  Here a sketch
gives a narrow bracket around each wanted rank, a second scan counts the rows
below and inside the bracket, and only the rows inside are grouped and ordered.
A bracket that still holds too many rows is narrowed again, so the ordered
part has a fixed bound whatever the table size.  The ranks are checked against
the counts, so the answer is exact even where the sketch is off.

The sketches of all tasks are merged in two steps: first into ``LANES`` groups
of tasks, then those into one, so that no task receives one sketch per split.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import as_double, melted, quoted, small_frame
from .ordered import ordered_totals

QUARTILES = (0.25, 0.5, 0.75)
SKETCH_K = 8_192
WHOLE_ROWS = 20_000
RESIDUAL_ROWS = 1_000_000
LANES = 1_024
GRID = 1_000
BRACKETED_GROUPS = 500


@dataclass
class QuantileRow:
    """Quantiles of one group, with whatever else was aggregated on the way."""

    key: str | None
    values: dict[tuple[str, float], float | None]
    counts: dict[str, int]
    extra: dict[str, object] = field(default_factory=dict)


@dataclass
class _Item:
    """One wanted quantile: its bracket and the values already known by rank."""

    column: str
    prob: float
    n: int
    lo: float
    hi: float
    margin: float
    below: int = 0
    within: int = 0
    found: dict[int, float] = field(default_factory=dict)

    @property
    def position(self) -> float:
        return self.prob * (self.n - 1)

    @property
    def pending(self) -> list[int]:
        if self.n == 0:
            return []
        ranks = {math.floor(self.position), math.ceil(self.position)}
        return sorted(ranks - self.found.keys())

    @property
    def done(self) -> bool:
        return not self.pending

    def covered(self) -> bool:
        return self.pending[0] >= self.below and self.pending[-1] < self.below + self.within

    def trim(self, at_lo: int, at_hi: int) -> None:
        """Settle ranks that fall on a bracket end, then leave the ends out."""
        for rank in self.pending:
            if rank < self.below + at_lo:
                self.found[rank] = self.lo
            elif rank >= self.below + self.within - at_hi:
                self.found[rank] = self.hi
        self.below += at_lo
        self.within -= at_lo + at_hi
        self.lo = math.nextafter(self.lo, math.inf) if at_lo else self.lo
        self.hi = math.nextafter(self.hi, -math.inf) if at_hi else self.hi

    @property
    def answer(self) -> float | None:
        if self.n == 0:
            return None
        first, last = self.found[math.floor(self.position)], self.found[math.ceil(self.position)]
        part = self.position - math.floor(self.position)
        return first + (last - first) * part if part < 0.5 else last - (last - first) * (1 - part)


class _Search:
    def __init__(self, df, columns, probs, key, sketch_k, whole_rows, residual_rows):
        self.spark = df.sparkSession
        self.columns, self.probs, self.key = list(columns), list(probs), key
        self.sketch_k, self.whole_rows, self.residual_rows = sketch_k, whole_rows, residual_rows
        # Three times the rank error that a sketch of this size keeps in 99 of 100 cases.
        self.margin = 3 * 2.296 / sketch_k**0.9433
        self.slots = [(c, p) for c in self.columns for p in self.probs]
        self.df = df
        self.items: dict[str | None, list[_Item]] = {}

    def sketched(self, frame: DataFrame, wanted: list[tuple[Column, list[float]]]) -> dict:
        """Per group, the count ``n<i>`` and approximate quantiles ``q<i>`` of each wanted value."""
        key = [] if self.key is None else [self.key]
        lanes = frame.withColumn("__lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
        parts = lanes.groupBy(*key, "__lane").agg(
            *(F.kll_sketch_agg_double(v, self.sketch_k).alias(f"s{i}") for i, (v, _) in enumerate(wanted))
        )
        merged = parts.groupBy(*key).agg(*(F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in range(len(wanted))))
        read = []
        for i, (_, fractions) in enumerate(wanted):
            n = F.kll_sketch_get_n_double(f"s{i}")
            at = F.array(*map(F.lit, fractions))
            read += [n.alias(f"n{i}"), F.when(n > 0, F.kll_sketch_get_quantile_double(f"s{i}", at)).alias(f"q{i}")]
        rows = merged.select(*key, *read).collect()
        return {row[self.key] if key else None: row for row in rows}

    def begin(self) -> None:
        """First brackets, from a sketch of every column."""
        fractions = [f for p in self.probs for f in (max(0.0, p - self.margin), min(1.0, p + self.margin))]
        for key, row in self.sketched(self.df, [(as_double(c), fractions) for c in self.columns]).items():
            self.start(key, row)
        if self.key is None and not self.items:
            self.items[None] = [_Item(c, p, 0, 0.0, 0.0, self.margin) for c, p in self.slots]

    def start(self, key, row) -> None:
        items = []
        for i, c in enumerate(self.columns):
            n, values = row[f"n{i}"], row[f"q{i}"]
            for j, p in enumerate(self.probs):
                whole = n <= self.whole_rows
                lo, hi = (-math.inf, math.inf) if whole else (values[2 * j], values[2 * j + 1])
                items.append(_Item(c, p, n, lo, hi, self.margin))
        self.items[key] = items

    def frame(self) -> DataFrame:
        """The rows with the brackets of their group at hand."""
        if self.key is None:
            return self.df
        rows = [
            (k, *(b for it in items for b in (it.lo, it.hi))) for k, items in self.items.items()
        ]
        bounds = ", ".join(f"__lo{s} double, __hi{s} double" for s in range(len(self.slots)))
        table = small_frame(self.spark, rows, f"{self.key} string, {bounds}")
        return self.df.join(F.broadcast(table), self.key)

    def bounds(self, slot: int) -> tuple[Column, Column]:
        if self.key is None:
            item = self.items[None][slot]
            return F.lit(item.lo), F.lit(item.hi)
        return F.col(f"__lo{slot}"), F.col(f"__hi{slot}")

    def inside(self, slot: int) -> Column:
        lo, hi = self.bounds(slot)
        return as_double(self.slots[slot][0]).between(lo, hi)

    def aggregate(self, exprs: list[Column]) -> dict:
        frame = self.frame()
        if self.key is None:
            return {None: frame.agg(*exprs).first()}
        return {row[self.key]: row for row in frame.groupBy(self.key).agg(*exprs).collect()}

    def open_slots(self) -> list[int]:
        return [
            s for s in range(len(self.slots)) if any(not it[s].done for it in self.items.values())
        ]

    def narrow(self) -> None:
        """Count rows below and inside each bracket, and tighten the wide ones."""
        while slots := self.open_slots():
            exprs = []
            for s in slots:
                below = as_double(self.slots[s][0]) < self.bounds(s)[0]
                exprs += [F.count_if(below).alias(f"b{s}"), F.count_if(self.inside(s)).alias(f"w{s}")]
            counted = self.aggregate(exprs)
            wide: list[tuple[_Item, object, int]] = []
            for key, items in self.items.items():
                for s in slots:
                    item = items[s]
                    if item.done:
                        continue
                    item.below, item.within = counted[key][f"b{s}"], counted[key][f"w{s}"]
                    if not item.covered():
                        item.lo, item.hi = -math.inf, math.inf
                        item.margin *= 10
                        item.below, item.within = 0, item.n
                    if item.lo == item.hi:
                        item.found.update(dict.fromkeys(item.pending, item.lo))
                    elif item.within > self.residual_rows:
                        wide.append((item, key, s))
            if not wide:
                return
            self.tighten(wide)

    def tighten(self, wide) -> None:
        asked = sorted({s for _, _, s in wide})
        ends = []
        for s in asked:
            value, (lo, hi) = as_double(self.slots[s][0]), self.bounds(s)
            ends += [F.count_if(value == lo).alias(f"l{s}"), F.count_if(value == hi).alias(f"h{s}")]
        counted = self.aggregate(ends)
        for item, key, s in wide:
            item.trim(counted[key][f"l{s}"], counted[key][f"h{s}"])
        wide = [(item, key, s) for item, key, s in wide if not item.done]
        if not wide:
            return
        grid = [i / GRID for i in range(GRID + 1)]
        slots = sorted({s for _, _, s in wide})
        inside = [(F.when(self.inside(s), as_double(self.slots[s][0])), grid) for s in slots]
        sketched = self.sketched(self.frame(), inside)
        for item, key, s in wide:
            values = sketched[key][f"q{slots.index(s)}"]
            low, high = self.relative_fractions(item)
            item.lo, item.hi = values[math.floor(low * GRID)], values[math.ceil(high * GRID)]

    def relative_fractions(self, item: _Item) -> list[float]:
        return [
            max(0.0, (item.pending[0] - item.below) / item.within - item.margin),
            min(1.0, (item.pending[-1] - item.below + 1) / item.within + item.margin),
        ]

    def pick(self) -> None:
        """Order the few rows left inside the brackets and read off the wanted ranks."""
        slots = self.open_slots()
        if not slots:
            return
        frame, any_inside = self.frame(), F.lit(False)
        entries = []
        for s in slots:
            any_inside = any_inside | self.inside(s)
            entries.append(
                F.struct(
                    F.lit(s).alias("slot"),
                    F.when(self.inside(s), as_double(self.slots[s][0]) + 0.0).alias("value"),
                )
            )
        key = [] if self.key is None else [self.key]
        counts = (
            melted(frame.where(any_inside), entries, "value", *map(F.col, key))
            .groupBy(*key, "slot", "value")
            .agg(F.count("*").alias("n"))
        )
        order = Window.partitionBy(*key, "slot").orderBy("value")
        running = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        wanted = [
            (*([k] if key else []), s, rank - items[s].below)
            for k, items in self.items.items()
            for s in slots
            for rank in items[s].pending
        ]
        kind = f"{self.key} string, " if key else ""
        table = small_frame(self.spark, wanted, f"{kind}slot int, rank bigint")
        hits = (
            running.join(F.broadcast(table), [*key, "slot"])
            .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
            .collect()
        )
        found = {(r[self.key] if key else None, r.slot, r["rank"]): r.value for r in hits}
        for k, items in self.items.items():
            for s in slots:
                for rank in items[s].pending:
                    items[s].found[rank] = found[(k, s, rank - items[s].below)]

    def results(self, key, extra) -> QuantileRow:
        items = self.items[key]
        return QuantileRow(
            key,
            {(it.column, it.prob): it.answer for it in items},
            {it.column: it.n for it in items},
            extra,
        )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    extra: Sequence[Column] = (),
    sketch_k: int = SKETCH_K,
    whole_rows: int = WHOLE_ROWS,
    residual_rows: int = RESIDUAL_ROWS,
) -> QuantileRow:
    """Quantiles of whole columns, with the ``extra`` aggregates beside them.

    The extras run as a scan of their own: next to a sketch they would lose
    code generation, which costs more than reading the same columns again.
    """
    search = _Search(df, columns, probs, None, sketch_k, whole_rows, residual_rows)
    search.begin()
    search.narrow()
    search.pick()
    return search.results(None, df.agg(*extra).first().asDict() if extra else {})


def exact_group_quantiles(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    extra: Sequence[Column] = (),
    sketch_k: int = SKETCH_K,
    whole_rows: int = WHOLE_ROWS,
    residual_rows: int = RESIDUAL_ROWS,
    max_groups: int | None = BRACKETED_GROUPS,
) -> list[QuantileRow] | None:
    """The same per value of the text column ``key``; None beyond ``max_groups``.

    ``max_groups=None`` is for a caller that has checked the number of groups.
    """
    if max_groups is not None and df.select(key).distinct().limit(max_groups + 1).count() > max_groups:
        return None
    search = _Search(df, columns, probs, key, sketch_k, whole_rows, residual_rows)
    search.begin()
    if not search.items:
        return []
    search.narrow()
    search.pick()
    extras = {r[key]: r.asDict() for r in df.groupBy(key).agg(*extra).collect()} if extra else {}
    return [search.results(k, extras.get(k, {})) for k in search.items]


def many_group_quantiles(
    df: DataFrame, key: str, column: str, probs: Sequence[float] = QUARTILES
) -> DataFrame:
    """Quantiles for any number of groups, as ``(key, n, q0, q1, ...)``.

    Value counts are range-partitioned over (key, value), so even a group that
    holds most of the table is spread over many tasks.
    """
    counts = (
        df.where(quoted(column).isNotNull())
        .groupBy(key, (as_double(column) + 0.0).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    ranked = ordered_totals(counts, [key, "value"], ["n"], within=[key])
    picks = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("total_n") - 1)
        first, last = F.floor(position), F.ceil(position)
        picks.append((first, last, position - first))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("before_n")) & (rank < F.col("before_n") + F.col("n"))

    aggs = [F.max("total_n").alias("n")]
    wanted = F.lit(False)
    for i, (first, last, part) in enumerate(picks):
        wanted = wanted | holds(first) | holds(last)
        low, high = (F.max(F.when(holds(r), F.col("value"))) for r in (first, last))
        share = F.max(part)  # the same formula as for brackets, so both give the same last digits
        between = F.when(share < 0.5, low + (high - low) * share).otherwise(high - (high - low) * (1 - share))
        aggs.append(between.alias(f"q{i}"))
    return ranked.where(wanted).groupBy(key).agg(*aggs)


def group_quantile_frame(
    df: DataFrame, key: str, column: str, probs: Sequence[float] = QUARTILES
) -> DataFrame:
    """``(key, n, q0, q1, ...)`` by brackets for few groups, by ordered counts for many."""
    rows = exact_group_quantiles(df, key, [column], probs)
    if rows is None:
        return many_group_quantiles(df, key, column, probs)
    names = ", ".join(f"q{i} double" for i in range(len(probs)))
    return small_frame(
        df.sparkSession,
        [(r.key, r.counts[column], *(r.values[(column, p)] for p in probs)) for r in rows if r.counts[column]],
        f"{key} string, n bigint, {names}",
    )
