"""Ordered windows and folds over runs that are too long for one task.

``Ordered`` lays rows out by ranges of (run, order), numbers the ranges, and works out each
window within a range; what lies beyond a range's borders comes from a table with one row
for each run and range (its first and last row, its sums), so a run of any length is spread
over as many tasks as it fills. Where no run has more than ``ROWS_IN_A_TASK`` rows (one
count tells), a run is one range and the same windows are plain ones.

``folded`` is for states that no window expresses. Ranges are folded in parallel from a
state that is assumed; where the range before ends in another one, the range is folded again
from that, until every range has begun as the one before it ended. States that forget their
past agree after a range or two; the result is that of one fold in any case, after at most
as many rounds as a run has ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groma.sources.scratch import ordered_parts, written

#: Rows of a run that one task sorts and holds without trouble.
ROWS_IN_A_TASK = 2_000_000
#: The column with a row's range.
PART = "__part"


def joined(rows: DataFrame, small: DataFrame, key: Sequence[str], how: str = "left") -> DataFrame:
    """rows with small's columns; equal keys, and null equals null."""
    there = small.select(*[F.col(k).alias(f"__own_{k}") if k in key else F.col(k) for k in small.columns])
    same = None
    for k in key:
        one = rows[k].eqNullSafe(there[f"__own_{k}"])
        same = one if same is None else same & one
    return rows.join(there, same, how).drop(*[f"__own_{k}" for k in key])


class Ordered:
    """Rows of runs in an order without ties; each method gives rows with further columns."""

    def __init__(self, rows: DataFrame, run: Sequence[str], order: Sequence[str], spread: bool):
        self.rows, self.run, self.order, self.spread = rows, list(run), list(order), spread
        self.key = [*self.run, PART] if spread else self.run

    @classmethod
    def of(cls, df: DataFrame, run: Sequence[str], order: Sequence[str]) -> Ordered:
        longest = df.groupBy(*run).count().agg(F.max("count")).first()[0] or 0
        if longest <= ROWS_IN_A_TASK:
            return cls(df, run, order, False)
        return cls(ordered_parts(df, [*run, *order], "ordered", PART), run, order, True)

    def having(self, rows: DataFrame) -> Ordered:
        """The same layout with other columns, or fewer rows."""
        return Ordered(rows, self.run, self.order, self.spread)

    def done(self) -> DataFrame:
        return self.rows.drop(PART) if self.spread else self.rows

    def window(self) -> Window:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def beyond(self, edge: Column, across: Callable[[Column, Window], Column], name: str) -> DataFrame:
        """rows with what the other ranges of the run tell: an aggregate of each range, and a window over these."""
        found = self.rows.groupBy(*self.key).agg(edge.alias("__edge"))
        over = Window.partitionBy(*self.run).orderBy(PART)
        return joined(self.rows, found.select(*self.key, across(F.col("__edge"), over).alias(name)), self.key)

    def neighbours(self, *, before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None) -> Ordered:
        """Columns of the row before and of the row after, null where there is none."""
        out = self
        for named, step, edge in ((before, F.lag, F.max_by), (after, F.lead, F.min_by)):
            if named:
                packed = F.struct(*[c.alias(n) for n, c in named.items()])
                value, rows = step(packed).over(out.window()), out.rows
                if out.spread:
                    rows = out.beyond(edge(packed, F.struct(*out.order)), lambda e, w, step=step: step(e).over(w), "__beyond")
                    value = F.coalesce(value, F.col("__beyond"))
                # worked out once: names of columns may stand in what is packed
                rows = rows.withColumn("__beside", value).drop("__beyond")
                out = out.having(rows.select("*", *[F.col(f"__beside.{n}").alias(n) for n in named]).drop("__beside"))
        return out

    def running(self, amount: Column, name: str) -> Ordered:
        """The sum of the amount up to each row, its own included; 0 where all amounts so far are null."""
        whole = F.coalesce(F.sum(amount).over(self.window().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        if not self.spread:
            return self.having(self.rows.withColumn(name, whole))
        before = lambda e, w: F.coalesce(F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return self.having(self.beyond(F.sum(amount), before, "__before").withColumn(name, whole + F.col("__before")).drop("__before"))

    def numbered(self, place: str, total: str) -> Ordered:
        """The row's place in its run, from 1, and the run's number of rows."""
        if not self.spread:
            own = Window.partitionBy(*self.run)
            return self.having(self.rows.withColumn(place, F.row_number().over(self.window())).withColumn(total, F.count(F.lit(1)).over(own)))
        counts = self.rows.groupBy(*self.run).agg(F.count(F.lit(1)).alias(total))
        return self.having(joined(self.running(F.lit(1), place).rows, counts, self.run))

    def carried(self, value: Column, name: str, *, back: bool = False) -> Ordered:
        """The last value that is not null up to each row, its own included; back: the next one from it on."""
        take, best = (F.first, F.min_by) if back else (F.last, F.max_by)
        ends = (0, Window.unboundedFollowing) if back else (Window.unboundedPreceding, 0)
        own = take(value, ignorenulls=True).over(self.window().rowsBetween(*ends))
        if not self.spread:
            return self.having(self.rows.withColumn(name, own))
        edge = best(value, F.when(value.isNotNull(), F.struct(*self.order)))
        others = (1, Window.unboundedFollowing) if back else (Window.unboundedPreceding, -1)
        far = lambda e, w: take(e, ignorenulls=True).over(w.rowsBetween(*others))
        return self.having(self.beyond(edge, far, "__far").withColumn(name, F.coalesce(own, F.col("__far"))).drop("__far"))


class Machine(Protocol):
    """A fold's state: ``step`` takes a row's values and gives its results; ``state`` and ``restore`` turn it into text and back."""

    def step(self, *values) -> tuple: ...

    def state(self) -> str: ...

    def restore(self, state: str) -> None: ...


def folded(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], reads: Sequence[str], machine: Callable[[], Machine], gives: str, entries: Callable[[Ordered], DataFrame] | None = None) -> DataFrame:
    """df with the columns of ``gives`` (name and type, comma-separated): a machine for each key takes its rows in order.

    entries: where a range's effect on any state can be told beforehand, gives key, PART and
    ``_entry``, the state that each range begins with, and no range is folded twice.
    """
    placed = Ordered.of(df, keys, order)
    own = [c for c in placed.rows.columns if c != PART]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own)
    key = list(placed.key)
    names = [x.split()[0] for x in gives.split(", ")]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple], list[tuple]]]:
        """Each batch with its rows' results, and the (key, entry, machine) that ended in it or are still open."""
        now, last, entry = None, None, None
        for batch in batches:
            found, ended = [], []
            plain = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in (*key, *reads)]
            starts = batch["_entry"].tolist() if "_entry" in batch else [None] * len(batch)
            for start, *values in zip(starts, *plain, strict=True):
                own_key = tuple(values[: len(key)])
                if now is None or own_key != last:
                    if now is not None:
                        ended.append((last, entry, now))
                    now, last, entry = machine(), own_key, start
                    if start is not None:
                        now.restore(start)
                found.append(now.step(*values[len(key) :]))
            yield batch, found, ended
        if now is not None:
            yield pd.DataFrame(), [], [(last, entry, now)]

    def results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, found, _ in runs(batches):
            if len(batch):
                more = dict(zip(names, ([r[i] for r in found] for i in range(len(names))), strict=True))
                yield batch[own].assign(**{n: pd.array(v, dtype="Int64") if f"{n} long" in gives else v for n, v in more.items()})

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, ended in runs(batches):
            if ended:
                yield pd.DataFrame([(*k, entry, end.state()) for k, entry, end in ended], columns=[*key, "_entry", "_exit"])

    def laid_out(rows: DataFrame) -> DataFrame:
        return rows.repartition(*key).sortWithinPartitions(*key, *order)

    if not placed.spread:
        return laid_out(placed.rows).mapInPandas(results, f"{kinds}, {gives}")
    of_key = ", ".join(f"`{k}` {placed.rows.schema[k].dataType.simpleString()}" for k in key)
    ends = f"{of_key}, _entry string, _exit string"
    states = entries(placed) if entries else written(laid_out(placed.rows).mapInPandas(exits, ends), "states")
    while not entries:
        due = F.lag("_exit").over(Window.partitionBy(*keys).orderBy(PART))
        chained = states.withColumn("_due", due)
        wrong = written(chained.filter(~F.col("_due").eqNullSafe(F.col("_entry"))).select(*key, F.col("_due").alias("_entry")), "again")
        if wrong.isEmpty():
            break
        again = laid_out(joined(placed.rows, wrong, key, "inner")).mapInPandas(exits, ends)
        right = joined(states, wrong.select(*key, F.lit(True).alias("_wrong")), key).filter("_wrong is null").drop("_wrong")
        states = written(right.unionByName(again), "states")
    return laid_out(joined(placed.rows, states.select(*key, "_entry"), key)).mapInPandas(results, f"{kinds}, {gives}")
