"""Order-dependent histories: spacing, rate limits, lockouts, assignment.

Each row depends on all of its key before it. Where no key has more than SPLIT rows, a window by key does it in one pass. A
larger key's rows are cut into ranges of the order that lie in different tasks; each range is reduced to one value, the
values of a key are scanned, and what comes before a range is carried back to its rows. There are as many carries as ranges
at most, since a range's end cuts one key, so they are broadcast whatever the number of keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadwright.sources.shared import written

#: Rows of a key that one task takes; more are cut into ranges of about so many.
SPLIT = 1 << 20
#: How values of a range are reduced, and a value is joined with what comes before it.
SUM = F.sum, lambda own, before: own + F.coalesce(before, F.lit(0))
MAX = F.max, lambda own, before: F.greatest(own, before)


@dataclass(frozen=True)
class Ordered:
    """Rows with a key and a total order inside each key; of equal rows in both, which is first is open. cut: whether they lie in numbered ranges."""

    rows: DataFrame
    key: str
    order: list
    cut: bool

    def having(self, **columns: Column) -> Ordered:
        return Ordered(self.rows.withColumns(columns), self.key, self.order, self.cut)

    def running(self, name: str, value: Column, how: tuple) -> Ordered:
        """With the value's running sum or maximum inside the key, this row included."""
        reduce, join = how
        place = [self.key, "_range"] if self.cut else [self.key]
        own = self.rows.withColumn(name, reduce(value).over(Window.partitionBy(*place).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)))
        if not self.cut:
            return Ordered(own, self.key, self.order, False)
        ranges = self.rows.groupBy(F.col(self.key).alias("_of"), F.col("_range").alias("_at")).agg(reduce(value).alias("_whole"))
        before = reduce("_whole").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        carried = ranges.select("_of", "_at", before.alias("_before")).where("_before is not null")
        joined = own.join(F.broadcast(carried), F.col(self.key).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")), "left")
        return Ordered(joined.withColumn(name, join(F.col(name), F.col("_before"))).drop("_of", "_at", "_before"), self.key, self.order, True)

    def done(self, *helpers: str) -> DataFrame:
        return self.rows.drop("_range", *helpers)


def ordered(rows: DataFrame, key: str, order: list, split: int = SPLIT) -> Ordered:
    """The rows as they are, if no key has more than `split`; else written to the shared folder in ranges of key and order."""
    size = rows.groupBy(key).count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    if (size["most"] or 0) <= split:
        return Ordered(rows, key, order, False)
    ranged = rows.repartitionByRange(-(-size["all"] // split) + 1, F.col(key), *order).withColumn("_range", F.spark_partition_id())
    return Ordered(written(ranged, "key-ranges"), key, order, True)


def spaced(rows: DataFrame, key: str, arrival: Column, delay: Column | float, order: list, split: int = SPLIT) -> DataFrame:
    """rows with start: the first moment at least `delay` after the key's previous start and not before the arrival.

    start_i = max(arrival_i, start_(i-1) + delay), in closed form the running maximum of arrival_j - j * delay, plus i * delay.
    """
    delay = F.lit(delay).cast("long") if isinstance(delay, int) else F.lit(delay) if not isinstance(delay, Column) else delay
    at = ordered(rows, key, order, split).running("_i", F.lit(1), SUM)
    at = at.having(_a=arrival - F.col("_i") * delay).running("start", F.col("_a"), MAX)
    return at.having(start=F.col("start") + F.col("_i") * delay).done("_i", "_a")


def rate_limited(failures: DataFrame, key: str, seconds: Column, attempts: int = 20, window_s: int = 900) -> DataFrame:
    """rows with recent (failures of the key before this one and less than the window ago) and rejected.

    Failures of a key are counted by second before they are shuffled. Time is cut into stretches of the window's length; in
    each, a running sum starts from the whole stretch before, and takes a second's failures off again when the window
    leaves it. It takes each second three times, however many fall into a window.
    """
    at = failures.withColumn("_s", seconds.cast("long"))
    counts = at.groupBy(F.col(key).alias("_of"), F.col("_s").alias("_at")).agg(F.count("*").alias("_n")).where("_at is not null")
    own = F.floor(F.col("_at") / window_s)
    step = lambda stretch, second, n, real: F.struct(stretch.alias("stretch"), second.alias("second"), n.alias("n"), F.lit(real).alias("real"))
    before = step(own + 1, (own + 1) * window_s - 1, F.col("_n"), False)  # enters the next stretch in its first sum
    leaves = step(own + 1, F.col("_at") + window_s, -F.col("_n"), False)
    steps = counts.select("_of", "_at", F.explode(F.array(step(own, F.col("_at"), F.col("_n"), True), before, leaves)).alias("_step"))
    w = Window.partitionBy("_of", "_step.stretch").orderBy("_step.second").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = steps.withColumn("_sum", F.sum("_step.n").over(w)).where("_step.real").select("_of", "_at", "_sum")
    told = at.join(within, F.col(key).eqNullSafe(F.col("_of")) & F.col("_s").eqNullSafe(F.col("_at")), "left")
    return told.withColumn("recent", F.col("_sum") - 1).withColumn("rejected", F.col("recent") >= attempts).drop("_s", "_of", "_at", "_sum")


def failure_runs(logins: DataFrame, key: str, order: list, success: Column, threshold: int = 5, split: int = SPLIT) -> DataFrame:
    """rows with failures (in a row up to here) and locks: whether this one reaches the threshold. A success starts anew; an expired lock does not.

    The failures in a row are all so far less all at the last success.
    """
    at = ordered(logins, key, order, split).having(_ok=success).running("_all", (~F.col("_ok")).cast("int"), SUM)
    at = at.having(_then=F.when(F.col("_ok"), F.col("_all"))).running("_last", F.col("_then"), MAX)
    at = at.having(failures=F.col("_all") - F.coalesce("_last", F.lit(0)))
    return at.having(locks=(F.col("failures") >= threshold) & ~F.col("_ok")).done("_ok", "_all", "_then", "_last")


def round_robin(rows: DataFrame, key: str, order: list, pool: Column, split: int = SPLIT) -> DataFrame:
    """rows with slot: their place among the key's rows modulo the size of the pool."""
    at = ordered(rows, key, order, split).running("_i", F.lit(1), SUM)
    return at.having(slot=F.pmod(F.col("_i") - 1, pool)).done("_i")
