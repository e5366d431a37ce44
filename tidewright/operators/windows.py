"""Positional windows over series, in blocks: lags, supervised rows, differences, runs, segments, correlograms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a block carries the neighbouring rows that its windows reach.
BLOCK = 65_536


def in_blocks(df: DataFrame, before: int, after: int, body: Callable[[DataFrame, object], DataFrame], size: int = BLOCK) -> DataFrame:
    """Applies window expressions to a series cut into blocks by idx, so that no task needs a whole series.

    Rows within ``before`` of a block's start and ``after`` of its end are replicated to it; body gets the rows and the
    window by (series, block) ordered by idx, and the replicas' results are left out.
    """
    size = max(size, before, after, 1)
    home = F.floor(F.col("idx") / size)
    reach = F.array_distinct(F.array(home, F.floor((F.col("idx") + before) / size), F.greatest(F.floor((F.col("idx") - after) / size), F.lit(0).cast("long"))))
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(reach))
    done = body(spread, Window.partitionBy("series", "_block").orderBy("idx"))
    return done.filter("_home = _block").drop("_home", "_block")


def supervised(df: DataFrame, k: int, value: str = "value") -> DataFrame:
    """Adds x, the k values before each row, oldest first, and y, its own; rows with fewer before them are left out."""

    def body(d: DataFrame, w) -> DataFrame:
        return d.withColumns({"x": F.collect_list(value).over(w.rowsBetween(-k, -1)), "y": F.col(value)})

    return in_blocks(df, k, 0, body).filter(F.size("x") == k)


def last_windows(df: DataFrame, k: int, n: int, value: str = "value") -> DataFrame:
    """supervised for the last n rows of each series, and one row more, without y, for what comes after them."""
    ends = df.groupBy("series").agg((F.max("idx") + 1).alias("_end"))
    rows = df.join(ends, "series").filter(F.col("idx") >= F.col("_end") - n - k)
    inside = supervised(rows.drop("_end"), k, value).join(ends, "series").filter(F.col("idx") >= F.col("_end") - n).select("series", "idx", "x", "y")
    tail = rows.filter(F.col("idx") >= F.col("_end") - k).groupBy("series", "_end").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("v")))), lambda r: r["v"]).alias("x"))
    return inside.unionByName(tail.filter(F.size("x") == k).select("series", F.col("_end").alias("idx"), "x", F.lit(None).cast("double").alias("y")))


def tail_windows(df: DataFrame, k: int, size: int, newest_first: bool = False, value: str = "value") -> DataFrame:
    """supervised within the last size rows of each series, so size - k rows; with newest_first x begins with the last value."""
    ends = df.groupBy("series").agg((F.max("idx") + 1).alias("_end"))
    rows = df.join(ends, "series").filter(F.col("idx") >= F.col("_end") - size).drop("_end")
    found = supervised(rows, k, value)
    return found.withColumn("x", F.reverse("x")) if newest_first else found


def padded(df: DataFrame, k: int, value: str = "value") -> DataFrame:
    """Like supervised for every row, with zeros to the left where the history is short."""

    def body(d: DataFrame, w) -> DataFrame:
        past = F.collect_list(value).over(w.rowsBetween(-k, -1))
        return d.withColumns({"_x": past, "y": F.col(value)}).withColumn("x", F.concat(F.array_repeat(F.lit(0.0), F.lit(k) - F.size("_x")), "_x")).drop("_x")

    return in_blocks(df, k, 0, body)


def shifted(df: DataFrame, n: int, fill: float, value: str = "value") -> DataFrame:
    """Adds shifted: the value n rows before (after, if n is negative), or fill."""

    def body(d: DataFrame, w) -> DataFrame:
        return d.withColumn("shifted", F.coalesce(F.lag(value, n).over(w) if n >= 0 else F.lead(value, -n).over(w), F.lit(fill)))

    return in_blocks(df, max(n, 0), max(-n, 0), body)


def differences(df: DataFrame, season: int, value: str = "value") -> DataFrame:
    """Adds backward, second, forward, seasonal and seasonal-forward differences; missing neighbours give null (0 backward)."""

    def body(d: DataFrame, w) -> DataFrame:
        x = F.col(value)
        lead = lambda n: F.lead(value, n).over(w)
        lag = lambda n: F.lag(value, n).over(w)
        return d.withColumns(
            {
                "d1": F.coalesce(F.bround(x - lag(1), 4), F.lit(0.0)),
                "d2": F.coalesce(F.bround(x - 2 * lag(1) + lag(2), 4), F.lit(0.0)),
                "f1": F.bround(lead(1) - x, 3),
                "s": x - lead(season),
                "f1s": (x - lead(1)) - (lead(season) - lead(season + 1)),
            }
        )

    return in_blocks(df, 2, season + 1, body)


def first_difference(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds diff, the step to the next value at 3 places; the last row has the mean of the two steps before it."""

    def body(d: DataFrame, w) -> DataFrame:
        step = F.lead(value).over(w) - F.col(value)
        last = (F.col(value) - F.lag(value, 2).over(w)) / 2
        return d.withColumn("diff", F.bround(F.coalesce(step, last), 3))

    return in_blocks(df, 2, 1, body)


def lag_pairs(df: DataFrame, lags: list[int], value: str = "value") -> DataFrame:
    """(series, lag, a, b): each value with the one lag rows before it."""

    def body(d: DataFrame, w) -> DataFrame:
        past = d.withColumns({f"_lag{n}": F.lag(value, n).over(w) for n in lags})
        pairs = F.array(*[F.struct(F.lit(n).alias("lag"), F.col(value).alias("a"), F.col(f"_lag{n}").alias("b")) for n in lags])
        return past.select("series", "_home", "_block", F.explode(pairs).alias("p")).select("series", "_home", "_block", "p.*")

    return in_blocks(df, max(lags), 0, body).filter("b is not null")


def autocorrelation(df: DataFrame, lags: list[int], value: str = "value") -> DataFrame:
    """(series, lag, r): biased autocorrelation, sum of products of deviations over n times the population variance.

    The mean goes before anything is multiplied, so a large one costs no digits. Null for series that don't vary.
    """
    stats = df.groupBy("series").agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    centred = df.join(stats, "series").select("series", "idx", "_n", (F.col(value) - F.col("_m")).alias("value"))
    whole = centred.groupBy("series").agg(F.sum(F.col("value") * F.col("value")).alias("_s"))
    sums = lag_pairs(centred, lags).groupBy("series", "lag").agg(F.sum(F.col("a") * F.col("b")).alias("_ab"))
    return sums.join(whole, "series").select("series", "lag", F.try_divide("_ab", "_s").alias("r"))


def pearson_all_lags(df: DataFrame, lags: int, value: str = "value", size: int = BLOCK) -> DataFrame:
    """(series, lag, r): correlation at every lag from 0 to lags - 1 that the series has pairs for.

    A block of deviations from the mean, with the lags before it, gives the sums of all lags at once: products by a transform, the others by
    running sums. Only these sums meet by series and lag.
    """
    stats = df.groupBy("series").agg(F.avg(value).alias("_m"), (F.max("idx") + 1).alias("_n"))
    rows = df.join(stats, "series").select("series", "idx", "_n", (F.col(value) - F.col("_m")).alias("v"))
    reach = F.sequence(F.floor(F.col("idx") / size), F.least(F.floor((F.col("idx") + lags - 1) / size), F.floor((F.col("_n") - 1) / size)))
    blocks = rows.withColumn("b", F.explode(reach)).groupBy("series", "b").agg(F.min("idx").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda r: r["v"]).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.x, float)
                skip = max(0, r.b * size - (lags - 1) - r.first)
                x, first = x[skip:], r.first + skip
                own = int(r.b * size - first)
                top = min(lags, len(x))
                n = 1 << int(2 * len(x)).bit_length()
                late = np.concatenate([np.zeros(own), x[own:]])
                ab = np.fft.irfft(np.fft.rfft(late, n) * np.conj(np.fft.rfft(x, n)), n)[:top]
                s1, s2 = (np.concatenate([[0.0], np.cumsum(y)]) for y in (x, x * x))
                k = np.arange(top)
                start = np.maximum(own, k)  # the first of the block's samples that has one so far before it
                pairs = len(x) - start
                sums = [pairs.astype(float), s1[-1] - s1[start], s1[len(x) - k] - s1[start - k], s2[-1] - s2[start], s2[len(x) - k] - s2[start - k], ab]
                out += [(r.series, int(i), *(float(c[i]) for c in sums)) for i in k if pairs[i] > 0]
            yield pd.DataFrame(out, columns=["series", "lag", "n", "a", "b", "aa", "bb", "ab"])

    parts = blocks.mapInPandas(run, "series string, lag int, n double, a double, b double, aa double, bb double, ab double")
    whole = parts.groupBy("series", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    left = lambda xy, x, y: F.col(xy) - F.col(x) * F.col(y) / F.col("n")
    return whole.select("series", "lag", F.try_divide(left("ab", "a", "b"), F.sqrt(F.greatest(left("aa", "a", "a"), F.lit(0.0)) * F.greatest(left("bb", "b", "b"), F.lit(0.0)))).alias("r"))


def lag_polynomial(*periods: int) -> dict[int, int]:
    """{offset: factor} of differences x[i] - x[i + d] taken one after the other for each given d: their product as polynomials."""
    out = {0: 1}
    for d in periods:
        more: dict[int, int] = {}
        for at, factor in out.items():
            for offset, sign in ((0, 1), (d, -1)):
                more[at + offset] = more.get(at + offset, 0) + sign * factor
        out = {at: factor for at, factor in sorted(more.items()) if factor}
    return out


#: The surveyed sum over 4, 8 and 12 hours and a day of ten-minute samples, by offset (fixed values).
COMPOSITE = {0: 1, 24: -1, 48: -1, 96: 1, 120: 1, 168: 1, 192: 1, 240: -1, 264: -1, 288: 1}
#: The surveyed filters by name: (factors by offset, samples at the end that have none) (fixed values).
FILTERS: dict[str, tuple[dict[int, int], int]] = {
    "diff0": (lag_polynomial(), 0),
    "diff1": (lag_polynomial(1), 1),
    "ddiff1": (lag_polynomial(1, 1), 2),
    "seas24": (lag_polynomial(24), 24),
    "seas48": (lag_polynomial(48), 48),
    "seas72": (lag_polynomial(72), 72),
    "seas144": (lag_polynomial(144), 144),
    "seas288": (COMPOSITE, 288),
    "diff1seas": (lag_polynomial(1, 72), 74),
    "ddiff1seas": (lag_polynomial(1, 1, 72), 75),
}


def filtered(df: DataFrame, filters: dict[str, tuple[dict[int, int], int]], value: str = "value") -> DataFrame:
    """Adds a column for each filter: the sum of factors times later values, in one window pass; null for so many samples at the end."""
    reach = max(max(kernel) for kernel, _ in filters.values())
    ends = df.groupBy("series").agg((F.max("idx") + 1).alias("_n"))

    def body(d: DataFrame, w) -> DataFrame:
        at = lambda offset: F.lead(value, offset).over(w) if offset else F.col(value)
        made = {name: sum((factor * at(offset) for offset, factor in list(kernel.items())[1:]), list(kernel.values())[0] * at(list(kernel)[0])) for name, (kernel, _) in filters.items()}
        return d.withColumns({name: F.when(F.col("idx") < F.col("_n") - lost, made[name]) for name, (_, lost) in filters.items()})

    return in_blocks(df.join(ends, "series"), 0, reach, body).drop("_n")


def filtered_series(df: DataFrame, filters: dict[str, tuple[dict[int, int], int]], value: str = "value") -> DataFrame:
    """The filters as series of their own, named series|filter, for spectra and correlograms."""
    made = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("value")) for name in filters])
    rows = filtered(df, filters, value).select("series", "idx", F.explode(made).alias("p"))
    return rows.select(F.concat_ws("|", "series", "p.kind").alias("series"), "idx", "p.value").filter("value is not null")


def runs(df: DataFrame, state: str = "state") -> DataFrame:
    """(series, run, state, start, len) of maximal runs of one state, in order.

    A run starts where the state changes, found within blocks; starts are numbered and followed within blocks too, and a block's last
    run takes its end from the next block with a start, so no series' runs meet in one task.
    """
    starts = in_blocks(df, 1, 0, lambda d, w: d.withColumn("_new", ~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.col("idx") == 0))).filter("_new")
    ends = df.groupBy("series").agg((F.max("idx") + 1).alias("_end"))
    found = starts.select("series", F.col("idx").alias("start"), F.col(state).alias("state"), F.floor(F.col("idx") / BLOCK).alias("_b"))
    by_series = Window.partitionBy("series").orderBy("_b")
    blocks = found.groupBy("series", "_b").agg(F.min("start").alias("_first"), F.count("*").alias("_n"))
    blocks = blocks.select("series", "_b", F.lead("_first").over(by_series).alias("_after"), F.coalesce(F.sum("_n").over(by_series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("series", "_b").orderBy("start")
    inside = found.withColumns({"_next": F.lead("start").over(w), "_rank": F.row_number().over(w) - 1})
    whole = inside.join(blocks, ["series", "_b"]).join(ends, "series")
    return whole.select("series", (F.col("_rank") + F.col("_before")).alias("run"), "state", "start", (F.coalesce("_next", "_after", "_end") - F.col("start")).alias("len"))


def longest_runs(run_table: DataFrame) -> DataFrame:
    """The longest run of each series and state, the first on ties."""
    return run_table.groupBy("series", "state").agg(F.max_by("start", F.struct("len", -F.col("start"))).alias("start"), F.max("len").alias("len"))


def ramps(df: DataFrame, rising: bool, value: str = "value") -> DataFrame:
    """(series, start, end, duration, change): maximal monotone segments that rise (or fall), in steps."""
    ok = (lambda a, b: a > b) if rising else (lambda a, b: a < b)
    moved = in_blocks(df, 1, 0, lambda d, w: d.withColumn("_up", F.coalesce(ok(F.col(value), F.lag(value).over(w)), F.lit(False))))
    steps = runs(moved.select("series", "idx", F.col("_up").alias("state"))).filter("state")
    spans = steps.select("series", (F.col("start") - 1).alias("start"), (F.col("start") + F.col("len") - 1).alias("end"))
    at = lambda name: df.select("series", F.col("idx").alias(name), F.col(value).alias(f"_{name}"))
    joined = spans.join(at("start"), ["series", "start"]).join(at("end"), ["series", "end"])
    return joined.select("series", "start", "end", (F.col("end") - F.col("start")).alias("duration"), (F.col("_end") - F.col("_start")).alias("change"))


def both_ramps(df: DataFrame, value: str = "value") -> DataFrame:
    """Rising and falling segments together."""
    return ramps(df, True, value).unionByName(ramps(df, False, value))


def exactly(value: Column, places: int) -> Column:
    """Half to even on the shortest decimal form, cut to nine places, so that binary noise of sums doesn't decide ties."""
    return F.bround(value.cast("decimal(28,9)"), places).cast("double")


#: Ranges of values that rows of a series are dealt to, less one.
SPLITTERS = 1023


def splitters(df: DataFrame, value: str) -> DataFrame:
    """(series, splitters): values that cut the rows of a series into ranges of about as many rows, whatever their distribution."""
    return df.groupBy("series").agg(F.percentile_approx(value, F.array(*[F.lit(i / (SPLITTERS + 1)) for i in range(1, SPLITTERS + 1)]), 20_000).alias("splitters"))


def range_of(value: Column, cuts: Column) -> Column:
    """How many of the SPLITTERS sorted values are at most the given one, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(SPLITTERS.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.element_at(cuts, at + step) <= value, step).otherwise(0))


def cumulated(counts: DataFrame, value: str = "value") -> DataFrame:
    """Adds _before, the rows n of smaller values of the series, to counts (series, value, n) of distinct values.

    Values are ranked within ranges between sampled splitters; only the ranges' totals meet by series.
    """
    placed = counts.join(splitters(counts, value), "series").withColumn("_range", range_of(F.col(value), F.col("splitters"))).drop("splitters")
    totals = placed.groupBy("series", "_range").agg(F.sum("n").alias("_rows"))
    earlier = Window.partitionBy("series").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("series", "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    inside = F.sum("n").over(Window.partitionBy("series", "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(shift, ["series", "_range"]).withColumn("_before", F.col("_shift") + F.col("_inside")).drop("_shift", "_inside", "_range")


def power_rates(df: DataFrame, minutes: float, value: str = "value", places: int = 3) -> DataFrame:
    """(series, idx, rate, kind): the tenth of steps (2 at least) that fall and rise most a minute; idx is the first step of that rate.

    Steps are counted by rate first, and rates are ranked within ranges, so no series is sorted in one task.
    """
    moved = in_blocks(df, 0, 1, lambda d, w: d.withColumn("_next", F.lead(value).over(w))).filter("_next is not null")
    steps = moved.select("series", "idx", exactly((F.col("_next") - F.col(value)) / minutes, places).alias("rate"))
    counts = steps.groupBy("series", "rate").agg(F.count("*").alias("n"), F.min("idx").alias("idx"))
    total = counts.groupBy("series").agg(F.sum("n").alias("_n"))
    k = F.greatest(F.floor((F.col("_n") + 1) / 10), F.lit(0))
    sized = cumulated(counts, "rate").join(total, "series").withColumn("_k", F.least(F.when(k > 1, k).otherwise(2), F.col("_n")))
    taken = lambda left: F.greatest(F.least(F.col("_k") - left, F.col("n")), F.lit(0)).cast("int")
    kinds = F.array(F.struct(F.lit("fall").alias("kind"), taken(F.col("_before")).alias("m")), F.struct(F.lit("rise").alias("kind"), taken(F.col("_n") - F.col("_before") - F.col("n")).alias("m")))
    rows = sized.select("series", "idx", "rate", F.explode(kinds).alias("x")).filter("x.m > 0")
    return rows.select("series", "idx", "rate", "x.kind", F.explode(F.array_repeat(F.lit(1), F.col("x.m"))).alias("_")).drop("_")


def positions(df: DataFrame, order: tuple[str, ...], bucket: Column) -> DataFrame:
    """Adds rank, from 0, within the series: ranks within buckets, which must follow the order, shifted by the earlier buckets' rows."""
    keyed = df.withColumn("_bucket", bucket)
    before = Window.partitionBy("series").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = keyed.groupBy("series", "_bucket").count().select("series", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("series", "_bucket").orderBy(*order)))
    return ranked.join(shift, ["series", "_bucket"]).withColumn("rank", (F.col("_rank") - 1 + F.col("_before")).cast("long")).drop("_rank", "_before", "_bucket")


def last_n(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series, by idx."""
    ends = df.groupBy("series").agg(F.max("idx").alias("_last"))
    return df.join(ends, "series").filter(F.col("idx") > F.col("_last") - n).drop("_last")


def tumbling(df: DataFrame, period: int, offset: int, value: str = "value") -> DataFrame:
    """(series, area, mean, std, low, high, n_in, n_out): full windows of period rows from offset, with a 10 % band around the mean."""
    area = F.floor((F.col("idx") - offset) / period)
    rows = df.filter(F.col("idx") >= offset).withColumn("area", area)
    stats = rows.groupBy("series", "area").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("_n")).filter(F.col("_n") == period)
    inside = F.col(value).between(F.col("mean") * 0.9, F.col("mean") * 1.1)
    return rows.join(stats, ["series", "area"]).groupBy("series", "area", "mean", "std", "low", "high").agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))


def stability(df: DataFrame, low: float | Column, high: float | Column, minutes: int, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(runs (series, stable, minutes), times (series, stable, unstable, off)): samples within and out of a band.

    Samples of zero or less are off: they count as such and break no run.
    """
    on = df.filter(F.col(value) > 0)
    kept = positions(on, ("idx",), F.floor(F.col("idx") / BLOCK)).select("series", F.col("rank").alias("idx"), F.col(value).between(low, high).alias("state"))
    found = runs(kept).select("series", F.col("state").alias("stable"), (F.col("len") * minutes).alias("minutes"))
    inside = (F.col(value) > 0) & F.col(value).between(low, high)
    n = lambda c: (F.count_if(c) * minutes)
    return found, df.groupBy("series").agg(n(inside).alias("stable"), n((F.col(value) > 0) & ~inside).alias("unstable"), n(F.col(value) <= 0).alias("off"))


def day_profiles(df: DataFrame, value: str = "value") -> DataFrame:
    """(series, day, pos, value): samples from each midnight sample to the next; those before the first and from the last one on are left out.

    Midnights are found among the rows, and looked up by date, one row for each series and date.
    """
    midnight = (F.hour("ts") == 0) & (F.minute("ts") == 0)
    dates = df.groupBy("series", F.to_date("ts").alias("date")).agg(F.min(F.when(midnight, F.col("idx"))).alias("at"), F.min(F.when(midnight, F.col("ts"))).alias("day"))
    so_far = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = dates.select("series", "date", F.last("at", ignorenulls=True).over(so_far).alias("at"), F.last("day", ignorenulls=True).over(so_far).alias("day"))
    last = dates.groupBy("series").agg(F.max("at").alias("_last"))
    rows = df.select("series", "idx", F.to_date("ts").alias("date"), F.col(value).alias("value")).join(known.filter("at is not null"), ["series", "date"]).join(last, "series")
    return rows.filter((F.col("idx") >= F.col("at")) & (F.col("at") < F.col("_last"))).select("series", "day", (F.col("idx") - F.col("at")).alias("pos"), "value")


def smoothed(df: DataFrame, value: str = "value", size: int = BLOCK) -> DataFrame:
    """Adds smooth: from left to right, each value between two equal ones becomes that value, so that a change carries on.

    A sample either stays or takes the next one's value. Which of the two depends on what its neighbour before it did, so a sample is a map
    of two states: both to one, each to itself, or each to the other. What a sample does is what the last map to one state gives, turned
    round by the swaps since; blocks are composed to such maps, and only those meet by series.
    """
    ends = df.groupBy("series").agg(F.max("idx").alias("_last"))

    def maps(d: DataFrame, w) -> DataFrame:
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        stayed, moved = F.coalesce(before.eqNullSafe(after), F.lit(False)), F.coalesce(F.col(value).eqNullSafe(after), F.lit(False))
        border = (F.col("idx") == 0) | (F.col("idx") == F.col("_last"))
        fixed = F.when(border, F.lit(False)).when(stayed == moved, stayed)
        return d.withColumns({"_after": after, "_fixed": fixed.cast("int"), "_swap": F.when(border | (stayed == moved), 0).otherwise(stayed.cast("int"))})

    block = F.floor(F.col("idx") / size)
    rows = in_blocks(df.join(ends, "series"), 1, 1, maps, size).withColumn("_b", block)
    w = Window.partitionBy("series", "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_turns", F.sum("_swap").over(w))
    # The last fixed state, as it would be with no swap before it in the block.
    rows = rows.withColumn("_base", F.last(F.when(F.col("_fixed").isNotNull(), (F.col("_fixed") + F.col("_turns")) % 2), ignorenulls=True).over(w))
    blocks = rows.groupBy("series", "_b").agg(F.sum("_swap").alias("_all"), F.max_by("_base", "idx").alias("_tail"))
    so_far = Window.partitionBy("series").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("_sum", F.sum("_all").over(so_far))
    blocks = blocks.withColumn("_held", F.last(F.when(F.col("_tail").isNotNull(), (F.col("_tail") + F.col("_sum") - F.col("_all")) % 2), ignorenulls=True).over(so_far))
    entry = blocks.select("series", (F.col("_b") + 1).alias("_b"), ((F.col("_held") + F.col("_sum")) % 2).alias("_entry"))
    ready = rows.join(entry, ["series", "_b"], "left")
    taken = (F.coalesce(F.col("_base"), F.col("_entry")) + F.col("_turns")) % 2 == 1
    return ready.select(*df.columns, F.when(taken, F.col("_after")).otherwise(F.col(value)).alias("smooth"))
