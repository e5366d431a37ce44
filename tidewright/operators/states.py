"""States of samples, transitions between them, and what an observation looks like in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.windows import in_blocks

#: Codes and names of the balance of consumers and generators (fixed values).
BALANCE, LACK, DEMAND_RISE, EXCESS, GENERATION_RISE = range(5)
NAMES5 = {
    BALANCE: ("BLNC", "Balance of consumer power and generated power"),
    LACK: ("LACK", "Lack electrical power"),
    DEMAND_RISE: ("SIPC", "Sharp increase in power consumption"),
    EXCESS: ("EXCS", "Excess electrical power"),
    GENERATION_RISE: ("SIGP", "Sharp increase in generation power"),
}
#: The eight states by code: (short, long) names (fixed values).
NAMES8 = {
    0: ("D__", "Diesels, WindTurbine Off, Hydrawlic Off"),
    1: ("W__", "Diesels Off,WindTurbine, Hydrawlic Off"),
    2: ("DW_", "Diesels, WindTurbine, Hydrawlic Off"),
    3: ("DT_", "Diesels, WindTurbines Off, Hydrawlic Turbine"),
    4: ("WT_", "Diesels Off, WindTurbines, Hydrawlic Turbine"),
    5: ("DWT", "Diesels , WindTurbines, Hydrawlic Turbine"),
    6: ("WP_", "Diesels Off, WindTurbines, Hydrawlic Pump"),
    7: ("DWP", "Diesels , WindTurbines, Hydrawlic Pump"),
}
#: The 36 states in the order of their codes: (flags, short, long) (fixed values). Two short names are misprints in the surveyed table,
#: which has iDiW_ for dDiW_ (a fall of the diesels) and dWxxP for xxdWP; here each is the name of its state.
STATES36 = (
    (1, "_Dxxx", "Diesels, WindTurbine Off, Hydrawlic Off"),
    (2, "iDxxx", "IncPower Diesels, WindTurbine Off, Hydrawlic Off"),
    (8, "xxxW_", "Diesels Off, WindTurbine, Hydrawlic Off"),
    (16, "xxiW_", "Diesels Off, IncPower WindTurbine, Hydrawlic Off"),
    (32, "xxdW_", "Diesels Off, DecPower WindTurbine, Hydrawlic Off"),
    (9, "_D_W_", "Diesels, WindTurbine, Hydrawlic Off"),
    (17, "_DiW_", "Diesels, IncPower WindTurbine, Hydrawlic Off"),
    (33, "_DdW_", "Diesels, DecPower WindTurbine, Hydrawlic Off"),
    (10, "iD_W_", "IncPower Diesels, WindTurbine, Hydrawlic Off"),
    (34, "iDdW_", "IncPower Diesels, DecPower WindTurbine, Hydrawlic Off"),
    (12, "dD_W_", "DecPower Diesels, WindTurbine, Hydrawlic Off"),
    (20, "dDiW_", "DecPower Diesels, IncPower WindTurbine, Hydrawlic Off"),
    (129, "_DxxT", "Diesels, WindTurbine Off, Hydrawlic Turbine"),
    (130, "iDxxT", "IncPower Diesels, WindTurbine Off,Hydrawlic Turbine"),
    (132, "dDxxT", "DecPower Diesels, WindTurbine Off, Hydrawlic Turbine"),
    (136, "xxxWT", "Diesels Off, WindTurbine, Hydrawlic Turbine"),
    (144, "xxiWT", "Diesels Off, IncPower WindTurbine, Hydrawlic Turbine"),
    (160, "xxdWT", "Diesels Off, DecPower WindTurbine, Hydrawlic Turbine"),
    (137, "_D_WT", "Diesels, WindTurbine, Hydrawlic Turbine"),
    (145, "_DiWT", "Diesels, IncPower WindTurbine, Hydrawlic Turbine"),
    (161, "_DdWT", "Diesels, DecPower WindTurbine, Hydrawlic Turbine"),
    (138, "iD_WT", "IncPower Diesels, WindTurbine, Hydrawlic Turbine"),
    (162, "iDdWT", "IncPower Diesels, DecPower WindTurbine, Hydrawlic Turbine"),
    (140, "dD_WT", "DecPower Diesels, WindTurbine, Hydrawlic Turbine"),
    (148, "dDiWT", "DecPower Diesels, IncPower WindTurbine, Hydrawlic Turbine"),
    (264, "xxxWP", "Diesels Off, WindTurbine, Hydrawlic Pump"),
    (272, "xxiWP", "Diesels Off, IncPower WindTurbine, Hydrawlic Pump"),
    (288, "xxdWP", "Diesels Off, DecPower WindTurbine, Hydrawlic Pump"),
    (265, "_D_WP", "Diesels, WindTurbine, Hydrawlic Pump"),
    (273, "_DiWP", "Diesels, IncPower WindTurbine, Hydrawlic Pump"),
    (289, "_DdWP", "Diesels, DecPower WindTurbine, Hydrawlic Pump"),
    (266, "iD_WP", "IncPower Diesels, WindTurbine, Hydrawlic Pump"),
    (274, "iDiWP", "IncPower Diesels, IncPower WindTurbine, Hydrawlic Pump"),
    (290, "iDdWP", "IncPower Diesels, DecPower WindTurbine, Hydrawlic Pump"),
    (268, "dD_WP", "DecPower Diesels, WindTurbine, Hydrawlic Pump"),
    (276, "dDiWP", "DecPower Diesels, IncPower WindTurbine, Hydrawlic Pump"),
)
NAMES36 = {i: (short, long) for i, (_, short, long) in enumerate(STATES36)}
#: Bits of the flags: a source that is steady, rising, falling; the plant as turbine, as pump (fixed values).
DIESEL_STEADY, DIESEL_RISE, DIESEL_FALL, WIND_STEADY, WIND_RISE, WIND_FALL, TURBINE, PUMP = 1, 2, 4, 8, 16, 32, 128, 256


def named(df: DataFrame, code: str, names: dict[int, tuple[str, str]]) -> DataFrame:
    """Adds short and long, the names of a code, UNDF if it has none."""
    short, long = (F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[i])]) for i in (0, 1))
    return df.withColumns({"short": F.coalesce(F.element_at(short, F.col(code)), F.lit("UNDF")), "long": F.coalesce(F.element_at(long, F.col(code)), F.lit("UNDF"))})


def sign_state(value: Column, band: Column | float) -> Column:
    """-1, 0 or 1, 0 within the band."""
    band = F.lit(band) if isinstance(band, float) else band
    return F.when(value > band, 1).when(value < -band, -1).otherwise(0)


def five_states(df: DataFrame, value: str = "value", band: float = 1e-3) -> DataFrame:
    """Adds state: excess below the band, lack above it; overridden where the next value runs away from the line through the last two.

    The value is the consumers' power less the generated one. The first and last samples have their band only.
    """

    def body(d: DataFrame, w) -> DataFrame:
        x, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
        level = F.when(x < -band, EXCESS).when(x > band, LACK).otherwise(BALANCE)
        demand, generation = (x > before) & (after > 2 * x - before), (x < before) & (after < 2 * x - before)
        return d.withColumn("state", F.when(demand, DEMAND_RISE).when(generation, GENERATION_RISE).otherwise(level))

    return in_blocks(df, 1, 1, body)


def eight_states(diesel: Column, wind: Column, hydro: Column) -> Column:
    """The code of which sources run, the hydraulic plant as turbine above zero and as pump below; null for other combinations."""
    on = {"D": diesel > 0, "W": wind > 0, "T": hydro > 0, "P": hydro < 0}
    off = {"D": diesel == 0, "W": wind == 0, "T": hydro == 0}
    state = F.lit(None).cast("int")
    for code, (name, _) in NAMES8.items():
        plant = on["T"] if "T" in name else on["P"] if "P" in name else off["T"]
        state = F.when((on if "D" in name else off)["D"] & (on if "W" in name else off)["W"] & plant, code).otherwise(state)
    return state


def change_states(df: DataFrame, diesel: str, wind: str, hydro: str, threshold: float = 0.577, compat: bool = True) -> DataFrame:
    """Adds code, the flags of steady, rising and falling sources and of the plant, and state, their number of 36; null if they have none.

    With compat the first sample counts wind and turbine as running whatever their values, as in older results.
    """

    def body(d: DataFrame, w) -> DataFrame:
        def flags(c: str, steady: int, rise: int, fall: int) -> Column:
            step = F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
            return F.when(step > threshold, rise).when(step < -threshold, fall).when(F.col(c) > 0, steady).otherwise(0)

        plant = F.when(F.col(hydro) > 0, TURBINE).when(F.col(hydro) < 0, PUMP).otherwise(0)
        code = flags(diesel, DIESEL_STEADY, DIESEL_RISE, DIESEL_FALL) + flags(wind, WIND_STEADY, WIND_RISE, WIND_FALL) + plant
        if compat:
            first = F.when(F.col(diesel) > 0, DIESEL_STEADY).otherwise(0) + F.lit(WIND_STEADY + TURBINE) + F.when(F.col(hydro) < 0, PUMP).otherwise(0)
            code = F.when(F.col("idx") == 0, first).otherwise(code)
        return d.withColumn("code", code)

    number = F.create_map(*[F.lit(x) for i, (flags, _, _) in enumerate(STATES36) for x in (flags, i)])
    return in_blocks(df, 1, 0, body).withColumn("state", F.element_at(number, F.col("code")))


def abrupt_states(df: DataFrame, level: float, sides: str = "all", value: str = "value") -> DataFrame:
    """Adds state: 1 near the largest value of the series, -1 near the smallest (which wins), 0 between.

    sides is all, upper or lower; for one side the band is half as wide, and only that side is marked.
    """
    ends = df.groupBy("series").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    delta = (F.col("_high") - F.col("_low")) * (1 - level) / (1 if sides == "all" else 2)
    state = F.lit(0)
    if sides != "lower":
        state = F.when(F.col(value) >= F.col("_high") - delta, 1).otherwise(state)
    if sides != "upper":
        state = F.when(F.col(value) <= F.col("_low") + delta, -1).otherwise(state)
    return df.join(ends, "series").withColumn("state", state).drop("_low", "_high")


def centred(df: DataFrame, value: str = "value", share: float = 0.1) -> DataFrame:
    """Adds centred, the deviation from the series' mean, and state, its sign outside share of the deviation."""
    stats = df.groupBy("series").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    deviation = F.col(value) - F.col("_m")
    return df.join(stats, "series").withColumns({"centred": deviation, "state": sign_state(deviation, F.col("_s") * share)}).drop("_m", "_s")


def transition_counts(df: DataFrame, state: str = "state") -> DataFrame:
    """(series, i, j, n) of neighbouring states."""
    pairs = in_blocks(df, 0, 1, lambda d, w: d.withColumn("_next", F.lead(state).over(w))).filter("_next is not null")
    return pairs.groupBy("series", F.col(state).alias("i"), F.col("_next").alias("j")).agg(F.count("*").alias("n"))


def transition_matrix(df: DataFrame, states: list[int], state: str = "state") -> DataFrame:
    """(series, i, j, p) for all pairs of the given states, zeros included; rows without transitions are all zero."""
    counts = transition_counts(df, state)
    every = F.array(*map(F.lit, states))
    grid = df.select("series").distinct().select("series", F.explode(every).alias("i")).select("series", "i", F.explode(every).alias("j"))
    total = counts.groupBy("series", "i").agg(F.sum("n").alias("total"))
    p = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))
    return grid.join(counts, ["series", "i", "j"], "left").join(total, ["series", "i"], "left").select("series", "i", "j", p.alias("p"))


def emissions(df: DataFrame, state: str = "state", value: str = "value", floor: float = 0.01, single: float = 1e-4) -> DataFrame:
    """(series, state, pi, mean, std): share, mean and population deviation by state, with floors."""
    total = df.groupBy("series").agg(F.count("*").alias("total"))
    stats = df.groupBy("series", F.col(state).alias("state")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("s"))
    std = F.when(F.col("n") == 1, single).otherwise(F.greatest(F.lit(floor), "s"))
    return stats.join(total, "series").select("series", "state", (F.col("n") / F.col("total")).alias("pi"), "mean", std.alias("std"))


#: Signs by state, and the patterns of neighbouring signs and of the first one (fixed values).
SIGNS = {-1: "-", 0: "0", 1: "+"}
PATTERNS = ("--", "-0", "-+", "0-", "00", "0+", "+-", "+0", "++", "Start-", "Start0", "Start+")


def _sign(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), state)


def pattern_totals(df: DataFrame, state: str = "state") -> DataFrame:
    """(pattern, n): how often each of PATTERNS comes in all series together, zeros included."""
    pairs = in_blocks(df, 0, 1, lambda d, w: d.withColumn("_next", F.lead(state).over(w)))
    found = F.array(F.concat(_sign(F.col(state)), _sign(F.col("_next"))), F.when(F.col("idx") == 0, F.concat(F.lit("Start"), _sign(F.col(state)))))
    counts = pairs.select(F.explode(found).alias("pattern")).filter("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return every.join(counts, "pattern", "left").fillna(0, ["n"])


def sign_statistics(df: DataFrame, value: str = "value", state: str = "state") -> DataFrame:
    """(series, sign, n, mean, std, start) for all three signs of each series; std is the population's, start whether the series begins so."""
    stats = df.groupBy("series", F.col(state).alias("state")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(F.col("idx") == 0).alias("start"))
    every = df.select("series").distinct().select("series", F.explode(F.array(*map(F.lit, SIGNS))).alias("state"))
    rows = every.join(stats, ["series", "state"], "left").fillna(0, ["n"]).fillna(False, ["start"])
    return rows.select("series", _sign(F.col("state")).alias("sign"), "n", "mean", "std", "start")


def rates(df: DataFrame, minutes: int, state: str = "state") -> DataFrame:
    """(series, state, rate, period): events by minute and its inverse."""
    total = df.groupBy("series").agg(F.count("*").alias("total"))
    n = df.groupBy("series", F.col(state).alias("state")).agg(F.count("*").alias("n")).join(total, "series")
    rate = F.col("n") / (F.col("total") * minutes)
    return n.select("series", "state", rate.alias("rate"), (1 / rate).alias("period"))


def ramp_code(duration: Column, change: Column, minutes: int) -> Column:
    """0 to 4 by the rate of change at 0.01, 0.075, 0.15 and 0.225 a minute, 4 more for a fall; null for changes under 1.

    The rate is over all samples of the ramp, one more than its steps.
    """
    rate = F.bround(F.abs(change) / ((duration + 1) * minutes), 4)
    band = F.when(rate >= 0.225, 4).when(rate >= 0.15, 3).when(rate >= 0.075, 2).when(rate >= 0.01, 1).otherwise(0)
    return F.when(F.abs(change) >= 1, F.when((change < 0) & (band > 0), band + 4).otherwise(band))


def ramp_samples(df: DataFrame, ramps: DataFrame, minutes: int) -> DataFrame:
    """(series, idx, state): the code of the ramp that covers each sample, the falling one if two do, else 0; the last sample has 0."""
    coded = ramps.withColumn("code", ramp_code(F.col("duration"), F.col("change"), minutes)).filter("code is not null")
    ends = df.groupBy("series").agg(F.max("idx").alias("_last"))
    covered = coded.join(ends, "series").filter(F.col("start") < F.col("_last")).select("series", F.explode(F.sequence("start", F.least(F.col("end"), F.col("_last") - 1))).alias("idx"), "code", (F.col("change") < 0).alias("fall"))
    states_ = covered.groupBy("series", "idx").agg(F.max_by("code", "fall").alias("state"))
    return df.select("series", "idx").join(states_, ["series", "idx"], "left").fillna(0, ["state"])
