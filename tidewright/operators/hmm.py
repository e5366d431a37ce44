"""Hidden Markov models per series: estimation by grouped counts, forward-backward, Viterbi, state forecasts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import states
from tidewright.operators.windows import BLOCK


@dataclass
class Model:
    """Initial, transition and emission probabilities; emission(observation) gives a row of likelihoods by state."""

    start: np.ndarray
    moves: np.ndarray
    emission: Callable[[np.ndarray], np.ndarray]


def discrete(matrix: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Emissions of symbols 0, 1, …; matrix is (state, symbol)."""
    return lambda obs: matrix[:, np.asarray(obs, int)].T


def gaussian(mean: np.ndarray, std: np.ndarray, cumulative: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Normal densities; or, for comparison with older results, distribution functions rounded at 6 places."""

    def at(obs: np.ndarray) -> np.ndarray:
        z = (np.asarray(obs, float)[:, None] - mean) / std
        if cumulative:
            return np.round(np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))(z), 6)
        return np.exp(-z * z / 2) / (std * math.sqrt(2 * math.pi))

    return at


def poisson(rate: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda obs: np.array([[math.exp(-r + n * math.log(max(r, 1e-12)) - math.lgamma(n + 1)) for r in rate] for n in np.asarray(obs)])


def forward(m: Model, obs: np.ndarray) -> tuple[np.ndarray, float]:
    """(scaled forward rows, log-probability of the observations)."""
    b, rows, total = m.emission(obs), [], 0.0
    a = m.start * b[0]
    for t in range(len(b)):
        a = a if t == 0 else (rows[-1] @ m.moves) * b[t]
        s = a.sum()
        total += math.log(s) if s > 0 else -math.inf
        rows.append(a / s if s > 0 else a)
    return np.array(rows), total


def backward(m: Model, obs: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """Backward rows, each scaled to sum 1; end weighs the last state."""
    b = m.emission(obs)
    rows = [np.ones(len(m.start)) if end is None else end]
    for t in range(len(b) - 1, 0, -1):
        r = m.moves @ (b[t] * rows[-1])
        rows.append(r / max(r.sum(), 1e-300))
    return np.array(rows[::-1])


def posterior(m: Model, obs: np.ndarray) -> np.ndarray:
    p = forward(m, obs)[0] * backward(m, obs)
    return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


def viterbi(m: Model, obs: np.ndarray, positional: bool = False) -> tuple[list[int], float]:
    """(most probable path, its log-probability), the first state on ties.

    positional gives the path of an older decoder: the best state of each column shifted by one, its last doubled.
    """
    with np.errstate(divide="ignore"):
        b, moves, v = np.log(m.emission(obs)), np.log(m.moves), np.log(m.start)
    v, back, columns = v + b[0], [], []
    columns.append(v)
    for row in b[1:]:
        step = v[:, None] + moves
        back.append(step.argmax(0))
        v = step.max(0) + row
        columns.append(v)
    path = [int(v.argmax())]
    for row in back[::-1]:
        path.append(int(row[path[-1]]))
    if positional:
        best = [int(c.argmax()) for c in columns[1:]]
        return [*best, int(v.argmax())], float(v.max())
    return path[::-1], float(v.max())


def forecast_states(m: Model, last: np.ndarray, steps: int) -> list[int]:
    """States after 1, 2, … steps from a distribution over states."""
    out = []
    for _ in range(steps):
        last = last @ m.moves
        out.append(int(last.argmax()))
    return out


def estimated(df: DataFrame, codes: list[int]) -> tuple[DataFrame, DataFrame]:
    """(emissions, transitions) of labelled series, by grouped counts."""
    return states.emissions(df), states.transition_matrix(df, codes)


def as_dictionaries(m: Model, names: list, observations: np.ndarray, labels: list) -> tuple[dict, dict, dict]:
    """(start, moves, emissions) of a model by the names of its states and the labels of observations."""
    b = m.emission(observations)
    start = {s: float(p) for s, p in zip(names, m.start, strict=True)}
    moves = {s: {t: float(p) for t, p in zip(names, row, strict=True)} for s, row in zip(names, m.moves, strict=True)}
    return start, moves, {s: {label: float(b[k, i]) for k, label in enumerate(labels)} for i, s in enumerate(names)}


def to_fields(start: np.ndarray, moves: np.ndarray, mean: np.ndarray, std: np.ndarray, codes: list[int]) -> dict:
    """A model with normal emissions as plain lists, to be saved."""
    return {"start": np.asarray(start).tolist(), "moves": np.asarray(moves).tolist(), "mean": np.asarray(mean).tolist(), "std": np.asarray(std).tolist(), "codes": list(codes)}


def from_fields(fields: dict) -> Model:
    return Model(np.array(fields["start"]), np.array(fields["moves"]), gaussian(np.array(fields["mean"]), np.array(fields["std"])))


def parameters(df: DataFrame, codes: list[int], value: str = "value", state: str = "state") -> DataFrame:
    """(series, start, moves, mean, std): arrays by state in the order of codes, from grouped counts; absent states keep small floors."""
    kinds = F.array(*map(F.lit, codes))
    stats = states.emissions(df, state, value)
    table = stats.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("pi", "mean", "std")))).alias("s"))  # a row for each state
    part = lambda name, none: F.transform(kinds, lambda c: F.coalesce(F.element_at("s", c)[name], F.lit(none)))
    counts = states.transition_counts(df, state).groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "n"))).alias("n"))
    n = lambda i, j: F.coalesce(F.element_at("n", F.struct(i.alias("i"), j.alias("j"))).cast("double"), F.lit(0.0)) + 1e-6
    row = lambda i: F.transform(kinds, lambda j: n(i, j) / F.aggregate(F.transform(kinds, lambda k: n(i, k)), F.lit(0.0), lambda a, v: a + v))
    total = F.aggregate(part("pi", 0.0), F.lit(0.0), lambda a, v: a + v + 1e-9)
    both = table.join(counts, "series", "left")
    return both.select("series", F.transform(part("pi", 0.0), lambda p: (p + 1e-9) / total).alias("start"), F.transform(kinds, row).alias("moves"), part("mean", 0.0).alias("mean"), part("std", 1e-4).alias("std"))


def log_likelihood(df: DataFrame, models: DataFrame, value: str = "value", size: int = BLOCK) -> DataFrame:
    """(series, n, logp) under models (series, start, moves, mean, std) with normal emissions.

    A block of samples is one matrix, the product of its steps' moves and emissions, scaled; only these meet by series, in order.
    """
    placed = df.select("series", "idx", F.col(value).alias("v"), F.floor(F.col("idx") / size).alias("b")).join(models, "series")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf.sort_values("idx")
        r = ready.iloc[0]
        start, moves = np.array(r["start"]), np.array([list(x) for x in r["moves"]])
        b = gaussian(np.array(r["mean"]), np.array(r["std"]))(ready["v"].to_numpy())
        m, scale = np.eye(len(start)), 0.0
        for t, row in enumerate(b):
            m = (m if ready["idx"].iloc[0] == 0 and t == 0 else m @ moves) * row
            s = m.sum()
            m, scale = (m / s, scale + math.log(s)) if s > 0 else (m, -math.inf)
        return pd.DataFrame({"series": [r["series"]], "b": [r["b"]], "n": [len(b)], "m": [m.ravel()], "scale": [scale], "start": [start]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf.sort_values("b")
        a, total = np.array(ready["start"].iloc[0]), 0.0
        for m, scale in zip(ready["m"], ready["scale"], strict=True):
            a = a @ np.array(m).reshape(len(a), -1)
            s = a.sum()
            a, total = (a / s, total + scale + math.log(s)) if s > 0 else (a, -math.inf)
        return pd.DataFrame({"series": [ready["series"].iloc[0]], "n": [int(ready["n"].sum())], "logp": [total]})

    parts = placed.groupBy("series", "b").applyInPandas(block, "series string, b long, n long, m array<double>, scale double, start array<double>")
    return parts.groupBy("series").applyInPandas(whole, "series string, n long, logp double")


#: Units of logarithms of probabilities, which are added as whole numbers, so that ties don't depend on how a path is cut into blocks; and the least one.
LOG_UNIT, LOG_LEAST = 2.0**24, -65536.0


def log_emissions(x: np.ndarray, mean: np.ndarray, std: np.ndarray, kind: str) -> np.ndarray:
    """Rows of logarithms by state: normal densities, or Poisson probabilities with mean as rates."""
    if kind == "poisson":
        n, rate = np.asarray(x, float)[:, None], np.maximum(mean, 1e-12)
        log = n * np.log(rate) - rate - np.array([math.lgamma(v + 1) for v in np.asarray(x, float)])[:, None]
    else:
        z = (np.asarray(x, float)[:, None] - mean) / std
        log = -z * z / 2 - np.log(std * math.sqrt(2 * math.pi))
    return np.maximum(log, LOG_LEAST)


def whole_logs(p: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities in whole units."""
    with np.errstate(divide="ignore"):
        return np.rint(np.maximum(np.log(p), LOG_LEAST) * LOG_UNIT).astype(np.int64)


class Steps:
    """The samples of a block under a model: what a step does to (max, +) scores and to probabilities."""

    def __init__(self, r, kind: str):
        self.start, self.moves = np.asarray(r.start, float), np.array([np.asarray(x, float) for x in r.moves])
        log = log_emissions(np.asarray(r.x, float), np.asarray(r.mean, float), np.asarray(r.std, float), kind)
        self.b, self.p = np.rint(log * LOG_UNIT).astype(np.int64), np.exp(log - log.max(1, keepdims=True))
        self.a, self.first = whole_logs(self.moves), r.b == 0
        self.pi, self.n, self.k = whole_logs(self.start), len(log), len(self.start)

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """What the whole block does: (best scores from each state before it to each at its end, scaled sums of probabilities)."""
        w = np.where(np.eye(self.k, dtype=bool), 0, np.int64(-(1 << 60))) if self.first else None
        m = np.eye(self.k)
        for t in range(self.n):
            if not (self.first and t == 0):
                w = self.a if w is None else (w[:, :, None] + self.a).max(1)
                m = m @ self.moves
            w, m = np.maximum(w + self.b[t], -(1 << 60)), m * self.p[t]
            m = m / max(m.max(), 1e-300)
        return w, m

    def scores(self, before: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """(back-pointers of each sample, scores at the end) from the scores before the block; the first state on ties."""
        back, v = [], before
        for t in range(self.n):
            if self.first and t == 0:
                v = self.pi + self.b[0]
                back.append(np.arange(self.k))
                continue
            step = v[:, None] + self.a
            back.append(step.argmax(0))
            v = step.max(0) + self.b[t]
        return back, v

    def posteriors(self, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """The most probable state of each sample, from probabilities before the block and after it."""
        rows, a = [], alpha
        for t in range(self.n):
            a = (self.start if self.first and t == 0 else a @ self.moves) * self.p[t]
            a = a / max(a.sum(), 1e-300)
            rows.append(a)
        out = np.empty(self.n, np.int64)
        for t in range(self.n - 1, -1, -1):
            out[t] = (rows[t] * beta).argmax()
            beta = self.moves @ (self.p[t] * beta)
            beta = beta / max(beta.sum(), 1e-300)
        return out


def paths(df: DataFrame, models: DataFrame, value: str = "value", kind: str = "normal", size: int = BLOCK) -> DataFrame:
    """(series, idx, viterbi, posterior): the most probable path and the most probable state of each sample, as numbers of states from 0.

    models are (series, start, moves, mean, std). A block of samples is first one matrix of best scores and one of sums of probabilities, from
    each state before it to each at its end; these meet by series, in order, and give what lies before and after each block. A
    second pass over the blocks finds where the best path to each of their last states comes from; these maps meet by series too and fix the last
    states; a third pass follows the path back within each block. Scores are whole numbers, so the path is that of the
    whole series at once, the first state on ties. A series of one block skips the first two passes.
    """
    rows = df.select("series", "idx", F.col(value).cast("double").alias("v"), F.floor(F.col("idx") / size).alias("b"))
    arrays = rows.groupBy("series", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda r: r["v"]).alias("x"))
    many = df.groupBy("series").agg((F.max("idx") >= size).alias("many"))
    placed = arrays.join(many, "series").join(models.select("series", "start", "moves", "mean", "std"), "series")
    long = placed.filter("many")

    def products(batches):
        for pdf in batches:
            found = [Steps(r, kind).products() for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"series": pdf["series"], "b": pdf["b"], "start": pdf["start"], "w": [w.ravel() for w, _ in found], "m": [m.ravel() for _, m in found]})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf.sort_values("b")
        start = np.asarray(ready["start"].iloc[0], float)
        k = len(start)
        w, m = ([np.asarray(x).reshape(k, k) for x in ready[c]] for c in "wm")
        v, alpha, scores, alphas = whole_logs(start), start, [], []
        for x, y in zip(w, m, strict=True):
            scores.append(v)
            alphas.append(alpha)
            v = (v[:, None] + x).max(0)
            v = v - v.max()
            alpha = alpha @ y
            alpha = alpha / max(alpha.sum(), 1e-300)
        beta, betas = np.ones(k), []
        for y in m[::-1]:
            betas.append(beta)
            beta = y @ beta
            beta = beta / max(beta.sum(), 1e-300)
        return pd.DataFrame({"series": ready["series"], "b": ready["b"], "v": scores, "alpha": alphas, "beta": betas[::-1]})

    def origins(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                back, v = Steps(r, kind).scores(np.asarray(r.v))
                at = np.arange(len(v))
                for row in back[::-1]:
                    at = row[at]
                out.append((r.series, r.b, at, int(v.argmax())))
            yield pd.DataFrame(out, columns=["series", "b", "origin", "best"])

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf.sort_values("b", ascending=False)
        now, out = int(ready["best"].iloc[0]), []
        for origin in ready["origin"]:
            out.append(now)
            now = int(origin[now])
        return pd.DataFrame({"series": ready["series"], "b": ready["b"], "last": out})

    def followed(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                steps = Steps(r, kind)
                whole = r.last is None or pd.isna(r.last)
                back, v = steps.scores(None if whole else np.asarray(r.v))
                path = [int(v.argmax()) if whole else int(r.last)]
                for row in back[:0:-1]:
                    path.append(int(row[path[-1]]))
                best = steps.posteriors(steps.start, np.ones(steps.k)) if whole else steps.posteriors(np.asarray(r.alpha, float), np.asarray(r.beta, float))
                yield pd.DataFrame({"series": r.series, "idx": r.b * size + np.arange(steps.n), "viterbi": path[::-1], "posterior": best})

    known = long.mapInPandas(products, "series string, b long, start array<double>, w array<long>, m array<double>").groupBy("series").applyInPandas(borders, "series string, b long, v array<long>, alpha array<double>, beta array<double>")
    last = long.join(known, ["series", "b"]).mapInPandas(origins, "series string, b long, origin array<long>, best long").groupBy("series").applyInPandas(ends, "series string, b long, last long")
    ready = placed.join(known, ["series", "b"], "left").join(last, ["series", "b"], "left")
    return ready.mapInPandas(followed, "series string, idx long, viterbi int, posterior int")


def level_models(df: DataFrame, value: str, rates: bool) -> DataFrame:
    """(series, low, start, moves, mean, std) of the levels ``programmed`` from the smallest to the largest of each series, by grouped counts.

    Levels that never occur have small floors. With rates, mean is the levels' shares.
    """
    total = df.groupBy("series").agg(F.count("*").alias("total"), F.min("programmed").alias("low"), F.max("programmed").alias("high"))
    levels = df.groupBy("series", "programmed").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    levels = levels.groupBy("series").agg(F.collect_list(F.struct("programmed", "n", "mean", "std")).alias("levels"))
    counts = states.transition_counts(df, "programmed").groupBy("series").agg(F.collect_list(F.struct("i", "j", "n")).alias("counts"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k = int(r.high - r.low) + 1
                share, mean, std, moves = np.zeros(k), r.low + np.arange(k, dtype=float), np.full(k, 1e-2), np.full((k, k), 1e-6)
                for x in r.levels:
                    i = int(x["programmed"] - r.low)
                    share[i], mean[i], std[i] = x["n"] / r.total, x["mean"], max(1e-2, x["std"])
                for x in r.counts if r.counts is not None else ():
                    moves[int(x["i"] - r.low), int(x["j"] - r.low)] += x["n"]
                out.append((r.series, r.low, (share + 1e-9) / (share + 1e-9).sum(), list(moves / moves.sum(1, keepdims=True)), np.maximum(share, 1e-6) if rates else mean, std))
            yield pd.DataFrame(out, columns=["series", "low", "start", "moves", "mean", "std"])

    ready = total.join(levels, "series").join(counts, "series", "left")
    return ready.mapInPandas(run, "series string, low long, start array<double>, moves array<array<double>>, mean array<double>, std array<double>")


def smoothed_power(df: DataFrame, unit: float, value: str = "value", rates: bool = False, size: int = BLOCK) -> DataFrame:
    """(series, idx, programmed, smooth): the value in whole units, and the most probable path of its levels given the value.

    Emissions are normal by level, or Poisson with the levels' shares as rates. Counts are grouped, and the path is made in blocks.
    """
    from tidewright.functions.scalars import quantised

    rows = df.select("series", "idx", F.col(value).cast("double").alias("value"), quantised(F.col(value), unit).alias("programmed"))
    models = level_models(rows, "value", rates)
    seen = rows.join(models.select("series", "low"), "series").select("series", "idx", "programmed", "low", (F.col("programmed") - F.col("low")).cast("double").alias("seen") if rates else F.col("value").alias("seen"))
    found = paths(seen, models, "seen", "poisson" if rates else "normal", size)
    return seen.join(found, ["series", "idx"]).select("series", "idx", "programmed", (F.col("viterbi") + F.col("low")).alias("smooth"))


#: Units of power of the sources (fixed values).
UNITS = {"diesel": 1.02, "demand": 1.0, "wind": 1.0, "turbine": 1.0, "pump": 0.5}


def programmed_power(df: DataFrame, rates: bool = True) -> DataFrame:
    """(series, idx, source, programmed, smooth) of wide rows (series, idx, diesel, demand, wind, hydro): hydro is split into turbine and pump first."""
    parts = {"turbine": F.greatest("hydro", F.lit(0.0)), "pump": F.greatest(-F.col("hydro"), F.lit(0.0)), **{c: F.col(c) for c in ("diesel", "demand", "wind")}}
    out = None
    for source, value in parts.items():
        one = smoothed_power(df.select(F.concat_ws("|", "series", F.lit(source)).alias("series"), "idx", value.alias("value")), UNITS[source], rates=rates)
        out = one if out is None else out.unionByName(one)
    name = F.split("series", r"\|")
    return out.select(F.get(name, F.lit(0)).alias("series"), "idx", F.get(name, F.lit(1)).alias("source"), "programmed", "smooth")


def decoded(df: DataFrame, codes: list[int], value: str = "value", state: str = "state", size: int = BLOCK) -> DataFrame:
    """(series, idx, state, viterbi, posterior): a model of a series' own labels, by grouped counts, and the states that it finds, in blocks."""
    found = paths(df, parameters(df, codes, value, state), value, "normal", size)
    code = lambda c: F.element_at(F.array(*map(F.lit, codes)), F.col(c) + 1).alias(c)
    return df.select("series", "idx", F.col(state).alias("state")).join(found, ["series", "idx"]).select("series", "idx", "state", code("viterbi"), code("posterior"))
