"""A traffic manager for generators: meters imbalance, colours requests, queues them by priority and spends token credit."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Power of each state by kind of device (fixed values).
STEPS = {"diesel": (0.0, 0.3, 0.6, 1.0), "turbine": (0.0, 0.9), "pump": (0.0, 0.5)}
COLOURS = ("green", "orange", "red", "none")


@dataclass
class Device:
    name: str
    kind: str
    state: int = 0
    times: dict[int, int] = field(default_factory=dict)

    def power(self) -> float:
        return STEPS[self.kind][self.state] * (-1 if self.kind == "pump" else 1)


def credit_tokens(kind: str, state: int, power: float, step: float = 0.1) -> tuple[int, int]:
    """(up, down): tokens of power that a device may still take on or give up.

    A pump, and a turbine the other way round, only moves from its first state and from its last one; a diesel moves between neighbouring states.
    """
    table = STEPS[kind]
    last = len(table) - 1
    if kind == "diesel":
        above = table[min(state + 1, last)]
        below = table[max(state - 1, 0)]
        return int((above - power) / step + 1e-9), -int(-(power - below) / step - 1e-9) if state else 0
    off = int((table[min(state + 1, last)] - power) / step + 1e-9) if state == 0 else 0
    on = int((power - table[0]) / step + 1e-9) if state == last else 0
    return (on, off) if kind == "pump" else (off, on)


def fleet(counts: dict[str, int], models: dict[str, list[str]]) -> list[Device]:
    """Devices of each kind, their models in turn."""
    return [Device(f"{models[kind][i % len(models[kind])]}-{i}", kind) for kind, n in counts.items() for i in range(n)]


def imbalance_range(value: float) -> int:
    """0 to 3 by the imbalance at 0.5, 0 and -0.5."""
    return 0 if value >= 0.5 else 1 if value >= 0 else 2 if value >= -0.5 else 3


def pump_enabled(ahead: tuple[float, float, float]) -> bool:
    return ahead[0] >= 0.5 and ahead[1] > 0 and ahead[2] > 0


def simulated(seed: int, steps: int = 128) -> list[tuple[int, float, float, str, str, int]]:
    """(step, imbalance, credit left, device, colour, new state) of each request that is granted."""
    rng = np.random.default_rng(seed)
    devices = [Device(f"diesel{i}", "diesel") for i in range(4)] + [Device(f"turbine{i}", "turbine") for i in range(2)] + [Device(f"pump{i}", "pump") for i in range(4)]
    ahead, out = list(rng.normal(0, 1, 3)), []
    for t in range(steps):
        want = ahead[0]
        credit = want - sum(d.power() for d in devices) * 0.1
        queue = []
        for i, d in enumerate(devices):
            up = credit < 0 if d.kind != "pump" else credit > 0
            state = d.state + (1 if up else -1)
            if 0 <= state < len(STEPS[d.kind]):
                colour = "red" if d.kind == "pump" and not pump_enabled(tuple(ahead)) else "green"
                queue.append((COLOURS.index(colour), i if d.kind != "pump" else i + 100, d, state))
        for colour, _, d, state in sorted(queue, key=lambda q: q[:2]):
            step = abs(STEPS[d.kind][state] - STEPS[d.kind][d.state])
            if COLOURS[colour] == "red" or abs(credit) < step:
                continue
            credit -= np.sign(credit) * step
            d.state = state
            out.append((t, float(want), float(credit), d.name, COLOURS[colour], state))
        for d in devices:
            d.times[d.state] = d.times.get(d.state, 0) + 1
        ahead = [*ahead[1:], float(rng.normal(0, 1))]
    return out


def simulations(spark: SparkSession, seeds: int, steps: int = 128) -> DataFrame:
    """Independent simulations, one for each seed, spread over the tasks."""

    def run(batches):
        for pdf in batches:
            rows = [(int(s), *r) for s in pdf["id"] for r in simulated(int(s), steps)]
            yield pd.DataFrame(rows, columns=["seed", "step", "imbalance", "credit", "device", "colour", "state"])

    return spark.range(seeds).mapInPandas(run, "seed long, step int, imbalance double, credit double, device string, colour string, state int")
