"""Small networks for one-step forecasts from lags: dense, convolutional and recurrent ones, their training, saving and use."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dense:
    """Weighted sums of the last axis, cut at zero if relu."""

    def __init__(self, inputs: int, units: int, relu: bool, rng: np.random.Generator):
        self.params = [rng.normal(size=(inputs, units)) * np.sqrt(2 / inputs), np.zeros(units)]
        self.relu = relu

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x
        z = x @ self.params[0] + self.params[1]
        self.y = np.maximum(z, 0) if self.relu else z
        return self.y

    def backward(self, g: np.ndarray) -> np.ndarray:
        g = g * (self.y > 0) if self.relu else g
        flat = self.x.reshape(-1, self.x.shape[-1])
        self.grads = [flat.T @ g.reshape(-1, g.shape[-1]), g.reshape(-1, g.shape[-1]).sum(0)]
        return g @ self.params[0].T


class Convolution(Dense):
    """A dense layer over windows of some steps of (batch, step, feature)."""

    def __init__(self, features: int, filters: int, width: int, rng: np.random.Generator):
        super().__init__(features * width, filters, True, rng)
        self.width = width

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.steps = x.shape[1]
        return super().forward(np.concatenate([x[:, i : self.steps - self.width + 1 + i] for i in range(self.width)], 2))

    def backward(self, g: np.ndarray) -> np.ndarray:
        back = np.split(super().backward(g), self.width, 2)
        out = np.zeros((g.shape[0], self.steps, back[0].shape[2]))
        for i, part in enumerate(back):
            out[:, i : self.steps - self.width + 1 + i] += part
        return out


class Pool:
    """The larger of each two steps; an odd last step is left out."""

    params: list = []
    grads: list = []

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.shape = x.shape
        pairs = x[:, : x.shape[1] // 2 * 2].reshape(x.shape[0], -1, 2, x.shape[2])
        self.first = pairs[:, :, 0] >= pairs[:, :, 1]
        return pairs.max(2)

    def backward(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape)
        out[:, 0 : 2 * g.shape[1] : 2], out[:, 1 : 2 * g.shape[1] : 2] = g * self.first, g * ~self.first
        return out


class Flatten:
    params: list = []
    grads: list = []

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.shape = x.shape
        return x.reshape(len(x), -1)

    def backward(self, g: np.ndarray) -> np.ndarray:
        return g.reshape(self.shape)


class Drop:
    """Leaves out a share of the values in training."""

    params: list = []
    grads: list = []

    def __init__(self, share: float, rng: np.random.Generator):
        self.share, self.rng, self.training = share, rng, False

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.mask = (self.rng.random(x.shape) >= self.share) / (1 - self.share) if self.training else 1.0
        return x * self.mask

    def backward(self, g: np.ndarray) -> np.ndarray:
        return g * self.mask


class Recurrent:
    """Long short-term memory with relu in place of tanh; gives its last state, or all of them."""

    def __init__(self, features: int, units: int, rng: np.random.Generator, every: bool = False, reverse: bool = False):
        self.units, self.every, self.reverse = units, every, reverse
        bias = np.zeros(4 * units)
        bias[units : 2 * units] = 1
        self.params = [rng.normal(size=(features, 4 * units)) / np.sqrt(features + units), rng.normal(size=(units, 4 * units)) / np.sqrt(features + units) * 0.5, bias]

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x[:, ::-1] if self.reverse else x
        w, u, b = self.params
        h = c = np.zeros((len(x), self.units))
        self.steps, out = [], []
        for t in range(x.shape[1]):
            z = np.clip(self.x[:, t] @ w + h @ u + b, -30, 30)
            i, f, o = (1 / (1 + np.exp(-z[:, k * self.units : (k + 1) * self.units])) for k in (0, 1, 3))
            g = np.maximum(z[:, 2 * self.units : 3 * self.units], 0)
            before, c = (h, c), f * c + i * g
            h = o * np.maximum(c, 0)
            self.steps.append((*before, i, f, g, o, c))
            out.append(h)
        return np.stack(out, 1) if self.every else h

    def backward(self, g: np.ndarray) -> np.ndarray:
        w, u, _ = self.params
        self.grads = [np.zeros_like(p) for p in self.params]
        dh = dc = np.zeros((len(self.x), self.units))
        dx = np.zeros(self.x.shape)
        for t in range(len(self.steps) - 1, -1, -1):
            h0, c0, i, f, a, o, c = self.steps[t]
            dh = dh + (g[:, t] if self.every else g if t == len(self.steps) - 1 else 0)
            dc = dc + dh * o * (c > 0)
            dz = np.concatenate([dc * a * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (a > 0), dh * np.maximum(c, 0) * o * (1 - o)], 1)
            self.grads[0] += self.x[:, t].T @ dz
            self.grads[1] += h0.T @ dz
            self.grads[2] += dz.sum(0)
            dx[:, t], dh, dc = dz @ w.T, dz @ u.T, dc * f
        return dx[:, ::-1] if self.reverse else dx


class Both:
    """Two recurrent layers, one of them from the end, side by side."""

    def __init__(self, features: int, units: int, rng: np.random.Generator):
        self.sides = [Recurrent(features, units, rng), Recurrent(features, units, rng, reverse=True)]
        self.params = [p for s in self.sides for p in s.params]

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([s.forward(x) for s in self.sides], 1)

    def backward(self, g: np.ndarray) -> np.ndarray:
        n = g.shape[1] // 2
        dx = self.sides[0].backward(g[:, :n]) + self.sides[1].backward(g[:, n:])
        self.grads = [p for s in self.sides for p in s.grads]
        return dx


#: The networks by name: layers in order as (kind, settings) (fixed values).
SHAPES: dict[str, list[tuple[str, dict]]] = {
    "mlp_1": [("flatten", {}), ("dense", {"units": 16}), ("drop", {"share": 0.2}), ("dense", {"units": 32}), ("drop", {"share": 0.2}), ("dense", {"units": 1, "relu": False})],
    "mlp_2": [("flatten", {}), ("dense", {"units": 16}), ("drop", {"share": 0.2}), ("dense", {"units": 32}), ("dense", {"units": 16}), ("dense", {"units": 1, "relu": False})],
    "univar_cnn": [("convolution", {"filters": 64, "width": 2}), ("pool", {}), ("flatten", {}), ("dense", {"units": 50}), ("dense", {"units": 1, "relu": False})],
    "vanilla_lstm": [("recurrent", {"units": 32}), ("dense", {"units": 1, "relu": False})],
    "stacked_lstm": [("recurrent", {"units": 32, "every": True}), ("recurrent", {"units": 32}), ("dense", {"units": 1, "relu": False})],
    "bidir_lstm": [("both", {"units": 32}), ("dense", {"units": 1, "relu": False})],
    "cnn_lstm": [("convolution", {"filters": 64, "width": 1}), ("pool", {}), ("recurrent", {"units": 32}), ("dense", {"units": 1, "relu": False})],
}
#: The configured set: networks, and two ARIMA models (fixed values).
MODELS = ("mlp_1", "mlp_2", "univar_cnn", "vanilla_lstm", "stacked_lstm", "bidir_lstm", "seasonal_arima", "best_arima")


def patched(shape: list[tuple[str, dict]], layer: int, key: str, value) -> list[tuple[str, dict]]:
    """The shape with one setting of one layer changed."""
    return [(kind, {**settings, key: value} if i == layer else dict(settings)) for i, (kind, settings) in enumerate(shape)]


class Network:
    """Layers in order for inputs (batch, lag); trained by Adam on mean squared errors."""

    def __init__(self, shape: list[tuple[str, dict]], lags: int, seed: int = 0):
        self.shape, self.lags, rng = shape, lags, np.random.default_rng(seed)
        self.layers, size = [], (lags, 1)
        for kind, s in shape:
            if kind == "flatten":
                layer, size = Flatten(), (size[0] * size[1],) if len(size) == 2 else size
            elif kind == "dense":
                layer, size = Dense(size[-1], s["units"], s.get("relu", True), rng), (*size[:-1], s["units"])
            elif kind == "drop":
                layer = Drop(s["share"], rng)
            elif kind == "convolution":
                layer, size = Convolution(size[1], s["filters"], s["width"], rng), (size[0] - s["width"] + 1, s["filters"])
            elif kind == "pool":
                layer, size = Pool(), (size[0] // 2, size[1])
            elif kind == "recurrent":
                layer, size = Recurrent(size[1], s["units"], rng, s.get("every", False)), (size[0], s["units"]) if s.get("every") else (s["units"],)
            else:
                layer, size = Both(size[1], s["units"], rng), (2 * s["units"],)
            self.layers.append(layer)

    def _run(self, x: np.ndarray, training: bool = False) -> np.ndarray:
        y = x[:, :, None]
        for layer in self.layers:
            if isinstance(layer, Drop):
                layer.training = training
            y = layer.forward(y)
        return y[:, 0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._run(x)

    def loss_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        error = self._run(x, True) - y
        g = (2 * error / len(y))[:, None]
        for layer in self.layers[::-1]:
            g = layer.backward(g)
        return float((error**2).mean()), [p for layer in self.layers for p in layer.grads]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 2e-3, seed: int = 1) -> Network:
        rng, step = np.random.default_rng(seed), 0
        params = [p for layer in self.layers for p in layer.params]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                i = order[low : low + batch]
                _, grads = self.loss_gradients(x[i], y[i])
                norm = np.sqrt(sum((g * g).sum() for g in grads))
                step += 1
                for p, g, a, c in zip(params, grads, m, v, strict=True):
                    g = g / max(1.0, norm)
                    a += 0.1 * (g - a)
                    c += 0.001 * (g * g - c)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
        return self

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        params = [p for layer in self.layers for p in layer.params]
        np.savez(f, shape=np.frombuffer(json.dumps([self.shape, self.lags]).encode(), np.uint8), **{f"p{i}": p for i, p in enumerate(params)})
        return f.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Network:
        got = np.load(io.BytesIO(raw), allow_pickle=False)
        shape, lags = json.loads(got["shape"].tobytes())
        out = cls([tuple(x) for x in shape], lags)
        for i, p in enumerate(p for layer in out.layers for p in layer.params):
            p[...] = got[f"p{i}"]
        return out


def ordered_batches(rows: DataFrame, share: float = 0.8, window: int = 64, batch: int = 32, seed: int = 0) -> DataFrame:
    """Adds train, the first share of each series by idx, and batch: rows shuffled within runs of a window, dealt in turn."""
    ends = rows.groupBy("series").agg((F.max("idx") + 1).alias("_n"))
    at = F.floor(F.col("idx") / window)
    place = F.pmod(F.xxhash64("series", "idx", F.lit(seed)), F.lit(window))
    return rows.join(ends, "series").withColumns({"train": F.col("idx") < F.floor(F.col("_n") * share), "batch": (at * window + place).cast("long")}).withColumn("batch", F.floor(F.col("batch") / batch)).drop("_n")


def trained(df: DataFrame, names: tuple[str, ...] = MODELS, lags: int = 24, epochs: int = 5, period: int = 24) -> DataFrame:
    """(series, model, content): every model of the set for every series, one fit for each task row; content loads without code.

    A series and its copies for each model are bounded by what the caller keeps of its history.
    """
    from tidewright.operators import forecast

    each = df.select("series", "idx", "value").withColumn("model", F.explode(F.array(*map(F.lit, names))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, name = pdf.sort_values("idx")["value"].to_numpy(float), pdf["model"].iloc[0]
        if name in SHAPES:
            low, span = x.min(), max(np.ptp(x), 1e-9)
            rows = np.lib.stride_tricks.sliding_window_view((x - low) / span, lags + 1)
            raw = json.dumps({"low": low, "span": span}).encode() + b"\n" + Network(SHAPES[name], lags).fit(rows[:, :-1], rows[:, -1], epochs).to_bytes()
        else:
            seasonal = ((1, 0, 1), period) if name == "seasonal_arima" else ((0, 0, 0), 0)
            orders = [(p, d, q) for p in range(3) for d in range(2) for q in range(2)] if name == "best_arima" else [(1, 0, 0)]
            fits = [(forecast.fit_arima(x, o, *seasonal)) for o in orders]
            best = min(fits, key=lambda f: f[0])[1]
            raw = json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in best.items()}).encode()
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "model": [name], "content": [raw]})

    return each.groupBy("series", "model").applyInPandas(run, "series string, model string, content binary")


def forecasts(history: DataFrame, models: DataFrame, steps: int = 4) -> DataFrame:
    """(series, model, horizon, forecast): saved models applied to the end of each series, each forecast being the next one's last lag."""
    from tidewright.operators import forecast

    joined = history.select("series", "idx", "value").join(models.select("series", "model", "content"), "series")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf.sort_values("idx")
        x, name, raw = ready["value"].to_numpy(float), ready["model"].iloc[0], ready["content"].iloc[0]
        if name in SHAPES:
            head, _, body = raw.partition(b"\n")
            scale, net = json.loads(head), Network.from_bytes(body)
            past = list((x - scale["low"]) / scale["span"])
            for _ in range(steps):
                past.append(float(net.predict(np.array([past[-net.lags :]]))[0]))
            y = np.array(past[len(x) :]) * scale["span"] + scale["low"]
        else:
            model = json.loads(raw)
            model = {k: np.array(v) if k in ("b", "resid") else tuple(v) if isinstance(v, list) else v for k, v in model.items()}
            y = forecast.forecast_arima(x, forecast.refreshed(x, model), steps)
        return pd.DataFrame({"series": ready["series"].iloc[0], "model": name, "horizon": np.arange(1, steps + 1), "forecast": y})

    return joined.groupBy("series", "model").applyInPandas(run, "series string, model string, horizon int, forecast double")
