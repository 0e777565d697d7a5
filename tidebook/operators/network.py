"""The graph network over windows of a split: a causal encoder a node, attention over the window's edges, a trunk and a
head a horizon; its gradients, and its training by averaging the partitions' weights after each epoch. The encoder
norms each time's channels, as statistics of a batch would differ between partitions.

Weights are a flat vector, whose size depends on the network's shape alone, never on the data: the only thing that is
broadcast, and the only thing that comes back to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import cos, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.graph import ATTRIBUTES
from tidebook.sources.cache import written

#: How much a horizon counts in the loss, before division by their mean.
HORIZON_WEIGHTS = (0.4, 0.4, 0.7, 1.0, 1.0, 1.0, 1.0)
#: Dilations of the encoder's convolutions, their taps, and the number of relations.
DILATIONS, TAPS, RELATIONS = (1, 2, 4, 8), 3, 7


class Value:
    """An array and how its gradient flows back to the arrays that it was made of."""

    def __init__(self, data: np.ndarray, back: Sequence[tuple[Value, object]] = ()):
        self.data, self.back, self.grad = data, back, None

    def __add__(self, other: Value) -> Value:
        return Value(self.data + other.data, [(self, lambda g: _fold(g, self.data.shape)), (other, lambda g: _fold(g, other.data.shape))])

    def __mul__(self, other: Value) -> Value:
        return Value(self.data * other.data, [(self, lambda g: _fold(g * other.data, self.data.shape)), (other, lambda g: _fold(g * self.data, other.data.shape))])

    def __matmul__(self, other: Value) -> Value:
        """Over the last axis of self and the first of a matrix."""
        n = self.data.shape[-1]
        return Value(self.data @ other.data, [(self, lambda g: g @ other.data.T), (other, lambda g: self.data.reshape(-1, n).T @ g.reshape(-1, g.shape[-1]))])

    def map(self, value: np.ndarray, slope: np.ndarray) -> Value:
        return Value(value, [(self, lambda g: g * slope)])

    def rows(self, at: np.ndarray) -> Value:
        return Value(self.data[at], [(self, lambda g: _gathered(g, at, len(self.data)))])

    def sums(self, to: np.ndarray, n: int) -> Value:
        """Rows summed by their group's number, of n."""
        return Value(_gathered(self.data, to, n), [(self, lambda g: g[to])])

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack.extend((u, False) for u, _ in v.back)
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            for u, flow in v.back:
                g = flow(v.grad)
                u.grad = g if u.grad is None else u.grad + g


def _fold(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(axis=wide, keepdims=True) if wide else g


def _gathered(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *rows.shape[1:]))
    np.add.at(out, to, rows)
    return out


def relu(x: Value, leak: float = 0.0) -> Value:
    slope = np.where(x.data > 0, 1.0, leak)
    return x.map(x.data * slope, slope)


def elu(x: Value) -> Value:
    low = np.exp(np.minimum(x.data, 0.0))
    return x.map(np.where(x.data > 0, x.data, low - 1.0), np.where(x.data > 0, 1.0, low))


def gelu(x: Value) -> Value:
    """By the tanh form."""
    c = np.sqrt(2.0 / pi)
    t = np.tanh(c * (x.data + 0.044715 * x.data**3))
    return x.map(0.5 * x.data * (1.0 + t), 0.5 * (1.0 + t) + 0.5 * x.data * (1.0 - t * t) * c * (1.0 + 3 * 0.044715 * x.data**2))


def normed(x: Value, gain: Value, shift: Value) -> Value:
    """Each row to mean 0 and deviation 1 over its channels, then scaled and moved."""
    mean = x.data.mean(axis=-1, keepdims=True)
    sd = np.sqrt(x.data.var(axis=-1, keepdims=True) + 1e-5)
    z = (x.data - mean) / sd
    unit = Value(z, [(x, lambda g: (g - g.mean(axis=-1, keepdims=True) - z * (g * z).mean(axis=-1, keepdims=True)) / sd)])
    return unit * gain + shift


def delayed(x: Value, by: int) -> Value:
    """(rows, time, channel) moved to later times, zeros before: no time sees a later one."""
    by = min(by, x.data.shape[1])

    def move(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        out[:, by:] = a[:, : a.shape[1] - by]
        return out

    def home(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(g)
        out[:, : g.shape[1] - by] = g[:, by:]
        return out

    return x if by == 0 else Value(move(x.data), [(x, home)])


@dataclass(frozen=True)
class Shape:
    """channels: of a node's row; horizons: heads; layers of attention, each with several heads, averaged."""

    channels: int
    hidden: int = 32
    horizons: int = 7
    heads: int = 4
    layers: int = 2

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, half = self.hidden, max(self.hidden // 2, 1)
        out: dict[str, tuple[int, ...]] = {"in.w": (self.channels, h), "in.b": (h,)}
        for d in DILATIONS:
            out |= {f"conv{d}.{j}": (h, h) for j in range(TAPS)} | {f"conv{d}.b": (h,), f"conv{d}.gain": (h,), f"conv{d}.shift": (h,)}
        out |= {"node.w": (h, h), "node.b": (h,)}
        for k in range(self.layers):
            for a in range(self.heads):
                out |= {f"att{k}.{a}.src": (h, h), f"att{k}.{a}.dst": (h, h), f"att{k}.{a}.edge": (len(ATTRIBUTES) + RELATIONS, h), f"att{k}.{a}.score": (h, 1)}
            out |= {f"att{k}.b": (h,), f"att{k}.gain": (h,), f"att{k}.shift": (h,)}
        out |= {"trunk.w": (h, h), "trunk.b": (h,)}
        for o in range(self.horizons):
            out |= {f"head{o}.w": (h, half), f"head{o}.b": (half,), f"head{o}.out": (half, 1), f"head{o}.c": (1,)}
        return out

    def first(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        draw = lambda name, dims: np.ones(dims) if name.endswith("gain") else np.zeros(dims) if len(dims) == 1 else rng.normal(size=dims) / np.sqrt(dims[0] * (TAPS if name.startswith("conv") else 1))
        return np.concatenate([draw(name, dims).ravel() for name, dims in self.parts().items()])

    def split(self, flat: np.ndarray) -> dict[str, Value]:
        out, at = {}, 0
        for name, dims in self.parts().items():
            size = int(np.prod(dims))
            out[name] = Value(flat[at : at + size].reshape(dims))
            at += size
        return out


def forward(shape: Shape, w: dict[str, Value], x: np.ndarray, src: np.ndarray, dst: np.ndarray, edge: np.ndarray, drop: np.random.Generator | None = None) -> Value:
    """(nodes, horizons) from x (nodes, time, channels) and edges; with ``drop`` some units are left out, as in training."""

    def thinned(v: Value, rate: float) -> Value:
        return v if drop is None else v * Value((drop.random(v.data.shape) >= rate) / (1.0 - rate))

    n = len(x)
    h = Value(x) @ w["in.w"] + w["in.b"]
    for d in DILATIONS:
        y = w[f"conv{d}.b"]
        for j in range(TAPS):
            y = delayed(h, j * d) @ w[f"conv{d}.{j}"] + y
        h = h + thinned(relu(normed(y, w[f"conv{d}.gain"], w[f"conv{d}.shift"])), 0.1)
    last = x.shape[1] - 1

    def spread(g: np.ndarray) -> np.ndarray:
        out = np.zeros((n, last + 1, shape.hidden))
        out[:, last] = g
        return out

    h = thinned(Value(h.data[:, last], [(h, spread)]) @ w["node.w"] + w["node.b"], 0.2)
    for k in range(shape.layers):
        total = w[f"att{k}.b"]
        for a in range(shape.heads):
            left, right = h @ w[f"att{k}.{a}.src"], h @ w[f"att{k}.{a}.dst"]
            sent = left.rows(src)
            score = relu(sent + right.rows(dst) + Value(edge) @ w[f"att{k}.{a}.edge"], 0.2) @ w[f"att{k}.{a}.score"]
            top = np.full((n, 1), -np.inf)
            np.maximum.at(top, dst, score.data)
            raised = np.exp(score.data - top[dst])
            power = score.map(raised, raised)
            whole = power.sums(dst, n).rows(dst)
            weight = thinned(power * whole.map(1.0 / whole.data, -1.0 / whole.data**2), 0.1)
            total = total + (weight * sent).sums(dst, n) * Value(np.array(1.0 / shape.heads))
        h = normed(h + elu(total), w[f"att{k}.gain"], w[f"att{k}.shift"])
    h = thinned(gelu(h @ w["trunk.w"] + w["trunk.b"]), 0.2)
    out = None
    for o in range(shape.horizons):
        one = gelu(h @ w[f"head{o}.w"] + w[f"head{o}.b"]) @ w[f"head{o}.out"] + w[f"head{o}.c"]
        place = Value(np.eye(shape.horizons)[o : o + 1])
        out = one @ place if out is None else out + one @ place
    return out


def loss_slope(p: np.ndarray, y: np.ndarray, valid: np.ndarray, group: np.ndarray, ic_weight: float = 0.5) -> tuple[float, np.ndarray]:
    """The cross-sectional loss and its slope by p. For each window with 3 valid nodes: values less their mean over
    the window's valid nodes, Huber loss (bound 1) less ``ic_weight`` times the cosine, weighted by horizon; then the
    mean over windows."""
    weight = np.resize(np.array(HORIZON_WEIGHTS), p.shape[1]) if p.shape[1] > len(HORIZON_WEIGHTS) else np.array(HORIZON_WEIGHTS[: p.shape[1]])
    weight = weight / weight.mean() / p.shape[1]
    total, slope, seen = 0.0, np.zeros_like(p), 0
    for g in np.unique(group):
        at = np.flatnonzero((group == g) & valid)
        if len(at) < 3:
            continue
        seen += 1
        a, b = p[at] - p[at].mean(axis=0), y[at] - y[at].mean(axis=0)
        e = a - b
        total += float(np.where(np.abs(e) <= 1.0, e * e / 2, np.abs(e) - 0.5).mean(axis=0) @ weight)
        d = np.clip(e, -1.0, 1.0) / len(at)
        na, nb = np.sqrt((a * a).sum(axis=0)), np.sqrt((b * b).sum(axis=0))
        den = na * nb + 1e-8
        c = (a * b).sum(axis=0) / den
        total -= ic_weight * float(c @ weight)
        d -= ic_weight * (b / den - c * nb / den * np.divide(a, na, out=np.zeros_like(a), where=na > 0))
        d *= weight
        slope[at] = d - d.mean(axis=0)
    return (total / seen, slope / seen) if seen else (0.0, slope)


def windows(panel: DataFrame, edges: DataFrame, channels: Sequence[str], targets: Sequence[str], seq: int) -> DataFrame:
    """(te, nodes, x, y, valid, src, dst, rel, edge): a row a window end, with the last ``seq`` rows of every node (time
    after time, node after node), its targets, and its edges. ``panel`` (ti, node, channels, targets, target_valid) has
    every node at every time. Null channels and targets are 0. Nodes meet by time before times meet by window."""
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    cell = F.struct(F.col("node"), F.array(*[number(c) for c in channels]).alias("v"), F.array(*[number(t) for t in targets]).alias("y"), F.coalesce("target_valid", F.lit(False)).alias("ok"))
    times = panel.select(F.col("ti").cast("long").alias("ti"), cell.alias("c")).groupBy("ti").agg(F.sort_array(F.collect_list("c")).alias("c"))
    times = times.select("ti", F.flatten("c.v").alias("v"), F.struct(F.col("c.node").alias("nodes"), F.flatten("c.y").alias("y"), F.col("c.ok").alias("valid")).alias("now"))
    reach = times.select("*", F.explode(F.sequence(F.col("ti"), F.col("ti") + seq - 1)).alias("te")).join(edges.select("te").distinct(), "te")
    per = reach.groupBy("te").agg(F.sort_array(F.collect_list(F.struct("ti", "v"))).alias("h"), F.max_by("now", "ti").alias("now"))
    per = per.select("te", "now.nodes", F.flatten(F.transform("h", lambda r: r["v"])).alias("x"), "now.y", "now.valid")
    own = edges.groupBy("te").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "rel", F.array(*ATTRIBUTES).alias("a")))).alias("e"))
    return per.join(own, "te").select("te", "nodes", "x", "y", "valid", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.col("e.rel").alias("rel"), F.flatten("e.a").alias("edge"))


def _batch(part: pd.DataFrame, shape: Shape) -> tuple[np.ndarray, ...]:
    """Block-diagonal arrays of several windows."""
    xs, ys, ok, src, dst, edge, group, at = [], [], [], [], [], [], [], 0
    for k, r in enumerate(part.itertuples(index=False)):
        n = len(r.nodes)
        place = {node: at + i for i, node in enumerate(r.nodes)}
        xs.append(np.asarray(r.x, float).reshape(-1, n, shape.channels).transpose(1, 0, 2))
        ys.append(np.asarray(r.y, float).reshape(n, -1))
        ok.append(np.asarray(r.valid, bool))
        src += [place[s] for s in r.src]
        dst += [place[d] for d in r.dst]
        edge.append(np.hstack([np.asarray(r.edge, float).reshape(len(r.src), -1), np.eye(RELATIONS)[np.asarray(r.rel, int)]]))
        group += [k] * n
        at += n
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(ok), np.array(src, int), np.array(dst, int), np.concatenate(edge), np.array(group)


def train(rows: DataFrame, shape: Shape, epochs: int = 3, batch: int = 16, rate: float = 1e-3, seed: int = 0, decay: float = 1e-5) -> np.ndarray | None:
    """Weights after ``epochs`` over ``rows`` (of ``windows``); None with fewer than ``batch`` of them.

    In an epoch each partition goes over its windows once, in an order of their hashes, in steps of ``batch``: gradient
    cut to norm 1, adaptive moments, decoupled decay, a rate falling along a cosine from epoch to epoch. Partitions start
    from the same weights and moments, and the mean by windows of what they end with opens the next epoch."""
    rows = written(rows.repartition(F.xxhash64("te", F.lit(seed))), "windows")
    if rows.limit(batch).count() < batch:
        return None
    size = len(shape.first(seed))
    state, step = np.concatenate([shape.first(seed), np.zeros(2 * size)]), 0.0
    for epoch in range(epochs):
        fall = rate * 0.5 * (1.0 + cos(pi * epoch / max(1, epochs)))

        def run(parts: Iterator[pd.DataFrame], state=state, step=step, fall=fall, epoch=epoch) -> Iterator[pd.DataFrame]:
            w, m, v = (a.copy() for a in np.split(state, 3))
            seen, t, drop = 0, step, np.random.default_rng((seed, epoch))
            for part in parts:
                for i in range(0, len(part), batch):
                    x, y, ok, src, dst, edge, group = _batch(part.iloc[i : i + batch], shape)
                    seen += min(batch, len(part) - i)
                    if ok.sum() < 3:
                        continue
                    named = shape.split(w)
                    out = forward(shape, named, x, src, dst, edge, drop)
                    _, slope = loss_slope(out.data, y, ok, group)
                    Value((out.data * slope).sum(), [(out, lambda g, s=slope: g * s)]).backward()
                    g = np.concatenate([(np.zeros(p.data.shape) if p.grad is None else p.grad).ravel() for p in named.values()])
                    g /= max(1.0, float(np.sqrt(g @ g)))
                    t += 1
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    w = w * (1.0 - fall * decay) - fall * (m / (1.0 - 0.9**t)) / (np.sqrt(v / (1.0 - 0.999**t)) + 1e-8)
            if seen:
                yield pd.DataFrame({"place": np.arange(3 * size + 1), "value": np.append(np.concatenate([w, m, v]), t), "n": seen})

        shuffled = rows.sortWithinPartitions(F.xxhash64("te", F.lit(seed), F.lit(epoch)))
        ends = shuffled.mapInPandas(run, "place long, value double, n long")
        mean = ends.groupBy("place").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")).orderBy("place")
        got = mean.toPandas()["value"].to_numpy()  # a value a weight and moment
        state, step = got[:-1], float(got[-1])
    return state[:size]


def predict(rows: DataFrame, shape: Shape, weights: np.ndarray) -> DataFrame:
    """(te, node, horizon, score) for every node of every window."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = shape.split(weights)
        for part in parts:
            for i in range(0, len(part), 16):
                some = part.iloc[i : i + 16]
                x, _, _, src, dst, edge, _ = _batch(some, shape)
                got = forward(shape, named, x, src, dst, edge).data
                te, node = np.repeat(some["te"].to_numpy(), some["nodes"].str.len()), np.concatenate(some["nodes"].to_numpy())
                yield pd.DataFrame({"te": np.repeat(te, shape.horizons), "node": np.repeat(node, shape.horizons), "horizon": np.tile(np.arange(shape.horizons), len(te)), "score": got.ravel()})

    return rows.mapInPandas(run, "te long, node string, horizon int, score double")
