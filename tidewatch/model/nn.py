"""The sequence and graph model in numpy, with reverse-mode gradients.

One forward pass serves batch scoring, streaming and training.  ``Var`` records
operations only while a parameter asks for gradients.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np

from tidewatch import config

N_FEATURES = len(config.FEATURES)
_erf = np.vectorize(math.erf, otypes=[float])


class Var:
    """An array with the operations that made it."""

    __array_priority__ = 100

    def __init__(self, value, parents=(), wants: bool = False):
        self.value = np.asarray(value, dtype=float)
        self.parents = parents if any(p.wants for p, _ in parents) else ()
        self.wants = wants or bool(self.parents)
        self.grad = None

    @property
    def shape(self):
        return self.value.shape

    def _unary(self, value, slope):
        return Var(value, ((self, lambda g: g * slope),))

    def __add__(self, other):
        other = as_var(other)
        return Var(self.value + other.value, ((self, lambda g: _fit(g, self.shape)), (other, lambda g: _fit(g, other.shape))))

    def __mul__(self, other):
        other = as_var(other)
        return Var(self.value * other.value, ((self, lambda g: _fit(g * other.value, self.shape)), (other, lambda g: _fit(g * self.value, other.shape))))

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + -as_var(other)

    def __rsub__(self, other):
        return as_var(other) - self

    def __truediv__(self, other):
        return self * as_var(other) ** -1.0

    def __pow__(self, power: float):
        return self._unary(self.value**power, power * self.value ** (power - 1))

    def __matmul__(self, other):
        other = as_var(other)
        a, b = self.value, other.value
        return Var(a @ b, ((self, lambda g: _fit(g @ np.swapaxes(b, -1, -2), a.shape)), (other, lambda g: _fit(np.swapaxes(a, -1, -2) @ g, b.shape))))

    def sum(self, axis=None, keepdims=False):
        def spread(g):
            g = g if keepdims or axis is None else np.expand_dims(g, axis)
            return np.broadcast_to(g, self.shape)

        return Var(self.value.sum(axis=axis, keepdims=keepdims), ((self, spread),))

    def mean(self, axis, keepdims=False):
        return self.sum(axis, keepdims) * (1.0 / self.shape[axis])

    def reshape(self, *shape):
        return Var(self.value.reshape(shape), ((self, lambda g: g.reshape(self.shape)),))

    def expand(self, axis):
        return Var(np.expand_dims(self.value, axis), ((self, lambda g: np.squeeze(g, axis)),))

    def exp(self):
        e = np.exp(self.value)
        return self._unary(e, e)

    def tanh(self):
        t = np.tanh(self.value)
        return self._unary(t, 1 - t * t)

    def sigmoid(self):
        s = sigmoid(self.value)
        return self._unary(s, s * (1 - s))

    def softplus(self):
        return self._unary(np.logaddexp(0.0, self.value), sigmoid(self.value))

    def at_most(self, top: float):
        return self._unary(np.minimum(self.value, top), (self.value <= top).astype(float))

    def gelu(self):
        cdf = 0.5 * (1 + _erf(self.value / math.sqrt(2)))
        return self._unary(self.value * cdf, cdf + self.value * np.exp(-0.5 * self.value**2) / math.sqrt(2 * math.pi))

    def backward(self):
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack.extend((p, False) for p, _ in node.parents)
        self.grad = np.ones(self.shape)
        for node in reversed(order):
            for parent, pull in node.parents:
                if parent.wants:
                    g = pull(node.grad)
                    parent.grad = g if parent.grad is None else parent.grad + g


def _fit(g, shape):
    """Sum a gradient over the axes along which its operand was broadcast."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for axis, size in enumerate(shape):
        if size == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


def as_var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def sigmoid(x):
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def join(a: Var, b: Var) -> Var:
    n = a.shape[-1]
    return Var(np.concatenate([a.value, b.value], -1), ((a, lambda g: g[..., :n]), (b, lambda g: g[..., n:])))


def masked_max(x: Var, keep: np.ndarray, axis: int) -> Var:
    """Maximum over ``axis`` of what is kept; zero where nothing is."""
    filled = np.where(keep > 0, x.value, -np.inf)
    at = np.expand_dims(filled.argmax(axis), axis)
    top = np.squeeze(np.take_along_axis(filled, at, axis), axis)
    real = np.isfinite(top)

    def pull(g):
        out = np.zeros(x.shape)
        np.put_along_axis(out, at, np.expand_dims(np.where(real, g, 0.0), axis), axis)
        return out

    return Var(np.where(real, top, 0.0), ((x, pull),))


class Pairs:
    """A square matrix [n, n] as its filled cells (src, dst, weight); ``@`` takes node states [b, n, h].

    Time and memory go with the cells, not with n * n.
    """

    def __init__(self, n: int, src, dst, weight):
        order = np.argsort(src, kind="stable")
        self.n, self.src, self.dst, self.weight = n, np.asarray(src)[order], np.asarray(dst)[order], np.asarray(weight, dtype=float)[order]
        self.rows, self.starts = np.unique(self.src, return_index=True)

    def _sums(self, values):
        out = np.zeros(values.shape)
        if len(self.rows):
            for i, part in enumerate(values):  # one batch at a time: the expanded cells are the largest array here
                out[i, self.rows] = np.add.reduceat(self.weight[:, None] * part[self.dst], self.starts, axis=0)
        return out

    def __matmul__(self, nodes: Var) -> Var:
        turned = Pairs(self.n, self.dst, self.src, self.weight) if nodes.wants else None
        return Var(self._sums(nodes.value), ((nodes, lambda g: turned._sums(g)),))


@dataclass(frozen=True)
class Spec:
    hidden: int = 24
    state: int = 6
    use_sequence: bool = True
    use_graph: bool = True
    pooling: str = "attention"
    time_mode: str = "time_aware"
    half_life: float | None = None

    def __post_init__(self) -> None:
        if self.pooling not in ("attention", "uniform"):
            raise ValueError(f"unknown pooling mode: {self.pooling}")
        if self.time_mode not in ("global", "per_entity", "time_aware"):
            raise ValueError(f"unknown time_mode: {self.time_mode}")
        if self.half_life is not None and self.half_life <= 0:
            raise ValueError("half_life must be positive or None")


#: The five arms of the ablation.
VARIANTS = {
    "static_baseline": {"use_sequence": False, "use_graph": False},
    "s6_only": {"use_graph": False},
    "gnn_only": {"use_sequence": False},
    "s6_gnn": {},
    "s6_gnn_uniform_pool": {"pooling": "uniform"},
}


class Model:
    """Weights and passes of the campaign model."""

    def __init__(self, spec: Spec | None = None, seed: int = 7):
        self.spec = spec or Spec()
        self.temperature, self.bias = 1.0, 0.0
        self.feature_stats: dict | None = None
        self.version = "development"
        rng = np.random.default_rng(seed)
        h, s = self.spec.hidden, self.spec.state
        self.w: dict[str, Var] = {}

        def linear(name, inputs, outputs, bias=True):
            bound = 1 / math.sqrt(inputs)
            self.w[name] = Var(rng.uniform(-bound, bound, (inputs, outputs)), wants=True)
            if bias:
                self.w[name + ".b"] = Var(rng.uniform(-bound, bound, outputs), wants=True)

        def norm(name):
            self.w[name + ".g"], self.w[name + ".b"] = Var(np.ones(h), wants=True), Var(np.zeros(h), wants=True)

        if self.spec.use_sequence:
            linear("in", N_FEATURES, h)
            linear("delta", h, h)
            linear("B", h, h * s, bias=False)
            linear("C", h, h * s, bias=False)
            self.w["a_log"] = Var(np.log(np.tile(np.arange(1, s + 1, dtype=float), (h, 1))), wants=True)
            self.w["skip"] = Var(np.ones(h), wants=True)
            if self.spec.time_mode == "time_aware":
                self.w["time"] = Var(np.zeros(1), wants=True)
            norm("seq")
        else:
            linear("static", 2 * N_FEATURES, h)
            norm("static_n")
        if self.spec.use_graph:
            for i in range(2):
                linear(f"self{i}", h, h)
                linear(f"near{i}", h, h)
                norm(f"graph{i}")
        for name, outputs in (("value", h), ("gate", h), ("score", 1)) if self.spec.pooling == "attention" else (("node", 1),):
            linear(name, h, outputs)
        linear("head0", 2 * h, h)
        linear("head1", h, 1)

    def _lin(self, name, x):
        out = x @ self.w[name]
        return out + self.w[name + ".b"] if name + ".b" in self.w else out

    def _norm(self, name, x):
        centred = x - x.mean(-1, True)
        return centred * ((centred * centred).mean(-1, True) + 1e-5) ** -0.5 * self.w[name + ".g"] + self.w[name + ".b"]

    def step(self, u, state, output, active, gap):
        """Advance the recurrence by one projected row: u [n, h], state [n, h, s], active [n, 1], gap [n] or None."""
        h, s = self.spec.hidden, self.spec.state
        pre = self._lin("delta", u)
        if gap is not None and "time" in self.w:
            pre = pre + self.w["time"] * np.asarray(gap)[:, None]
        delta = pre.softplus().at_most(5.0).expand(-1)
        moved = (delta * -self.w["a_log"].exp()).exp() * state + delta * self._lin("B", u).reshape(-1, h, s) * u.expand(-1)
        on = active[..., None]
        state = moved * on + state * (1 - on)
        out = (self._lin("C", u).reshape(-1, h, s) * state).sum(-1) + self.w["skip"] * u
        return state, out * active + output * (1 - active)

    def start(self, n):
        return Var(np.zeros((n, self.spec.hidden, self.spec.state))), Var(np.zeros((n, self.spec.hidden)))

    def project(self, x):
        return self._lin("in", as_var(x))

    def encode(self, x, mask, gaps):
        """Node states [n, h] of histories x [n, t, f], mask [n, t], gaps [n, t]."""
        if not self.spec.use_sequence:
            keep = mask[..., None]
            mean = (x * keep).sum(1) / np.maximum(keep.sum(1), 1)
            top = masked_max(Var(x), keep, 1).value
            return self._norm("static_n", self._lin("static", Var(np.concatenate([mean, top], -1))).gelu())
        state, output = self.start(len(x))
        for t in range(x.shape[1]):
            if mask[:, t].any():
                state, output = self.step(self.project(x[:, t]), state, output, mask[:, t : t + 1], gaps[:, t])
        return self._norm("seq", output)

    def relate(self, nodes, active, adjacency):
        """(graph logits [b], node logits [b, n]) of node states [b, n, h], active [b, n], adjacency [b, n, n] or ``Pairs``."""
        if not isinstance(adjacency, Pairs):
            adjacency = as_var(adjacency)
        if self.spec.use_graph:
            for i in range(2):
                near = adjacency @ nodes
                nodes = self._norm(f"graph{i}", nodes + (self._lin(f"self{i}", nodes) + self._lin(f"near{i}", near)).gelu())
        on = active[..., None]
        mean = (nodes * on).sum(1) * (1 / np.maximum(on.sum(1), 1))
        if self.spec.pooling == "attention":
            logits = self._lin("score", self._lin("value", nodes).tanh() * self._lin("gate", nodes).sigmoid())
            high = np.where(on > 0, logits.value, -np.inf).max(1, keepdims=True)
            weight = (logits - np.where(np.isfinite(high), high, 0.0)).at_most(50.0).exp() * on
            pooled = (weight * nodes).sum(1) / (weight.sum(1) + 1e-300)
        else:
            logits = self._lin("node", nodes)
            pooled = masked_max(nodes, np.broadcast_to(on, nodes.shape), 1)
        graph = self._lin("head1", self._lin("head0", join(mean, pooled)).gelu())
        return graph.reshape(-1), logits.reshape(*active.shape)

    def forward(self, x, mask, adjacency, gaps):
        """(graph logits, node logits) of batches x [b, n, t, f], mask and gaps [b, n, t], adjacency [b, n, n]."""
        b, n, t, f = x.shape
        nodes = self.encode(x.reshape(b * n, t, f), mask.reshape(b * n, t), gaps.reshape(b * n, t))
        return self.relate(nodes.reshape(b, n, self.spec.hidden), (mask.sum(-1) > 0).astype(float), adjacency)

    def probability(self, logits):
        return sigmoid(np.asarray(logits) / max(self.temperature, 1e-3) + self.bias)

    def calibration(self) -> str:
        if self.temperature == 1.0 and self.bias == 0.0:
            return "none"
        return f"affine:scale={1 / self.temperature:.6f},bias={self.bias:.6f}"

    def freeze(self) -> Model:
        """Stop recording; for scoring."""
        for v in self.w.values():
            v.wants = False
        return self

    def save(self, folder: str | Path) -> None:
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        np.savez(folder / "weights.npz", **{k: v.value for k, v in self.w.items()})
        manifest = {
            "engine_version": config.ENGINE_VERSION, "model_version": self.version, "feature_schema_hash": config.schema_hash(), "spec": asdict(self.spec),
            "calibration": {"temperature": self.temperature, "bias": self.bias, "label": self.calibration()}, "feature_stats": self.feature_stats,
            "scoring": {"top_k_default": config.DEFAULTS["scoring.top_k"], "evidence_limit": config.EVIDENCE_LIMIT},
        }
        (folder / "manifest.json").write_text(json.dumps(manifest, indent=2) + "\n")

    @classmethod
    def load(cls, folder: str | Path) -> Model:
        """A saved model; one of another feature layout is refused."""
        manifest = json.loads((Path(folder) / "manifest.json").read_text())
        if manifest["feature_schema_hash"] != config.schema_hash():
            raise ValueError("the model was made for another feature layout")
        model = cls(Spec(**manifest["spec"]))
        with np.load(Path(folder) / "weights.npz") as arrays:
            if set(arrays) != set(model.w):
                raise ValueError("weights do not fit the manifest")
            for name in arrays:
                model.w[name] = Var(arrays[name], wants=True)
        model.temperature, model.bias = manifest["calibration"]["temperature"], manifest["calibration"]["bias"]
        model.feature_stats, model.version = manifest["feature_stats"], manifest["model_version"]
        return model
