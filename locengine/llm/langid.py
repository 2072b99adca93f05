"""Language ID by a bidirectional gated recurrent network over bytes.

Each text is cut into stretches of `STRETCH` bytes. Two recurrent layers read every stretch,
one forwards and one backwards; at each position their states give a distribution over the
learned languages. A document's probability is the geometric mean of those of its positions,
so that long documents count as a whole. The network is trained in numpy by
backpropagation through time on a bounded sample of labelled rows.

A text that is null or has no letter is `und` with score 0. So is every text if nothing could be
learned (no labelled row); with one language all others get it with score 1. Repeated rows
are predicted alike. The sample takes rows by a hash of their text, so that neither
the order nor the partitions of the table matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from locengine.llm.common import text_columns

STRETCH = 64
_FLOAT = np.float32


@dataclass
class Network:
    """Weights; gates are in the order update, reset, candidate."""

    languages: list[str]
    inputs: list[np.ndarray]  # per direction, 256 x 3H
    states: list[np.ndarray]  # per direction, H x 3H
    bias: list[np.ndarray]  # per direction, of the state's candidate part, H
    out: np.ndarray  # 2H x C
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, *self.bias, self.out, self.out_bias]


def new_network(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(_FLOAT)

    return Network(
        languages,
        [normal(256, 3 * hidden, scale=0.5) for _ in range(2)],
        [normal(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
        [np.zeros(hidden, dtype=_FLOAT) for _ in range(2)],
        normal(2 * hidden, len(languages), scale=hidden**-0.5),
        np.zeros(len(languages), dtype=_FLOAT),
    )


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), which costs a quarter of tanh; its slope is (1 - |y|)**2 at value y."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


def _forward(net: Network, way: int, data: np.ndarray) -> list[tuple]:
    """Per step (h before, z, r, n, state part of the candidate, h); data is T x B."""
    hidden = len(net.bias[way])
    h = np.zeros((data.shape[1], hidden), dtype=_FLOAT)
    steps = []
    for t in range(len(data)):
        x, u = net.inputs[way][data[t]], h @ net.states[way]
        gates = 0.5 + 0.5 * _squash(x[:, : 2 * hidden] + u[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        s = u[:, 2 * hidden :] + net.bias[way]
        n = _squash(x[:, 2 * hidden :] + r * s)
        after = n + z * (h - n)
        steps.append((h, z, r, n, s, after))
        h = after
    return steps


def _backward(
    net: Network, way: int, data: np.ndarray, steps: list[tuple], into: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, states and bias; into is the loss gradient of each h, T x B x H."""
    hidden = len(net.bias[way])
    d_in = np.zeros_like(net.inputs[way])
    d_state = np.zeros_like(net.states[way])
    d_bias = np.zeros_like(net.bias[way])
    back = np.zeros_like(steps[0][0])
    for t in range(len(data) - 1, -1, -1):
        h, z, r, n, s, _ = steps[t]
        d = into[t] + back
        d_n = d * (1 - z) * _slope(n)
        d_s = d_n * r
        d_z = d * (h - n) * 0.5 * _slope(2 * z - 1)
        d_r = d_n * s * 0.5 * _slope(2 * r - 1)
        d_x = np.concatenate((d_z, d_r, d_n), axis=1)
        d_u = np.concatenate((d_z, d_r, d_s), axis=1)
        np.add.at(d_in, data[t], d_x)
        d_state += h.T @ d_u
        d_bias += d_s.sum(axis=0)
        back = d * z + d_u @ net.states[way].T
    return d_in, d_state, d_bias


def gradients(net: Network, data: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions of stretches (T x B) and its gradients."""
    length, batch = data.shape
    both = [_forward(net, 0, data), _forward(net, 1, data[::-1])]
    ahead = np.stack([s[5] for s in both[0]])
    behind = np.stack([s[5] for s in both[1]])[::-1]
    states = np.concatenate((ahead, behind), axis=2)
    logits = states @ net.out + net.out_bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    own = p[:, np.arange(batch), label]
    loss = float(-np.log(np.maximum(own, 1e-30)).mean())
    p[:, np.arange(batch), label] -= 1
    d = p / (length * batch)
    d_out = states.reshape(-1, states.shape[2]).T @ d.reshape(-1, d.shape[2])
    d_states = d @ net.out.T
    hidden = len(net.bias[0])
    ahead = _backward(net, 0, data, both[0], d_states[:, :, :hidden])
    behind = _backward(net, 1, data[::-1], both[1], d_states[::-1, :, hidden:])
    parts = zip(ahead, behind, strict=True)
    return loss, [x for pair in parts for x in pair] + [d_out, d.sum(axis=(0, 1))]


def train(
    texts: list[bytes],
    labels: list[str],
    hidden: int = 6,
    steps: int = 500,
    batch: int = 192,
    rate: float = 0.02,
    seed: int = 7,
) -> Network | None:
    """A network from labelled texts; None without any. Languages weigh alike."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return None
    net = new_network(languages, hidden, rng)
    if len(languages) == 1:
        return net
    of: list[list[np.ndarray]] = [[] for _ in languages]
    for text, label in zip(texts, labels, strict=True):
        data = np.frombuffer(text, dtype=np.uint8)
        if len(data) >= STRETCH:
            whole = data[: len(data) // STRETCH * STRETCH].reshape(-1, STRETCH)
        else:
            whole = np.resize(data, (1, STRETCH)) if len(data) else np.zeros((0, STRETCH), np.uint8)
        of[languages.index(label)].append(whole)
    pools = [np.concatenate(x) for x in of]
    usable = [i for i, pool in enumerate(pools) if len(pool)]
    if not usable:
        return net
    weights = net.parameters()
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        label = rng.choice(usable, batch)
        data = np.stack([pools[i][rng.integers(len(pools[i]))] for i in label]).T
        if step % 4 == 0:  # short texts occur too
            data = data[: STRETCH // 4]
        _, grads = gradients(net, data, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


class Reader:
    """The network laid out for reading many stretches at once: gates x stretches."""

    def __init__(self, net: Network):
        hidden = len(net.bias[0])
        self.hidden = hidden
        self.inputs = [np.ascontiguousarray(w.T) for w in net.inputs]
        self.states = [np.ascontiguousarray(w.T) for w in net.states]
        self.bias = [b[:, None] for b in net.bias]
        self.out, self.out_bias = np.ascontiguousarray(net.out.T), net.out_bias[:, None]

    def _read(self, way: int, data: np.ndarray) -> np.ndarray:
        """States T x H x B for data T x B."""
        hidden, inputs, states = self.hidden, self.inputs[way], self.states[way]
        length, batch = data.shape
        out = np.empty((length, hidden, batch), dtype=_FLOAT)
        h = np.zeros((hidden, batch), dtype=_FLOAT)
        x = np.empty((3 * hidden, batch), dtype=_FLOAT)
        u = np.empty((3 * hidden, batch), dtype=_FLOAT)
        for t in range(length):
            np.take(inputs, data[t], axis=1, out=x, mode="clip")
            np.matmul(states, h, out=u)
            gates = x[: 2 * hidden]
            gates += u[: 2 * hidden]
            below = np.abs(gates, out=u[: 2 * hidden])
            below += 1
            gates /= below
            gates *= 0.5
            gates += 0.5
            s, n = u[2 * hidden :], x[2 * hidden :]
            s += self.bias[way]
            s *= gates[hidden:]
            n += s
            np.abs(n, out=s)
            s += 1
            n /= s
            after = out[t]
            np.subtract(h, n, out=after)
            after *= gates[:hidden]
            after += n
            h = after
        return out

    def positions(self, data: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Sums over the real positions of log probabilities, C x B; data and real are T x B."""
        ahead, behind = self._read(0, data), self._read(1, data[::-1])[::-1]
        hidden = self.hidden
        total = np.zeros((len(self.out), data.shape[1]), dtype=np.float64)
        for t in range(len(data)):
            logits = self.out[:, :hidden] @ ahead[t] + self.out[:, hidden:] @ behind[t]
            logits += self.out_bias
            logits -= logits.max(axis=0)
            logits -= np.log(np.exp(logits).sum(axis=0))
            total += logits * real[t]
        return total

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean log probabilities of every text's positions, B x C; zero for an empty text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        pieces = -(-sizes // STRETCH)
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        of = np.repeat(np.arange(len(texts)), pieces)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[of] + place * STRETCH
        length = np.minimum(STRETCH, sizes[of] - place * STRETCH)
        sums = np.zeros((len(texts), len(self.out)))
        for a in range(0, len(of), 4096):
            b = min(len(of), a + 4096)
            # Short ends are moved back into the text, as far as it goes, and read only once.
            back = np.minimum(STRETCH - length[a:b], start[a:b] - begin[of[a:b]])
            at = np.arange(STRETCH)[:, None]
            real = (at >= back) & (at < back + length[a:b])
            where = np.minimum(start[a:b] - back + at, len(flat) - 1)
            data = np.where(at < back + length[a:b], flat[where], 32)
            np.add.at(sums, of[a:b], self.positions(data, real).T)
        return sums / np.maximum(sizes, 1)[:, None]


def training_sample(
    labelled: DataFrame, text: str, lang: str, per_language: int = 400, chars: int = 2048
) -> tuple[list[bytes], list[str]]:
    """At most per_language texts of each language, of each a stretch of at most `chars`.

    Every language is learned; of more than 200, fewer texts of each, to hold the sample's size.
    """
    rows = labelled.where(
        F.col(f"`{lang}`").isNotNull() & (F.length(F.trim(F.col(f"`{text}`"))) > 0)
    ).select(
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.xxhash64(F.col(f"`{text}`")).alias("key"),
        F.col(f"`{text}`").alias("text"),
    )
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    rows = rows.select(
        "lang",
        "key",
        F.substring(F.col("text"), (F.pmod("key", room) + 1).cast("int"), F.lit(chars)).alias("text"),
    )
    languages = rows.select("lang").distinct().count()
    per_language = max(1, min(per_language, 200 * per_language // max(1, languages)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    kept = rows.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    table = kept.orderBy("lang", "key").toArrow().to_pydict()
    return [t.encode() for t in table["text"]], table["lang"]


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 400, **more
) -> Network | None:
    return train(*training_sample(docs, text, lang, per_language), **more)


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The documents with lang_pred and score, the probability of that language.

    Columns of the input with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def compute(texts):
        net = shared.value
        langs, scores = [], []
        if net is None:
            return [["und"] * len(texts), [0.0] * len(texts)]
        raws = [t or b"" for t in texts]
        letters = [any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in raws]
        if len(net.languages) == 1:
            logs = np.zeros((len(raws), 1))
        else:
            logs = Reader(net).documents(raws)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i, has in enumerate(letters):
            langs.append(net.languages[best[i]] if has else "und")
            scores.append(float(p[i, best[i]]) if has else 0.0)
        return [langs, scores]

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return text_columns(docs, text, fields, compute, most=1 << 18)


def held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    c = F.col(f"`{doc_id}`") if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def drop_unknown(
    docs: DataFrame, net: Network | None, text: str = "text", least: float = 0.5
) -> DataFrame:
    """The documents whose language is learned and has at least the score `least`."""
    columns = docs.columns
    named = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    found = identify(named, net, f"c{columns.index(text)}")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.drop("lang_pred", "score").toDF(*columns)
