"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad; its features are its own, its two
neighbours' and a bias, and a 2 x 2 matrix holds the transitions.  Labels
exist for documents only, so training starts from lines that carry their
document's label, then lets the fitted field relabel the lines of bad
documents it is sure are good (never all of them), and fits again.
Forward-backward gives each line's marginal of being good; their mean,
weighted by the lines' lengths, becomes the document's score through a
logistic curve fitted on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample: documents of each label, and the lines that a document of it may have.
SAMPLE_PER_LABEL = 2500
SAMPLE_LINES = 2000
FEATURES = 17
THRESHOLD = 0.3

_LOWER, _UPPER, _DIGIT, _SYMBOL, _BANG, _PIPE, _SPACE, _OTHER, _WIDE = range(9)
_CLASS = np.asarray(
    [
        _WIDE if c >= 0x80 else _LOWER if 97 <= c <= 122 else _UPPER if 65 <= c <= 90 else _DIGIT if 48 <= c <= 57
        else _PIPE if c == 0x7C else _SYMBOL if chr(c) in "#*$%&<>" else _BANG if chr(c) in "!?" else _SPACE if c <= 32 else _OTHER
        for c in range(256)
    ],
    dtype=np.uint8,
)
_ENDS = (".", "!", "?", '"', ":", "…", "。")
_NOTICE = ("licen", "copyright", "cookie", "rights reserved", "subscribe", "terms of")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths in characters) of the lines of a whole text; an empty or null text is one empty line."""
    text = text or ""
    lines = text.split("\n")
    raw = np.frombuffer((text + "\n").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 10)[:-1] + 1])
    kind = _CLASS[raw]
    counts = np.stack([np.add.reduceat(kind == c, starts, dtype=np.int32) for c in range(9)], axis=1).astype(np.float32)
    counts[:, _SPACE] -= 1
    size = np.maximum(counts.sum(1), 1)
    x = np.zeros((len(lines), FEATURES), dtype=np.float32)
    letters = np.maximum(counts[:, _LOWER] + counts[:, _UPPER], 1)
    x[:, 0] = counts[:, _UPPER] / letters
    for k, c in enumerate((_DIGIT, _SYMBOL, _BANG, _PIPE, _OTHER, _WIDE), start=1):
        x[:, k] = counts[:, c] / size
    seen: set[str] = set()
    lowered = text.lower()
    notices = [w for w in _NOTICE if w in lowered]
    low_lines = lowered.split("\n") if notices else lines
    for k, (line, low) in enumerate(zip(lines, low_lines, strict=True)):
        words = line.split()
        n = max(len(words), 1)
        x[k, 7:15] = (
            line.rstrip().endswith(_ENDS), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, line in seen and bool(words),
            min(len(line) / n, 40) / 10, any(w in low for w in notices), not words, line[:1].isupper(),
        )
        x[k, 15], x[k, 16] = np.log1p(n) / 6, np.log1p(len(line)) / 8
        seen.add(line)
    return x, np.asarray([max(len(line), 1) for line in lines], dtype=np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A line's features, the previous and the next line's (zero beyond the ends) and a bias."""
    none = np.zeros((1, x.shape[1]), dtype=x.dtype)
    return np.concatenate([x, np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none]), np.ones((len(x), 1), x.dtype)], axis=1)


def forward_backward(unary: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Marginals of being good for each line of each document, and the expected transitions.

    unary: log-odds of good for the lines of a document.  Documents run side
    by side, longest first, so the padding never grows past a document's end.
    """
    order = sorted(range(len(unary)), key=lambda k: -len(unary[k]))
    sizes = np.asarray([len(unary[k]) for k in order])
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int((sizes > t).sum()) for t in range(longest)]
    flat = np.concatenate([unary[k] for k in order]) if order else np.zeros(0)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    weight = np.exp(trans - trans.max())
    alpha: list[np.ndarray] = []
    for t in range(longest):
        odds = 1 / (1 + np.exp(-np.clip(flat[first[: active[t]] + t], -30, 30)))
        emit = np.stack([1 - odds, odds], axis=1)
        a = emit if t == 0 else (alpha[-1][: active[t]] @ weight) * emit
        alpha.append(a / a.sum(1, keepdims=True))
    good, pair = np.zeros(len(flat)), np.zeros((2, 2))
    beta = np.zeros((0, 2))
    for t in range(longest - 1, -1, -1):
        n = active[t]
        full = np.ones((n, 2))
        if t + 1 < longest:
            m = active[t + 1]
            odds = 1 / (1 + np.exp(-np.clip(flat[first[:m] + t + 1], -30, 30)))
            emit = np.stack([1 - odds, odds], axis=1) * beta
            joint = alpha[t][:m, :, None] * weight[None] * emit[:, None, :]
            pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            full[:m] = emit @ weight.T
            full[:m] /= full[:m].sum(1, keepdims=True)
        beta = full
        post = alpha[t] * full
        good[first[:n] + t] = post[:, 1] / post.sum(1)
    out: list[np.ndarray] = [np.zeros(0)] * len(unary)
    for place, k in enumerate(order):
        out[k] = good[first[place] : first[place] + sizes[place]]
    return out, pair


@dataclass
class LineField:
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 4.0
    shift: float = -2.0

    def marginals(self, documents: list[np.ndarray]) -> list[np.ndarray]:
        return forward_backward([with_neighbours(x) @ self.weights for x in documents], self.trans)[0]

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        means = np.asarray([np.average(p, weights=n) for p, (_, n) in zip(self.marginals([x for x, _ in documents]), documents, strict=True)])
        return 1 / (1 + np.exp(-(self.slope * means + self.shift)))


def _fit_field(inputs: list[np.ndarray], labels: list[np.ndarray], importance: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by gradient steps scaled to each weight (Adam)."""
    x, y = np.concatenate(inputs), np.concatenate(labels).astype(np.float64)
    each = np.repeat(importance, [len(v) for v in inputs])
    observed = np.zeros((2, 2))
    for v, w in zip(labels, importance, strict=True):
        for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
            observed[a, b] += w * ((v[:-1] == a) & (v[1:] == b)).sum()
    ends = np.cumsum([len(v) for v in inputs])[:-1]
    theta, m, s = np.zeros(x.shape[1] + 4), 0.0, 0.0
    total = each.sum()
    for k in range(1, steps + 1):
        trans = theta[-4:].reshape(2, 2)
        # importance is by label and close to even, so expected transitions are scaled by its mean
        good, pair = forward_backward(np.split(x @ theta[:-4], ends), trans)
        grad = np.concatenate([x.T @ (each * (y - np.concatenate(good))), (observed - pair * (observed.sum() / max(pair.sum(), 1e-9))).ravel()]) / total
        grad -= 1e-4 * theta
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float, steps: int = 80) -> LineField:
    """prior: share of label 1 among all labelled documents, of which the sample holds both labels alike."""
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        return LineField(np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), 0.0, 30.0 if labels and y[0] else 0.0)
    lines = [np.full(len(x), v) for (x, _), v in zip(documents, labels, strict=True)]
    inputs = [with_neighbours(x).astype(np.float64) for x, _ in documents]
    # a document weighs alike however many lines it has, up to a point
    importance = np.asarray([1.0 / np.sqrt(len(x)) for x in inputs])
    for label in (0, 1):
        importance[y == label] /= importance[y == label].sum()
    importance *= len(y) / 2
    weights, trans = _fit_field(inputs, lines, importance, steps)
    found = forward_backward([x @ weights for x in inputs], trans * 0)[0]
    for k, p in enumerate(found):
        if y[k] == 0:
            sure = p > 0.8
            sure[np.argmin(p)] = False
            lines[k] = np.where(sure, 1, 0)
    field = LineField(*_fit_field(inputs, lines, importance, steps))
    field.slope, field.shift = 1.0, 0.0
    means = np.asarray([np.average(p, weights=n) for p, (_, n) in zip(field.marginals([x for x, _ in documents]), documents, strict=True)])
    share = np.where(y == 1, prior / max((y == 1).mean(), 1e-9), (1 - prior) / max((y == 0).mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge-stabilised logistic regression on the mean
        p = 1 / (1 + np.exp(-(a * means + b)))
        r, h = share * (y - p), share * p * (1 - p)
        g = np.asarray([(r * means).sum() - 0.01 * a, r.sum()])
        hess = np.asarray([[(h * means**2).sum() + 0.01, (h * means).sum()], [(h * means).sum(), h.sum() + 1e-6]])
        a, b = np.asarray([a, b]) + np.linalg.solve(hess, g)
    field.slope, field.shift = max(float(a), 0.0), float(b)
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> LineField:
    """Fit on a sample of about ``per_label`` documents of each label, taken by a hash of the id.

    Labels other than 0 and 1, null ids and null texts are left out; of
    conflicting labels of an id the least counts.  Without a label the score
    is the same for all.
    """
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).filter("y in (0, 1) and i is not null").groupBy("i").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if not counts:
        return LineField(np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), 0.0, 0.0)
    share = F.when(F.col("y") == 1, min(1.0, per_label / max(counts.get(1, 0), 1))).otherwise(min(1.0, per_label / max(counts.get(0, 0), 1)))
    sample = own.filter(F.pmod(F.xxhash64("i", F.lit(6)), F.lit(1_000_000)) / 1_000_000 < share).limit(4 * per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, n = line_features(t)
                if len(x) <= SAMPLE_LINES:
                    rows.append((y, x.tobytes(), n.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.int32()), (1, pa.binary()), (2, pa.binary()))], names=["y", "x", "n"])

    # the sample is bounded, so it is the side to broadcast: no text is shuffled
    joined = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null").join(F.broadcast(sample), "i")
    got = joined.select(F.col("y").cast("int"), "t").mapInArrow(run, "y int, x binary, n binary").toArrow().to_pydict()
    rows = sorted(zip(got["y"], got["x"], got["n"], strict=True))
    documents = [(np.frombuffer(x, np.float32).reshape(-1, FEATURES), np.frombuffer(n, np.float32).astype(np.float64)) for _, x, n in rows]
    return fit(documents, [r[0] for r in rows], counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of whole texts; a null or empty text scores as one empty line."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = shared.value.scores([line_features(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
