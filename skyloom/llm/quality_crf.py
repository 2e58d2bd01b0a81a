"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line with a word gets figures of its own (symbols, capitals, separators, repeats, ...), and those
of the lines before and after it. The field labels each line good or bad; neighbouring labels share a
learnt potential. Forward-backward gives each line's probability of being good, and the mean over lines,
weighted by their lengths, is the document's quality.

The field is fitted on the driver, on a bounded sample of labelled documents: at most ``max_documents``,
those whose ids hash lowest, each with all of its lines. Only
labels that the caller's ``train`` condition admits are used. Scoring covers every line of every text,
in Arrow batches without a shuffle.

Edge cases: a null or empty text is scored as one empty line. Documents without labels are scored like
others; labels of missing documents are ignored; a document with several labels counts as good if most
are. With no labels, or labels of one kind only, all scores are that kind's value, 0.5 without any.
Repeated rows get equal scores; of several texts of one id the field learns from that of the least figures. Very long texts are processed whole. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DROP = {
    "symbols": b"#*$%&|<>@^~=+_\\{}[]",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": bytes(range(48, 58)),
    "high": bytes(range(128, 256)),
    "marks": b".,;:?'\"()-",
    "shout": b"!",
}
N_FIGURES = 14


@dataclass(frozen=True)
class Fit:
    max_documents: int = 3000
    rounds: int = 200
    rate: float = 0.05
    ridge: float = 1e-3


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of own, previous and next figures, then edge flags and the bias
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    constant: float | None = None


def line_figures(line: bytes) -> tuple[list[float], int]:
    """Figures of one line of UTF-8, and its length in bytes."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return [0.0] * N_FIGURES, max(size, 1)
    c = {k: size - len(line.translate(None, v)) for k, v in _DROP.items()}
    inked = sum(map(len, words))
    letters = c["upper"] + c["lower"] + c["high"]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(n),
        inked / n,
        c["symbols"] / inked,
        c["upper"] / max(letters, 1),
        c["digits"] / inked,
        c["marks"] / inked,
        c["shout"] / inked,
        line.count(b" | ") / n,
        repeats / n,
        len(set(words)) / n,
        float(line.rstrip()[-1:] in b".!?\"'"),
        float(c["upper"] > 0.6 * max(letters, 1) and letters > 3),
        letters / inked,
        math.log1p(c["symbols"]),
    ], size


def document_figures(text: str | None) -> tuple[list[list[float]], list[int]]:
    """Figures and lengths of the lines that have a word; of one empty line where none has."""
    found = [line_figures(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.split()]
    found = found or [line_figures(b"")]
    return [f for f, _ in found], [n for _, n in found]


def with_neighbours(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows of own, previous and next figures, two edge flags and a one; the rows are lines of documents in order."""
    before = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]) * ~first[:, None]
    after = np.vstack([x[1:], np.zeros((1, x.shape[1]))]) * ~last[:, None]
    return np.hstack([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))])


def edges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    first, last = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
    first[ends - lengths] = True
    last[ends - 1] = True
    return first, last


def marginals(score: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of good for every line, summed pair probabilities a document, and log partition values.

    Documents are swept together: step t treats the t-th line of all that have one.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    node = np.exp(np.stack([np.zeros_like(score), np.clip(score, -30, 30)], 1))
    link = np.exp(pair)
    alpha, beta = np.empty_like(node), np.ones_like(node)
    scale = np.empty(len(score))
    for t in range(steps):
        at = starts[: active[t]] + t
        a = node[at] * (1.0 if t == 0 else alpha[at - 1] @ link)
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    pairs = np.zeros((len(lengths), 2, 2))
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        nxt = node[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = nxt @ link.T
        pairs[: active[t + 1]] += alpha[at][:, :, None] * link[None] * nxt[:, None, :]
    good = alpha[:, 1] * beta[:, 1]
    total = alpha[:, 0] * beta[:, 0] + good
    z = np.add.reduceat(np.log(scale), np.cumsum(lengths) - lengths)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return good / total, pairs[back], z


def fit(figures: list[np.ndarray], labels: list[int], p: Fit) -> Model:
    """Maximum likelihood by Adam; all lines of a document bear its label; both kinds weigh the same."""
    if len(set(labels)) < 2:
        flat = np.zeros(N_FIGURES)
        return Model(flat, flat + 1, np.zeros(3 * N_FIGURES + 3), constant=float(labels[0]) if labels else 0.5)
    lengths = np.array([len(x) for x in figures])
    x = np.vstack(figures)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    rows = with_neighbours((x - mean) / scale, *edges(lengths))
    y = np.array(labels, float)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y) / np.sqrt(lengths)
    per_line, truth = np.repeat(weight, lengths), np.repeat(y, lengths)
    counts = np.zeros((len(y), 2, 2))
    counts[np.arange(len(y)), y.astype(int), y.astype(int)] = lengths - 1
    w, pair = np.zeros(rows.shape[1]), np.zeros((2, 2))
    theta = np.concatenate([w, pair.ravel()])
    m = v = np.zeros_like(theta)
    for i in range(1, p.rounds + 1):
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs, _ = marginals(rows @ w, lengths, pair)
        slope = np.concatenate([rows.T @ ((truth - good) * per_line), ((counts - pairs) * weight[:, None, None]).sum(0).ravel()]) - p.ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + p.rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    # Pair potentials are kept within reach of the lines' own evidence.
    return Model(mean, scale, theta[:-4], np.clip(theta[-4:].reshape(2, 2), -3, 3))


def score_texts(texts: list[str | None], model: Model) -> list[float]:
    """Length-weighted marginals of each text."""
    if model.constant is not None:
        return [model.constant] * len(texts)
    if not texts:
        return []
    found = [document_figures(t) for t in texts]
    lengths = np.array([len(n) for _, n in found])
    x = (np.array([f for fs, _ in found for f in fs]) - model.mean) / model.scale
    good, _, _ = marginals(with_neighbours(x, *edges(lengths)) @ model.weights, lengths, model.pair)
    size = np.array([n for _, ns in found for n in ns], float)
    at = np.cumsum(lengths) - lengths
    return (np.add.reduceat(good * size, at) / np.add.reduceat(size, at)).tolist()


def train(docs: DataFrame, labels: DataFrame, admit: Column, p: Fit = Fit(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from the sample of labelled documents that ``admit``, a condition on labels' id column, lets in."""
    chosen = (
        labels.where(admit & F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64(key), key)
        .limit(p.max_documents)
    )
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(key, "y", text)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [document_figures(t)[0] for t in batch.column(2).to_pylist()]
            flat = [pa.array([v for f in fs for v in f], pa.float64()) for fs in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.to_pylist() for x in flat], pa.list_(pa.float64()))], [key, "y", "figures"])

    kind = docs.schema[key].dataType.simpleString()
    sample = rows.mapInArrow(run, f"{key} {kind}, y int, figures array<double>").toPandas()
    # Of the texts of one id, that of the least figures; rows in any order give one model.
    first: dict = {}
    for id_, y, figures in zip(sample[key].tolist(), sample["y"].tolist(), map(tuple, sample["figures"]), strict=True):
        if id_ not in first or figures < first[id_][1]:
            first[id_] = (int(y), figures)
    chosen = [first[id_] for id_ in sorted(first)]
    return fit([np.array(f, float).reshape(-1, N_FIGURES) for _, f in chosen], [y for y, _ in chosen], p)


def held_out(key: str = "doc_id") -> Column:
    """Whether CRC-32 of the id, as text, is divisible by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the ``keep`` columns, score and predicted (1 where the score reaches the threshold) of every document."""
    held = [key, *(c for c in keep if c != key)]
    source = docs.select(*held, *([text] if text not in held else []))
    text_at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                scores = score_texts(part.column(text_at).to_pylist(), model)
                arrays = [part.column(i) for i in range(len(held))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*held, "score", "predicted"])

    return source.mapInArrow(run, ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in held) + ", score double, predicted int")
