"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken in Arrow batches. The trees are fitted with numpy on a bounded sample of labelled documents,
flattened into arrays, and walked for whole batches and all trees at once.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import held_out, public_id, texts

#: Labelled documents that a model is fitted on, about; all if there are fewer.
SAMPLE = 20_000
THRESHOLD = 0.7
FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "stops", "shouts", "symbols", "pipes", "wide",
            "repeats", "longest_run", "distinct_words", "log_lines", "distinct_lines", "line_bytes", "longest_line",
            "symbol_ends", "entropy")
_SYMBOLS = np.frombuffer(b"#$%&*@^~=<>{}[]\\_+/", np.uint8)
_ENDS = frozenset(b"#$%&*@^~=!")


def statistics(text: bytes) -> list[float]:
    """Numbers about one text; shares are 0 where there is nothing to count."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    w = max(len(words), 1)
    letters = max(int(count[65:91].sum() + count[97:123].sum()), 1)
    repeats = sum(map(operator.eq, words[1:], words))
    run = max((sum(1 for _ in g) for _, g in groupby(words)), default=0) if repeats else min(len(words), 1)
    p = count[count > 0] / n
    widths = list(map(len, lines))
    return [np.log1p(n), np.log1p(len(words)), n / w, count[65:91].sum() / letters, count[48:58].sum() / n,
            (count[32] + count[9:14].sum()) / n, (count[44] + count[46]) / n, (count[33] + count[63]) / n,
            count[_SYMBOLS].sum() / n, count[124] / n, count[128:].sum() / n, repeats / w, run / w,
            len(set(words)) / w, np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines), max(widths) / n,
            sum(x[-1] in _ENDS for x in words) / w, float(-(p * np.log(p)).sum())]


def _table(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column(i).to_pylist()], np.float32).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes in breadth-first order, then leaves. Values go right if above the cut."""

    prior: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        while inner and node[:1].max(initial=0) < inner:
            right = x[row, self.feature[tree, node]] > self.cut[tree, node]
            node = 2 * node + 1 + right
        raw = self.prior + (self.leaf[tree, node - inner].sum(axis=1) if inner else 0)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
        smooth: float = 1.0, least: float = 3.0) -> Trees:
    """Boosted trees for labels 0 and 1 by second-order splits of histograms; `least` is the curvature a child needs."""
    inner = 2 ** depth - 1
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(mean / (1 - mean))), np.zeros((trees, inner), np.int64),
                  np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)))
    if len(y) < 2 or y.min() == y.max():
        return model
    # Cuts are values of the data, so a bin's code is above a cut exactly when its value is.
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    width, n_features = bins + 1, x.shape[1]
    cell = code + np.arange(n_features) * width
    raw = np.full(len(y), model.prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n_nodes = 2 ** level - 1, 2 ** level
            at = (cell + ((node - first) * n_features * width)[:, None]).ravel()
            size = n_nodes * n_features * width
            shape = (n_nodes, n_features, width)
            gs = np.bincount(at, np.repeat(g, n_features), size).reshape(shape).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, n_features), size).reshape(shape).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + smooth) + (ga - gs) ** 2 / (ha - hs + smooth) - ga ** 2 / (ha + smooth)
            gain[(hs < least) | (ha - hs < least)] = 0
            best = gain.reshape(n_nodes, -1).argmax(axis=1)
            feature, place = best // width, best % width
            for k in range(n_nodes):
                if gain[k, feature[k], place[k]] > 1e-6 and place[k] < len(cuts[feature[k]]):
                    model.feature[t, first + k] = feature[k]
                    model.cut[t, first + k] = cuts[feature[k]][place[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        total_g, total_h = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        model.leaf[t] = -rate * total_g / (total_h + smooth)
        raw += model.leaf[t][leaf]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Trees:
    """Fit on about `sample` labelled documents that are not held out, chosen by a hash of doc_id.

    Labels without a document, without an id or with a null quality are not used; several labels of one id count each.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    part = max(1, min(1 << 20, (sample << 20) // max(known.count(), 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _table(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(table[:, i]) for i in range(len(FEATURES))]],
                                             names=["label", *FEATURES])

    # The chosen labels are as many as `sample`, two numbers each: they are broadcast, the texts stay where they are.
    measured = (texts(docs).join(F.broadcast(chosen), "doc_id").select("label", F.col("text").cast("binary"))
                .mapInArrow(measure, "label int, " + ", ".join(f"{f} float" for f in FEATURES))).toArrow()
    order = np.lexsort([measured.column(c).to_numpy() for c in measured.column_names])  # the fit does not depend on task order
    x = np.stack([measured.column(f).to_numpy()[order] for f in FEATURES], axis=1) if len(order) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, measured.column("label").to_numpy()[order].astype(np.float64), **options)


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold`) of every whole text, a row for each input row.

    Null text counts as empty and is scored too; a null doc_id is not held out. Repeated rows score alike. An empty
    table gives no rows; columns other than doc_id and text are ignored. A model fitted without both labels gives
    every text the same score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_table(batch, 1)), pa.float64())],
                                             names=["doc_id", "score"])

    scored = texts(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")
    return scored.select(public_id().alias("doc_id"), held_out(public_id()).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
