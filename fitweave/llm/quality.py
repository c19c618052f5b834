"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few measurements. Each measurement has one lookup table over its
bins, each chosen pair of measurements one over the grid of theirs; a score is the
sum of the cells a text falls in, through the logistic function. Tables are learned by cyclic
boosting: round after round each measurement in turn gets a shallow tree on the
current residuals, whose leaves are added to its table; then the pairs that explain most of what
is left get theirs. Scoring is one bin search and one addition for each table.

The fit reads at most SAMPLE_ROWS labelled rows, in the order of a hash of
their ids, and of them measurements only; every whole text is measured and scored.

Defined results: null, empty and wordless texts are measured as all zeros and
scored like any other; null labels are not learned from; of several labels of one id the least
counts; without labels of both classes every score is the labels' mean (one half without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.llm.bytesops import LOWER, SPACES, Spans, mixed, pieces, raw, runs, table
from fitweave.llm.steps import crc_fold, stored

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 16, 8, 120, 80, 0.1
DEPTH, LEAST_ROWS, RIDGE = 2, 20, 1.0

_CLASSES = {
    "upper": table((0x41, 0x5A)),
    "digits": table((0x30, 0x39)),
    "symbols": np.isin(np.arange(256), list(b"#*$%&|<>")),
    "marks": np.isin(np.arange(256), list(b".,;:?\"'()-")),
    "exclamations": np.isin(np.arange(256), list(b"!")),
    "foreign": table((0x80, 0xFF)),
    "blanks": SPACES,
}
MEASURES = ["log_words", "word_length", "long_words", "distinct_words", "said_again", "distinct_windows", "distinct_lines", "line_words", *_CLASSES]


def _distinct(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n texts."""
    _, first = np.unique(mixed(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(of[first], minlength=n)


def measure(texts: pa.Array) -> np.ndarray:
    """MEASURES of each text; one row for each."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(MEASURES)))
    if not len(data):
        return out
    size = np.maximum(1, np.diff(offsets))
    for k, inside in enumerate(_CLASSES.values()):
        before = np.concatenate([[0], np.cumsum(inside[data])])
        out[:, len(MEASURES) - len(_CLASSES) + k] = np.diff(before[offsets]) / size
    data = LOWER[data]
    spans = Spans(data)
    starts, ends = runs(~SPACES[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    of, some = np.repeat(np.arange(n), words), np.maximum(1, words)
    hashes = spans.hashes(starts, ends)
    windows = mixed(mixed(hashes[:-2] + np.uint64(1)) + mixed(hashes[1:-1] + np.uint64(2)) + mixed(hashes[2:] + np.uint64(3))) if len(hashes) > 2 else hashes[:0]
    whole = of[: len(windows)] == of[2:]
    line_starts, line_ends = runs(data != 0x0A, offsets)
    line_of = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_of, minlength=n)
    again = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n)
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.bincount(of, ends - starts, minlength=n) / some
    out[:, 2] = np.bincount(of[ends - starts > 15], minlength=n) / some
    out[:, 3] = _distinct(hashes, of, n) / some
    out[:, 4] = again / some
    out[:, 5] = _distinct(windows[whole], of[: len(windows)][whole], n) / np.maximum(1, words - 2)
    out[:, 6] = _distinct(spans.hashes(line_starts, line_ends), line_of, n) / np.maximum(1, lines)
    out[:, 7] = words / np.maximum(1, lines)
    out[words == 0] = 0
    return out


@dataclass
class Model:
    """Bin edges of each measurement, its table, and the tables of pairs over coarser edges."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-g.sum() / (h.sum() + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Leaf value of each bin: a tree of splits over one measurement's histogram."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = left_g**2 / (left_h + RIDGE) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(left_n < LEAST_ROWS) | (n.sum() - left_n < LEAST_ROWS)] = 0
    if not depth or not len(gain) or gain.max() <= 1e-6:
        return np.full(g.shape, _leaf(g, h))
    place = int(gain.argmax()) + 1
    return np.concatenate([_tree(g[:place], h[:place], n[:place], depth - 1), _tree(g[place:], h[place:], n[place:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """(leaf value of each cell, gain) of the best tree that cuts both measurements of a pair once."""
    quarter = []
    for x in (g, h, n):
        low = np.cumsum(np.cumsum(x, axis=0), axis=1)
        up, left, whole = low[:-1, -1:], low[-1:, :-1], low[-1, -1]
        low = low[:-1, :-1]
        quarter.append((low, up - low, left - low, whole - up - left + low))
    if not quarter[0][0].size:
        return np.zeros(g.shape), 0.0
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(quarter[0], quarter[1]))
    gain = np.where(np.minimum.reduce(quarter[2]) >= LEAST_ROWS, gain, 0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] <= 1e-6:
        return np.zeros(g.shape), 0.0
    leaves = [-quarter[0][q][i, j] / (quarter[1][q][i, j] + RIDGE) for q in range(4)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaves
    return out, float(gain[i, j])


def train(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Fit the tables by cyclic boosting on the logistic loss."""
    if not len(labels) or labels.min() == labels.max():
        mean = float(labels.mean()) if len(labels) else 0.5
        return Model(float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    mean = labels.mean()
    model = Model(float(np.log(mean / (1 - mean))))
    model.edges = [_edges(column, BINS) for column in rows.T]
    model.coarse = [_edges(column, PAIR_BINS) for column in rows.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, column, side="right") for e, column in zip(model.edges, rows.T)]
    coarse = [np.searchsorted(e, column, side="right") for e, column in zip(model.coarse, rows.T)]
    z = np.full(len(labels), model.bias)

    def histograms(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(cells, p - labels, size), np.bincount(cells, p * (1 - p), size), np.bincount(cells, minlength=size)

    for _ in range(ROUNDS):
        for k, cells in enumerate(fine):
            step = RATE * _tree(*histograms(cells, len(model.tables[k])))
            model.tables[k] += step
            z += step[cells]
    grids = {}
    for a in range(rows.shape[1]):
        for b in range(a):
            shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
            grids[a, b] = _quadrants(*(x.reshape(shape) for x in histograms(coarse[a] * shape[1] + coarse[b], shape[0] * shape[1])))[1]
    model.pairs = sorted(grids, key=lambda p: (-grids[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), grid in zip(model.pairs, model.pair_tables):
            cells = coarse[a] * grid.shape[1] + coarse[b]
            step = RATE * _quadrants(*(x.reshape(grid.shape) for x in histograms(cells, grid.size)))[0]
            grid += step
            z += step.ravel()[cells]
    return model


def score(rows: np.ndarray, model: Model) -> np.ndarray:
    """Probability of label 1 of each row of MEASURES: bin searches and additions."""
    z = np.full(len(rows), model.bias)
    for column, edges, values in zip(rows.T, model.edges, model.tables):
        z += values[np.searchsorted(edges, column, side="right")]
    for (a, b), grid in zip(model.pairs, model.pair_tables):
        z += grid[np.searchsorted(model.coarse[a], rows[:, a], side="right"), np.searchsorted(model.coarse[b], rows[:, b], side="right")]
    return 1 / (1 + np.exp(-z))


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, measures) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = measure(piece.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(MEASURES), pa.int32()), pa.array(rows.ravel()))
                yield pa.record_batch([piece.column("doc_id"), lists], names=["doc_id", "measures"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, measures array<double>")


def fit(rows: DataFrame, labels: DataFrame, learn_from: Column) -> Model:
    """Train on a bounded sample of the labelled rows that ``learn_from`` admits; rows have doc_id and measures."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn_from).groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = rows.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()  # at most SAMPLE_ROWS
    return train(np.array(sample.measures.tolist()).reshape(-1, len(MEASURES)), sample.quality.to_numpy(dtype=float))


def quality(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every measured row."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("measures").flatten()).reshape(-1, len(MEASURES))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score(values, model))], names=["doc_id", "score"])

    return rows.select("doc_id", "measures").mapInArrow(scan, f"doc_id {kind}, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows that are not held out."""
    rows = stored(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "measures")
    held_out = crc_fold("doc_id", 4) == 2
    model = fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return quality(rows, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLE: dict[str, str] = {}
