"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of the slots of its character n-grams (a short word is one of
them), so an unseen misspelling shares most of its vector with the word it hides.
A passage of PASSAGE words is the mean of its words' vectors; two linear outputs
and a softmax give its probability. A text's score is that of its worst passage,
so a few words in a long text are not averaged away. Embeddings and the linear
layer are trained jointly in numpy, by the gradient through the worst passage.

After training a word's vector meets the linear layer in one number, so
scoring is a table lookup for each n-gram, cached by word, and a mean.

The fit reads at most SAMPLE_ROWS labelled texts of each class, of at most SAMPLE_BYTES together,
taken in the order of a hash of their ids; scoring reads every whole text.

Defined results: null, empty and wordless texts get the score of a passage with
no words, which is below one half; null labels are not learned from; of several labels of one
id the largest counts; without labels of both classes every score is that of the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.llm.bytesops import LOWER, Spans, mixed, pieces, raw, runs, table
from fitweave.llm.steps import crc_fold, drop, stored

SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16 << 20
SLOTS, DIM, PASSAGE = 1 << 18, 8, 32
GRAMS = (3, 4, 5)
#: Empty words added to a passage's mean, so that one odd word decides no short text.
SHRINK = 4
LETTERS = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF), (0x27, 0x27), (0x40, 0x40), (0x24, 0x24))


@dataclass
class Model:
    """What scoring needs: the logit share of each slot, and the bias."""

    slots: np.ndarray
    bias: float


def _word_slots(starts: np.ndarray, ends: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all words one after another, number of each word's slots)."""
    sizes = ends - starts
    counts = sum(np.maximum(0, sizes + 2 - g + 1) for g in GRAMS)
    firsts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int64)
    used = np.zeros(len(starts), dtype=np.int64)
    for g in GRAMS:
        n = np.maximum(0, sizes + 2 - g + 1)  # n-grams over the word with a mark on either side
        word = np.repeat(np.arange(len(starts)), n)
        k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        low = starts[word] + k - 1
        left, right = low < starts[word], low + g > ends[word]
        h = spans.hashes(np.maximum(low, starts[word]), np.minimum(low + g, ends[word]))
        h = mixed(h * np.uint64(3) + left.astype(np.uint64) * np.uint64(0x51ED) + right.astype(np.uint64) * np.uint64(0xA2B7) + np.uint64(g))
        out[firsts[word] + used[word] + k] = h & np.uint64(SLOTS - 1)
        used += n
    return out, counts


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Spans]:
    """(starts, ends and hashes of words, first word of each text, spans); a word said again at once counts once."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends = runs(LETTERS[data], offsets)
    spans = Spans(data)
    hashes, bounds = spans.hashes(starts, ends), np.searchsorted(starts, offsets)
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[bounds < len(new)]] = True
    return starts[new], ends[new], hashes[new], np.concatenate([[0], np.cumsum(new)])[bounds], spans


def _passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each passage, first passage of each text); passages overlap by half, the last is whole."""
    sizes = np.diff(bounds)
    half = PASSAGE // 2
    n = np.maximum(1, -(-(sizes - half) // half))
    text = np.repeat(np.arange(len(sizes)), n)
    firsts = np.cumsum(n) - n
    k = np.arange(len(text)) - firsts[text]
    return bounds[:-1][text] + np.minimum(k * half, np.maximum(0, sizes[text] - PASSAGE)), firsts


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 0.2, seed: int = 5) -> Model:
    """Fit embeddings and linear layer jointly: stochastic AdaGrad on the softmax loss of worst passages."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(SLOTS, dtype=np.float32), -2.0)
    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.02, (SLOTS, DIM)).astype(np.float32)
    weight, bias = random.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    squares, weight_squares, bias_squares = np.full(SLOTS, 1e-4, dtype=np.float32), 1e-4, 1e-4
    # distinct words of the sample by number; their slots lie one after another in flat
    known: dict[int, int] = {}
    flat_parts, size_parts, sequences = [], [], []
    for low in range(0, len(texts), 256):
        starts, ends, hashes, bounds, spans = _words(pa.array(texts[low : low + 256], pa.large_string()))
        hashes, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        slots, counts = _word_slots(starts[first], ends[first], spans)
        before = len(known)
        names = np.array([known.setdefault(h, len(known)) for h in hashes.tolist()], dtype=np.int32)
        new = names >= before
        flat_parts.append(slots[np.repeat(new, counts)].astype(np.int32))
        size_parts.append(counts[new].astype(np.int32))
        sequences += [names[back[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    del known
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *flat_parts])
    sizes = np.concatenate([np.zeros(0, dtype=np.int32), *size_parts])
    del flat_parts, size_parts
    firsts = np.cumsum(sizes) - sizes
    weights = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        # a word's logit under the current model, once for each epoch's choice of worst passages
        direction = weight[:, 1] - weight[:, 0]
        logits = np.add.reduceat((embed @ direction)[flat], firsts) / sizes if len(flat) else np.zeros(0)
        for i in random.permutation(len(sequences)):
            words = sequences[i]
            if not len(words):
                continue
            places, _ = _passages(np.array([0, len(words)]))
            if len(places) > 1:
                sums = np.concatenate([[0], np.cumsum(logits[words])])
                place = places[np.argmax(sums[np.minimum(places + PASSAGE, len(words))] - sums[places])]
                words = words[place : place + PASSAGE]
            bag = np.concatenate([flat[firsts[w] : firsts[w] + sizes[w]] for w in words])
            share = np.repeat(1 / (sizes[words] * (len(words) + SHRINK)), sizes[words]).astype(np.float32)
            mean = share @ embed[bag]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            error = (p - np.array([1 - labels[i], labels[i]])).astype(np.float32) * np.float32(weights[i])
            back = weight @ error
            weight_squares += float((np.outer(mean, error) ** 2).mean())
            bias_squares += float((error**2).mean())
            weight -= step * np.outer(mean, error) / np.sqrt(weight_squares)
            bias -= step * error / np.sqrt(bias_squares)
            squares[bag] += (share**2) * float((back**2).mean())
            np.subtract.at(embed, bag, (step * share / np.sqrt(squares[bag]))[:, None] * back[None, :])
    return Model((embed @ (weight[:, 1] - weight[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of toxicity of each text."""
    starts, ends, hashes, bounds, spans = _words(texts)
    if not len(starts):
        return np.full(len(texts), 1 / (1 + exp(-min(model.bias, -1e-3))))
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    slots, counts = _word_slots(starts[first], ends[first], spans)
    logits = np.add.reduceat(model.slots[slots].astype(np.float64), np.cumsum(counts) - counts) / counts
    places, firsts = _passages(bounds)
    ends_at = np.minimum(places + PASSAGE, np.repeat(bounds[1:], np.diff(np.append(firsts, len(places)))))
    sums = np.concatenate([[0], np.cumsum(logits[back])])
    worst = np.maximum.reduceat((sums[ends_at] - sums[places]) / (ends_at - places + SHRINK), firsts)
    return 1 / (1 + np.exp(-np.where(np.diff(bounds) > 0, worst + model.bias, min(model.bias, -1e-3))))


def fit(documents: DataFrame, labels: DataFrame, learn_from: Column) -> Model:
    """Train on a bounded sample of the labelled rows that ``learn_from`` admits."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn_from).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_ROWS).union(known.where("toxic = 0").orderBy(*order).limit(SAMPLE_ROWS))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 * SAMPLE_ROWS ids
    rows = stored(rows.dropDuplicates(["doc_id"]).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))), "sample")
    chosen, spent = [], {0: 0, 1: 0}
    for row in rows.select("doc_id", "toxic", "size").orderBy(*order).collect():
        if spent[row.toxic] + row["size"] <= SAMPLE_BYTES // 2:
            spent[row.toxic] += row["size"]
            chosen.append(row.doc_id)
    wanted = documents.sparkSession.createDataFrame([(i,) for i in chosen], f"doc_id {documents.schema['doc_id'].dataType.simpleString()}")
    sample = rows.join(F.broadcast(wanted), "doc_id").orderBy(*order).select("text", "toxic").collect()
    drop(rows)
    texts, toxic = [r.text or "" for r in sample], np.array([r.toxic for r in sample])
    del sample
    return train(texts, toxic)


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # SLOTS floats
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.record_batch([piece.column("doc_id"), pa.array(score(piece.column("text"), shared.value))], names=["doc_id", "score"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows that are not held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_fold("doc_id", 5) == 0
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return toxicity(documents, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
