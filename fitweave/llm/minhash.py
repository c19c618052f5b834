"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of five words. Documents with one
set are one class; the rest runs on class representatives. Of each of the
minima only the low bits are kept, packed into a sketch; whole minima only feed
the band keys. In a bucket of equal band keys every member meets the bucket's
first member, not every other. A pair's sketches are compared by counting equal
lanes, corrected for lanes that agree by chance; pairs that may reach the
threshold are confirmed on whole sets. In buckets whose members are then not in one
component, those outside its largest component meet all members, so every pair
of a bucket has been compared or lies in one component; no partner is capped,
and a group of copies costs as many pairs as it has members.

A pair at the threshold misses all bands with probability
(1 - 0.75^ROWS)^BANDS, about 2e-5, and the five-sigma margin of the
sketch test with about 3e-7. Members of buckets that stay mixed get a longer sketch of one
bit a minimum, so that few pairs below the threshold ask for whole sets.

Defined results: null, empty and wordless texts have no shingles and link with
nothing; a text of fewer than five words is one shingle; rows that share a
doc_id are one document; a row with a null doc_id stands alone and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.llm.bytesops import LOWER, SPACES, Spans, mixed, pieces, raw, runs
from fitweave.llm.graph import components
from fitweave.llm.steps import drop, stored

WIDTH, BANDS, ROWS, BITS, PERCENT = 5, 40, 5, 4, 75
#: Sketches in one list that members of a mixed bucket meet; there are as many lists as it takes.
LISTED = 128
MINIMA = BANDS * ROWS
#: Minima of the long sketch, one bit each, that members of mixed buckets get for a sharper test.
LONG_MINIMA = 2048


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each text, shingles of each text); still with repeats."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends = runs(~SPACES[data], offsets)
    words = Spans(data).hashes(starts, ends)
    bounds = np.searchsorted(starts, offsets)
    hashes = np.zeros(len(words), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(WIDTH, dtype=np.uint64)])
    lengths = np.diff(bounds)
    left = np.repeat(bounds[1:], lengths) - np.arange(len(words))  # words from here to the text's end
    for i in range(WIDTH):
        hashes = mixed(hashes * np.uint64(0x2545F4914F6CDD1D) + np.where(left > i, padded[i : i + len(words)], np.uint64(i)))
    return hashes, bounds[:-1], np.where(lengths >= WIDTH, lengths - WIDTH + 1, np.minimum(lengths, 1))


def _minima(values: np.ndarray, count: int = MINIMA) -> np.ndarray:
    """The least values of ``count`` hash functions."""
    seeds = mixed(np.arange(7, 7 + count, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    least = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    small = (values >> np.uint64(32)).astype(np.uint32)
    block = max(16, 256 * MINIMA // count)
    for low in range(0, len(small), block):
        x = small[None, low : low + block] * seeds[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def _sketch(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` bits of each of the minima, packed into longs; spare lanes are zero."""
    width = 64 // bits
    lanes = np.zeros(-(-len(minima) // width) * width, dtype=np.uint64)
    lanes[: len(minima)] = minima & np.uint32((1 << bits) - 1)
    return np.bitwise_or.reduce(lanes.reshape(-1, width) << (np.arange(width, dtype=np.uint64) * np.uint64(bits)), axis=1)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in minima.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = mixed(keys * np.uint64(0x2545F4914F6CDD1D) + column)
    return keys


def _longs(rows: list[np.ndarray]) -> pa.Array:
    """Arrow lists of longs."""
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(flat.view(np.int64)))


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sketch, bands) of every document row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                hashes, firsts, counts = _shingles(piece.column("text"))
                sizes, one, two, packed, bands = [], [], [], [], []
                for first, count in zip(firsts.tolist(), counts.tolist()):
                    values = np.unique(hashes[first : first + count])
                    sizes.append(len(values))
                    one.append(int(mixed(values).sum().view(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(mixed(values ^ np.uint64(0x9E3779B97F4A7C15))).view(np.int64)))
                    minima = _minima(values) if count else None
                    packed.append(_sketch(minima) if count else np.zeros(0, dtype=np.uint64))
                    bands.append(_band_keys(minima) if count else np.zeros(0, dtype=np.uint64))
                yield pa.record_batch(
                    [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _longs(packed), _longs(bands)],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch", "bands"],
                )

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch array<bigint>, bands array<bigint>"
    )


def shingle_sets(documents: DataFrame) -> DataFrame:
    """(node, shingles) with each document's whole set of shingle hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                hashes, firsts, counts = _shingles(piece.column("text"))
                sets = [np.unique(hashes[first : first + count]) for first, count in zip(firsts.tolist(), counts.tolist())]
                yield pa.record_batch([piece.column("node"), _longs(sets)], names=["node", "shingles"])

    return documents.select("node", F.col("text").cast("string").alias("text")).mapInArrow(scan, "node bigint, shingles array<bigint>")


def long_sketches(sets: DataFrame) -> DataFrame:
    """(node, size, long) of each set: one bit of each of LONG_MINIMA minima."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.asarray(x.values).view(np.uint64) for x in batch.column("shingles")]
            yield pa.record_batch(
                [batch.column("node"), pa.array([len(v) for v in values], pa.int64()), _longs([_sketch(_minima(v, LONG_MINIMA), 1) for v in values])], names=["node", "size", "long"]
            )

    return sets.mapInArrow(scan, "node bigint, size bigint, long array<bigint>")


def estimated_similarity(one: Column, two: Column, bits: int = BITS, minima: int = MINIMA) -> Column:
    """Similarity from packed low bits: equal lanes by bit counts, less those that agree by chance."""
    lane_ones = sum(1 << place for place in range(0, 64, bits))
    ones = F.lit(lane_ones - (1 << 64 if lane_ones >> 63 else 0))

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        folded = reduce(lambda f, i: f.bitwiseOR(F.shiftrightunsigned(z, i)), range(1, bits), z)
        return F.bit_count(folded.bitwiseAND(ones) if bits > 1 else folded)

    unequal = F.aggregate(F.zip_with(one, two, differing), F.lit(0), lambda n, x: n + x)
    chance = 1 / (1 << bits)
    return (1 - unequal / minima - chance) / (1 - chance)


def least_estimate(percent: int, bits: int = BITS, minima: int = MINIMA) -> float:
    """The threshold less five standard deviations of the estimate."""
    chance = 1 / (1 << bits)
    agree = chance + (1 - chance) * percent / 100
    return percent / 100 - 5 * (agree * (1 - agree) / minima) ** 0.5 / (1 - chance)


def _likely(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches may reach the threshold."""
    near = pairs.join(packed.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(packed.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    return near.where(estimated_similarity(F.col("sketch_a"), F.col("sketch_b")) >= least_estimate(percent)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    whole = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return whole.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def _pairs_across(live: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share a bucket and may reach the threshold by their long sketches.

    live: (band, bucket, node, component). In each bucket with several components the
    members outside its largest one are strangers; every member meets every
    stranger's sketch in place, in lists of about LISTED, and only pairs that may
    reach the threshold become rows, each in the first bucket that both share. A
    bucket of one component costs nothing.
    """
    parts = live.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "component"))
    mixed_buckets = parts.groupBy("bucket").agg(largest.alias("most"), F.sum("n").alias("members")).where("most.n < members")
    mixed_buckets = stored(mixed_buckets.select("bucket", F.col("most.component").alias("main"), (F.col("members") - F.col("most.n")).alias("strangers")), "mixed")
    live = stored(live.join(mixed_buckets, "bucket"), "members")
    nodes = stored(live.select("node").distinct(), "nodes")
    sharp = long_sketches(sets.join(nodes, "node", "left_semi")).join(classes.join(nodes, "node", "left_semi").select("node", "bands"), "node")
    live = live.join(stored(sharp, "long"), "node")
    lot = F.pmod(F.xxhash64("node"), F.ceil(F.col("strangers") / LISTED))
    heads = live.where("component <> main").groupBy("bucket", lot.alias("lot")).agg(F.collect_list(F.struct("node", "component", "size", "long", "bands")).alias("heads"))
    once = lambda h: (F.col("component") == F.col("main")) | (h["node"] < F.col("node"))  # noqa: E731  two strangers meet from either side
    first = lambda h: F.array_position(F.zip_with(h["bands"], F.col("bands"), lambda x, y: x == y), True) == F.col("band") + 1
    near = F.filter(
        "heads",
        lambda h: (h["component"] != F.col("component")) & once(h) & (F.col("size") * 100 >= percent * h["size"]) & (h["size"] * 100 >= percent * F.col("size")) & (estimated_similarity(h["long"], F.col("long"), 1, LONG_MINIMA) >= least_estimate(percent, 1, LONG_MINIMA)) & first(h),
    )
    met = live.select("band", "bucket", "node", "component", "main", "size", "long", "bands").join(heads, "bucket").select("node", F.explode(F.transform(near, lambda h: h["node"])).alias("head"))
    return met.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each document row: (doc_id, n_shingles, component_id, kept, class_id, n_links).

    class_id: least doc_id with the same shingle set. n_links: confirmed links
    of that class to other classes by which its component was joined.
    """
    rows = stored(sketches(documents), "sketches")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    classes = stored(filled.groupBy(*key).agg(F.min_by(F.struct("doc_id", "sketch", "bands"), "doc_id").alias("r")).select(*key, F.col("r.doc_id").alias("node"), "r.sketch", "r.bands"), "classes")
    named = filled.select("doc_id", *key).join(classes.select(*key, "node"), key).select("doc_id", "node")
    same_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    links = stored(named.join(same_id, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "edges")

    members = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("bucket", "first")
    live = stored(members.join(stored(shared, "shared"), "bucket").select("band", "bucket", "node", "first"), "buckets")
    packed = stored(classes.join(live.select("node").distinct(), "node", "left_semi").select("node", F.col("n_shingles").alias("size"), "sketch"), "packed")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(packed.select("node"), "node", "left_semi")
    sets = stored(shingle_sets(texts), "sets")

    pairs = stored(live.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = links.union(stored(_confirmed(_likely(pairs, packed, percent), sets, percent), "edges"))
    labels = stored(components(links), "labels")
    live = live.join(labels.withColumnRenamed("id", "node"), "node", "left").select("band", "bucket", "node", F.coalesce("component", "node").alias("component"))
    more = stored(_confirmed(stored(_pairs_across(live, sets, classes, percent), "pairs"), sets, percent), "edges")
    if not more.isEmpty():
        links = links.union(more)
        labels = stored(components(links), "labels")

    drop(sets, packed)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = classes.select(*key, "node").join(labels.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left")
    found = found.select(*key, F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = rows.select("doc_id", *key).join(found, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_minhash": op1_minhash}
ORACLE: dict[str, str] = {}
