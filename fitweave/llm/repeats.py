"""Removal of byte strings that occur again anywhere, by prefix doubling over runs of positions.

A position is removed if it lies in a string of LENGTH bytes that also starts
elsewhere. Suffix positions are ranked by ever longer strings; a rank is a 64-bit hash
of the string, so equal strings have equal ranks in every task, and Spark groups the
pairs (position, rank) to find ranks that occur once. Positions of such a rank are
unique and leave; the others are ranked again at a greater length, up to LENGTH.

Neighbouring positions mostly share their fate, so rows are runs of positions, not positions:

1. Each position takes the least hash among the GRAM-byte strings inside its
   LENGTH bytes. Positions that take the same string form a run; equal
   LENGTH-byte strings take it at the same distance. Rank of a run: that string.
2. Runs with a shared rank are cut at fixed distances into pieces of 32, then 8
   positions, then single ones. A piece has two ranks: of the bytes that all its positions'
   strings have (169, 193, then 200 bytes), and of the bytes that any of them has. If no
   other piece has the first, all its positions are unique; if another has the
   second, all are repeated; otherwise it is cut further.

Of runs that are equal altogether one goes on for all, so a third of all rows
being copies costs counts, not pairs, and no group of equal ranks meets in one task.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH lose
nothing; strings never cross texts; repeated rows count as occurrences of each other;
what remains may be cut inside a character, so it is bytes; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.llm.bytesops import Spans, last_minima, mixed, pieces, raw
from fitweave.llm.steps import drop, stored

LENGTH, GRAM = 200, 64
WIDTHS = (32, 8, 1)


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows with a key (id, h) that equal rows share and that survives a second scan."""
    return documents.select(F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("h"), "doc_id", F.col("text").cast("string").alias("text"))


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, h, gram, cover, lo, n, d): runs of n positions from lo on that take one string, d bytes after lo."""
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = raw(piece.column("text"))
                if len(data) < length:
                    continue
                spans = Spans(data)
                grams = spans.grams(gram)
                taken = last_minima(grams, length - gram + 1)
                sizes = np.diff(offsets)
                inside = (np.repeat(offsets[1:], sizes) - np.arange(len(data)) >= length)[: len(taken)]
                text = np.repeat(np.arange(len(sizes)), sizes)[: len(taken)]
                joined = np.zeros(len(taken) + 1, dtype=bool)  # a position goes on with the run before it
                joined[1:-1] = inside[1:] & inside[:-1] & (taken[1:] == taken[:-1]) & (text[1:] == text[:-1])
                first = np.flatnonzero(inside & ~joined[:-1])
                last = np.flatnonzero(inside & ~joined[1:])
                place, at = taken[first], text[first]
                cover = mixed(spans.hashes(first, last + length) + (place - first).astype(np.uint64))
                yield pa.record_batch(
                    [piece.column("id").take(pa.array(at)), piece.column("h").take(pa.array(at)), pa.array(grams[place].view(np.int64)), pa.array(cover.view(np.int64)),
                     pa.array((first - offsets[at]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array((place - first).astype(np.int32))],
                    names=["id", "h", "gram", "cover", "lo", "n", "d"],
                )

    return rows.select("id", "h", "text").mapInArrow(scan, f"id {kind}, h bigint, gram bigint, cover bigint, lo int, n int, d int")


def _contexts(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(aid, n, d, bytes) with the bytes of all strings that start in each asked run."""
    wanted = asked.groupBy("id", "h").agg(F.collect_list(F.struct("aid", "lo", "n", "d")).alias("runs"))  # bounded by the text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = raw(piece.column("text"))
                aid, n, d, out = [], [], [], []
                for low, found in zip(offsets[:-1].tolist(), piece.column("runs").to_pylist()):
                    for r in found:
                        aid.append(r["aid"])
                        n.append(r["n"])
                        d.append(r["d"])
                        out.append(data[low + r["lo"] : low + r["lo"] + r["n"] - 1 + length].tobytes())
                yield pa.record_batch([pa.array(aid, pa.int64()), pa.array(n, pa.int32()), pa.array(d, pa.int32()), pa.array(out, pa.binary())], names=["aid", "n", "d", "bytes"])

    return rows.select("id", "h", "text").join(wanted, ["id", "h"]).select("text", "runs").mapInArrow(cut, "aid bigint, n int, d int, bytes binary")


def _parts(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """(aid, x, core, cover) of each part of ``width`` distances from x on; contexts may list the parts wanted.

    A part that leaves its run has the rank of its common bytes, but of all
    its bytes only a rank of its own.
    """
    columns = ["aid", "n", "d", "bytes"] + (["parts"] if "parts" in contexts.columns else [])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                values = batch.column("bytes")
                bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
                data = np.frombuffer(values.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
                bounds = bounds - bounds[0]
                n, d, aid = (np.asarray(batch.column(c)).astype(np.int64) for c in ("n", "d", "aid"))
                least, most = d - n + 1, d  # distances of the run's positions
                if "parts" in columns:
                    lists = batch.column("parts")
                    row, x = np.repeat(np.arange(len(n)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten()).astype(np.int64)
                    keep = (x <= most[row]) & (x + width > least[row])
                    row, x = row[keep], x[keep]
                else:
                    count = most // width - least // width + 1
                    row = np.repeat(np.arange(len(n)), count)
                    x = (least[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * width
                spans = Spans(data)
                place = bounds[:-1][row] + d[row]  # of the string that the run took
                core = mixed(spans.hashes(place - x, place - (x + width - 1) + length) * np.uint64(31) + x.astype(np.uint64))
                full = (x >= least[row]) & (x + width - 1 <= most[row])
                begin, end = np.where(full, place - (x + width - 1), place), np.where(full, place - x + length, place)
                cover = np.where(full, mixed(spans.hashes(begin, end) * np.uint64(37) + x.astype(np.uint64)), mixed(aid[row].astype(np.uint64) * np.uint64(41) + x.astype(np.uint64)))
                yield pa.record_batch([pa.array(aid[row]), pa.array(x.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(full)], names=["aid", "x", "core", "cover", "full"])

    return contexts.select(*columns).mapInArrow(rank, "aid bigint, x int, core bigint, cover bigint, full boolean")


def repeated_positions(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, h, start, stop): ranges of positions whose ``length`` bytes start elsewhere too; rows have id, h, text."""
    runs = stored(_runs(rows, length, gram), "runs")
    grams = runs.groupBy("gram").agg(F.count("*").alias("times"), F.min("cover").alias("low"), F.max("cover").alias("high")).where("times > 1")
    grams = stored(grams.select("gram", (F.col("low") != F.col("high")).alias("mixed")), "grams")  # apart from the join, so that Spark may split a frequent gram's rows there
    shared = stored(runs.join(grams, "gram"), "shared")
    drop(runs)
    alike = shared.where("mixed").groupBy("gram", "cover").agg(F.count("*").alias("times"), F.min(F.struct("id", "h", "lo", "n", "d")).alias("r"))
    alike = stored(alike.select("gram", "cover", "times", F.monotonically_increasing_id().alias("aid"), "r.*"), "asked")
    equal = shared.where("mixed").join(alike.where("times > 1").select("gram", "cover"), ["gram", "cover"], "left_semi")
    found = [stored(shared.where("not mixed").unionByName(equal).select("id", "h", F.col("lo").alias("start"), (F.col("lo") + F.col("n")).alias("stop")), "ranges")]
    drop(shared)
    contexts = stored(_contexts(rows, alike, length), "contexts")
    asked = contexts
    for width, next_width in zip(WIDTHS, (*WIDTHS[1:], None)):
        parts = stored(_parts(asked, width, length).dropDuplicates(["aid", "x"]), "parts")
        cores = parts.groupBy("core").agg(F.count("*").alias("times"), F.min("cover").alias("low"), F.max("cover").alias("high")).where("times > 1")
        cores = stored(cores.select("core", (F.col("low") != F.col("high")).alias("mixed")), "cores")
        common = stored(parts.join(cores, "core"), "common")
        drop(parts)
        groups = stored(common.where("mixed").groupBy("core", "cover").agg(F.count("*").alias("times"), F.min(F.struct("aid", "x")).alias("r")), "groups")
        twice = common.where("mixed").join(groups.where("times > 1").select("core", "cover"), ["core", "cover"], "left_semi")
        ends = common.where("not mixed and full").unionByName(twice).select("aid", "x").join(alike.select("aid", "id", "h", "lo", "d"), "aid")
        start = F.col("lo") + F.col("d") - F.col("x")
        found.append(stored(ends.select("id", "h", (start - (width - 1)).alias("start"), (start + 1).alias("stop")), "ranges"))
        drop(common)
        if next_width is not None:
            steps = F.expr(f"explode(transform(sequence(0, {width // next_width - 1}), i -> r.x + i * {next_width}))")
            wanted = groups.select("r.aid", steps.alias("part")).groupBy("aid").agg(F.collect_list("part").alias("parts"))
            asked = contexts.join(wanted, "aid")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each document row: (doc_id, n_bytes, spans, kept); spans (start, stop) are removed, kept is what remains."""
    rows = _keyed(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    ranges = repeated_positions(rows, length, gram).groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))  # bounded by the text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = raw(piece.column("text"))
                spans, kept = [], []
                for low, high, found in zip(offsets[:-1].tolist(), offsets[1:].tolist(), piece.column("ranges").to_pylist()):
                    if not found:
                        spans.append([])
                        kept.append(data[low:high].tobytes())
                        continue
                    edge = np.zeros(high - low + 1, dtype=np.int32)
                    np.add.at(edge, [r["start"] for r in found], 1)
                    np.add.at(edge, [r["stop"] - 1 + length for r in found], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(change[::2], change[1::2])])
                    kept.append(data[low:high][~gone].tobytes())
                yield pa.record_batch([piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(ranges, ["id", "h"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of `without_repeats` over all documents."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_repeats": op5_repeats}
ORACLE: dict[str, str] = {}
