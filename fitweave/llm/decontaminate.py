"""Benchmark decontamination by winnowing.

Documents and benchmark items are word sequences. Of every run of
``window - gram + 1`` consecutive word grams the least hash is kept, so a span
of ``window`` shared words always leaves a kept gram in both texts. Kept grams
of documents and items are joined; each joined pair is extended to the windows
around the gram, and only windows equal in all their words count.

A Bloom bitmap of the items' grams, of one fixed size however many items
there are, stops grams that no item has inside the scan. It lets false
positives through to the join and never drops a match.

Defined results: null, empty and wordless texts have no words and hit nothing;
an item with fewer than ``window`` words is one window of its own length; items
with one id are one item, a null id reads "null"; repeated document rows give one
row each; an empty benchmark hits nothing; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.llm.bytesops import LOWER, Spans, last_minima, mixed, pieces, raw, runs, table
from fitweave.llm.steps import stored

WINDOW, GRAM = 13, 7
BLOOM_BITS = 23
#: Bytes of words once A-Z are lower-cased: digits, a-z and all bytes of other scripts.
WORD_BYTES = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: The same as a pattern, for Spark and other SQL engines.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_MARKS = "array<struct<fp:bigint,first:int,size:int,windows:array<bigint>>>"


def _sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + words[i : i + n])
    return out


def _kept(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept grams of one long word sequence."""
    grams = _sequence_hashes(words, gram)
    places = np.unique(last_minima(grams, window - gram + 1))
    return places, grams[places]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word offsets of each text)."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends = runs(WORD_BYTES[data], offsets)
    return Spans(data).hashes(starts, ends), np.searchsorted(starts, offsets)


def _marks(words: np.ndarray, offsets: np.ndarray, window: int, gram: int, short: list[int], wanted: np.ndarray | None, whole: bool) -> list[list]:
    """Kept grams of each text, as (hash, first word of the first window, window size, window hashes).

    ``whole``: a text shorter than ``window`` is one window (an item);
    otherwise every window of each size in ``short`` is kept (a document).
    """
    out: list[list] = [[] for _ in range(len(offsets) - 1)]

    def add(fps: np.ndarray, places: np.ndarray, size: int, reach: int, hashes: np.ndarray, text: np.ndarray) -> None:
        if wanted is not None:
            hit = wanted[(fps >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)]
            fps, places, text = fps[hit], places[hit], text[hit]
        for fp, place, t in zip(fps.view(np.int64).tolist(), places.tolist(), text.tolist()):
            first = place - reach
            around = [int(hashes[p]) if offsets[t] <= p <= offsets[t + 1] - size else None for p in range(first, place + 1)]
            out[t].append((fp, first - int(offsets[t]), size, around))

    of_text = lambda places: np.searchsorted(offsets, places, side="right") - 1
    lengths = np.diff(offsets)
    reach = window - gram
    grams = _sequence_hashes(words, gram)
    windows = _sequence_hashes(words, window).view(np.int64)
    if len(windows):
        low = last_minima(grams, reach + 1)[: len(windows)]
        starts = np.arange(len(windows))
        inside = offsets[of_text(starts) + 1] - starts >= window
        places = np.unique(low[inside])
        add(grams[places], places, window, reach, windows, of_text(places))
    sizes = sorted(set(lengths[(lengths > 0) & (lengths < window)].tolist())) if whole else short
    for size in sizes:
        hashes = _sequence_hashes(words, size)
        places = offsets[:-1][lengths == size] if whole else np.arange(len(hashes))
        text = of_text(places)
        fits = offsets[text + 1] - places >= size
        add(hashes[places[fits]], places[fits], size, 0, hashes.view(np.int64), text[fits])
    return out


def _marked(rows: DataFrame, id_column: str, window: int, gram: int, short: list[int], bloom, whole: bool) -> DataFrame:
    """(id, n_words, marks) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if bloom is None else np.unpackbits(np.frombuffer(bloom.value, dtype=np.uint8), bitorder="little").astype(bool)
        kind = pa.list_(pa.struct([("fp", pa.int64()), ("first", pa.int32()), ("size", pa.int32()), ("windows", pa.list_(pa.int64()))]))
        for batch in batches:
            for piece in pieces(batch):
                words, offsets = _words(piece.column("text"))
                marks = _marks(words, offsets, window, gram, short, wanted, whole)
                marks = [[{"fp": a, "first": b, "size": c, "windows": d} for a, b, c, d in x] for x in marks]
                yield pa.record_batch([piece.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(marks, kind)], names=["id", "n_words", "marks"])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, f"id {kind}, n_words bigint, marks {_MARKS}")


def _bloom(spark: SparkSession, items: DataFrame):
    """Broadcast bitmap of 2^BLOOM_BITS bits over the leading bits of the items' grams; its size is fixed."""
    bits = items.select(F.explode("marks").alias("m")).select(F.shiftrightunsigned("m.fp", 64 - BLOOM_BITS).alias("bit")).distinct()
    cells = bits.groupBy(F.shiftright("bit", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).collect()
    bitmap = np.zeros(1 << (BLOOM_BITS - 5), dtype=np.uint32)
    for row in cells:  # at most 2^(BLOOM_BITS - 5) cells
        bitmap[row.cell] = row.bits
    return spark.sparkContext.broadcast(bitmap.tobytes())


def covered(spans: Column) -> Column:
    """Number of places in the union of (start, end) spans."""
    step = lambda acc, x: F.struct(
        (acc.n + F.greatest(F.lit(0), x.end - F.greatest(x.start, acc.reach))).cast("bigint").alias("n"), F.greatest(acc.reach, x.end).cast("int").alias("reach")
    )
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("int").alias("reach")), step, lambda acc: acc.n)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each document row: (doc_id, n_words, n_hit, item_ids, contaminated).

    A word is hit if it lies in an occurrence of a benchmark window. A document
    is contaminated if a word is hit and hits are at least a twentieth of its words.
    """
    spark = documents.sparkSession
    items = stored(_marked(benchmark, "item_id", window, gram, [], None, True), "items")
    short = [r.n for r in items.filter(f"n_words > 0 and n_words < {window}").select(F.col("n_words").alias("n")).distinct().collect()]  # fewer than window
    rows = _marked(documents, "doc_id", window, gram, sorted(short), _bloom(spark, items), False)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "marks")
    item_marks = (
        items.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("item"), F.explode("marks").alias("m"))
        .select("item", F.col("m.fp").alias("fp"), F.col("m.size").alias("size"), F.col("m.windows").alias("item_windows"))
        .distinct()
    )
    doc_marks = rows.select("row", F.explode("marks").alias("m")).select("row", F.col("m.fp").alias("fp"), F.col("m.size").alias("size"), F.col("m.first").alias("first"), "m.windows")
    same = F.filter(
        F.transform("windows", lambda x, i: F.when(x == F.element_at("item_windows", i + 1), F.struct((F.col("first") + i).alias("start"), (F.col("first") + i + F.col("size")).alias("end")))),
        lambda x: x.isNotNull(),
    )
    hits = doc_marks.join(item_marks, ["fp", "size"]).select("row", "item", same.alias("spans")).filter(F.size("spans") > 0)
    hits = hits.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("item_ids"))
    hits = hits.select("row", covered(F.col("spans")).alias("n_hit"), "item_ids")
    out = rows.select("row", F.col("id").alias("doc_id"), "n_words").join(hits, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of `contamination` over all documents and items."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated"
    )


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE = {
    "op10_decontamination": f"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') w from documents),
b as (select coalesce(cast(item_id as varchar), 'null') item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') w from benchmark),
bw as (select distinct item, least(len(w), 13) n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') s
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') s from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
hit as (select r, i, bw.n, item from dw join bw on dw.s = bw.s and dw.n = bw.n),
places as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from hit) group by r),
items as (select r, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from hit group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join places using (r) left join items using (r)"""
}
