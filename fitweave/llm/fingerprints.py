"""Document fingerprints by winnowing.

Every run of GRAM bytes of a text has a rolling hash. Of each window of neighbouring grams the
least hash is kept, the rightmost one of equals, with its position; one mark serves
all windows that it wins. So two texts that share ``window + GRAM - 1`` bytes share a mark,
wherever the passage stands. Long texts have windows of WIDEST grams; shorter texts have narrower ones, so that
they too have some MARKS marks. Marks of a wide window are among those of a narrow one, so marks of different
windows are compared after the finer ones have been winnowed again, from their positions alone.

The fingerprint is a string: window, n_bytes, then ``hash+distance`` of each mark in hexadecimal; `decode` reads it.
Likeness is the share of bytes, of both texts, that stand at marks which the other text has too: each mark
stands for the bytes up to the next one.

`neighbours` gives each document the next one in descending order of ids. Ids are cut into ranges of equal size at
their percentiles (an id that holds many rows is cut further, by a hash of its rows), texts are shuffled once, into
their range, and the first document of a range is copied to the range before it. Tasks read their
rows in order, two texts at a time.

Defined results: null and empty texts have the fingerprint of an empty text, which is like an empty one (1) and unlike
any other (0); a text shorter than GRAM bytes is one gram; a null id comes last, rows of one id are in the order of a
hash of their text, and each row has a result; very long texts are hashed in blocks of BLOCK bytes; other
columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.llm.bytesops import Spans, last_minima, pieces

GRAM, WIDEST, NARROWEST, MARKS, BLOCK = 16, 128, 4, 32, 1 << 20
_LOW = np.uint64(32)


def window_of(grams: int) -> int:
    """Grams in a window: a power of two, so that a text of so many grams has about MARKS windows' length or more."""
    wide = max(NARROWEST, min(WIDEST, grams // MARKS))
    return 1 << (wide.bit_length() - 1)


def winnow(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(window, positions, 32-bit hashes) of the marks of a text, in order of position."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data)
    if n <= GRAM:
        whole = Spans(data).hashes(np.zeros(1, dtype=np.int64), np.array([n])) if n else np.zeros(0, dtype=np.uint64)
        return NARROWEST, np.zeros(len(whole), dtype=np.int64), (whole >> _LOW).astype(np.uint32)
    window = window_of(n - GRAM + 1)
    places, hashes = [], []
    step = BLOCK - window - GRAM + 2  # windows that start in a block end in it
    for low in range(0, n - GRAM + 1, step):
        grams = Spans(data[low : low + BLOCK]).grams(GRAM)
        kept = np.unique(last_minima(grams, min(window, len(grams))))
        places.append(kept + low)
        hashes.append((grams[kept] >> _LOW).astype(np.uint32))
        if low + BLOCK >= n:
            break
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    places, first = np.unique(places, return_index=True)  # neighbouring blocks share windows' ends
    return window, places, hashes[first]


def coarser(n: int, window: int, wanted: int, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marks of a wider window, from those of a narrower one: the least mark of each wider window."""
    if window >= wanted or not len(places):
        return places, hashes
    grams = max(1, n - GRAM + 1)
    starts = np.unique(np.concatenate([[0], np.minimum(places + 1, max(0, grams - wanted)), np.clip(places - wanted + 1, 0, max(0, grams - wanted))]))
    lows, highs = np.searchsorted(places, starts), np.searchsorted(places, starts + wanted)
    order = np.append((hashes.astype(np.int64) << 31) + (len(places) - 1 - np.arange(len(places))), np.iinfo(np.int64).max)
    least = np.minimum.reduceat(order, np.column_stack([lows, highs]).ravel())[::2][highs > lows]
    kept = np.unique(len(places) - 1 - (least & ((1 << 31) - 1)))
    return places[kept], hashes[kept]


def encode(n: int, marks: tuple[int, np.ndarray, np.ndarray]) -> str:
    window, places, hashes = marks
    gaps = np.diff(places, prepend=0).tolist()
    return f"{window:x};{n:x};" + ",".join([f"{h:08x}+{g:x}" for h, g in zip(hashes.tolist(), gaps)])


def decode(fingerprint: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(n_bytes, window, positions, hashes)."""
    window, n, listed = fingerprint.split(";")
    pairs = [mark.split("+") for mark in listed.split(",")] if listed else []
    places = np.cumsum(np.array([int(g, 16) for _, g in pairs], dtype=np.int64))
    return int(n, 16), int(window, 16), places, np.array([int(h, 16) for h, _ in pairs], dtype=np.uint32)


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Positions (in a, in b) of equal marks; every shared span of the wider window plus GRAM - 1 bytes has one."""
    (n, v, p, x), (m, w, q, y) = decode(a), decode(b)
    (p, x), (q, y) = coarser(n, v, w, p, x), coarser(m, w, v, q, y)
    at: dict[int, list[int]] = {}
    for place, mark in zip(q.tolist(), y.tolist()):
        at.setdefault(mark, []).append(place)
    return [(place, other) for place, mark in zip(p.tolist(), x.tolist()) for other in at.get(mark, [])]


def _covered(n: int, places: np.ndarray, found: np.ndarray) -> int:
    starts = places.copy()
    starts[:1] = 0  # the first mark also stands for what comes before it
    return int(np.diff(starts, append=n)[found].sum())


def likeness(n: int, a: tuple[int, np.ndarray, np.ndarray], m: int, b: tuple[int, np.ndarray, np.ndarray]) -> float:
    """Share of the bytes of two texts at common marks, 0 to 1."""
    if not n or not m:
        return float(n == m)
    (p, x), (q, y) = coarser(n, a[0], b[0], *a[1:]), coarser(m, b[0], a[0], *b[1:])
    return (_covered(n, p, np.isin(x, y)) + _covered(m, q, np.isin(y, x))) / (n + m)


def like(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    (n, v, p, x), (m, w, q, y) = decode(a), decode(b)
    return likeness(n, (v, p, x), m, (w, q, y))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, fingerprint) of every row; nothing is shuffled."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = [(t or "").encode() for t in piece.column("text").to_pylist()]
                marks = [encode(len(t), winnow(t)) for t in texts]
                yield pa.record_batch([piece.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(marks, pa.string())], names=["doc_id", "n_bytes", "fingerprint"])

    return rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, fingerprint string")


def neighbours(documents: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text) in parts to be read in order: a part's rows by descending id, then as guest the row that follows them."""
    spark = documents.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    least = -(1 << 63)
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least))
    cuts = documents.select(place.alias("o")).agg(F.percentile_approx("o", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    cuts = sorted(cuts or [])  # one for each part
    below = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), place.alias("o"), F.xxhash64("doc_id", "text").alias("h"))
    lower, same = F.size(F.filter(below, lambda c: c < F.col("o"))), F.size(F.filter(below, lambda c: c == F.col("o")))
    share = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(least)), 32)  # in the order of h
    rows = rows.withColumn("part", (lower + F.shiftrightunsigned(share * same, 32)).cast("int"))
    tops = sorted(rows.groupBy("part").agg(F.max(F.struct("o", "h")).alias("top")).select("part", "top.o", "top.h").collect())  # a row for each part
    hosts = [(tops[(i + 1) % len(tops)].part, t.o, t.h) for i, t in enumerate(tops)]
    if not hosts:
        return rows.select("part", F.lit(False).alias("guest"), "doc_id", "text")
    guests = spark.createDataFrame(hosts, "host int, o bigint, h bigint")
    placed = rows.join(F.broadcast(guests), ["o", "h"], "left")
    seats = F.array(F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest")))
    placed = placed.select("doc_id", "text", "o", "h", F.explode(F.filter(seats, lambda s: s["part"].isNotNull())).alias("seat"))
    placed = placed.select("seat.part", "seat.guest", "doc_id", "text", "o", "h")
    return placed.repartitionById(parts, "part").sortWithinPartitions(F.desc("part"), "guest", F.desc("o"), F.desc("h")).select("part", "guest", "doc_id", "text")


def edited_likeness(documents: DataFrame) -> DataFrame:
    """Every document, its copy with the last third replaced by the beginning of the next one, and how like each other they and the next one are."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the next one

        def result(row: tuple, following: tuple) -> tuple:
            doc_id, text, size, marks = row[:4]
            third = len(text) // 3
            copy = (text[: len(text) - third] + following[1][:third]).encode()
            marks_of_copy = winnow(copy) if third else marks
            return (
                doc_id, len(text), hashlib.sha256(copy).hexdigest(), encode(size, marks), encode(len(copy), marks_of_copy),
                likeness(size, marks, len(copy), marks_of_copy), likeness(size, marks, following[2], following[3]),
            )

        for batch in batches:
            for piece in pieces(batch):
                out = []
                for part, guest, doc_id, text in zip(*(column.to_pylist() for column in piece.columns)):
                    if guest and held is None:
                        continue  # a further copy of the guest
                    raw = (text or "").encode()
                    row = (doc_id, text or "", len(raw), winnow(raw))
                    if held is not None:
                        out.append(result(held, row))
                    held = None if guest else row
                if out:
                    yield pa.record_batch([pa.array(column, type_) for column, type_ in zip(zip(*out), types(piece))], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def types(piece: pa.RecordBatch) -> list[pa.DataType]:
        return [piece.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    return neighbours(documents).mapInArrow(compare, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_fingerprints": op13_fingerprints}
ORACLE: dict[str, str] = {}
