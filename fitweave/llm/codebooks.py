"""Vector code compression: product codes whose nearest entries are found in the Walsh-Hadamard domain, in integers.

A vector's components become integers (`SCALE` times, floor) and the vector is cut into equal parts. A part, padded with
zeros to a power of two, is transformed by the integer Walsh-Hadamard transform and its coefficients are put in sequency order, the
coarse ones first. Squared differences of coefficients sum to the padded width times the squared distance, so the sums
over the first coefficients bound it from below: the entry that is nearest after LEAD coefficients is
measured in full, and every other entry leaves as soon as its partial sum is above that. Nothing is rounded.

Each round is one scan: tasks assign their parts and return a sum and a count for each entry, Spark adds these, and the
driver holds the codebooks alone: parts x entries x width integers, whatever the number of vectors.

Defined results: rows whose vector is null, or holds a null or a component that is not finite, are left out; shorter
vectors, and lengths that the parts do not divide, are padded with zeros to the width of the longest; components saturate at
+-LIMIT; magnitudes whose distances do not fit 64 bits are counted in Python's integers; an error beyond a long is the greatest long;
the first entries are the vectors of least id (ties by the vector; a null id gives none, and if all ids are null nothing is coded), fewer than asked for if there are fewer; repeated
rows count and are coded each; null labels are one label; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.llm.steps import stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LEAD, ROWS, LIMIT, LONGEST = 2, 4096, 1 << 62, (1 << 63) - 1


def transform(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients along the last axis (a power of two long), in sequency order."""
    width, out, half = values.shape[-1], values.copy(), 1
    while half < width:
        pairs = out.reshape(*values.shape[:-1], width // (2 * half), 2, half)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(values.shape)
        half *= 2
    return out[..., sequency_order(width)]


def sequency_order(width: int) -> np.ndarray:
    """Rows of the natural transform by their number of sign changes: bit-reversed Gray code."""
    bits = width.bit_length() - 1
    gray = np.arange(width) ^ (np.arange(width) >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(width, dtype=np.int64))


def padded(parts: np.ndarray) -> np.ndarray:
    width = parts.shape[-1]
    full = 1 << (width - 1).bit_length()
    return np.concatenate([parts, np.zeros((*parts.shape[:-1], full - width), dtype=parts.dtype)], axis=-1)


def nearest(rows: np.ndarray, entries: np.ndarray, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """(entry, width times the squared distance) of each row of coefficients; the lower entry of equally near ones."""
    n, width = rows.shape
    partial = sum((rows[:, k, None] - entries[None, :, k]) ** 2 for k in range(min(lead, width)))
    first = np.argmin(partial, axis=1)
    most = ((rows - entries[first]) ** 2).sum(axis=1)
    row, entry = np.nonzero(partial <= most[:, None])
    sums = partial[row, entry]
    for k in range(lead, width):
        sums = sums + (rows[row, k] - entries[entry, k]) ** 2
        alive = sums <= most[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    heads = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(sums, heads)
    winners = np.flatnonzero(sums == least[row])  # in the order of rows, then entries
    return entry[winners[np.searchsorted(row[winners], np.arange(n))]], least


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints) of the rows that have a finite vector; ints are padded to one length."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("bigint"))
    return vectors.where(fit).select("vec_id", "label", scaled.alias("ints"))


def _exact(values: np.ndarray, other: np.ndarray, width: int) -> bool:
    """Whether distances between the two, times the padded width and summed over parts, fit 64 bits."""
    most = max((max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0) for v in (values, other))
    return 4 * most * most * width * width < 1 << 55


class Codebooks:
    """entries[part][entry] are lists of ``width`` integers."""

    def __init__(self, entries: list[list[list[int]]], width: int):
        self.entries, self.width = entries, width

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def assign(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, parts, entry, squared distance) of at most ROWS rows at a time; the last two have a column for each part."""
        books = np.array(self.entries, dtype=np.int64)
        total = len(self.entries) * self.width
        for low in range(0, batch.num_rows, ROWS):
            rows = batch.slice(low, ROWS)
            lists = rows.column("ints")
            lengths = np.asarray(lists.value_lengths())
            values = np.zeros((len(lists), total), dtype=np.int64)
            values[np.arange(total)[None, :] < lengths[:, None]] = np.asarray(lists.flatten())
            parts, own = values.reshape(len(lists), len(self.entries), self.width), books
            full = 1 << (self.width - 1).bit_length()
            if not _exact(parts, own, full):
                parts, own = parts.astype(object), own.astype(object)
            found = [nearest(transform(padded(parts[:, p])), transform(padded(own[p]))) for p in range(len(self.entries))]
            yield rows, parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] // full for f in found], axis=1)


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors of least id; None without vectors."""
    length = rows.agg(F.max(F.size("ints"))).first()[0]
    if length is None:
        return None
    width = max(1, -(-length // parts))
    least = [list(r.ints) + [0] * (width * parts - len(r.ints)) for r in rows.where("vec_id is not null").orderBy("vec_id", "ints").limit(entries).collect()]
    return Codebooks([[v[p * width : (p + 1) * width] for v in least] for p in range(parts)], width) if least else None


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; entries without parts stay."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k, width = len(books.entries), len(books.entries[0]), books.width
        total, counts = np.zeros((n, k, width), dtype=object), np.zeros((n, k), dtype=np.int64)
        for batch in batches:
            for _, parts, entry, _ in books.assign(batch):
                small = parts.dtype != object and int(np.abs(parts).max()) < 1 << 50
                for p in range(n):
                    counts[p] += np.bincount(entry[:, p], minlength=k)
                    part = np.zeros((k, width), dtype=np.int64 if small else object)
                    np.add.at(part, entry[:, p], parts[:, p])
                    total[p] += part.astype(object)
        p, e, i = (index.ravel() for index in np.indices((n, k, width + 1)))
        values = np.concatenate([counts[..., None].astype(object), total], axis=2).ravel().tolist()  # place 0 is the count
        yield pa.record_batch([pa.array(p), pa.array(e), pa.array(i), pa.array(values, pa.decimal128(38, 0))], names=["part", "entry", "place", "value"])

    schema = "part bigint, entry bigint, place bigint, value decimal(38,0)"
    added = rows.select("ints").mapInArrow(sums, schema).groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
    got = {(r.part, r.entry, r.place): int(r.value) for r in added.collect()}  # a row for each integer of the codebooks
    means = lambda p, e, old: [got[p, e, i + 1] // got[p, e, 0] for i in range(books.width)] if got.get((p, e, 0)) else old
    return Codebooks([[means(p, e, old) for e, old in enumerate(part)] for p, part in enumerate(books.entries)], books.width)


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part, and the squared distance to the coded vector."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, _, entry, distance in books.assign(batch):
                digits = pa.array([row.tobytes().hex() for row in entry.astype(np.uint8)], pa.string())
                errors = pa.array([min(int(e), LONGEST) for e in distance.sum(axis=1)] if distance.dtype == object else distance.sum(axis=1).astype(np.int64), pa.int64())
                yield pa.record_batch([some.column("vec_id"), some.column("label"), digits, errors], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "ints").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every vector that can be coded, and the codebooks (at most 256 entries)."""
    rows = stored(integers(vectors), "integers")
    books = first_books(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0), None
    for _ in range(rounds):
        books = refined(rows, books)
    return coded(rows, books), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """The error of all rows of a label beside each of its rows; labels meet as sums, so a frequent one is no large group."""
    codes = stored(codes, "codes")
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = stored(sums.select(F.col("label").alias("of"), F.least("total", F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error")), "label-errors")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with errors and the digest of the codebooks."""
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_error(codes)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _sql() -> str:
    """The rounds as one common table each; parts and components as rows."""
    distance = "(select part, entry, vec_id, sum((v.x - c.x) * (v.x - c.x)) d from v join {c} c using (part, place) group by part, entry, vec_id)"
    assigned = "(select part, vec_id, arg_min(entry, (d, entry)) entry, min(d) d from {distance} group by part, vec_id)"
    steps = [f"""n as (select vec_id, label, embedding e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as materialized (select vec_id, (i // (len(e) // {PARTS})) part, i % (len(e) // {PARTS}) place, cast(floor(cast(e[i + 1] as double) * {SCALE}) as bigint) x from n, unnest(range(len(e))) r(i)),
c0 as materialized (select part, row_number() over (partition by part, place order by vec_id) - 1 entry, place, x from v where vec_id in (select vec_id from n order by vec_id limit {ENTRIES}))"""]
    for r in range(ROUNDS):
        d = assigned.format(distance=distance.format(c=f"c{r}"))
        steps.append(f"""c{r + 1} as materialized (select part, entry, place, coalesce((s - ((s % k) + k) % k) // k, x) x from c{r} left join
  (select part, entry, place, cast(sum(x) as bigint) s, count(*) k from v join {d} using (part, vec_id) group by part, entry, place) using (part, entry, place))""")
    d = assigned.format(distance=distance.format(c=f"c{ROUNDS}"))
    return f"""with {", ".join(steps)},
f as (select vec_id, string_agg(printf('%02x', cast(entry as integer)), '' order by part) code, cast(sum(d) as bigint) error from {d} group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, place)) from c{ROUNDS}) codebooks_sha256 from f join n using (vec_id)"""


ORACLE = {"op11_vector_codes": _sql()}
