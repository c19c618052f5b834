"""Periodic runs of words, located by block convolution.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least `LEAST` words and
`EXPONENT` periods long. At scale L = 1, 2, 4, ... the periods from L to 2L - 1 are sought: words are
cut into blocks of L, and a run of such a period holds a whole block followed by its copy q words later, as
it is four periods long. For all distances at once, the sums of squared differences between a block's word
numbers and the following window are two energies less twice a correlation, which a number-theoretic transform gives
exactly modulo two primes; the sum is zero where the block occurs again. Each such distance is a seed: words at
that distance are compared outwards from the block to the first difference, so a run is confirmed on its words
and a sum that is zero modulo both primes by chance seeds nothing.

Blocks are skipped only where no seed can be new: a block with a word that does not come again within 2L - 1 words has no copy there,
and a block that lies with its window inside a run of a smaller period has copies of multiples of that period only.

Texts are independent of each other: a task numbers the words of each text in turn, so words of different
texts never agree, and handles many texts in one transform.

Defined results: null and empty texts have no words and no runs; repeated rows and null ids give a row each; ties of length and
start cannot occur, as runs of one text with equal ends are one run; a very long text is read in slices of
SLICE bytes and held as one number a word, transforms take CELLS numbers at a time or one block; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.functions.text import let
from fitweave.llm.bytesops import SPACES, pieces

LEAST, EXPONENT = 6, 4
SLICE, CELLS = 1 << 20, 1 << 19
#: Primes of the form k * 2^26 + 1, with a generator of their units.
PRIMES = {2013265921: 31, 469762049: 3}
BLANKS = r"[\x20\x09-\x0D]+"


@lru_cache(maxsize=None)
def _roots(prime: int, size: int, inverse: bool) -> list[np.ndarray]:
    """Twiddle factors for halves of 1, 2, 4, ... size / 2 numbers."""
    out, half = [], 1
    while half < size:
        root = pow(PRIMES[prime], (prime - 1) // (2 * half), prime)
        root = pow(root, -1, prime) if inverse else root
        powers = np.ones(1, dtype=np.uint64)
        while len(powers) < half:
            powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), prime)) % np.uint64(prime)])
        out.append(powers)
        half *= 2
    return out


def ntt(rows: np.ndarray, prime: int) -> np.ndarray:
    """Transform along the last axis, in bit-reversed order."""
    n, size = rows.shape
    p = np.uint64(prime)
    for roots in reversed(_roots(prime, size, False)):
        half = len(roots)
        pairs = rows.reshape(n, size // (2 * half), 2, half)
        out = np.empty_like(pairs)
        out[:, :, 0] = (pairs[:, :, 0] + pairs[:, :, 1]) % p
        out[:, :, 1] = (pairs[:, :, 0] + (p - pairs[:, :, 1])) * roots % p
        rows = out.reshape(n, size)
    return rows


def inverse_ntt(rows: np.ndarray, prime: int) -> np.ndarray:
    """Undo `ntt`."""
    n, size = rows.shape
    p = np.uint64(prime)
    for roots in _roots(prime, size, True):
        half = len(roots)
        pairs = rows.reshape(n, size // (2 * half), 2, half)
        turned = pairs[:, :, 1] * roots % p
        out = np.empty_like(pairs)
        out[:, :, 0] = (pairs[:, :, 0] + turned) % p
        out[:, :, 1] = (pairs[:, :, 0] + (p - turned)) % p
        rows = out.reshape(n, size)
    return rows * np.uint64(pow(size, -1, prime)) % p


def occurrences(words: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every copy of words[b : b + size] at distances from size to 2 * size - 1, in order.

    ``words`` are numbers from 0; the text ends where it ends, that is, a window may be shorter there.
    """
    none = np.zeros(0, dtype=np.int64)
    blocks = blocks[blocks + 2 * size <= len(words)]
    if not len(blocks):
        return none, none
    found, width = [], 2 * size
    low_word = words.min()
    for low in range(0, len(blocks), max(1, CELLS // width)):
        starts = blocks[low : low + max(1, CELLS // width)]
        places = starts[:, None] + size + np.arange(width)[None, :]
        inside = places < len(words)
        window = np.where(inside, words[np.minimum(places, len(words) - 1)] - low_word + 1, 0).astype(np.uint64)
        block = (words[starts[:, None] + np.arange(size)[None, :]] - low_word + 1).astype(np.uint64)
        zero = np.ones((len(starts), size), dtype=bool)
        for prime in PRIMES:
            p = np.uint64(prime)
            mirrored = np.zeros_like(window)
            mirrored[:, -np.arange(size) % width] = block % p
            correlation = inverse_ntt(ntt(mirrored, prime) * ntt(window % p, prime) % p, prime)[:, :size]
            energy = np.cumsum(np.concatenate([np.zeros((len(starts), 1), dtype=np.uint64), (window % p) ** np.uint64(2) % p], axis=1), axis=1)
            both = energy[:, size : 2 * size] - energy[:, :size] + ((block % p) ** np.uint64(2) % p).sum(axis=1, dtype=np.uint64)[:, None]
            zero &= both % p == correlation * np.uint64(2) % p
        row, distance = np.nonzero(zero)
        found.append((starts[row], distance + size))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two equally long arrays."""
    low, step = 0, 32
    while low < len(a):
        differ = np.flatnonzero(a[low : low + step] != b[low : low + step])
        if len(differ):
            return low + int(differ[0])
        low, step = low + step, step * 2
    return len(a)


def _recurrence(words: np.ndarray) -> np.ndarray:
    """Distance to the next place of the same word; len(words) if there is none."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), len(words), dtype=np.int64)
    same = words[order[1:]] == words[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


class Runs:
    """Runs found so far, in the order of their starts, with the greatest end up to each."""

    def __init__(self):
        self.found: list[tuple[int, int, int]] = []  # start, end, period
        self.settle()

    def settle(self) -> None:
        self.found.sort()
        self.starts = np.array([r[0] for r in self.found], dtype=np.int64)
        self.reach = np.maximum.accumulate(np.array([r[1] for r in self.found], dtype=np.int64)) if self.found else self.starts

    def hold(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether one run holds [low, high)."""
        if not self.found:
            return np.zeros(len(low), dtype=bool)
        last = np.searchsorted(self.starts, low, side="right")
        return (last > 0) & (self.reach[last - 1] >= high)


def find_runs(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of a sequence of numbers, by start, then period; ``exponent`` is 4 or more."""
    runs, size, gaps = Runs(), 1, _recurrence(words)
    widest = gaps.copy()  # of each block, the greatest distance from one of its words to its next place
    while size * exponent <= len(words):
        blocks = np.flatnonzero(widest < 2 * size) * size
        blocks = blocks[~runs.hold(blocks, np.minimum(blocks + 3 * size - 1, len(words)))]
        starts, distances = occurrences(words, blocks, size)
        new = ~runs.hold(starts, starts + size + distances)
        ends: dict[int, int] = {}  # for each distance the end of the last stretch that agrees
        fresh = []
        for b, d in zip(starts[new].tolist(), distances[new].tolist()):
            if ends.get(d, -1) > b:
                continue
            high = b + _agreeing(words[b : len(words) - d], words[b + d :])
            low = b - _agreeing(words[:b][::-1], words[d : b + d][::-1])
            ends[d] = high
            if high - low + d >= max(least, exponent * d):
                fresh.append((low, high + d, d))
        if fresh:
            held = runs.hold(np.array([f[0] for f in fresh]), np.array([f[1] for f in fresh]))
            runs.found += [f for f, inside in zip(fresh, held.tolist()) if not inside]
            runs.settle()
        size *= 2
        half = widest[: len(widest) // 2 * 2].reshape(-1, 2).max(axis=1)  # a block without a partner at the end is no whole block
        widest = half
    return [(low, high - low, d) for low, high, d in sorted((r[0], r[1], r[2]) for r in runs.found)]


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word, distinct words) of a text."""
    known: dict[bytes, int] = {}
    out, low = [], 0
    while low < len(text):
        high = min(len(text), low + SLICE)
        if high < len(text):  # up to the next blank
            while high < len(text):
                blank = np.flatnonzero(SPACES[np.frombuffer(text[high : high + SLICE], dtype=np.uint8)])
                if len(blank):
                    high += int(blank[0])
                    break
                high = min(len(text), high + SLICE)
        words = text[low:high].split()
        for word in set(words) - known.keys():
            known[word] = len(known)
        out.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        low = high
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.int64)), list(known)


def collapsed(words: np.ndarray, distinct: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that stay: of every run the first period."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(map(distinct.__getitem__, words[keep].tolist())).decode()


def periodic_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs (start, length, period) in words, and the text without their repeats."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                coded = [numbered((t or "").encode()) for t in piece.column("text").to_pylist()]
                sizes = np.array([len(words) for words, _ in coded], dtype=np.int64)
                firsts = np.cumsum(sizes) - sizes
                shift = np.cumsum([0] + [len(distinct) for _, distinct in coded])
                of_text: list[list[tuple[int, int, int]]] = [[] for _ in coded]
                for start, length, period in find_runs(np.concatenate([words + s for (words, _), s in zip(coded, shift.tolist())])):
                    t = int(np.searchsorted(firsts, start, side="right")) - 1
                    of_text[t].append((start - int(firsts[t]), length, period))
                texts = [collapsed(words, distinct, runs) for (words, distinct), runs in zip(coded, of_text)]
                listed = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in of_text]
                yield pa.record_batch([piece.column("doc_id"), pa.array(sizes), pa.array(listed, pa.list_(run)), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _looped(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document by hash repeats its words from some place on; ids without a value leave it."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def edit(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10)
        return let(n, lambda n: let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.concat_ws(
            " ", F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))))))

    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, edit)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the runs of all documents, every tenth of which is made to repeat itself."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(documents.select("doc_id", _looped(F.col("doc_id"), F.col("text").cast("string")).alias("text")))
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE = {
    "op12_periodic_runs": f"""
with crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) t from (select cast(unnest(range(256)) as bigint) i)),
d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w,
  list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))) b from documents),
h as (select r, doc_id, w, len(w) n, xor(4294967295, list_reduce(b, lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8))) h from d cross join crc),
a as (select *, h // 10 g, case when n > 0 then (h // 10) % n end a from h),
x as (select r, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) else w end w from a),
p as materialized (select r, n, w[i + 1] word, i from (select r, n, w, unnest(range(n)) i from x)),
e as (select u.r, v.i - u.i q, u.i from p u join p v on u.r = v.r and u.word = v.word and v.i > u.i and 4 * (v.i - u.i) <= u.n),
s as (select r, q, min(i) s, count(*) + q l from (select r, q, i, i - row_number() over (partition by r, q order by i) k from e) group by r, q, k having count(*) + q >= greatest({LEAST}, {EXPONENT} * q)),
u as materialized (select * from s where not exists (select 1 from s o where o.r = s.r and o.q < s.q and o.s <= s.s and o.s + o.l >= s.s + s.l)),
g as (select r, count(*) n_runs, arg_min(struct_pack(s, l, q), (-cast(l as double) / q, s, q)) best, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) lines from u group by r),
dropped as (select distinct r, unnest(range(s + q, s + l)) i from u),
kept as (select r, string_agg(word, ' ' order by i) t from p anti join dropped using (r, i) group by r)
select doc_id, cast(coalesce(n_runs, 0) as bigint) n_runs, cast(best.s as bigint) as start, cast(best.l as bigint) as length, cast(best.q as bigint) as period, cast(1000 * best.l // best.q as bigint) exponent_milli,
  sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256, cast(n as bigint) n_words from x left join g using (r) left join kept using (r)"""
}
