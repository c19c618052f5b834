"""Secret scan: fixed patterns, and a randomness battery for what no pattern knows.

Patterns give the base spans and are cut out of the runs of key characters. Every part of a run that is left and long enough
is read in the smallest encoding that has all its characters, and asked two questions.

Could it be drawn uniformly from that alphabet? The battery: chi-squared over alphabet classes, runs about the
alphabet's middle, and serial correlation, combined by Fisher's method. Words, paths and names fail.

Could it be ordinary? Ordinary runs follow the corpus's own character pairs, counted over all shorter runs of all texts. The probability of a run
under uniform draws, divided by that under these pairs, exceeds 1 / p for an ordinary run with probability p at most,
whatever its length, so its inverse is a p-value of "ordinary".

Both are decided per stratum (encoding, length, and whether it has letters) by Benjamini-Hochberg over the p-values of all
documents. A span of kind "random" is a run that is rejected as ordinary, at most ``fdr`` of them wrongly as far as ordinary runs
follow the pairs, and that the battery does not reject as random. Long runs are not judged by short ones. The p-values meet on
fixed grids; only counts per stratum and grid cell are shuffled.

Defined results: null and empty texts have no spans; repeated rows give one row
each; offsets are code points, end exclusive; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from math import erfc, exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitweave.llm.bytesops import pieces, raw, runs, table
from fitweave.llm.steps import stored

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"]
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, RANDOM_LEAST = 6, 20, 24, 20
HEX_BYTES = table((0x30, 0x39), (0x61, 0x66))
KEY_BYTES = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x5F, 0x5F))
_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _LOWER
#: Encodings from the smallest alphabet to the largest; those without digits are for keys that happen to have none.
ENCODINGS = {
    "digits": _DIGITS, "hex": _DIGITS + b"abcdef", "HEX": _DIGITS + b"ABCDEF", "lower": _LOWER, "UPPER": _UPPER, "base32": _UPPER + b"234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
    "letters": _LETTERS, "lettersurl": _LETTERS + b"-_", "letters64": _LETTERS + b"+/", "lettersmixed": _LETTERS + b"+/-_",
    "base62": _DIGITS + _UPPER + _LOWER, "base64url": _UPPER + _LOWER + _DIGITS + b"-_", "base64": _UPPER + _LOWER + _DIGITS + b"+/",
    "mixed": _UPPER + _LOWER + _DIGITS + b"+/-_",
}
#: Dashes, dates and numbers must not share a stratum with keys; without letters they are read in an encoding that has some.
_UNLETTERED = re.compile(rb"[^A-Za-z]*[+/_-][^A-Za-z]*")
_CODES = {name: np.array([alphabet.find(bytes([i])) for i in range(256)]) for name, alphabet in ENCODINGS.items()}
#: Cells of the p-value grid for each factor of e, and its last cell.
GRID, LAST_CELL = 8, 400
FDR = 0.01


#: Key characters in the order of their numbers in the table of pairs; share of uniform draws mixed into it.
_KEY_ORDER = np.flatnonzero(KEY_BYTES)
_KEY_NUMBER = np.zeros(256, dtype=np.int64)
_KEY_NUMBER[_KEY_ORDER] = np.arange(len(_KEY_ORDER))
MIXED = 0.01


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(_KEY_ORDER)
    counts = np.zeros(n * n, dtype=np.int64)
    for batch in batches:
        for piece in pieces(batch):
            data, offsets = raw(piece.column("text"))
            if len(data) < 2:
                continue
            inside = KEY_BYTES[data]
            starts, ends = runs(inside, offsets)
            long = ends - starts >= RANDOM_LEAST
            for a, b in zip(starts[long].tolist(), ends[long].tolist()):
                inside[a:b] = False
            both = inside[:-1] & inside[1:]
            both[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
            numbers = _KEY_NUMBER[data]
            counts += np.bincount((numbers[:-1] * n + numbers[1:])[both], minlength=n * n)
    yield pa.record_batch([pa.array(np.arange(n * n)), pa.array(counts)], names=["pair", "n"])


def pair_costs(documents: DataFrame) -> np.ndarray:
    """-log P(next | character) of key characters, from the runs of all texts that are too short to be tested; a table of 64 x 64 numbers."""
    n = len(_KEY_ORDER)
    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(n * n)
    for r in counted.collect():
        counts[r.pair] = r.n
    counts = counts.reshape(n, n)
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    return -np.log((1 - MIXED) * share + MIXED / n)


def ordinary(token: bytes, name: str, costs: np.ndarray) -> float:
    """log of the p-value of "follows the corpus's pairs": at most 0."""
    numbers = _KEY_NUMBER[np.frombuffer(token, dtype=np.uint8)]
    return min(0.0, (len(numbers) - 1) * log(len(ENCODINGS[name])) - float(costs[numbers[:-1], numbers[1:]].sum()))


def _normal_tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def battery(token: bytes) -> tuple[str, float]:
    """(encoding, p-value of "uniformly random") of a run of key characters."""
    data = np.frombuffer(token, dtype=np.uint8)
    full = _UNLETTERED.fullmatch(token) is not None
    name = next(n for n, codes in _CODES.items() if (codes[data] >= 0).all() and not (full and n.startswith("letters")))
    size, values = len(ENCODINGS[name]), _CODES[name][data]
    n = len(values)
    classes = max(2, min(size, n // 5))
    counts = np.bincount(values * classes // size, minlength=classes)
    expected = np.bincount(np.arange(size) * classes // size, minlength=classes) * n / size
    chi, freedom = float(((counts - expected) ** 2 / expected).sum()), classes - 1
    width = 2 / (9 * freedom)
    uniform = _normal_tail(((chi / freedom) ** (1 / 3) - (1 - width)) / sqrt(width))
    high = values >= size / 2
    share = float((np.arange(size) >= size / 2).mean())
    changes = int((high[1:] != high[:-1]).sum())
    chance = 2 * share * (1 - share)
    spread = sqrt(max(1e-9, (n - 1) * chance * (1 - chance) + 2 * (n - 2) * (share * (1 - share) - chance**2) + 0.25))
    switching = min(1.0, 2 * _normal_tail(abs(changes - (n - 1) * chance) / spread))
    centred = values - (size - 1) / 2
    serial = float((centred[1:] * centred[:-1]).sum()) / ((size**2 - 1) / 12) / sqrt(n - 1)
    correlated = min(1.0, 2 * _normal_tail(abs(serial)))
    half = -sum(log(max(p, 1e-30)) for p in (uniform, switching, correlated))
    return name, min(1.0, exp(-half) * (1 + half + half**2 / 2))


def _base_spans(text: bytes, keyed: bool, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the pattern spans of one text."""
    out = [(a, 2, b) for a, b in hexes]
    if keyed:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return sorted(out)


def _random_runs(text: bytes, spans: list[tuple[int, int, int]], candidates: list[tuple[int, int]], costs: np.ndarray) -> list[tuple[int, int, str, float, float]]:
    """Parts of the runs of key characters outside the pattern spans, with stratum and the logs of both p-values."""
    out = []
    lows, highs = [], []  # the spans' union
    for low, _, high in spans:
        if lows and low <= highs[-1]:
            highs[-1] = max(highs[-1], high)
        else:
            lows.append(low)
            highs.append(high)
    for a, b in candidates:
        i = bisect_right(highs, a)
        while a < b:
            stop = min(b, lows[i]) if i < len(lows) else b
            if stop - a >= RANDOM_LEAST:
                name, p = battery(text[a:stop])
                out.append((a, stop, name if re.search(rb"[A-Za-z]", text[a:stop]) else f"{name}-unlettered", log(max(p, 1e-30)), ordinary(text[a:stop], name, costs)))
            a = highs[i] if i < len(highs) else b
            i += 1
    return out


def _cell(log_p: float) -> int:
    return min(LAST_CELL, int(-log_p * GRID))


def _scan(batches: Iterator[pa.RecordBatch], costs: np.ndarray) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    run = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("cell", pa.int32()), ("odd", pa.int32())])
    for batch in batches:
        for piece in pieces(batch):
            data, offsets = raw(piece.column("text"))
            whole = data.tobytes()
            lower, keyed = whole.lower(), set()
            for word in ASSIGN_WORDS:
                place = lower.find(word)
                while place >= 0:
                    keyed.add(int(np.searchsorted(offsets, place, side="right")) - 1)
                    place = lower.find(word, place + 1)
            found = []
            for inside, least in ((HEX_BYTES, HEX_LEAST), (KEY_BYTES, RANDOM_LEAST)):
                starts, ends = runs(inside[data], offsets)
                long = ends - starts >= least
                of_text: dict[int, list[tuple[int, int]]] = {}
                for a, b in zip(starts[long].tolist(), ends[long].tolist()):
                    t = int(np.searchsorted(offsets, a, side="right")) - 1
                    of_text.setdefault(t, []).append((a - int(offsets[t]), b - int(offsets[t])))
                found.append(of_text)
            spans_out, runs_out = [], []
            for t, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                text = whole[low:high]
                spans = _base_spans(text, t in keyed, found[0].get(t, []))
                random = _random_runs(text, spans, found[1].get(t, []), costs)
                if not spans and not random:
                    spans_out.append([])
                    runs_out.append([])
                    continue
                before = np.concatenate([[0], np.cumsum((data[low:high] & 0xC0) != 0x80)])  # code points before each byte
                spans_out.append([{"start": int(before[a]), "kind": k, "end": int(before[b])} for a, k, b in spans])
                runs_out.append(
                    [{"start": int(before[a]), "end": int(before[b]), "stratum": f"{name}:{(b - a).bit_length()}", "cell": _cell(p), "odd": _cell(q)} for a, b, name, p, q in random]
                )
            yield pa.record_batch([piece.column("doc_id"), pa.array(spans_out, pa.list_(span)), pa.array(runs_out, pa.list_(run))], names=["doc_id", "spans", "runs"])


def _rejected_from(found: DataFrame, column: str, fdr: float) -> DataFrame:
    """(stratum, least rejected cell of the column): Benjamini-Hochberg over the grid; a few rows for each stratum.

    Cell c holds p-values up to exp(-c / GRID); that upper end stands for all of them.
    """
    cells = found.groupBy("stratum", F.col(column).alias("c")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum")
    cells = cells.select("stratum", "c", F.sum("n").over(by.orderBy(F.desc("c"))).alias("at_most"), F.sum("n").over(by).alias("m"))
    return cells.where(F.exp(-F.col("c") / GRID) * F.col("m") <= fdr * F.col("at_most")).groupBy("stratum").agg(F.min("c").alias(f"{column}_from"))


def secret_spans(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, spans) of every row: spans (start, kind, end) in order; kind is a place in KINDS."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind, costs = rows.schema["doc_id"].dataType.simpleString(), pair_costs(rows)
    schema = f"doc_id {kind}, spans array<struct<start:bigint,kind:int,end:bigint>>, runs array<struct<start:bigint,end:bigint,stratum:string,cell:int,odd:int>>"
    scanned = rows.mapInArrow(lambda batches: _scan(batches, costs), schema)
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    found = scanned.select("row", F.explode("runs").alias("r")).select("row", "r.*")
    secret = found.join(_rejected_from(found, "odd", fdr), "stratum").where("odd >= odd_from")
    secret = secret.join(_rejected_from(found, "cell", fdr), "stratum", "left").where("cell_from is null or cell < cell_from")
    added = secret.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.join(added, "row", "left").select("doc_id", F.sort_array(F.concat("spans", F.coalesce("added", none))).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of `secret_spans` over all documents."""
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op8_secrets": op8_secrets}
ORACLE: dict[str, str] = {}
