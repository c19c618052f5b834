"""Small awkward corpora, and plain models of what the operators promise."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside.
CLASHING = ["row", "id", "h", "node", "size", "bucket", "gram", "cover", "component", "marks", "spans", "runs", "slot", "weight", "bytes", "score", "part", "file", "words", "key", "kept", "pipeline_key", "pipeline_twice"]


def sentence(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):03d}{'aeiou'[rng.randrange(5)]}" for _ in range(words))


def texts(seed: int = 3) -> list[str | None]:
    """Nulls, empties, blanks, short and long texts, copies, near copies, shared passages, other scripts."""
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (8, 60, 120, 200, 300, 80, 90)]
    near = []
    for text in base[2:5]:
        words = text.split()
        for k in (1, 2, 5, 12):
            edited = list(words)
            for place in rng.sample(range(len(words)), k):
                edited[place] = f"new{rng.randrange(99)}"
            near.append(" ".join(edited))
    shared = sentence(rng, 50)
    passages = [f"{sentence(rng, 40)}\n{shared}\n{sentence(rng, 30)}" for _ in range(4)]
    odd = ["Grüße, МИР! naïve café — ça va? 東京都 " + sentence(rng, 20), "AB ab Ab aB ab", "a", "a b c d", "A B C D", "x " * 700, "line one here\n" * 40, "\t\n \x0b\x0c\r", "é" * 300, "z" * 450]
    long = sentence(rng, 9000, 5000)
    return [None, "", " ", *base, *near, *passages, *odd, long, base[3], base[3], None, ""]


def documents(spark: SparkSession, rows: list[str | None] | None = None, first: int = 100) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)], SCHEMA)


def awkward(spark: SparkSession) -> DataFrame:
    """The same rows with null ids, null sources, a row twice, an id with two texts, and clashing columns."""
    rows = [(i if i % 7 else None, t, None, None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (5, "another text under an id that exists " + sentence(random.Random(8), 30), None, "s1", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, df.n_chars)
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def lower(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def blank_words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")
