"""Language rule, chunks and translation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.functions.constants import (
    CHUNK_CHARS, ENGLISH_MARKERS, FOREIGN_MARKERS, LANGUAGE_ALIASES, LANGUAGE_NAMES, LANGUAGE_OFF, NON_LATIN_SCRIPTS)
from fitweave.functions.text import language_tokens, let, literal_map, strip


def looks_english(text: Column) -> Column:
    """L1: share of English function words against foreign ones; blank counts as English."""
    counted = let(language_tokens(text), lambda tokens: F.struct(
        F.size(tokens).alias("n"), F.size(F.filter(tokens, lambda t: t.isin(ENGLISH_MARKERS))).alias("en"),
        F.size(F.filter(tokens, lambda t: t.isin(FOREIGN_MARKERS))).alias("other")))
    return let(counted, lambda c: _english_by_counts(text, c["n"], c["en"], c["other"]))


def _english_by_counts(text: Column, n: Column, english: Column, foreign: Column) -> Column:
    return (F.when(F.coalesce(strip(text), F.lit("")) == "", True)
            .when(text.rlike(NON_LATIN_SCRIPTS), False)
            .when(n < 12, foreign == 0)
            .when(foreign >= 4, False)
            .otherwise((english / F.greatest(n, F.lit(1)) >= 0.12) & (english > foreign)))


def language_code(value: Column) -> Column:
    """L2: supported code of a requested language; null for "off" values and unknown ones."""
    raw = strip(value)
    mapped = F.coalesce(literal_map(LANGUAGE_ALIASES)[F.lower(raw)], raw)
    prefix = F.lower(F.left(mapped, F.lit(2)))
    codes = list(LANGUAGE_NAMES)
    return F.when((raw == "") | F.lower(raw).isin(LANGUAGE_OFF), None).when(
        mapped.isin(codes), mapped).when(prefix.isin(codes), prefix)


def language_supported(value: Column) -> Column:
    """False only for values that are neither a language nor an "off" value."""
    raw = strip(value)
    return value.isNull() | (raw == "") | F.lower(raw).isin(LANGUAGE_OFF) | language_code(value).isNotNull()


def detected_code(value: Column) -> Column:
    """L2: code reported by a translation source."""
    code = F.coalesce(literal_map(LANGUAGE_ALIASES)[strip(value)], strip(value))
    prefix = F.left(code, F.lit(2))
    codes = list(LANGUAGE_NAMES)
    shaped = code.rlike(r"^[a-z]{2}(?:-[A-Za-z]{2,4})?$")
    return F.when(code.isin(codes), code).when(shaped & prefix.isin(codes), prefix)


def chunks(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """L3: paragraphs packed to at most ``limit`` characters; longer paragraphs are cut."""
    gap = "\n\n"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, part: Column) -> Column:
        full = state["open"].isNotNull() & (F.length(state["open"]) + 2 + F.length(part) > limit)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(full | state["open"].isNull(), part).otherwise(F.concat(state["open"], F.lit(gap), part)).alias("open"))

    def pieces(chunk: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(chunk), F.lit(limit)), lambda at: F.substring(chunk, at, F.lit(limit)))

    packed = F.aggregate(F.split(text, r"\n{2,}"), start, add, lambda s: F.array_append(s["done"], s["open"]))
    cut = F.flatten(F.transform(packed, lambda c: F.when(F.length(c) <= limit, F.array(c)).otherwise(
        pieces(c))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(cut)


def chunk_table(texts: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, text) -> (doc_id, chunk_no, chunk, chunk_hash)."""
    rows = texts.select("doc_id", F.posexplode(chunks(strip(F.col("text")), limit)).alias("chunk_no", "chunk"))
    return rows.withColumn("chunk_hash", F.sha2("chunk", 256))


def apply_memory(texts: DataFrame, memory: DataFrame, target: str = "en") -> DataFrame:
    """L4: translate from a memory table (chunk_hash, target, translated, detected).

    Returns every text with (source_language, translated_text, is_translated,
    n_missing); English texts are not looked up when the target is English.
    Repeated chunks of many texts meet the memory as one distinct chunk.
    """
    original = texts.withColumn("original", strip(F.coalesce(F.col("text"), F.lit(""))))
    skip = (F.col("original") == "") | (looks_english(F.col("original")) if target == "en" else F.lit(False))
    flagged = original.select("doc_id", "original", skip.alias("skip"))
    pieces = chunk_table(flagged.where(~F.col("skip")).select("doc_id", F.col("original").alias("text")))
    known = memory.where(F.col("target") == target).groupBy("chunk_hash").agg(
        F.min(F.struct("translated", "detected")).alias("m")).select("chunk_hash", "m.*")
    looked_up = pieces.select("doc_id", "chunk_no", "chunk_hash").join(known, "chunk_hash", "left")
    whole = looked_up.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "translated", "detected"))).alias("parts"),
        F.count_if(F.col("translated").isNull()).alias("n_missing"))
    whole = whole.select("doc_id", "n_missing",
                         strip(F.array_join(F.transform("parts", lambda p: p["translated"]), "\n\n")).alias("joined"),
                         detected_code(F.get(F.filter(F.transform("parts", lambda p: p["detected"]),
                                                      lambda d: d.isNotNull()), F.lit(0))).alias("found"))
    rows = flagged.join(whole, "doc_id", "left")
    done = (F.col("n_missing") == 0) & (F.col("joined") != "") & (F.coalesce("found", F.lit("")) != target) & (
        F.col("joined") != F.col("original"))
    done = F.coalesce(done, F.lit(False))
    english = F.lit("en") if target == "en" else F.lit(None).cast("string")
    return rows.select("doc_id", F.when(F.col("skip") & (F.col("original") != ""), english).otherwise(F.col("found")).alias("source_language"),
                       F.when(done, F.col("joined")).alias("translated_text"), done.alias("is_translated"),
                       F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def work_list(texts: DataFrame, memory: DataFrame, target: str = "en") -> DataFrame:
    """L4: distinct chunks an external translator still has to do."""
    open_texts = texts.where(~looks_english(F.col("text"))) if target == "en" else texts
    pieces = chunk_table(open_texts).groupBy("chunk_hash").agg(F.min("chunk").alias("chunk"), F.count("*").alias("uses"))
    return pieces.join(memory.where(F.col("target") == target).select("chunk_hash"), "chunk_hash", "left_anti")


def translation_notes(applied: DataFrame, target: str = "en") -> DataFrame:
    """L4: counts and the message of a run."""
    label = LANGUAGE_NAMES.get(target, target)
    counts = applied.agg(F.count_if("is_translated").alias("translated"), F.count_if(F.col("n_missing") > 0).alias("failed"))

    def listing(n: Column) -> Column:
        return F.when(n == 1, "listing").otherwise("listings")

    notes = F.array_compact(F.array(
        F.when(F.col("translated") > 0, F.concat(F.lit("Translated "), F.col("translated"), F.lit(" "), listing(F.col("translated")),
                                                 F.lit(f" into {label}. The original text is kept."))),
        F.when(F.col("failed") > 0, F.concat(F.lit("Could not translate "), F.col("failed"), F.lit(" "), listing(F.col("failed")),
                                             F.lit("; showing the original text.")))))
    return counts.withColumn("notes", notes)


def display_text(translated: Column, original: Column) -> Column:
    """The translation where there is one."""
    return F.coalesce(F.nullif(translated, F.lit("")), original, F.lit(""))
