"""Quality rules as a bitmask ledger, in Spark expressions only.

`ledger` measures every text once and stores, beside the measurements, one bit
for each failed rule. A policy is a named, versioned set of rules; applying
one, or another version, or asking what a rule alone removes, reads only the
bits. `ablations` folds the ledger to its distinct bit patterns first, so it
costs one aggregation with a handful of rows after the map side.

Defined results: a null text counts as empty; a text without words fails the
length rule only; repeated rows give one row each; further columns are not read.
Three-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.functions.text import let
from fitweave.llm.steps import stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3

# The rules: name, and when a text fails by its measurements. The place in the list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "5 * n_exclamations > n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("bullets", "n_lines > 3 and 10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "n_lines > 3 and 10 * n_ellipsis_lines > 3 * n_lines"),
]
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a text is kept if it fails none of the rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[rule] for rule in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = [
    BASE,
    Policy("v1", BASE.rules + ("many_symbols", "repeated_lines", "short_words", "long_words")),
    Policy("v2", tuple(name for name, _ in RULES)),
]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def occurrences(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(without(text, characters))).cast("bigint")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    windows = F.when(
        F.size(words) > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))),
    )

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        beside = lambda s, k, h: F.coalesce(F.get(s, k)["h"] == h, F.lit(False))
        twice = let(ranked, lambda s: F.filter(s, lambda x, k: beside(s, k - 1, x["h"]) | beside(s, k + 1, x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)).cast("bigint")


def measurements(text: Column) -> Column:
    """Struct of all measurements of a text."""

    def of(t: Column) -> Column:
        words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
        lines = F.filter(F.split(t, "\n"), lambda line: without(line, BLANKS) != "")
        size = lambda a: F.size(a).cast("bigint")
        of_words = let(words, lambda w: F.struct(size(w).alias("n_words"), F.coalesce(repeated_words(w), F.lit(0).cast("bigint")).alias("n_repeat_words")))
        of_lines = let(
            lines,
            lambda x: F.struct(
                size(x).alias("n_lines"),
                (size(x) - size(F.array_distinct(x))).alias("n_dup_lines"),
                size(F.filter(x, lambda s: F.ltrim(s).substr(1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
                size(F.filter(x, lambda s: F.rtrim(s).endswith("...") | F.rtrim(s).endswith("…"))).alias("n_ellipsis_lines"),
            ),
        )
        letters = F.regexp_replace(t, "[^\\p{L}]+", "")
        of_letters = let(letters, lambda x: F.struct(F.char_length(x).cast("bigint").alias("n_letters"), F.char_length(F.regexp_replace(x, "[^\\p{Lu}]+", "")).cast("bigint").alias("n_capitals")))
        chars = F.char_length(without(t, BLANKS)).cast("bigint")
        return F.struct(of_words.alias("w"), of_lines.alias("l"), of_letters.alias("c"), chars.alias("word_chars"), occurrences(t, SYMBOLS).alias("n_symbols"), occurrences(t, "!").alias("n_exclamations"))

    return let(F.coalesce(text, F.lit("")), of)


def ledger(documents: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed_rules) of every row; failed_rules has the bit of each failed rule."""
    measured = documents.select("doc_id", measurements(F.col("text").cast("string")).alias("m")).select("doc_id", "m.w.*", "m.l.*", "m.c.*", "m.word_chars", "m.n_symbols", "m.n_exclamations")
    guarded = [(name, test if name == "few_words" else f"n_words > 0 and {test}") for name, test in RULES]
    bits = sum((F.when(F.expr(test), F.lit(BIT[name])).otherwise(0) for name, test in guarded), F.lit(0))
    return measured.withColumn("failed_rules", bits.cast("bigint"))


def kept_by(policy: Policy, failed: str = "failed_rules") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """(version, rule, n_docs, n_kept, n_failed, n_failed_alone, n_kept_without) for each rule of each policy."""
    patterns = entries.groupBy("failed_rules").agg(F.count("*").alias("n"))
    rules = [f"struct('{p.version}' version, '{rule}' rule, {p.mask}L mask, {BIT[rule]}L bit)" for p in policies for rule in p.rules]
    judged = patterns.select("failed_rules", "n", F.explode(F.expr(f"array({', '.join(rules)})")).alias("p")).select("failed_rules", "n", "p.*")
    failed = F.col("failed_rules").bitwiseAND(F.col("mask"))
    others = failed.bitwiseAND(F.bitwise_not(F.col("bit")))
    counts = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return judged.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"), counts(failed == 0).alias("n_kept"), counts(F.col("failed_rules").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        counts(failed == F.col("bit")).alias("n_failed_alone"), counts(others == 0).alias("n_kept_without"),
    )


def judged(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """The ledger's rows with what its bits say: kept_<version> of every policy, and of the last one the rule that alone rejects
    the text (``sole_rule``) with the number of texts that would be kept without that rule (``n_kept_without``)."""
    current = policies[-1]
    failed = F.col("failed_rules").bitwiseAND(F.lit(current.mask))
    sole = F.coalesce(*[F.when(failed == BIT[rule], F.lit(rule)) for rule in current.rules])
    rows = entries.select("*", *[kept_by(p).alias(f"kept_{p.version}") for p in policies], sole.alias("sole_rule"))
    counts = ablations(entries, [current]).select(F.col("rule").alias("sole_rule"), "n_kept_without")
    return rows.join(F.broadcast(counts), "sole_rule", "left")  # a row for each rule


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, written once; the verdicts of all policies and the ablation of the current one are read from it."""
    entries = stored(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ledger")
    kept = F.col(f"kept_{POLICIES[-1].version}")
    return judged(entries, POLICIES).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col(f"kept_{BASE.version}")).alias("base_failed"),
        (F.col(f"kept_{BASE.version}") & kept).alias("kept"), "failed_rules", *[f"kept_{p.version}" for p in POLICIES[1:]], "sole_rule", "n_kept_without",
    )


QUERIES = {"op4_rule_ledger": op4_rule_ledger}

_TESTS = " + ".join(f"case when {'' if name == 'few_words' else 'n_words > 0 and '}{test} then {BIT[name]} else 0 end" for name, test in RULES)
ORACLE = {
    "op4_rule_ledger": f"""
with t as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from t),
g as (select r, i, w[i : i + 2] g from (select r, w, unnest(range(1, len(w) - 1)) i from w where len(w) > 2)),
twice as (select r, unnest(list(i)) i from g group by r, g having count(*) > 1),
rep as (select r, count(distinct p) n from (select r, unnest(range(i, i + 3)) p from twice) group by r),
m as (select doc_id, len(w) n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols,
  len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(l) n_lines, length(regexp_replace(t, '[^!]+', '', 'g')) n_exclamations,
  length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) n_capitals,
  len(list_filter(l, lambda x: ltrim(x)[1] in ('-', '*', '•'))) n_bullet_lines, len(list_filter(l, lambda x: rtrim(x) like '%...' or rtrim(x) like '%…')) n_ellipsis_lines
  from w left join rep using (r)),
b as (select *, {_TESTS} failed_rules from m),
rules as (select * from (values {", ".join(f"('{rule}', {BIT[rule]})" for rule in POLICIES[-1].rules)}) v(rule, bit)),
ablated as (select rule, bit, count(*) filter (failed_rules & {POLICIES[-1].mask} & ~bit = 0) n_kept_without from rules cross join b group by all)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
  cast(n_repeat_words as bigint) n_repeat_words, failed_rules & {BASE.mask} <> 0 base_failed, failed_rules & {POLICIES[-1].mask} = 0 kept, cast(failed_rules as bigint) failed_rules,
  {", ".join(f"failed_rules & {p.mask} = 0 kept_{p.version}" for p in POLICIES[1:])}, rule sole_rule, n_kept_without from b left join ablated on failed_rules & {POLICIES[-1].mask} = bit"""
}
