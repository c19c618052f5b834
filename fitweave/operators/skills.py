"""Skill engine: vocabulary, mentions, coverage and comparison."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.functions.text import blank_to_null, let, literal_array, literal_map, quote, skill_key, strip
from fitweave.functions.vocabulary import ALIAS_GROUPS, FAMILIES, GENERIC_TERMS, KNOWN_LABELS
from fitweave.session import checkpointed

_AZURE_PRODUCTS = r"(?i)\bazure\s+(?:devops|pipelines)\b"
_TOKENS = r"[a-z0-9]+|[^\sa-z0-9]"


def plain_key(name: str) -> str:
    """Driver-side form of the skill key, for the fixed tables only."""
    text = re.sub(r"[/_\-]+", " ", name.lower().strip().replace("&", " and "))
    return " ".join(re.sub(r"[^a-z0-9+.# ]+", "", text).split())


_GENERIC_KEYS = sorted({plain_key(term) for term in GENERIC_TERMS})
_CANONICAL = {plain_key(label): group[0] for group in ALIAS_GROUPS for label in group}


def _family_roles() -> dict[str, tuple[int, bool]]:
    roles: dict[str, tuple[int, bool]] = {}
    for family, (umbrellas, tools) in enumerate(FAMILIES):
        for is_umbrella, labels in ((True, umbrellas), (False, tools)):
            for label in labels:
                canonical = _CANONICAL.get(plain_key(label), label)
                roles.setdefault(plain_key(canonical), (family, is_umbrella))
    return roles


_ROLES = _family_roles()


def base_labels() -> list[str]:
    """Distinct base vocabulary in search order, generic terms removed."""
    family_labels = [label for pair in FAMILIES for labels in pair for label in labels]
    alias_labels = [label for group in ALIAS_GROUPS for label in group]
    kept: dict[str, str] = {}
    for label in [*KNOWN_LABELS, *family_labels, *alias_labels]:
        if plain_key(label) not in _GENERIC_KEYS:
            kept.setdefault(label.lower(), label)
    return list(kept.values())


def is_generic(name: Column) -> Column:
    """K2: posting phrases that are no technical skill."""
    return skill_key(name).isin(_GENERIC_KEYS)


def canonical_skill(name: Column) -> Column:
    """K3: canonical spelling of an aliased tool, else the trimmed name."""
    return F.coalesce(literal_map(_CANONICAL)[skill_key(name)], strip(name))


def canonical_key(name: Column) -> Column:
    return skill_key(canonical_skill(name))


def _role(name: Column, part: int) -> Column:
    return literal_map({key: role[part] for key, role in _ROLES.items()})[canonical_key(name)]


def base_vocabulary(spark: SparkSession) -> DataFrame:
    """The fixed labels as a dimension (ord, label); its size is a constant of the code."""
    return spark.createDataFrame(list(enumerate(base_labels())), "ord int, label string")


def vocabulary(base: DataFrame, extras: DataFrame) -> DataFrame:
    """K4: base labels then extra labels (ord, label), first spelling per lower-case form."""
    rows = base.select(F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), "label").unionByName(
        extras.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), "label"))
    rows = rows.withColumn("label", blank_to_null("label")).where("label is not null").where(~is_generic(F.col("label")))
    # min over (part, ord) combines before the shuffle, however often a label repeats
    return rows.groupBy(F.lower("label").alias("lower_label")).agg(
        F.min(F.struct("part", "ord", "label")).alias("first")).select("lower_label", "first.*")


# --- K5 mentions -----------------------------------------------------------

def _mention_pattern(labels: list[str]) -> str:
    """One pass over the text: at every token start, the longest label that ends on a boundary."""
    longest_first = sorted((label.lower() for label in labels), key=lambda s: (-len(s), s))
    by_letter: dict[str, list[str]] = {}
    for label in longest_first:
        rest = quote(label[1:]) + (r"(?!\s+(?:devops|pipelines)\b)" if plain_key(label) == "azure" else "")
        by_letter.setdefault(label[0], []).append(rest)
    # one branch per first letter, so most token starts fail on a single character
    options = [quote(letter) + "(?:" + "|".join(rests) + ")" for letter, rests in by_letter.items()]
    letters = "".join(quote(letter) for letter in by_letter)
    return rf"(?=[{letters}])(?<![a-z0-9])(?=(" + "|".join(options) + r")(?![a-z0-9]))"


def _shorter_labels(labels: list[str]) -> dict[str, list[int]]:
    """label -> ordinals of itself and of the labels it starts with (found at the same place)."""
    lowered = [label.lower() for label in labels]
    result = {}
    for text in lowered:
        own = []
        for position, other in enumerate(lowered):
            ends_word = len(text) == len(other) or not re.match("[a-z0-9]", text[len(other):len(other) + 1])
            product = other == "azure" and re.match(r"azure\s+(devops|pipelines)\b", text)
            if text.startswith(other) and ends_word and not product:
                own.append(position)
        result[text] = own
    return result


def _may_equal_a_key(lowered: Column, longest: int) -> Column:
    """Cheap exact guard: a text with more key characters than the longest key of the vocabulary equals none."""
    return lowered.rlike(rf"^[^a-z0-9+.#&]*+(?:[a-z0-9+.#&][^a-z0-9+.#&]*+){{0,{longest}}}+$")


def base_mentions(text: Column) -> Column:
    """K5 for the base vocabulary: labels mentioned in a text, in vocabulary order."""
    labels = base_labels()
    lowered = F.lower(text)
    hits = F.array_distinct(F.regexp_extract_all(lowered, F.lit(_mention_pattern(labels)), F.lit(1)))
    closure = literal_map(_shorter_labels(labels))
    same_key: dict[str, list[int]] = {}
    for position, label in enumerate(labels):
        same_key.setdefault(plain_key(label), []).append(position)
    by_key = literal_map(same_key)
    nothing = F.array().cast("array<int>")
    whole = F.coalesce(F.when(_may_equal_a_key(lowered, max(map(len, same_key))), by_key[skill_key(text)]), nothing)
    ordinals = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(hits, lambda h: closure[h])), whole)))
    names = literal_array(labels)
    return F.coalesce(F.transform(ordinals, lambda o: F.element_at(names, o + 1)), F.array().cast("array<string>"))


def _anchor(label: Column) -> Column:
    """Longest token of a label: every text that mentions the label has this token."""
    tokens = F.regexp_extract_all(F.lower(label), F.lit(_TOKENS), F.lit(0))
    return F.array_max(F.transform(tokens, lambda t: F.struct(
        F.when(t.rlike("^[a-z0-9]"), F.length(t)).otherwise(0).alias("size"), t.alias("token"))))["token"]


def mentions_label(text: Column, label: Column) -> Column:
    """Exact check of one (text, label) row."""
    body = F.when(skill_key(label) == "azure", F.regexp_replace(text, _AZURE_PRODUCTS, "")).otherwise(text)
    pattern = F.concat(F.lit(r"(?iu)(?<![a-z0-9])"),
                       F.regexp_replace(label, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1"), F.lit(r"(?![a-z0-9])"))
    return F.contains(F.lower(text), F.lower(label)) & F.regexp_like(body, pattern)


#: What counts as a letter or digit at a label's edge when case is ignored, and longer labels' part that finds them.
_IN_WORD, _MOST_WORDS = "a-z0-9\u017f\u0131", 8
#: The ends of a text and the seams of a run with its surroundings; control characters of texts and labels give way to another one.
_END, _SEAM, _CONTROL = "\u0001", "\u0002", "\u0003"


def _folded(text: Column) -> Column:
    return F.lower(F.translate(text, "\u0130" + _END + _SEAM, "i" + _CONTROL * 2))


def _word_grams(folded: Column, lengths: list[int], longest: int, edges: tuple[int, int] | None = None) -> Column:
    """Distinct runs of so many words with what stands between them, none longer than ``longest`` characters.

    With ``edges`` each run comes with so many characters before and after it, as one string with _SEAM between the three; _END stands for the ends of the text.
    """
    ends = F.concat(F.lit(_END), folded, F.lit(_END))
    both = F.struct(F.regexp_extract_all(folded, F.lit(f"([{_IN_WORD}]+)"), F.lit(1)).alias("word"),
                    F.transform(F.regexp_extract_all(folded, F.lit(f"[{_IN_WORD}]+[^{_IN_WORD}]*"), F.lit(0)), lambda w: F.when(F.length(w) < longest, w)).alias("whole"),
                    (F.regexp_extract_all(ends, F.lit(f"[^{_IN_WORD}]+"), F.lit(0)) if edges else F.array()).alias("gaps"))

    def sided(level: Column, n: int, gaps: Column) -> Column:
        before = F.zip_with(level, gaps, lambda g, left: F.concat(F.right(left, F.lit(edges[0])), F.lit(_SEAM), g))
        after = F.slice(gaps, F.lit(n + 1), F.size(gaps))
        return F.zip_with(before, after, lambda g, right: F.concat(g, F.lit(_SEAM), F.left(right, F.lit(edges[1]))))

    def build(b: Column, level: Column, n: int, kept: list[Column]) -> Column:
        if n in lengths:
            short = F.transform(level, lambda g: F.when(F.length(g) <= longest, g))
            kept = [*kept, sided(short, n, b["gaps"]) if edges else short]
        if n == max(lengths):
            return F.array_distinct(F.array_compact(F.concat(*kept)))
        longer = F.zip_with(b["whole"], F.slice(level, F.lit(2), F.size(level)), lambda head, rest: F.concat(head, rest))
        return let(longer, lambda x: build(b, x, n + 1, kept))

    return let(both, lambda b: build(b, b["word"], 1, []))


def vocabulary_mentions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """K5 for a large vocabulary: docs (doc_id, text) x labels (label) -> (doc_id, label); doc_id is a key.

    A mention starts and ends at the edges of a text's words, or with signs that stand before or after a word. So a label is found by an
    equi-join of its words, with what stands between them, with the text's runs of as many words as some label has; signs at its
    edges are compared with those around the run, and the text is not needed again. The few labels without such words, with very
    many, or with a rule of their own are found by one sign or their first words, and are then checked on the text, all candidates of a text at once.
    """
    word = f"[{_IN_WORD}]+"
    wanted = labels.select(strip(F.col("label")).alias("label")).where("label <> ''").distinct()
    folded = _folded(F.col("label"))
    core = F.regexp_extract(folded, f"{word}(?:[^{_IN_WORD}]+{word}){{0,{_MOST_WORDS - 1}}}", 0)
    head, tail = (F.regexp_extract(folded, p, 1) for p in (f"^([^{_IN_WORD}]*)", f"([^{_IN_WORD}]*)$"))
    plain = (F.concat(head, core, tail) == folded) & (core != "") & (skill_key(F.col("label")) != "azure")
    kind = F.when(~plain, "checked").when(core == folded, "whole").otherwise("signed")
    wanted = checkpointed(wanted.select("label", skill_key(F.col("label")).alias("same_key"), kind.alias("kind"), head.alias("head"), tail.alias("tail"),
                                        F.regexp_count(core, F.lit(word)).alias("words"), F.when(core != "", core).otherwise(F.regexp_extract(folded, r"\S", 0)).alias("key")))
    # a row of each kind
    seen = {r.kind: r for r in wanted.groupBy("kind").agg(F.collect_set("words").alias("lengths"), *[F.max(F.length(c)).alias(c) for c in ("key", "same_key", "head", "tail")]).collect()}
    text, docs, found = _folded(F.col("text")), docs.where("text is not null"), []
    if "whole" in seen:
        keys = docs.select("doc_id", F.explode(_word_grams(text, seen["whole"].lengths, seen["whole"].key)).alias("key"))
        found.append(keys.join(wanted.where("kind = 'whole'").select("key", "label"), "key"))
    if "signed" in seen:
        most = seen["signed"]
        sided = docs.select("doc_id", F.explode(_word_grams(text, most.lengths, most.key, (most["head"] + 1, most["tail"] + 1))).alias("run"))
        sided = sided.select("doc_id", F.split("run", _SEAM).alias("p")).selectExpr("doc_id", "p[0] as before", "p[1] as key", "p[2] as after")
        met = sided.join(wanted.where("kind = 'signed'").select("key", "label", "head", "tail"), "key")
        fits = lambda side, sign, whole: (F.length(sign) == 0) | (whole(side, sign) & (F.length(side) > F.length(sign)))
        met = met.where(fits(F.col("before"), F.col("head"), F.endswith) & fits(F.col("after"), F.col("tail"), F.startswith))
        found.append(met.select("doc_id", "label").distinct())
    if "checked" in seen:
        lengths = [n for n in seen["checked"].lengths if n]
        keys = [_word_grams(text, lengths, seen["checked"].key)] if lengths else []
        if 0 in seen["checked"].lengths:
            keys.append(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"[^\s{_IN_WORD}]"), F.lit(0))))
        met = docs.select("doc_id", F.explode(F.concat(*keys)).alias("key")).join(wanted.where("kind = 'checked'").select("key", "label"), "key")
        met = met.groupBy("doc_id").agg(F.collect_list("label").alias("candidates")).join(docs, "doc_id")
        found.append(met.select("doc_id", F.explode(F.filter("candidates", lambda label: mentions_label(F.col("text"), label))).alias("label")))
    longest = max((r.same_key for r in seen.values()), default=0)
    short = docs.where(_may_equal_a_key(F.lower("text"), longest)).select("doc_id", "text", skill_key(F.col("text")).alias("same_key"))
    found.append(short.join(wanted.select("label", "same_key"), "same_key").where(~mentions_label(F.col("text"), F.col("label"))))
    return reduce(DataFrame.unionByName, [rows.select("doc_id", "label") for rows in found])


# --- K6 coverage -----------------------------------------------------------

def coverage(job_labels: DataFrame, profile_labels: DataFrame) -> DataFrame:
    """K6: which profile labels cover which posting labels.

    Works on distinct labels only: (job_label, profile_label, kind) with kind
    same / alias / contains / family. Tools never cover sibling tools.
    """
    jobs = job_labels.select(strip(F.col("label")).alias("job_label")).where("job_label <> ''").distinct()
    jobs = jobs.select("job_label", skill_key(F.col("job_label")).alias("job_key"),
                       canonical_skill(F.col("job_label")).alias("job_name"),
                       canonical_key(F.col("job_label")).alias("name_key"),
                       _role(F.col("job_label"), 0).alias("family"), _role(F.col("job_label"), 1).alias("umbrella"))
    mine = profile_labels.select(strip(F.col("label")).alias("profile_label")).where("profile_label <> ''").distinct()
    mine = mine.where(~is_generic(F.col("profile_label")))
    mine = mine.select("profile_label", skill_key(F.col("profile_label")).alias("own_key"),
                       canonical_key(F.col("profile_label")).alias("name_key"),
                       _role(F.col("profile_label"), 0).alias("family"))

    same = jobs.join(mine, "name_key").select(
        "job_label", "profile_label", F.when(F.col("job_key") == F.col("own_key"), 0).otherwise(1).alias("rank"))
    needles = jobs.select("job_label", F.explode(F.array_distinct(F.array("job_label", "job_name"))).alias("needle"))
    needles = needles.withColumn("anchor", _anchor(F.col("needle")))
    tokens = mine.select("profile_label", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("profile_label"), F.lit(_TOKENS), F.lit(0)))).alias("anchor"))
    contains = tokens.join(needles, "anchor").where(mentions_label(F.col("profile_label"), F.col("needle"))).select(
        "job_label", "profile_label", F.lit(2).alias("rank"))
    family = jobs.where("umbrella").join(mine.where("family is not null"), "family").select(
        "job_label", "profile_label", F.lit(3).alias("rank"))
    kinds = F.array(*[F.lit(k) for k in ("same", "alias", "contains", "family")])
    return same.unionByName(contains).unionByName(family).groupBy("job_label", "profile_label").agg(
        F.min("rank").alias("rank")).select("job_label", "profile_label", F.element_at(kinds, F.col("rank") + 1).alias("kind"))


# --- K7 comparison ---------------------------------------------------------

def first_per_tool(posting_skills: DataFrame) -> DataFrame:
    """Posting labels (posting_id, ord, label): the first label of each canonical tool, no generic terms."""
    rows = posting_skills.withColumn("label", strip(F.col("label"))).where("label <> ''").where(~is_generic(F.col("label")))
    return rows.groupBy("posting_id", canonical_key(F.col("label")).alias("tool")).agg(
        F.min(F.struct("ord", "label")).alias("first")).select("posting_id", "tool", "first.ord", "first.label")


def profile_coverage(profile_skills: DataFrame, cover: DataFrame) -> DataFrame:
    """(profile_id, job_label, via): what each profile covers and through which of its labels.

    ``via`` is empty for an identical name, else the longest profile label per tool.
    """
    mine = profile_skills.select("profile_id", "ord", strip(F.col("label")).alias("profile_label"))
    rows = mine.join(cover, "profile_label").withColumn("tool", canonical_key(F.col("profile_label")))
    per_tool = rows.groupBy("profile_id", "job_label", "tool").agg(
        F.max((F.col("kind") == "same").cast("int")).alias("same"),
        F.min("ord").alias("first_ord"),
        F.max_by("profile_label", F.struct(F.length("profile_label"), -F.col("ord"))).alias("best"))
    grouped = per_tool.groupBy("profile_id", "job_label").agg(
        F.max("same").alias("same"), F.array_sort(F.collect_list(F.struct("first_ord", "best"))).alias("found"))
    return grouped.select("profile_id", "job_label", F.when(F.col("same") == 1, F.array().cast("array<string>")).otherwise(
        F.transform("found", lambda f: f["best"])).alias("via"))


def compare(pairs: DataFrame, posting_skills: DataFrame, profile_skills: DataFrame) -> DataFrame:
    """K7: pairs (profile_id, posting_id) -> one row per posting tool with matched flag and via labels."""
    tools = checkpointed(first_per_tool(posting_skills))
    covered = profile_coverage(profile_skills, coverage(tools.select("label"), profile_skills.select("label")))
    rows = pairs.select("profile_id", "posting_id").join(tools, "posting_id")
    rows = rows.join(covered.withColumnRenamed("job_label", "label"), ["profile_id", "label"], "left")
    return rows.select("profile_id", "posting_id", "ord", F.col("label").alias("name"),
                       F.col("via").isNotNull().alias("matched"), "via")


def summarise_comparison(compared: DataFrame) -> DataFrame:
    """Matched (with via) and missing lists per pair, in posting order."""
    item = F.struct("ord", F.struct("name", "via").alias("skill"))
    return compared.groupBy("profile_id", "posting_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("matched"), F.struct("ord", "name")))).alias("m"),
        F.array_sort(F.collect_list(F.when(~F.col("matched"), F.struct("ord", "name")))).alias("x"),
        F.array_sort(F.collect_list(F.when(F.col("matched"), item)), lambda a, b: a["ord"] - b["ord"]).alias("v"),
    ).select("profile_id", "posting_id",
             F.transform("m", lambda r: r["name"]).alias("matched"),
             F.transform("x", lambda r: r["name"]).alias("missing"),
             F.transform("v", lambda r: r["skill"]).alias("evidence"))


def profile_size(profile_skills: DataFrame) -> DataFrame:
    """Number of non-blank labels per profile (the score's denominator)."""
    return profile_skills.where(F.col("label").rlike(r"(?U)\S")).groupBy("profile_id").agg(F.count("*").alias("n_profile"))


def coverage_score(n_matched: Column, n_profile: Column) -> Column:
    """K8: matched share, half-even at four decimals; 0 for an empty profile."""
    return F.when(n_profile > 0, F.bround(n_matched / n_profile, 4)).otherwise(F.lit(0.0))


# --- K12, K13 --------------------------------------------------------------

def search_terms(possible: Column, recent: Column) -> Column:
    """Up to three titles, quoted and OR-ed; null when the profile has no titles."""
    nothing = F.array().cast("array<string>")
    titles = F.when(F.size(F.coalesce(possible, nothing)) > 0, possible).otherwise(F.coalesce(recent, nothing))
    terms = F.transform(F.slice(titles, 1, 3), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"')))
    return F.nullif(F.array_join(terms, " OR "), F.lit(""))


def tidy_skill_list(items: Column, limit: int = 40) -> Column:
    """Labels equal up to blanks, '_' and '-' merged in order; the spaced spelling is
    preferred unless it is only a lower-case variant of a cased one."""
    def compact(label: Column) -> Column:
        return F.lower(F.regexp_replace(label, r"(?U)[\s_\-]+", ""))

    def better(old: Column, new: Column) -> Column:
        spaced = ~F.contains(old, F.lit(" ")) & F.contains(new, F.lit(" "))
        lower_variant = (old != F.lower(old)) & (new == F.lower(new))
        return F.when(spaced & ~lower_variant, new).otherwise(old)

    clean = F.filter(F.transform(items, strip), lambda v: compact(v) != "")
    merged = let(clean, lambda labels: F.transform(F.array_distinct(F.transform(labels, compact)), lambda key: F.aggregate(
        F.filter(labels, lambda v: compact(v) == key), F.lit(None).cast("string"),
        lambda old, new: F.when(old.isNull(), new).otherwise(better(old, new)))))
    return F.slice(merged, 1, limit)


def labels_for(name: Column) -> Column:
    """A tool's own name followed by every spelling of its alias group."""
    groups = literal_map({plain_key(group[0]): group for group in ALIAS_GROUPS})
    return F.array_distinct(F.concat(F.array(name), F.coalesce(groups[canonical_key(name)], F.array().cast("array<string>"))))
