"""Union, dedup, catalogue and paging rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitweave.functions.urls import workspace_url
from fitweave.session import checkpointed


def ordered_union(sources: list[DataFrame]) -> DataFrame:
    """Rows of several sources with (source_ord, ord) as their order."""
    tagged = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def greedy_dedup(rows: DataFrame, id_column: str = "identity", url_column: str = "url", order: str = "ord") -> DataFrame:
    """D3: keep a row iff no already kept row (in order) has its identity or its link; exact, not two dropDuplicates.

    A null identity or link is no key: it equals no other, so a row without both is kept.

    Rounds: a row that comes first for both its keys is kept; rows sharing a key
    with a kept row leave. Each round works on undecided key pairs only, equal pairs
    are one row, and the accept step joins on the row's own order, so a key shared by
    many rows is only ever aggregated. ``order`` must be unique.
    """
    keyless = F.col(id_column).isNull() & F.col(url_column).isNull()
    pairs = rows.where(~keyless).groupBy(F.col(id_column).alias("k1"), F.col(url_column).alias("k2")).agg(F.min(order).alias("o"))
    undecided = checkpointed(pairs)
    kept = [rows.where(keyless).select(F.col(order).alias("o"))]

    def first_of(key: str) -> DataFrame:
        """(o, key) of rows that come first for their key, and of rows without it."""
        keyed = undecided.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("o").alias("o"))
        return keyed.select("o", key).unionByName(undecided.where(F.col(key).isNull()).select("o", key))

    while not undecided.isEmpty():
        accepted = checkpointed(first_of("k1").join(first_of("k2"), "o"))
        kept.append(accepted.select("o"))
        undecided = checkpointed(undecided.join(accepted.select("k1"), "k1", "left_anti").join(accepted.select("k2"), "k2", "left_anti"))
    return rows.join(reduce(DataFrame.unionByName, kept).withColumnRenamed("o", order), order, "left_semi")


#: What a pasted description keeps of its row, and what a later row of the same posting cannot say about it.
PASTED, OUTDATED = ["description", "description_source", "skills"], ["translated_description", "translation_language"]


def upsert_catalogue(existing: DataFrame, incoming: DataFrame, keep: DataFrame) -> DataFrame:
    """Incoming rows replace the row of the same id one after the other (the last one wins), but the first pasted description
    survives with its skills, whether it was there before or came with this batch; the translation of a later row is
    cleared then. Rows neither kept nor incoming are dropped.

    existing (id, ...), incoming (id, ord, ...), keep (id); both with description, description_source, skills, translated_description.
    """
    fields = [c for c in existing.columns if c != "id"]
    own = F.struct(*[c for c in PASTED if c in fields])
    is_paste = F.col("description_source") == "pasted"
    last = incoming.groupBy("id").agg(F.max_by(F.struct(*fields), "ord").alias("new"), F.max("ord").alias("last"),
                                      F.min(F.when(is_paste, F.col("ord"))).alias("first"), F.min_by(own, F.when(is_paste, F.col("ord"))).alias("paste"))
    old = existing.select("id", F.struct(*fields).alias("old"), F.when(is_paste, own).alias("older")).join(keep.select("id").distinct().withColumn("keep", F.lit(True)), "id", "left")
    both = old.join(last, "id", "full_outer").where(F.col("new").isNotNull() | F.col("keep"))
    held = F.when(F.col("new").isNotNull(), F.coalesce("older", F.when(F.col("first") < F.col("last"), F.col("paste"))))
    both = both.withColumn("held", held)
    pasted = F.col("held").isNotNull()

    def value(name: str):
        merged = F.when(F.col("new").isNotNull(), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        if name in PASTED:
            merged = F.when(pasted, F.col(f"held.{name}")).otherwise(merged)
        if name in OUTDATED:
            merged = F.when(pasted, F.lit(None)).otherwise(merged)
        return merged.alias(name)
    return both.select("id", *[value(c) for c in fields])


def new_links(candidates: DataFrame, existing: DataFrame, url: str = "application_url") -> DataFrame:
    """Hand-added roles whose link is not in the workspace yet."""
    known = existing.select(workspace_url(F.col(url)).alias("_link")).distinct()
    return candidates.withColumn("_link", workspace_url(F.col(url))).join(known, "_link", "left_anti").drop("_link")


def crawl_pages(rows: DataFrame) -> DataFrame:
    """Rows (query_id, page, job_id) -> per page: rows, new rows and whether crawling stops there.

    A page stops the crawl when it has rows but none of them is new; pages after the first stop are not read.
    """
    first = rows.groupBy("query_id", "job_id").agg(F.min("page").alias("page"))
    fresh = first.groupBy("query_id", "page").agg(F.count("*").alias("n_new"))
    pages = rows.groupBy("query_id", "page").agg(F.count("*").alias("n_rows")).join(fresh, ["query_id", "page"], "left").withColumn(
        "n_new", F.coalesce("n_new", F.lit(0)))
    stops = pages.where("n_new = 0").groupBy("query_id").agg(F.min("page").alias("stop_page"))
    return pages.join(stops, "query_id", "left").where(F.col("stop_page").isNull() | (F.col("page") <= F.col("stop_page"))).select(
        "query_id", "page", "n_rows", "n_new", F.coalesce(F.col("page") == F.col("stop_page"), F.lit(False)).alias("stopped"))


def crawl_results(rows: DataFrame, limits: DataFrame, max_pages: int = 8) -> DataFrame:
    """Distinct rows per query in page order up to its limit, within the page budget.

    rows (query_id, page, place, job_id), limits (query_id, limit).
    """
    pages = crawl_pages(rows.where(F.col("page") < max_pages)).where("not stopped").select("query_id", "page")
    first = rows.join(pages, ["query_id", "page"]).groupBy("query_id", "job_id").agg(F.min(F.struct("page", "place")).alias("at"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "job_id"))
    return first.withColumn("rank", order).join(limits, "query_id").where(F.col("rank") <= F.col("limit")).select("query_id", "rank", "job_id", F.col("at.page").alias("page"))
