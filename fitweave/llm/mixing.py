"""Mixing sources to target weights by Pfair scheduling, in Spark expressions only.

Every source's documents, in the order of a hash, are laid end to end and cut
into blocks of equal size. The mixture is a row of slots of one block each. With
weights w of sum W, block j of a source is released at slot floor(j * W / w) and due
by slot ceil((j + 1) * W / w); each slot goes to the released block that is due
first. As the weights fill the slots this meets every due time, so at every
slot each source is less than one block away from its target share. Weights are the shares in parts of 2^39,
so a share is met as it is, whatever the number of sources: one below a slot in a thousand gets a slot now and then.

The schedule has a row for each slot, and one task works it out: its steps are slots times sources, bounded by the
size of a block. Unless the caller sets their size, the documents of all sources are SLOTS blocks, few documents and many alike, so slots
do not grow with the data. The list of sources is a parameter's size (some thousands; more should be grouped). Rows of documents
only look their block's slot up. Positions within a source are two-level sums: per hash bucket, then
over a source's buckets; a source with a third of all rows is as many groups as it has buckets.

A mixture ends where the last source has been read once: no document of a source with a weight is left out, and a source that is read
earlier starts again, as often as its share asks for, but ``passes`` times at most. A share that asks for more is cut to so many
passes, and what it leaves goes to the other sources in proportion; deviation is counted from the shares after that. With a given
horizon the shares hold as they are, documents whose block comes later are not in it, and a source that has been read so many times leaves its slots idle.
Passes are laid end to end, so shares hold in bytes; a source smaller than a block is read once for each slot.

Defined results: a null source is a source of its own, named ""; null and empty texts count one byte; a
source without a weight has weight zero and is never in the mixture; a text larger than a block takes the slot of its first byte; repeated rows and ids each
take their place; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitweave.functions.text import let
from fitweave.llm.steps import stored

SLOTS, PASSES, BUCKETS = 1 << 16, 8, 1 << 12
#: Weights are parts of this; a schedule is worked out in runs of so many slots.
PARTS, RUN = 1 << 39, 512
#: Exponent by which the pipeline flattens the sources' own shares.
TEMPER = 0.7


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _released(block: Column, weight: Column, total: Column) -> Column:
    return _div(block * total, weight)


def _due(block: Column, weight: Column, total: Column) -> Column:
    return _div((block + 1) * total + weight - 1, weight)


def exact_weights(shares: DataFrame) -> DataFrame:
    """(source, weight) of positive shares, in parts of PARTS; every source has one part at least."""
    positive = shares.where("share > 0")
    total = positive.agg(F.sum("share")).first()[0] or 1.0
    return positive.select("source", F.greatest(F.lit(1), F.round(F.col("share") / total * PARTS)).cast("bigint").alias("weight"))


def _slots(weights: Column, total: Column, runs: int) -> Column:
    """Runs of slots, each an array of (source index << 32) + block: earliest due time first among released blocks.

    The state holds, for each source, its next block and when that is released and due.
    """

    def turn(state: Column, t: Column) -> Column:
        due = F.array_min(F.transform(state["next"], lambda x: F.when(x["released"] <= t, x["due"])))
        first = let(due, lambda d: F.array_position(F.transform(state["next"], lambda x: (x["released"] <= t) & (x["due"] == d)), F.lit(True)).cast("int") - 1)

        def taken(i: Column) -> Column:
            advanced = F.transform(state["next"], lambda x, k: F.when(k == i, _next(F.get(weights, i), x["block"] + 1)).otherwise(x))
            return F.struct(advanced.alias("next"), F.concat(state["slots"], F.array(F.shiftleft(i.cast("bigint"), 32) + F.get(state["next"], i)["block"])).alias("slots"))

        return let(first, taken)

    def _next(weight: Column, block: Column) -> Column:
        return F.struct(block.alias("block"), _released(block, weight, total).alias("released"), _due(block, weight, total).alias("due"))

    def run(state: Column, r: Column) -> Column:
        start = F.struct(state["next"].alias("next"), F.array().cast("array<bigint>").alias("slots"))
        done = F.aggregate(F.sequence(r * RUN, r * RUN + RUN - 1), start, turn)
        return let(done, lambda d: F.struct(d["next"].alias("next"), F.concat(state["runs"], F.array(d["slots"])).alias("runs")))

    begin = F.struct(F.transform(weights, lambda w: _next(w, F.lit(0).cast("bigint"))).alias("next"), F.array().cast("array<array<bigint>>").alias("runs"))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(runs - 1).cast("bigint")), begin, run, lambda a: a["runs"])


def schedule(weights: DataFrame, slots: int) -> DataFrame:
    """(source, block, slot) of the first slots; weights: (source, weight), a row for each source, of integers whose sum is at most 2^40."""
    listed = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("all"), F.sum("weight").alias("total")).where("total > 0")
    runs = max(1, -(-slots // RUN))
    slot_runs = let(F.transform("all", lambda x: x["weight"]), lambda w: _slots(w, F.col("total"), runs))
    rows = listed.select("all", F.posexplode(slot_runs).alias("run", "taken")).select("all", "run", F.posexplode("taken").alias("place", "code"))
    rows = rows.select(F.get("all", F.shiftright("code", 32).cast("int"))["source"].alias("source"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("block"),
                       (F.col("run").cast("bigint") * RUN + F.col("place")).alias("slot"))
    return rows.where(F.col("slot") < slots)


def _placed(documents: DataFrame) -> DataFrame:
    """(doc_id, source, bytes, h): what scheduling needs of each row; h orders a source's documents."""
    size = F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint")
    return documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), size.alias("bytes"), F.xxhash64("doc_id", "text").alias("h"))


def mixture(documents: DataFrame, shares: DataFrame, block_bytes: int | None = None, horizon: int | None = None, passes: int = PASSES) -> DataFrame:
    """One row for each document and pass: (doc_id, source, block, epoch, slot, released, due, kept, h).

    shares: (source, share) of the target mixture, one row a source; need not sum to one.
    block_bytes: size of a block; by default the documents' bytes by SLOTS.
    horizon: slots of the mixture; by default as many as the sources need to be read once each.
    Repeats are listed only where they are in the mixture; slot, released and due are null for sources without a
    weight, and slot is null beyond the horizon.
    """
    rows = stored(_placed(documents), "placed")
    bucket = F.shiftrightunsigned("h", 52).cast("int")  # BUCKETS ranges of the hash's order
    groups = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("bytes").alias("bytes"))
    by_source = Window.partitionBy("source")
    before = F.coalesce(F.sum("bytes").over(by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = stored(groups.select("source", "bucket", before.alias("before"), F.sum("bytes").over(by_source).alias("source_bytes")), "groups")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.withColumn("bucket", bucket).withColumn("ahead", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    start = start.join(groups.drop("source_bytes"), ["source", "bucket"]).withColumn("first", F.col("before") + F.col("ahead"))

    # from here to the schedule: a row for each source
    sizes = groups.select("source", "source_bytes").distinct().join(shares.where("share > 0").select("source", "share"), "source", "left")
    if block_bytes is None:
        block_bytes = max(1, ceil((sizes.agg(F.sum("source_bytes")).first()[0] or 0) / SLOTS))
    blocks = F.greatest(F.lit(1.0), F.col("source_bytes") / block_bytes)
    if horizon is None:
        scale = sizes.agg(F.max(blocks / F.col("share"))).first()[0] or 1.0  # so that the last source is read once
        targets = sizes.where("share is not null").select("source", F.least(F.col("share") * scale, blocks * passes).alias("share"))
    else:
        targets = shares.select("source", "share")
    weights = exact_weights(targets)
    plan = stored(sizes.drop("share").join(weights, "source", "left"), "weights")
    total = F.lit(plan.agg(F.sum("weight")).first()[0] or 0).cast("bigint")
    if horizon is None:
        horizon = plan.agg(F.max(_due(F.ceil(F.col("source_bytes") / block_bytes) - 1, F.col("weight"), total))).first()[0] or 0
        slots = stored(schedule(weights, horizon), "schedule")
        last = plan.select("source", (F.ceil(F.col("source_bytes") / block_bytes) - 1).alias("block")).join(slots, ["source", "block"])
        end = (last.agg(F.max("slot")).first()[0] or 0) + 1
    else:
        slots, end = stored(schedule(weights, horizon), "schedule"), horizon
    own = slots.where(F.col("slot") < end).groupBy("source").agg(F.count("*").alias("own"))
    pass_bytes = F.greatest(F.col("source_bytes"), F.lit(block_bytes))
    plan = plan.join(own, "source", "left").select(
        "source", "weight", pass_bytes.alias("pass_bytes"), F.least(F.greatest(F.ceil(F.col("own") * block_bytes / pass_bytes), F.lit(1)), F.lit(passes)).alias("passes"))
    plan = plan.withColumn("passes", F.coalesce("passes", F.lit(1)))
    out = start.select("doc_id", "source", "first", "h").join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)))
    out = out.withColumn("block", F.floor((F.col("first") + F.col("epoch") * F.col("pass_bytes")) / block_bytes))
    out = out.join(slots.where(F.col("slot") < end), ["source", "block"], "left").where("epoch = 0 or slot is not null")
    return out.select(
        "doc_id", "source", "block", "epoch", "slot", _released(F.col("block"), F.col("weight"), total).alias("released"), _due(F.col("block"), F.col("weight"), total).alias("due"),
        F.col("slot").isNotNull().alias("kept"), "h",
    )


def tempered_shares(documents: DataFrame, exponent: float = TEMPER) -> DataFrame:
    """(source, share): each source's bytes to a power below one, so that large sources give way to small ones."""
    return _placed(documents).groupBy("source").agg(F.pow(F.sum("bytes").cast("double"), F.lit(exponent)).alias("share"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mixture of all documents with tempered shares."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(documents, tempered_shares(documents)).drop("h")


QUERIES = {"op7_mixing": op7_mixing}
ORACLE: dict[str, str] = {}
