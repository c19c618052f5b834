"""WARC revisit resolution: an as-of join of not-modified records to earlier full responses.

A revisit takes the latest full response of the same canonical URL that is
strictly earlier (of equal times the greatest record id). Its validators are then
checked, and of its headers those that a 304 may update replace the response's.
Time is cut into spans: within a span records are ordered, from span to span only the last
response of a URL is carried, so a URL with a third of all records is as many
groups as it has spans. Bodies are not moved; the result names the response.

Defined results: a record without URL or time is "no key"; a revisit without an earlier
response is "no response"; a validator counts only where both sides have it; records with
equal times do not see each other; repeated records give one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitweave.functions.urls import canonical_url
from fitweave.llm.steps import stored

SPAN = 3600
#: Columns of a capture by page_id, its number i and the page's body hash, in SQL that Spark and DuckDB read alike.
_FULL = "(i = 0 and page_id % 23 > 0 or i = 2 and page_id % 3 = 0)"
_STATE = "case when i >= 2 and page_id % 3 = 0 then concat(body, '-2') else body end"
_CAPTURE = {
    "record_id": "page_id * 4 + i",
    "url": "case when not (i = 3 and page_id % 17 = 1) then url end",
    "at": "case when not (i = 1 and page_id % 19 = 2) then page_id * 7 + i * 2000 end",
    "kind": f"case when {_FULL} then 'response' else 'revisit' end",
    "etag": f"case when {_FULL} then {_STATE} when page_id % 7 = 3 then null when i = 2 and page_id % 5 = 0 then 'other' when page_id % 4 = 1 then concat('W/', {_STATE}) else {_STATE} end",
    "last_modified": f"case when page_id % 13 = 4 and {_FULL} then null when page_id % 2 = 0 and i = 3 and not {_FULL} then 'later' else concat('day ', page_id % 11) end",
    "digest": f"case when page_id % 9 = 5 and i = 1 and not {_FULL} then 'none of them' when page_id % 10 = 7 and not {_FULL} then null else {_STATE} end",
}
# Headers that a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """records (record_id, url, at, kind, etag, last_modified, digest, headers) -> (record_id, outcome, response_id, headers) of each revisit."""
    text_headers = F.to_json(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("key"), F.col("at").cast("bigint").alias("at"), "kind", "etag", "last_modified", "digest", text_headers.alias("headers"))
    rows = stored(rows.withColumn("span", F.floor(F.col("at") / span)), "records")
    keyed = rows.where("key is not null and at is not null")
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "last_modified", "digest", "headers"))
    ends = keyed.groupBy("key", "span").agg(F.max(full).alias("last"))
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(ends.select("key", "span", F.max("last").over(earlier).alias("carried")), "carried")
    within = Window.partitionBy("key", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = keyed.withColumn("near", F.max(full).over(within)).where("kind = 'revisit'").join(carried, ["key", "span"])
    found = found.withColumn("r", F.coalesce("near", "carried"))
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    outcome = (
        F.when(F.col("r").isNull(), "no response").when(differ(_strong(F.col("etag")), _strong(F.col("r.etag"))), "etag differs")
        .when(differ(F.col("last_modified"), F.col("r.last_modified")), "modified").when(differ(F.col("digest"), F.col("r.digest")), "digest differs").otherwise("resolved")
    )
    kind = "map<string,string>"
    new = F.map_filter(F.from_json("headers", kind), lambda k, v: F.lower(k).isin(PERMITTED))
    names = F.transform(F.map_keys(new), F.lower)
    merged = F.map_concat(F.map_filter(F.from_json("r.headers", kind), lambda k, v: ~F.array_contains(names, F.lower(k))), new)
    good = F.col("outcome") == "resolved"
    out = found.withColumn("outcome", outcome).select("record_id", "outcome", F.when(good, F.col("r.record_id")).alias("response_id"), F.when(good, merged).alias("headers"))
    lost = rows.where("kind = 'revisit' and (key is null or at is null)")
    return out.unionByName(lost.select("record_id", F.lit("no key").alias("outcome"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("response_id"), F.lit(None).cast(kind).alias("headers")))


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of every page: a response, a revisit, a changed response or a revisit, and a last revisit.

    Validators of a revisit agree with the page's last response, are weak, are missing or differ, each by a rule on the
    page's number; some pages were never fetched in full, some captures have no URL or no time.
    """
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("body"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return rows.selectExpr(*[f"{value} as {name}" for name, value in _CAPTURE.items()], "map('Date', cast(i as string), 'Content-Type', if(i = 0, 'text/html', 'x')) as headers")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages' captures."""
    out = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("record_id", "outcome", "response_id", F.col("headers")["Date"].alias("date"), F.col("headers")["Content-Type"].alias("content_type"))


QUERIES = {"op3_revisits": op3_revisits}
_CAPTURES_SQL = ", ".join(f"{value} as {name}" for name, value in _CAPTURE.items() if name != "url")
ORACLE = {
    "op3_revisits": f"""
with links as (select page_id, md5(coalesce(html, '')) body, regexp_replace(url, '#.*$', '') u from pages),
split as (select page_id, body, lower(regexp_extract(u, '^([^:]+)', 1)) || '://' || lower(regexp_extract(u, '://([^/?]*)', 1)) base, regexp_extract(u, '://[^/?]*([^?]*)', 1) path,
  list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.') and not regexp_matches(lower(p), '^(utm_|trk=|trackingid=|refid=|position=|pagenum=)'))) ps from links),
u as (select page_id, body, base || regexp_replace(path, '/+$', '') || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end url from split),
n as (select * from u cross join range(4) r(i)),
c as (select *, regexp_replace(etag, '^W/', '') tag from (select i, {_CAPTURE["url"]} as key, {_CAPTURES_SQL} from n)),
m as (select v.record_id, any_value(v.i) i, any_value(v.key is null or v."at" is null) lost, any_value(v.tag) tag, any_value(v.last_modified) mod, any_value(v.digest) digest,
  arg_max(struct_pack(id := o.record_id, i := o.i, tag := o.tag, mod := o.last_modified, digest := o.digest), (o."at", o.record_id)) filter (o.record_id is not null) r
  from c v left join c o on o.key = v.key and o."at" < v."at" and o.kind = 'response' where v.kind = 'revisit' group by v.record_id),
j as (select *, case when lost then 'no key' when r is null then 'no response' when tag <> r.tag then 'etag differs' when mod <> r.mod then 'modified' when digest <> r.digest then 'digest differs' else 'resolved' end outcome from m)
select cast(record_id as bigint) record_id, outcome, cast(case when outcome = 'resolved' then r.id end as bigint) response_id, case when outcome = 'resolved' then cast(i as varchar) end date,
  case when outcome = 'resolved' then case when r.i = 0 then 'text/html' else 'x' end end content_type from j"""
}
