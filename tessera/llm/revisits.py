"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A revisit (304) has no body. Its full response is the latest one of the same canonical URL that is earlier, in order of
(time, record id). If both have an ETag, the weak comparison of these must hold; otherwise, if both have Last-Modified,
these must be equal; if neither can be compared the revisit is taken as it is. The result has the response's headers,
with those of the revisit that a 304 may update in their place.

One URL may have a third of all records. Records are dealt out in order of (URL, time, id), in spans of about as many
each, so one with a far-off time moves no bounds; the latest response is found within (URL, span), and where a span has
none before a revisit, from a summary that has one row for each URL and span. So no task sorts a whole URL.

Nulls: records without an id, URL or time match nothing, and a revisit of that kind is kept as unresolved; null headers
count as none. Header names are compared in lower case. Repeated records: a repeated revisit gives a row each; of repeated
responses one is used. An id may stand at several URLs or times: records are told apart by id, URL and time together. Other
columns, whatever their names, are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Headers that a 304 response updates (RFC 9110, 15.4.5), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only trace where a visitor comes from.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, user or fragment, no tracking parameters, others in order, no slash at the end."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))), "&")
    return F.when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _lower(headers: Column) -> Column:
    """Names in lower case; of several equal names the last one's value."""
    none = F.create_map().cast("map<string,string>")
    entries = F.map_entries(F.coalesce(headers, none))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.size(names) + 1), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def latest_earlier(records: DataFrame) -> DataFrame:
    """(id, url, ts, response, response_ts) of the revisits (columns id, url, ts, full boolean) that have an earlier full response, each once."""
    each = records.where("id IS NOT NULL AND url IS NOT NULL AND ts IS NOT NULL").select("id", "url", "ts", "full").distinct()
    dealt = written(each.repartitionByRange("url", "ts", "id").withColumn("span", F.spark_partition_id()), "dealt")
    before = Window.partitionBy("url", "span").orderBy("ts", "id", "full").rowsBetween(Window.unboundedPreceding, -1)
    response = F.when(F.col("full"), F.struct("ts", "id"))
    near = dealt.withColumn("r", F.last(response, ignorenulls=True).over(before)).where("NOT full")
    ends = dealt.groupBy("url", "span").agg(F.max(response).alias("last"))
    carried = ends.select("url", "span", F.last("last", ignorenulls=True).over(Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = near.join(carried, ["url", "span"], "left").withColumn("r", F.coalesce("r", "carried")).where("r IS NOT NULL")
    return found.select("id", "url", "ts", F.col("r.id").alias("response"), F.col("r.ts").alias("response_ts"))


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit of records (id, url, ts long, status int, headers map<string,string>, body): id, url (canonical), response, state, headers, body.

    Full responses are those of status 200, revisits those of 304; others are left out. state is resolved, changed (the
    validators differ) or missing (no earlier response); headers and body are null unless resolved.
    """
    all_ = records.where("status IN (200, 304)").select("id", canonical(F.col("url")).alias("url"), "ts", (F.col("status") == 200).alias("full"), _lower(F.col("headers")).alias("headers"), "body")
    found = latest_earlier(all_)
    full = all_.where("full").select("url", F.col("id").alias("response"), F.col("ts").alias("response_ts"), F.col("headers").alias("old"), F.col("body").alias("text")).dropDuplicates(["url", "response", "response_ts"])
    pairs = all_.where("NOT full").select("id", "url", "ts", "headers").join(found, ["id", "url", "ts"], "left").join(full, ["url", "response", "response_ts"], "left")
    tag, old_tag, date, old_date = F.col("headers")["etag"], F.col("old")["etag"], F.col("headers")["last-modified"], F.col("old")["last-modified"]
    same = F.when(tag.isNotNull() & old_tag.isNotNull(), _opaque(tag) == _opaque(old_tag)).when(date.isNotNull() & old_date.isNotNull(), date == old_date).otherwise(True)
    state = F.when(F.col("old").isNull(), "missing").when(same, "resolved").otherwise("changed")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    ok = F.col("state") == "resolved"
    return pairs.withColumn("state", state).select("id", "url", "response", "state", F.when(ok, merged).alias("headers"), F.when(ok, F.col("text")).alias("body"))


def records_of(pages: DataFrame) -> DataFrame:
    """WARC-like records of crawled pages (page_id, url, html): for each page its full response, and a later revisit by another spelling of its URL.

    The response of page n has the id 2n and the time 10n; its revisit has the id 2n + 1 and comes 5 to 204 units later.
    Every fifth revisit has an ETag of its own, as after a change; every seventh has none.
    """
    n, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    make = lambda id_, url, ts, status, headers, body: F.struct(id_.alias("id"), url.alias("url"), ts.alias("ts"), F.lit(status).alias("status"), F.map_filter(headers, lambda k, v: v.isNotNull()).alias("headers"), body.alias("body"))
    date = lambda ts: F.concat(F.lit("t"), ts.cast("string"))
    full = make(n * 2, F.col("url"), n * 10, 200, F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), date(n * 10)), F.col("html"))
    later = n * 10 + 5 + (n * 7) % 200
    own = F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    spelt = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    revisit = make(n * 2 + 1, spelt, later, 304, F.create_map(F.lit("etag"), own, F.lit("Content-Length"), F.lit("0"), F.lit("DATE"), date(later)), F.lit(None).cast("string"))
    return pages.select(F.explode(F.array(full, revisit)).alias("r")).select("r.*")
