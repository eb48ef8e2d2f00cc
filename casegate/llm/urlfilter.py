"""URL filters over time: lists of domains whose entries have dates.

Dated entries become validity intervals, and an as-of join judges every capture by
the entry that was valid when it was fetched: the most specific one among those of
its host and the domains above it. All of it is DataFrame work. Intervals are laid
over buckets of days, so the join is on (domain, bucket) and a domain with a long
history, or a host with a large part of all captures, is dealt over many keys;
captures are first reduced to different (host, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Days of a bucket.
BUCKET_DAYS = 32
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """Host of a URL in lower case without a closing dot; null if there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when(found != "", found)


def domains(name: Column) -> Column:
    """The host and all domains above it, the host first."""
    labels = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01")) / BUCKET_DAYS).cast("int")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of ``entries`` (domain, day, listed): domain, listed,
    valid_from, valid_to (not included; null: still valid).

    An entry holds until the domain's next one. Entries of one domain and day are one,
    which lists if any does. Entries without domain, day or verdict take no part.
    Following entries are found within buckets, then from bucket to bucket.
    """
    one = (
        entries.select(F.regexp_replace(F.lower("domain"), r"\.$", "").alias("domain"), F.col("day").cast("date").alias("day"), "listed")
        .where("domain is not null and domain != '' and day is not null and listed is not null")
        .groupBy("domain", "day")
        .agg(F.max("listed").alias("listed"))
        .withColumn("bucket", _bucket(F.col("day")))
    )
    firsts = one.groupBy("domain", "bucket").agg(F.min("day").alias("first"))
    onward = firsts.select("domain", "bucket", F.lead("first").over(W.partitionBy("domain").orderBy("bucket")).alias("onward"))
    within = F.lead("day").over(W.partitionBy("domain", "bucket").orderBy("day"))
    return (
        one.withColumn("following", within)
        .join(onward, ["domain", "bucket"])
        .select("domain", "listed", F.col("day").alias("valid_from"), F.coalesce("following", "onward").alias("valid_to"))
    )


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures`` (page_id, url, fetched) with its verdict.

    Returns page_id, url, fetched, host, verdict, domain, valid_from, valid_to. The
    verdict is ``blocked`` or ``allowed`` by the entry of the longest domain that was
    valid on the day it was fetched, ``unlisted`` without one, and ``invalid`` without
    a host or a day. Repeated rows are judged each.
    """
    rows = captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched"), host(F.col("url")).alias("host"))
    asked = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    keys = asked.select("host", "fetched", _bucket(F.col("fetched")).alias("bucket"), F.explode(domains(F.col("host"))).alias("domain"))
    until = asked.agg(F.max("fetched")).first()[0]  # one value; open intervals are laid out up to it
    last = F.lit(until).cast("date")
    valid = (
        intervals(entries)
        .where(F.col("valid_from") <= last)
        .withColumn("upto", F.greatest("valid_from", F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)))
        .withColumn("bucket", F.explode(F.sequence(_bucket(F.col("valid_from")), _bucket(F.col("upto")))))
        .select("domain", "bucket", "listed", "valid_from", "valid_to")
    )
    active = (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    verdicts = (
        keys.join(valid, ["domain", "bucket"])
        .where(active)
        .groupBy("host", "fetched")
        .agg(F.max(F.struct(F.length("domain").alias("length"), "domain", "listed", "valid_from", "valid_to")).alias("entry"))
    )
    listed = F.col("entry.listed")
    return rows.join(verdicts, ["host", "fetched"], "left").select(
        "page_id",
        "url",
        "fetched",
        "host",
        F.when(F.col("host").isNull() | F.col("fetched").isNull(), "invalid")
        .when(listed, "blocked")
        .when(~listed, "allowed")
        .otherwise("unlisted")
        .alias("verdict"),
        "entry.domain",
        "entry.valid_from",
        "entry.valid_to",
    )
