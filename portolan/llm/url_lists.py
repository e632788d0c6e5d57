"""URL filters by dated lists: each capture is judged by the entries in force when it was fetched.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROOT_LABELS = 2   # a host is looked up under itself and its parents of as many labels or more

ACTIONS = ("block", "allow", "remove")


def host(url: Column) -> Column:
    """The lower-case host of a URL, without user, port, or a dot at the end; NULL if it
    has none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def host_and_parents(name: Column) -> Column:
    """The host and its parent domains, the longest first; a name has 127 labels at most."""
    labels = F.split(name, r"\.")
    shortest = F.least(F.size(labels), F.lit(ROOT_LABELS))
    names = F.transform(
        F.sequence(F.size(labels), shortest, F.lit(-1)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    return F.when(name.isNotNull(), names).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until) for dated entries (domain, action, at).

    An entry holds from its time until the domain's next one, the last one for good;
    `remove` ends the one before and holds nothing itself. Of entries at one time the
    one later in block, allow, remove holds. The window orders one domain's history,
    the changes of one list line, after equal entries were merged.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    dated = entries.select(F.lower("domain").alias("domain"), "action", F.col("at")).where(
        F.col("domain").isNotNull() & F.col("at").isNotNull() & (rank > 0))
    one = dated.groupBy("domain", "at").agg(F.max(F.struct(rank, "action")).alias("last")).select(
        "domain", "at", F.col("last.action").alias("action"))
    history = Window.partitionBy("domain").orderBy("at")
    return one.withColumn("until", F.lead("at").over(history)).where(
        F.col("action") != "remove").select("domain", "action", F.col("at").alias("since"), "until")


def _months(since: Column, until: Column) -> Column:
    """Number of the month of a time, and of all months between two."""
    def number(at: Column) -> Column:
        return F.year(at) * 12 + F.month(at)

    return F.sequence(number(since), number(until))


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetched_at, domain, action, since, kept) for captures (page_id,
    url, fetched_at), one row each.

    The entry in force on the most specific domain decides: the host itself before its
    parents. `kept` is false where that entry blocks. A capture that no entry covers,
    one without a host or time included, is kept with NULLs for the entry. Repeated
    rows are judged each; empty tables are fine on either side.

    As-of join by equality: validity intervals are cut at month ends, captures looked
    up by (domain, month), and the time compared within. So even a domain with a
    third of the captures and a long history is many keys, and matches of a capture
    are bounded by its host's labels. No hint: Spark broadcasts a list under its size
    limit and splits hot keys beyond it.
    """
    seen = captures.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"),
        F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at")).withColumn(
        "host", host(F.col("url"))).drop("url")
    span = seen.agg(F.struct(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last")))
    ranged = validity(entries.withColumn("at", F.col("at").cast("timestamp_ntz"))).withColumn(
        "_span", span.scalar())
    since = F.greatest("since", F.col("_span.first"))
    until = F.least(F.coalesce("until", F.col("_span.last")), F.col("_span.last"))
    listed = ranged.where(since <= until).select(
        F.col("domain").alias("_domain"), F.explode(_months(since, until)).alias("_month"),
        F.col("since").alias("_since"), F.col("until").alias("_until"), F.col("action").alias("_action"))

    month = F.year("fetched_at") * 12 + F.month("fetched_at")
    looked_up = seen.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "page_id", "host", "fetched_at", month.alias("month"),
        F.posexplode_outer(host_and_parents(F.col("host"))).alias("place", "domain"))
    in_force = (
        (F.col("domain") == F.col("_domain")) & (F.col("month") == F.col("_month"))
        & (F.col("_since") <= F.col("fetched_at"))
        & (F.col("_until").isNull() | (F.col("fetched_at") < F.col("_until"))))
    entry = F.struct("place", F.col("_domain").alias("domain"), F.col("_action").alias("action"),
                     F.col("_since").alias("since"))
    return (
        looked_up.join(listed, in_force, "left")
        .groupBy("row", "page_id", "host", "fetched_at")
        .agg(F.min(F.when(F.col("_action").isNotNull(), entry)).alias("entry"))
        .select("page_id", "host", "fetched_at", "entry.domain", "entry.action", "entry.since",
                F.coalesce(F.col("entry.action") != "block", F.lit(True)).alias("kept"))
    )
