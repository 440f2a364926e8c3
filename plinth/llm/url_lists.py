"""URL filters: a temporal list join.

A list is a feed of dated changes: an entry (a host or domain) is added or removed on a day.
Changes become validity intervals, and every capture is judged by the entries that were active
on the day of its fetch: those of its host and of each domain above it. The most specific
active entry decides; where a block and an allow entry are equally specific, allow wins.

Scale: DataFrame functions only. Changes are first reduced to one state for each list, entry
and day, so an entry's intervals are one short array (no longer than the feed has days) and
the as-of join is an equality join on the entry that gives at most one row for each domain
above a host; a hot host is split by the join. Pages' contents are never read.

Defined cases: a null or unreadable URL, or a null day, matches nothing and is not blocked.
Two changes of an entry on one day: it is active if one of them adds it. A removal without an
addition before it does nothing; an entry that is never removed stays active. Repeated rows
each give a row. Extra columns are left alone; host, n_active, entry and blocked replace columns
of those names, in any case of letters (as Spark compares names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A host, or an IPv6 address in brackets.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)"
ADDRESS = r"^(\[.*\]|\d+\.\d+\.\d+\.\d+)$"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and each domain above it, of two labels at least; addresses have none above."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when((n > 1) & ~host.rlike(ADDRESS), F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array(host))


def intervals(changes: DataFrame) -> DataFrame:
    """(list, entry, valid): arrays of [start, end) days from rows (list, entry, day, added)."""
    states = changes.where(F.col("entry").isNotNull() & F.col("day").isNotNull()).groupBy("list", "entry", "day").agg(F.max("added").alias("added"))
    order = Window.partitionBy("list", "entry").orderBy("day")  # one row for each day at most
    turns = states.withColumn("before", F.lag("added").over(order)).where(F.col("added") != F.coalesce("before", F.lit(False)))
    spans = turns.withColumn("until", F.lead("day").over(order)).where("added")
    return spans.groupBy("list", "entry").agg(F.array_sort(F.collect_list(F.struct(F.col("day").alias("start"), F.col("until").alias("end")))).alias("valid"))


def judged(captures: DataFrame, lists: DataFrame) -> DataFrame:
    """captures (with url and fetched, a day), host, n_active, entry (that decides) and blocked. lists: of intervals(), list 'block' or 'allow'."""
    told = ["host", "n_active", "entry", "blocked"]
    kept = [c for c in captures.columns if c.lower() not in told]
    # the captures as one column, so that none of theirs meets a name used here
    rows = captures.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host_of(F.col("url")).alias("host"), "fetched")
    # a host's captures of one day are judged once
    asked = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    keys = asked.select("host", "fetched", F.explode(domains_of(F.col("host"))).alias("entry"))
    active = F.exists("valid", lambda v: (v["start"] <= F.col("fetched")) & (v["end"].isNull() | (F.col("fetched") < v["end"])))
    hits = keys.join(lists, "entry").where(active)
    best = F.max(F.struct(F.length("entry").alias("n"), (F.col("list") == "allow").alias("allow"), F.col("entry").alias("entry"))).alias("best")
    verdicts = hits.groupBy("host", "fetched").agg(F.count("*").alias("n_active"), best)
    out = rows.join(verdicts, ["host", "fetched"], "left")
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.entry").alias("entry"), F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"))


def demo_feed(pages: DataFrame) -> DataFrame:
    """A feed that grows with the pages: each page changes its host's entry, and that of its domain, on a day of its own."""
    host = host_of(F.col("url"))
    rows = pages.select(host.alias("host"), F.when(host.rlike(ADDRESS), host).otherwise(F.substring_index(host, ".", -2)).alias("domain"), (F.col("page_id") * 37 % 365).alias("day"), (F.col("page_id") % 3 != 0).alias("added"))
    hosts = rows.select(F.when(F.length("host") % 5 == 0, "allow").otherwise("block").alias("list"), F.col("host").alias("entry"), "day", "added")
    domains = rows.select(F.lit("block").alias("list"), F.col("domain").alias("entry"), "day", (F.col("added") & (F.col("day") % 4 == 0)).alias("added"))
    return hosts.unionByName(domains)


def url_report(pages: DataFrame) -> DataFrame:
    """Each page judged by the feed at its fetch day."""
    captures = pages.select("page_id", "url", (F.col("page_id") % 365).alias("fetched"))
    return judged(captures, intervals(demo_feed(pages))).select("page_id", "host", "fetched", "n_active", "entry", "blocked")


REPORT_SQL = r"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)', 1)), '') AS host,
                  page_id % 365 AS fetched, page_id * 37 % 365 AS day, page_id % 3 <> 0 AS added FROM pages),
c AS (SELECT CASE WHEN length(host) % 5 = 0 THEN 'allow' ELSE 'block' END AS list, host AS entry, day, added FROM p
      UNION ALL SELECT 'block', CASE WHEN regexp_matches(host, '^(\[.*\]|\d+\.\d+\.\d+\.\d+)$') THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END, day, added AND day % 4 = 0 FROM p),
s AS (SELECT list, entry, day, bool_or(added) AS added FROM c WHERE entry IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
t AS (SELECT *, lag(added) OVER w AS before FROM s WINDOW w AS (PARTITION BY list, entry ORDER BY day)),
u AS (SELECT *, lead(day) OVER (PARTITION BY list, entry ORDER BY day) AS until FROM t WHERE added <> coalesce(before, false)),
i AS (SELECT * FROM u WHERE added),
h AS (SELECT p.page_id, i.list, i.entry FROM p JOIN i ON (p.host = i.entry OR ends_with(p.host, '.' || i.entry) AND NOT regexp_matches(p.host, '^(\[.*\]|\d+\.\d+\.\d+\.\d+)$')) AND i.day <= p.fetched AND (i.until IS NULL OR p.fetched < i.until)),
b AS (SELECT page_id, count(*) AS n, arg_max(entry, length(entry) * 2 + (list = 'allow')::INT) AS entry, arg_max(list, length(entry) * 2 + (list = 'allow')::INT) AS list FROM h GROUP BY page_id)
SELECT p.page_id, p.host, p.fetched, coalesce(b.n, 0)::BIGINT AS n_active, b.entry, coalesce(b.list = 'block', false) AS blocked FROM p LEFT JOIN b USING (page_id)
"""
