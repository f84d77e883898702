"""URL filters by a sort-merge range join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import Scratch

#: Hosts of rules up to which they are sent to every task, to leave out keys that no rule can meet.
BROADCAST_HOSTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPENS, ASKS, ENDS = 0, 1, 2


def lowered(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def key(host_labels: Column) -> Column:
    """The reversed host, canonical: `com.example.www`."""
    return F.array_join(host_labels, ".")


def intervals(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) as events (hk, pk, kind, state) of a sweep in order of hk, pk, kind.

    A rule is the interval of all paths of its key that begin with its path: it opens at
    the path and ends after the last path with that beginning (a byte that UTF-8 never
    has). Intervals of a key nest or lie apart. state is what stands on top of the stack of
    active rules after the event: the rule itself where it opens, the rule around it (none
    outside any) where it ends. The rule around it is the last to open one level higher.
    """
    pk = F.encode("path", "UTF-8")
    size = F.length("host") + F.length("path")
    rule = F.struct(size.alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    rows = rules.select(key(labels(F.col("host"))).alias("hk"), pk.alias("pk"), rule.alias("rule"))
    ends = F.concat("pk", F.unhex(F.lit("FF")))
    events = rows.select("hk", F.explode(F.array(F.struct(F.col("pk").alias("pk"), F.lit(OPENS).alias("kind"), F.lit(1).alias("step"), "rule"), F.struct(ends.alias("pk"), F.lit(ENDS).alias("kind"), F.lit(-1).alias("step"), "rule"))).alias("e")).select("hk", "e.*")
    deep = running(events, ["hk"], ["pk", "kind"], sums={"depth": "step"}).where(F.col("kind") == OPENS)
    around, inner = F.struct("depth", "rule"), F.struct((F.col("depth") - 1).alias("depth"), F.lit(None).cast(rows.schema["rule"].dataType).alias("rule"))
    chain = deep.select("hk", "pk", F.col("rule").alias("own"), F.explode(F.array(around, inner)).alias("p")).select("hk", "pk", "own", F.col("p.depth").alias("level"), F.col("p.rule").alias("seen"))
    chain = running(chain, ["hk", "level"], ["pk"], lasts={"parent": "seen"}).where("seen is null")
    state = lambda c: F.struct(F.col(c).alias("rule"))
    both = F.explode(F.array(F.struct(F.col("pk").alias("pk"), F.lit(OPENS).alias("kind"), state("own").alias("state")), F.struct(ends.alias("pk"), F.lit(ENDS).alias("kind"), state("parent").alias("state"))))
    return chain.select("hk", both.alias("e")).select("hk", "e.*")


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per row of pages(page_id, url, ...): page_id, host, path, rule, verdict.

    rules(host, path, verdict): a rule fits its host and all subdomains where the url's path
    begins with the rule's; of those that fit the longest text wins, then the longer host.
    Rules that repeat count once, of different verdicts on one rule the greater (block over
    allow); a null host or path of a rule is empty, a null verdict is block. Urls that no
    rule fits have a null rule and the verdict `otherwise`; a null or empty url, or one
    without `://`, has an empty host and path and is judged like any other. Repeated rows
    and null page_ids come back as they came; very long urls are compared no further than
    the longest rule. Other columns are ignored, no pages or no rules are no error.

    Each url asks under each ending of its host, as a reversed key, at its path. Rules open
    and end at places of the same order, so one sorted sweep over both, cut into slices that
    split even equal urls, carries the top of the stack of active rules to every url. A url
    asks under no more labels than the longest rule host has, and of up to broadcast_hosts
    hosts of rules, which are counted first, under those alone.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    urls, row = scratch.numbered(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    rules = rules.select(lowered(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit("block")).alias("verdict"))
    rules = scratch.stored(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    hosts = rules.select(key(labels(F.col("host"))).alias("hk")).distinct()
    n_hosts, most_labels, longest = rules.agg(F.count_distinct("host"), F.max(F.size(labels(F.col("host")))), F.max(F.length("path"))).first()
    events = scratch.stored(intervals(rules), "events")
    parts = labels(F.col("host"))
    ask = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most_labels or 1))), lambda n: key(F.slice(parts, F.lit(1), n)))
    asked = urls.select(row, F.left("path", F.lit(longest or 0)).alias("path"), F.explode(ask).alias("hk"))
    if n_hosts <= broadcast_hosts:
        asked = asked.join(F.broadcast(hosts), "hk", "left_semi")
    nothing = F.lit(None).cast(events.schema["state"].dataType)
    asked = asked.select("hk", F.encode("path", "UTF-8").alias("pk"), F.lit(ASKS).alias("kind"), nothing.alias("state"), row)
    swept = running(asked.unionByName(events, allowMissingColumns=True), ["hk"], ["pk", "kind", row], lasts={"top": "state"})
    met = swept.where((F.col("kind") == ASKS) & F.col("top.rule").isNotNull()).select(row, F.col("top.rule").alias("best"))
    all_ = urls.unionByName(met, allowMissingColumns=True).groupBy(row)
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    got = all_.agg(one("page_id"), one("host"), one("path"), F.max("best").alias("best"))
    return got.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


# Rules of the query as (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a short list."""
    some = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r))) for r in rules))
    return spark.range(1).select(F.inline(some))


def op11_urls(pages: DataFrame) -> DataFrame:
    """judged() by RULES; urls that none fits are allowed."""
    return judged(pages, rule_table(pages.sparkSession, RULES))


OP11_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) AS r(host, path, verdict)),
urls AS (
  SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, u.host, u.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) = 1
"""
