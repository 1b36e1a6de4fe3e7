"""URL filters by a sort-merge range join (DataFrame functions only).

A rule is a host, a path and a verdict. It fits its host and all subdomains, where the
URL's path starts with the rule's. A host's labels in reverse order, each followed by
a dot, are its canonical key ("news.example.net" is "net.example.news."), so the hosts
under a rule, and likewise the paths that start with a rule's path, are one interval
of the sorted keys. Intervals of prefixes are nested or apart.

``active`` sweeps rules and points together in key order. A rule opens at its key and
closes behind the last key that has it as a prefix; the number of open rules is the
height of the stack, a rule's height when it opens is its slot, and the rule in a slot
is the last one opened there. The sweep runs once over distinct hosts and the rules'
hosts, and once over the paths below each rule host that is active.

The sorted table is cut into ranges, as many as there are shuffle partitions, and only one row
per range and slot is carried over, so neither a hot host nor a rule that covers most pages
meets in one task: equal keys are spread by a hash of the point. Pages are reduced to
their distinct hosts and paths first. No rule list is broadcast by hint.

Of the rules that fit, the longest wins: most characters of host and path together, then the
longer host, then the greater text. Rules of equal host and path count once, block before allow.

Defined results: null url or one without "://": host and path empty, no rule. Null or empty
rule hosts, and rule paths that are neither empty nor begin with "/", fit nothing; a null rule path
is an empty one; a null verdict is no rule. Repeated pages each have a row. No rules: every page has the
default verdict. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions.scan import running_max_before
from poolscope.llm.tables import stored

BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "struct<length: int, host_length: int, rule: string, verdict: string>"


def host_of(url: Column) -> Column:
    """The text after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    after = F.instr(url, "://")
    return F.when(after > 0, F.substring(url, after + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def active(points: DataFrame, rules: DataFrame) -> DataFrame:
    """(point, rule) of every rule whose key is a prefix of the point's key.

    ``points`` has a text ``key`` and any ``point``, ``rules`` distinct text keys and a struct ``rule``.
    """
    spark = points.sparkSession
    at = F.col("key").cast("binary")
    rule_type, point_type = rules.schema["rule"].dataType, points.schema["point"].dataType
    no_rule, no_point = F.lit(None).cast(rule_type), F.lit(None).cast(point_type)
    opened = rules.select(at.alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step"), no_point.alias("point"), "rule")
    closed = rules.select(
        F.concat(at, F.unhex(F.lit("FF"))).alias("at"), F.lit(0), F.lit(-1), no_point.alias("point"), no_rule.alias("rule")
    )
    asked = points.select(at.alias("at"), F.lit(1), F.lit(0), "point", no_rule.alias("rule"))
    events = opened.union(closed).union(asked).withColumn("spread", F.xxhash64("point"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = stored(
        events.repartitionByRange(ranges, "at", "kind", "spread").withColumn("range", F.spark_partition_id()), "urls-sweep"
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = swept.groupBy("range").agg(F.sum("step").alias("step")).select(
        "range", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("carried")
    )
    upto = Window.partitionBy("range").orderBy("at", "kind", "spread").rowsBetween(Window.unboundedPreceding, 0)
    stack = (
        swept.withColumn("inside", F.sum("step").over(upto)).join(carried, "range")
        .withColumn("height", (F.col("inside") + F.col("carried")).cast("int"))
        .filter("step >= 0 and height > 0")
    )
    slots = F.when(F.col("rule").isNotNull(), F.array("height")).otherwise(F.sequence(F.lit(1), "height"))
    opening = F.when(F.col("rule").isNotNull(), F.struct("at", "rule"))
    slotted = stack.select("at", "kind", "range", "point", F.explode(slots).alias("slot"), opening.alias("opening"))
    topped = running_max_before(slotted, ["slot"], ["at", "kind"], F.col("range"), "opening", "top")
    return topped.filter("kind = 1").select("point", F.col("top.rule").alias("rule"))


def usable(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) of the rules that can fit a URL, each host and path once."""
    path = F.coalesce("path", F.lit(""))
    return (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), path.alias("path"), "verdict")
        .filter("host <> '' and not contains(host, '/') and (path = '' or startswith(path, '/')) and verdict is not null")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )


def judged(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rules`` has host, path, verdict."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = stored(usable(rules), "urls-rules")
    rule_hosts = rules.select(host_key(F.col("host")).alias("key"), F.struct("host").alias("rule")).distinct()
    hosts = cut.select("host").distinct().select(host_key(F.col("host")).alias("key"), F.col("host").alias("point"))
    below = active(hosts, rule_hosts).select(F.col("point").alias("host"), F.col("rule.host").alias("rule_host"))
    points = (
        cut.select("host", "path").distinct().join(below, "host")
        .select(F.concat(host_key(F.col("rule_host")), "path").alias("key"), F.struct("host", "path").alias("point"))
    )
    text = F.concat("host", "path")
    kept = F.struct(F.length(text).alias("length"), F.length("host").alias("host_length"), text.alias("rule"), "verdict")
    fitting = active(points, rules.select(F.concat(host_key(F.col("host")), "path").alias("key"), kept.cast(RULE).alias("rule")))
    longest = fitting.groupBy("point.host", "point.path").agg(F.max("rule").alias("won"))
    return cut.join(longest, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")
    )


def check_sql(rules: list[tuple[str, str, str]], default: str = ALLOW) -> str:
    """The same result in DuckDB's SQL, for a short list of rules."""
    listed = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return f"""
WITH listed(rule_host, rule_path, judged) AS (VALUES {listed}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
won AS (SELECT host, path, max({{'n': length(rule_host || rule_path), 'h': length(rule_host), 'rule': rule_host || rule_path, 'verdict': judged}}) AS best
  FROM (SELECT DISTINCT host, path FROM cut)
  JOIN listed ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{default}') AS verdict
FROM cut LEFT JOIN won USING (host, path)"""
