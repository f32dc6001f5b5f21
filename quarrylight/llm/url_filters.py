"""URL filters: a sort-merge range join of reversed-host keys with prefix rules.

A rule (host, path) fits its host and all subdomains, if the URL's path starts with the rule's path; the longest
(host and path together, then the longer host) wins. Every URL gets one key for each domain it belongs to, down to the
deepest domain that a rule names: the domain's labels in reverse, then the path. With that key a rule is a prefix, and
so an interval of the sorted keys; intervals of prefixes nest or are disjoint. Keys and rules of a domain are sorted
together and swept: each rule carries the stack of the rules that it is nested in, a key looks at the stack of the last
rule before it, and the deepest rule of that stack whose interval has not yet ended is the one in force.

Scale: only distinct (host, path) pairs are swept. Domains with over a thousandth of all keys, of which there can be a
thousand at most, are dealt out over salts, with their rules copied to each salt. The rest of a domain's keys is below
that share, so no task gets a domain whole. DataFrame operations only.

Null URLs, and URLs without ``://``, have an empty host and path, which no rule fits. A port or user name belongs to the
host as written. Equal rules with different verdicts: block wins. Repeated URLs and ids: every row keeps its own row.
Columns of the input stay, but for those named like a result column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import SHARE, as_row, lower_ascii, replace_columns, written


def with_host_and_path(df: DataFrame, url: str, row: str = "__row") -> DataFrame:
    """The row as one struct, and the URL's host and path."""
    text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    mark = F.locate("://", text)
    rest = F.when(mark > 0, F.substr(text, mark + 3)).otherwise(F.lit(""))
    out = df.select(as_row(df, row), rest.alias("rest")).withColumn("host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.substr("rest", F.length("host") + 1), r"^[^?#]*", 0)
    return out.select(row, lower_ascii(F.col("host")).alias("host"), path.alias("path"))


def reversed_host(host: str) -> F.Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(domain, path, stack): each rule with the rules that it is nested in and itself, outermost first.

    A rule's ancestors are the rules at its own proper prefixes, found by an equality join on the prefixes of those
    lengths that occur among the rules of the domain.
    """
    one = (
        rules.where("host is not null and path is not null")
        .select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max_by("verdict", F.struct(F.col("verdict") == "block", F.col("verdict"))).alias("verdict"))
        .select(reversed_host("host").alias("domain"), "host", "path", "verdict")
    )
    lengths = one.groupBy("domain").agg(F.collect_set(F.length("path")).alias("lengths"))
    prefixes = one.join(lengths, "domain").select(
        "domain", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")
    )
    found = prefixes.select("domain", F.col("path").alias("inner"), F.substr("path", F.lit(1), F.col("n")).alias("path"))
    stacked = found.join(one, ["domain", "path"]).groupBy("domain", "inner").agg(
        F.array_sort(F.collect_list(F.struct(F.length("path").alias("n"), "path", "host", "verdict"))).alias("stack")
    )
    return stacked.select("domain", F.col("inner").alias("path"), "stack")


def sweep(keys: DataFrame, stacks: DataFrame) -> DataFrame:
    """keys (domain, salt, path, host) and stacks (domain, salt, path, stack) to keys with the rule in force, or null."""
    rule = F.col("stack")
    events = stacks.select("domain", "salt", "path", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), rule)
    events = events.unionByName(
        keys.select("domain", "salt", "path", F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    )
    order = Window.partitionBy("domain", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    active = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    return swept.select("host", "path", F.try_element_at(active, F.lit(-1)).alias("rule"))


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (the rule's host and path joined, or null) and verdict (the rule's, else ``default``)."""
    rows = with_host_and_path(df, url)
    stacks = written(rule_stacks(rules), "rule-stacks")
    depth = stacks.agg(F.coalesce(F.max(F.size(F.split("domain", r"\."))), F.lit(0)).alias("depth"))
    labels = F.reverse(F.split("host", r"\."))
    levels = F.sequence(F.lit(1), F.least(F.size("labels"), F.col("depth")))
    keys = (
        rows.where("host <> ''")
        .groupBy("host", "path")
        .agg(F.lit(1).alias("one"))
        .join(F.broadcast(depth), F.col("depth") > 0)
        .withColumn("labels", labels)
        .select("host", "path", F.explode(F.transform(levels, lambda n: F.array_join(F.slice("labels", F.lit(1), n), "."))).alias("domain"))
        .join(stacks.select("domain").distinct(), "domain", "left_semi")
    )
    keys = written(keys, "url-keys")
    counts = keys.groupBy("domain").count()
    total = counts.agg(F.sum("count").alias("total"))
    # No more than SHARE domains can each hold more than a SHARE-th of the keys, which bounds what is broadcast.
    hot = F.broadcast(
        counts.join(F.broadcast(total), F.col("count") * SHARE > F.col("total")).select(
            "domain", F.ceil(F.col("count") * SHARE / F.col("total")).cast("int").alias("salts")
        )
    )
    salts = F.coalesce("salts", F.lit(1))
    salted = keys.join(hot, "domain", "left").select(
        "domain", F.pmod(F.xxhash64("host", "path"), salts).cast("int").alias("salt"), "host", "path"
    )
    copied = stacks.join(hot, "domain", "left").select(
        "domain", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "path", "stack"
    )
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(
        (F.length("rule.host") + F.length("rule.path")).alias("n"), F.length("rule.host").alias("m"),
        F.concat("rule.host", "rule.path").alias("rule"), F.col("rule.verdict").alias("verdict"),
    )))
    verdicts = (
        sweep(salted, copied).where("rule is not null").groupBy("host", "path").agg(best.alias("best"))
        .select(F.col("host").alias("h"), F.col("path").alias("p"), "best")
    )
    joined = rows.join(verdicts, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return replace_columns(joined, "__row", {
        "host": F.col("host"), "path": F.col("path"), "rule": F.col("best.rule"),
        "verdict": F.coalesce("best.verdict", F.lit(default)),
    })
