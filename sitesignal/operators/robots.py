"""robots.txt datasets: rules, delay, declared sitemaps and the filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions.urls import percent_decode, percent_encode, robots_path, strip_blanks
from sitesignal.operators.skew import join_by_load

LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85  ]"


RULES = "array<struct<allow:boolean,path:string>>"
_GROUP_KINDS = ["user-agent", "allow", "disallow", "crawl-delay", "request-rate"]


def _lines(body: Column) -> Column:
    """``(kind, value)`` of the lines that open, fill or end a group; the kind of an empty line is empty."""

    def fields(line: Column) -> Column:
        text = F.substring_index(line, "#", 1)
        kind = F.lower(strip_blanks(F.substring_index(text, ":", 1)))
        value = strip_blanks(percent_decode(strip_blanks(F.regexp_replace(text, r"^[^:]*:", ""))))
        return F.when(line == "", F.struct(F.lit("").alias("kind"), F.lit("").alias("value"))).when(
            text.contains(":") & kind.isin(_GROUP_KINDS), F.struct(kind.alias("kind"), value.alias("value")))

    return F.filter(F.transform(F.split(body, LINE_BREAK), fields), lambda l: l.isNotNull())


def _groups(lines: Column) -> Column:
    """Lines cut where an empty line stands and where agents follow rules; parts without agents or without rules are no groups."""

    def opens(i: Column) -> Column:
        here, before = F.get(lines, i)["kind"], F.get(lines, i - 1)["kind"]
        return (i == 0) | (here == "") | ((here == "user-agent") & (before != "user-agent"))

    at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), opens)
    cut = F.transform(at, lambda start, n: F.slice(lines, start + 1, F.coalesce(F.get(at, n + 1), F.size(lines)) - start))
    whole = F.filter(cut, lambda g: (F.get(g, F.lit(0))["kind"] == "user-agent") & F.exists(g, lambda l: l["kind"] != "user-agent"))
    return F.when(F.size(lines) > 0, whole)


def rule_path(value: Column) -> Column:
    """A rule's path as it is compared: empty parameters, query and fragment cut, then quoted."""
    bare = F.regexp_replace(value, "#$", "")
    bare = F.regexp_replace(bare, r"^([^?#]*)\?(?=#|$)", "$1")
    bare = F.regexp_replace(bare, r"^((?:[^?#]*/)?[^/;?#]*);(?=[?#]|$)", "$1")
    return percent_encode(bare)


def with_group(robots: DataFrame, key: str = "host") -> DataFrame:
    """``(key, body, rules, crawl_delay)`` of the group that applies to every agent.

    That is the first one with an agent without a name, else the first with
    the agent ``*``. A delay counts if it is a whole number, the last such one.
    Steps are columns of their own, so that each is evaluated once.
    """
    cut = robots.select(key, "body", _lines(F.col("body")).alias("_lines"))
    cut = cut.select(key, "body", _groups(F.col("_lines")).alias("_groups"))
    agents = lambda g: F.transform(F.filter(g, lambda l: l["kind"] == "user-agent"), lambda l: l["value"])
    star = F.filter("_groups", lambda g: F.array_contains(agents(g), "*"))
    nameless = F.filter("_groups", lambda g: F.array_contains(agents(g), "") & ~F.array_contains(agents(g), "*"))
    picked = cut.select(key, "body", F.coalesce(F.get(nameless, F.lit(0)), F.get(star, F.lit(0))).alias("_g"))
    listed = F.filter("_g", lambda l: l["kind"].isin("allow", "disallow"))
    rules = F.transform(listed, lambda l: F.struct(((l["kind"] == "allow") | (l["value"] == "")).alias("allow"), rule_path(l["value"]).alias("path")))
    delays = F.filter("_g", lambda l: (l["kind"] == "crawl-delay") & l["value"].rlike(r"^\p{Nd}+$"))
    # digits of any script; a number beyond all use is no delay
    plain = F.try_element_at(delays, F.lit(-1))["value"].try_cast("double")
    return picked.select(
        key, "body", F.coalesce(rules, F.array().cast(RULES)).alias("rules"), F.when(plain < float("inf"), plain).alias("crawl_delay"))


def robots_policy(robots: DataFrame, key: str = "host") -> DataFrame:
    """One row per host: ``rules`` in file order, ``crawl_delay`` and declared ``sitemaps``."""
    return with_group(robots, key).select(key, "rules", "crawl_delay", declared_in(F.col("body")).alias("sitemaps"))


def robots_rules(robots: DataFrame, key: str = "host") -> DataFrame:
    """Long form: ``(host, rule_ord, allow, path)`` for the agent ``*``."""
    rows = with_group(robots, key).select(key, F.posexplode("rules").alias("rule_ord", "_rule"))
    return rows.select(key, "rule_ord", F.col("_rule.allow").alias("allow"), F.col("_rule.path").alias("path"))


def declared_in(body: Column) -> Column:
    """URLs of the ``Sitemap:`` lines of a body, in file order."""
    lines = F.filter(F.split(body, LINE_BREAK), lambda l: l.rlike(r"(?i)^sitemap:"))
    return F.coalesce(
        F.transform(lines, lambda l: strip_blanks(F.regexp_replace(l, r"^[^:]*:", ""))),
        F.array().cast("array<string>"),
    )


def declared_sitemaps(robots: DataFrame, key: str = "host") -> DataFrame:
    return robots.select(key, F.posexplode(declared_in(F.col("body"))).alias("ord", "sitemap_url"))


def crawl_delay(robots: DataFrame, key: str = "host", enabled: bool = True) -> DataFrame:
    """``(host, crawl_delay)``; null when absent, not a whole number, or robots are ignored."""
    if not enabled:
        return robots.select(key, F.lit(None).cast("double").alias("crawl_delay"))
    return with_group(robots, key).select(key, "crawl_delay")


def is_allowed(rules: Column, path: Column) -> Column:
    """The first rule in file order that fits decides; none, or no file, allows.

    Rules are one array per host, so no row is multiplied and no second
    shuffle is needed to pick the first match.
    """
    fitting = F.filter(rules, lambda r: (r["path"] == "*") | path.startswith(r["path"]))
    return F.coalesce(F.get(fitting, F.lit(0))["allow"], F.lit(True))


def robots_filter(urls: DataFrame, policy: DataFrame, on: str = "host", url: str = "url",
                  enabled: bool = True) -> DataFrame:
    """Keep the rows whose URL the policy of their host allows."""
    if not enabled:
        return urls
    return with_allowed(urls, policy, on, url).filter("allowed").drop("allowed")


def with_allowed(urls: DataFrame, policy: DataFrame, on: str = "host", url: str = "url") -> DataFrame:
    joined = join_by_load(urls, policy.select(on, "rules"), on)
    # most hosts have no rules: the path is only quoted where there is something to match
    allowed = F.when(F.coalesce(F.size("rules"), F.lit(0)) <= 0, F.lit(True)).otherwise(
        is_allowed(F.col("rules"), robots_path(url))
    )
    return joined.withColumn("allowed", allowed).drop("rules")


def min_interval(policy: DataFrame, key: str = "host",
                 default: float = fv.DEFAULT_MIN_INTERVAL_SECONDS) -> DataFrame:
    """Seconds between requests: the default, widened but never narrowed by the declared delay."""
    return policy.select(
        key, F.greatest(F.lit(float(default)), F.coalesce("crawl_delay", F.lit(0.0))).alias("min_interval")
    )
