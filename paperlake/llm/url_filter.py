"""URL filter by rules and by empirical-Bayes host reputation, with DataFrame functions only.

Labelled pages are counted by host. A beta prior fitted to all labels is shrunk to a posterior for each
suffix, which is the prior of its registered domains, whose posteriors are the priors of their hosts.
A host is blocked when even the upper posterior bound of its share of good pages is below a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, join_hot, written

#: The rules of the query, as (action, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Suffixes of more than one label under which domains are registered.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its action; both null if none fits."""
    name = action = F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def suffix_of(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    long = F.substring_index(host, ".", -2).isin(*long_suffixes)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(counts: DataFrame, mean: str) -> float:
    """Of the beta prior of groups (n, good) around their ``mean``, by moments; between 1 and 1000.

    Sums over groups whose expected spread is known: the more the groups' shares differ beyond chance,
    the weaker the prior. One row comes back to the driver."""
    p = F.col(mean)
    chance = p * (1 - p)
    one = counts.where(F.col("n") > 1).agg(
        F.sum(F.pow(F.col("good") - F.col("n") * p, 2) / F.col("n") - chance).alias("more"),
        F.sum((F.col("n") - 1) * chance).alias("full"),
    ).first()
    if not one["full"] or one["more"] is None:
        return 10.0
    alike = min(max(one["more"] / one["full"], 1 / 1001), 0.5)
    return 1 / alike - 1


def reputation(pages: DataFrame, labels: DataFrame, z: float = 1.645) -> DataFrame:
    """One row for each host of pages (url): pages, n, good, a, b, mean, lower and upper.

    labels: (url, good boolean); rows whose good is null tell nothing. Hosts without labels get their
    domain's posterior at the strength of a host's prior, and likewise upwards; with no label at all the
    prior is Beta(1, 1). The empty host is a host of its own."""
    asked = pages.select(host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    known = labels.where(F.col("good").isNotNull()).select(host_of(F.col("url")).alias("host"), F.col("good").cast("long").alias("good"))
    known = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    hosts = asked.join(known, "host", "full").select(
        "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"),
        F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"),
    )
    hosts = written(hosts, "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    base = ((whole["good"] or 0) + 1) / ((whole["n"] or 0) + 2)

    def level(groups: DataFrame, mean: str, out: str) -> DataFrame:
        k = F.lit(_strength(groups, mean))
        return groups.withColumn(out, (F.col("good") + k * F.col(mean)) / (F.col("n") + k)).withColumn(f"{out}_k", k)

    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = level(hosts.groupBy("suffix").agg(*sums).withColumn("all_mean", F.lit(base)), "all_mean", "suffix_mean")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    domains = level(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), "suffix_mean", "domain_mean")
    out = level(hosts.join(domains.select("domain", "domain_mean"), "domain"), "domain_mean", "mean")
    a = F.col("good") + F.col("mean_k") * F.col("domain_mean")
    out = out.withColumn("a", a).withColumn("b", F.col("n") + F.col("mean_k") - a)
    half = F.lit(z) * F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    return out.select(
        "host", "domain", "suffix", "pages", "n", "good", "a", "b", "mean",
        F.greatest(F.lit(0.0), F.col("mean") - half).alias("lower"), F.least(F.lit(1.0), F.col("mean") + half).alias("upper"),
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, least: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row for each row of pages (page_id, url): host, path, rule, verdict, mean, lower and upper.

    The longest rule that fits decides; else a host is blocked when upper < least. Null urls and urls
    without :// have an empty host and path. An empty table gives no rows. Other columns aren't read."""
    hosts = written(reputation(pages, labels, z).select("host", "pages", "mean", "lower", "upper").where("pages > 0"), "reputation")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = join_hot(rows, hosts, "host", "pages")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("upper") < F.lit(least), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_host).alias("verdict"), "mean", "lower", "upper",
    )
