"""URL filters: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled pages are counted per host. A host's rate of bad pages is shrunk to its
registered domain's, that to its suffix's, and that to the overall rate: each
level's posterior mean is the prior mean of the level below, with a strength
fitted by moments over the groups of that level. A page is blocked when the lower
bound of its host's posterior is above ``max_bad``, by default the overall rate: the
host is worse than all pages together, with the certainty that ``z`` stands for.

Pages are read twice: to count labelled pages by host, which makes a stage table of a
row a host, and for the verdicts. Aggregates combine on the map side; the join back to
pages is on a key with one row on the other side, so that a hot host is split by
adaptive execution. All levels above hosts come from the stage table.

Defined results: a null url or one without "://" has an empty host and path, fits
no rule, and gets the verdict of the prior of all hosts (as an empty host of its
own). Pages without a label count as unlabelled; a host without labels gets its
prior. A page of several outcomes counts as the worst; null outcomes are none. A port
belongs to the host but not to its registered domain or suffix. Repeated rows each get
their verdict, very long urls are read whole, extra columns are ignored. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One-sided normal quantile of the posterior bound (84 %).
Z = 1.0
#: Suffixes of two labels that register names one level deeper: a short list, for more pass your own.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "com.cn")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (
    UrlRule("block", "net/"),
    UrlRule("allow", "example.net/en/"),
    UrlRule("block", "example.com/de/"),
    UrlRule("allow", "org/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """The host without a port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    parts = F.split(host, "\\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    return F.when(two.isin(*two_label), two).otherwise(F.element_at(parts, -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The label before the suffix, with the suffix."""
    front = F.left(host, F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0)))
    last = F.element_at(F.split(front, "\\."), -1)
    return F.when(front == "", host).otherwise(F.concat(last, F.lit("."), suffix))


def matching_rule(rules: Sequence[UrlRule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as (rule, verdict), else null."""
    chain = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _shrunk(counts: DataFrame, prior: Column) -> tuple[Column, Column]:
    """Posterior mean and strength of a group with n, bad and a prior (mean, strength)."""
    strength = prior.getField("strength") + F.col("n")
    mean = (prior.getField("mean") * prior.getField("strength") + F.col("bad")) / strength
    return mean, strength


def _strength(counts: DataFrame, least: float, most: float) -> DataFrame:
    """One row: the beta-binomial strength of groups by moments.

    The variance between groups is the weighted variance of their rates less what
    binomial sampling gives; strength = mean * (1 - mean) / variance - 1, kept in
    [least, most]. No labelled group: ``least``.
    """
    rate = F.col("bad") / F.col("n")
    sums = counts.filter("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("n") * rate * rate).alias("sq"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    p = F.col("bad") / F.col("n")
    within = p * (1 - p)
    between = (F.col("sq") - F.col("n") * p * p - (F.col("k") - 1) * within) / (F.col("n") - F.col("nn") / F.col("n"))
    fitted = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("n") * F.col("n") > F.col("nn")),
                    F.when(between > 0, within / between - 1).otherwise(F.lit(float(most))))
    return sums.select(F.least(F.greatest(F.coalesce(fitted, F.lit(float(least))), F.lit(float(least))), F.lit(float(most))).alias("strength"))


def reputations(labelled: DataFrame, least: float = 2.0, most: float = 200.0, z: float = Z, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Per host: n, bad, the posterior mean of its bad rate, its lower bound, and the overall rate.

    ``labelled`` has host and bad (1, 0 or null for no label), a row per page.
    """
    counted = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    name = name_of(F.col("host"))
    counted = counted.withColumn("suffix", suffix_of(name, two_label)).withColumn("domain", domain_of(name, F.col("suffix")))
    hosts = stage(counted, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))

    def level(groups: DataFrame, priors: DataFrame, on: list[str]) -> DataFrame:
        joined = groups.join(priors, on) if on else groups.crossJoin(F.broadcast(priors))  # one row
        joined = joined.crossJoin(F.broadcast(_strength(groups, least, most)))  # one row
        prior = F.struct(F.col("mean"), F.col("strength"))
        mean, strength = _shrunk(groups, prior)
        return joined.withColumns({"post_mean": mean, "post_strength": strength}).drop("mean", "strength")

    by_suffix = level(suffixes, overall, [])
    by_domain = level(domains, by_suffix.select("suffix", F.col("post_mean").alias("mean")), ["suffix"])
    by_host = level(hosts, by_domain.select("domain", F.col("post_mean").alias("mean")), ["domain"])
    sd = F.sqrt(F.col("post_mean") * (1 - F.col("post_mean")) / (F.col("post_strength") + 1))
    told = by_host.crossJoin(F.broadcast(overall.select(F.col("mean").alias("overall"))))  # one row
    return told.select("host", "n", "bad", "post_mean", F.greatest(F.col("post_mean") - z * sd, F.lit(0.0)).alias("lower_bound"), "overall")


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule] = RULES, max_bad: float | None = None, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, post_mean and lower_bound of each page.

    ``outcomes`` has page_id and bad, at most one row a page counts (the worst).
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    outcome = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = stage(reputations(parsed.select("page_id", "host").join(outcome, "page_id", "left"), z=z), "reputations")
    scored = parsed.join(known.select("host", "post_mean", "lower_bound", "overall"), "host", "left")
    bound = F.col("overall") if max_bad is None else F.lit(max_bad)
    hit = matching_rule(rules, F.col("host"), F.col("path"))
    return scored.withColumn("hit", hit).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("lower_bound") > bound, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "post_mean", "lower_bound",
    )
