"""URL filter by empirical-Bayes host reputation (DataFrame operations only).

Labelled page outcomes (good 1, bad 0) are counted by host, registered domain
and suffix.  Each level's beta prior has the mean of the level above it and a
strength fitted by moments; a page passes if the lower posterior bound of the
finest level that is known for it reaches the threshold.  Explicit rules come
before the reputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

# Second-level labels under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels, three where the last but one is a public second level (co.uk)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    second = F.when(n >= 3, F.element_at(labels, -2))
    three = second.isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(labels, F.when(three, -3).otherwise(-2), 3), "."))


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.

    A rule fits its host and every subdomain of it if the path starts with its
    path; length counts host and path.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, on, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        rule, verdict = F.when(fits, on + under).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(counts: DataFrame, weakest: float, strongest: float) -> DataFrame:
    """One row, kappa: the prior strength by the moments of beta-binomial groups (n, k).

    rho is the intra-class correlation, kappa = 1 / rho - 1 held between the
    two limits; without spread to measure, the strongest prior.
    """
    n, k = F.col("n"), F.col("k")
    sums = counts.agg(
        F.sum("n").cast("double").alias("N"),
        F.sum("k").cast("double").alias("K"),
        F.sum((n * n).cast("double")).alias("N2"),
        F.sum((k * k).cast("double") / n).alias("K2"),
        F.count(F.lit(1)).cast("double").alias("g"),
    )
    p = F.col("K") / F.col("N")
    within = p * (1 - p)
    spread = F.col("K2") - F.col("N") * p * p - within * (F.col("g") - 1)
    scale = within * (F.col("N") - F.col("N2") / F.col("N") - (F.col("g") - 1))
    rho = F.when(scale > 0, spread / scale)
    kappa = F.when(rho > 0, F.greatest(F.lit(weakest), F.least(F.lit(strongest), 1 / rho - 1))).otherwise(F.lit(strongest))
    return sums.select(kappa.alias("kappa"))


def host_reputation(outcomes: DataFrame, weakest: float = 2.0, strongest: float = 200.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors of (host, domain, suffix, all) from ``outcomes`` (host, good).

    Each has its key, ``a`` and ``b`` of the beta posterior; the last has one
    row, and with no outcomes at all it is the uniform prior.  Rows with a null
    outcome are left out.  Counts are combined before every shuffle, so a host
    with a third of all rows costs one row per task.
    """
    # each level written once: its strength, its posterior and the level above come from it
    hosts = materialize(
        outcomes.where(F.col("good").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
        .select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "k"),
        "host-outcomes",
    )
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domain-outcomes")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffix-outcomes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    everything = total.select((F.col("k") + 1.0).alias("a"), (F.col("n") - F.col("k") + 1.0).alias("b"))

    def shrunk(counts: DataFrame, prior: DataFrame, on: str | None, keys: list[str]) -> DataFrame:
        mean = prior.select(*([on] if on else []), (F.col("a") / (F.col("a") + F.col("b"))).alias("prior_mean"))
        # prior of one row for all, or one row per key of the level above
        joined = counts.join(mean, on) if on else counts.join(F.broadcast(mean))
        joined = joined.join(F.broadcast(_strength(counts, weakest, strongest)))
        a = F.col("k") + F.col("kappa") * F.col("prior_mean")
        b = F.col("n") - F.col("k") + F.col("kappa") * (1 - F.col("prior_mean"))
        return joined.select(*keys, a.alias("a"), b.alias("b"))

    by_suffix = shrunk(suffixes, everything, None, ["suffix"])
    by_domain = shrunk(domains, by_suffix, "suffix", ["domain"])
    by_host = shrunk(hosts, by_domain, "domain", ["host"])
    return by_host, by_domain, by_suffix, everything


def url_filter(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = 1.645,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, reputation.

    ``reputation`` is the lower bound mean - z * sd of the posterior of the
    page's host, or of its registered domain, suffix or the whole table where
    the finer level has no outcome; rounded to 6 digits.  The verdict is the
    rule's, else ``allow`` if the reputation reaches ``threshold``.  A null or
    malformed url has an empty host and is judged as any unknown host.
    """
    by_host, by_domain, by_suffix, everything = host_reputation(outcomes)
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    def bound(a: str = "a", b: str = "b") -> Column:
        n = F.col(a) + F.col(b)
        mean = F.col(a) / n
        return F.round(mean - z * F.sqrt(mean * (1 - mean) / (n + 1)), 6)

    # one reputation per distinct host first, then one join of the pages by host
    hosts = rows.groupBy("host").count().select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"))
    judged = (
        hosts.join(by_host.select("host", bound().alias("of_host")), "host", "left")
        .join(by_domain.select("domain", bound().alias("of_domain")), "domain", "left")
        .join(by_suffix.select("suffix", bound().alias("of_suffix")), "suffix", "left")
        .join(F.broadcast(everything.select(bound().alias("of_all"))))
        .select("host", F.coalesce("of_host", "of_domain", "of_suffix", "of_all").alias("reputation"))
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("reputation") >= threshold, "allow").otherwise("block")
    return rows.join(judged, "host", "left").select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "reputation"
    )
