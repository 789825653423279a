"""URL filtering by rules and by an empirical-Bayes reputation of hosts (operator 8).

All of it is DataFrame work.  Labelled page outcomes are counted per host, registered domain and
public suffix.  At each level the rate of bad pages has a beta prior whose mean is the posterior mean
of the level above and whose weight is fitted to the spread between the level's members by the method
of moments (a beta-binomial model).  A host is blocked when the lower bound of its posterior rate,
the mean less ``z`` standard deviations, reaches ``limit``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels that belong to the public suffix under a two-letter domain, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Least and most weight of a prior, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label of a host, or the last two as in co.uk."""
    labels = F.split(host, r"\.", -1)
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    double = (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    return F.when(double, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and the label before it, or the whole host."""
    size = F.size(F.split(suffix_of(host), r"\.", -1))
    labels = F.split(host, r"\.", -1)
    wanted = F.least(size + 1, F.size(labels))
    return F.concat_ws(".", F.slice(labels, F.size(labels) - wanted + 1, wanted))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules``, pairs of verdict and ``host/path``, that fits.

    A rule fits its host and all subdomains if the path starts with the rule's path.  Equally long
    ones go by their order.  The rules become one expression, so a few hundred are reasonable.
    """
    rule = verdict = F.lit(None).cast("string")
    for name, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def _weight(level: DataFrame) -> Column:
    """The prior weight that explains the spread of ``bad / n`` among the rows of ``level``.

    With p the pooled rate, the weighted squares exceed what chance makes by a between-member
    variance v, and a beta with mean p and variance v has weight p (1 - p) / v - 1.
    """
    n, bad = F.sum("n"), F.sum("bad")
    p = bad / n
    squares = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - bad * bad / n
    spread = n - F.sum(F.col("n") * F.col("n")) / n
    chance = (F.count("n") - 1) * p * (1 - p)
    v = F.when(spread > 0, (squares - chance) / F.when(spread > 0, spread))
    weight = F.when((v > 0) & (n > 0), p * (1 - p) / F.when(v > 0, v) - 1).otherwise(F.lit(MOST_WEIGHT))
    return level.agg(F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), weight))).scalar()


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, sd): the posterior bad-page rate of every host in ``outcomes``.

    ``outcomes`` has (host, bad): a row per page, ``bad`` null where the page has no label.  Pages are
    counted per host before anything else, so a hot host is a few partial counts.  Without any label
    the mean is one half everywhere.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").cast("double").alias("n"),
        F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("bad"),
    )
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = F.sum("n")
    overall = suffixes.agg(F.when(total > 0, F.sum("bad") / F.when(total > 0, total)).otherwise(0.5)).scalar()

    def shrunk(level, above):
        weight = _weight(level.filter("n > 0"))
        weight = F.coalesce(weight, F.lit(MOST_WEIGHT))
        return (F.col("bad") + weight * above) / (F.col("n") + weight), weight

    mean, _ = shrunk(suffixes, overall)
    by_suffix = suffixes.select("suffix", mean.alias("above"))
    mean, _ = shrunk(domains, F.col("above"))
    by_domain = domains.join(by_suffix, "suffix").select("suffix", "domain", mean.alias("above"))
    mean, weight = shrunk(hosts, F.col("above"))
    known = hosts.join(by_domain, ["suffix", "domain"]).select(
        "host", "n", "bad", mean.alias("mean"), (F.col("n") + weight).alias("size")
    )
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return known.select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), "mean", sd.alias("sd"))


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    page_id: str = "page_id",
    url: str = "url",
    limit: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) of every page.

    ``labels`` has (id, bad): outcomes by page id; a page with several is bad if one of them is, and
    a null id matches nothing.  The longest rule that fits decides; else a page is blocked if the
    lower bound of its host's bad-page rate, ``bad_bound``, is at least ``limit``.  Null urls have
    the empty host, whose pages share a reputation.  Repeated rows stay and count as pages.
    """
    rows = pages.select(
        pages[page_id].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path")
    )
    marks = labels.groupBy("id").agg(F.max("bad").alias("bad"))
    outcomes = rows.join(marks, rows.page_id == marks.id, "left").select("host", "bad")
    known = host_reputation(outcomes).select(
        "host", F.greatest(F.lit(0.0), F.col("mean") - F.lit(z) * F.col("sd")).alias("bad_bound")
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("bad_bound") >= limit, "block").otherwise("allow")
    return rows.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "bad_bound"
    )
