"""URL filters: rules, then empirical-Bayes reputation of hosts.

Pages with an outcome (good or not) count for their host, its registered domain and its
suffix. A user, a port and a dot at the end are no part of a domain. A suffix is the last label,
or the last two under a country's registry that deals out names by kind (``REGISTRIES``, as in
``co.uk``); an IP address is a domain of its own, and all of them have the empty suffix. A host's share of good pages has a beta prior with the mean of its domain, which is
itself shrunk towards the suffix, and that towards all pages. How strongly each level
shrinks is estimated from the data: the beta-binomial correlation inside the level's groups
by the method of moments. A host is blocked if the upper bound of its posterior share of
good pages is still below ``least_good``: a host about which little is known stays.

DataFrame functions only. Counts aggregate before the shuffle; the only rows that reach
the driver are one of sums for each of the three levels. Verdicts come back by a join on
the host with one row per host on one side, read from a written table, so that adaptive
execution can split a hot host's pages.

Results that are defined: a null url, or one without ``://``, has an empty host and path;
the empty host and hosts of one label are hosts like others, and their own domain; hosts of
any length and with any characters are taken as they are; a null outcome is no outcome; a host without outcomes
is as good as its domain, one of an unseen domain as its suffix; repeated rows count and are
judged each; other columns are kept unless named like a result; an empty table stays empty.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.shared import stored

#: (verdict, host and path prefix); the longest that fits wins.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
LEAST_GOOD = 0.5
#: Second labels below which countries register names, fixed by their registries.
REGISTRIES = ("ac", "co", "com", "edu", "gov", "gob", "go", "mil", "ne", "net", "nom", "or", "org")
#: Normal quantile of the bound: 95 % one-sided.
SPREAD = 1.645
#: Bounds of the correlation inside groups.
CORRELATION = (0.001, 0.999)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        name = F.when(fits, rule).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain of a host, and its suffix."""
    name = F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*\z", "")
    name = F.regexp_replace(name, r"\.\z", "")
    address = name.rlike(r"^[0-9.]+\z|^\[")
    by_kind = name.rlike(rf"[^.]\.({'|'.join(REGISTRIES)})\.[a-z][a-z]\z")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    domain = F.when(address, name).when(by_kind, three).otherwise(two)
    suffix = F.when(address, "").when(by_kind, two).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Mean and prior strength (in pages) of a level, from groups with ``n`` and ``good``."""
    row = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum("good").alias("good"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("between"),
    ).first()
    if not row["n"]:
        return 0.5, 1.0
    mean = row["good"] / row["n"]
    low, high = CORRELATION
    within, room = mean * (1 - mean), row["n"] - row["squares"] / row["n"] - (row["groups"] - 1)
    if within == 0 or room <= 0:
        correlation = low
    else:
        moved = (row["between"] - row["n"] * mean * mean) / within - (row["groups"] - 1)
        correlation = min(max(moved / room, low), high)
    return mean, (1 - correlation) / correlation


def reputations(pages: DataFrame) -> DataFrame:
    """``host, n, good, mean, upper`` of every host of ``pages`` (``host``, ``outcome``)."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = stored(
        pages.groupBy("host")
        .agg(F.count("outcome").alias("n"), F.count(F.when(F.col("outcome"), 1)).alias("good"))
        .withColumns({"domain": domain, "suffix": suffix}),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    (_, host_strength), (_, domain_strength), (mean, suffix_strength) = map(_strength, (hosts, domains, suffixes))

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("good") + prior * strength) / (F.col("n") + strength)

    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), suffix_strength).alias("suffix_mean"))
    domains = stored(
        domains.join(suffixes, "suffix").select(
            "domain", shrunk(F.col("suffix_mean"), domain_strength).alias("domain_mean")
        ),
        "domains",
    )
    posterior = shrunk(F.col("domain_mean"), host_strength)
    total = F.col("n") + host_strength + 1
    return (
        hosts.join(domains, "domain")
        .select("host", "n", "good", posterior.alias("mean"), (posterior * (1 - posterior) / total).alias("variance"))
        .select("host", "n", "good", "mean", (F.col("mean") + SPREAD * F.sqrt("variance")).alias("upper"))
    )


def judge_urls(
    pages: DataFrame,
    outcome: Column,
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    least_good: float = LEAST_GOOD,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``, and ``upper``, the bound of the host.
    ``outcome`` says of a page whether it is good; null says nothing."""
    results = ["host", "path", "rule", "verdict", "upper"]
    own = [F.col(f"`{c}`") for c in pages.columns if c not in results or c == url_col]
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    known = stored(reputations(pages.select(host.alias("host"), outcome.alias("outcome"))), "reputations")
    known = known.select(F.col("host").alias("__host"), "upper")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    found = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    url = F.col("__url")
    host, path = host_and_path(url)
    kept = [c for c in pages.columns if c not in results or c == url_col]
    return (
        pages.select(F.struct(*own).alias("__own"), F.col(f"`{url_col}`").cast("string").alias("__url"))
        .withColumns({"host": host, "path": path})
        .join(known, F.col("host") == F.col("__host"), "left")
        .select(
            *[F.col("__own").getField(c).alias(c) for c in kept],
            "host",
            "path",
            name.alias("rule"),
            F.coalesce(verdict, found).alias("verdict"),
            "upper",
        )
    )
