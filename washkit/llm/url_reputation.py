"""URL filtering by host reputation, with fixed rules first.

Labelled page outcomes are shrunk through beta-binomial priors: the suffix's rate towards the
overall rate, the registered domain's towards its suffix, the host's towards its domain. The
strength of each prior is estimated from the spread between the groups of its level. A host is
blocked when the lower posterior bound of its bad rate exceeds the limit. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Second labels under which countries register names for others.
SHARED_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nom", "or", "org", "sch")
#: Standard deviations of the posterior bound, and the bad rate that the bound must exceed.
DEVIATIONS, LIMIT = 1.645, 0.25


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):  # longer rules overwrite shorter ones
        name, _, start = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def levels(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without user part, port and closing dot. A suffix is the
    last label, or the last two where they are a shared label and a country's two letters, or the
    longest of ``suffixes`` (of up to three labels) that the host ends with. An address is its own
    domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "\\.$", "")
    address = name.rlike("^([0-9]{1,3}\\.){3}[0-9]{1,3}$") | name.startswith("[")
    two = F.substring_index(name, ".", -2)
    shared = two.rlike("^(" + "|".join(SHARED_LABELS) + ")\\.[a-z]{2}$")
    given = lambda n: F.substring_index(name, ".", -n).isin([x for x in suffixes if x.count(".") == n - 1])
    n = F.when(given(3), 3).when(given(2) | shared, 2).otherwise(1)
    last = lambda k: F.concat_ws(".", F.slice(F.split(name, "\\."), -F.least(k, F.size(F.split(name, "\\."))), k))
    return F.when(address, name).otherwise(last(n + 1)), F.when(address, name).otherwise(last(n))


def _strength(groups: DataFrame) -> DataFrame:
    """(k): prior strength of a level from its groups (n, x), by the variance between groups."""
    sums = groups.where("n > 0").select("n", "x", (F.col("x") * F.col("x") / F.col("n")).alias("xx"), (F.col("n") * F.col("n")).alias("nn")) \
        .agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum("nn").alias("nn"))
    p = F.col("x") / F.col("n")
    noise = p * (1 - p)
    spread = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    rho = (spread - noise * (F.col("m") - 1)) / (noise * (F.col("n") - F.col("nn") / F.col("n") - (F.col("m") - 1)))
    rho = F.when((F.col("m") > 1) & (noise > 0) & (F.col("n") - F.col("nn") / F.col("n") - (F.col("m") - 1) > 0), rho).otherwise(F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(0.0001)), F.lit(0.99))
    return sums.select((1 / rho - 1).alias("k"))


def host_bounds(outcomes: DataFrame, deviations: float = DEVIATIONS, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, rate, bound) from hosts' outcome counts (host, n, x): posterior mean of the bad rate and its lower bound."""
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = outcomes.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "x")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    overall = tops.agg(F.when(F.sum("n") > 0, (F.sum("x") + 0.5) / (F.sum("n") + 1)).otherwise(F.lit(0.0)).alias("top"))

    def shrunk(level: DataFrame, prior: str, rate: str) -> DataFrame:
        alpha = F.col("k") * F.col(prior) + F.col("x")
        size = F.col("k") + F.col("n")
        return level.withColumn("k", _strength(level.select("n", "x")).scalar()).withColumn(rate, alpha / size).withColumn("size", size)

    s = shrunk(tops.withColumn("top", overall.scalar()), "top", "suffix_rate").select("suffix", "suffix_rate")
    d = shrunk(domains.join(s, "suffix"), "suffix_rate", "domain_rate").select("suffix", "domain", "domain_rate")
    h = shrunk(hosts.join(d, ["suffix", "domain"]), "domain_rate", "rate")
    bound = F.col("rate") - deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("size") + 1))
    return h.select("host", "rate", bound.alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url",
               limit: float = LIMIT, deviations: float = DEVIATIONS, suffixes: Sequence[str] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``outcomes``: (page_id, bad), bad 1 or 0; outcomes that repeat a page are averaged into one
    (bad where any says so), null ones ignored. A rule fits its host and all subdomains when the
    URL's path starts with the rule's; the longest wins. Where none fits, the verdict is ``block``
    when the host's posterior bound exceeds ``limit``, else ``allow``. A null URL or one without
    ``://`` has an empty host and path, and counts with the other empty hosts. Rows with a null id
    are judged and count no outcome; without outcomes every host is allowed. ``suffixes``: see
    :func:`levels`. Other columns are
    not read.
    """
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.where("bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").cast("double").alias("bad"))
    counts = base.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("x"))
    bounds = host_bounds(counts, deviations, suffixes).select("host", (F.col("bound") > limit).alias("bad_host"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow"))
    return base.join(bounds, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"))
