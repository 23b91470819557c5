"""URL filter by empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host, registered domain and public suffix. Each level's good rate has
a beta prior: its mean is the parent's posterior mean, its strength is estimated from all groups of that level by
the method of moments. A host is blocked when even the upper end of its posterior range of good rates stays below
a floor. Fixed rules come first; the longest that fits decides.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the
posterior of the empty host. Pages without a label count for nothing; labels that are given more than once for
a page are averaged into one outcome. Without any label every unruled url is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from coursequarry.llm.tables import join_groups
from coursequarry.sources.scratch import cut_lineage

# Suffixes of two labels under which names are registered.
TWO_PART_SUFFIXES = [
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
    "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
]
FLOOR = 0.5
RANGE = 1.645
# Limits of the estimated correlation of labels in a group. The lower one holds a prior's strength at 49 labels, so that a
# level with few groups does not make a host without labels certain.
CORRELATION = (0.02, 0.5)
LEVELS = ("suffix", "domain", "host")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without a "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def suffix_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    return F.when(two.isin(TWO_PART_SUFFIXES), two).otherwise(F.element_at(parts, -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it; a bare suffix is its own domain."""
    parts = F.split(host, r"\.")
    n = F.size(F.split(suffix, r"\.")) + 1
    return F.when(F.size(parts) < n, host).otherwise(
        F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path prefix) that fits, as "host/path", and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=False):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> float:
    """How many labels a level's prior is worth: from the spread of the groups' rates around their prior means."""
    p, n = F.col("prior"), F.col("n")
    row = groups.filter("n > 1 and prior > 0 and prior < 1").agg(
        F.sum(n * (F.col("good") / n - p) * (F.col("good") / n - p) / (p * (1 - p))).alias("spread"),
        F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if not row["k"] or row["n"] <= row["k"]:
        return 1 / CORRELATION[0] - 1
    rho = (row["spread"] - row["k"]) / (row["n"] - row["k"])
    rho = min(max(rho, CORRELATION[0]), CORRELATION[1])
    return 1 / rho - 1


def reputation(outcomes: DataFrame, floor: float = FLOOR, width: float = RANGE) -> DataFrame:
    """(host, good_rate, upper, blocked) of every host of `outcomes` (host, good 0..1 or null for no label)."""
    suffix = suffix_of(F.col("host"))
    hosts = cut_lineage(
        outcomes.groupBy("host").agg(
            F.count("*").alias("pages"), F.coalesce(F.sum("good"), F.lit(0.0)).cast("double").alias("good"),
            F.count("good").alias("n"))
        .withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    total = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 1.0
    parent = None
    for level in LEVELS:
        own = hosts.groupBy(*LEVELS[:LEVELS.index(level) + 1]).agg(
            F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum("pages").alias("pages"))
        if parent is None:
            own = own.withColumn("prior", F.lit(mean))
        else:
            up = LEVELS[:LEVELS.index(level)]
            own = own.join(parent.select(*up, F.col("rate").alias("prior")), list(up))
        own = cut_lineage(own, level)
        k = _strength(own)
        a, b = F.col("good") + k * F.col("prior"), F.col("n") - F.col("good") + k * (1 - F.col("prior"))
        parent = own.withColumn("rate", a / (a + b)).withColumn(
            "upper", F.col("rate") + width * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    return parent.select("host", "pages", F.col("rate").alias("good_rate"), "upper",
                         (F.col("upper") < floor).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]],
               floor: float = FLOOR, width: float = RANGE) -> DataFrame:
    """page_id, host, path, rule, verdict and good_rate of every page.

    `outcomes` is (page_id, good): 1 for a page found good, 0 for a bad one.
    """
    host, path = url_parts(pages["url"])
    rows = cut_lineage(pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path")), "urls")
    once = outcomes.groupBy("page_id").agg(F.avg("good").alias("good"))
    scored = rows.join(once, "page_id", "left")
    hosts = reputation(scored.select("host", "good"), floor, width)
    hosts = cut_lineage(hosts.select(F.encode("host", "UTF-8").alias("key"), "pages", "good_rate", "blocked"), "ruf")
    judged = join_groups(rows.withColumn("key", F.encode("host", "UTF-8")), hosts, "key", "pages", rows.count())
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(
        verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "good_rate")
