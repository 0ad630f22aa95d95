"""URL filters by empirical-Bayes host reputation.

Labelled outcomes of pages (bad or not) are counted per host. The share of bad pages of a host is shrunk towards its
registered domain's, that towards the suffix's, and that towards all pages', by beta-binomial priors: at each level
the prior of a unit has the posterior mean of the unit above and a weight estimated from how much the units of a level
differ (method of moments). A page is blocked when a lower bound of its host's posterior share exceeds a limit, so hosts
with few labels are blocked on strong evidence only. Explicit rules go first.

A host without a labelled page is judged with n = 0 by the mean of its registered domain, else its suffix, else all pages.
The spread around it is that of every level without labels, one beta within the other. Null addresses and those without ``://`` have an empty
host and path: no rule fits them, they have no reputation and pass. Without any label nothing is known of any host, and
the prior of all pages is even. A page with several labels counts each; null labels count none. Repeated pages
repeat their outcomes. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.llm.storage import small_first, stored

#: (verdict, host, path): the rule with the longest host and path that fits an address decides.
Rule = tuple[str, str, str]
#: Share of bad pages above which a host is blocked, and how many standard deviations the bound lies below the mean.
LIMIT, DEVIATIONS = 0.5, 2.0
#: Bounds of a prior's weight, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url.cast("string"), "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url.cast("string"), "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The rule that decides (host and path as text), and its verdict; null without one. ``rules`` is a short list."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda rule: (-len(rule[1]) - len(rule[2]), -len(rule[1]), rule))
    fits = [((host == at) | host.endswith(f".{at}")) & path.startswith(below) & (host != "") for _, at, below in ordered]
    for fit, (says, at, below) in reversed(list(zip(fits, ordered, strict=True))):
        verdict = F.when(fit, F.lit(says)).otherwise(verdict)
        name = F.when(fit, F.lit(f"{at}{below}")).otherwise(name)
    return name, verdict


def registered_domain(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host)


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def _shrunk(units: DataFrame, above: str) -> DataFrame:
    """Adds the posterior mean ``mean`` and weight ``pages`` of units (bad, n) around ``above``, their prior's mean.

    The prior's weight comes from the spread of shares between units around their prior means, less what binomial
    counts spread by themselves.
    """
    share = F.col("bad") / F.col("n")
    noise = F.col(above) * (1 - F.col(above))
    moments = units.where("n > 0").agg(
        F.sum(F.col("n") * (share - F.col(above)) ** 2).alias("between"), F.sum(noise).alias("within"),
        F.sum((F.col("n") - 1) * noise).alias("scale"))
    # between = within + scale * rho, and a beta prior of weight w has rho = 1 / (w + 1)
    rho = F.when(F.col("scale") > 0, (F.col("between") - F.col("within")) / F.col("scale"))
    weight = F.when(rho > 1 / (1 + MOST_WEIGHT), F.greatest(1 / rho - 1, F.lit(LEAST_WEIGHT))).otherwise(F.lit(MOST_WEIGHT))
    joined = units.join(F.broadcast(moments.select(weight.alias("weight"))))  # one row
    return joined.withColumn("pages", F.col("n") + F.col("weight")).withColumn(
        "mean", (F.col("bad") + F.col("weight") * F.col(above)) / F.col("pages")).drop("weight")


def _bound(mean: Column, pages: Column) -> Column:
    spread = F.sqrt(mean * (1 - mean) / (pages + 1))
    return F.greatest(mean - DEVIATIONS * spread, F.lit(0.0))


def _levels(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors of hosts, of domains and of suffixes with labelled pages, and one row of the mean of all
    pages and how much a host differs from its domain (``in_domain``), suffix and all: the beta's 1 / (weight + 1)."""
    hosts = stored(outcomes.where("bad IS NOT NULL").groupBy("host").agg(
        F.sum(F.col("bad").cast("double")).alias("bad"), F.count("*").cast("double").alias("n"))
        .withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host"))), "url-hosts")
    whole = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("above"))

    def level(key: str, *more: str) -> DataFrame:
        return hosts.groupBy(key, *more).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))

    suffixes = _shrunk(level("suffix").join(F.broadcast(whole)), "above")
    domains = _shrunk(level("domain", "suffix").join(suffixes.select("suffix", F.col("mean").alias("above")), "suffix"), "above")
    units = _shrunk(hosts.join(domains.select("domain", F.col("mean").alias("above")), "domain"), "above")
    # within betas of weights w, mean * (1 - mean) is left by the product of w / (w + 1)
    held = [x.agg(F.coalesce(F.first(F.col("pages") - F.col("n")), F.lit(MOST_WEIGHT)).alias("w")).select((F.col("w") / (F.col("w") + 1)).alias(name))
            for x, name in ((units, "a"), (domains, "b"), (suffixes, "c"))]
    for one in held:
        whole = whole.join(F.broadcast(one))  # one row
    return units, domains, suffixes, whole.selectExpr("above", "1 - a AS in_domain", "1 - a * b AS in_suffix", "1 - a * b * c AS in_all")


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, mean, bound) from (host, bad): posterior share of bad pages and its lower bound, per host with pages."""
    return _levels(outcomes)[0].select("host", "mean", _bound(F.col("mean"), F.col("pages")).alias("bound"))


def _inherited(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, mean, bound) of all ``hosts`` (a row each): their own posterior, or with no labels that of what is above them."""
    units, domains, suffixes, whole = _levels(outcomes)
    known = stored(units.select("host", "mean", "pages"), "url-reputations")
    domains, suffixes = (stored(x.select(key, F.col("mean").alias(name)), f"url-{name}")
                         for x, key, name in ((domains, "domain", "of_domain"), (suffixes, "suffix", "of_suffix")))
    rows = (hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
            .join(small_first(known), "host", "left").join(small_first(domains), "domain", "left")
            .join(small_first(suffixes), "suffix", "left").join(F.broadcast(whole)))  # one row
    mean = F.coalesce("mean", "of_domain", "of_suffix", "above")
    differs = F.when(F.col("of_domain").isNotNull(), F.col("in_domain")).when(F.col("of_suffix").isNotNull(), F.col("in_suffix"))
    pages = F.coalesce("pages", 1 / F.coalesce(differs, "in_all") - 1)
    return rows.select("host", mean.alias("mean"), _bound(mean, pages).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation, bound) per page.

    ``outcomes``: (page_id, bad) of labelled pages, 1 for a bad one. Hosts without a label have the reputation of what is above them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = rows.join(outcomes.select("page_id", "bad"), "page_id").where("host <> ''").select("host", "bad")
    known = stored(_inherited(rows.where("host <> ''").select("host").distinct(), labelled), "url-known")
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce(F.col("bound") > limit, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return (rows.join(small_first(known), "host", "left")
            .select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                    F.col("mean").alias("reputation"), "bound"))
