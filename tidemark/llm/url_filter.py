"""URL filter: rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (good or bad) are counted by host. Counts roll up to the registered
domain and to the public suffix. Going down, each level's good rate is a beta-binomial posterior
whose prior mean is the posterior mean of the level above; the strength of the prior is a
moment estimate of how much the units of that level differ. A host is blocked if the upper
posterior bound of its good rate is below the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

# The rules, as (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# Second-level names that form a suffix together with a two-letter country.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

THRESHOLD = 0.5
#: Standard deviations of the posterior bound: one-sided 90 %.
Z = 1.2815515655446004
#: A host with more than this share of all pages counts as hot; at most 1 / share hosts can.
HOT_SHARE = 0.001


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Public suffix: the last label, or the last two as in co.uk."""
    two = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"((?:^|(?<=\.))(?:{two})\.[a-z]{{2}}|[^.]*)$", 1)


def domain_of(host: Column, suffix: Column) -> Column:
    """Registered domain: the suffix and the label before it, or the whole host."""
    labels, n = F.split(host, r"\."), F.size(F.split(suffix, r"\.")) + 1
    n = F.least(n, F.size(labels))
    return F.array_join(F.slice(labels, -n, n), ".")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if rule is None:
        rule = verdict = F.lit(None).cast("string")
    return rule, verdict


def _strength(rows: DataFrame, n: str, y: str, mean: str, name: str) -> DataFrame:
    """Prior strength of a level by moments: one row. 1e6 if its units don't differ."""
    m, k, good = F.col(mean), F.col(n), F.col(y)
    spread = m * (1 - m)
    extra = F.sum((good - k * m) * (good - k * m)) - F.sum(k * spread)
    rho = F.try_divide(extra, F.sum(k * (k - 1) * spread))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1e-6)), F.lit(0.5))
    return rows.agg((1 / rho - 1).alias(name))


def _posterior(prior: str, strength: str, n: str, y: str) -> Column:
    return (F.col(prior) * F.col(strength) + F.col(y)) / (F.col(strength) + F.col(n))


def reputation(outcomes: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """Posterior of every host.

    ``outcomes``: host, good (1, 0, or null if not labelled), one row a page; a host without
    labelled pages gets its domain's rate. Result: host, pages, n, y, mean, bound, blocked.
    One aggregation by host meets the pages; all later steps run on counts. If no page is
    labelled, the global rate is 0.5.
    """
    labelled = F.col("good").isNotNull()
    hosts = outcomes.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count("good").cast("double").alias("n"),
        F.coalesce(F.sum(F.when(labelled, F.col("good"))), F.lit(0)).cast("double").alias("y"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn(
        "domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("y").alias("dy"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dy").alias("sy"))
    whole = suffixes.agg(F.coalesce(F.try_divide(F.sum("sy"), F.sum("sn")), F.lit(0.5)).alias("m0"))

    # Every joined aggregate below without a key is a single row.
    suffixes = suffixes.crossJoin(F.broadcast(whole))
    suffixes = suffixes.crossJoin(F.broadcast(_strength(suffixes, "sn", "sy", "m0", "k1"))).withColumn(
        "m1", _posterior("m0", "k1", "sn", "sy"))
    domains = domains.join(suffixes.select("suffix", "m1"), "suffix")
    domains = domains.crossJoin(F.broadcast(_strength(domains, "dn", "dy", "m1", "k2"))).withColumn(
        "m2", _posterior("m1", "k2", "dn", "dy"))
    hosts = hosts.join(domains.select("domain", "suffix", "m2"), ["domain", "suffix"])
    hosts = hosts.crossJoin(F.broadcast(_strength(hosts, "n", "y", "m2", "k3")))
    mean = _posterior("m2", "k3", "n", "y")
    total = F.col("k3") + F.col("n")
    hosts = hosts.withColumn("mean", mean).withColumn(
        "bound", F.least(F.lit(1.0), F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))))
    return hosts.select("host", "pages", "n", "y", "mean", "bound", (F.col("bound") < threshold).alias("blocked"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = THRESHOLD, hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Verdict for every page url: page_id, host, path, rule, verdict, good_rate, bound.

    ``labels``: page_id, good; several labels of one page count as its best one. A null url, or
    one without ``://``, has an empty host and path; empty hosts share one reputation. Repeated
    rows stay repeated. Hosts with more than ``hot_share`` of all pages, of which there can
    be no more than 1 / hot_share, are joined by broadcast, all others by shuffle, so no host's
    pages meet in one task.
    """
    url = F.col("url")
    parsed = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = labels.filter("page_id is not null and good is not null").groupBy("page_id").agg(
        F.max("good").alias("good"))
    hosts = reputation(parsed.join(known, "page_id", "left"), threshold)
    total = pages.agg((F.count(F.lit(1)) * hot_share).alias("least"))
    hosts = hosts.crossJoin(F.broadcast(total)).withColumn("hot", F.col("pages") > F.col("least"))
    columns = ["mean", "bound", "blocked"]
    hot = hosts.filter("hot").select("host", *[F.col(c).alias(f"hot_{c}") for c in columns])
    cold = hosts.filter("not hot").select(F.col("host").alias("cold_host"), *columns)
    # Pages of hot hosts get a key of their own that no host has, so they spread evenly.
    judged = parsed.join(F.broadcast(hot), "host", "left").withColumn(
        "cold_host", F.when(F.col("hot_blocked").isNull(), F.col("host")).otherwise(
            F.concat(F.lit("/"), F.xxhash64("page_id", "path").cast("string"))))
    judged = judged.join(cold, "cold_host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    blocked = F.coalesce("hot_blocked", "blocked")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.round(F.coalesce("hot_mean", "mean"), 6).alias("good_rate"),
        F.round(F.coalesce("hot_bound", "bound"), 6).alias("bound"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label with its id: good if of quality and not toxic."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(
            F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("good"))
    return judge(table(spark, sf_dir, "pages"), labels)


ORACLE = """
with parsed as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
outcome as (
  select doc_id, max(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end)::double as good
  from labels where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
h as (
  select host, count(good)::double as n, coalesce(sum(good), 0) as y, string_split(host, '.') as parts
  from parsed left join outcome on page_id = doc_id group by host),
s as (
  select *, case when len(parts) >= 2 and regexp_full_match(parts[-1], '[a-z]{2}')
    and parts[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') then 2 else 1 end as k from h),
d as (
  select host, n, y, array_to_string(list_slice(parts, greatest(1, len(parts) - k + 1), len(parts)), '.') as suffix,
    array_to_string(list_slice(parts, greatest(1, len(parts) - k), len(parts)), '.') as domain from s),
suffixes as (select suffix, sum(n) as n, sum(y) as y from d group by suffix),
whole as (select coalesce(sum(y) / nullif(sum(n), 0), 0.5) as m from suffixes),
k1 as (
  select 1 / least(greatest(coalesce((sum((y - n * m) ** 2) - sum(n * m * (1 - m)))
    / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-6), 0.5) - 1 as k from suffixes, whole),
m1 as (select suffix, (m * k + y) / (k + n) as m from suffixes, whole, k1),
domains as (
  select domain, suffix, any_value(m) as m, sum(n) as n, sum(y) as y from d join m1 using (suffix) group by domain, suffix),
k2 as (
  select 1 / least(greatest(coalesce((sum((y - n * m) ** 2) - sum(n * m * (1 - m)))
    / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-6), 0.5) - 1 as k from domains),
m2 as (select domain, suffix, (m * k + y) / (k + n) as m from domains, k2),
hosts as (select d.*, m from d join m2 using (domain, suffix)),
k3 as (
  select 1 / least(greatest(coalesce((sum((y - n * m) ** 2) - sum(n * m * (1 - m)))
    / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-6), 0.5) - 1 as k from hosts),
rate as (select host, (m * k + y) / (k + n) as mean, k + n + 1 as more from hosts, k3),
bound as (select host, mean, least(1, mean + 1.2815515655446004 * sqrt(mean * (1 - mean) / more)) as bound from rate),
rules(verdict, rule) as (values ('allow', 'org/'), ('block', 'example.org/es/'),
  ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
fitting as (
  select host, path, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict
  from (select distinct host, path from parsed), rules
  where ('.' || host) like ('%.' || split_part(rule, '/', 1))
    and starts_with(path, substr(rule, strpos(rule, '/'))) group by host, path)
select page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, case when bound < 0.5 then 'block' else 'allow' end) as verdict,
  round(mean, 6) as good_rate, round(bound, 6) as bound
from parsed p join bound b on b.host = p.host left join fitting f on f.host = p.host and f.path = p.path
"""
