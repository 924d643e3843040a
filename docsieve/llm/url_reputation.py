"""URL filters by empirical-Bayes host reputation.

Page outcomes are counted per host, hosts per registered domain, domains per
suffix.  At each level a beta-binomial prior, centred on the level above, shrinks
the rate of the level below; its strength is estimated from the spread of the
rates (method of moments).  A host is blocked when the lower bound of its
posterior bad rate lies above a limit.  Written rules go before the estimate.

Only counts per host are joined back to the pages: a host with a third of all
pages is one row on one side, and Spark splits the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .registry import query, table
from .text import ascii_lower

Rule = tuple[str, str, str]  # verdict, host, path
RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Labels below a country's (two letters) under which names are registered there.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
#: Other suffixes of two labels, whose names belong to different people; all else is one label.
TWO_LABEL_SUFFIXES = (
    "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "readthedocs.io", "vercel.app",
    "web.app", "wordpress.com",
)
MAX_BAD_RATE, Z = 0.2, 1.645


def url_host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest that fits the host or a parent domain and starts the path."""
    rule = verdict = F.lit(None).cast("string")
    for says, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(domain, suffix) of a host; a host of fewer labels is its own domain."""
    last, last_two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    national = last.rlike("^[a-z]{2}$") & F.substring_index(last_two, ".", 1).isin(*SECOND_LEVEL)
    long = last_two.isin(*two_label) | national
    suffix = F.when(long, last_two).otherwise(last)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(last_two), suffix


def prior_strength(groups: DataFrame) -> float:
    """Pseudo-observations of the prior at one level, from ``n`` trials and ``bad``
    outcomes per group.  One row of sums reaches the driver; without spread, 1,000."""
    with_n = groups.where("n > 0")
    row = with_n.agg(
        F.count("*").alias("g"),
        F.sum("n").cast("double").alias("n"),
        F.sum("bad").cast("double").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("between"),
    ).first()
    if not row.g or row.g < 2:
        return 1000.0
    p = row.bad / row.n
    spread, span = p * (1 - p), row.n - row.nn / row.n - (row.g - 1)
    if spread <= 0 or span <= 0:
        return 1000.0
    share = (row.between - row.n * p * p - (row.g - 1) * spread) / (span * spread)
    share = min(max(share, 1 / 1001), 0.5)
    return 1 / share - 1


def host_reputation(hosts: DataFrame, two_label: Sequence[str] = TWO_LABEL_SUFFIXES, z: float = Z) -> DataFrame:
    """Posterior of each host from (host, n, bad).

    Adds ``domain``, ``suffix``, ``rate`` (posterior mean of the bad rate) and
    ``bound`` (mean less ``z`` standard deviations).  Hosts without outcomes take
    their domain's estimate, domains their suffix's, suffixes the overall rate.
    """
    domain, suffix = registered_domain(F.col("host"), two_label)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    overall = (total.bad or 0) / total.n if total.n else 0.0
    at_suffix, at_domain, at_host = map(prior_strength, (suffixes, domains, hosts))

    def mean(prior: str | Column, strength: float) -> Column:
        return (F.col("bad") + prior * F.lit(strength)) / (F.col("n") + F.lit(strength))

    s = suffixes.select("suffix", mean(F.lit(overall), at_suffix).alias("_at_suffix"))
    d = domains.join(s, "suffix").select("domain", mean(F.col("_at_suffix"), at_domain).alias("_at_domain"))
    rated = hosts.join(d, "domain").withColumn("rate", mean(F.col("_at_domain"), at_host))
    variance = F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(at_host + 1))
    return rated.withColumn("bound", F.col("rate") - z * F.sqrt(variance)).drop("_at_domain")


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = RULES,
    max_bad_rate: float = MAX_BAD_RATE,
    two_label: Sequence[str] = TWO_LABEL_SUFFIXES,
    z: float = Z,
) -> DataFrame:
    """Every page row with its verdict.

    ``pages`` has page_id and url, ``outcomes`` has page_id and bad (0 or 1; null
    outcomes and null ids count for nothing, of repeated ids the worst holds).
    Returns page_id, host, path, rule, verdict, rate and bound, one row per input
    row; other columns are dropped.  A null url, or one without ``://``, has an
    empty host, which is judged like any other host.
    """
    urls = pages.select("page_id", url_host("url").alias("host"), url_path("url").alias("path"))
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = (
        urls.select("page_id", "host").join(known, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    # Small beside the pages, and read by every sum below.
    counted = materialise(counted, "host-counts")
    rated = host_reputation(counted, two_label, z).select("host", "rate", "bound")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > max_bad_rate, "block").otherwise("allow")
    return urls.join(rated, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "rate", "bound"
    )


def label_outcomes(labels: DataFrame) -> DataFrame:
    """A labelled page is bad if its quality is 0 or it is toxic; pages carry the ids of the labelled rows."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    both_null = F.col("quality").isNull() & F.col("toxic").isNull()
    return labels.select(F.col("doc_id").alias("page_id"), F.when(~both_null, bad.cast("int")).alias("bad"))


def _sql_list(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _moments(level: str) -> str:
    return f"""(SELECT CASE WHEN g < 2 OR spread <= 0 OR span <= 0 THEN 1000.0
      ELSE 1 / least(greatest((between_ - n * p * p - (g - 1) * spread) / (span * spread), 1 / 1001.0::DOUBLE), 0.5) - 1 END
    FROM (SELECT *, p * (1 - p) AS spread, n - nn / n - (g - 1) AS span FROM (
      SELECT count(*) AS g, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS between_,
             sum(bad)::DOUBLE / sum(n) AS p FROM {level} WHERE n > 0)))"""


SQL = f"""
WITH urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad FROM labels
          WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM urls LEFT JOIN known USING (page_id) GROUP BY host),
labelled AS (SELECT *, string_split(host, '.') AS l FROM counted),
tailed AS (SELECT *, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS one FROM labelled),
hosts AS (SELECT host, n, bad,
    CASE WHEN long THEN three ELSE two END AS domain, CASE WHEN long THEN two ELSE one END AS suffix
  FROM (SELECT *, two IN ({_sql_list(TWO_LABEL_SUFFIXES)}) OR regexp_full_match(two, '({"|".join(SECOND_LEVEL)})\\.[a-z][a-z]') AS long FROM tailed)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
strength AS (SELECT {_moments("suffixes")} AS s, {_moments("domains")} AS d, {_moments("hosts")} AS h,
  (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0), 0) FROM suffixes) AS overall),
s_rate AS (SELECT suffix, (bad + overall * s) / (n + s) AS r FROM suffixes, strength),
d_rate AS (SELECT domain, (bad + r * d) / (n + d) AS r FROM domains JOIN s_rate USING (suffix), strength),
h_rate AS (SELECT host, n, (bad + r * h) / (n + h) AS rate, h FROM hosts JOIN d_rate USING (domain), strength),
bounds AS (SELECT host, rate - {Z} * sqrt(rate * (1 - rate) / (n + (h + 1))) AS bound FROM h_rate),
rules(rule, says, name, start) AS (VALUES {", ".join(f"('{h}{p}', '{v}', '{h}', '{p}')" for v, h, p in RULES)}),
fits AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM (SELECT DISTINCT host, path FROM urls) JOIN rules
    ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, urls.host, urls.path, rule,
       coalesce(says, CASE WHEN bound > {MAX_BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict
FROM urls JOIN bounds USING (host) LEFT JOIN fits ON urls.host = fits.host AND urls.path = fits.path
"""


@query("op10_url_reputation", SQL)
def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), label_outcomes(table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")
