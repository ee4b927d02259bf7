"""URL filters (operator 3): rules first, then empirical-Bayes reputation from host to registered domain to suffix."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules of the production query as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Public suffixes of two labels, under which the registered domain has three; others are of one label.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "org.uk", "com.au", "edu.au", "net.au", "org.au", "co.nz", "org.nz", "ac.jp", "co.jp", "ne.jp", "or.jp",
    "co.kr", "or.kr", "com.br", "net.br", "org.br", "com.cn", "net.cn", "org.cn", "com.hk", "com.tw", "com.sg", "com.mx", "com.ar", "com.co", "com.tr", "com.ua",
    "co.in", "net.in", "org.in", "co.id", "co.il", "co.th", "co.za", "com.my", "com.ph", "com.vn", "com.pl", "com.es", "com.pt",
)
ADDRESS = r"^[0-9]+(\.[0-9]+){3}$"
#: A page is blocked where its host's block rate is above LIMIT with the one-sided confidence of Z deviations.
LIMIT, Z = 0.5, 1.645
#: Bounds of the correlation of outcomes within a group: 1 / (1 + a prior's strength).
RHO = (0.001, 0.9)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. The rules are literals of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def site_of(host: Column) -> Column:
    """The host without user, port and a dot at its end: what domains and suffixes are cut from."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _last_labels(host: Column, n: Column) -> Column:
    site = site_of(host)
    return F.when(site.rlike(ADDRESS), site).otherwise(F.array_join(F.slice(F.split(site, r"\."), -F.least(n, F.size(F.split(site, r"\."))), n), "."))


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: a label more than the public suffix. Addresses are their own."""
    return _last_labels(host, F.when(F.substring_index(site_of(host), ".", -2).isin(*suffixes), 3).otherwise(2))


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    return _last_labels(host, F.when(F.substring_index(site_of(host), ".", -2).isin(*suffixes), 2).otherwise(1))


def _strength(groups: DataFrame) -> float:
    """Prior strength by moments: how far rates of groups (n, bad, mean of the parent) stray beyond binomial noise."""
    v = F.col("mean") * (1 - F.col("mean"))
    got = groups.where("n > 0").agg(
        F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("mean")) ** 2).alias("s"), F.sum(v).alias("v"), F.sum((F.col("n") - 1) * v).alias("w")
    ).first()
    rho = (got.s - got.v) / got.w if got.w else RHO[0]
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def _posterior(groups: DataFrame) -> DataFrame:
    """Adds a and b of the beta posterior of each group's block rate, its parent's mean being the prior's."""
    s = _strength(groups)
    return groups.withColumns({"a": F.col("mean") * s + F.col("bad"), "b": (1 - F.col("mean")) * s + F.col("n") - F.col("bad")})


def reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, low) of each host of (host, bad), where bad is 1, 0 or null (a page without a label).

    Counts are summed by host before anything else, so a hot host costs one row a task; domains and suffixes are
    summed from hosts. Each level's posterior mean is the prior mean of the level below. low is the posterior's
    lower bound, its mean less Z deviations: the normal approximation to the beta's quantile at 0.05, which for posteriors of
    strength a + b over 10 and means from 0.2 to 0.8 is within 0.04 of it. Only three strengths and a total come to the driver.
    """
    count = [F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")]
    again = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = written(outcomes.groupBy("host").agg(*count).withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    domains = hosts.groupBy("domain", "suffix").agg(*again)
    suffixes = domains.groupBy("suffix").agg(*again)
    total = hosts.agg(*again).first()
    mean = ((total.bad or 0) + 1) / ((total.n or 0) + 2)
    rate = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = _posterior(suffixes.withColumn("mean", F.lit(mean))).select("suffix", rate.alias("mean"))
    domains = written(_posterior(domains.join(suffixes, "suffix")).select("domain", rate.alias("mean")))
    hosts = _posterior(hosts.join(domains, "domain"))
    n = F.col("a") + F.col("b")
    return hosts.select("host", "n", "bad", rate.alias("rate"), (rate - Z * F.sqrt(F.col("a") * F.col("b") / (n * n * (n + 1)))).alias("low"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, limit: float = LIMIT, suffixes=SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, low) of every page; a page that a rule fits is a labelled outcome.
    There are no other labels than the rules' own verdicts: what a host's other pages get follows from them.

    Null urls or urls without :// have an empty host and path, a host like any other. Repeated rows and null ids are
    judged each; an empty table gives an empty one; other columns are dropped. The join to hosts is one that
    adaptive execution splits where a host is hot.
    """
    u = F.col(f"`{url}`")
    rule, verdict = rule_fit(F.col("host"), F.col("path"), rules)
    seen = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    seen = seen.withColumns({"rule": rule, "ruled": verdict})
    known = reputation(seen.select("host", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("bad")), suffixes)
    by_host = F.when(F.col("low") > limit, "block").otherwise("allow")
    return seen.join(known, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "rate", "low")


_LEVEL = """, {name}_s AS (SELECT coalesce(sum(n * power(bad * 1.0 / n - mean, 2)), 0) AS s, coalesce(sum(mean * (1 - mean)), 0) AS v,
    coalesce(sum((n - 1) * mean * (1 - mean)), 0) AS w FROM {name} WHERE n > 0),
  {name}_p AS (SELECT t.*, mean * k + bad AS a, (1 - mean) * k + n - bad AS b FROM {name} t,
    (SELECT 1 / least(greatest(CASE WHEN w <> 0 THEN (s - v) / w ELSE 0.001 END, 0.001), 0.9) - 1 AS k FROM {name}_s))"""


def _case(what: int) -> str:
    fits = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    said = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", (h + p, v)[what]) for h, p, v in fits]
    return "CASE " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in said) + " END"


ORACLE = (
    f"""WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
  part AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
  seen AS (SELECT *, {_case(0)} AS rule, {_case(1)} AS ruled FROM part),
  site AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS site FROM seen),
  cutup AS (SELECT *, CASE WHEN array_to_string(string_split(site, '.')[-2:], '.') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN 2 ELSE 1 END AS k,
    regexp_matches(site, '{ADDRESS}') AS numeric FROM site),
  host0 AS (SELECT host, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS bad,
    any_value(CASE WHEN numeric THEN site ELSE array_to_string(string_split(site, '.')[-(k + 1):], '.') END) AS domain,
    any_value(CASE WHEN numeric THEN site ELSE array_to_string(string_split(site, '.')[-k:], '.') END) AS suffix FROM cutup GROUP BY host),
  dom0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host0 GROUP BY ALL),
  suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1.0) / (sum(n) + 2) FROM host0) AS mean FROM dom0 GROUP BY suffix)"""
    + _LEVEL.format(name="suf")
    + ", dom AS (SELECT d.*, p.a / (p.a + p.b) AS mean FROM dom0 d JOIN suf_p p USING (suffix))"
    + _LEVEL.format(name="dom")
    + ", hosts AS (SELECT h.*, p.a / (p.a + p.b) AS mean FROM host0 h JOIN dom_p p USING (domain))"
    + _LEVEL.format(name="hosts")
    + f""", known AS (SELECT host, a / (a + b) AS rate, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM hosts_p)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN low > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  round(rate, 6) AS rate, round(low, 6) AS low FROM seen JOIN known USING (host)"""
)
