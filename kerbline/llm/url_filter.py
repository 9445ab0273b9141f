"""URL filters by the reputation of hosts, shrunk through beta-binomial priors.

Labelled pages are counted by host, by registered domain and by suffix: the last label of the host, or the last two where these are
one of the public suffixes SUFFIXES (a parameter), and the registered domain is one label more. The
mean of all outcomes is the prior mean of a suffix, a suffix's posterior mean that of its domains, a domain's that of its hosts.
How much a prior weighs is estimated at each level from how far its members scatter around their parents: with outcomes n, share
good p and prior mean m, n (p - m)^2 has the expectation m (1 - m) (1 + (n - 1) rho), which gives rho, and the prior weighs
1 / rho - 1 outcomes, within LIGHTEST..HEAVIEST. A host is allowed where the lower posterior bound, mean - Z deviations, reaches
ENOUGH. A rule that fits goes before.

DataFrame functions only. Counts are combined before each shuffle; each level is written once, and so is the table of verdicts, so
that the join back to the pages is one that adaptive execution can split where a host has very many pages.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.session import written

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of two labels, by country.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "police.uk", "sch.uk",
    "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "school.nz",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "ne.kr", "or.kr", "pe.kr", "re.kr",
    "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "edu.hk", "gov.hk", "net.hk", "org.hk", "com.tw", "edu.tw", "gov.tw", "net.tw", "org.tw",
    "ac.in", "co.in", "edu.in", "firm.in", "gen.in", "gov.in", "ind.in", "net.in", "nic.in", "org.in", "res.in", "com.sg", "edu.sg", "gov.sg", "net.sg", "org.sg",
    "com.my", "edu.my", "gov.my", "net.my", "org.my", "ac.id", "co.id", "go.id", "net.id", "or.id", "ac.th", "co.th", "go.th", "in.th", "or.th",
    "com.ph", "gov.ph", "net.ph", "org.ph", "com.vn", "edu.vn", "gov.vn", "net.vn", "org.vn", "ac.il", "co.il", "gov.il", "net.il", "org.il",
    "com.br", "edu.br", "gov.br", "net.br", "org.br", "com.ar", "edu.ar", "gob.ar", "net.ar", "org.ar", "com.mx", "edu.mx", "gob.mx", "net.mx", "org.mx",
    "com.co", "edu.co", "gov.co", "net.co", "org.co", "com.pe", "com.ve", "com.ec", "com.uy", "ac.za", "co.za", "gov.za", "net.za", "org.za", "web.za",
    "com.tr", "edu.tr", "gov.tr", "net.tr", "org.tr", "com.ua", "edu.ua", "gov.ua", "net.ua", "org.ua", "com.pl", "edu.pl", "gov.pl", "net.pl", "org.pl",
    "com.eg", "com.sa", "com.pk", "com.bd", "com.ng", "co.ke", "co.tz", "co.ug", "co.at", "or.at", "com.pt", "com.gr", "com.cy", "com.mt",
)
Z = 1.645
ENOUGH = 0.5
LIGHTEST, HEAVIEST = 2.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or without ://. Only A-Z is lower-cased."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.coalesce(path, F.lit(""))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    rule = F.coalesce(*(F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ordered, strict=True)))
    verdict = F.coalesce(*(F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ordered, strict=True)))
    return rule, verdict


def domain_and_suffix(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    two = F.substring_index(host, ".", -2)
    public = two.isin(*suffixes)
    return F.when(public, F.substring_index(host, ".", -3)).otherwise(two), F.when(public, two).otherwise(F.substring_index(host, ".", -1))


def weight(members: DataFrame) -> float:
    """From rows (n, good, prior): how many outcomes the prior weighs."""
    n, good, m = F.col("n"), F.col("good"), F.col("prior")
    spread = m * (1 - m)
    rho = (F.sum(n * (good / n - m) * (good / n - m) - spread)) / F.sum((n - 1) * spread)
    least, most = 1 / (HEAVIEST + 1), 1 / (LIGHTEST + 1)
    held = F.least(F.greatest(F.when(F.isnan(rho), None).otherwise(rho), F.lit(least)), F.lit(most))
    return members.where("n > 0").agg((1 / F.coalesce(held, F.lit(least)) - 1).alias("w")).first()[0]


def shrunk(members: DataFrame) -> DataFrame:
    """members with alpha and beta of the posterior and its mean."""
    w = F.lit(weight(members))
    out = members.withColumn("alpha", F.col("good") + F.col("prior") * w).withColumn("beta", F.col("n") - F.col("good") + (1 - F.col("prior")) * w)
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """From rows (host, good), good null where unlabelled: (host, n, good, mean, bound), one for each host."""
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*total), "domains")
    tops = written(domains.groupBy("suffix").agg(*total), "suffixes")
    prior = tops.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("m")).first()[0]
    tops = shrunk(tops.withColumn("prior", F.lit(prior))).select("suffix", F.col("mean").alias("prior"))
    domains = written(shrunk(domains.join(tops, "suffix")).select("domain", F.col("mean").alias("prior")), "domains")
    out = shrunk(hosts.join(domains, "domain"))
    size = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))
    return out.select("host", "n", "good", "mean", (F.col("mean") - Z * deviation).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of pages.

    A label row with quality 1 is a good outcome, 0 a bad one, null none; a page with several labels has several outcomes. Repeated
    pages are judged each. A host without labels has its domain's mean. Without any label every prior mean is a half. Empty in,
    empty out.
    """
    host, path = host_and_path(F.col(url_col))
    mine = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = labels.select(F.col(label_id).alias("page_id"), F.col(label_col).alias("good")).where("good is not null and page_id is not null")
    outcomes = mine.select("page_id", "host").join(known, "page_id", "left").select("host", "good")
    verdicts = written(reputation(outcomes).select("host", F.when(F.col("bound") >= ENOUGH, "allow").otherwise("block").alias("learned")), "verdicts")
    rule, verdict = by_rule(F.col("host"), F.col("path"))
    return mine.join(verdicts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "learned").alias("verdict"))
