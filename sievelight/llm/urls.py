"""3. URL filters: empirical-Bayes host reputation, below explicit rules.

A page's outcome is 1 (good) or 0 (bad); most pages have none. Counts of outcomes are shrunk level by level through
beta-binomial priors: the suffix towards the global rate, the registered domain towards its suffix, the host towards its
domain. The strength of a level's prior comes from its own counts by the method of moments. A host passes if the lower
bound of its posterior, the quantile `level` of its beta distribution, reaches `least_good`.

Levels are of the host's name without user info and port. The suffix is the last label, or the last two where they are
one of SUFFIXES; the registered domain has one label more; an address is its own domain and suffix.

Hosts are aggregated before anything is shuffled by host, levels are stored tables, and verdicts return to the pages by a
join that broadcasts the few heaviest hosts.

Defined cases: a url that is null or without `://` has an empty host and path, and its reputation is that of the empty host;
pages without an outcome count as pages only; outcomes other than 0 and 1 are ignored; repeated outcomes of a page each
count; with no outcomes at all every host has the bound of the neutral prior, and passes if that reaches `least_good`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import join_unique, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the contract, as (verdict, host/path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


#: Suffixes of two labels under which names are registered.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "com.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "ac.in", "co.in",
    "net.in", "org.in", "ac.nz", "co.nz", "net.nz", "org.nz", "ac.za", "co.za", "org.za", "co.kr", "or.kr", "com.mx", "org.mx", "com.ar", "com.tr", "com.tw", "com.hk", "com.sg",
)


@dataclass(frozen=True)
class Reputation:
    level: float = 0.05
    least_good: float = 0.5
    weakest: float = 2.0
    strongest: float = 1000.0


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-12):
            break
    return out


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    left = x < (a + 1) / (a + b + 2)
    u, v, y = np.where(left, a, b), np.where(left, b, a), np.where(left, x, 1 - x)
    part = front * _fraction(u, v, y) / u
    return np.where(left, part, 1 - part)


def beta_quantile(a: np.ndarray, b: np.ndarray, level: float) -> np.ndarray:
    """By bisection, to about 1e-9."""
    low, high = np.full(len(a), 1e-12), np.full(len(a), 1 - 1e-12)
    for _ in range(32 if len(a) else 0):
        mid = (low + high) / 2
        below = beta_cdf(a, b, mid) < level
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    label = F.split(name, r"\.")
    n = F.size(label)
    tail = lambda k: F.array_join(F.slice(label, F.greatest(F.lit(1), n - k + 1), k), ".")
    address = name.rlike(r"^(\d+(\.\d+){3}|\[.*\])$")
    two = tail(2).isin(*SUFFIXES)
    return F.when(address, name).when(two, tail(3)).otherwise(tail(2)), F.when(address, name).when(two, tail(2)).otherwise(tail(1))


def _strength(level: DataFrame, r: Reputation) -> float:
    """The strength of the prior at a level with one row (n, s) per unit."""
    sums = level.where("n > 0").agg(
        F.sum("n").alias("N"), F.sum("s").alias("S"), F.count("*").alias("J"), F.sum(F.col("n") * F.col("n")).alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("W")
    )
    t = sums.first()
    if not t.N:
        return r.strongest
    m, free = t.S / t.N, t.N - t.Q / t.N
    between = (t.W - t.N * m * m - (t.J - 1) * m * (1 - m)) / free if free > 0 else 0.0
    return max(r.weakest, min(r.strongest, m * (1 - m) / between - 1)) if between > 0 else r.strongest


def reputations(pages: DataFrame, r: Reputation = Reputation()) -> DataFrame:
    """pages: host, good (1, 0 or null). Per host: host, pages, n, s, mean, bound."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("s"))
    domain, suffix = levels(F.col("host"))
    hosts = store(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    counts = [F.count("*").alias("units"), F.sum("n").alias("n"), F.sum("s").alias("s")]
    domains = store(hosts.groupBy("domain", "suffix").agg(*counts), "domains")
    suffixes = store(domains.groupBy("suffix").agg(*counts), "suffixes")
    n, s = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()

    def shrunk(level: DataFrame, up: Column, k: float) -> Column:
        return (F.col("s") + up * k) / (F.col("n") + k)

    k_suffix, k_domain, k_host = (_strength(x, r) for x in (suffixes, domains, hosts))
    up = suffixes.select("suffix", "units", shrunk(suffixes, F.lit((s + 1) / (n + 2)), k_suffix).alias("up"))
    up = join_unique(domains.drop("units"), up, "suffix", "units").select("domain", "suffix", shrunk(domains, F.col("up"), k_domain).alias("up"))
    up = store(up.join(domains.select("domain", "units"), "domain").drop("suffix"), "domain_means")
    known = join_unique(hosts.drop("suffix"), up, "domain", "units").select("host", "pages", "n", "s", "up", shrunk(hosts, F.col("up"), k_host).alias("mean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s, up = (batch.column(k).to_numpy().astype(float) for k in (2, 3, 4))
            bound = beta_quantile(s + k_host * up, n - s + k_host * (1 - up), r.level)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(bound)], names=["host", "pages", "n", "s", "mean", "bound"])

    return known.mapInArrow(run, "host string, pages long, n long, s long, mean double, bound double")


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: list[tuple[str, str]] = RULES, reputation: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url", good_col: str = "good") -> DataFrame:
    """Per page: id, host, path, rule, verdict, bound (of the host's good rate). outcomes: id_col and good_col."""
    host, path = host_path(F.col(url_col))
    split = store(pages.select(id_col, host.alias("host"), path.alias("path")), "hosts_paths")
    known = outcomes.where(F.col(good_col).isin(0, 1)).select(id_col, F.col(good_col).cast("long").alias("good"))
    hosts = store(reputations(split.select(id_col, "host").join(known, id_col, "left"), reputation), "reputations")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = join_unique(split, hosts.select("host", "pages", "bound"), "host", "pages").withColumns({"rule": rule, "verdict": verdict})
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bound") >= reputation.least_good, "allow").otherwise("block")).alias("verdict"), "bound")


def labelled_pages(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Outcomes of the pages whose path ends in the number of a labelled document, the one they show: that document's label."""
    number = F.regexp_extract(host_path(F.col(url_col))[1], r"/(\d{1,18})(?:\.html?)?/?$", 1)
    shown = pages.select(id_col, F.when(number != "", number.cast("long")).alias("_doc")).where("_doc is not null")
    return shown.join(labels.select(F.col(label_id).cast("long").alias("_doc"), F.col(label_col).alias("good")), "_doc").select(id_col, "good")
