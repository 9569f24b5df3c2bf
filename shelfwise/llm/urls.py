"""URL filtering: explicit rules first, then empirical-Bayes reputation of hosts.

Labelled pages say how many of a host's pages turned out bad. A host's rate of bad pages is drawn to
that of its registered domain, the domain's to its public suffix, the suffix's to all pages, by
beta-binomial priors whose strengths are estimated from how much rates differ at each level; a prior
counts what there is beside the unit itself. A host is blocked if even the lower bound of its posterior rate is above a limit, so a host with few labelled
pages is not blocked on its own account. Everything is counted per host before anything is joined.
"""

from __future__ import annotations

import pkgutil
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: A host is blocked if its posterior rate less so many standard deviations is above the limit.
DEVIATIONS, LIMIT = 1.645, 0.5
#: Bounds of the estimated prior strengths, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


@lru_cache(1)
def public_suffixes() -> dict[str, int]:
    """Labels of the public suffix by rule of publicsuffix.org, whose list lies beside this file (MPL 2.0)."""
    out = {}
    for line in pkgutil.get_data(__package__, "public_suffix_list.dat").decode().splitlines():
        if line.strip() and not line.startswith("//"):
            rule = line.split()[0].lower()
            name = rule.removeprefix("!")
            labels = name.count(".") + (rule == name)  # an exception's suffix is a label shorter
            out[name] = labels
            out[".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))] = labels
    return out


def suffix_labels(name: str, rules: dict[str, int]) -> int:
    """How many labels of a name are its public suffix: those of the longest rule, or one."""
    labels = name.split(".")
    for i in range(len(labels)):
        exact = ".".join(labels[i:])
        if (found := rules.get(exact) or rules.get(".".join(["*", *labels[i + 1 :]]))) is not None:
            return found
    return 1


@lru_cache(1)
def _suffix_labels():
    @F.pandas_udf("int")
    def count(names: pd.Series) -> pd.Series:
        rules = public_suffixes()
        return pd.Series([1 if x is None else suffix_labels(x, rules) for x in names], dtype="int32")

    return count


def levels_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without user and port; an address is its own."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    parts = F.split(bare, r"\.")
    count = F.size(parts)
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.lit(1), count - n + 1), n), ".")
    address = bare.rlike(r"^[0-9.]+$") | F.startswith(bare, F.lit("["))
    labels = _suffix_labels()(bare)
    return F.when(address, bare).otherwise(last(labels + 1)), F.when(address, bare).otherwise(last(labels))


def _strength(units: DataFrame) -> DataFrame:
    """Rate over all pages and prior strength, from counts (n, bad) of units: one row.

    From the intraclass correlation by analysis of variance; few or equal units give the most strength.
    """
    s = units.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("N"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("B"), F.count("*").cast("double").alias("k"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("N2"), F.coalesce(F.sum(F.col("bad") * F.col("bad") / F.col("n")), F.lit(0)).cast("double").alias("Q"))
    c = {x: F.col(x) for x in ("N", "B", "k", "N2", "Q")}
    rate = (c["B"] + 0.5) / (c["N"] + 1)
    between = (c["Q"] - c["B"] * c["B"] / c["N"]) / (c["k"] - 1)
    within = (c["B"] - c["Q"]) / (c["N"] - c["k"])
    size = (c["N"] - c["N2"] / c["N"]) / (c["k"] - 1)
    strength = within * size / (between - within)
    enough = (c["k"] > 1) & (c["N"] > c["k"]) & (between > within)
    return s.select(rate.alias("rate"), F.when(enough, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), strength))).otherwise(F.lit(MOST_STRENGTH)).alias("strength"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, rate and bound from labelled outcomes (host, bad): posterior mean and lower bound."""
    domain, suffix = levels_of(F.col("host"))
    hosts = materialize(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumns({"domain": domain, "suffix": suffix}), "host-counts")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # the strengths are three rows of two numbers
    top = _strength(suffixes).select(F.col("rate").alias("rate0"), F.col("strength").alias("m0")).first()
    m1, m2 = _strength(domains).first()["strength"], _strength(hosts).first()["strength"]
    drawn = lambda bad, n, m, rate: (bad + m * rate) / (n + m)
    col = F.col
    # a prior comes from what else there is at a level: nothing counts twice
    suffixes = suffixes.select("suffix", col("n").alias("suffix_n"), col("bad").alias("suffix_bad"))
    rest = drawn(col("suffix_bad") - col("bad"), col("suffix_n") - col("n"), top["m0"], F.lit(top["rate0"]))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", col("n").alias("domain_n"), col("bad").alias("domain_bad"), rest.alias("suffix_rate"))
    rest = drawn(col("domain_bad") - col("bad"), col("domain_n") - col("n"), m1, col("suffix_rate"))
    mean = drawn(col("bad"), col("n"), m2, rest)
    deviation = F.sqrt(mean * (1 - mean) / (col("n") + m2 + 1))
    return hosts.join(domains, ["domain", "suffix"]).select("host", "n", "bad", mean.alias("rate"), (mean - DEVIATIONS * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    ``outcomes`` has page_id and bad (0 or 1), a row per labelled page. Host and path of a null url or
    one without ``://`` are empty; such pages are judged like those of one host without a name.
    Repeated pages and null ids are kept; hosts without a labelled page are allowed, as are all if
    nothing is labelled. An empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labelled = rows.join(outcomes.select("page_id", "bad"), "page_id").select("host", "bad")
    # a table of known size: broadcast where small, else hot hosts' rows are split among tasks
    blocked = materialize(host_reputation(labelled).filter(F.col("bound") > LIMIT).select("host", F.lit("block").alias("found")), "blocked-hosts")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("found"), F.lit("allow")).alias("verdict"))


def labelled_outcomes(labels: DataFrame) -> DataFrame:
    """page_id and bad from labels by id: a page is bad if it is of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("bad"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), labelled_outcomes(table(spark, sf_dir, "labels")))


@lru_cache(1)
def _suffixes_sql() -> str:
    """The rules of ``public_suffixes`` as rows (name, labels), from one text."""
    rules = ",".join(f"{name} {labels}" for name, labels in public_suffixes().items())
    return f"SELECT split_part(x, ' ', 1) AS name, CAST(split_part(x, ' ', 2) AS INTEGER) AS labels FROM (SELECT unnest(string_split('{rules}', ',')) AS x)"


def _strength_sql(source: str) -> str:
    return f"""SELECT (B + 0.5) / (N + 1) AS rate,
      CASE WHEN k > 1 AND N > k AND (Q - B * B / N) / (k - 1) > (B - Q) / (N - k)
           THEN greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, ((B - Q) / (N - k)) * ((N - N2 / N) / (k - 1)) / ((Q - B * B / N) / (k - 1) - (B - Q) / (N - k))))
           ELSE {MOST_STRENGTH} END AS m
    FROM (SELECT coalesce(sum(n), 0)::DOUBLE AS N, coalesce(sum(bad), 0)::DOUBLE AS B, count(*)::DOUBLE AS k,
                 coalesce(sum(n * n), 0)::DOUBLE AS N2, coalesce(sum(bad * bad / n::DOUBLE), 0)::DOUBLE AS Q FROM {source})"""


def _rule_sql(pick) -> str:
    whens = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"CASE {whens} END"


def oracle_sql() -> str:
    """The same verdicts in SQL, with the whole list of suffixes."""
    return rf"""
WITH r AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare, count(*) AS n, sum(bad) AS bad
  FROM r JOIN o USING (page_id) GROUP BY host
), p AS (SELECT *, string_split(bare, '.') AS parts, regexp_matches(bare, '^[0-9.]+$') OR starts_with(bare, '[') AS address FROM c),
ends AS (SELECT host, i, array_to_string(parts[i:], '.') AS exact, array_to_string(list_concat(['*'], parts[i + 1:]), '.') AS wild FROM (SELECT host, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)),
rules AS ({_suffixes_sql()}),
told AS (SELECT host, arg_min(coalesce(a.labels, b.labels), i) AS labels FROM ends LEFT JOIN rules a ON exact = a.name LEFT JOIN rules b ON wild = b.name WHERE coalesce(a.labels, b.labels) IS NOT NULL GROUP BY host),
h AS (
  SELECT host, n, bad, CASE WHEN address THEN bare ELSE array_to_string(parts[-(coalesce(labels, 1) + 1):], '.') END AS domain,
         CASE WHEN address THEN bare ELSE array_to_string(parts[-coalesce(labels, 1):], '.') END AS suffix FROM p LEFT JOIN told USING (host)
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
m0 AS ({_strength_sql("s")}), m1 AS ({_strength_sql("d")}), m2 AS ({_strength_sql("h")}),
dr AS (SELECT domain, d.suffix, d.n, d.bad, (s.bad - d.bad + m0.m * m0.rate) / (s.n - d.n + m0.m) AS rate FROM d JOIN s USING (suffix), m0),
hp AS (SELECT host, h.n, h.bad, (dr.bad - h.bad + m1.m * dr.rate) / (dr.n - h.n + m1.m) AS rate FROM h JOIN dr USING (domain, suffix), m1),
hr AS (SELECT host, n, m2.m AS m, (bad + m2.m * hp.rate) / (n + m2.m) AS rate FROM hp, m2),
b AS (SELECT host FROM hr WHERE rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (n + m + 1)) > {LIMIT})
SELECT page_id, host, path, {_rule_sql(lambda v, h, p: h + p)} AS rule,
       coalesce({_rule_sql(lambda v, h, p: v)}, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""
