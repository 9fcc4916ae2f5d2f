"""URL filters: path rules first, then empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, written

#: (verdict, rule): a rule is a host and a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
#: Posterior lower bound that a host needs, and the normal quantile of that bound.
LEAST, Z = 0.6, 1.0
#: Reputations that are sent to every task at most, at 80 bytes a host.
HOST_BYTES = 16 << 20
#: Limits of the fitted prior strengths, in pseudo-pages.
STRENGTH = (1.0, 500.0)


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parse(pages: DataFrame) -> DataFrame:
    """page_id, host, path, domain (registered), suffix of every row; no ``://`` gives empty strings."""
    url = F.coalesce(F.col("url"), F.lit(""))
    p = pages.select("page_id", url.alias("_url"))
    host, path = host_and_path(F.col("_url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    last2 = F.substring_index("host", ".", -2)
    suffix = F.when(last2.isin(*TWO_LABEL_SUFFIXES), last2).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(last2.isin(*TWO_LABEL_SUFFIXES), F.substring_index("host", ".", -3)).otherwise(last2)
    return p.select("*", suffix.alias("suffix"), domain.alias("domain"))


def rule_for(rules=RULES) -> F.Column:
    """The longest rule that fits ``host`` and ``path``; null where none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _shrunk(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """Posterior mean and strength of each child: Beta prior at the parent's mean, its strength by moments.

    The strength is one number a level: between-child variance of the rates around their parents' means,
    less the binomial part. It is read from a one-row aggregate.
    """
    c = children.join(parents.select(on, F.col("mean").alias("prior")), on)
    n, k, m = F.col("n"), F.col("k"), F.col("prior")
    square = F.round((k / n - m) * (k / n - m), 9)
    s = c.agg(F.sum(F.round(m * (1 - m), 9).cast("decimal(20,9)")).alias("pq"), F.sum(F.round(m * (1 - m) / n, 9).cast("decimal(20,9)")).alias("noise"), F.sum(square.cast("decimal(20,9)")).alias("var"))
    pq, noise, var = (F.col(x).cast("double") for x in ("pq", "noise", "var"))
    strength = F.when(var > noise, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.try_divide(pq - var, var - noise)))).otherwise(STRENGTH[1])
    s = s.select(F.coalesce(strength, F.lit(STRENGTH[1])).alias("strength"))
    return c.withColumn("strength", s.scalar()).select(*children.columns, F.round((k + F.col("strength") * m) / (n + F.col("strength")), 9).alias("mean"), (n + F.col("strength")).alias("total"), "strength")


def reputation(parsed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Posteriors of every labelled host, domain and suffix (n, k, mean, total, strength), and the root's mean, as four tables.

    outcomes: page_id, good (0/1; null is no label). Unlabelled levels take their parent's mean in ``verdicts``.
    """
    o = parsed.join(outcomes.where("good is not null").select("page_id", F.col("good").cast("double").alias("_g")), "page_id")
    # each level is a small table of its own, written, so that no level counts the pages anew
    hosts = written(o.groupBy("suffix", "domain", "host").agg(F.count("*").cast("double").alias("n"), F.sum("_g").alias("k")), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("root", F.lit(1))
    root = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(F.lit(1).alias("root"), F.round((F.coalesce("k", F.lit(0.0)) + 1) / (F.coalesce("n", F.lit(0.0)) + 2), 9).alias("mean"))
    s = written(_shrunk(written(suffixes, "suffixes"), root, "root"), "suffixes")
    d = written(_shrunk(written(domains, "domains"), s, "suffix"), "domains")
    h = written(_shrunk(hosts, d, "domain"), "hosts")
    return h, d, s, root


def bound(mean: F.Column, total: F.Column) -> F.Column:
    """Lower posterior bound, by the Beta's normal approximation."""
    return mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))


def verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, bound of every page.

    A fitting rule decides; else the host's posterior lower bound, at least ``least`` to allow. A host without
    labels has its domain's posterior, then the suffix's, then the overall mean, with no pages of its own.
    Null URLs and such without ``://`` are judged as the empty host. Repeated rows are kept; an empty table gives none; other
    columns are not read. Reputations go to every task up to HOST_BYTES; more of them meet the pages by a join that splits hot hosts.
    """
    p = parse(pages)
    h, d, s, root = reputation(p, outcomes)
    # one row for each distinct host, so that pages meet a host's reputation once
    hosts = p.select("host", "domain", "suffix").distinct()
    m = lambda t, key, name: t.select(key, F.col("mean").alias(f"{name}_mean"), F.col("total").alias(f"{name}_total"), F.col("strength").alias(f"{name}_strength"))
    r = hosts.join(m(h, "host", "h"), "host", "left").join(m(d, "domain", "d"), "domain", "left").join(m(s, "suffix", "s"), "suffix", "left").withColumn("r_mean", root.select("mean").scalar())
    mean = F.coalesce("h_mean", "d_mean", "s_mean", "r_mean")
    total = F.coalesce("h_total", F.least("d_total", F.lit(STRENGTH[1])), F.least("s_total", F.lit(STRENGTH[1])), F.lit(2.0))
    r = written(r.select("host", mean.alias("mean"), F.round(bound(mean, total), 6).alias("bound")), "reputations")
    r = F.broadcast(r) if bounded(r, HOST_BYTES, 80) else r
    kind = {rule: v for v, rule in rules}
    out = p.select("page_id", "host", "path", rule_for(rules).alias("rule")).join(r, "host")
    of_rule = F.lit(None).cast("string")
    for rule, v in kind.items():
        of_rule = F.when(F.col("rule") == rule, F.lit(v)).otherwise(of_rule)
    by_method = F.when(F.col("bound") >= least, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce(of_rule, by_method).alias("verdict"), "mean", "bound")


def _level(name: str, parent: str, on: str, keys: str) -> str:
    """SQL of ``_shrunk``."""
    return f"""{name}_c AS (SELECT c.*, p.mean AS m FROM {name}_n c JOIN {parent} p USING ({on})),
{name}_v AS (SELECT coalesce(CASE WHEN var > noise THEN greatest(1.0::DOUBLE, least(500.0::DOUBLE, (pq - var) / (var - noise))) ELSE 500.0::DOUBLE END, 500.0::DOUBLE) AS strength FROM
 (SELECT sum(round(m * (1 - m), 9)::DECIMAL(20,9))::DOUBLE AS pq, sum(round(m * (1 - m) / n, 9)::DECIMAL(20,9))::DOUBLE AS noise, sum(round((k / n - m) * (k / n - m), 9)::DECIMAL(20,9))::DOUBLE AS var FROM {name}_c)),
{name} AS (SELECT {keys}, n, k, strength, round((k + strength * m) / (n + strength), 9) AS mean, n + strength AS total FROM {name}_c, {name}_v)"""


def _rule_sql() -> str:
    cases = []
    for _, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'")
    return "CASE " + " ".join(cases) + " END"


def _verdict_sql() -> str:
    return "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES) + " END"


_two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
#: Over ``pages`` and, as outcomes, the quality labels of the documents whose numbers the URLs have.
ORACLE = rf"""
WITH p0 AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p1 AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
p2 AS (SELECT *, string_split(host, '.') AS part, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS last2 FROM p1),
p AS (SELECT *, CASE WHEN last2 IN ({_two}) THEN last2 ELSE part[-1] END AS suffix, CASE WHEN last2 IN ({_two}) THEN array_to_string(list_slice(part, -3, -1), '.') ELSE last2 END AS domain FROM p2),
o AS (SELECT p.*, quality::DOUBLE AS g FROM p JOIN labels l ON l.doc_id::VARCHAR = regexp_extract(url, '^[^:]*://[^/?#]*/[a-z]+/([0-9]+)', 1) WHERE quality IS NOT NULL),
h_n AS (SELECT suffix, domain, host, count(*)::DOUBLE AS n, sum(g) AS k FROM o GROUP BY ALL),
d_n AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h_n GROUP BY ALL),
s_n AS (SELECT suffix, 1 AS root, sum(n) AS n, sum(k) AS k FROM d_n GROUP BY ALL),
r AS (SELECT 1 AS root, round((coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2), 9) AS mean FROM s_n),
{_level("s", "r", "root", "suffix")},
{_level("d", "s", "suffix", "suffix, domain")},
{_level("h", "d", "domain", "host")},
j AS (SELECT p.page_id, p.host, p.path, {_rule_sql()} AS rule, coalesce(h.mean, d.mean, s.mean, r.mean) AS mean, coalesce(h.total, least(d.total, 500.0::DOUBLE), least(s.total, 500.0::DOUBLE), 2.0::DOUBLE) AS total
 FROM p LEFT JOIN h USING (host) LEFT JOIN d ON d.domain = p.domain LEFT JOIN s ON s.suffix = p.suffix, r)
SELECT page_id, host, path, rule, coalesce({_verdict_sql()}, CASE WHEN round(mean - {Z} * sqrt(mean * (1 - mean) / (total + 1)), 6) >= {LEAST} THEN 'allow' ELSE 'block' END) AS verdict,
 round(mean - {Z} * sqrt(mean * (1 - mean) / (total + 1)), 6) AS bound FROM j
"""
