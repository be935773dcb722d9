"""URL filter: prefix rules, then empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes are counted per host. Bad rates are shrunk from level to level -- all pages,
public suffix, registered domain, host -- with a beta-binomial prior whose strength is estimated from the
counts of that level by the method of moments. A host is blocked when the lower posterior bound of its
bad rate exceeds ``threshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, spread_join

#: (action, host, path prefix): a rule fits its host and all subdomains.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Public suffixes of two labels, where no others are given; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")

Z = 1.645
THRESHOLD = 0.5
#: Host tables up to this many rows are broadcast (about 100 bytes a row); larger ones are shuffled, but for the
#: hosts of many pages.
BROADCAST_HOSTS = 100_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """A host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(bare_host(host), ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(two, ".", -1))


def domain_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(bare_host(host), ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(bare_host(host), ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and action of the longest fitting rule, null where none fits."""
    text = action = None
    for act, rule_host, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        text = F.when(fits, rule_host + prefix) if text is None else text.when(fits, rule_host + prefix)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, action


def _shrunk(level: DataFrame) -> DataFrame:
    """Add ``strength`` to rows (n, bad, mu): the beta-binomial prior's size by moments, one value for the level."""
    v = F.col("mu") * (1 - F.col("mu"))
    rho = (F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mu"), 2) - v))
           / F.nullif(F.sum(F.when(F.col("n") > 0, v * (F.col("n") - 1))), F.lit(0.0)))
    strength = 1 / F.least(F.greatest(F.coalesce(rho, F.lit(0.01)), F.lit(0.001)), F.lit(0.5)) - 1
    return level.crossJoin(F.broadcast(level.agg(strength.alias("strength"))))  # the right side is one row


def _mean() -> Column:
    return (F.col("bad") + F.col("strength") * F.col("mu")) / (F.col("n") + F.col("strength"))


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, bound) from ``outcomes`` (host, n, bad), one row per host.

    ``bound`` is the posterior mean of the bad rate less ``z`` posterior standard deviations. A host
    without labels gets its domain's rate. No labels at all: the root rate is one half.
    """
    hosts = outcomes.select("host", "n", "bad").withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("suffix").alias("suffix"))
    tails = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = tails.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mu"))
    s = _shrunk(tails.crossJoin(F.broadcast(root))).select("suffix", _mean().alias("mu"))
    d = _shrunk(domains.join(s, "suffix")).select("domain", _mean().alias("mu"))
    h = _shrunk(hosts.join(d, "domain"))
    a = F.col("bad") + F.col("strength") * F.col("mu")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("mu"))
    mean = a / (a + b)
    return h.select("host", "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD, z: float = Z, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) hold page outcomes by page id; a label row is bad when toxic is 1
    or quality is 0, a null in both counts for nothing, and every repeated row counts. Other columns of
    either table are ignored. A null url, or one without ``://``, has an empty host and path and is judged
    by the reputation of the empty host. Repeated page ids give one row each; empty tables are allowed.
    """
    p = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    bad = (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).cast("long")
    marks = (labels.where(F.col("toxic").isNotNull() | F.col("quality").isNotNull())
             .groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad")))
    outcomes = (p.join(marks, "page_id", "left").groupBy("host")
                .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    blocked = materialize(host_reputation(materialize(outcomes), z, suffixes).select("host", (F.col("bound") > threshold).alias("blocked")))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("blocked"), "block").otherwise("allow"))
    judged = p.join(F.broadcast(blocked), "host", "left") if blocked.count() <= BROADCAST_HOSTS else spread_join(p, blocked, ["host"], "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; see ``filter_urls``."""
    return filter_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


_SUFFIX_LIST = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}"
    for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2])))


def _level_sql(name: str, source: str) -> str:
    return f"""{name}_strength AS (
  SELECT 1 / least(greatest(coalesce(
    sum(CASE WHEN n > 0 THEN n * pow(bad / n - mu, 2) - mu * (1 - mu) END)
      / nullif(sum(CASE WHEN n > 0 THEN mu * (1 - mu) * (n - 1) END), 0), 0.01), 0.001), 0.5) - 1 AS strength
  FROM {source})"""


ORACLE = f"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
marks AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM p LEFT JOIN marks ON p.page_id = marks.doc_id GROUP BY host),
tails AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts FROM counts),
hosts AS (
  SELECT host, n, bad,
    CASE WHEN array_to_string(parts[-2:], '.') IN ({_SUFFIX_LIST}) THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
    CASE WHEN array_to_string(parts[-2:], '.') IN ({_SUFFIX_LIST}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix
  FROM tails),
domains AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
s0 AS (SELECT *, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM suffixes) AS mu FROM suffixes),
{_level_sql('s', 's0')},
d0 AS (
  SELECT domains.*, (s0.bad + strength * mu) / (s0.n + strength) AS mu
  FROM domains JOIN s0 USING (suffix), s_strength),
{_level_sql('d', 'd0')},
h0 AS (
  SELECT hosts.host, hosts.n, hosts.bad, (d0.bad + strength * mu) / (d0.n + strength) AS mu
  FROM hosts JOIN d0 USING (domain), d_strength),
{_level_sql('h', 'h0')},
h1 AS (SELECT host, bad + strength * mu AS a, n - bad + strength * (1 - mu) AS b FROM h0, h_strength),
h2 AS (SELECT host, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > {THRESHOLD} AS blocked FROM h1)
SELECT page_id, host, path,
  CASE {_FITS.format(*(f"'{h}{p}'" for _, h, p in RULES))} END AS rule,
  CASE {_FITS.format(*(f"'{a}'" for a, _, _ in RULES))} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN h2 USING (host)
"""
