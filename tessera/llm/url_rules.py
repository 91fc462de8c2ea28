"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes and confirmed by full digests.

A rule (host, path, verdict) fits the urls of its host and of all subdomains whose path starts with the rule's.  Of the rules that fit,
the one with the longest text (host and path together) decides, of equally long ones that with the longer host, and of rules with the
same host and path `block`.  A url that no rule fits has the verdict `otherwise` and no rule.

Each different (host, path) is judged once.  It is expanded into the suffixes of its host, of no more labels than rules have, times the
path and its prefixes: those that end in a slash, up to the length of the longest rule's path, and those of the lengths that rules
without a slash at their end have.  So each rule that fits is met, and how many expressions a very long url has depends on the rules.
Expressions meet rules on the first 32 bits of their SHA-256 digests; the whole digests are compared then.  Rules go out once for each of
SALTS parts of the urls, so no task has all expressions of one host.  A url that many rows hold takes its verdict from a broadcast
of such urls, no more than HOT of them; all others from a shuffle.

Null urls and urls without `://` have an empty host and path, which only a rule of the empty host fits; urls may be repeated, and each
row is judged.  Rules with a null host or path are passed over; without rules all is `otherwise`.  No urls give no rows.  Columns of the
input named like a result have `_in` appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, materialise, set_aside

#: Parts of the urls that the rules are sent to.
SALTS = 16
#: Hexadecimal digits of a digest that expressions and rules are joined on.
SHORT = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, after the first `://`, in lower case, and path; both empty for a null url and one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column, most: int) -> Column:
    """The host and what follows each of its dots, of `most` labels at most."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def prefixes(path: Column, longest: int, lengths: list[int]) -> Column:
    """The path, its prefixes that end in a slash, of `longest` characters at most, and those of the given lengths."""
    parts = F.split(F.substring(path, 1, longest), "/")
    ended = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    ended = F.concat(F.array(path), F.when(F.size(parts) > 1, ended).otherwise(F.array().cast("array<string>")))
    if not lengths:
        return ended
    own = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    return F.concat(ended, F.transform(own, lambda n: F.substr(path, F.lit(1), n)))


def _digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; the line end keeps host and path apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prepared(rules: DataFrame) -> DataFrame:
    """One row for each (host, path) of the rules, with its digests and its place in the order of precedence."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.col("path")
    one = rules.where("host is not null and path is not null").groupBy(host.alias("r_host"), path.alias("r_path")).agg(F.max(F.col("verdict") == "block").alias("block"))
    verdict = F.when(F.col("block"), F.lit("block")).otherwise(F.lit("allow"))
    size = (F.length("r_host") + F.length("r_path")).alias("size")
    return one.select(F.struct(size, F.length("r_host").alias("of_host"), F.concat("r_host", "r_path").alias("rule"), verdict.alias("verdict")).alias("fit"), _digest(F.col("r_host"), F.col("r_path")).alias("r_digest"))


def _sizes(rules: DataFrame) -> tuple[int, int, list[int]]:
    """Labels and path length that rules have at most, and the lengths of paths without a slash at their end: as many as there are different lengths."""
    given = rules.where("host is not null and path is not null")
    most, longest = given.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    open_ = given.where(~F.col("path").endswith("/")).select(F.length("path").alias("n")).distinct()
    return most or 0, longest or 0, sorted(r.n for r in open_.collect())


def verdicts(urls: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """rule and verdict of each row (host, path) of urls, which differ from each other; further columns stay."""
    most, longest, lengths = _sizes(rules)
    if not most:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    given = _prepared(rules).withColumns({"short": F.substring("r_digest", 1, SHORT), "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    wide = urls.withColumns({"suffix": F.explode(suffixes(F.col("host"), most)), "prefix": F.explode(prefixes(F.col("path"), longest, lengths))})
    digest = _digest(F.col("suffix"), F.col("prefix"))
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    asked = wide.select(*urls.columns, digest.alias("digest"), salt.alias("salt")).withColumn("short", F.substring("digest", 1, SHORT))
    met = asked.join(given, ["short", "salt"], "left")
    fit = F.max(F.when(F.col("digest") == F.col("r_digest"), F.col("fit"))).alias("fit")
    out = met.groupBy("host", "path").agg(*(F.first(c).alias(c) for c in urls.columns if c not in ("host", "path")), fit)
    return out.select(*urls.columns, F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(otherwise)).alias("verdict"))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule (the text of the deciding rule, null without one) and verdict."""
    kept = set_aside(pages, *({"host", "path", "rule", "verdict"} - {url.lower()}))
    host, path = host_and_path(F.col(url))
    placed = kept.withColumns({"__host": host, "__path": path})
    if url.lower() in ("host", "path", "rule", "verdict"):
        placed = set_aside(placed, url.lower())
    placed = placed.withColumnsRenamed({"__host": "host", "__path": "path"})
    urls = placed.groupBy("host", "path").agg(F.count("*").alias("__rows"))
    judgements = materialise(verdicts(urls, rules, otherwise), "verdicts")
    return joined_hot(placed, judgements, ["host", "path"], "__rows")
