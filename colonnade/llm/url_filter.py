"""Verdicts on URLs by host rules and wildcard patterns, found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import column
from colonnade.session import local_table

#: Up to so many rules travel to every task; more are joined by their token.
BROADCAST_RULES = 50_000

#: Hosts and places that are no reading matter: `*` stands for any characters.
PATTERNS = (
    "casino-*", "*.casino-*", "*-casino.*", "*.casino/*", "poker-*", "*.poker-*", "*-poker.*", "*/gambling/*",
    "*-betting.*", "*.xxx/*", "*/porn/*", "*.porn.*", "*/adult/*", "*.adult.*", "*-viagra.*", "*/viagra/*", "*-pills.*",
    "*/phishing/*", "*/malware/*", "*/warez/*", "*/torrent/*", "*-payday-*", "*.exe", "*.zip", "*.apk",
    "*/wp-login.php*", "*/wp-admin/*", "*/cgi-bin/*", "*.doubleclick.net/*", "*/login/*", "*/signup/*",
)


@dataclass(frozen=True)
class Rule:
    """What a URL's host and path must match as a regular expression to get the verdict."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    of_host: bool


def _full_tokens(text: str, open_left: bool, open_right: bool) -> list[str]:
    """The runs of letters and digits in a literal that nothing can lengthen."""
    found = []
    for m in re.finditer(r"[a-z0-9]+", text.lower()):
        if not (open_left and m.start() == 0 or open_right and m.end() == len(text)):
            found.append(m[0])
    return found


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_" or ord(c) > 127 else "\\" + c for c in text)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """For a host, its subdomains, and paths that start with `path`."""
    text = host.lower() + path
    regex = r"^(?:[^/]*\.)?" + _quoted(text)
    return Rule(text, verdict, regex, tuple(_full_tokens(text, False, True)), True)


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    """For a wildcard pattern over host and path."""
    parts = pattern.split("*")
    tokens = []
    for k, part in enumerate(parts):
        tokens += _full_tokens(part, k > 0, k < len(parts) - 1)
    return Rule(pattern, verdict, "(?s)^" + ".*".join(map(_quoted, parts)) + "$", tuple(tokens), False)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(subject: Column) -> Column:
    """Distinct runs of letters a-z and digits, and the empty token, under which rules without literal are."""
    lowered = F.translate(subject, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lowered, "[^a-z0-9]+")))


def _rule_tables(spark: SparkSession, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    columns = {
        "number": list(range(len(rules))), "name": [r.name for r in rules], "verdict": [r.verdict for r in rules],
        "regex": [r.regex for r in rules], "of_host": [r.of_host for r in rules], "length": [len(r.name) for r in rules],
    }
    table = local_table(
        spark, columns, "number long, name string, verdict string, regex string, of_host boolean, length int"
    )
    literal = [(k, t) for k, r in enumerate(rules) for t in dict.fromkeys(r.tokens or ("",))]
    tokens = local_table(
        spark, {"number": [k for k, _ in literal], "token": [t for _, t in literal]}, "number long, token string"
    )
    return table, tokens


def index_rules(subjects: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rules, each under the one of its literal tokens that the fewest subjects hold."""
    spark = subjects.sparkSession
    table, tokens = _rule_tables(spark, rules)
    hint = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    literals = tokens.select("token").distinct()
    held = subjects.select(F.explode(tokens_of(F.col("subject"))).alias("token"))
    counts = held.join(hint(literals), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least")
    best = tokens.join(counts, "token", "left").groupBy("number").agg(rarest)
    return table.join(best, "number").select("name", "verdict", "regex", "of_host", "length", F.col("least.token").alias("token"))


def judge_urls(
    pages: DataFrame, rules: Iterable[Rule], patterns: Iterable[Rule] = tuple(map(pattern_rule, PATTERNS)),
    otherwise: str = "allow", id_column: str = "page_id", url_column: str = "url",
) -> DataFrame:
    """For every row of `pages` the id, `host`, `path`, `rule` (the longest host rule that fits, else null),
    `verdict` (that rule's; else that of the longest pattern that fits; else `otherwise`) and `pattern` (the one
    that decided, else null).

    Each rule stands in an index under its rarest literal token; the tokens of a URL fetch rules, and only their
    regular expressions run.  Of rules of one length the one with the greater verdict, then name, wins.  Null URLs and
    those without `://` have an empty host and path, which no host rule fits.  Equal rows and null ids give a row each;
    other columns are not read.  Different host and path are judged once, however many rows have them.
    """
    rules = [*rules, *patterns]
    url = column(url_column).cast("string")
    parsed = pages.select(column(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    empty = F.lit(None).cast("string")
    if not rules:
        return parsed.select(
            F.col("id").alias(id_column), "host", "path", empty.alias("rule"), F.lit(otherwise).alias("verdict"),
            empty.alias("pattern"),
        )
    subjects = parsed.select("host", "path").distinct().withColumn("subject", F.concat("host", "path"))
    index = index_rules(subjects, rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    candidates = subjects.withColumn("token", F.explode(tokens_of(F.col("subject")))).join(index, "token")
    fits = candidates.filter(F.expr("rlike(subject, regex)"))
    best = F.max(F.struct("of_host", "length", "verdict", "name")).alias("best")
    judged = fits.groupBy("host", "path").agg(best)
    return parsed.join(judged, ["host", "path"], "left").select(
        F.col("id").alias(id_column), "host", "path",
        F.when(F.col("best.of_host"), F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
        F.when(~F.col("best.of_host"), F.col("best.name")).alias("pattern"),
    )
