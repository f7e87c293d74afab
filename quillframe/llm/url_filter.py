"""URL filters: pattern rules that URL tokens fetch from an index.

Each rule has a literal part; its index token is the one of its whole literal tokens that is rarest among the tokens of all URLs at hand.
The index is a table of tokens and rules. The URLs' own tokens are joined with it, and only the rules that this fetches run their regular
expressions. Spark broadcasts the index while it is small, and else joins by sorting; so there may be any number of rules. Each distinct
URL is judged once, and its verdict joined to its rows.

Defined cases: a null URL, or one without `://`, has empty host and path and matches no rule. Rows that repeat a URL are judged alike.
Rules without tokens are tried on every URL. Among rules that match, site rules (a host with its subdomains and a path prefix) come before
patterns, and the longest wins; ties go to the first in the list. Columns may have any names; those that `judge` makes are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """regex runs over host and path together; tokens are maximal runs of a-z and 0-9 that a lower-cased match has whole."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(name: str, verdict: str) -> Rule:
    """`example.org/es/`: that host and its subdomains, paths that begin with `/es/`."""
    host, _, rest = name.partition("/")
    path = "/" + rest
    whole = re.split(TOKEN, path.lower())
    tokens = [*re.split(TOKEN, host.lower()), *(whole if not whole[-1] else whole[:-1])]  # a prefix may end inside a token
    return Rule(name, verdict, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path)}".replace("\\/", "/"), tuple(t for t in tokens if t), True)


def host_pattern(words: str, verdict: str = "block") -> Rule:
    """`cheap-pills`: hosts in which these tokens follow each other."""
    return Rule(words, verdict, f"^[^/]*(?<![a-z0-9]){re.escape(words)}(?![a-z0-9])", tuple(re.split(TOKEN, words)))


#: Site rules of the production list, then patterns of hosts that sell or spam.
RULES = [
    *(site_rule(n, v) for n, v in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))),
    *map(host_pattern, ("spam-farm", "cheap-pills", "free-casino", "casino", "porn", "xxx", "viagra", "payday-loans", "torrent")),
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), TOKEN), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row for each rule; place is its place in the list."""
    rows = [(i, r.site, len(r.name), r.name, r.verdict, r.regex, list(dict.fromkeys(r.tokens))) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "place int, site boolean, length int, name string, verdict string, regex string, tokens array<string>")


def index_of(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """rules by `token`: of each rule's tokens the one that the fewest of the URLs' tokens (a column `token`) equal, the first of them on a tie; the empty token for a rule without tokens."""
    own = rules.select("place", F.posexplode("tokens").alias("nth", "token"))
    counts = tokens.join(own.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = own.join(counts, "token", "left").groupBy("place").agg(F.min_by("token", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "nth")).alias("token"))
    return rules.drop("tokens").join(rarest, "place", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge(pages: DataFrame, rules: list[Rule] = RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the site rule that decided, or null), pattern (the pattern that did, or null) and verdict."""
    made = ("host", "path", "rule", "pattern", "verdict")
    numbered = [f"c{k}" for k in range(len(pages.columns))]  # by place, so that no name can clash
    url = F.col(numbered[pages.columns.index(url_col)])
    read = pages.toDF(*numbered).withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("text", F.concat("host", "path"))
    texts = read.select("text").filter("text <> ''").distinct()
    table = rule_table(pages.sparkSession, rules)
    asked = texts.select("text", F.explode(F.concat(_tokens(F.col("text")), F.array(F.lit("")))).alias("token"))
    index = written(index_of(table, asked.select("token")))
    matching = asked.join(index, "token").filter(F.regexp_like("text", F.col("regex")))
    first = F.struct("site", "length", (-F.col("place")).alias("turn"))
    # as a table its size is known: broadcast while small, else joined by sorting, with hot URLs split
    best = written(matching.groupBy("text").agg(F.max_by(F.struct("site", "name", "verdict"), first).alias("best")).select("text", "best.*"))
    kept = [F.col(n).alias(c) for n, c in zip(numbered, pages.columns, strict=True) if c not in made]
    return read.join(best, "text", "left").select(
        *kept, "host", "path", F.when(F.col("site"), F.col("name")).alias("rule"), F.when(~F.col("site"), F.col("name")).alias("pattern"), F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def sql(rules: list[Rule] = RULES) -> str:
    """The same judgement in DuckDB, rule by rule."""
    sites = sorted((r for r in rules if r.site), key=lambda r: -len(r.name))
    quoted = lambda x: x.replace("'", "''")

    def fits(r: Rule) -> str:
        host, _, rest = r.name.partition("/")
        return f"((host = '{quoted(host)}' or ends_with(host, '.{quoted(host)}')) and starts_with(path, '/{quoted(rest)}'))"

    patterns = [r for r in rules if not r.site]
    bounded = lambda r: f"regexp_matches(host, '(^|[^a-z0-9]){quoted(re.escape(r.name))}([^a-z0-9]|$)')"
    return f"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages
), m as (
  select *, case {' '.join(f"when {fits(r)} then '{quoted(r.name)}'" for r in sites)} end as rule from u
)
select page_id, host, path, rule, case {' '.join(f"when rule = '{quoted(r.name)}' then '{r.verdict}'" for r in sites)}
  when {' or '.join(map(bounded, patterns))} then 'block' else 'allow' end as verdict
from m
"""
