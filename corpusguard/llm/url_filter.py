"""URL filters: pattern rules found by their rarest literal token.

Every rule states the literal tokens that a URL must have for its regular
expression to match. The rarest of them, by the number of distinct URLs of the
table that have it, is the rule's key in an index. Each distinct URL is cut into
tokens, a join with the index fetches candidate rules, and only those rules'
regular expressions run. Verdicts go back to the rows by URL, so a URL that many
rows have is judged once.

All steps are built-in functions. Rules are a literal table of the driver's, so
their number is known; up to ``BROADCAST_RULES`` they are sent to every task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name``: what a result shows. ``regex``: searched in host + path.
    ``literals``: tokens that every match has. ``place``: a rule of a higher place
    goes before all of a lower one; within a place the longest name wins."""

    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]
    place: int = 0
    shown: bool = field(default=True)


def path_rule(rule: str, verdict: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains, where the URL's path
    starts with the rule's."""
    host, slash, path = rule.partition("/")
    # The last piece of the path may go on in the URL, so it is no whole token.
    whole = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path.lower())
    return Rule(rule, verdict, rf"^([^/]*\.)?{_quoted(host)}{_quoted(slash + path)}", tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", host) + whole)), 1)


def host_word(*words: str) -> Rule:
    """A rule that blocks hosts with the words, joined by hyphens, as a label or
    as a part of one."""
    word = "-".join(words)
    return Rule(word, "block", rf"^[^/]*(?:^|[.-]){_quoted(word)}(?:[.:/-]|$)", words, 0, False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


#: The host and path rules.
RULES = [
    path_rule("com/en/", "block"),
    path_rule("example.com/en/7", "allow"),
    path_rule("net/de/", "block"),
    path_rule("example.net/de/8", "block"),
    path_rule("org/es/", "block"),
]
#: Words that unwanted hosts call themselves by.
BLOCKED_WORDS = [
    "adult",
    "ads",
    "bet",
    "bets",
    "betting",
    "casino",
    "casinos",
    "clickbait",
    "escort",
    "escorts",
    "gambling",
    "jackpot",
    "lottery",
    "malware",
    "nsfw",
    "payday",
    "phishing",
    "pills",
    "poker",
    "porn",
    "porno",
    "sex",
    "slots",
    "spam",
    "torrent",
    "torrents",
    "tracker",
    "viagra",
    "warez",
    "xxx",
]
DEFAULT_RULES = RULES + [host_word(w) for w in BLOCKED_WORDS]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: list[Rule] | None = None, otherwise: str = "allow") -> DataFrame:
    """``pages(url, ...)`` → its columns with ``host, path, rule, verdict``.

    ``rule``: the name of the deciding rule if it is one that is shown, else null.
    URLs that no rule matches get the verdict ``otherwise``. A null url, or one
    without ``://``, has an empty host and path, which no default rule matches.
    Given columns of these four names are replaced. Rows repeat as given; an empty
    table gives no rows.
    """
    rules = DEFAULT_RULES if rules is None else rules
    if missing := [r.name for r in rules if not r.literals]:
        raise ValueError(f"rules without a literal token: {missing}")
    spark = pages.sparkSession
    made = ("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("url"))
    kept = [c for c in pages.columns if c not in made]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not rules:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))

    # Each distinct URL with its distinct tokens.
    urls = rows.select("host", "path").where("host <> ''").distinct()
    whole = F.concat("host", "path")
    tokens = F.array_distinct(F.split(F.lower(whole), "[^a-z0-9]+"))
    cut = urls.select("host", "path", F.explode(tokens).alias("token")).where("token <> ''")

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df

    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.regex, list(r.literals), r.place, r.shown) for i, r in enumerate(rules)],
        "number int, rule string, verdict string, regex string, literals array<string>, place int, shown boolean",
    )
    literals = table.select("number", F.explode("literals").alias("token"))
    seen = cut.join(sent(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("number").orderBy(F.coalesce("n", F.lit(0)), "token")
    index = literals.join(seen, "token", "left").withColumn("rank", F.row_number().over(order)).where("rank = 1").select("number", "token")
    index = index.join(table, "number")

    matched = cut.join(sent(index), "token").where(F.expr("concat(host, path) rlike regex"))
    best = F.max_by(F.struct("rule", "verdict", "shown"), F.struct("place", F.length("rule").alias("n"), "rule"))
    decided = matched.groupBy("host", "path").agg(best.alias("best"))
    out = rows.join(decided, ["host", "path"], "left")
    return out.select(*kept, "host", "path", F.when(F.col("best.shown"), F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


ORACLE = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
),
rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
fits AS (
  SELECT s.host, s.path, r.rule, r.verdict, row_number() OVER (PARTITION BY s.host, s.path ORDER BY length(r.rule) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules r
    ON ('.' || s.host) LIKE ('%.' || split_part(r.rule, '/', 1)) AND starts_with(s.path, substr(r.rule, instr(r.rule, '/')))
)
SELECT s.page_id, s.host, s.path, f.rule,
  coalesce(f.verdict, CASE WHEN regexp_matches(s.host, '(^|[.-])({"|".join(BLOCKED_WORDS)})([.:-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON f.n = 1 AND f.host = s.host AND f.path = s.path
"""
