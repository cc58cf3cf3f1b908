"""URL filters: every rule is a regular expression, indexed by its rarest literal token.

A url's tokens fetch candidate rules from the index, and only those run their expression. The index is a constant of the
plan: an array of slots by the tokens' hashes, so a token costs one look, however many rules there are. All of it is
DataFrame functions inside one projection: nothing is shuffled but the counts of the rules' own tokens.

Rules are written as lines: ``||host/path`` (the host and its subdomains), ``|`` at either end (the start or the end of
host and path), ``*`` (anything), ``^`` (a separator or the end), ``@@`` in front (allow), ``!`` (a comment). Of the rules
that fit, host rules decide, the longest first; then those that allow; then those that block.

Edge cases: a null url, and one without ``://``, has an empty host and path, no rule and the verdict of no pattern
(allow). Rules without a whole literal token are candidates of every url. Repeated rows each get their own verdict;
columns other than page_id and url don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_key

#: Rules that one projection holds as literals; more rules are applied in as many projections.
RULES_AT_ONCE = 50_000


@dataclass(frozen=True)
class Rule:
    """pattern runs on host + path; tokens: literals, cut out by non-alphanumeric characters, that any match contains."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int


def host_rule(name: str, verdict: str) -> Rule:
    """``example.net/en/``: the host and all its subdomains, where the path starts with what follows the host."""
    host, _, rest = name.partition("/")
    whole = f"/{rest}"
    cut = re.findall(r"[a-z0-9]+", host) + [t for t in re.findall(r"[a-z0-9]+(?=[^a-z0-9])", whole)]
    pattern = r"^([^/]*\.)?" + re.escape(host).replace("\\-", "-") + re.escape(whole).replace("\\-", "-")
    return Rule(name, pattern, tuple(dict.fromkeys(cut)), verdict, 1000 + len(name))


def word_rule(word: str) -> Rule:
    """Blocks urls that have the word between delimiters."""
    return Rule(word, rf"(^|[^a-z0-9]){re.escape(word)}([^a-z0-9]|$)", (word,), "block", len(word))


_SIGNS = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}


def line_rule(line: str) -> Rule | None:
    """The rule of a line, in lower case; None for a comment and an empty line."""
    line = line.strip()
    if not line or line.startswith("!"):
        return None
    allow = line.startswith("@@")
    body = line[2 * allow :].lower()
    start = 2 if body.startswith("||") else 1 if body.startswith("|") else 0
    end = body.endswith("|") and len(body) > start
    body = body[start : len(body) - end]
    middle = "".join(_SIGNS.get(c, c if c.isalnum() else "\\" + c) for c in body)
    pattern = ("", "^", r"^([^/]*\.)?")[start] + middle + "$" * end
    # A token has to be whole in any url that fits: no wildcard and no open end next to it.
    whole = ("" if start else "*") + body + ("" if end else "*")
    tokens = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", whole)
    return Rule(line, pattern, tuple(dict.fromkeys(tokens)), "allow" if allow else "block", len(body) + 500 * allow)


def read_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    return tuple(r for r in map(line_rule, lines) if r)


HOST_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
PATTERN_RULES = tuple(map(word_rule, ("casino", "poker", "porn", "xxx", "viagra", "torrent", "login", "signup", "cart", "checkout")))


def split_url(df: DataFrame) -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    raw = F.regexp_extract(F.col("_rest"), "^[^/?#]*", 0)
    return (
        df.withColumn("_rest", rest)
        .withColumn("_raw", raw)
        .withColumn("host", ascii_lower(F.col("_raw")))
        .withColumn("path", F.regexp_extract(F.substr(F.col("_rest"), F.length("_raw") + F.lit(1)), "^[^?#]*", 0))
        .drop("_rest", "_raw")
    )


def _tokens() -> Column:
    return F.array_distinct(F.split(ascii_lower(F.concat("host", "path")), "[^a-z0-9]+"))


def _lookup(index: dict[str, list[int]]) -> Callable[[Column], Column]:
    """The numbers that a token has in the index, none if it isn't there: a constant array of slots by the tokens' hashes."""
    slots: list[list[dict]] = [[] for _ in range(max(1, 2 * len(index)))]
    for token, ids in index.items():
        slots[text_key(token.encode()) % len(slots)].append({"token": token, "rules": ids})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<token:string,rules:array<int>>>>")
    slot = lambda t: F.get(table, F.pmod(F.xxhash64(t), F.lit(len(slots))).cast("int"))
    return lambda t: F.flatten(F.transform(F.filter(slot(t), lambda e: e["token"] == t), lambda e: e["rules"]))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many urls hold each literal token of the rules: as many numbers as the rules have tokens."""
    known = _lookup({t: [0] for r in rules for t in r.tokens})
    held = urls.select(F.explode(F.filter(_tokens(), lambda t: F.size(known(t)) > 0)).alias("t"))
    return {t: n for t, n in held.groupBy("t").count().collect()}


def candidates(rules: tuple[Rule, ...], seen: dict[str, int]) -> Column:
    """The numbers of the rules that the row's _tokens fetch."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(i)
    fetched = F.flatten(F.transform("_tokens", _lookup(index)))
    always = [i for i, r in enumerate(rules) if not r.tokens]
    return F.concat(fetched, F.from_json(F.lit(json.dumps(always)), "array<int>")) if always else fetched


def _best_of(rules: tuple[Rule, ...], exact: set[Rule], seen: dict[str, int]) -> Column:
    """The weightiest of the candidate rules whose expression fits, or null."""
    rows = [{"weight": r.weight, "rule": r.name if r in exact else None, "verdict": r.verdict, "pattern": r.pattern, "exact": r in exact} for r in rules]
    body = F.from_json(F.lit(json.dumps(rows)), "array<struct<weight:int,rule:string,verdict:string,pattern:string,exact:boolean>>")
    found = F.transform(candidates(rules, seen), lambda i: F.get(body, i))
    fits = F.filter(found, lambda r: F.regexp_like(F.when(r["exact"], F.col("_whole")).otherwise(F.col("_low")), r["pattern"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["weight"].alias("weight"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def judge(pages: DataFrame, host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. The longest fitting host rule decides; else a pattern that fits, allowing ones first."""
    urls = split_url(pages.select("page_id", "url"))
    rules = (*host_rules, *pattern_rules)
    seen: dict[str, int] = {}
    for k in range(0, len(rules), RULES_AT_ONCE):
        seen |= token_counts(urls, rules[k : k + RULES_AT_ONCE])
    df = urls.withColumn("_tokens", _tokens()).withColumn("_low", ascii_lower(F.concat("host", "path"))).withColumn("_whole", F.concat("host", "path"))
    found = []
    for k in range(0, len(rules), RULES_AT_ONCE):
        df = df.withColumn(f"_f{k}", _best_of(rules[k : k + RULES_AT_ONCE], set(host_rules), seen))
        found.append(F.col(f"_f{k}"))
    best = F.greatest(*found) if len(found) > 1 else found[0]
    return df.withColumn("_best", best).select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit("allow")).alias("verdict"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_WORDS = "|".join(r.name for r in PATTERN_RULES)
OP3_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
             ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT p.*, (SELECT max({{'n': length(r.rule), 'rule': r.rule, 'verdict': r.verdict}}) FROM r
             WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict
       WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
