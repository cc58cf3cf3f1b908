import random
import re

import pytest
from pyspark.sql import functions as F

from linkweave.llm import url_filters
from linkweave.llm.url_filters import HOST_RULES, PATTERN_RULES, candidates, host_rule, judge, line_rule, read_rules, split_url, token_counts

URLS = [None, "", "no scheme.net/", "http://a.net", "http://net/", "http://NET/x", "https://x.example.net/en/1", "https://example.net/en", "https://example.NET/en/?q", "https://badexample.net/en/", "http://example.com/de/a#b", "http://m.example.com/DE/a", "ftp://u.org/fr/", "http://org/fr/x?y://z", "http://x.io/casino/a", "http://x.io/Casinos", "http://casino.io?poker", "http://x.io/a#login", "x://y://z.net/", "http://a.net/é\n/poker"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = []
    for r in HOST_RULES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.name), r.name, r.verdict))
    if fits:
        return host, path, *max(fits)[1:]
    low = (host + path).lower()
    return host, path, None, "block" if any(re.search(r.pattern, low) for r in PATTERN_RULES) else "allow"


def test_equals_brute_force(spark, monkeypatch):
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    for at_once in (2000, 3):
        monkeypatch.setattr(url_filters, "RULES_AT_ONCE", at_once)
        got = {r.page_id: tuple(r)[1:] for r in judge(frame).collect()}
        assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_plan_is_native_and_shuffles_no_rows(spark):
    plan = judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_repeated_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert judge(frame).count() == 3 and judge(frame.limit(0)).collect() == []


def test_rule_tokens_are_in_every_match():
    assert host_rule("example.net/en/", "allow").tokens == ("example", "net", "en")
    assert host_rule("example.net/en", "allow").tokens == ("example", "net")


@pytest.mark.parametrize(
    ("line", "fits", "not_fits"),
    [
        ("||ads.example.org^", ["ads.example.org/", "x.ads.example.org/a", "ads.example.org"], ["badads.example.org/", "ads.example.orgs/", "a.net/ads.example.org/"]),
        ("/banner/*/img^", ["a.net/banner/x/img", "a.net/x/banner/a/b/img/9"], ["a.net/banner/img", "a.net/banner/x/imgs"]),
        ("|shop.net/cart", ["shop.net/cart", "shop.net/carts"], ["a.shop.net/cart"]),
        ("swf|", ["a.net/x.swf", "a.net/xswf"], ["a.net/x.swf/1"]),
        ("@@||Good.net/Track", ["good.net/track/1"], ["good.net/"]),
        ("-ad-*.gif", ["a.net/x-ad-1.gif"], ["a.net/x-ad-1xgif"]),
    ],
)
def test_lines_of_rules(line, fits, not_fits):
    rule = line_rule(line)
    assert rule.verdict == ("allow" if line.startswith("@@") else "block")
    for url in fits:
        assert re.search(rule.pattern, url) and set(rule.tokens) <= set(re.split("[^a-z0-9]+", url)), url
    assert not any(re.search(rule.pattern, url) for url in not_fits)


def test_no_rules_in_comments():
    assert read_rules(["! a comment", "", "  ", "||a.net^"]) == (line_rule("||a.net^"),)


def test_thousands_of_rules_equal_brute_force(spark):
    r = random.Random(6)
    word = lambda n=250: f"{r.choice('abcdefgh')}{r.randrange(n)}"
    lines = [r.choice((f"||{word()}.net^", f"||{word()}.org/{word(60)}/", f"/{word()}/*/{word(60)}^", f"|{word()}.net/{word()}", f"-{word()}-", f"@@||{word()}.net/{word(60)}", f"{word()}*{word()}", f".{word()}|")) for _ in range(4000)]
    rules = read_rules(lines)
    urls = [f"http://{r.choice(('', 'www.'))}{word()}.{r.choice(('net', 'org'))}/{word(60)}/{word()}{r.choice('/-.')}{word()}{r.choice('/-.')}{word(60)}" for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in judge(frame, HOST_RULES, rules).collect()}
    blocked = 0
    for i, u in enumerate(urls):
        host, path, name, verdict = brute(u)
        low = (host + path).lower()
        if name is None:
            fits = [(p.weight, p.verdict) for p in rules if re.search(p.pattern, low)]
            verdict = max(fits, key=lambda x: (x[0], x[1]))[1] if fits else "allow"
            blocked += verdict == "block"
        assert got[i] == (name, verdict), u
    assert blocked > 20
    judged = split_url(frame).withColumn("_tokens", url_filters._tokens())
    seen = token_counts(judged, rules)
    with_token = tuple(p for p in rules if p.tokens)
    n = judged.select(F.size(candidates(with_token, seen)).alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert n[0] < 40 and n[1] < 200, n
