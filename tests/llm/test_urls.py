import re

import pytest

from orrery.llm import urls

URLS = [
    "https://www.example.org/es/1", "http://EXAMPLE.org/en/12?x", "http://example.org/en/2", "http://a.com/fr/", "http://a.com/de/x#y", "http://com/fr/z", "http://acom/fr/z",
    "http://notexample.org/es/", "https://x.org?q=/es/", "https://x.org", "ftp://cheap-pills.example.net/a", "http://m.spam-farm.b.net/", "http://fine.net/cheap/pills", "no scheme", None, "", "://",
    "http://a.net/wp-login.php?x=1", "http://a.net/x?sessionid=0123456789abcdef0", "http://a.net\n/b", "http://a.com/fr/", "http://x.example.org/es/://y"]


def _brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in urls.PREFIX_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda f: len(f[0]))
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
    return host, path, None, "block" if any(re.search(p, low) for p, _, v in urls.PATTERN_RULES if v == "block") else "allow"


@pytest.mark.parametrize("limit", [urls.BROADCAST_RULES, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(k, u, "mine", 1) for k, u in enumerate(URLS)], "page_id long, url string, verdict string, extra int").repartition(3)
    rows = urls.filter_urls(pages, urls.compile_rules(spark)).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == _brute(URLS[r.page_id]), URLS[r.page_id]


def test_rarest_token_and_refusal(spark):
    pages = spark.createDataFrame([(k, f"http://common.rare{k % 5}.net/") for k in range(20)], "page_id long, url string")
    rules = urls.compile_rules(spark, (), ((r"common\.rare1\.", (("common", "rare1"),), "block"),))
    assert [r.token for r in urls.index_rules(rules, pages.select("url")).collect()] == ["rare1"]
    with pytest.raises(Exception, match="literal token"):
        urls.index_rules(urls.compile_rules(spark, (), (("x", ((),), "block"),)), pages.select("url")).collect()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(pages, urls.compile_rules(spark)).count() == 0


def test_thousands_of_rules_with_alternatives(spark):
    """Against every rule's expression run on every URL; a common word of all URLs is never the token that fetches."""
    patterns = tuple((rf"^[a-z]+://([^/?#]*\.)?(bad{k}|evil{k})-shop\.", ((f"bad{k}", "shop"), (f"evil{k}", "shop")), "block" if k % 3 else "allow") for k in range(3000))
    found = [f"http://www.{('bad', 'evil', 'good')[k % 3]}{k * 7 % 4000}-shop.net/{'x' * (k % 5)}" for k in range(600)] + ["http://bad3-shop.evil9-shop.org/", "http://x.net/" + "y" * 100_000, None, "bad1-shop.net"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(found)], "page_id long, url string")
    rules = urls.compile_rules(spark, (), patterns)
    index = urls.index_rules(rules, pages.select("url"))
    assert index.count() == 6000 and index.where("token = 'shop'").isEmpty()
    compiled = [(re.compile(p), p, v) for p, _, v in patterns]
    for r in urls.filter_urls(pages, rules).collect():
        url = found[r.page_id]
        fits = [(len(p), v == "block", p, v) for c, p, v in compiled if url and "://" in url and c.search(url)]
        assert r.verdict == (max(fits)[3] if fits else "allow"), url
