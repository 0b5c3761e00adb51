"""The URL filter's whole query against plain Python: counts, segmentation, naive Bayes and verdicts."""

import math
import re
from collections import Counter
from functools import lru_cache

import pytest

from tracewright.llm import queries, urls


def judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in urls.RULES if (host == (h := r[: r.index("/")]) or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def letters(text):
    return re.findall(r"[^\W\d_]+", text)


def brute(pages):
    """page_id: (host, path, rule, verdict, odds)."""
    counts = Counter(w for _, _, html in pages for w in letters(re.sub(r"<[^>]*>", " ", html or "").lower()) if len(w) <= 24)
    total = sum(counts.values())
    model = {w: n for w, n in counts.items() if n >= max(2, total * 1e-5)}
    for w in urls.BLOCK_WORDS + urls.ALLOW_WORDS:
        model[w] = max(model.get(w, 0), max(1, int(total * 1e-5)))
    total = max(total, sum(model.values()))
    cost = {w: math.log(n / total) for w, n in model.items()}
    strange = min(cost.values()) - 10

    @lru_cache(None)
    def best(name):
        if not name:
            return 0.0, ()
        ends = []
        for k in range(1, len(name) + 1):
            word, rest = name[-k:], name[:-k]
            if word in cost:
                ends.append((best(rest)[0] + cost[word], rest, word))
            elif k == 1:
                ends.append((best(rest)[0] + strange, rest, word))
        score, rest, word = max(ends, key=lambda e: e[0])
        return score, (*best(rest)[1], word)

    named = {n for rule, _ in urls.RULES for n in re.findall(r"[^\W\d_]+|\d+", rule)}

    def words(text):
        return [w for name in letters(text) if name not in named for w in best(name)[1] if len(w) > 2 and w not in named]

    verdicts, seen = dict(urls.RULES), {}
    for _, url, _ in pages:
        host, path, rule = judge(url)
        if rule:
            seen.setdefault((host, verdicts[rule]), set()).update(letters(path.lower()))
    tokens = {"block": Counter(urls.BLOCK_WORDS), "allow": Counter(urls.ALLOW_WORDS)}
    hosts = Counter({"block": 1, "allow": 1})
    for (host, verdict), names in seen.items():
        tokens[verdict].update(["-"] * host.count("-") + words(host) + [w for n in names for w in words(n)])
        hosts[verdict] += 1
    vocabulary = tokens["block"].keys() | tokens["allow"].keys()
    share = {v: {w: (tokens[v][w] + 1) / (sum(tokens[v].values()) + len(vocabulary)) for w in vocabulary} for v in tokens}
    out = {}
    for page, url, _ in pages:
        host, path, rule = judge(url)
        odds = math.log(hosts["block"] / hosts["allow"]) + sum(math.log(share["block"][w] / share["allow"][w]) for w in ["-"] * host.count("-") + words(host) + words(path.lower()) if w in vocabulary)
        out[page] = (host, path, rule, verdicts.get(rule, "block" if odds > math.log(urls.BLOCK_ODDS) else "allow"), odds)
    return out


def same(rows, expected):
    got = {r["page_id"]: r for r in rows}
    assert got.keys() == expected.keys()
    for page, (host, path, rule, verdict, odds) in expected.items():
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert math.isclose(r["block_odds"], odds, abs_tol=1e-6)
        assert r["verdict"] == verdict or abs(odds - math.log(urls.BLOCK_ODDS)) < 1e-6


def test_whole_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = queries.QUERIES["op2_url_filter"](spark, sf).collect()
    assert rows[0].asDict().keys() >= {"page_id", "host", "path", "rule", "verdict"}
    same(rows, brute(pages))


def test_odd_rows(spark):
    """Nulls, repeated rows and ids, hyphens, long urls and texts."""
    html = "<p>" + "cheap pills and a library of books " * 40_000 + "</p>"
    pages = [
        (1, "http://buy-now.example.com/de/x", html), (2, "http://buy-now.example.com/en/x", None), (3, None, "cheap cheap"), (4, "http://net/" + "a" * 300, "x"),
        (5, "https://cheappills.example.org/en/" + "library/" * 150_000, "books"), (6, "http://library.org/fr/books", "<b>books</b>"), (7, "no scheme", ""),
    ]
    rows = [*pages, pages[0], (2, "http://other.example.com/en/x", "pills")]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and len({(r["page_id"], r["url"] if "url" in r else r["host"], r["verdict"]) for r in got}) == len(rows) - 1
    once = [r for r in got if r["host"] != "other.example.com"]
    expected = brute(rows)
    same([r for r in once if r["page_id"] != 2], {k: v for k, v in expected.items() if k != 2})


@pytest.mark.parametrize("weight", [0, 1])
def test_words_are_not_needed_for_planted_hosts(weight):
    """Hosts are told apart by what hosts of one verdict share, not by the names of large hosts."""
    cut = urls.Segmenter({w: math.log(0.01) for w in ("buy", "now", "win", "big", "river", "stone", "cloud", "field", "lake")})
    hosts = [(f"{a}-{b}.com", "block", [""]) for a, b in (("buy", "now"), ("win", "big"), ("buy", "big"))] + [(f"{a}{b}.com", "allow", [""]) for a, b in (("river", "stone"), ("cloud", "field"), ("lake", "stone"))]
    named = urls.rule_names(urls.RULES)
    bayes = urls.Bayes([(urls.features(h, "", cut, named), v == "block") for h, v, _ in hosts], weight)
    assert bayes.score(urls.features("win-now.com", "", cut, named)) > math.log(urls.BLOCK_ODDS) > bayes.score(urls.features("riverfield.com", "", cut, named))
    assert sum(urls.held_out(hosts, cut)) == len(hosts)
