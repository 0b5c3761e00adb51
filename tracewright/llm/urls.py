"""URL filter: host word segmentation, then multinomial naive Bayes, under rules.

Rules come first: a rule fits its host and all subdomains of it if the path
starts with the rule's path; the longest rule decides. Where none fits, the
method does: names in host and path are split into words by unigram Viterbi,
and multinomial naive Bayes over the words gives block or allow.

Unigrams are words of all pages' text, counted in parallel and kept above a share
of MIN_SHARE of all words, which bounds the model to 1 / MIN_SHARE words. Names of
urls are not counted: a host would else be a word of its own and never be split.

The classifier is fitted on labelled rows: urls that a rule decides. Its unit is
the host, not the page: all pages of a host with one verdict are one observation,
with each word of the host and each distinct word of its paths, so that a large
host does not teach its own name. At most TRAIN_ROWS distinct (host, verdict, path
name) are taken, picked by hash of the host. A hyphen of a host is a token like its
words. What the rules themselves name (a suffix, a language) says nothing where no
rule fits, so these names, numbers and words under three letters are no features.
The fixed word lists below are a prior: each word counts SEED_WEIGHT times, which
is once, as if one host had it. A url is blocked if the odds of block exceed
BLOCK_ODDS to one.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule, and is judged by the class priors alone; a null html counts no words;
null and repeated ids are judged row by row. Other columns are ignored; an
empty table gives an empty result, and no labelled rows leave the word lists.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TRAIN_ROWS = 20_000
SEED_WEIGHT = 1
MIN_SHARE = 1e-5
BLOCK_ODDS = 5.0
LONGEST = 24
# Words that name unwanted and ordinary sites.
BLOCK_WORDS = ("adult", "bet", "betting", "bonus", "casino", "cheap", "crack", "dating", "escort", "free", "gambling", "hack", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "payday", "pharmacy", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "torrent", "viagra", "warez", "x", "xxx")
ALLOW_WORDS = ("about", "archive", "article", "blog", "book", "college", "docs", "edu", "forum", "gov", "guide", "health", "help", "history", "journal", "library", "learn", "museum", "news", "open", "paper", "press", "research", "school", "science", "search", "study", "support", "university", "weather", "wiki")

_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[^\W\d_]+|\d+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWERED), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, tail = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(tail))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _ruled(pages: DataFrame, url_col: str, keep: list[Column], rules: tuple) -> DataFrame:
    base = pages.select(*keep, F.col(url_col).alias("__tw_url"))
    host, path = host_and_path(F.col("__tw_url"))
    return base.withColumn("host", host).withColumn("path", path).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).drop("__tw_url")


def unigrams(pages: DataFrame, html_col: str = "html", min_share: float = MIN_SHARE) -> dict[str, float]:
    """Log-probability of each word that makes up at least ``min_share`` of all words of all pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            for html in b.column(0).to_pylist():
                n.update(_WORD.findall(_TAG.sub(" ", html or "").lower()))
            words = [w for w in n if len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64())], names=["word", "n"])

    counted = pages.select(F.col(html_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = settle(counted)
    every = counted.agg(F.sum("n")).first()[0] or 0
    kept = counted.where(F.col("n") >= max(2, every * min_share)).collect()  # at most 1 / min_share words
    listed = Counter({r["word"]: r["n"] for r in kept})
    floor = max(1, int(every * min_share))
    for w in (*BLOCK_WORDS, *ALLOW_WORDS):
        listed[w] = max(listed[w], floor)
    every = max(every, sum(listed.values()))
    return {w: math.log(n / every) for w, n in listed.items()}


class Segmenter:
    """Unigram Viterbi; a character outside all words costs more than any word."""

    def __init__(self, model: dict[str, float]):
        self.model, self.seen = model, {}
        self.unknown = (min(model.values()) if model else 0.0) - 10.0
        self.longest = max(map(len, model), default=1)

    def words(self, name: str) -> tuple[str, ...]:
        if name in self.seen:
            return self.seen[name]
        if len(self.seen) > 100_000:
            self.seen.clear()
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            top, at = best[j - 1] + self.unknown, j - 1
            for i in range(max(0, j - self.longest), j):
                p = self.model.get(name[i:j])
                if p is not None and best[i] + p > top:
                    top, at = best[i] + p, i
            best.append(top)
            back.append(at)
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return self.seen.setdefault(name, tuple(reversed(out)))


def features(host: str, path: str, cut: Segmenter, named: frozenset[str] = frozenset()) -> list[str]:
    """Hyphens of the host and segmented words of host and path, without those in ``named``, numbers and words under three letters."""
    words = [w for name in _NAME.findall(host + " " + path.lower()) if name not in named and not name[0].isdigit() for w in cut.words(name)]
    return ["-"] * host.count("-") + [w for w in words if len(w) > 2 and w not in named]


def rule_names(rules: tuple) -> frozenset[str]:
    return frozenset(name for rule, _ in rules for name in _NAME.findall(rule))


class Bayes:
    """Multinomial naive Bayes with add-one smoothing: log odds of block."""

    def __init__(self, rows: list[tuple[list[str], bool]], seed_weight: int = SEED_WEIGHT):
        n: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
        docs = Counter({True: 1, False: 1})
        for words, block in rows:
            n[block].update(words)
            docs[block] += 1
        for block, seeds in ((True, BLOCK_WORDS), (False, ALLOW_WORDS)):
            for w in seeds:
                n[block][w] += seed_weight
        v = len(n[True].keys() | n[False].keys())
        size = {k: sum(c.values()) + v for k, c in n.items()}
        self.odds = {w: math.log((n[True][w] + 1) / size[True]) - math.log((n[False][w] + 1) / size[False]) for w in n[True].keys() | n[False].keys()}
        self.prior = math.log(docs[True] / docs[False])

    def score(self, words: list[str]) -> float:
        return self.prior + math.fsum(self.odds.get(w, 0.0) for w in words)


def labelled(ruled: DataFrame, train_rows: int = TRAIN_ROWS) -> list[tuple[str, str, list[str]]]:
    """(host, rule's verdict as ``block``, names in paths) of the hosts that rules decide, from at most ``train_rows`` distinct rows."""
    names = F.array_distinct(F.array_append(F.regexp_extract_all(F.lower("path"), F.lit(r"\p{L}+"), F.lit(0)), F.lit("")))
    rows = ruled.select("host", "verdict", F.explode(names).alias("name")).distinct()
    sample = rows.orderBy(F.xxhash64("host"), "host", "verdict", "name").limit(train_rows).collect()
    found: dict[tuple[str, str], list[str]] = {}
    for r in sample:
        found.setdefault((r["host"], r["verdict"]), []).append(r["name"])
    return [(host, verdict, names) for (host, verdict), names in sorted(found.items())]


def fitted(hosts: list[tuple[str, str, list[str]]], cut: Segmenter, rules: tuple = RULES) -> Bayes:
    named = rule_names(rules)
    return Bayes([(features(host, " ".join(names), cut, named), verdict == "block") for host, verdict, names in hosts])


def fit(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: tuple = RULES, train_rows: int = TRAIN_ROWS, min_share: float = MIN_SHARE) -> tuple[Segmenter, Bayes]:
    cut = Segmenter(unigrams(pages, html_col, min_share))
    ruled = _ruled(pages, url_col, [], rules).where(F.col("rule").isNotNull())
    verdict = F.lit(None).cast("string")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    return cut, fitted(labelled(ruled.select("host", "path", verdict.alias("verdict")), train_rows), cut, rules)


def held_out(hosts: list[tuple[str, str, list[str]]], cut: Segmenter, rules: tuple = RULES, folds: int = 5, odds: float = BLOCK_ODDS) -> tuple[int, int, int, int]:
    """Of hosts that were not fitted on: rightly blocked, wrongly blocked, missed, rightly allowed, by the rules' verdicts."""
    named, out = rule_names(rules), [0, 0, 0, 0]
    fold = lambda host: zlib.crc32(host.encode()) % folds
    for k in range(folds):
        bayes = fitted([h for h in hosts if fold(h[0]) != k], cut, rules)
        for host, verdict, names in (h for h in hosts if fold(h[0]) == k):
            says = bayes.score(features(host, " ".join(names), cut, named)) > math.log(odds)
            out[(0 if says else 2) if verdict == "block" else (1 if says else 3)] += 1
    return tuple(out)


def url_filter(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's log odds of block for every row."""
    cut, bayes = fit(pages, url_col, html_col, rules, train_rows)
    verdicts, named = dict(rules), rule_names(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = [bayes.score(features(h, p, cut, named)) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            verdict = [verdicts[r] if r else "block" if o > math.log(BLOCK_ODDS) else "allow" for r, o in zip(b.column(3).to_pylist(), odds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(verdict, pa.string()), pa.array(odds, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "block_odds"])

    ruled = _ruled(pages, url_col, [F.col(id_col).cast("long").alias("page_id")], rules).select("page_id", "host", "path", "rule")
    return ruled.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, block_odds double")
