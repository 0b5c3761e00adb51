"""Each distance of the quality rules rejects, alone, texts that only it can reject."""

import random
from collections import Counter

import brute
from tracewright.llm import quality

ENGLISH = [w for w in quality.COMMON["en"] if len(w) > 1]


def _text(rng, n, common, end=" "):
    return "".join((rng.choice(ENGLISH) if rng.random() < common else rng.choice(brute.VOCAB)) + end for _ in range(n))


def test_each_distance_rejects_alone(spark):
    rng = random.Random(21)
    plain = [(i, _text(rng, 200, 0.23), "en", "s") for i in range(300)]
    bare = [(1000 + i, _text(rng, 200, 0), "en", "s") for i in range(10)]  # like the others, but no common word
    bars = [(2000 + i, "".join(w + (" | " if k % 2 else " ") for k, w in enumerate(_text(rng, 200, 0.23).split())), "en", "s") for i in range(10)]  # a bar after every other word
    df = brute.frame(spark, plain + bare + bars)
    out = {r["doc_id"]: r for r in quality.quality_report(df).collect()}
    refs = quality.references(df)
    steps = Counter(round(quality.STEPS * r["class_distance"]) for r in out.values())
    limit = quality.limits([("en", k, n) for k, n in steps.items()], refs)["en"]
    assert not any(r["base_failed"] for r in out.values())
    assert all(out[i]["kept"] for i, *_ in plain)
    assert all(out[i]["word_distance"] > limit[1] and out[i]["class_distance"] < limit[0] and not out[i]["kept"] for i, *_ in bare)
    assert all(out[i]["word_distance"] < limit[1] and limit[0] < out[i]["class_distance"] < 0.30 and not out[i]["kept"] for i, *_ in bars)
    assert {r["doc_id"] for r in quality.quality_filter(df).select("doc_id").collect()} == {i for i, *_ in plain}


def test_rare_common_words_reject_nobody(spark):
    """Where a language hardly uses the listed words, a text without them is as good as the others."""
    rng = random.Random(22)
    rows = [(i, _text(rng, 120, 0.02), "xx", "s") for i in range(100)]
    out = quality.quality_report(brute.frame(spark, rows)).collect()
    assert all(r["kept"] for r in out)
