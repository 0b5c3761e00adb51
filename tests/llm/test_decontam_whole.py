"""Decontamination against all alignments: items of any length, and windows that only just reach the similarity."""

import random

import brute
import corpus_pipeline
import pytest
from tracewright.llm import decontam, queries


def leaks(rows, items, window=20, similarity=0.75):
    """Like brute.leaks, for items of any length."""
    out = set()
    for i, t, *_ in rows:
        w = brute.tokens(t)
        for item, text in items:
            b = brute.tokens(text)
            n = min(window, len(b))
            if i is None or not b:
                continue
            for d in range(-len(b) + n, len(w) - n + 1):
                eq = [b[k] == w[k + d] for k in range(max(0, -d), min(len(b), len(w) - d))]
                if any(sum(eq[k : k + n]) >= similarity * n for k in range(len(eq) - n + 1)):
                    out.add((i, item))
                    break
    return out


def _words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def _tables(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def _pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"broadcast_seeds": 0, "broadcast_hits": 0}])
def test_short_items(spark, limits):
    rng = random.Random(31)
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(1, 14)] + [(50, "これは短い質問です"), (51, ""), (52, None)]
    rows = [(100 + k, " ".join(_words(rng, 20)) + f" {t}; " + " ".join(_words(rng, 9))) for k, t in items if t]
    for n in range(4, 14):  # one token in another place of each item
        w = items[n - 1][1].split()
        w[rng.randrange(n)] = "zz"
        rows.append((200 + n, " ".join(_words(rng, 5) + w)))
    rows += [(300, " ".join(_words(rng, 60))), (301, items[0][1]), (302, None), (None, items[4][1])]
    found = _pairs(decontam.contaminated(*_tables(spark, rows, items), least_item=1, **limits))
    assert found == leaks(rows, items)
    assert {(100 + k, k) for k, t in items if t} <= found and {d for d, _ in found if 200 <= d < 300} == set(range(204, 214))


def test_registered_query_and_stage_take_short_items(spark, tmp_path):
    rows, items = [(1, "before what is the capital after"), (2, "nothing of that kind")], [(7, "What is the capital?")]
    for df, name in zip(_tables(spark, rows, items), ("documents", "benchmark"), strict=True):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert _pairs(queries.op3_decontamination(spark, str(tmp_path))) == {(1, 7)}
    left = corpus_pipeline.leaks(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r["doc_id"] for r in left.collect()] == [2]


def test_no_window_is_missed(spark):
    """Random substitutions down to 75 %, and every fifth token at each phase."""
    rng = random.Random(32)
    items = [(k, " ".join(_words(rng, n))) for k, n in enumerate((11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 40, 59))]
    rows, planted = [], set()

    def plant(k, w):
        rows.append((len(rows), " ".join(_words(rng, 12) + w + _words(rng, 12))))
        planted.add((rows[-1][0], k))

    for k, t in items:
        w = t.split()
        n = min(20, len(w))
        for _ in range(30):
            at = rng.randrange(len(w) - n + 1)
            part = w[at : at + n]
            for j in rng.sample(range(n), n - -(-3 * n // 4)):
                part[j] = "zz"
            plant(k, part)
        for phase in range(5):
            if len(w) >= 20:
                plant(k, ["zz" if j % 5 == phase else x for j, x in enumerate(w)])
    docs, bench = _tables(spark, rows, items)
    found = _pairs(decontam.contaminated(docs.repartition(4), bench))
    assert planted <= found and found == leaks(rows, items)


@pytest.mark.parametrize(("window", "similarity"), [(8, 0.6), (20, 0.9), (12, 1.0), (30, 0.5)])
def test_other_rules(spark, window, similarity):
    rng = random.Random(33)
    items = [(k, " ".join(f"v{rng.randrange(30)}" for _ in range(n))) for k, n in enumerate((1, 2, 5, 9, 14, 33))]
    rows = [(len(items) * j + k, " ".join("zz" if rng.random() < (1 - similarity) else x for x in t.split())) for j in range(12) for k, t in items]
    found = _pairs(decontam.contaminated(*_tables(spark, rows, items), window=window, similarity=similarity, least_item=1))
    assert found == leaks(rows, items, window, similarity)
