"""Every engine query against its SQL; those without SQL against plain Python."""

import pytest

from tracewright.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_without_sql(spark, sf):
    sizes = {r["method"]: r for r in QUERIES["size_report"](spark, sf).collect()}
    assert sizes["raw"]["bytes"] == sizes["raw"]["raw_bytes"] > sizes["zstd-19"]["bytes"]
    trained = QUERIES["trained_dictionary_report"](spark, sf).collect()
    assert len(trained) == 17 and all(r["bytes"] < r["raw_bytes"] for r in trained)
    codes = QUERIES["huffman_lengths"](spark, sf).collect()
    assert sum(2.0 ** -r["bits"] for r in codes) == 1.0
    assert len({r["code"] for r in codes}) == len(codes) and all(len(r["code"]) == r["bits"] for r in codes)
    mined = QUERIES["drain_templates"](spark, sf).collect()
    assert sum(r["n_lines"] for r in mined) == 1000 and len(mined) <= 6


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_equals_scan_for_random_terms(spark, sf):
    """Completeness: pruning by index never drops a hit."""
    import random

    from tracewright.operators import index, search
    from tracewright.sources import tables as S

    lines = index.packets(S.document_lines(S.table(spark, sf, "documents")), 8, 8, "doc_id").cache()
    tokens = index.token_index(lines).cache()
    text = " ".join(r["line"] for r in lines.limit(400).collect())
    rng = random.Random(5)
    for _ in range(6):
        at = [rng.randrange(len(text) - 8) for _ in range(2)]
        terms = [text[a : a + rng.randrange(1, 7)].strip() or "e" for a in at]
        for mode in ("and", "or"):
            whole = search.keywords(lines, terms, mode).select("doc_id", "line_no")
            found = search.indexed(lines, tokens, terms, mode).hits.select("doc_id", "line_no")
            assert sorted(whole.collect()) == sorted(found.collect())
