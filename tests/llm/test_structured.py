"""Regular strings that sums modulo 2**64 cannot tell apart, texts of several chunks, and buckets of several levels."""

import random

import brute
import numpy as np
import pytest

from tracewright.llm import bytekit as K
from tracewright.llm import neardup, quality, substring, suffix


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def ordered(xs):
    return sorted(map(tuple, xs), key=repr)


def compare(df, expected, *cols):
    assert ordered(df.select(*cols).collect()) == ordered(expected)


@pytest.fixture(scope="module")
def regular():
    """Words, lines and runs of 1,024 and 4,096 characters with their complements."""
    rng, texts = random.Random(21), []
    for n in (1024, 4096):
        for a, b in (("a", "b"), ("b", "a")):
            word = thue_morse(n, a, b)
            texts += [word, " ".join([word] * 25), f"{word}\n{thue_morse(n, b, a)}\nshort line", thue_morse(n, f"{a} ", f"{b} "), thue_morse(n, f"{a}{a} ", f"{b}{a} ")]
            texts.append(" ".join(f"{word}{k}" for k in range(24)) + " " + brute.prose(rng, 30))
    texts.append("\n".join(thue_morse(2048, *p) for p in ("ab", "ba", "ab")) + " " + brute.prose(rng, 200))
    return [(k + 1, t, "en", "s") for k, t in enumerate(texts)]


def test_substring_of_regular_texts(spark, regular):
    compare(substring.substring_dedup(brute.frame(spark, regular), digest=True), brute.substring(regular), "doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize(("hot", "batch"), [(24, 512), (1, 16)])
def test_suffix_of_regular_texts(spark, regular, hot, batch):
    compare(suffix.suffix_dedup(brute.frame(spark, regular), digest=True, hot=hot, batch=batch), brute.suffix(regular), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_quality_of_regular_texts(spark, regular):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    compare(quality.quality_report(brute.frame(spark, regular)), ((i, *brute.quality(t)) for i, t, *_ in regular), *cols)


def test_near_duplicates_of_regular_texts(spark, regular):
    compare(neardup.near_duplicates(brute.frame(spark, regular)), brute.near(regular), "doc_id", "n_shingles", "component_id", "kept")


def test_windows_that_share_a_hash_are_compared(monkeypatch):
    """Repeated windows are found word by word, even if all windows meet under one hash."""
    rng = random.Random(22)
    texts = [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(12)]
    monkeypatch.setattr(K.Words, "windows", lambda self, w: (np.zeros(len(self.hash), K.U), self.pos + w <= self.counts[self.doc]))
    import pyarrow as pa

    assert quality.measure(pa.array(texts))["n_repeat_words"].tolist() == [brute.quality(t)[4] for t in texts]


def test_spans_and_products():
    rng = np.random.default_rng(23)
    a, b = (rng.integers(0, 2**61 - 1, 500).astype(K.U) for _ in range(2))
    p = 2**61 - 1
    assert K.product(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b)]
    buf = rng.integers(0, 256, 70_000).astype(np.uint8)
    s = K.Spans(buf)
    starts = rng.integers(0, 60_000, 50)
    got = s.of(starts, starts + 1000)
    for i, at in enumerate(starts):
        assert K.Spans(buf[at : at + 1000].copy()).of(np.array([0]), np.array([1000]))[0] == got[i]
    assert len(np.unique(K.grams(buf, 16))) == len(buf) - 15
    assert (K.grams(buf[5:], 9) == K.grams(buf, 9)[5:]).all() and len(K.grams(buf[:7], 8)) == 0


def test_windows_of_every_width():
    rng = random.Random(24)
    text = " ".join(rng.choice("ab") for _ in range(300)).encode()
    w = K.Words(np.frombuffer(text, np.uint8), np.array([0, 200, len(text)]))
    words = [text[a:b] for a, b in zip(w.starts, w.ends)]
    for n in (1, 2, 3, 5, 7, 8, 13, 20, 31):
        h, whole = w.windows(n)
        by = {}
        for k in np.flatnonzero(whole):
            by.setdefault(tuple(words[k : k + n]), set()).add(int(h[k]))
        assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    long = [b"x" * n for n in (1, 7, 8, 9, 63, 64, 65, 66, 200)] + [b"x" * 64 + b"y", b"x" * 8 + b"\0", b"\0" * 9]
    buf, ends = np.frombuffer(b"".join(long * 2), np.uint8), np.cumsum([len(x) for x in long * 2])
    h = K.word_hashes(buf, np.append(0, ends[:-1]), ends)
    assert (h[: len(long)] == h[len(long) :]).all() and len(set(h.tolist())) == len(long)
    assert K.Words(np.zeros(0, np.uint8), np.array([0, 0])).windows(3)[0].size == 0


def test_family_holds_several_levels(spark):
    """One bucket, contexts of many documents around a shared passage: several batches and levels, with and without trimming."""
    rng = random.Random(25)
    passage = brute.prose(rng, 160)
    rows = [(k, f"{brute.prose(rng, 12)} {passage} {brute.prose(rng, 12)}", "en", "s") for k in range(30)]
    rows += [(100 + k, rows[k][1], "en", "s") for k in range(12)]  # pairs of copies hold the edges twice
    levels = []
    family = suffix.IndexFamily.add

    def spy(self, *args):
        family(self, *args)
        levels.append(sum(x is not None for x in self.levels))

    expected = brute.suffix(rows)
    for hot, batch in ((10**6, 8), (4, 8), (4, 512)):
        compare(suffix.suffix_dedup(brute.frame(spark, rows), digest=True, hot=hot, batch=batch), expected, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    texts = [t.encode() for _, t, *_ in rows]
    suffix.IndexFamily.add = spy
    try:
        fam = suffix.IndexFamily(400, 128)
        for i in range(0, 42, 3):
            part = [t[:500] for t in texts[i : i + 3]]
            fam.add(part, np.full(len(part), 64), np.zeros((len(part), 128), bool))
    finally:
        suffix.IndexFamily.add = family
    assert max(levels) >= 3


@pytest.fixture(scope="module")
def long_rows():
    """Texts of over 1 MiB (several chunks and stretches) that share passages with each other and with short ones."""
    rng = random.Random(26)
    vocab = [f"{rng.randrange(16**6):06x}" for _ in range(30_000)]
    words = rng.choices(vocab, k=190_000)
    shared = rng.choices(vocab, k=120)
    long_a = " ".join(words[:95_000] + shared + words[95_000:])
    long_b = " ".join(rng.choices(vocab, k=170_000) + shared + words[1000:1100])
    return [(1, long_a, "en", "s"), (2, long_b, "en", "s"), (3, " ".join(shared), "en", "s"), (4, " ".join(words[150_000:150_200]), "en", "s"), (5, long_a, "en", "s"), (6, None, "en", "s")]


def test_long_texts_substring(spark, long_rows):
    compare(substring.substring_dedup(brute.frame(spark, long_rows), digest=True), brute.substring(long_rows), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_long_texts_suffix(spark, long_rows):
    """Held against hashes of all strings by Python's own ``hash`` of slices, over a window of the text that is short enough."""
    rows = [(i, t and t[: 1_150_000], lang, s) for i, t, lang, s in long_rows if i in (2, 3, 6)] + [(7, long_rows[1][1][1_040_000:1_060_000], "en", "s")]
    compare(suffix.suffix_dedup(brute.frame(spark, rows), digest=True), brute.suffix(rows), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_long_texts_quality(spark, long_rows):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    compare(quality.quality_report(brute.frame(spark, long_rows)), ((i, *brute.quality(t)) for i, t, *_ in long_rows), *cols)


def test_long_texts_near(spark, long_rows):
    compare(neardup.near_duplicates(brute.frame(spark, long_rows)), brute.near(long_rows), "doc_id", "n_shingles", "component_id", "kept")


def test_family_of_edited_copies(spark, monkeypatch):
    """All pairs are near the limit: few are verified at first, and no link between components is lost."""
    rng, rows = random.Random(27), []
    base = [f"w{k}" for k in range(400)]
    for k in range(60):  # pairs agree in about three quarters of their shingles
        words = list(base)
        for j in rng.sample(range(0, 400, 5), 6):
            words[j] = f"x{k}-{j}"
        rows.append((k, " ".join(words), "en", "s"))
    rows += [(100 + k, " ".join(f"y{k}-{j}" for j in range(40)), "en", "s") for k in range(5)]
    told = []
    cluster = neardup._cluster
    sets = [neardup._distinct(*neardup.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0] for _, t, *_ in rows[:60]]
    for near in (1, 8, 10**6):
        monkeypatch.setattr(neardup, "NEAR", near)
        told.append(cluster(np.array([len(s) for s in sets]), neardup.wide_bits(sets)))
    assert [len(t[0]) for t in told] == sorted({len(t[0]) for t in told}) and len(told[1][0]) <= 480 and told[0][1] and told[1][1] and not told[2][1]
    assert all(len(t[0]) + len(t[1]) >= len(told[2][0]) for t in told)
    for near in (1, 8):
        monkeypatch.setattr(neardup, "NEAR", near)
        compare(neardup.near_duplicates(brute.frame(spark, rows)), brute.near(rows), "doc_id", "n_shingles", "component_id", "kept")
