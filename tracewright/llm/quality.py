"""Quality rules: fixed base rules, then divergence from language references.

Per text, with words ``[^\\x20\\x09-\\x0D]+``: the base rule fails below
MIN_WORDS words, or if more than REPEAT_PERCENT of them lie in 8-word windows
that the text has twice. Texts that pass are compared with the reference of
their language by Jensen-Shannon distance (base 2): their histogram of
character classes, and their histogram of common words of all languages, each
only above a minimum length. A text is kept unless the base rule fails or a
distance exceeds its limit.

Limits follow the corpus, by language. Classes: the median distance of the texts
that pass the base rule, plus CLASS_SPREADS robust deviations, at least
CLASS_LEAST. Common words: WORD_SHARE of the distance that a text without any
common word has; but where common words make up less than WORD_COMMON of the
reference, so that a short text may well have none, WORD_LIMIT.

References are means over all texts of a language that pass the base rule, in
integer millionths, so that they do not depend on the order of rows. A language
with fewer than MIN_DOCS such texts takes the mean of all texts. There are at
most as many references as COMMON has languages, plus one for all others.
Spreads come from counts of distances in thousandths, with the same exception
for few texts, so they do not depend on the order of rows either.

Defined cases: null and empty texts have no words and fail; a null or unknown
language uses the common reference of such rows; every row is judged by itself,
whatever its id, and repeated rows agree. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as K
from .scratch import settle

# Frequent function words of four languages.
COMMON = {
    "de": ("aber", "als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "er", "es", "für", "ich", "im", "in", "ist", "mit", "nicht", "sich", "sie", "so", "und", "von", "war", "zu"),
    "en": ("a", "and", "are", "as", "at", "be", "by", "for", "from", "he", "her", "his", "i", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you"),
    "es": ("al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "más", "no", "o", "para", "por", "que", "se", "su", "un", "una", "y"),
    "fr": ("au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour", "que", "qui", "sur", "un", "une"),
}
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
MIN_DOCS = 50
#: least size: characters for the classes, words for the common words
CLASS_GUARD, WORD_GUARD = 200, 60
CLASS_SPREADS, CLASS_LEAST = 12, 0.05
WORD_SHARE, WORD_COMMON, WORD_LIMIT = 0.9, 0.1, 0.45
#: distances are counted in steps of 1 / STEPS
STEPS = 1000
MARKS = b"#*$%&|<>"

TOTALS = "lang string, at int, sum long"
_NAMES = sorted({w for words in COMMON.values() for w in words})


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 space, 4 marks, 5 other ASCII, 6 other script, 7 inner byte."""
    c = np.full(256, 5, np.uint8)
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[K.SPACE] = 3
    c[list(MARKS)] = 4
    c[0xC0:] = 6
    c[0x80:0xC0] = 7
    return c


_CLASS = _classes()
N_CLASS, N_WORD = 7, len(_NAMES) + 1


def _name_hashes() -> tuple[np.ndarray, np.ndarray]:
    raw = [n.encode() for n in _NAMES]
    ends = np.cumsum([len(r) for r in raw])
    h = K.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]), ends)
    order = np.argsort(h)
    return h[order], order


_HASHES, _ORDER = _name_hashes()


def measure(column: pa.Array | pa.ChunkedArray) -> dict[str, np.ndarray]:
    """Counts of each text: words, chars, marks, dup_lines, repeats, classes (n, 7), common (n, words + 1)."""
    buf, off = K.utf8(column)
    n = len(off) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out |= {"classes": np.zeros((n, N_CLASS), np.int64), "common": np.zeros((n, N_WORD), np.int64)}
    for i, j in K.chunks(off):
        _measure(buf[off[i] : off[j]], off[i : j + 1] - off[i], {k: v[i:j] for k, v in out.items()})
    out["word_chars"][:] = out["classes"].sum(1) - out["classes"][:, 3]
    out["n_symbols"][:] = out["classes"][:, 4]
    return out


def _measure(buf: np.ndarray, off: np.ndarray, out: dict[str, np.ndarray]) -> None:
    n = len(off) - 1
    if not len(buf):
        return
    kind = _CLASS[buf]
    for d in range(n):
        out["classes"][d] = np.bincount(kind[off[d] : off[d + 1]], minlength=8)[:N_CLASS]
    w = K.Words(buf, off)
    out["n_words"][:] = w.counts
    # words in windows that the text has twice
    at = _repeated(w)
    edge = np.zeros(len(w.starts) + REPEAT_WINDOW + 1, np.int32)
    edge[at] += 1
    np.add.at(edge, at + REPEAT_WINDOW, -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(edge)[: len(w.starts)] > 0)))
    out["n_repeat_words"][:] = total[w.first[1:]] - total[w.first[:-1]]
    # lines with a word that equal an earlier line
    feed = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate((off[:-1], feed + 1)))
    starts = starts[starts < len(buf)]
    ends = np.append(starts[1:], len(buf))
    doc = np.searchsorted(off, starts, "right") - 1
    ends = ends - (buf[ends - 1] == 10)
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    code = K.coded(buf, buf != 10, ends - starts)
    lines = doc[has] * (int(code.max(initial=0)) + 1) + code[has]
    order = np.argsort(lines, kind="stable")
    same = np.flatnonzero(lines[order][1:] == lines[order][:-1]) + 1
    out["n_dup_lines"][:] = np.bincount(doc[has][order][same], minlength=n)
    # common words
    low = K.word_hashes(K.LOWERED[buf], w.starts, w.ends)
    k = np.searchsorted(_HASHES, low)
    k[k == len(_HASHES)] = 0
    name = np.where(_HASHES[k] == low, _ORDER[k], N_WORD - 1)
    out["common"][:] = np.bincount(w.doc * N_WORD + name, minlength=n * N_WORD).reshape(n, N_WORD)


def _repeated(w: K.Words) -> np.ndarray:
    """Starts of windows whose words the same text has in another window: met by hash, then compared word by word."""
    h, whole = w.windows(REPEAT_WINDOW)
    at = np.flatnonzero(whole)
    key = K.joined(h[at], w.doc[at].astype(K.U))
    mine = K.within(key, K.distinct(key)[1])
    at, key = at[mine], key[mine]
    if not len(at):
        return at
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    inside = np.zeros(len(w.starts) + REPEAT_WINDOW + 1, np.int32)
    inside[at] += 1
    np.add.at(inside, at + REPEAT_WINDOW, -1)
    words = np.flatnonzero(np.cumsum(inside)[: len(w.starts)] > 0)
    code = np.zeros(len(w.starts), np.int64)
    code[words] = w.codes(words)
    rows = np.column_stack((w.doc[at], *(code[at + k] for k in range(REPEAT_WINDOW))))
    if (rows[1:] != rows[:-1])[key[1:] == key[:-1]].any():  # a hash stands for several windows
        _, group, often = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        at = at[often[group.reshape(-1)] > 1]
    return np.sort(at)


def _base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` to the same row of ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0).sum(1) for x in (p, q)]
    return np.sqrt(np.maximum(kl[0] + kl[1], 0) / 2)


def _language(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x if x in COMMON else "" for x in column.to_pylist()]


def _summed(parts: Iterator[tuple[dict[str, np.ndarray], list[str]]]) -> Iterator[pa.RecordBatch]:
    """Per language: the number of texts that pass the base rule, and sums of their shares in millionths."""
    total: dict[str, np.ndarray] = {}
    for m, langs in parts:
        vec = np.hstack((np.ones((len(langs), 1)), np.rint(1e6 * _shares(m["classes"])), np.rint(1e6 * _shares(m["common"])))).astype(np.int64)
        vec[_base_failed(m)] = 0
        lang = np.array(langs)
        for x in set(langs):
            total[x] = total.get(x, 0) + vec[lang == x].sum(0)
    if total:
        yield pa.RecordBatch.from_pydict({"lang": [x for x in total for _ in total[x]], "at": [i for x in total for i in range(len(total[x]))], "sum": [int(v) for x in total for v in total[x]]}, pa.schema([("lang", pa.string()), ("at", pa.int32()), ("sum", pa.int64())]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _summed((measure(b.column(0)), _language(b.column(1))) for b in batches)


def _references(rows: list[tuple[str, int, int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    sums: dict[str, np.ndarray] = {}
    for lang, at, s in rows:
        sums.setdefault(lang, np.zeros(1 + N_CLASS + N_WORD))[at] = s
    every = sum(sums.values(), np.zeros(1 + N_CLASS + N_WORD))
    out = {}
    for lang in [*COMMON, ""]:
        v = sums.get(lang, np.zeros(1))
        v = v if v[0] >= MIN_DOCS else every
        out[lang] = tuple(x / max(x.sum(), 1) for x in (v[1 : 1 + N_CLASS], v[1 + N_CLASS :]))
    return out


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean shares of character classes and common words by language, over all documents."""
    return _references(_totals(docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_sums, TOTALS)))


def _distances(m: dict[str, np.ndarray], lang: list[str], refs: dict) -> list[np.ndarray]:
    """Distances of the classes and of the common words, 0 below the guard."""
    names = sorted(refs)
    at = np.array([names.index(x) for x in lang], int)
    far = []
    for key, k, guard in (("classes", 0, CLASS_GUARD), ("common", 1, WORD_GUARD)):
        d = distance(_shares(m[key]), np.stack([refs[x][k] for x in names])[at])
        far.append(np.where(m[key].sum(1) >= guard, d, 0.0))
    return far


def _spread(parts: Iterator[tuple[dict[str, np.ndarray], list[str]]], refs: dict) -> Iterator[pa.RecordBatch]:
    """Per language and step: the number of texts above the guard that pass the base rule with that class distance."""
    total: Counter[tuple[str, int]] = Counter()
    for m, lang in parts:
        if lang:
            step = np.rint(STEPS * _distances(m, lang, refs)[0]).astype(int)
            seen = ~_base_failed(m) & (m["classes"].sum(1) >= CLASS_GUARD)
            total.update((lang[i], int(step[i])) for i in np.flatnonzero(seen))
    if total:
        yield pa.RecordBatch.from_pydict({"lang": [x for x, _ in total], "at": [k for _, k in total], "sum": list(total.values())}, pa.schema([("lang", pa.string()), ("at", pa.int32()), ("sum", pa.int64())]))


def _median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])


def limits(rows: list[tuple[str, int, int]], refs: dict) -> dict[str, tuple[float, float]]:
    """Greatest distances of the classes and of the common words by language."""
    counts: dict[str, np.ndarray] = {}
    for lang, at, n in rows:
        counts.setdefault(lang, np.zeros(STEPS + 1, np.int64))[at] = n
    every = sum(counts.values(), np.zeros(STEPS + 1, np.int64))
    steps = np.arange(STEPS + 1) / STEPS
    out = {}
    for lang, (_, common) in refs.items():
        n = counts.get(lang, np.zeros(1, np.int64))
        n = n if n.sum() >= MIN_DOCS else every
        middle = _median(steps, n) if n.sum() else 0.0
        spread = 1.4826 * _median(np.abs(steps - middle), n) if n.sum() else 0.0
        none = np.zeros((1, N_WORD))
        none[0, -1] = 1
        word = WORD_SHARE * float(distance(none, common[None])[0]) if 1 - common[-1] >= WORD_COMMON else WORD_LIMIT
        out[lang] = (middle + max(CLASS_SPREADS * spread, CLASS_LEAST), word)
    return out


def judge(m: dict[str, np.ndarray], lang: list[str], refs: dict, most: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept, and the two distances (0 below the guard)."""
    if not lang:
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0), np.zeros(0)
    far = _distances(m, lang, refs)
    failed = _base_failed(m)
    limit = np.array([most[x] for x in lang])
    return failed, ~failed & (far[0] <= limit[:, 0]) & (far[1] <= limit[:, 1]), *far


def _totals(parts: DataFrame) -> list[tuple[str, int, int]]:
    return [tuple(r) for r in parts.groupBy("lang", "at").agg(F.sum("sum").alias("sum")).collect()]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LONGS = ", ".join(f"{k} long" for k in BASE)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = measure(b.column(1))
        hist = np.hstack((m["classes"], m["common"])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in BASE), pa.array([r.tobytes() for r in hist], pa.binary()), pa.array(_language(b.column(2)))], names=["doc_id", *BASE, "hist", "lang"])


def _unpacked(b: pa.RecordBatch) -> tuple[dict[str, np.ndarray], list[str]]:
    m = {k: b.column(1 + i).to_numpy() for i, k in enumerate(BASE)}
    hist = np.frombuffer(b"".join(b.column(1 + len(BASE)).to_pylist()), np.int32).reshape(b.num_rows, N_CLASS + N_WORD)
    return m | {"classes": hist[:, :N_CLASS].astype(np.int64), "common": hist[:, N_CLASS:].astype(np.int64)}, b.column(b.num_columns - 1).to_pylist()


def _fitted(docs: DataFrame, doc_id: Column, text_col: str, lang_col: str) -> tuple[DataFrame, dict, dict]:
    """The counts of every row, written; the references and the limits."""
    features = settle(docs.select(doc_id.cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_measured, f"doc_id long, {LONGS}, hist binary, lang string"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(map(_unpacked, batches))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _spread(map(_unpacked, batches), refs)

    refs = _references(_totals(features.mapInArrow(sums, TOTALS)))
    return features, refs, limits(_totals(features.mapInArrow(spread, TOTALS)), refs)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every row."""
    features, refs, most = _fitted(docs, F.col(id_col), text_col, lang_col)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, lang = _unpacked(b)
            failed, kept, far_class, far_word = judge(m, lang, refs, most)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in BASE), pa.array(failed), pa.array(kept), pa.array(far_class), pa.array(far_word)], names=["doc_id", *BASE, "base_failed", "kept", "class_distance", "word_distance"])

    return features.mapInArrow(judged, f"doc_id long, {LONGS}, base_failed boolean, kept boolean, class_distance double, word_distance double")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that pass, unchanged: one scan for references and limits, one to filter."""
    _, refs, most = _fitted(docs, F.lit(None), text_col, lang_col)
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(judge(measure(b.column(text)), _language(b.column(lang)), refs, most)[1]))

    return docs.mapInArrow(keep, docs.schema)
