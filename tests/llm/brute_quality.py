"""Plain Python of the quality verdicts: references, distances and limits from the rows themselves."""

import math
from collections import Counter

import brute

from tracewright.llm import quality as Q

NAMES = sorted({w for words in Q.COMMON.values() for w in words})


def shares(text):
    """Shares of character classes and of common words, and both totals."""
    classes = [0] * 7
    for c in text:
        o = ord(c)
        kind = 6 if o > 127 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\f\r" else 4 if c in "#*$%&|<>" else 5
        classes[kind] += 1
    common = Counter(w if w in NAMES else None for w in (brute._lower(w) for w in brute.WORD.findall(text)))
    words = [common[n] for n in NAMES] + [common[None]]
    share = lambda x: [v / max(sum(x), 1) for v in x]
    return share(classes), share(words), sum(classes), sum(words)


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: math.fsum(a * math.log2(a / c) for a, c in zip(x, m) if a)
    return math.sqrt(max(kl(p) + kl(q), 0) / 2)


def median(values):
    values = sorted(values)
    return values[(len(values) + 1) // 2 - 1]


def kept(rows):
    """(base failed, kept, class distance, word distance) of each row, in order."""
    langs = [lang if lang in Q.COMMON else "" for _, _, lang, _ in rows]
    measured = [shares(t or "") for _, t, *_ in rows]
    failed = [brute.quality(t)[5] for _, t, *_ in rows]
    refs, far = {}, [None] * len(rows)
    for lang in [*Q.COMMON, ""]:
        for members in ([i for i, x in enumerate(langs) if x == lang and not failed[i]], [i for i in range(len(rows)) if not failed[i]]):
            if len(members) >= Q.MIN_DOCS or len(members) == sum(not f for f in failed):
                break
        sums = [[sum(round(1e6 * measured[i][k][j]) for i in members) for j in range(len(measured[0][k]))] for k in (0, 1)]
        refs[lang] = [[v / max(sum(s), 1) for v in s] for s in sums]
    for i, (c, w, n_chars, n_words) in enumerate(measured):
        ref = refs[langs[i]]
        far[i] = (distance(c, ref[0]) if n_chars >= Q.CLASS_GUARD else 0.0, distance(w, ref[1]) if n_words >= Q.WORD_GUARD else 0.0)
    limit = {}
    steps = [round(1000 * f[0]) / 1000 for f in far]
    seen = [i for i in range(len(rows)) if not failed[i] and measured[i][2] >= Q.CLASS_GUARD]
    for lang in refs:
        mine = [steps[i] for i in seen if langs[i] == lang]
        mine = mine if len(mine) >= Q.MIN_DOCS else [steps[i] for i in seen]
        middle = median(mine) if mine else 0.0
        spread = 1.4826 * median([abs(k / 1000 - middle) for k in (round(1000 * x) for x in mine)]) if mine else 0.0
        common = refs[lang][1]
        none = [0.0] * len(NAMES) + [1.0]
        word = Q.WORD_SHARE * distance(none, common) if 1 - common[-1] >= Q.WORD_COMMON else Q.WORD_LIMIT
        limit[lang] = (middle + max(Q.CLASS_SPREADS * spread, Q.CLASS_LEAST), word)
    return [(failed[i], not failed[i] and far[i][0] <= limit[langs[i]][0] and far[i][1] <= limit[langs[i]][1], *far[i]) for i in range(len(rows))]
