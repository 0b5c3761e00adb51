"""Plain Python versions of the operators, and a small corpus of difficult rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NO_ID = (1 << 63) - 1
#: names that the operators use inside, to clash with
EXTRA = "home long, key string, rep int, `text2` string, bands string, seed int, w string, host string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
VOCAB = [a + b for a in ("th", "re", "an", "in", "er", "on", "ti", "es") for b in ("the", "ing", "a", "ed", "ou", "le", "né")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(("", "", "", ",", ".", ".\n")) for _ in range(n))


def corpus(seed=1):
    """(doc_id, text, lang, source): copies, near copies, shared passages and lines, odd and empty rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(14)]
    shared, line = prose(rng, 70).replace("\n", " "), "All rights reserved by nobody."
    texts = list(base)
    texts += [base[0]] * 4 + [base[1], base[1] + " tail"]
    for k in range(8):
        words = base[2].split(" ")
        words[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(6)]
    texts += [f"{line}\n{prose(rng, 30)}\n{line}" for _ in range(12)]
    texts += [None, "", " \t\n\x0b\f\r ", "one", "two words", "two words", "é\u00a0é ü\u2003x", "a" * 1500, "the the " * 400, shared, "x\r\ny", "\n\n", "𝔘𝔫𝔦 " * 60]
    texts.append(" ".join(prose(rng, 50) for _ in range(120)))
    rows = [(i * 3 + 1, t, ("en", "de", None, "xx")[i % 4], ("s0", "s0", "s1", None)[i % 4]) for i, t in enumerate(texts)]
    rows += [(None, base[3], "en", "s1"), (None, "null id", "en", "s1"), rows[0], (rows[1][0], base[4], "en", "s0")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "k", 2, "t2", "b", 3, "w", "h") for i, t, lang, s in rows], SCHEMA)


def _cover(n, hits, length):
    edge = [0] * (n + length + 1)
    for k in hits:
        edge[k] += 1
        edge[k + length] -= 1
    out, c = [], 0
    for k in range(n):
        c += edge[k]
        out.append(c > 0)
    return out


def substring(rows, window=20):
    docs = [(NO_ID if i is None else i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, w in docs:
        drop = _cover(len(w), [k for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (i, k)], window)
        kept = " ".join(x for x, d in zip(w, drop) if not d)
        out.append((None if i == NO_ID else i, len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix(rows, length=400):
    docs = [(i, (t or "").encode()) for i, t, *_ in rows]
    n = Counter(t[k : k + length] for _, t in docs for k in range(len(t) - length + 1))
    out = []
    for i, t in docs:
        drop = _cover(len(t), [k for k in range(len(t) - length + 1) if n[t[k : k + length]] > 1], length)
        spans = sum(d and not (k and drop[k - 1]) for k, d in enumerate(drop))
        out.append((i, len(t), sum(drop), spans, hashlib.sha256(bytes(b for b, d in zip(t, drop) if not d)).hexdigest()))
    return out


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingle_set(text):
    w = WORD.findall(_lower(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows):
    """(doc_id, n_shingles, component_id, kept); a set stands under the least id that has it."""
    docs = [(NO_ID if i is None else i, shingle_set(t)) for i, t, *_ in rows]
    rep = {}
    for i, s in docs:
        rep[s] = min(rep.get(s, i), i)
    sets = [s for s in rep if s]
    root = {i: i for i in rep.values()}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(sets):
        for b in sets[:x]:
            if 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((of(rep[a]), of(rep[b])))
                root[q] = p
    named = lambda i: None if i == NO_ID else i
    comp = lambda i, s: of(rep[s]) if s else i
    return [(named(i), len(s), named(comp(i, s)), comp(i, s) == i) for i, s in docs]


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k : k + 8])].append(k)
    repeated = {j for ks in where.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w))


def lines(rows, ratio, least):
    pages, have = Counter(s for *_, s in rows), Counter()
    solid = lambda x: bool(x.strip(" \t\r\x0b\f"))
    for _, t, _, s in rows:
        have.update({(s, x) for x in (t or "").split("\n") if t is not None and solid(x)})
    bad = {k for k, n in have.items() if n >= least and n > pages[k[0]] * ratio}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for i, t, _, s in rows]


def tokens(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def leaks(rows, items, window=20, similarity=0.75):
    """(doc_id, item_id) where some aligned window of an item agrees in enough tokens (no seeds: all alignments)."""
    out = set()
    for i, t, *_ in rows:
        w = tokens(t)
        for item, text in items:
            b = tokens(text)
            n = min(window, len(b))
            if i is None or len(b) < 11:
                continue
            for d in range(-len(b) + n, len(w) - n + 1):
                eq = [b[k] == w[k + d] for k in range(max(0, -d), min(len(b), len(w) - d))]
                if any(sum(eq[k : k + n]) >= similarity * n for k in range(len(eq) - n + 1)):
                    out.add((i, item))
                    break
    return out
