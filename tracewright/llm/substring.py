"""Substring deduplication with difference-cover anchors.

A window is ``window`` consecutive words of one document. Every word covered by
a window whose word sequence also starts earlier (smaller id, or same document
and earlier start) goes; windows are judged on the input.

Method. Word positions are taken modulo a period p. A difference cover D of p
has, for any two residues, a common shift that brings both into D, so two equal
windows that start anywhere share an aligned anchor of ``window - p + 1`` words
among the positions in D. Only anchors are hashed and exchanged:

1. each home sends its distinct anchor hashes to buckets of the hash space;
2. a bucket returns to each home those that occur twice or more;
3. around them the home *extends*: it hashes the whole windows that hold such
   an anchor and sends each distinct one with the smallest id that has it;
4. a bucket names the owner of each, and tells the other homes;
5. homes drop covered words.

The text is shuffled once (one exchange serves the three passes). Messages are
distinct within a home, so a passage common to a third of all documents costs
one entry a home and is never expanded into pairs.

Defined cases: a null text has no words; a null id counts as one id later than
all others; rows that repeat an id are one document's text twice, where equal
windows at the same start do not remove each other. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytekit as K
from . import exchange as X
from . import homes as H

#: minimal difference covers by period (fixed values)
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
LEAST_ANCHOR = 8


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of LEAST_ANCHOR words, and its cover."""
    p = max((p for p in COVERS if window - p + 1 >= min(LEAST_ANCHOR, window)), default=1)
    return p, COVERS[p]


def _chunks(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, buffer, offsets) of runs of documents, in order of their ids."""
    ids = t.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    if not (np.diff(order) > 0).all():
        t, ids = t.take(order), ids[order]
    buf, off = K.utf8(t.column("text"))
    for i, j in K.chunks(off):
        yield ids[i:j], buf[off[i] : off[j]], off[i : j + 1] - off[i]


def _anchors(w: K.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a chunk's anchors."""
    p, d = cover(window)
    h, whole = w.windows(window - p + 1)
    at = np.flatnonzero(np.isin(np.arange(p), d)[w.pos % p] & whole)
    return at, h[at]


WINDOW = X.HASHES + ", docs binary"


def _tell_anchors(window: int, buckets: int):
    def tell(key, t):
        found = [_anchors(K.Words(buf, off), window)[1] for _, buf, off in _chunks(t)]
        found, again = K.distinct(np.concatenate(found) if found else np.zeros(0, K.U))
        return X.say(key[0].as_py(), buckets, found, K.within(found, again))

    return tell


def _repeated(t):
    """The anchors of a bucket that two homes have, or one home twice."""
    homes, blobs, own = X.heard(t)
    _, again = K.distinct(np.concatenate(blobs))
    return X.reply([(h, b[K.within(b, again) | f], b[:0]) for h, b, f in zip(homes, blobs, own, strict=True)])


def _tell_windows(window: int, buckets: int):
    def tell(key, t, hot):
        hot_hashes = np.sort(K.unblob(hot.column("lost")))
        p, _ = cover(window)
        hashes, docs = [np.zeros(0, K.U)], [np.zeros(0, np.int64)]
        for ids, buf, off in _chunks(t) if len(hot_hashes) else ():
            w = K.Words(buf, off)
            at, h = _anchors(w, window)
            mark = np.zeros(len(w.starts) + p + 1, np.int32)
            mark[at[K.within(h, hot_hashes)] + 1] = 1
            seen = np.cumsum(mark)
            whole, fits = w.windows(window)
            mine = np.flatnonzero(fits & (seen[p : p + len(w.starts)] > seen[: len(w.starts)]))
            hashes.append(whole[mine])
            docs.append(ids[w.doc[mine]])
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(h, kind="stable")  # documents come in order of id: the first of a run has the smallest
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        return X.say(key[0].as_py(), buckets, h[at], np.diff(np.append(at, len(h))) > 1, d[at])

    return tell


def _owned(t):
    """For each home: hashes that an earlier document has, and others that it has twice itself."""
    homes, blobs, flags = X.heard(t)
    flags = np.concatenate(flags)
    docs, h = K.unblob(t.column("docs"), np.int64), np.concatenate(blobs)
    _, again = K.distinct(h)
    lost, both = np.zeros(len(h), bool), np.flatnonzero(K.within(h, again))
    group = np.searchsorted(again, h[both])
    least = np.full(len(again), H.NO_ID, np.int64)
    np.minimum.at(least, group, docs[both])
    lost[both] = docs[both] > least[group]
    out, i = [], 0
    for home, b in zip(homes, blobs, strict=True):
        s = slice(i, i + len(b))
        out.append((home, b[lost[s]], b[flags[s] & ~lost[s]]))
        i += len(b)
    return X.reply(out)


def _covered(window: int):
    def cut(key, t, told):
        lost, multi = np.sort(K.unblob(told.column("lost"))), np.sort(K.unblob(told.column("multi")))
        parts, places = [], []
        for ids, buf, off in _chunks(t):
            w = K.Words(buf, off)
            h, whole = w.windows(window) if len(lost) + len(multi) else (np.zeros(len(w.starts), K.U), np.zeros(len(w.starts), bool))
            gone = whole & K.within(h, lost)
            own = np.flatnonzero(whole & K.within(h, multi))
            parts.append((ids, buf, off, w.starts, w.ends, w.first, gone))
            places.append((h[own], ids[w.doc[own]], w.pos[own], own, np.full(len(own), len(parts) - 1)))
        if places:  # of windows that this home owns, all but the first start
            h, d, pos, own, part = (np.concatenate(x) for x in zip(*places, strict=True))
            order = np.lexsort((pos, d, h))
            h, d, pos, own, part = (x[order] for x in (h, d, pos, own, part))
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (d != d[head]) | (pos != pos[head])
            for k in np.unique(part[later]):
                parts[k][-1][own[later & (part == k)]] = True
        rows = []
        for ids, buf, off, starts, ends, first, gone in parts:
            edge = np.zeros(len(gone) + window + 1, np.int32)
            at = np.flatnonzero(gone)
            edge[at] += 1
            edge[at + window] -= 1
            drop = np.cumsum(edge)[: len(gone)] > 0
            for k, doc in enumerate(ids):
                a, b = first[k], first[k + 1]
                mine, text = drop[a:b], buf[off[k] : off[k + 1]].tobytes()
                n = int(mine.sum())
                words = text.split() if n < b - a else []
                kept = b" ".join(compress(words, ~mine) if n else words)
                rows.append((int(doc), int(b - a), n, kept))
        return rows

    return cut


def _digest(rows: list) -> pa.Table:
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_words": pa.array([r[1] for r in rows], pa.int64()), "n_removed": pa.array([r[2] for r in rows], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())})


def _texts(rows: list) -> pa.Table:
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_words": pa.array([r[1] for r in rows], pa.int64()), "n_removed": pa.array([r[2] for r in rows], pa.int64()), "text": pa.array([r[3].decode() for r in rows], pa.string())})


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space: ``text``, or with ``digest`` its ``kept_sha256``."""
    spark = docs.sparkSession
    homes, buckets = H.counts(spark, docs)
    home = H.housed(docs, id_col, text_col, homes)
    hot = home.groupBy("home").applyInArrow(_tell_anchors(window, buckets), X.HASHES).groupBy("bucket").applyInArrow(_repeated, X.REPLY)
    told = home.groupBy("home").cogroup(hot.groupBy("home")).applyInArrow(_tell_windows(window, buckets), WINDOW).groupBy("bucket").applyInArrow(_owned, X.REPLY)
    cut, shape = _covered(window), _digest if digest else _texts
    out = home.groupBy("home").cogroup(told.groupBy("home")).applyInArrow(lambda key, t, r: shape(cut(key, t, r)), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")
    return out.withColumn("doc_id", H.named(out["doc_id"]))
