"""Suffix-array deduplication with a logarithmic family of indexes.

Every byte covered by a ``length``-byte string that also starts anywhere else,
in the same document or another, goes; strings are judged on the input and never
cross documents.

Sampling. A string is represented by the least of its first SPREAD k-gram hashes
(the leftmost, if equal). Where it lies is fixed by the string's own bytes, so
equal strings pick the same place, and strings that start side by side mostly
share theirs. The suffixes at these places are the ones indexed; each stands for
a run of starts and carries its *context*, the bytes all strings of the run cover.

1. each home (a batch of documents) tells buckets the hash of the bytes that
   every string of a sampled suffix contains, its *core*, with the number of
   contexts it has for it, and hears which cores are repeated;
2. it sends the contexts of those, distinct within the home, to the core's bucket;
3. a bucket keeps an index family: every new batch of contexts is sorted into a
   pair of suffix arrays (bytes from the sampled place on, and bytes before it,
   backwards) and merge-scanned against each existing level for strings of full
   length that both hold; then levels of equal size merge, which needs no scan;
4. homes hear, by place, which starts of each context are repeated, and cut.

Skew. Inside a passage that a third of all documents share, contexts are equal;
at its edges they differ from document to document though they share a core. The
contexts of a core that has more than HOT of them in all homes are therefore
*trimmed* first: homes tell the hashes of their single strings, distinct within
the home, and hear which of them others hold. What is left of a context are the
stretches of strings that are held elsewhere by the same homes (in groups of
PEERS, each of at least two holders); such a piece goes, as bytes, to the bucket
that its group of holders names, and into the family there. So an edge that only
one document has never reaches a bucket, and a passage that all homes hold meets
PEERS to 2 PEERS copies of itself in each of many buckets.

Every string is decided in a family, by its bytes. Hashes (modulo 2**61 - 1)
route, choose what is worth sending, and find equal contexts within one home.

Defined cases: a null text is empty; a null id is kept (null ids are dealt as
one id); rows that repeat an id are documents of their own, so copies remove
each other; documents under ``length`` bytes lose nothing. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as K
from . import exchange as X
from . import homes as H

LENGTH = 400
SPREAD, GRAM = 128, 16
#: contexts of a core, over all homes, that go to one bucket as they are
HOT = 512
#: homes whose copies of a trimmed context meet in a bucket (up to twice as many)
PEERS = 64
#: contexts that make a batch of the index family
BATCH = 1024
STEP = 1 << 18
_PLACE = 24  # bits of a packed place

CORES = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
TALK = pa.schema([(c, pa.int32()) for c in ("bucket", "home", "kind")] + [(c, pa.binary()) for c in ("hashes", "flags", "lefts", "sizes", "times", "spots", "packed")])
STRINGS = pa.schema([("home", pa.int32()), ("hashes", pa.binary()), ("routes", pa.binary()), ("hot", pa.binary())])
HEAR = pa.schema([("home", pa.int32()), ("spots", pa.binary()), ("bits", pa.binary())])
_CONTEXT, _STRING = 0, 1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema)


def _ordered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, buffer and offsets of a home, in an order that does not depend on that of the rows."""
    ids = t.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[order]) == 0).any():
        text = t.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i])), np.int64)
    if (np.diff(order) < 0).any():
        t, ids = t.take(order), ids[order]
    return ids, *K.utf8(t.column("text"))


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive entries."""
    n = len(key)
    if n < w:
        return key[:0]
    rows = np.full((-(-n // w), w), ~K.U(0))
    rows.reshape(-1)[:n] = key
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Runs:
    """Sampled suffixes of a stretch of a home: place, first and last start, all relative to ``lo``."""

    def __init__(self, lo: int, buf: np.ndarray, valid: np.ndarray, length: int, spread: int, gram: int):
        self.lo, self.buf, self.length = lo, buf, length
        self.spans = K.Spans(buf)
        h = K.grams(buf, gram)
        key = (h >> K.U(_PLACE) << K.U(_PLACE)) | np.arange(len(h), dtype=K.U)
        at = np.flatnonzero(valid)
        place = (_least(key, spread)[at] & K.U((1 << _PLACE) - 1)).astype(np.int64) if len(at) else at
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        self.place, self.first = place[head], at[head]
        self.last = at[np.append(head[1:], len(at)) - 1] if len(head) else at
        #: hash of the bytes that every string of the run holds from the sampled place on
        self.core = self.spans.of(self.place, self.place + length - spread + 1)

    def keys(self, place: np.ndarray | None = None, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Hash of each context, that of a whole run unless stretches are given, with the place in it."""
        place, first, last = (self.place, self.first, self.last) if place is None else (place, first, last)
        return K.mix(self.spans.of(first, last + self.length) ^ K.mix(((place - first) << 32 | (last - first)).astype(K.U)))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the strings of some runs, their hashes, and the run of each."""
        n = self.last[which] - self.first[which] + 1
        starts = np.repeat(self.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return starts, self.spans.of(starts, starts + self.length), np.repeat(which, n)

    def pieces(self, hot: np.ndarray, strings: np.ndarray, routes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Run, first and last start, and route of the stretches of told strings of a route in runs with a hot core."""
        starts, h, run = self.strings(np.flatnonzero(K.within(self.core, hot)))
        known = np.flatnonzero(K.within(h, strings))
        starts, run, route = starts[known], run[known], routes[np.searchsorted(strings, h[known])]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (run[1:] != run[:-1]) | (route[1:] != route[:-1])
        head = np.flatnonzero(new)
        return run[head], starts[head], starts[np.append(head[1:], len(starts)) - 1] if len(head) else starts, route[head]


def _runs(buf: np.ndarray, off: np.ndarray, length: int, spread: int, gram: int) -> Iterator[Runs]:
    edge = np.zeros(len(buf) + 1, np.int8)
    ends = off[1:]
    np.add.at(edge, np.maximum(off[:-1], ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) == 0
    for lo in range(0, len(buf), STEP):
        yield Runs(lo, buf[lo : lo + STEP + length + spread], valid[lo : lo + STEP], length, spread, gram)


def _tell_cores(length: int, spread: int, gram: int, buckets: int):
    def tell(key, t):
        _, buf, off = _ordered(t)
        runs = [(r.core, r.keys()) for r in _runs(buf, off, length, spread, gram)]
        core, context = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, K.U), np.zeros(0, K.U))
        order = np.lexsort((context, core))
        core, context = core[order], context[order]
        head, first = np.ones(len(core), bool), np.ones(len(core), bool)
        head[1:] = core[1:] != core[:-1]
        first[1:] = head[1:] | (context[1:] != context[:-1])
        at = np.flatnonzero(head)
        # contexts, and one more if the home has one of them twice
        n = np.add.reduceat(first, at, dtype=np.int64) + ~np.logical_and.reduceat(first, at) if len(at) else at
        core, n = core[at], np.minimum(n, 255).astype(np.uint8)
        cut = K.cuts(core, buckets)
        return _table([(b, key[0].as_py(), K.blob(core[i:j]), K.blob(n[i:j])) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i], CORES)

    return tell


def _repeated(hot: int):
    def answer(t):
        """Per home its cores with several contexts: those with at most ``hot`` in all homes, and the others."""
        homes = t.column("home").to_pylist()
        blobs, counts = ([np.frombuffer(b, kind) for b in t.column(c).to_pylist()] for c, kind in (("hashes", K.U), ("counts", np.uint8)))
        every, n = np.concatenate(blobs), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order].astype(np.int64)
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(n, at)
        some, many = every[at[(total > 1) & (total <= hot)]], every[at[(total > 1) & (total > hot)]]
        return X.reply([(h, b[K.within(b, some)], b[K.within(b, many)]) for h, b in zip(homes, blobs, strict=True)])

    return answer


def _cells(home: int, buckets: int, route: np.ndarray, key: np.ndarray, core: np.ndarray, left: np.ndarray, spots: np.ndarray, contexts: list[bytes]) -> list[tuple]:
    """One cell a bucket: contexts, distinct within the home, and all places where they start."""
    order = np.lexsort((spots, key, route))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (route[order][1:] != route[order][:-1])
    at = np.append(np.flatnonzero(new), len(order))
    heads, times = order[at[:-1]], np.diff(at)
    cut, zip_ = K.cuts(route[heads], buckets), zstandard.ZstdCompressor(level=1)
    rows = []
    for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
        if j > i:
            pick = heads[i:j]
            parts = [contexts[k] for k in pick]
            numbers = (left[pick].astype(np.int16), np.array([len(p) for p in parts], np.int16), times[i:j].astype(np.int32), spots[order[at[i] : at[j]]].astype(np.int64))
            rows.append((b, home, _CONTEXT, K.blob(core[pick]), b"", *map(K.blob, numbers), zip_.compress(b"".join(parts))))
    return rows


def _tell_contexts(length: int, spread: int, gram: int, buckets: int):
    def tell(key, t, told):
        home = key[0].as_py()
        cold, hot = np.sort(K.unblob(told.column("lost"))), np.sort(K.unblob(told.column("multi")))
        found, contexts, strings = [], [], []
        _, buf, off = _ordered(t)
        for r in _runs(buf, off, length, spread, gram) if len(cold) + len(hot) else ():
            mine = np.flatnonzero(K.within(r.core, cold))
            first, last = r.first[mine], r.last[mine]
            found.append((r.core[mine], r.keys()[mine], r.place[mine] - first, first + r.lo))
            contexts += [r.buf[a:b].tobytes() for a, b in zip(first, last + length, strict=True)]
            strings.append(r.strings(np.flatnonzero(K.within(r.core, hot)))[1])
        rows = []
        if contexts:
            core, keys, left, spots = map(np.concatenate, zip(*found, strict=True))
            rows = _cells(home, buckets, core, keys, core, left, spots, contexts)
        if strings:
            every, again = K.distinct(np.concatenate(strings))
            said = X.say(home, buckets, every, K.within(every, again))
            rows += [(b, home, _STRING, h, f, b"", b"", b"", b"", b"") for b, h, f in zip(*(said.column(c).to_pylist() for c in ("bucket", "hashes", "flags")), strict=True)]
        return _table(rows, TALK)

    return tell


def _tell_pieces(length: int, spread: int, gram: int, buckets: int):
    def tell(key, t, told):
        strings, routes, hot = (K.unblob(told.column(c)) for c in ("hashes", "routes", "hot"))
        order, hot = np.argsort(strings), np.sort(hot)
        strings, routes = strings[order], routes[order]
        rows = []
        if len(strings):
            found, contexts = [], []
            _, buf, off = _ordered(t)
            for r in _runs(buf, off, length, spread, gram):
                run, first, last, route = r.pieces(hot, strings, routes)
                found.append((route, r.keys(r.place[run], first, last), r.core[run], r.place[run] - first, first + r.lo))
                contexts += [r.buf[a:b].tobytes() for a, b in zip(first, last + length, strict=True)]
            rows = _cells(key[0].as_py(), buckets, *map(np.concatenate, zip(*found, strict=True)), contexts)
        return _table(rows, TALK)

    return tell


class Level:
    """Contexts with the two suffix arrays over their sampled places, and which of their strings are repeated."""

    def __init__(self, contexts: list[bytes], left: np.ndarray, marks: np.ndarray, length: int, core: np.ndarray, forward: list[int] | None = None, backward: list[int] | None = None):
        self.contexts, self.left, self.marks, self.length, self.core = contexts, left, marks, length, core
        # timsort merges the runs that sorted levels bring along in linear time
        self.forward = np.array(sorted(forward or range(len(contexts)), key=lambda i: contexts[i][left[i] :]), np.int64)
        self.backward = np.array(sorted(backward or range(len(contexts)), key=lambda i: contexts[i][: left[i]][::-1]), np.int64)

    def scan(self) -> Level:
        """Mark every full-length string that two contexts of the level hold."""
        n, length, spread = len(self.contexts), self.length, self.marks.shape[1]
        if n < 2:
            return self
        right = _common([c[k:] for c, k in zip(self.contexts, self.left, strict=True)], self.forward)
        left = _common([c[:k][::-1] for c, k in zip(self.contexts, self.left, strict=True)], self.backward)
        size = np.array([len(c) for c in self.contexts])
        least, most = np.maximum(0, length - (size - self.left)), self.left  # offsets of the place in the run's strings
        near = np.zeros(n, bool)
        close = right >= length - spread + 1
        near[self.forward[1:][close]] = near[self.forward[:-1][close]] = True
        for o in range(spread):
            who = np.flatnonzero(near & (least <= o) & (o <= most))
            if len(who) < 2:
                continue
            same_right, same_left = np.empty(n, np.int64), np.empty(n, np.int64)
            same_right[self.forward] = np.concatenate(([0], np.cumsum(right < length - o)))
            same_left[self.backward] = np.concatenate(([0], np.cumsum(left < o)))
            group = (same_right[who] * n + same_left[who]).astype(K.U)
            self.marks[who, o] |= K.within(group, K.distinct(group)[1])
        return self

    def part(self, core: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        """Contexts with one of the sorted cores (no others can share a string), and their order in both arrays."""
        mine = K.within(self.core, core)
        at = np.cumsum(mine) - 1
        return np.flatnonzero(mine), at[self.forward[mine[self.forward]]].tolist(), at[self.backward[mine[self.backward]]].tolist()


def _common(strings: list[bytes], order: np.ndarray, step: int = 4096) -> np.ndarray:
    """Length of the common prefix of each string with the next in order."""
    width = max(map(len, strings), default=0)
    size = np.array([len(strings[i]) for i in order])
    out = np.zeros(len(order) - 1, np.int64)
    if not width:
        return out
    for i in range(0, len(order) - 1, step):
        rows = order[i : i + step + 1]
        flat = np.frombuffer(b"".join(strings[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(len(rows), width)
        differ = flat[1:] != flat[:-1]
        out[i : i + len(rows) - 1] = np.where(differ.any(1), differ.argmax(1), width)
    return np.minimum(out, np.minimum(size[1:], size[:-1]))


class IndexFamily:
    """Levels of about BATCH, 2 BATCH, 4 BATCH ... contexts; each batch is scanned against all that came before."""

    def __init__(self, length: int, spread: int):
        self.length, self.spread = length, spread
        self.levels: list[Level | None] = []

    def add(self, contexts: list[bytes], left: np.ndarray, marks: np.ndarray, core: np.ndarray | None = None) -> None:
        level = Level(contexts, left, marks, self.length, np.zeros(len(contexts), K.U) if core is None else core).scan()
        for old in self.levels:
            if old is not None:
                self.merge_scan(old, level)
        k = 0
        while k < len(self.levels) and self.levels[k] is not None:
            level, self.levels[k], k = self.merged(self.levels[k], level), None, k + 1
        self.levels[k:] = [level, *self.levels[k + 1 :]]

    def merge_scan(self, a: Level, b: Level) -> None:
        """Mark the strings that a context of one level and one of the other hold."""
        both = K.distinct(b.core)[0]
        both = both[K.within(both, K.distinct(a.core)[0])]
        if len(both):
            (p, p_forward, p_backward), (q, q_forward, q_backward) = a.part(both), b.part(both)
            joint = self._joint([a.contexts[i] for i in p] + [b.contexts[i] for i in q], [a.left[p], b.left[q]], [a.marks[p], b.marks[q]], [a.core[p], b.core[q]], p_forward, q_forward, p_backward, q_backward, len(p)).scan()
            a.marks[p], b.marks[q] = joint.marks[: len(p)], joint.marks[len(p) :]

    def _joint(self, contexts, left, marks, core, a_forward, b_forward, a_backward, b_backward, n: int) -> Level:
        return Level(contexts, np.concatenate(left), np.concatenate(marks), self.length, np.concatenate(core), [*a_forward, *(i + n for i in b_forward)], [*a_backward, *(i + n for i in b_backward)])

    def merged(self, a: Level, b: Level) -> Level:
        """Both levels as one, their arrays merged; what they share is marked already."""
        return self._joint(a.contexts + b.contexts, [a.left, b.left], [a.marks, b.marks], [a.core, b.core], a.forward, b.forward, a.backward, b.backward, len(a.contexts))

    def close(self) -> Level | None:
        """All levels as one."""
        whole = None
        for level in self.levels:
            if level is not None:
                whole = level if whole is None else self.merged(whole, level)
        return whole


def _family(length: int, spread: int, batch: int):
    def decide(t: pa.Table) -> pa.Table:
        """To each home: where its contexts start that others, or it again, share strings with, and a bit for each string."""
        t = t.filter(pc.equal(t.column("kind"), _CONTEXT))
        unzip = zstandard.ZstdDecompressor()
        at: dict[tuple[bytes, int], int] = {}
        holders: list[list[tuple[int, np.ndarray]]] = []  # of each distinct context: homes, and its places there
        family, fresh = IndexFamily(length, spread), []

        def flush() -> None:
            if fresh:
                family.add([c for c, _, _ in fresh], np.array([k for _, k, _ in fresh], np.int64), np.zeros((len(fresh), spread), bool), np.array([x for *_, x in fresh], K.U))
                fresh.clear()

        for cell in zip(*(t.column(c) for c in ("home", "hashes", "lefts", "sizes", "times", "spots", "packed")), strict=True):
            home, cores, lefts, sizes, times, spots, packed = (v.as_py() for v in cell)
            sizes, times, spots = np.frombuffer(sizes, np.int16).astype(np.int64), np.frombuffer(times, np.int32), np.frombuffer(spots, np.int64)
            flat, end, last = unzip.decompress(packed, max_output_size=int(sizes.sum())), np.cumsum(sizes), np.cumsum(times)
            for core, left, i, j, p, q in zip(np.frombuffer(cores, K.U).tolist(), np.frombuffer(lefts, np.int16).tolist(), (end - sizes).tolist(), end.tolist(), (last - times).tolist(), last.tolist(), strict=True):
                entry = (flat[i:j], left)
                k = at.setdefault(entry, len(holders))
                if k == len(holders):
                    holders.append([])
                    fresh.append((*entry, core))
                    if len(fresh) >= batch:
                        flush()
                holders[k].append((home, spots[p:q]))
        flush()
        whole, told = family.close(), {}
        if whole is not None:
            for context, left, marks in zip(whole.contexts, whole.left.tolist(), whole.marks, strict=True):
                mine, n, starts = holders[at[context, left]], len(context) - length + 1, np.zeros(spread, bool)
                starts[:n] = True if sum(len(p) for _, p in mine) > 1 else marks[left - n + 1 : left + 1][::-1]
                if starts.any():
                    bits = np.packbits(starts).tobytes()
                    for home, places in mine:
                        told.setdefault(home, []).append((places, bits * len(places)))
        return _table([(home, K.blob(np.concatenate([p for p, _ in rows])), b"".join(b for _, b in rows)) for home, rows in told.items()], HEAR)

    return decide


def _answer_strings(t: pa.Table) -> pa.Table:
    """To each home: its strings that others hold or it holds twice, and the route of each, shared with its group of holders."""
    t = t.filter(pc.equal(t.column("kind"), _STRING))
    if not t.num_rows:
        return _table([], STRINGS)
    homes, blobs, own = X.heard(t)
    h, wanted = np.concatenate(blobs), np.concatenate(own)
    home = np.repeat(np.array(homes, np.int64), [len(b) for b in blobs])
    order = np.lexsort((home, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    group, rank = np.repeat(np.arange(len(at)), n), np.arange(len(h)) - np.repeat(at, n)
    who = np.bitwise_xor.reduceat(K.mix(home[order].astype(K.U) + K.U(1)), at)
    peers = np.minimum(rank // PEERS, np.maximum(n[group] // PEERS - 1, 0))
    route = np.empty(len(h), K.U)
    route[order] = K.joined(who[group], peers.astype(K.U))
    wanted[order] |= (n > 1)[group]
    ends = np.cumsum([len(b) for b in blobs])
    cut = [(x, np.flatnonzero(wanted[j - len(b) : j]) + j - len(b)) for x, b, j in zip(homes, blobs, ends, strict=True)]
    return _table([(x, K.blob(h[mine]), K.blob(route[mine]), b"") for x, mine in cut if len(mine)], STRINGS)


def _cut(length: int, spread: int, shape):
    def cut(key, t, told):
        ids, buf, off = _ordered(t)
        edge = np.zeros(len(buf) + length + 1, np.int32)
        spots = K.unblob(told.column("spots"), np.int64)
        bits = K.unblob(told.column("bits"), np.uint8).reshape(len(spots), spread // 8)
        for i in range(0, len(spots), 1 << 16):
            which, start = np.nonzero(np.unpackbits(bits[i : i + (1 << 16)], axis=1))
            start += spots[i + which]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
        gone = np.cumsum(edge)[: len(buf)] > 0
        rows = []
        for k, doc in enumerate(ids):
            mine, text = gone[off[k] : off[k + 1]], buf[off[k] : off[k + 1]]
            n = int(mine.sum())
            spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n else 0
            rows.append((int(doc), len(text), n, spans, (text[~mine] if n else text).tobytes()))
        return shape(rows)

    return cut


def _columns(rows: list, last: pa.Array, name: str) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table([*(pa.array(c, pa.int64()) for c in cols[:4]), last], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])


def _digest(rows: list) -> pa.Table:
    return _columns(rows, pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string()), "kept_sha256")


def _bytes(rows: list) -> pa.Table:
    return _columns(rows, pa.array([r[4] for r in rows], pa.binary()), "kept")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, hot: int = HOT, batch: int = BATCH, spread: int = SPREAD, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay: ``kept`` (binary), or with ``digest`` its ``kept_sha256``."""
    if length - spread + 1 < gram or not 8 <= gram <= 16 or spread % 8 or length + spread > 32_000:
        raise ValueError("length must exceed spread by gram - 1, spread must be a multiple of 8, and gram 8 to 16")
    homes, buckets = H.counts(docs.sparkSession, docs)
    home = H.housed(docs, id_col, text_col, homes)
    sampling, of = (length, spread, gram), lambda schema: ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)
    cores = home.groupBy("home").applyInArrow(_tell_cores(*sampling, buckets), of(CORES)).groupBy("bucket").applyInArrow(_repeated(hot), X.REPLY)
    said = home.groupBy("home").cogroup(cores.groupBy("home")).applyInArrow(_tell_contexts(*sampling, buckets), of(TALK))
    strings = said.groupBy("bucket").applyInArrow(_answer_strings, of(STRINGS))
    frequent = cores.where(F.length("multi") > 0).select("home", F.lit(b"").alias("hashes"), F.lit(b"").alias("routes"), F.col("multi").alias("hot"))
    pieces = home.groupBy("home").cogroup(strings.unionByName(frequent).groupBy("home")).applyInArrow(_tell_pieces(*sampling, buckets), of(TALK))
    decide = _family(length, spread, batch)

    def decide_contexts(t):
        return decide(t)

    def decide_pieces(t):
        return decide(t)

    told = said.groupBy("bucket").applyInArrow(decide_contexts, of(HEAR)).unionByName(pieces.groupBy("bucket").applyInArrow(decide_pieces, of(HEAR)))
    out = home.groupBy("home").cogroup(told.groupBy("home")).applyInArrow(_cut(length, spread, _digest if digest else _bytes), f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}")
    return out.withColumn("doc_id", H.named(out["doc_id"]))
