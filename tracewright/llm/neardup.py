"""MinHash near-duplicate detection with fast similarity sketching.

A document's set is its distinct shingles of five words (A-Z lower-cased); with
fewer words, all of them as one. Documents are linked if the sets' Jaccard
similarity is at least 75 %; a component is what links connect.

Sketch. T bins are filled in rounds: in each of the first T rounds every
element falls into one bin of its own by hash, in T more the bin is given by the
round; a bin keeps its least (round, value), and rounds stop once all bins are
full, which the last T guarantee. Bins of two sets agree with probability equal
to their similarity, independently enough for the usual concentration bounds.
BANDS bands of ROWS bins are joined: a pair at 75 % escapes all of them with
probability (1 - 0.75**3)**24, about 2 in a million.

Plan. Equal sets (exact copies) are one class, found by a grouped minimum.
Class representatives fall into buckets, one a band; those that share a bucket
get a wide sketch of WIDE bins, one bit each. A bucket's members meet in blocks
of about BLOCK, in which wide sketches are compared: estimates are off by more
than MARGIN with a probability of about 2 in a million, so a pair is *surely*
linked above, *open* between, and dismissed below. Only a star around the first
member of each surely linked cluster is told, and open pairs between clusters;
so a group of copies sends about one pair a member. Of open pairs, each member's
NEAR likeliest come first. Every pair told is verified on the full sets, and
verified links alone connect. Buckets of several blocks, and those with open pairs
left, then compare members outside their largest component with all others, block
by block: what is not told is connected already. No candidate is capped or sampled.

Defined cases: a document without words has an empty set, no links, and stands
for itself; a null id counts as one id later than all others. A set stands under
the smallest id that has it: rows that repeat an id are judged by their texts,
and sets that stand under the same id count as one. Other columns are ignored
by ``near_duplicates`` and kept by ``near_dedup``; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as K
from . import homes as H
from .components import components
from .scratch import settle, small

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 24, 3
T = BANDS * ROWS
#: bins of the wide sketch, and how far its estimate is trusted: 4.75 standard deviations at 75 %, where bits agree with probability 7/8
WIDE = 8192
MARGIN = 4.75 * 2 * (7 / 64 / WIDE) ** 0.5
#: documents sketched at a time (8 WIDE bytes each)
SKETCHED = 512
#: members of a bucket compared in one task
BLOCK, OUTSIDE = 1024, 256
#: open pairs of a member that are verified before the others
NEAR = 32
#: ids that may be broadcast (8 bytes each)
BROADCAST_IDS = 500_000


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk, and the offsets of each document's."""
    w = K.Words(buf, off, lower=True)
    h, whole = w.windows(size)
    n = np.maximum(w.counts - size + 1, 0)
    few = np.flatnonzero((w.counts > 0) & (w.counts < size))
    at = np.concatenate(([0], np.cumsum(n + ((w.counts > 0) & (w.counts < size)))))
    out = np.empty(at[-1], K.U)
    spots = np.ones(at[-1], bool)
    spots[at[few]] = False
    out[spots] = h[whole]
    for d in few:  # all words as one, told apart from shingles of ``size`` words by the count
        mine = w.hash[w.first[d] : w.first[d + 1]]
        out[at[d]] = K.mix(np.array([int(np.bitwise_xor.reduce(K.mix(mine + K._random(len(mine), 77)))) ^ (len(mine) << 60)], K.U))[0]
    return out, at


def sketch(sets: np.ndarray, at: np.ndarray, t: int = T) -> np.ndarray:
    """(documents, t) bins: round << 32 | value. Documents without elements keep all-ones.

    Rounds are taken several at a time where elements are few: a bin keeps its
    first round whatever comes after, so that rounds too many change nothing.
    """
    n, none = len(at) - 1, ~K.U(0)
    out = np.full((n, t), none)
    flat = out.reshape(-1)
    doc, elements = np.repeat(np.arange(n), np.diff(at)), sets

    def hashed(x: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        return K.mix(x ^ ((rounds.astype(K.U) + K.U(1)) * K.U(0x9E3779B97F4A7C15)))

    r = turn = 0
    while r < t and len(elements):
        some = max(1, min(t - r, (1 << 17) // len(elements)))
        rounds = np.repeat(np.arange(r, r + some), len(elements))
        g = hashed(np.tile(elements, some), rounds)
        b = ((g >> K.U(32)) * K.U(t)) >> K.U(32)
        np.minimum.at(flat, np.tile(doc, some) * t + b.astype(np.int64), (rounds.astype(K.U) << K.U(32)) | (g & K.U(0xFFFFFFFF)))
        r, turn = r + some, turn + 1
        if n * t <= 16 * len(elements) * some or turn % 8 == 0:
            more = (out == none).any(1)[doc]
            if not more.all():
                elements, doc = elements[more], doc[more]
    for d in np.flatnonzero((out == none).any(1) & (np.diff(at) > 0)):  # bins that no round of throws has hit
        bins = np.flatnonzero(out[d] == none)
        own = sets[at[d] : at[d + 1]]
        for i in range(0, len(bins), max(1, (1 << 17) // len(own))):
            part = bins[i : i + max(1, (1 << 17) // len(own))]
            g = hashed(np.tile(own, len(part)), np.repeat(t + part, len(own))).reshape(len(part), len(own))
            out[d, part] = ((t + part).astype(K.U) << K.U(32)) | (g & K.U(0xFFFFFFFF)).min(1)
    return out


def bands(bins: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) bucket keys; the band is part of the key."""
    n, t = bins.shape
    parts = bins.reshape(n, t // rows, rows)
    key = np.arange(1, t // rows + 1, dtype=K.U) * K.U(0xD1B54A32D192ED03) + np.zeros((n, 1), K.U)
    for k in range(rows):
        key = K.mix(key ^ parts[:, :, k])
    return key


def _distinct(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    out = []
    for a, b in zip(at, at[1:], strict=False):
        s = np.sort(sets[a:b])
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        out.append(s[new])
    return out


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0)
        buf, off = K.utf8(b.column(1))
        for i, j in K.chunks(off):
            sets, at = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            each = _distinct(sets, at)
            n = np.array([len(s) for s in each], np.int64)
            keys = bands(sketch(np.concatenate(each) if each else sets, np.concatenate(([0], np.cumsum(n)))))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array([_set_key(s) for s in each], pa.binary()), flat], names=["doc_id", "n_shingles", "set_key", "bands"])


def wide_bits(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, WIDE / 64) words of one bit per bin of a wide sketch."""
    out = np.zeros((len(sets), WIDE // 64), K.U)
    order = np.argsort([len(s) for s in sets], kind="stable")  # like sizes need like numbers of rounds
    for i in range(0, len(sets), SKETCHED):
        pick = order[i : i + SKETCHED]
        bins = sketch(np.concatenate([sets[k] for k in pick]), np.concatenate(([0], np.cumsum([len(sets[k]) for k in pick]))), WIDE)
        out[pick] = np.packbits((K.mix(bins) & K.U(1)).astype(bool), axis=1).view(K.U)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = K.utf8(b.column(1))
        each = [s for i, j in K.chunks(off) for s in _distinct(*shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i]))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_set_key(s) for s in each], pa.binary()), pa.array([s.tobytes() for s in each], pa.binary()), pa.array([w.tobytes() for w in wide_bits(each)], pa.binary())], names=["rep", "set_key", "shingles", "wide"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), K.U), np.frombuffer(y.as_buffer(), K.U)
            if len(p) > len(q):
                p, q = q, p
            both = int(K.within(p, q).sum())
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = sets.select("rep", "shingles")
    left = pairs.join(sets.withColumnRenamed("shingles", "sa"), pairs["a"] == sets["rep"]).select("a", "b", "sa")
    both = left.join(sets.withColumnRenamed("shingles", "sb"), F.col("b") == F.col("rep")).select("a", "b", "sa", "sb")
    return settle(both.mapInArrow(_linked, "a long, b long"))


def _estimates(wide: np.ndarray, n: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of a member with others; 0 where sizes rule the links out."""
    fits = np.flatnonzero(100 * np.minimum(n[one], n[others]) >= PERCENT * np.maximum(n[one], n[others]))
    out = np.zeros(len(others))
    out[fits] = 1 - 2 / WIDE * np.bitwise_count(wide[others[fits]] ^ wide[one]).sum(1, dtype=np.int64)
    return out


_SURE, _OPEN = PERCENT / 100 + MARGIN, PERCENT / 100 - MARGIN


def _cluster(n: np.ndarray, wide: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs to verify in a block: stars of sure links, and each member's likeliest open pairs between clusters; and the open pairs left."""
    m, out, left = len(n), [], []
    cluster, rest = np.full(m, -1), np.arange(m)
    while len(rest):
        first, rest = rest[0], rest[1:]
        cluster[first] = first
        near = _estimates(wide, n, first, rest)
        sure = near >= _SURE
        out += [(first, x) for x in rest[sure]]
        cluster[rest[sure]] = first
        rest = rest[~sure]
    if len(np.unique(cluster)) > 1:  # across clusters: one sure pair joins two of them, open ones come by likelihood
        found: list[tuple[int, int, float]] = []
        for x in range(m - 1):
            others = np.flatnonzero(cluster[x + 1 :] != cluster[x]) + x + 1
            near = _estimates(wide, n, x, others)
            found += [(x, y, e) for y, e in zip(others[near >= _OPEN].tolist(), near[near >= _OPEN].tolist(), strict=True)]
        root = {c: c for c in np.unique(cluster).tolist()}

        def of(x: int) -> int:
            c = int(cluster[x])
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        told = np.zeros(m, int)
        for x, y, e in sorted(found, key=lambda f: -f[2]):
            if of(x) == of(y):
                continue
            if e < _SURE and min(told[x], told[y]) >= NEAR:
                left.append((x, y))
                continue
            out.append((x, y))
            told[[x, y]] += 1
            if e >= _SURE:
                root[of(x)] = of(y)
    return out, left


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups, as tables, out of batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        now = tuple(int(c[0]) for c in cols)
        change[0] = last is not None and now != last
        cut = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:], strict=False):
            if held and j > i and change[i]:
                yield pa.Table.from_batches(held)
                held = []
            if j > i:
                held.append(b.slice(i, j - i))
        last = tuple(int(c[-1]) for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _wide(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("wide").to_pylist()), K.U).reshape(t.num_rows, WIDE // 64)


def _pairs(a: list[int], b: list[int], keys: list[int] | None = None) -> pa.RecordBatch:
    """Pairs, and after them the keys of buckets with open pairs left."""
    if keys is None:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    none = [None] * len(keys)
    return pa.RecordBatch.from_arrays([pa.array(a + none, pa.int64()), pa.array(b + none, pa.int64()), pa.array([None] * len(a) + keys, pa.int64())], names=["a", "b", "open_key"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs told by each block (key, block, rep, n, wide, bands), each in the first bucket that it shares.

    That loses no connection: what a star in a later bucket joins by a pair told
    earlier was joined there. An open pair that its first bucket leaves is left to
    the comparison of that bucket's outside members.
    """
    a, b, keys = [], [], []
    for t in _runs(batches, 2):
        found, left = _cluster(t.column("n").to_numpy(), _wide(t)) if t.num_rows > 1 else ([], [])
        if found:
            rep, key = t.column("rep").to_numpy(), t.column("key")[0].as_py()
            bands_of = np.array(t.column("bands").to_pylist(), np.int64)

            def here(pairs: list[tuple[int, int]], bands_of=bands_of, key=key) -> tuple[np.ndarray, np.ndarray]:
                x, y = np.array(pairs, np.int64).reshape(-1, 2).T
                first = bands_of[x, (bands_of[x] == bands_of[y]).argmax(1)] == key
                return x[first], y[first]

            if len(here(left)[0]):
                keys.append(key)
            x, y = (rep[i] for i in here(found))
            a += np.minimum(x, y)[x != y].tolist()
            b += np.maximum(x, y)[x != y].tolist()
        if len(a) > 50_000:
            yield _pairs(a, b, keys)
            a, b, keys = [], [], []
    yield _pairs(a, b, keys)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one outside block with one block of all members (key, part, outside, rep, n, component, wide)."""
    a, b = [], []
    for t in _runs(batches, 2):
        rep, n, comp, wide = t.column("rep").to_numpy(), t.column("n").to_numpy(), t.column("component").to_numpy(), _wide(t)
        out = t.column("outside").to_numpy()
        every = np.flatnonzero(~out)
        for x in np.flatnonzero(out):
            others = every[comp[every] != comp[x]]
            for y in others[_estimates(wide, n, x, others) >= _OPEN]:
                a.append(int(min(rep[x], rep[y])))
                b.append(int(max(rep[x], rep[y])))
        if len(a) > 50_000:
            yield _pairs(a, b)
            a, b = [], []
    yield _pairs(a, b)


def _crossed(members: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Open pairs of the buckets of some members, between members outside the largest component and all others."""
    now = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    each = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    most = each.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all")).select("key", F.col("top.component").alias("main"), (F.col("all") - F.col("top.c")).alias("n_out"), "all").where("n_out > 0")
    now = settle(now.join(most, "key").select("key", "rep", "n", "component", (F.col("component") != F.col("main")).alias("is_out"), F.ceil(F.col("n_out") / OUTSIDE).cast("int").alias("outs"), F.ceil(F.col("all") / BLOCK).cast("int").alias("alls")))
    spot = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")
    outside = now.where("is_out").select("*", F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("col")).withColumn("part", F.col("col") * F.col("outs") + spot("outs")).withColumn("outside", F.lit(True))
    every = now.select("*", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("col")).withColumn("part", spot("alls") * F.col("outs") + F.col("col")).withColumn("outside", F.lit(False))
    cols = ["key", "part", "outside", "rep", "n", "component"]
    dealt = outside.select(*cols).unionByName(every.select(*cols)).join(sets.select("rep", "wide"), "rep").select(*cols, "wide")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_across, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(H.NO_ID)).alias("doc_id")
    texts = docs.select(ids, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = settle(texts.mapInArrow(_features, "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    classes = settle(found.where("n_shingles > 0").groupBy("set_key", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("first")).select("set_key", F.col("n_shingles").alias("n"), F.col("first.doc_id").alias("rep"), "first.bands"))
    entries = classes.select("set_key", "rep", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settle(entries.join(shared, "key").select("set_key", "rep", "n", "key", "size"))
    involved = small(members.select(F.col("rep").alias("doc_id")).distinct(), broadcast_ids)
    sets = settle(texts.join(involved, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "rep long, set_key binary, shingles binary, wide binary"))

    # the same members share a block in every bucket, and with it their stars
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)).cast("int")
    # by the set itself: an id may stand for several
    dealt = members.join(sets.select("set_key", "wide"), "set_key").join(classes.select("set_key", "bands"), "set_key").select("key", block.alias("block"), "rep", "n", "wide", "bands")
    told = settle(dealt.repartition("key", "block").sortWithinPartitions("key", "block", "rep").mapInArrow(_within, "a long, b long, open_key long").distinct())
    left = small(told.where("open_key IS NOT NULL").select(F.col("open_key").alias("key")).distinct(), broadcast_ids)
    told = told.where("open_key IS NULL").select("a", "b")
    links = _verify(told, sets)
    comps = components(links, links.count())
    large = members.where(F.col("size") > BLOCK)
    more = large.unionByName(members.where(F.col("size") <= BLOCK).join(left, "key", "left_semi")) if not left.isEmpty() else large
    if not more.isEmpty():
        more = settle(_crossed(more, comps, sets).join(told, ["a", "b"], "left_anti"))
        links = links.unionByName(_verify(more, sets))
        comps = components(links, links.count())

    by_class = classes.join(comps, classes["rep"] == comps["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select(H.named(F.col("doc_id")).alias("doc_id"), "n_shingles", H.named(F.col("component")).alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The documents with one of each component, that of the smallest id, and all columns."""
    drop = near_duplicates(docs, id_col, text_col, broadcast_ids).where(~F.col("kept")).select(F.col("doc_id").alias("__tw_drop")).distinct()
    drop = small(drop, broadcast_ids)
    return docs.join(drop, F.col(id_col).cast("long") == F.col("__tw_drop"), "left_anti")
