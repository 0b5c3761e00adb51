"""Best-fit packing of tokenised documents into sequences, by bin completion.

A document's ids are those of the byte-level BPE and a closing id; one longer
than ``size`` is cut into pieces of ``size``, the first of which may be shorter.
Only the lengths of pieces matter to packing, so the solver sees a histogram of
at most ``size`` counts, whatever the corpus, and answers with *patterns*: which
lengths share a sequence, and how often. Equal sequences are completed together.

Solver. Best-fit decreasing gives the incumbent. If it misses the lower bound,
bin completion looks for better: it takes the largest length left, enumerates
the undominated fillings around it (no length left over could be added, nor
replace a smaller one), tries those of least waste first, and prunes a branch
once its waste exceeds what an improvement by one sequence allows. The node
budget is a parameter; the best packing found stands. Beyond the budget, the
enumeration is capped: half of the nodes go to each of two orders; an enumeration
ends after 3 fillings without waste and 600 branches (first order: pairs before
others) or 12 and 4000 (second); of what it finds at most 3 fillings are tried, and
only the first once 64 choices are open. If the branches run out before any
filling, the largest piece is closed alone. So more sequences than needed can
result, though never more than best-fit decreasing needs; no piece is lost.

Plan. Documents are tokenised once; pieces (ids left out unless asked for) are
written to the shared folder. The histogram is a map-side combined count. Pieces
of a length are numbered within salts of the piece's hash, each salt starting
where the counts of those before it end, so that a length with a third of all
pieces is not one task; the number picks the slot.

Tokeniser. Ids are those that ``tokenizers`` gives with the JSON file. They are computed
by ``tiktoken`` from the ranks file, which holds the same vocabulary; texts are
cut at single spaces between other characters, where no token spans, and each
part is encoded once and remembered (at most CACHE parts a worker, then anew).
Texts that hold one of the vocabulary's special strings go to the JSON file's
tokeniser whole. Tests hold both against each other.

Defined cases: a null text is empty and yields the closing id alone; rows with
equal ids are documents of their own; a null id is kept. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle

SIZE = 2048
END_ID = 0
NODES = 10_000
CACHE = 400_000
SPECIAL = ("<|endoftext|>",)
_SPLIT = re.compile(r"(?<=\S)(?= \S)")


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; a dict from parts, without their leading space, to ids."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, ranks_path: str, json_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.whole = json_path, None

    @classmethod
    def of(cls, ranks_path: str, json_path: str) -> Encoder:
        return cls._made.get((ranks_path, json_path)) or cls._made.setdefault((ranks_path, json_path), cls(ranks_path, json_path))

    def ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes | None:
        if len(self) >= CACHE:
            self.clear()
        out = self.ids(" " + part) if part and not part[0].isspace() and not part[-1].isspace() else None
        self[part] = out
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in SPECIAL):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *parts = text.split(" ")
        try:
            if head and not head[-1].isspace():
                return b"".join([self.ids(head), *map(self.__getitem__, parts)])
        except TypeError:  # white space beside a space: a cut there could change tokens
            pass
        return b"".join(map(self.ids, _SPLIT.split(text)))


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    files = files or tokenizer_files()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(*files)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (encoder.encode(text) if text else b"") + end
                n, at = len(ids) // 4, 0
                for k in range(-(-n // size)):
                    to = n - size * (-(-n // size) - 1 - k)
                    part = ids[4 * at : 4 * to]
                    rows.append((doc, k, at, to - at, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
                    at = to
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[5], pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Of the sequences needed: by total length, and for each k with lengths over size - k counted apart."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    pieces, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * lengths)))
    upto = lambda x: np.searchsorted(lengths, x, "right")
    k = lengths[lengths <= size // 2]
    half, most = upto(size // 2), upto(size - k)
    middle, free = pieces[most] - pieces[half], (pieces[most] - pieces[half]) * size - (total[most] - total[half])
    small = total[half] - total[np.searchsorted(lengths, k)]
    by_k = pieces[-1] - pieces[most] + middle + np.maximum(0, -(-(small - free) // size))
    return int(max(-(-total[-1] // size), by_k.max(initial=0)))


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit decreasing, over groups of equal open sequences."""
    room: dict[int, list[list]] = {}
    rooms: set[int] = set()
    done: list[Pattern] = []

    def put(pattern: tuple[int, ...], n: int, left: int) -> None:
        if left == 0:
            done.append((pattern, n))
        else:
            room.setdefault(left, []).append([pattern, n])
            rooms.add(left)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fits = [r for r in rooms if r >= length]
            if not fits:
                k = size // length
                whole, rest = divmod(n, k)
                if whole:
                    put((length,) * k, whole, size - k * length)
                if rest:
                    put((length,) * rest, 1, size - rest * length)
                break
            left = min(fits)
            group = room[left][-1]
            take = min(n, group[1])
            n -= take
            group[1] -= take
            if not group[1]:
                room[left].pop()
                if not room[left]:
                    rooms.discard(left)
            put((*group[0], length), take, left - length)
    return done + [(p, n) for groups in room.values() for p, n in groups]


def fillings(lengths: list[int], counts: dict[int, int], room: int, pairs: bool = True) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` out of the lengths left (descending), least waste first.

    One item that fills the room dominates all fillings, and a filling without
    waste is dominated by none; so one item and, with ``pairs``, two are tried first.
    """
    if counts.get(room):
        return [(room,)]
    most, tries = (3, 600) if pairs else (12, 4000)  # fillings wanted, and branches tried
    exact: list[tuple[int, ...]] = []
    for x in lengths if pairs else ():
        if 2 * x < room or len(exact) == most:
            break
        if x < room and counts.get(room - x, 0) > (2 * x == room):
            exact.append((x, room - x))
    if exact:
        return exact
    found: list[tuple[int, tuple[int, ...]]] = []
    left = [tries]

    def dominated(picked: tuple[int, ...], slack: int) -> bool:
        spare = lambda x: counts[x] > picked.count(x)
        if any(x <= slack and spare(x) for x in lengths):
            return True
        return any(s < x <= s + slack and spare(x) for s in set(picked) for x in lengths)

    def grow(i: int, picked: tuple[int, ...], slack: int) -> None:
        left[0] -= 1
        if left[0] < 0 or (found and sum(w == 0 for w, _ in found) >= most):
            return
        if slack == 0 or not any(x <= slack and counts[x] > picked.count(x) for x in lengths[i:]):
            if slack == 0 or not dominated(picked, slack):
                found.append((slack, picked))
            return
        if slack in counts and counts[slack] > picked.count(slack) and lengths[i] >= slack:
            found.append((0, (*picked, slack)))  # nothing dominates a filling without waste
            return
        for j in range(i, len(lengths)):
            x = lengths[j]
            if x <= slack and counts[x] > picked.count(x):
                grow(j, (*picked, x), slack - x)

    grow(0, (), room)
    return [p for _, p in sorted(found, key=lambda f: (f[0], len(f[1])))[:most]]


def complete(counts: dict[int, int], size: int = SIZE, nodes: int = NODES) -> list[Pattern]:
    """Patterns (lengths, how often) that hold all pieces in as few sequences as were found."""
    counts = {k: c for k, c in counts.items() if c}
    if not counts:
        return []
    incumbent = [best_fit(counts, size)]
    fewest = [sum(n for _, n in incumbent[0])]
    least, total, budget = lower_bound(counts, size), sum(k * c for k, c in counts.items()), [nodes]

    def search(left: dict[int, int], used: list[Pattern], bins: int, waste: int, pairs: bool) -> None:
        """Depth first over fillings of the largest length left, an explicit stack of choices."""
        stack = [(left, used, bins, waste)]
        while stack and fewest[0] > least and budget[0] > 0:
            left, used, bins, waste = stack.pop()
            if waste > (fewest[0] - 1) * size - total:  # cannot improve on the incumbent
                continue
            if not left:
                if bins < fewest[0]:
                    fewest[0], incumbent[0] = bins, used
                continue
            budget[0] -= 1
            lengths = sorted(left, reverse=True)
            first = lengths[0]
            rest = dict(left)
            rest[first] -= 1
            choices = fillings([x for x in lengths if rest[x]], rest, size - first, pairs) or [()]
            for fill in reversed(choices[: 3 if len(stack) < 64 else 1]):
                pattern = (first, *fill)
                often = min(left[x] // pattern.count(x) for x in set(pattern))
                after = {x: c - often * pattern.count(x) for x, c in left.items()}
                stack.append(({x: c for x, c in after.items() if c}, [*used, (pattern, often)], bins + often, waste + often * (size - sum(pattern))))

    for pairs in (True, False):  # two orders of fillings, each with half of the nodes
        budget[0] = nodes // 2
        if fewest[0] > least:
            search(counts, [], 0, 0, pairs)
    return incumbent[0]


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: for each use in a pattern the first slot, times, first sequence and offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, often in patterns:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((often, sequence, offset))
            offset += x
        sequence += often
    return {x: (np.cumsum([0] + [t[0] for t in uses[:-1]]), *(np.array(c, np.int64) for c in zip(*uses, strict=True))) for x, uses in out.items()}


def pack(found: DataFrame, size: int = SIZE, nodes: int = NODES) -> DataFrame:
    """The pieces with sequence_id and offset. ``found`` must be stored: it is read three times."""
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    slots = _slots(complete(histogram, size, nodes))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("salt", "before")
    names = [c for c in found.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, _, sequence, offset = slots[int(x)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                seq[mine], off[mine] = sequence[k] + rank[mine] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return ranked.select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, nodes: int = NODES, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(settle(pieces(docs, size, end_id, **options)), size, nodes)
