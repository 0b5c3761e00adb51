"""Dictionary and data records of an ordered stream of lines, and the lines out of them again.

A *session* is what one stream's codec remembers: templates by number, their move-to-front order,
the last numbers of each template, and, by kind, words, tokens or the values of each slot. It
turns a packet of lines into records: ``DICT`` with what the packet brings that is new, then
``DATA``, which only refers to what is known. Kinds:

* ``ints``: numbers as steps from the last line of the same template;
* ``typed``: besides, high-entropy tokens as typed values, each written once and referred to;
* ``words``: as ``ints``, with templates spelt in words that a dictionary numbers;
* ``slots``: numbers that their slot has had before refer to it (a flag a number, references at a
  fixed width), others step from the slot's last number;
* ``auto``: for each packet the shorter of ``slots`` and a packet that stands alone (``ALONE``).

With ``known`` templates given, nothing is added: a line of another template becomes a ``REJECT``
record with its text. Sessions are plain values, so a stream keeps them as state: the same
records come from ``records`` in batch and from ``stream_records``. One stream's records depend on
those before them, so a stream is one group; streams are independent.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import encode, forms, mine

#: state processors travel whole: their workers do not see files added to the application
for _module in (sys.modules[__name__], forms, encode, mine):
    cloudpickle.register_pickle_by_value(_module)

KINDS = ("ints", "typed", "words", "slots", "auto")
PACKET = 64
#: partitions of state for a few long streams, of which each is one group
PARTITIONS = 64
#: literals whose spelling in words is kept, so that it need not be found again
SPELT = 65_536
Record = tuple[str, int, int, bytes]  # kind, lines, new templates, packed


class Front:
    """Symbols 0, 1, 2, ... by last use, latest first; a new one stands last.

    Symbols lie at places that rise with their last use. A tree of counts over the places tells how many
    lie above one, so a step costs the logarithm of the symbols, not their number.
    """

    def __init__(self, order: Iterable[int] = ()):
        self._lay(list(order))

    def _lay(self, order: list[int], least: int = 1024) -> None:
        """Places for the symbols, with as much room again above and below."""
        n = len(order)
        room = n + max(least, 1024)
        self.held, self.at = array("q", [-1]) * (n + 2 * room), array("q", [0]) * n
        self.low, self.high, self.count = room, room + n, n
        for place, x in zip(range(self.high - 1, self.low - 1, -1), order, strict=True):
            self.held[place], self.at[x] = x, place
        size = len(self.held)
        self.tree, self.top = array("q", [0]) + array("q", (x >= 0 for x in self.held)), 1 << (size.bit_length() - 1)
        for i in range(1, size + 1):
            if (j := i + (i & -i)) <= size:
                self.tree[j] += self.tree[i]

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[int]:
        return (self.held[p] for p in range(self.high - 1, self.low - 1, -1) if self.held[p] >= 0)

    def reserve(self, n: int) -> None:
        """Room for ``n`` new symbols and ``n`` uses: none of them moves another symbol's place."""
        if self.low < n or len(self.held) - self.high < n:
            self._lay([*self], n)

    def _count(self, place: int, by: int) -> None:
        tree, i, size = self.tree, place + 1, len(self.held)
        while i <= size:
            tree[i] += by
            i += i & -i

    def _move(self, x: int, place: int) -> None:
        old = self.at[x]
        self.held[old] = -1
        self._count(old, -1)
        self.held[place], self.at[x] = x, place
        self._count(place, 1)

    def add(self) -> None:
        """The next symbol, behind all others."""
        if not self.low:
            self._lay([*self])
        self.low -= 1
        self.held[self.low] = self.count
        self.at.append(self.low)
        self.count += 1
        self._count(self.low, 1)

    def drop(self) -> None:
        """Undoes the last ``add``."""
        place = self.at.pop()
        self.held[place] = -1
        self.count -= 1
        self._count(place, -1)

    def use(self, x: int) -> int:
        """How many symbols stand before this one, which then is the first."""
        tree, i, below = self.tree, self.at[x] + 1, 0
        while i:
            below += tree[i]
            i &= i - 1
        if below < self.count:
            if self.high == len(self.held):
                self._lay([*self])
            self.high += 1
            self._move(x, self.high - 1)
        return self.count - below

    def take(self, position: int) -> int:
        """The symbol that stands there, which then is the first."""
        tree, place, step, rest, size = self.tree, 0, self.top, self.count - position, len(self.held)
        while step:
            if place + step <= size and tree[place + step] < rest:
                place += step
                rest -= tree[place]
            step >>= 1
        x = self.held[place]
        self.use(x)
        return x


class Session:
    """State of one stream, for writing or for reading. A packet costs what it holds, however long the stream was before."""

    def __init__(self, kind: str = "ints", known: list[str] | None = None):
        if kind not in KINDS:
            raise ValueError(f"no such kind: {kind}")
        self.kind, self.closed = kind, known is not None
        self.templates: list[tuple[str, ...]] = []
        self.arity: list[int] = []
        self.front = Front()
        self.last: dict[int, array] = {}
        self.tokens: list[str] = []
        self.words: list[str] = []
        #: values that each slot has had, of templates used twice or more; one used once has had its ``last``
        self.values: dict[int, list[list[int]]] = {}
        self.number: dict[tuple[str, ...], int] = {}
        self.token_number: dict[str, int] = {}
        self.word_number: dict[str, int] = {}
        self.value_number: dict[int, list[dict[int, int]]] = {}
        self.spelt: dict[str, bytes] = {}
        self.undo: list[Callable[[], None]] | None = None
        for template in dict.fromkeys(self._cut(line)[0] for line in known or ()):
            self._learn(template)

    def dumps(self) -> bytes:
        last, values = [[k, v.tolist()] for k, v in self.last.items()], list(self.values.items())
        return zlib.compress(json.dumps([self.kind, self.closed, self.templates, list(self.front), last, self.tokens, self.words, values]).encode(), 1)

    @classmethod
    def loads(cls, raw: bytes) -> Session:
        s = cls()
        s.kind, s.closed, templates, front, last, tokens, words, values = json.loads(zlib.decompress(raw))
        for t in templates:
            s._name(tuple(t))
        s.front, s.last, s.values = Front(front), {k: array("q", v) for k, v in last}, dict(values)
        _number(s.tokens, s.token_number, tokens)
        _number(s.words, s.word_number, words)
        return s

    def _cut(self, line: str | None) -> forms.Cut:
        return forms.cut(line, self.kind == "typed")

    def _name(self, template: tuple[str, ...]) -> None:
        template = tuple(map(sys.intern, template))  # templates share most of their parts
        self.number[template] = len(self.templates)
        self.templates.append(template)
        self.arity.append(template[1::2].count("n"))

    def _learn(self, template: tuple[str, ...]) -> None:
        self._name(template)
        self.front.add()
        if self.undo is not None:
            self.undo.append(self._forget)

    def _forget(self) -> None:
        del self.number[self.templates.pop()]
        self.arity.pop()
        self.front.drop()

    # --- writing

    def write(self, places: list[int], lines: list[str | None]) -> list[Record]:
        """The records of one packet."""
        if self.kind == "auto":
            self.front.reserve(len(lines))
            self.undo = []
            records = self._write(places, lines)
            undo, self.undo = self.undo, None
            alone = forms.Out()
            forms.write_places(alone, places)
            alone += forms.smallest(lines)
            if len(alone) < sum(len(r[3]) for r in records):
                for back in reversed(undo):
                    back()
                return [("ALONE", len(lines), 0, bytes(alone))]
            return records
        return self._write(places, lines)

    def _write(self, places: list[int], lines: list[str | None]) -> list[Record]:
        cuts = [self._cut(x) for x in lines]
        records: list[Record] = []
        if self.closed:
            strange = {i for i, c in enumerate(cuts) if c[0] not in self.number}
            for i in sorted(strange):
                out = forms.Out()
                forms.write_places(out, [places[i]])
                out.text(lines[i] or "")
                records.append(("REJECT", 1, 0, bytes(out)))
            keep = [i for i in range(len(lines)) if i not in strange]
            places, cuts = [places[i] for i in keep], [cuts[i] for i in keep]
            if not keep:
                return records
        else:
            book, n = self._dictionary(cuts)
            if book:
                records.append(("DICT", 0, n, book))
        out = forms.Out()
        forms.write_places(out, places)
        ids = [self.number[t] for t, _, _ in cuts]
        forms.write_bits(out, [self._use(x) for x in ids])
        (self._write_slots if self.kind in ("slots", "auto") else self._write_steps)(out, ids, [n for _, n, _ in cuts])
        for *_, found in cuts:
            out.numbers(self.token_number[t] for t in found)
        return [*records, ("DATA", len(cuts), 0, zlib.compress(bytes(out), 9))]

    def _use(self, x: int) -> int:
        if self.undo is not None:
            self.undo.append(partial(self.front._move, x, self.front.at[x]))
        return self.front.use(x)

    def _dictionary(self, cuts: list[forms.Cut]) -> tuple[bytes, int]:
        """What the packet brings that is new, learnt and written; empty if nothing is."""
        fresh = [t for t in dict.fromkeys(t for t, _, _ in cuts) if t not in self.number]
        tokens = [t for t in dict.fromkeys(t for *_, found in cuts for t in found) if t not in self.token_number]
        if not fresh and not tokens:
            return b"", 0
        out = forms.Out()
        if self.kind == "words":
            known = len(self.words)
            spelt = [forms.varint(len(t)) + b"".join(map(self._spelt, t)) for t in fresh]
            out.number(len(self.words) - known)
            out += b"".join(map(forms.textual, self.words[known:]))
            out.number(len(fresh))
            out += b"".join(spelt)
        else:
            out.number(len(fresh))
            for t in fresh:
                forms.write_template(out, t)
        out.number(len(tokens))
        for t in tokens:
            forms.write_typed(out, t)
        self._take(fresh, tokens)
        return zlib.compress(bytes(out), 9), len(fresh)

    def _spelt(self, part: str) -> bytes:
        """A literal by the numbers of its words; words that are new are learnt."""
        found = self.spelt.get(part)
        if found is None:
            words = _spell(part)
            _number(self.words, self.word_number, [w for w in dict.fromkeys(words) if w not in self.word_number])
            found = forms.varint(len(words)) + b"".join(forms.varint(self.word_number[w]) for w in words)
            if len(self.spelt) == SPELT:
                self.spelt.clear()
            self.spelt[part] = found
        return found

    def _take(self, templates: list[tuple[str, ...]], tokens: list[str]) -> None:
        for t in templates:
            self._learn(t)
        _number(self.tokens, self.token_number, tokens)

    def _write_steps(self, out: forms.Out, ids: list[int], rows: list[list[int]]) -> None:
        for x, row in zip(ids, rows, strict=True):
            before = self.last.get(x) or [0] * len(row)
            out.signeds(v - b for v, b in zip(row, before, strict=True))
            self.last[x] = array("q", row)

    def _write_slots(self, out: forms.Out, ids: list[int], rows: list[list[int]]) -> None:
        flags, refs, steps = [], [], []
        for x, row in zip(ids, rows, strict=True):
            before = self.last.get(x)
            if before is None:  # its slots have had nothing
                flags += [0] * len(row)
                steps += row
            else:
                had, known = self._had(x), self._known(x)
                for slot, v in enumerate(row):
                    at = known[slot].get(v)
                    flags.append(int(at is not None))
                    if at is not None:
                        refs.append(at)
                        continue
                    steps.append(v - before[slot])
                    known[slot][v] = len(had[slot])
                    had[slot].append(v)
                    if self.undo is not None:
                        self.undo.append(partial(_unhad, had[slot], known[slot]))
            if self.undo is not None:
                self.undo.append(partial(self._back, x, before))
            self.last[x] = array("q", row)
        out.bits(flags, 1)
        forms.write_bits(out, refs)
        out.signeds(steps)

    def _had(self, x: int) -> list[list[int]]:
        """Values that the slots of a template used before have had, in order."""
        if x not in self.values:
            self.values[x] = [[v] for v in self.last[x]]
        return self.values[x]

    def _known(self, x: int) -> list[dict[int, int]]:
        """The places of those values."""
        if x not in self.value_number:
            self.value_number[x] = [{v: i for i, v in enumerate(had)} for had in self._had(x)]
        return self.value_number[x]

    def _back(self, x: int, before: array | None) -> None:
        if before is not None:
            self.last[x] = before
            return
        del self.last[x]
        self.values.pop(x, None)
        self.value_number.pop(x, None)

    # --- reading

    def read(self, kind: str, raw: bytes) -> list[tuple[int, str | None]]:
        """(place, line) of a record."""
        if kind == "ALONE":
            inp = forms.In(raw)
            return list(zip(forms.read_places(inp), forms.unpacked(raw[inp.at :]), strict=True))
        if kind == "REJECT":
            inp = forms.In(raw)
            return [(forms.read_places(inp)[0], inp.text())]
        inp = forms.In(zlib.decompress(raw))
        if kind == "DICT":
            if self.kind == "words":
                words = self.words
                words += inp.texts(inp.number())
                number = inp.number
                fresh = [tuple(words[number()] if (n := number()) == 1 else "".join([words[number()] for _ in range(n)]) for _ in range(number())) for _ in range(number())]
            else:
                fresh = [forms.read_template(inp) for _ in range(inp.number())]
            self._take(fresh, [forms.read_typed(inp) for _ in range(inp.number())])
            return []
        places = forms.read_places(inp)
        ids = [self.front.take(at) for at in forms.read_bits(inp)]
        rows = (self._read_slots if self.kind in ("slots", "auto") else self._read_steps)(inp, ids)
        found = [[self.tokens[inp.number()] for _ in range(self.templates[x][1::2].count("t"))] for x in ids]
        return [(p, forms.joined(self.templates[x], iter(row), iter(ts))) for p, x, row, ts in zip(places, ids, rows, found, strict=True)]

    def _read_steps(self, inp: forms.In, ids: list[int]) -> list[list[int]]:
        rows = []
        for x in ids:
            steps, before = inp.signeds(self.arity[x]), self.last.get(x)
            rows.append([b + v for b, v in zip(before, steps, strict=True)] if before else steps)
            self.last[x] = array("q", rows[-1])
        return rows

    def _read_slots(self, inp: forms.In, ids: list[int]) -> list[list[int]]:
        flags, refs, rows, at = inp.bits(1), iter(forms.read_bits(inp)), [], 0
        for x in ids:
            before = self.last.get(x)
            if before is None:
                at += self.arity[x]  # their flags are 0
                row = inp.signeds(self.arity[x])
            else:
                row = []
                for slot, values in enumerate(self._had(x)):
                    if flags[at]:
                        row.append(values[next(refs)])
                    else:
                        row.append(before[slot] + inp.signed())
                        values.append(row[-1])
                    at += 1
            self.last[x] = array("q", row)
            rows.append(row)
        return rows


def _number(names: list[str], number: dict[str, int], new: list[str]) -> None:
    for x in new:
        number[x] = len(names)
        names.append(x)


def _unhad(had: list[int], known: dict[int, int]) -> None:
    del known[had.pop()]


def _spell(part: str) -> list[str]:
    """The words of a literal and what stands between them."""
    return re.findall(" +|[^ ]+", part)


SCHEMA = "seq long, kind string, n_lines long, n_new long, packed binary"


def _packets(session: Session, seq: int, rows: pd.DataFrame, size: int) -> tuple[pd.DataFrame, int]:
    """The records of the rows in order, cut into packets; the last one may be shorter."""
    rows, out = rows.sort_values("line_no", kind="stable"), []
    places, lines = rows["line_no"].tolist(), [None if x is None or x != x else x for x in rows["line"]]
    for i in range(0, len(lines), size):
        for kind, n, new, raw in session.write(places[i : i + size], lines[i : i + size]):
            out.append((seq, kind, n, new, raw))
            seq += 1
    return pd.DataFrame(out, columns=["seq", "kind", "n_lines", "n_new", "packed"]), seq


def records(lines: DataFrame, kind: str = "ints", by: str = "stream", size: int = PACKET, known: list[str] | None = None) -> DataFrame:
    """(by, seq, kind, n_lines, n_new, packed) of each stream of (by, line_no, line)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _packets(Session(kind, known), 0, pdf, size)[0].assign(**{by: key[0]})[[by, "seq", "kind", "n_lines", "n_new", "packed"]]

    return lines.select(by, "line_no", "line").groupBy(by).applyInPandas(run, f"{by} long, {SCHEMA}")


class _Writer(StatefulProcessor):
    """Keeps the session and the next record's number."""

    def __init__(self, kind: str, size: int, known: list[str] | None):
        self.kind, self.size, self.known = kind, size, known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "seq long, body binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        seq, session = 0, Session(self.kind, self.known)
        if self.state.exists():
            seq, body = self.state.get()
            session = Session.loads(bytes(body))
        out, seq = _packets(session, seq, pd.concat(list(rows)), self.size)
        self.state.update((seq, session.dumps()))
        yield out.assign(stream=key[0])[["stream", "seq", "kind", "n_lines", "n_new", "packed"]]

    def close(self) -> None:
        pass


def stream_records(lines: DataFrame, kind: str = "ints", size: int = PACKET, known: list[str] | None = None) -> DataFrame:
    """The records of a stream of (stream, line_no, line), whose lines arrive in order; each batch ends its last packet."""
    return lines.groupBy("stream").transformWithStateInPandas(_Writer(kind, size, known), f"stream long, {SCHEMA}", "append", "none")


def lines_of(written: DataFrame, kind: str = "ints", by: str = "stream", known: list[str] | None = None) -> DataFrame:
    """(by, line_no, line, rejected) out of the records of each stream."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        session, places, lines, rejected = Session(kind, known), [], [], []
        for record, raw in pdf.sort_values("seq")[["kind", "packed"]].itertuples(index=False):
            for place, line in session.read(record, bytes(raw)):
                places.append(place)
                lines.append(line)
                rejected.append(record == "REJECT")
        return pd.DataFrame({by: key[0], "line_no": places, "line": pd.Series(lines, dtype=object), "rejected": rejected})

    # a few streams fall more evenly on ranges than on partitions by hash
    return written.select(by, "seq", "kind", "packed").repartitionByRange(by).groupBy(by).applyInPandas(run, f"{by} long, line_no long, line string, rejected boolean")
