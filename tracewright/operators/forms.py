"""Packets of lines as bytes: what lines share is written once, and the lines come back exactly.

A line is cut into a template (its literals) and slots. A *form* says how the three streams of
a packet are written:

* text: which slots a line has. ``whole`` none; ``plain`` numbers; ``shared`` numbers where two
  lines share the template; ``mined`` the variable words of a mined template; ``tokens``,
  ``token_dict`` and ``token_types`` numbers and high-entropy tokens (inline, as a dictionary, as
  a dictionary of typed values); ``lossy`` numbers of the canonical text, which alone comes back;
* ids: the templates of the lines. ``ids`` plainly; ``runs`` with lengths; ``front`` as
  move-to-front positions; ``front_bits`` those at a fixed width; ``front_huffman`` by code;
* numbers: ``plain``; ``delta`` to the line of the same template before; ``adaptive`` the shorter
  of both for each slot; ``bits`` each slot at the width of its largest value.

A packet is a bounded group (``index.packets``), so no task holds more than one packet's state,
and packets are decoded alone. Numbers are digits without a leading zero, at most 18; others stay
in the literals. A null line comes back as null; an empty packet has no rows.
"""

from __future__ import annotations

import datetime
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .encode import canonical, code_lengths
from .mine import ANY, Miner

CANONICAL = T.CANONICAL
_NUMBER = re.compile(r"(?<![0-9])(0|[1-9][0-9]{0,17})(?![0-9])")
_TOKEN = re.compile(CANONICAL)
_WORD_GAP = re.compile(r"[ \t\n\x0B\f\r]+")
# The tags of the lossy canonical form, in the order in which they are put in.
_TAGS = ((T.TIMESTAMP, "<TS>"), (T.UUID, "<UUID>"), (T.HEX, "<HEX>"), (T.INT, "<INT>"))

#: name: (text, ids, numbers); a packet's first byte is the place of its form here
FORMS = {
    "lines": ("whole", "ids", "plain"),
    "templates": ("plain", "ids", "plain"),
    "hybrid": ("shared", "ids", "plain"),
    "front": ("plain", "front", "plain"),
    "front_bits": ("plain", "front_bits", "plain"),
    "front_delta": ("plain", "front_bits", "delta"),
    "canonical": ("tokens", "front_bits", "delta"),
    "front_huffman": ("plain", "front_huffman", "plain"),
    "runs": ("plain", "runs", "plain"),
    "adaptive": ("plain", "front_bits", "adaptive"),
    "value_bits": ("plain", "front_bits", "bits"),
    "canonical_dict": ("token_dict", "front_bits", "delta"),
    "canonical_types": ("token_types", "front_bits", "delta"),
    "mined": ("mined", "front_bits", "plain"),
    "lossy": ("lossy", "front_bits", "delta"),
}
#: alternatives of which ``smallest`` keeps the shortest
SEVEN = ("lines", "templates", "hybrid", "front", "front_bits", "front_delta", "canonical")
Template = tuple[str, ...]  # literal, kind, literal, kind, ..., literal; empty for a null line


class Out(bytearray):
    """Bytes written one value after another."""

    def number(self, n: int) -> None:
        while n > 127:
            self.append(n & 127 | 128)
            n >>= 7
        self.append(n)

    def signed(self, n: int) -> None:
        self.number(2 * n if n >= 0 else -2 * n - 1)

    def blob(self, b: bytes) -> None:
        self.number(len(b))
        self += b

    def text(self, s: str) -> None:
        self.blob(s.encode("utf-8", "surrogatepass"))

    def numbers(self, values: Iterable[int]) -> None:
        self += b"".join(map(varint, values))

    def signeds(self, values: Iterable[int]) -> None:
        self.numbers(2 * n if n >= 0 else -2 * n - 1 for n in values)

    def bits(self, values: list[int], width: int) -> None:
        digits = map(str, values) if width == 1 else map(f"{{:0{width}b}}".format, values)
        self.blob(int("1" + "".join(digits), 2).to_bytes((width * len(values)) // 8 + 1, "big"))


class _Kept(dict):
    """A table that travels empty: workers get these functions by value, and what state processors bring must stay under 1 MB."""

    def __reduce__(self):
        return _Kept, ()


#: short texts and numbers as bytes, as they come again
KEPT = 65_536
_numbers: dict[int, bytes] = _Kept()
_texts: dict[str, bytes] = _Kept()


def varint(n: int) -> bytes:
    """A number as ``Out.number`` writes it."""
    found = _numbers.get(n)
    if found is None:
        out = Out()
        out.number(n)
        found = bytes(out)
        if len(_numbers) < KEPT:
            _numbers[n] = found
    return found


def textual(s: str) -> bytes:
    """A text as ``Out.text`` writes it."""
    found = _texts.get(s)
    if found is None:
        raw = s.encode("utf-8", "surrogatepass")
        found = varint(len(raw)) + raw
        if len(raw) < 64 and len(_texts) < KEPT:
            _texts[s] = found
    return found


class In:
    """The reader of what ``Out`` wrote."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def number(self) -> int:
        n = shift = 0
        while True:
            b = self.raw[self.at]
            self.at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    def signed(self) -> int:
        z = self.number()
        return z // 2 if z % 2 == 0 else -(z + 1) // 2

    def signeds(self, count: int) -> list[int]:
        raw, at, out = self.raw, self.at, []
        for _ in range(count):
            z = raw[at]
            at += 1
            if z > 127:
                self.at = at - 1
                z = self.number()
                at = self.at
            out.append(-(z + 1 >> 1) if z & 1 else z >> 1)
        self.at = at
        return out

    def blob(self) -> bytes:
        n = self.number()
        self.at += n
        return self.raw[self.at - n : self.at]

    def texts(self, count: int) -> list[str]:
        raw, at, out = self.raw, self.at, []
        for _ in range(count):
            n = raw[at]
            at += 1
            if n > 127:
                self.at = at - 1
                n = self.number()
                at = self.at
            out.append(str(raw[at : at + n], "utf-8", "surrogatepass"))
            at += n
        self.at = at
        return out

    def text(self) -> str:
        return self.blob().decode("utf-8", "surrogatepass")

    def bits(self, width: int) -> list[int]:
        digits = format(int.from_bytes(self.blob(), "big"), "b")[1:]
        return [*map(int, digits)] if width == 1 else [int(digits[i : i + width], 2) for i in range(0, len(digits), width)]


# --- cutting lines ----------------------------------------------------------------------------------

Cut = tuple[Template, list[int], list[str]]


def cut(line: str | None, tokens: bool = False) -> Cut:
    """Template, numbers and high-entropy tokens of a line."""
    if line is None:
        return (), [], []
    parts, numbers, found, at = [], [], [], 0

    def plain(text: str) -> str:
        pieces = _NUMBER.split(text)
        numbers.extend(map(int, pieces[1::2]))
        pieces[1::2] = ["n"] * (len(pieces) // 2)
        parts.extend(pieces[:-1])
        return pieces[-1]

    for m in _TOKEN.finditer(line) if tokens else ():
        parts.extend((plain(line[at : m.start()]), "t"))
        found.append(m[0])
        at = m.end()
    parts.append(plain(line[at:]))
    return tuple(parts), numbers, found


def joined(template: Template, numbers: Iterator[int], tokens: Iterator[str]) -> str | None:
    if not template:
        return None
    parts = list(template)
    parts[1::2] = [str(next(numbers)) if p == "n" else next(tokens) for p in parts[1::2]]
    return "".join(parts)


def _whole(lines: list[str | None]) -> list[Cut]:
    return [((), [], []) if x is None else ((x,), [], []) for x in lines]


def _shared(lines: list[str | None]) -> list[Cut]:
    cuts = [cut(x) for x in lines]
    often = Counter(t for t, _, _ in cuts)
    return [c if often[c[0]] > 1 else w for c, w in zip(cuts, _whole(lines), strict=True)]


def _mined(lines: list[str | None]) -> list[Cut]:
    """Words apart at single spaces; what differs between the lines of a mined template is a slot."""
    miners: dict[int, Miner] = {}
    words = [None if x is None else x.split(" ") for x in lines]
    # a word that looks like a slot would be taken for one
    at = [None if w is None or ANY in w else miners.setdefault(len(w), Miner()).add(w) for w in words]
    out = []
    for x, w, c in zip(lines, words, at, strict=True):
        if c is None:
            out += _whole([x])
            continue
        parts, found, literal = [], [], ""
        for i, (t, word) in enumerate(zip(miners[len(w)].clusters[c], w, strict=True)):
            literal += " " if i else ""
            if t == ANY:
                parts += [literal, "t"]
                found.append(word)
                literal = ""
            else:
                literal += word
        out.append(((*parts, literal), [], found))
    return out


def lossy(line: str | None) -> str | None:
    """The canonical text that ``text.canonical_lossy`` gives."""
    for pattern, tag in _TAGS if line is not None else ():
        line = re.sub(pattern, tag, line, flags=re.A)
    return line and _WORD_GAP.sub(" ", line).strip(" ")


_TEXT: dict[str, Callable[[list], list[Cut]]] = {
    "whole": _whole,
    "plain": lambda lines: [cut(x) for x in lines],
    "shared": _shared,
    "mined": _mined,
    "tokens": lambda lines: [cut(x, True) for x in lines],
    "token_dict": lambda lines: [cut(x, True) for x in lines],
    "token_types": lambda lines: [cut(x, True) for x in lines],
    "lossy": lambda lines: [cut(lossy(x)) for x in lines],
}


# --- ids ---------------------------------------------------------------------------------------------

def front_positions(ids: list[int], front: list[int]) -> list[int]:
    """Move-to-front positions; ``front`` is changed."""
    out = []
    for x in ids:
        at = front.index(x)
        front.insert(0, front.pop(at))
        out.append(at)
    return out


def front_ids(positions: list[int], front: list[int]) -> list[int]:
    out = []
    for at in positions:
        out.append(front[at])
        front.insert(0, front.pop(at))
    return out


def width_of(values: list[int]) -> int:
    return max(1, max(values, default=0).bit_length())


def write_bits(out: Out, values: list[int]) -> None:
    width = width_of(values)
    out.number(width)
    out.bits(values, width)


def read_bits(inp: In) -> list[int]:
    return inp.bits(inp.number())


def _write_ids(out: Out, way: str, ids: list[int], k: int) -> None:
    if way == "runs":
        runs = [i for i, x in enumerate(ids) if not i or x != ids[i - 1]]
        out.number(len(runs))
        for i, j in zip(runs, [*runs[1:], len(ids)], strict=False):
            out.number(ids[i])
            out.number(j - i)
        return
    values = ids if way == "ids" else front_positions(ids, list(range(k)))
    if way == "front_bits":
        write_bits(out, values)
    elif way == "front_huffman":
        lengths = code_lengths(Counter(values))
        codes = canonical(lengths)
        out.number(len(lengths))
        for v in sorted(lengths):
            out.number(v)
            out.number(lengths[v])
        out.bits([1], 1) if not values else out.blob(int("1" + "".join(codes[v] for v in values), 2).to_bytes(sum(lengths[v] for v in values) // 8 + 1, "big"))
    else:
        for v in values:
            out.number(v)


def _read_ids(inp: In, way: str, n: int, k: int) -> list[int]:
    if way == "runs":
        ids = []
        for _ in range(inp.number()):
            x = inp.number()
            ids += [x] * inp.number()
        return ids
    if way == "front_bits":
        values = read_bits(inp)
    elif way == "front_huffman":
        lengths = {inp.number(): inp.number() for _ in range(inp.number())}
        symbol = {c: v for v, c in canonical(lengths).items()}
        values, code = [], ""
        for bit in format(int.from_bytes(inp.blob(), "big"), "b")[1:] if n else (inp.blob(), "")[1]:
            code += bit
            if code in symbol:
                values.append(symbol[code])
                code = ""
    else:
        values = [inp.number() for _ in range(n)]
    return values if way == "ids" else front_ids(values, list(range(k)))


# --- numbers -----------------------------------------------------------------------------------------

def _steps(column: list[int]) -> list[int]:
    return [v - (column[i - 1] if i else 0) for i, v in enumerate(column)]


def _zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def _size(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def _columns(ids: list[int], rows: list[list[int]]) -> dict[tuple[int, int], list[int]]:
    """Values by (template, slot), in order."""
    found: dict[tuple[int, int], list[int]] = {}
    for x, row in zip(ids, rows, strict=True):
        for slot, v in enumerate(row):
            found.setdefault((x, slot), []).append(v)
    return {key: found[key] for key in sorted(found)}


def _write_numbers(out: Out, way: str, ids: list[int], rows: list[list[int]]) -> None:
    if way == "plain":
        for row in rows:
            for v in row:
                out.number(v)
        return
    for column in _columns(ids, rows).values():
        if way == "bits":
            write_bits(out, column)
            continue
        steps = [_zigzag(v) for v in _steps(column)]
        if way == "adaptive":
            shorter = sum(map(_size, steps)) < sum(map(_size, column))
            out.append(shorter)
            steps = steps if shorter else column
        for v in steps:
            out.number(v)


def _read_numbers(inp: In, way: str, ids: list[int], arity: list[int]) -> list[list[int]]:
    if way == "plain":
        return [[inp.number() for _ in range(arity[x])] for x in ids]
    columns = {}
    for key, holes in _columns(ids, [[0] * arity[x] for x in ids]).items():
        if way == "bits":
            columns[key] = read_bits(inp)
            continue
        stepped = way == "delta" or bool(inp.number())
        column: list[int] = []
        for _ in holes:
            column.append((column[-1] if column else 0) + inp.signed() if stepped else inp.number())
        columns[key] = column
    rows, at = [], Counter()
    for x in ids:
        rows.append([columns[x, slot][at[x]] for slot in range(arity[x])])
        at[x] += 1
    return rows


# --- tokens ------------------------------------------------------------------------------------------

_STAMP = re.compile(r"(\d{4}-\d\d-\d\d)([T ])(\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z?)", re.A)
_ZERO = datetime.datetime(1970, 1, 1)


def write_typed(out: Out, token: str) -> None:
    """A token as time, UUID, hex digits or integer where that gives it back exactly, else as text."""
    if m := _STAMP.fullmatch(token):
        try:
            at = datetime.datetime.fromisoformat(f"{m[1]}T{m[3]}")
        except ValueError:
            at = None
        if at is not None:
            out += b"d"
            out.append((m[2] == "T") | bool(m[5]) << 1 | len(m[4] or "") << 2)
            out.signed(int((at - _ZERO).total_seconds()))
            out.number(int(m[4] or 0))
            return
    plain = token.replace("-", "")
    if re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", token):
        out += b"u" + bytes.fromhex(plain)
    elif re.fullmatch("0|[1-9][0-9]*", token, re.A):
        out += b"i"
        out.number(int(token))
    elif re.fullmatch("(?:[0-9a-f]{2})+", token):
        out += b"h"
        out.blob(bytes.fromhex(token))
    else:
        out += b"s"
        out.text(token)


def read_typed(inp: In) -> str:
    kind = chr(inp.raw[inp.at])
    inp.at += 1
    if kind == "d":
        flags = inp.raw[inp.at]
        inp.at += 1
        at, rest, digits = _ZERO + datetime.timedelta(seconds=inp.signed()), inp.number(), flags >> 2
        return at.isoformat("T" if flags & 1 else " ") + (f".{rest:0{digits}d}" if digits else "") + ("Z" if flags & 2 else "")
    if kind == "u":
        h = inp.raw[inp.at : inp.at + 16].hex()
        inp.at += 16
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    return str(inp.number()) if kind == "i" else inp.blob().hex() if kind == "h" else inp.text()


def _write_tokens(out: Out, text: str, tokens: list[str]) -> None:
    if text in ("tokens", "mined"):
        for t in tokens:
            out.text(t)
    elif text in ("token_dict", "token_types"):
        known = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        out.number(len(known))
        for t in known:
            out.text(t) if text == "token_dict" else write_typed(out, t)
        for t in tokens:
            out.number(known[t])


def _read_tokens(inp: In, text: str, n: int) -> list[str]:
    if text in ("tokens", "mined"):
        return [inp.text() for _ in range(n)]
    if text in ("token_dict", "token_types"):
        known = [inp.text() if text == "token_dict" else read_typed(inp) for _ in range(inp.number())]
        return [known[inp.number()] for _ in range(n)]
    return []


# --- packets -----------------------------------------------------------------------------------------

def write_template(out: Out, template: Template) -> None:
    out.number(len(template))
    out += b"".join(map(textual, template))


def read_template(inp: In) -> Template:
    return tuple(inp.texts(inp.number()))


def packed(lines: list[str | None], form: str) -> bytes:
    """A packet in a form; its first byte names the form."""
    text, way, how = FORMS[form]
    cuts = _TEXT[text](lines)
    known = {t: i for i, t in enumerate(dict.fromkeys(t for t, _, _ in cuts))}
    ids, out = [known[t] for t, _, _ in cuts], Out()
    out.number(len(lines))
    out.number(len(known))
    for t in known:
        write_template(out, t)
    _write_ids(out, way, ids, len(known))
    _write_numbers(out, how, ids, [n for _, n, _ in cuts])
    _write_tokens(out, text, [t for *_, found in cuts for t in found])
    return bytes([list(FORMS).index(form)]) + zlib.compress(bytes(out), 9)


def unpacked(raw: bytes) -> list[str | None]:
    """The lines of a packet (of form ``lossy``: their canonical texts)."""
    text, way, how = list(FORMS.values())[raw[0]]
    inp = In(zlib.decompress(raw[1:]))
    n, k = inp.number(), inp.number()
    known = [read_template(inp) for _ in range(k)]
    ids = _read_ids(inp, way, n, k)
    rows = _read_numbers(inp, how, ids, [t[1::2].count("n") for t in known])
    tokens = iter(_read_tokens(inp, text, sum(known[x][1::2].count("t") for x in ids)))
    return [joined(known[x], iter(row), tokens) for x, row in zip(ids, rows, strict=True)]


def smallest(lines: list[str | None], among: tuple[str, ...] = SEVEN) -> bytes:
    """The shortest of the alternatives; the first of equals."""
    return min((packed(lines, f) for f in among), key=len)


def method(raw: bytes) -> str:
    return list(FORMS)[raw[0]]


def write_places(out: Out, places: list[int]) -> None:
    out.number(len(places))
    for v in _steps(places):
        out.signed(v)


def read_places(inp: In) -> list[int]:
    places, last = [], 0
    for _ in range(inp.number()):
        last += inp.signed()
        places.append(last)
    return places


def encode(lines: DataFrame, form: str | None = None, unit: str = "packet_id", order: str = "line_no", line: str = "line", among: tuple[str, ...] = SEVEN) -> DataFrame:
    """(unit, method, n_lines, raw_bytes, places, packed) of each packet, in a form or the shortest of several."""
    if form is not None and form not in FORMS:
        raise ValueError(f"no such form: {form}")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        rows, at = t.column(line).to_pylist(), Out()
        raw = packed(rows, form) if form else smallest(rows, among)
        write_places(at, t.column(order).to_pylist())
        size = sum(len((x or "").encode("utf-8", "surrogatepass")) + 1 for x in rows)
        return pa.table({unit: [key[0].as_py()], "method": [method(raw)], "n_lines": [len(rows)], "raw_bytes": [size], "places": [bytes(at)], "packed": [raw]})

    return lines.select(unit, order, line).groupBy(unit).applyInArrow(run, f"{unit} long, method string, n_lines long, raw_bytes long, places binary, packed binary")


def decode(packets: DataFrame, unit: str = "packet_id", order: str = "line_no") -> DataFrame:
    """(unit, order, line): the lines of all packets, each packet on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, at, raw in zip(*(b.column(c).to_pylist() for c in (unit, "places", "packed")), strict=True):
                places, lines = read_places(In(at)), unpacked(raw)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=[unit, order, "line"])

    return packets.select(unit, "places", "packed").mapInArrow(run, f"{unit} long, {order} long, line string")


# --- whole packets under a trained dictionary ---------------------------------------------------------

def train(sample: DataFrame, order: str, line: str = "line", size: int = 16_384) -> bytes:
    """A zstd dictionary learnt on the driver from a bounded sample of lines, in order; empty if they are too few."""
    import zstandard

    rows = [(r[line] or "").encode() for r in sample.select(order, line).orderBy(order).collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def plain(places: list[int], lines: list[str | None]) -> bytes:
    out = Out()
    write_places(out, places)
    for x in lines:
        out.number(x is not None)
        out.text(x or "")
    return bytes(out)


def unplain(raw: bytes) -> tuple[list[int], list[str | None]]:
    inp = In(raw)
    places = read_places(inp)
    return places, [x if there else None for there, x in ((inp.number(), inp.text()) for _ in places)]


def squeezed(raw: bytes, book: bytes, level: int = 10) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(book) if book else None).compress(raw)


def unsqueezed(raw: bytes, book: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book) if book else None).decompress(raw)


def sizes(packets: DataFrame) -> DataFrame:
    """(method, n_packets, raw_bytes, bytes) over encoded packets."""
    return packets.groupBy("method").agg(F.count(F.lit(1)).alias("n_packets"), F.sum("raw_bytes").alias("raw_bytes"), F.sum(F.length("packed") + F.length("places")).alias("bytes"))
