"""Packet forms, stream records, codecs of channels and traces, and streams cut into stretches."""

import json
import random
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import encode, forms, index, mine, search, trace
from tracewright.operators import templates as M
from tracewright.sources import store
from tracewright.sources import tables as S
from tracewright.streaming import protocol

ODD = [None, "", " ", "a {} 007 12345678901234567890 é", "<*> x <*>", "at 2026-01-18 05:50:12.250Z id 6f9619ff-8b86-d011-b42d-00c04fc964ff 0123456789abcdefAB 123456789", "t 2026-13-40T99:99:99 q 2026-01-18T05:50:12", "x  y\tz", "0 00 000", "n", "t", "1234567" * 5, "\n\n", "𝔘 9", "\x00\x01"]


def sample(seed=1, n=60):
    rng = random.Random(seed)
    lines = [*ODD, *(f"user {rng.randrange(99)} logged in from 10.0.0.{i % 7} at {1000 + i} id {rng.randrange(10**9, 10**10)}" for i in range(n)), *["same line"] * 5]
    rng.shuffle(lines)
    return lines


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


@pytest.mark.parametrize("form", sorted(forms.FORMS))
def test_forms_give_lines_back(form):
    for seed in range(5):
        lines = sample(seed)
        assert forms.unpacked(forms.packed(lines, form)) == ([forms.lossy(x) for x in lines] if form == "lossy" else lines)
        assert forms.method(forms.packed(lines, form)) == form
    for lines in ([], [None], ["x"], ["x"] * 300):
        assert forms.unpacked(forms.packed(lines, form)) == lines


def test_smallest_is_the_shortest_of_seven():
    for seed in range(4):
        lines = sample(seed)
        assert len(forms.smallest(lines)) == min(len(forms.packed(lines, f)) for f in forms.SEVEN)
        assert forms.unpacked(forms.smallest(lines)) == lines


def test_numbers_and_bits():
    out, values = forms.Out(), [0, 1, 127, 128, 300, 2**40, 10**18 - 1]
    for v in values:
        out.number(v)
        out.signed(-v)
    forms.write_bits(out, values)
    forms.write_bits(out, [])
    inp = forms.In(bytes(out))
    assert [x for v in values for x in (inp.number(), inp.signed())] == [x for v in values for x in (v, -v)]
    assert forms.read_bits(inp) == values and forms.read_bits(inp) == []


@pytest.mark.parametrize("kind", protocol.KINDS)
def test_sessions_give_lines_back(kind):
    lines, writer, reader, got = sample(3), protocol.Session(kind), protocol.Session(kind), []
    for i in range(0, len(lines), 16):
        writer = protocol.Session.loads(writer.dumps())  # as state between batches
        for record, _, _, raw in writer.write(list(range(i, min(i + 16, len(lines)))), lines[i : i + 16]):
            got += reader.read(record, raw)
    assert got == list(enumerate(lines))


def test_front_is_a_list_moved_to_front():
    """Against a plain list, over many layings and with steps undone."""
    rng, front, plain = random.Random(2), protocol.Front(), []
    for k in range(6000):
        if not plain or rng.random() < 0.4:
            front.add()
            plain.append(len(plain))
        elif rng.random() < 0.5:
            x = plain[min(int(rng.expovariate(0.02)), len(plain) - 1)]
            assert front.use(x) == plain.index(x)
            plain.insert(0, plain.pop(plain.index(x)))
        else:
            at = rng.randrange(len(plain))
            assert front.take(at) == plain[at]
            plain.insert(0, plain.pop(at))
        if k % 997 == 0:
            assert list(front) == plain and len(front) == len(plain)
            front = protocol.Front(front)


@pytest.mark.parametrize("kind", ["ints", "typed", "words", "slots", "auto"])
def test_packets_cost_the_same_late_in_a_stream(kind):
    """Nothing that a packet does may go over all that the stream has had."""
    rng, session, reader, took, got = random.Random(4), protocol.Session(kind), protocol.Session(kind), [], []
    lines = [" ".join(rng.choices("abcdefgh", k=9)) + f" {i} {rng.getrandbits(64):016x} {i % 7}" for i in range(24_000 if kind != "auto" else 8_000)]
    for i in range(0, len(lines), 64):
        start = time.process_time()
        for record, _, _, raw in session.write(list(range(i, min(i + 64, len(lines)))), lines[i : i + 64]):
            got += reader.read(record, raw)
        took.append(time.process_time() - start)
    assert got == list(enumerate(lines))
    n = len(took) // 6
    assert sorted(took[-n:])[n // 2] < 3 * sorted(took[:n])[n // 2]


def test_auto_forgets_what_stood_alone():
    """Packets that stand alone leave the session as it was, as if they had not been."""
    rng = random.Random(7)
    session, other, records = protocol.Session("auto"), protocol.Session("slots"), []
    for i in range(0, 6400, 64):
        if i % 192:
            lines = [f"job {rng.randrange(30)} took {rng.randrange(50)} of {rng.randrange(4)}" for _ in range(64)]
        else:
            lines = [f"{rng.getrandbits(200):050x} {rng.randrange(10**15)}" for _ in range(64)]
        found = session.write(list(range(i, i + 64)), lines)
        records.append(found[-1][0])
        if found[-1][0] != "ALONE":
            assert found == other.write(list(range(i, i + 64)), lines)
        assert (session.templates, list(session.front), session.last) == (other.templates, list(other.front), other.last)
    assert {"ALONE", "DATA"} == set(records)


def test_state_processors_leave_kept_bytes_behind():
    """Over 1 MB Spark broadcasts a processor, and the worker that starts a stream has no broadcasts."""
    for k in range(forms.KEPT):
        forms.varint(k)
        forms.textual(f"{k:060d}")
    raw = cloudpickle.dumps(protocol._Writer("slots", 64, None))
    assert len(forms._texts) == forms.KEPT and len(raw) < 1 << 20
    state = cloudpickle.loads(raw).handleInputRows.__globals__
    there, here = state["Session"]("words"), protocol.Session("words")
    assert there.write([0, 1], ["a 1 b", "a 2 b"]) == here.write([0, 1], ["a 1 b", "a 2 b"])


def test_closed_dictionary_rejects(spark):
    rows = [(k % 2, k, x) for k, x in enumerate(["a 1", "b 2", "a 3", None, "a 4", "c"])]
    df = spark.createDataFrame(rows, "stream long, line_no long, line string")
    written = protocol.records(df, "ints", size=2, known=["a 1"])
    got = {r["line_no"]: (r["line"], r["rejected"]) for r in protocol.lines_of(written, "ints", known=["a 1"]).collect()}
    assert got == {0: ("a 1", False), 1: ("b 2", True), 2: ("a 3", False), 3: ("", True), 4: ("a 4", False), 5: ("c", True)}
    assert written.where("kind = 'DICT'").count() == 0


def test_batch_records(spark):
    lines = sample(5)
    df = frame(spark, lines).withColumn("stream", F.col("line_no") % 3)
    for kind in protocol.KINDS:
        back = protocol.lines_of(protocol.records(df, kind, size=7), kind)
        assert {r["line_no"]: r["line"] for r in back.collect()} == dict(enumerate(lines))
    with pytest.raises(ValueError, match="no such kind"):
        protocol.Session("none")


def test_template_ids_that_repeat(spark):
    """Two templates may share an event id: lines come back once each."""
    bank = [("E1", "job <*> took <*>"), ("1", "task <*> ended"), ("0x1", "task <*> began")]
    lines = ["job 1 took 2", "task 3 ended", "task 4 began", "else"]
    path = store.scratch_path(spark)
    store.write(frame(spark, lines), M.compile_bank(bank), path)
    back = store.read(spark, path).orderBy("line_no").collect()
    assert [r["line"] for r in back] == lines and [r["event_id"] for r in back] == [1, 1, 1, None]
    bare = M.match(frame(spark, lines), M.compile_bank(bank)).drop("tpl")
    with pytest.raises(ValueError, match="several templates"):
        M.render(bare, M.compile_bank(bank))


def test_terms_in_parameters_and_large_banks(spark):
    bank = M.compile_bank([("1", "alpha <*>"), *((str(k + 2), f"other {k} <*>") for k in range(60))])
    m = M.match(frame(spark, ["alpha zeta", *(f"other {k} zeta" for k in range(60)), "zeta alone"]), bank)
    assert M.fast_search(m, bank, "zeta").count() == 61
    near = M._anchored(bank)
    assert all(near(f"other {k} x") and bank[near(f"other {k} x")[0]].event_id == k + 2 for k in (0, 31, 59)) and near("nothing") == []


def test_store_of_packets(spark):
    lines = [x for x in sample(6, 300)]
    path = store.scratch_path(spark)
    store.write(frame(spark, lines), [], path, "dict", packet=16, group=4)
    assert store.kind_of(spark, path) == "dict"
    assert [r["line"] for r in store.read(spark, path).orderBy("line_no").collect()] == lines
    assert store.read_packets(spark, path, 1, 2).count() == 16
    tiny = store.scratch_path(spark)
    store.write(frame(spark, ["a"]), [], tiny, "dict")
    assert [r["line"] for r in store.read(spark, tiny).collect()] == ["a"]


def test_lines_of_files_of_mixed_sizes(spark, tmp_path):
    """By file, then place, though large files are read first."""
    small, large = [f"a {i}" for i in range(20)], [f"b {i}" for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(small) + "\n")
    (tmp_path / "b.txt").write_text("\r\n".join(large) + "\r\n")
    (tmp_path / "c.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = S.read_lines(spark, f"{tmp_path}/*.txt").orderBy("line_no").collect()
        first = S.read_lines(spark, f"{tmp_path}/*.txt", 3).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line"] for r in got] == small + large and [r["line_no"] for r in got] == list(range(4020))
    assert [r["line"] for r in first] == small[:3]


def test_substitution_keeps_control_bytes(spark):
    keys = ["k", "long_key", "\x01", "t0;"]
    texts = ['{"k":1,"long_key":"\x01k"}', "\x010;", "\x01t0;", "\x01e", '"\x01"', '"t0;"\x01t2;', "\x01\x01e\x01", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    back = df.select("i", encode.unsubstitute(encode.substitute(F.col("t"), keys), keys).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in back] == texts


def test_no_terms_null_lines_and_null_symbols(spark):
    df = frame(spark, ["a", None, "a b"])
    assert search.keywords(df, []).count() == 0 and search.indexed(index.packets(df), index.token_index(index.packets(df)), []).hits.count() == 0
    assert {r["template"]: r["n_lines"] for r in mine.mine(df, ["line_no"]).collect()} == {"a": 1, "a b": 1}
    codes = {r["line"]: r["code"] for r in encode.huffman(df, "line").collect()}
    assert set(codes) == {None, "a", "a b"} and sorted(map(len, codes.values())) == [1, 2, 2]


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_streams_in_stretches(spark, size):
    """One key for all rows, and several: as if each stream were one list."""
    rng = random.Random(8)
    rows = [(s, i, rng.randrange(-50, 50) if rng.random() < 0.9 else None, rng.choice("aab")) for i in range(120) for s in (rng.choice((None, 1, 2)),)]
    df = spark.createDataFrame(rows, "s int, i long, v long, x string")
    by = {}
    for s, i, v, x in rows:
        by.setdefault(s, []).append((i, v, x))
    got = {r["i"]: r for r in encode.deltas(df, "v", ["s"], ["i"], size=size).collect()}
    sums = {r["i"]: r["restored"] for r in encode._sums(df, "v", ["s"], ["i"], "restored", size).collect()}
    fronts = {r["i"]: r["position"] for r in encode.move_to_front(df, "x", "s", "i", size).collect()}
    runs = sorted((str(r["s"]), r["run"], r["value"], r["length"], r["first"]) for r in encode.runs(df, "x", ["s"], ["i"], size).collect())
    expected = []
    for s, items in by.items():
        before, total, front, run, last = 0, None, [], 0, None
        for i, v, x in items:
            assert got[i]["delta"] == (None if v is None else v - (before or 0))
            before = v
            total = total if v is None else (total or 0) + v
            assert sums[i] == total
            at = front.index(x) if x in front else len(front)
            assert fronts[i] == at
            front = [x] + [y for y in front if y != x]
            if x != last or not run:
                run += 1
                expected.append([str(s), run, x, 0, i])
            expected[-1][3] += 1
            last = x
    assert runs == sorted(map(tuple, expected))


def test_codes_by_count(spark):
    rng = random.Random(9)
    rows = [(c, i, f"v{rng.randrange(40) ** 2 % 31}") for i in range(900) for c in (i % 3,)]
    got = {(r["c"], r["v"]): (r["n"], r["code"]) for r in encode.dictionary_by_count(spark.createDataFrame(rows, "c int, i long, v string"), "v", ["i"], "c").collect()}
    for c in range(3):
        mine_ = [v for x, _, v in rows if x == c]
        order = sorted(dict.fromkeys(mine_), key=lambda v: (-mine_.count(v), mine_.index(v)))
        assert {v: got[c, v] for v in order} == {v: (mine_.count(v), k) for k, v in enumerate(order)}


def drain(lines):
    """The parse tree on one list of lines, by the paper: length, leading words, then the most similar cluster."""
    clusters = []  # [key, words, n, first]
    children = {}
    for at, line in enumerate(lines):
        if line is None:
            continue
        words = [w for w in line.split(" ") if w]
        lead = words[:1]
        key = []
        for w in lead:
            seen = children.setdefault((len(words), *key), [])
            k = "<*>" if any(c.isdigit() for c in w) else w
            if k not in seen and (("<*>" in seen and len(seen) >= 100) or len(seen) + ("<*>" not in seen) >= 100):
                k = "<*>"
            if k not in seen:
                seen.append(k)
            key.append(k)
        mates = [c for c in clusters if c[0] == (len(words), *key)]
        best = max(mates, key=lambda c: (sum(a == b != "<*>" for a, b in zip(c[1], words)) / max(1, len(words)), c[1].count("<*>")), default=None)
        if best is None or sum(a == b != "<*>" for a, b in zip(best[1], words)) / max(1, len(words)) < 0.4:
            clusters.append([(len(words), *key), words, 1, at])
        else:
            best[1] = [a if a == b else "<*>" for a, b in zip(best[1], words)]
            best[2] += 1
    out = {}
    for _, words, n, first in clusters:
        t = " ".join(words)
        out[t] = (out.get(t, (0, first))[0] + n, min(out.get(t, (0, first))[1], first))
    return out


def test_mining_against_one_list(spark):
    rng = random.Random(10)
    lines = [None, "", *(f"{rng.choice(('user', 'disk', 'node7', 'job'))} {rng.choice('abcdef')} {rng.choice(('is up', 'is down', 'took ' + str(rng.randrange(99))))}" for _ in range(400))]
    lines += [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} stands alone {i}" for i in range(150)]
    rng.shuffle(lines)
    got = {r["template"]: (r["n_lines"], r["first"][0]) for r in mine.mine(frame(spark, lines), ["line_no"]).collect()}
    assert got == drain(lines)
    apart = {r["template"]: r["n_lines"] for r in mine.mine(frame(spark, [f"user {i} in room {i % 5}" for i in range(300)]), ["line_no"], stretch=20).collect()}
    assert apart == {"user <*> in room <*>": 300}


def test_channels_give_values_back(spark):
    values = {0: ["1", "-5", "+7", "007", "9" * 30, ""], 1: ["10.0.0.1", "010.1.1.1", "255.255.255.255", "1.2.3.999"], 2: ["abcdef01", "ABCDEF01", "0xabcdef", "abc"], 3: ["x", "", "y z"]}
    rows = [(k * 10 + i, 1, k, v) for k, vs in values.items() for i, v in enumerate(vs)]
    found = spark.createDataFrame(rows, "line_no long, event_id long, channel int, value string")
    types = spark.createDataFrame([(1, k, kind) for k, kind in enumerate(("int", "ip", "hex", "raw"))], "event_id long, channel int, kind string")
    typed = encode.typed_channels(found, types, 4)
    assert {r["line_no"]: r["v"] for r in typed.withColumn("v", encode.untyped(typed)).collect()} == {r[0]: r[3] for r in rows}
    assert typed.where("number IS NOT NULL OR raw IS NOT NULL").count() == 5
    with pytest.raises(ValueError, match="more channels"):
        encode.typed_channels(found, types, 3)


def test_trace_lines_give_themselves_back(spark):
    rid = "6f9619ff-8b86-d011-b42d-00c04fc964ff"
    lines = [f"[2024-01-01T00:00:00.000+00:00] tool_call::a rid={rid} payload={{\"k\":1}}", f"2024-01-01T00:00:02Z tool_call::a rid={rid.upper()} payload={{}}", "[INFO] x", "2024-01-01 00:00:02 body", "[2024-01-01T00:00:01.123456-07:00] early", "free", "", "[2024-01-01T00:00:00.1+00:00] x\ny", None]
    coded = trace.encode(frame(spark, lines), ["k"])
    assert [r["line"] for r in trace.decode(coded, ["k"]).orderBy("line_no").collect()] == lines
    assert {r["line_no"] for r in coded.where("raw IS NULL").collect()} >= {0, 2, 3, 5, 6}


def test_typed_values_go_back(spark):
    lines = ["st=ok at 2026-01-18T05:50:12Z id 6F9619FF-8B86-D011-B42D-00C04FC964FF h 0xAF f -1.5e3 i -7", "", "none", "1 2 3.5"]
    back = frame(spark, lines).select("line", T.typed_refill(T.typed_template(F.col("line")), T.typed_values(F.col("line"))).alias("b")).collect()
    assert all(r["line"] == r["b"] for r in back)


def test_written_index(spark):
    lines = ["alpha beta", "alpha", "beta gamma", "é alpha beta", None, "delta alphabet beta"] * 40
    df = index.packets(frame(spark, lines), 3, 4)
    c = index.Context.of(df)
    for terms, mode in ((["alpha", "beta"], "and"), (["gamma", "delta"], "or"), (["é", "alph"], "and"), (["zzz"], "and"), ([], "and"), (["a"], "or")):
        expected = sorted(r["line_no"] for r in search.keywords(df, terms, mode).collect())
        for found in (c.hits(terms, mode), c.block_hits(terms, mode), c.two_level(terms, mode), c.two_level(terms, mode, "or"), index.two_level(df, terms, mode)[0]):
            assert sorted(r["line_no"] for r in found.collect()) == expected
    assert c.units_with("Delta").count() == df.where("line LIKE '%delta%'").select("packet_id").distinct().count()
    with pytest.raises(ValueError, match="more strictly"):
        c.two_level(["a"], "or", "and")


def test_structured_search_lets_no_match_escape(spark):
    """Against the flattened JSON in plain Python: keys with dots and brackets, case, escapes, repeated keys, numbers."""
    rng = random.Random(11)
    payloads = ['{"a.b":7}', '{"a":{"b":7}}', '{"a":{"b":7.0}}', '{"A":{"B":"X y"}}', '{"a":[1,{"b":"x Y "}]}', '{"a[1]":{"b":"\\u0058 y"}}', '{"a":1,"A":2}', '{"a":1,"a":{"b":7}}', '{"a":null}', '{"a":true}', '{"a":1e2}', '{"a":"100"}', '{"a":{}} tail', "[1,2]", "5", '"é"', '{"É":{"b":7}}', '{"a":{"b":7', '{"a":12345678901234567890}', '{"a":{"b":-0.0}}', '{"a":0.1}']
    lines = [f"tool_call::t rid=1 payload={p}" for p in payloads] + ["tool_call::u none", "free", None]
    words = ["k:a.b", "k:a", "k:a[1].b", "k:[0]", "kv:a.b=7", "kv:a.b=7.0", "kv:a.b=x y", "kv:a[1].b=x y", "kv:a=none", "kv:a=true", "kv:a=100", "kv:a=100.0", "kv:a=12345678901234567890", "n:a.b=7", "n:a=1", "n:a=100", "n:a.b=0", "n:a=0.1", "v:x y", "v:é", "k:é.b", "kv:a.b=-0.0", "k:" + "a." * 9 + "b", "k:", "kv:=5", "k:it's"]

    def leaves(line):
        try:
            return trace.flatten(json.loads(line.split("payload=", 1)[1])) if line and "payload=" in line else []
        except ValueError:
            return []

    def one(word, line):
        kind, _, rest = word.partition(":")
        path, eq, value = rest.partition("=")
        for p, k, t, n in leaves(line):
            if kind == "k" and p.lower() == rest or kind == "v" and k == "str" and t.lower() == rest:
                return True
            if kind == "kv" and p.lower() == path and t.strip(" ").lower() == value.strip():
                return True
            if kind == "n" and p.lower() == path and n is not None and n == float(value):
                return True
        return False

    df = frame(spark, lines)
    for w in words:
        assert sorted(r["line_no"] for r in search.search(df, [w]).collect()) == [i for i, x in enumerate(lines) if one(w, x)], w
    for _ in range(6):
        a, b = rng.sample(words, 2)
        for mode, both in (("and", all), ("or", any)):
            assert sorted(r["line_no"] for r in search.search(df, [a, b], mode).collect()) == [i for i, x in enumerate(lines) if both(one(w, x) for w in (a, b))], (a, b, mode)
