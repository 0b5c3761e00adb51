"""Adversarial rows: what a lossy or order-dropping store would get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import encode, index, memory, mine, search, trace
from tracewright.operators import templates as M
from tracewright.sources import store
from tracewright.sources import tables as S


def _lines(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def _stored(spark, lines, rows, kind="lite", **k):
    path = store.scratch_path(spark)
    store.write(_lines(spark, lines), M.compile_bank(rows), path, kind, **k)
    return path


ODD = [
    "job 007 took +5",
    "job 0xAB took ABCDEF1",
    "job  12  took x",
    "nothing known here",
    "job [*] took <*>",
    "job  took ",
    "",
    "job \\E(.*) took \\Q$1",
    "at 2024-01-01 00:00:00 job done",
    "at 2025-12-31T23:59:59.5 job done",
    "é job ü took ß \u0085",
    "job 7 took 8\r",
]
BANK = [("E1", "job <*> took <*>"), ("0x2", "at 2026-01-18 05:50:12 job done"), ("bad", "x"), ("3", "")]


@pytest.mark.parametrize("kind", ["lite", "cold", "hot"])
def test_store_is_lossless_and_ordered(spark, kind):
    """Text of parameters, unknown lines between known ones, wildcards in values, literal dates."""
    path = _stored(spark, ODD, BANK, kind)
    assert [r["line"] for r in store.read(spark, path).orderBy("line_no").collect()] == ODD
    assert store.kind_of(spark, path) == kind
    known = {r["line_no"]: r["event_id"] for r in store.read(spark, path).collect()}
    assert known[3] is None and known[0] == 1 and known[8] == known[9] == 2


def test_store_keeps_more_values_than_any_cap(spark):
    lines = [f"job {i * 7919} took {i}" for i in range(6000)]
    path = _stored(spark, lines, BANK)
    assert [r["line"] for r in store.read(spark, path).orderBy("line_no").collect()] == lines


def test_store_without_events_keeps_lines(spark):
    path = _stored(spark, ["a", "b"], [])
    assert [r["line"] for r in store.read(spark, path).orderBy("line_no").collect()] == ["a", "b"]


def test_event_ids():
    assert [M.event_id(x) for x in ("12", "E12", "e7", "0x1F", "0xff", "bad", "E", " 5 ")] == [12, 12, 7, 31, 255, None, None, 5]


def test_priority_of_templates(spark):
    bank = M.compile_bank([("1", "<*>"), ("2", "a <*>"), ("3", "a long anchor <*>"), ("4", "a b")])
    assert [t.event_id for t in bank] == [4, 3, 2, 1]
    got = M.match(_lines(spark, ["a b", "a long anchor x", "a c", "z"]), bank).orderBy("line_no").collect()
    assert [r["event_id"] for r in got] == [4, 3, 2, 1]


def test_batches_equal_chain(spark):
    bank = M.compile_bank(BANK)
    a = M.match(_lines(spark, ODD), bank).orderBy("line_no").collect()
    b = M._match_batches(_lines(spark, ODD), bank, "line").orderBy("line_no").collect()
    assert [(r["event_id"], r["params"]) for r in a] == [(r["event_id"], r["params"]) for r in b]


def test_filter_precedes_limit_and_unknown_lines_are_found(spark):
    lines = [f"job {i} took cheap" for i in range(50)] + ["job 51 took dear", "unknown dear line"]
    m = M.match(_lines(spark, lines), M.compile_bank(BANK))
    fast = M.fast_search(m, M.compile_bank(BANK), "job dear").limit(5).collect()
    assert [r["line_no"] for r in fast] == [50]
    assert sorted(r["line_no"] for r in M.route(m, M.compile_bank(BANK), "dear").collect()) == [50, 51]


def test_part_words_and_or(spark):
    lines = index.packets(_lines(spark, ["receiveBlock x", "other", "é only", "tail IOException"]), 1, 2)
    tokens = index.token_index(lines)
    for terms, mode, hits in ((["ceive"], "and", [0]), (["x"], "and", [0, 3]), (["é"], "and", [2]), (["ceiveb", "ioexc"], "or", [0, 3]), (["é", "other"], "or", [1, 2])):
        assert sorted(r["line_no"] for r in search.indexed(lines, tokens, terms, mode).hits.collect()) == hits


PAYLOAD = '{"a":{"b":[1,"x",true,null]},"n":1.0,"Up":"Mixed"}'
TRACE = [f"[2024-01-01T00:00:00.000+00:00] tool_call::a rid=6F9619FF-8B86-D011-B42D-00C04FC964FF payload={PAYLOAD}", "tool_call::b payload={broken", "tool_call::b payload={} tail", "free text"]


@pytest.mark.parametrize(
    ("words", "mode", "hits"),
    [
        (["k:a.b[0]"], "and", [0]),
        (["k:a"], "and", []),
        (["kv:a.b[2]=true"], "and", [0]),
        (["n:n=1"], "and", [0]),
        (["n:a.b[2]=1"], "and", [0]),
        (["kv:a.b[3]=none"], "and", [0]),
        (["kv:n=1.0"], "and", [0]),
        (["v:mixed"], "and", [0]),
        (["k:up"], "and", [0]),
        (["v:1"], "and", []),
        (["n:n=x"], "and", []),
        (["tool:"], "and", []),
        (["tool:a", "tool:b"], "or", [0, 1, 2]),
        (["tool:b", "k:a.b[0]"], "or", [0, 1, 2]),
        (["TEXT"], "and", [3]),
        ([" "], "and", []),
    ],
)
def test_structured_search(spark, words, mode, hits):
    assert sorted(r["line_no"] for r in search.search(_lines(spark, TRACE), words, mode).collect()) == hits


def test_trace_parse_keeps_text(spark):
    lines = [*TRACE, "[INFO] x", "2024-01-01T00:00:02Z bare tool", "[2024-01-01T00:00:01.123456-07:00] early"]
    got = trace.parse(_lines(spark, lines)).orderBy("line_no").collect()
    assert [r["ts_style"] for r in got] == ["bracket", "none", "none", "none", "none", "bare", "bracket"]
    assert got[0]["rid"] == "6F9619FF-8B86-D011-B42D-00C04FC964FF" and got[0]["payload"] == PAYLOAD
    assert got[4]["raw"] == "[INFO] x"
    assert got[6]["ts"].isoformat() == "2024-01-01T07:00:01.123456"


def test_deep_payload_is_flattened():
    deep = {"v": 1}
    for _ in range(500):
        deep = {"x": deep}
    assert trace.flatten(deep)[0][0].count(".") == 500


def test_canonical_round_trip(spark):
    lines = ["1234567 at 2026-01-18 05:50:12", "id 0123456789abcdefABCDEF00 then 7654321", "<@> own mark", "6F9619FF-8B86-D011-B42D-00C04FC964FF"]
    df = _lines(spark, lines).where("line_no <> 2")
    back = df.select("line", T.refill(T.canonical_text(F.col("line")), T.canonical_tokens(F.col("line"))).alias("back")).collect()
    assert all(r["line"] == r["back"] for r in back)


def test_templates_of_numbers(spark):
    row = _lines(spark, ["variant=A value 100 {x} 0099 ID=7 12"]).select(T.keyed_template(F.col("line")).alias("k"), T.number_template(F.col("line")).alias("n"), T.numbers(F.col("line")).alias("v")).first()
    assert row["k"] == "variant={} value {} {x} {} ID={} 12" and row["n"] == "variant={} value {} {x} {} ID={} {}"
    assert row["v"] == ["100", "0099", "7", "12"]


def test_typed_values(spark):
    line = "st=ok at 2026-01-18T05:50:12Z id 6F9619FF-8B86-D011-B42D-00C04FC964FF h 0xAF f -1.5e3 i -7"
    got = _lines(spark, [line]).select(T.typed_values(F.col("line")).alias("v")).first()["v"]
    assert [v["kind"] for v in got] == ["kv", "time", "uuid", "hex", "float", "int"]


def test_stems_and_terms():
    assert [T.stem_word(w) for w in ("Running", "added", "boxes", "cats", "is", "bed", "sing")] == ["runn", "add", "box", "cat", "is", "bed", "sing"]
    assert T.match_terms("Evaluating") == ["evaluating", "evaluat", "evalu"]


def test_memory_restores_any_position(spark):
    texts = ["\n\nProject: late\nbody\nGoal: g\nNote: n", "one", "", "a\nb\nc", "Decision: x\n\nDecision: y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = memory.packets(df).withColumn("led", F.startswith("text", F.concat("header", F.lit("\n"), "goal", F.lit("\n"))))
    got = {r["id"]: r for r in p.withColumn("back", memory.restore(p)).collect()}
    assert [got[i]["back"] for i in range(5)] == texts
    assert got[0]["header"] == "Project: late" and got[0]["goal"] == "Goal: g" and got[0]["witness"] == "Note: n"
    assert got[2]["header"] == "Chunk:"


def test_move_to_front_against_a_list(spark):
    rng = random.Random(3)
    rows = [(i % 3, i, rng.choice("abcde")) for i in range(300)]
    got = encode.move_to_front(spark.createDataFrame(rows, "s int, i int, x string"), "x", "s", "i").collect()
    lists, expected = {}, {}
    for s, i, x in rows:
        front = lists.setdefault(s, [])
        expected[i] = front.index(x) if x in front else len(front)
        if x in front:
            front.remove(x)
        front.insert(0, x)
    assert {r["i"]: r["position"] for r in got} == expected


def test_dictionary_ids_are_dense_and_in_order(spark):
    rows = [(i, f"v{i * i % 701}") for i in range(5000)]
    got = {r["v"]: r["id"] for r in encode.dictionary(spark.createDataFrame(rows, "i long, v string"), "v", ["i"]).collect()}
    assert got == {v: k for k, v in enumerate(dict.fromkeys(v for _, v in rows))}


def test_huffman_is_optimal():
    lengths = encode.code_lengths({"a": 5, "b": 9, "c": 12, "d": 13, "e": 16, "f": 45})
    assert sum(n * lengths[s] for s, n in {"a": 5, "b": 9, "c": 12, "d": 13, "e": 16, "f": 45}.items()) == 224
    assert encode.code_lengths({"x": 3}) == {"x": 1} and encode.code_lengths({}) == {}


def test_miner_and_parameters(spark):
    lines = [f"user {i} logged in from 10.0.0.{i % 7}" for i in range(40)] + [f"disk sd{c} full" for c in "abc"]
    got = {r["template"]: r["n_lines"] for r in mine.mine(_lines(spark, lines), ["line_no"]).collect()}
    assert got == {"user <*> logged in from <*>": 40, "disk <*> full": 3}
    assert mine.parameters("user 5 logged in from 10.0.0.5", "user <*> logged in from <*>") == ["5", "10.0.0.5"]
    assert mine.parameters("other", "user <*>") == []


def test_substitution_round_trip(spark):
    keys = ["k", "long_key"]
    texts = ['{"k":1,"long_key":"\x01k"}', '{"kk":2}', "\x010;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["b"] for r in df.select(encode.unsubstitute(encode.substitute(F.col("t"), keys), keys).alias("b")).collect()][:2] == texts[:2]


def test_ranges_and_selection(spark):
    lines = index.packets(_lines(spark, [str(i) for i in range(100)]), 10, 3)
    assert index.packet_range(lines, -5, 2).count() == 20 and index.packet_range(lines, 7, 7).count() == 0
    assert index.selected(lines, []).count() == 0 and index.selected(lines, [3], "block_id").count() == 10


def test_reading_lines_in_order(spark, tmp_path):
    lines = [f"line {i} é" for i in range(5000)]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n", "utf-8")
    got = S.read_lines(spark, str(tmp_path / "log.txt")).orderBy("line_no").collect()
    assert [r["line"] for r in got] == lines and [r["line_no"] for r in got] == list(range(5000))
    assert S.read_lines(spark, str(tmp_path / "log.txt"), 7).count() == 7
    (tmp_path / "t.csv").write_text('EventId,EventTemplate\nE1,"a, <*>"\n,x\nE2,\n')
    assert S.read_templates(spark, str(tmp_path / "t.csv")) == [("E1", "a, <*>")]


def test_commits(spark):
    path = store.scratch_path(spark)
    rec = lambda n, t: spark.createDataFrame([(n, "1", 3, 0.95, t)], "seq long, packet_version string, used_tier int, confidence double, text string")
    store.commit(spark, path, rec(2, "b"))
    store.commit(spark, path, rec(1, "a"))
    assert store.last_commit(spark.read.parquet(path)).first()["text"] == "b"
