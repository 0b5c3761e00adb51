"""The engine's own registered queries, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import encode, forms, index, memory, mine, reports, search, trace
from ..operators import templates as M
from ..sources import store
from ..sources import tables as S
from ..streaming import incremental, protocol

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: a bank in all notations of ids and wildcards; lines of ``view`` fit none
BANK_ROWS = [
    ("E1", "[<*>] tool_call::click rid=<*> payload=<*>"),
    ("2", '[<*>] tool_call::error rid=<*> payload={"p":{"k": <*>},"user":{"id":<*>,<*>'),
    ("0x03", "[[*]] tool_call::purchase rid=[*] payload=[*]"),
    ("e4", "[<*>] tool_call::signup rid=<*> payload=<*>"),
    ("bad", "[<*>] never <*>"),
    ("E9", "[<*>] tool_call::<*> rid=<*> payload=nothing"),
]
BANK = M.compile_bank(BANK_ROWS)

_RID = " || '-' || ".join(f"substr(md5(event_id::VARCHAR), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
TRACE = f"""trace AS (SELECT event_id AS line_no, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00] tool_call::' || event_type || ' rid=' || {_RID}
  || ' payload=' || '{{"p":' || props || ',"user":{{"id":' || user_id::VARCHAR || ',"tags":["' || event_type || '",' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',null]}}}}' AS line FROM events)"""
LINES = "lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
#: distinct tokens of packets of eight documents, blocks of eight packets
PACKED = LINES + ",\npacked AS (SELECT *, doc_id // 8 AS packet_id, doc_id // 64 AS block_id FROM lines)"
TOKENS = PACKED + f",\ntokens AS (SELECT DISTINCT block_id, packet_id, unnest(regexp_extract_all(lower(line), '{T.TOKEN_A}')) AS token FROM packed)"


def _trace(spark: SparkSession, d: str) -> DataFrame:
    return S.trace_lines(S.table(spark, d, "events"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.document_lines(S.table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return index.packets(_lines(spark, d), 8, 8, "doc_id")


_CONTEXTS: dict[tuple[str, str], index.Context] = {}


def _context(spark: SparkSession, d: str) -> index.Context:
    """The packed lines and their index, written by the first query of the application that needs them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = index.Context.of(_packed(spark, d))
    return _CONTEXTS[key]


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return M.match(_trace(spark, d), BANK)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- traces ---------------------------------------------------------------------------------------

@query("trace_parse", f"""WITH {TRACE} SELECT line_no, 'bracket' AS ts_style, strftime(strptime(regexp_extract(line, '^\\[([^\\]]+)\\+00:00\\]', 1), '%Y-%m-%dT%H:%M:%S.%g'), '%Y-%m-%d %H:%M:%S.%g') AS ts_text,
  regexp_extract(line, 'tool_call::([^ ]+) ', 1) AS tool, upper(replace(regexp_extract(line, 'rid=([^ ]+) ', 1), '-', '')) AS rid_hex, regexp_extract(line, 'payload=(.*)$', 1) AS payload FROM trace""")
def trace_parse(spark, d):
    """Lines split into time, tool, request id and payload; the id through its 16 bytes and back."""
    p = trace.parse(_trace(spark, d))
    return p.select("line_no", "ts_style", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts_text"), "tool", F.hex(F.unhex(F.replace("rid", F.lit("-"), F.lit("")))).alias("rid_hex"), "payload")


def _structured(name: str, keywords: list[str], mode: str, where: str) -> None:
    sql = f"""WITH {TRACE}, p AS (SELECT *, regexp_extract(line, 'tool_call::([^ ]+) ', 1) AS tool, regexp_extract(line, 'payload=(.*)$', 1)::JSON AS j FROM trace)
SELECT line_no, line FROM p WHERE {where}"""
    query(name, sql)(lambda spark, d: search.search(_trace(spark, d), keywords, mode))


_structured("trace_structured_kv_num", ["tool:error", "n:p.k=69"], "and", "tool = 'error' AND json_extract_string(j, '$.p.k') = '69'")
_structured("trace_tool_filter", ["tool:Purchase"], "and", "tool = 'purchase'")
_structured("trace_key_exists", ["k:user.tags[2]", "kv:user.id=8"], "and", "json_extract_string(j, '$.user.id') = '8'")
_structured("trace_inner_key_is_no_leaf", ["k:user.tags", "tool:click"], "or", "tool = 'click'")
_structured("trace_value_eq", ["v:SIGNUP"], "and", "tool = 'signup'")
_structured("trace_bool_leaf", ["kv:user.tags[1]=true", "n:user.tags[1]=1", "tool:view"], "and", "tool = 'view' AND line_no % 2 = 0")
_structured("trace_null_leaf", ["kv:user.tags[2]=none", "kv:p.k=7"], "and", "json_extract_string(j, '$.p.k') = '7'")
_structured("trace_bool_or", ["tool:error", "tool:signup", "n:p.k=5.0"], "or", "tool IN ('error', 'signup') OR json_extract_string(j, '$.p.k') = '5'")
_structured("trace_mixed_and", ["tool:click", "payloads", "tags"], "and", "tool = 'click' AND contains(line, 'paylo') AND contains(line, 'tag')")


@query("payload_leaves", f"""WITH {TRACE}, p AS (SELECT line_no, regexp_extract(line, 'payload=(.*)$', 1)::JSON AS j FROM trace)
SELECT line_no, 'p.k' AS path, 'num' AS kind, json_extract_string(j, '$.p.k') AS text FROM p
UNION ALL SELECT line_no, 'user.id', 'num', json_extract_string(j, '$.user.id') FROM p
UNION ALL SELECT line_no, 'user.tags[0]', 'str', json_extract_string(j, '$.user.tags[0]') FROM p
UNION ALL SELECT line_no, 'user.tags[1]', 'bool', CASE WHEN line_no % 2 = 0 THEN 'true' ELSE 'false' END FROM p
UNION ALL SELECT line_no, 'user.tags[2]', 'null', 'none' FROM p""")
def payload_leaves(spark, d):
    """JSON payloads flattened to leaves."""
    return trace.payload_leaves(_trace(spark, d))


@query("tool_index", f"""WITH {TRACE} SELECT regexp_extract(line, 'tool_call::([^ ]+) ', 1) AS tool, count(*) AS n_lines, count(DISTINCT line_no // 60) AS n_packets, min(line_no // 60) AS first_packet FROM trace GROUP BY 1""")
def tool_index(spark, d):
    return index.tool_index(index.packets(_trace(spark, d)))


@query("topk_json_keys", f"""WITH {TRACE} SELECT key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_extract(line, 'payload=(.*)$', 1), '"([^"\\\\]+)"\\s*:', 1)) AS key FROM trace) GROUP BY key ORDER BY n DESC, key LIMIT 4""")
def topk_json_keys(spark, d):
    return encode.json_keys(_trace(spark, d).withColumn("payload", trace.loose_payload(F.col("line"))), "payload", 4)


@query("json_token_substitution", "SELECT count(*) AS n, count(*) AS n_equal, true AS shorter FROM events")
def json_token_substitution(spark, d):
    """Frequent keys replaced by numbers, and back."""
    lines = _trace(spark, d).withColumn("payload", trace.loose_payload(F.col("line")))
    keys = [r["key"] for r in encode.json_keys(lines, "payload", 256).collect()]
    packed = lines.withColumn("packed", encode.substitute(F.col("payload"), keys)).withColumn("back", encode.unsubstitute(F.col("packed"), keys))
    return packed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("back") == F.col("payload")).alias("n_equal"), (F.sum(F.length("packed")) < F.sum(F.length("payload"))).alias("shorter"))


# --- keyword search -------------------------------------------------------------------------------

def _keyword(name: str, terms: list[str], mode: str) -> None:
    test = (" AND " if mode == "and" else " OR ").join(f"contains(lower(line), '{t.lower()}')" for t in terms)
    sql = f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE {test}"
    query(name, sql)(lambda spark, d: search.keywords(_lines(spark, d), terms, mode))
    query(name.replace("keyword_", "keyword_indexed_"), sql)(lambda spark, d: _context(spark, d).hits(terms, mode).select("doc_id", "line_no", "line"))


@query("index_build", f"WITH {TOKENS} SELECT (SELECT count(*) FROM lines) AS n_lines, count(*) AS n_tokens, count(DISTINCT (block_id, token)) AS n_block_tokens FROM tokens")
def index_build(spark, d):
    """The written lines and indexes that the searches below read, built anew."""
    c = index.Context.of(_packed(spark, d))
    n = [x.agg(F.count(F.lit(1)).alias(name)) for x, name in ((c.lines, "n_lines"), (c.tokens, "n_tokens"), (c.blocks, "n_block_tokens"))]
    return n[0].crossJoin(n[1]).crossJoin(n[2])  # one row each


_keyword("keyword_all", ["eation", "thand"], "and")
_keyword("keyword_any", ["licensed", "token", "password"], "or")
_keyword("keyword_phrase", ["of the"], "and")
_keyword("keyword_part_word", ["cense", "pache"], "and")
_keyword("keyword_unicode", ["é", "tion"], "and")


def _stem_sql(words: list[str], mode: str) -> str:
    each = ["(" + " OR ".join(f"contains(lower(line), '{t}')" for t in T.match_terms(w)) + ")" for w in words]
    return f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE " + (" AND " if mode == "and" else " OR ").join(each)


@query("keyword_stem_prefix", _stem_sql(["Licensing", "versions"], "and"))
def keyword_stem_prefix(spark, d):
    return search.search(_lines(spark, d), ["Licensing", "versions"], "and")


@query("stem_terms", f"""WITH {LINES}, w AS (SELECT unnest(regexp_extract_all(lower(line), '{T.TOKEN_B}')) AS w FROM lines),
s AS (SELECT w, CASE WHEN length(w) <= 3 THEN w WHEN ends_with(w, 'ing') AND length(w) > 5 THEN left(w, length(w) - 3) WHEN ends_with(w, 'ed') AND length(w) > 4 THEN left(w, length(w) - 2)
  WHEN ends_with(w, 'es') AND length(w) > 4 THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS stem FROM w)
SELECT stem, count(*) AS n, count(DISTINCT w) AS n_words FROM s GROUP BY stem""")
def stem_terms(spark, d):
    words = _lines(spark, d).select(F.explode(T.tokens_b(F.col("line"))).alias("w"))
    return words.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("w").alias("n_words"))


@query("token_df", f"WITH {TOKENS} SELECT token, count(DISTINCT packet_id) AS df FROM tokens GROUP BY token")
def token_df(spark, d):
    return index.token_df(index.token_index(_packed(spark, d)))


@query("token_df_block", f"WITH {TOKENS} SELECT token, count(DISTINCT block_id) AS df FROM tokens GROUP BY token")
def token_df_block(spark, d):
    return index.token_df(index.token_index(_packed(spark, d), ["block_id"]))


@query("keyword_units_and", f"""WITH {PACKED}, w AS (SELECT DISTINCT packet_id, unnest(regexp_extract_all(lower(line), '{T.TOKEN_B}')) AS w FROM packed)
SELECT packet_id FROM w GROUP BY packet_id HAVING bool_or(w = 'licensed' OR w = 'licens' OR left(w, 5) = 'licen') AND bool_or(w = 'the')""")
def keyword_units_and(spark, d):
    """Packets that hold an entry of every keyword: words, stems, marked prefixes."""
    return index.keyword_units(index.keyword_index(_packed(spark, d)), ["licensed", "the"], "and")


_SELECT = "count(DISTINCT {u}) AS n_units, count(*) AS n_lines, count(DISTINCT {u}) FILTER (WHERE {u} IN (SELECT {u} FROM kept)) AS n_selected, count(*) FILTER (WHERE {u} IN (SELECT {u} FROM kept)) AS n_read FROM packed"


def _selectivity(name: str, unit: str) -> None:
    sql = f"WITH {TOKENS}, kept AS (SELECT {unit} FROM tokens GROUP BY {unit} HAVING bool_or(contains(token, 'apach')) AND bool_or(contains(token, 'version'))) SELECT " + _SELECT.format(u=unit)

    def run(spark, d):
        p = _packed(spark, d)
        return reports.selectivity(p, search.pruned_units(index.token_index(p, [unit]), ["apach", "version"], "and", [unit]), unit)

    query(name, sql)(run)


_selectivity("packet_selectivity", "packet_id")
_selectivity("block_selectivity", "block_id")


@query("twolevel_select", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE contains(lower(line), 'apach') AND contains(lower(line), 'version')")
def twolevel_select(spark, d):
    """Blocks pruned, then packets in them, then lines tested."""
    return _context(spark, d).two_level(["apach", "version"]).select("doc_id", "line_no", "line")


@query("twolevel_unindexed", ORACLE_SQL["twolevel_select"])
def twolevel_unindexed(spark, d):
    """The same for one search, without a written index."""
    return index.two_level(_packed(spark, d), ["apach", "version"])[0].select("doc_id", "line_no", "line")


@query("twolevel_resolutions", ORACLE_SQL["twolevel_select"])
def twolevel_resolutions(spark, d):
    """Blocks that hold all terms, in them packets that hold any, then lines that hold all."""
    return _context(spark, d).two_level(["apach", "version"], packet_mode="or").select("doc_id", "line_no", "line")


@query("block_hits", f"WITH {PACKED} SELECT block_id, count(*) AS n_hits, min(line_no) AS first FROM packed WHERE contains(lower(line), 'apach') AND contains(lower(line), 'version') GROUP BY block_id")
def block_hits(spark, d):
    """Hits by block, of the blocks that the block index leaves."""
    return _context(spark, d).block_hits(["apach", "version"]).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("line_no").alias("first"))


@query("context_searches", f"WITH {PACKED} SELECT term, count(*) AS n FROM packed, (VALUES ('apach'), ('licen'), ('é')) AS t(term) WHERE contains(lower(line), term) GROUP BY term")
def context_searches(spark, d):
    """Several searches over one written index; a term outside the tokeniser's alphabet reads all."""
    c = _context(spark, d)
    hits = [c.two_level([t]).select(F.lit(t).alias("term")) for t in ("apach", "licen", "é")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("token_packets", f"WITH {TOKENS} SELECT DISTINCT packet_id FROM tokens WHERE token = 'licensed'")
def token_packets(spark, d):
    """Packets that hold a whole token, by equality."""
    return _context(spark, d).units_with("licensed")


@query("packet_range", f"WITH {TRACE} SELECT line_no // 60 AS packet_id, count(*) AS n, min(line_no) AS first, max(line_no) AS last FROM trace WHERE line_no // 60 BETWEEN 3 AND 6 GROUP BY 1")
def packet_range(spark, d):
    p = index.packet_range(index.packets(_trace(spark, d)), 3, 7)
    return p.groupBy("packet_id").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


@query("block_select", f"WITH {TRACE} SELECT line_no, line_no // 480 AS block_id FROM trace WHERE line_no // 480 IN (0, 2)")
def block_select(spark, d):
    return index.selected(index.packets(_trace(spark, d)), [0, 2], "block_id").select("line_no", "block_id")


@query("packet_select", f"WITH {TRACE} SELECT line_no, line_no // 60 AS packet_id FROM trace WHERE line_no // 60 IN (1, 5)")
def packet_select(spark, d):
    return index.selected(index.packets(_trace(spark, d)), [1, 5]).select("line_no", "packet_id")


@query("occurrence_count", f"WITH {LINES} SELECT sum((length(lower(line)) - length(replace(lower(line), 'the', ''))) // 3)::BIGINT AS n_occurrences, count(*) FILTER (WHERE contains(lower(line), 'the')) AS n_lines FROM lines")
def occurrence_count(spark, d):
    return reports.occurrences(_lines(spark, d), "The")


@query("probe_token", f"""WITH {LINES} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(line), '[a-z_]{{4,}}')) AS word FROM lines)
WHERE word NOT IN ({', '.join(f"'{w}'" for w in reports.STOP)}) GROUP BY word ORDER BY n DESC, word LIMIT 1""")
def probe_token(spark, d):
    return reports.probe_words(_lines(spark, d)).limit(1)


@query("display_hits", f"WITH {LINES} SELECT doc_id, line_no, left(line, 200) AS shown FROM lines WHERE contains(lower(line), 'tion') ORDER BY doc_id, line_no LIMIT 10")
def display_hits(spark, d):
    """The first ten hits, at most 200 characters each (a display)."""
    return search.keywords(_lines(spark, d), ["tion"]).orderBy("doc_id", "line_no").limit(10).select("doc_id", "line_no", F.left("line", F.lit(200)).alias("shown"))


# --- templates ------------------------------------------------------------------------------------

def _quote(s: str) -> str:
    return re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", s).replace("'", "''")


def _case(then: Callable[[M.Template, str], str], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{t.pattern(_quote, '$')}') THEN {then(t, t.pattern(_quote, '$'))}" for t in BANK) + f" ELSE {default} END"


MATCHED = TRACE + ",\nmatched AS (SELECT *, " + _case(lambda t, p: str(t.event_id)) + " AS event_id FROM trace)"


@query("template_bank", "SELECT * FROM (VALUES " + ", ".join(f"({t.event_id}::BIGINT, {t.n_params}, '{t.anchor.replace(chr(39), chr(39) * 2)}', {i})" for i, t in enumerate(BANK)) + ") AS t(event_id, n_params, anchor, prio)")
def template_bank(spark, d):
    return M.bank_table(spark, BANK).select("event_id", "n_params", "anchor", "prio")


def _param(i: int) -> str:
    return _case(lambda t, p: f"regexp_extract(line, '{p}', {i})" if i <= t.n_params else "NULL")


@query("template_match", f"WITH {TRACE} SELECT line_no, ({_case(lambda t, p: str(t.event_id))})::BIGINT AS event_id, {_param(1)} AS p1, {_param(2)} AS p2, {_param(3)} AS p3, {_param(4)} AS p4 FROM trace")
def template_match(spark, d):
    return _matched(spark, d).select("line_no", "event_id", *[F.get("params", F.lit(i)).alias(f"p{i + 1}") for i in range(4)])


@query("template_match_batches", ORACLE_SQL["template_match"])
def template_match_batches(spark, d):
    """The same through Arrow batches, the way of large banks."""
    return M._match_batches(_trace(spark, d), BANK, "line").select("line_no", "event_id", *[F.get("params", F.lit(i)).alias(f"p{i + 1}") for i in range(4)])


@query("template_coverage", f"WITH {MATCHED} SELECT count(*) AS n_lines, count(event_id) AS n_known, count(*) - count(event_id) AS n_unknown FROM matched")
def template_coverage(spark, d):
    return M.coverage(_matched(spark, d))


@query("event_recall", f"WITH {MATCHED} SELECT line_no, line FROM matched WHERE event_id = 3")
def event_recall(spark, d):
    return M.recall(_matched(spark, d), 3).select("line_no", "line")


@query("packet_event_set", f"WITH {MATCHED} SELECT line_no // 60 AS packet_id, event_id::BIGINT AS event_id, count(*) AS n FROM matched WHERE event_id IS NOT NULL GROUP BY 1, 2")
def packet_event_set(spark, d):
    return index.event_sets(index.packets(_matched(spark, d)))


@query("fast_candidates", "SELECT * FROM (VALUES (0::BIGINT, 2::BIGINT), (1, 9), (2, 4), (3, 3), (4, 1)) AS t(rank, event_id)")
def fast_candidates(spark, d):
    found = M.candidates(BANK, 'tool_call::error "k" payload')
    return spark.createDataFrame(list(enumerate(found)), "rank long, event_id long")


@query("candidate_lines", f"WITH {MATCHED} SELECT event_id::BIGINT AS event_id, CASE event_id WHEN 2 THEN 0 WHEN 9 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 ELSE 4 END::BIGINT AS rank, count(*) AS n FROM matched WHERE event_id IS NOT NULL GROUP BY 1, 2")
def candidate_lines(spark, d):
    """Lines of each candidate event, with its rank."""
    ranks = spark.createDataFrame(list(enumerate(M.candidates(BANK, 'tool_call::error "k" payload'))), "rank long, event_id long")
    return _matched(spark, d).join(F.broadcast(ranks), "event_id").groupBy("event_id", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("literal_parameters", f"WITH {TRACE} SELECT line_no, {_param(1)} AS p1, {_param(2)} AS p2, {_param(3)} AS p3, {_param(4)} AS p4 FROM trace WHERE {_case(lambda t, p: 'true', 'false')}")
def literal_parameters(spark, d):
    """Parameters found by the literals of the line's template in turn."""
    texts = F.broadcast(M.bank_table(spark, BANK).select(F.col("prio").alias("tpl"), F.regexp_replace("template", r"\[\*\]", mine.ANY).alias("template")))  # a bank is a file of the driver's
    found = _matched(spark, d).join(texts, "tpl").withColumn("found", mine.extracted("line", "template"))
    return found.select("line_no", *[F.get("found", F.lit(i)).alias(f"p{i + 1}") for i in range(4)])


@query("fast_search", f"WITH {MATCHED} SELECT line_no, event_id::BIGINT AS event_id FROM matched WHERE event_id IS NOT NULL AND contains(line, 'true') AND contains(line, 'payload')")
def fast_search(spark, d):
    return M.fast_search(_matched(spark, d), BANK, "payload true").select("line_no", "event_id")


@query("route_search", f"WITH {MATCHED} SELECT line_no, event_id::BIGINT AS event_id, event_id IS NOT NULL AND event_id = 4 AS fast FROM matched WHERE contains(line, 'sign')")
def route_search(spark, d):
    """Known and unknown lines in one plan."""
    return M.route(_matched(spark, d), BANK, "sign").select("line_no", "event_id", "fast")


@query("decode_scan", f"WITH {TRACE} SELECT line_no FROM trace WHERE contains(lower(line), '::view rid=0')")
def decode_scan(spark, d):
    """Whole-string substring over restored lines, unknown ones included."""
    m = M.render(_matched(spark, d), BANK).withColumn("line", F.coalesce("rendered", "line"))
    return search.keywords(m, ["::VIEW rid=0"]).select("line_no")


@query("render_roundtrip", f"WITH {MATCHED} SELECT count(*) AS n, 0::BIGINT AS n_different, count(*) - count(event_id) AS n_raw FROM matched")
def render_roundtrip(spark, d):
    m = M.render(_matched(spark, d), BANK)
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("rendered", "line") != F.col("line")).alias("n_different"), F.count_if(F.col("event_id").isNull()).alias("n_raw"))


@query("drain_templates")
def drain_templates(spark, d):
    """Templates mined from the trace lines (no SQL: the tree depends on the order of lines)."""
    return mine.mine(_trace(spark, d), ["line_no"]).select("template", "n_lines", F.get("first", F.lit(0)).alias("first"))


# --- canonical forms and templates of numbers -------------------------------------------------------

_LOSSY = "line"
for _p, _t in ((T.TIMESTAMP, "<TS>"), (T.UUID, "<UUID>"), (T.HEX, "<HEX>"), (T.INT, "<INT>")):
    _LOSSY = f"regexp_replace({_LOSSY}, '{_p}', '{_t}', 'g')"


@query("canon_lossy", f"WITH {TRACE} SELECT line_no, trim(regexp_replace({_LOSSY}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS canon FROM trace")
def canon_lossy(spark, d):
    return _trace(spark, d).select("line_no", T.canonical_lossy(F.col("line")).alias("canon"))


@query("canon_tokens", f"WITH {LINES} SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '{T.CANONICAL}')) AS token FROM lines) GROUP BY token")
def canon_tokens(spark, d):
    return _lines(spark, d).select(F.explode(T.canonical_tokens(F.col("line"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("canon_token_kinds", f"""WITH {TRACE}, t AS (SELECT unnest(regexp_extract_all(line, '{T.CANONICAL}')) AS token FROM trace)
SELECT CASE WHEN contains(token, ':') THEN 'ts' WHEN length(token) = 36 THEN 'uuid' WHEN length(token) >= 16 THEN 'hex' ELSE 'int' END AS kind, count(*) AS n, sum(length(token))::BIGINT AS chars FROM t GROUP BY 1""")
def canon_token_kinds(spark, d):
    t = _trace(spark, d).select(F.explode(T.canonical_tokens(F.col("line"))).alias("token"))
    return t.groupBy(T.token_kind(F.col("token")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).cast("long").alias("chars"))


@query("canon_roundtrip", f"WITH {LINES} SELECT (SELECT count(*) FROM lines) + (SELECT count(*) FROM events) AS n, 0::BIGINT AS n_different")
def canon_roundtrip(spark, d):
    """Marked text and tokens give the lines back."""
    every = _lines(spark, d).select("line").unionByName(_trace(spark, d).select("line"))
    back = T.refill(T.canonical_text(F.col("line")), T.canonical_tokens(F.col("line")))
    return every.agg(F.count(F.lit(1)).alias("n"), F.count_if(back != F.col("line")).alias("n_different"))


@query("lossless_tokens", f"WITH {LINES} SELECT count(*) AS n, 0::BIGINT AS n_different FROM lines")
def lossless_tokens(spark, d):
    return _lines(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_join(T.tokens_c(F.col("line")), "") != F.col("line")).alias("n_different"))


@query("numeric_template", "SELECT template, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(c_name || ' ID=' || c_nationkey || ' variant=' || left(c_mktsegment, 1) || ' at ' || c_nationkey, '(LOOP=|ID=|STEP=|ROUND=|EPOCH=)[0-9]+', '\\1{}', 'g'), '(variant=)[A-Za-z]', '\\1{}', 'g'), '[0-9]{3,}', '{}', 'g') AS template FROM customer) GROUP BY template")
def numeric_template(spark, d):
    """Keyed numbers, variants and long numbers out of generated lines."""
    c = S.table(spark, d, "customer")
    line = F.concat(F.col("c_name"), F.lit(" ID="), F.col("c_nationkey").cast("string"), F.lit(" variant="), F.left("c_mktsegment", F.lit(1)), F.lit(" at "), F.col("c_nationkey").cast("string"))
    return c.groupBy(T.keyed_template(line).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("number_template", f"WITH {TRACE} SELECT template, count(*) AS n, min(line_no) AS first FROM (SELECT line_no, regexp_replace(regexp_replace(line, '(variant=)[A-Za-z]', '\\1{{}}', 'g'), '[0-9]+', '{{}}', 'g') AS template FROM trace) GROUP BY template")
def number_template(spark, d):
    return _trace(spark, d).groupBy(T.number_template(F.col("line")).alias("template")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))


@query("signed_template", "SELECT p_partkey, regexp_replace('size ' || (p_size - 25) || ' of ' || p_name, '-?[0-9]+', '{}', 'g') AS template, array_to_string(regexp_extract_all('size ' || (p_size - 25) || ' of ' || p_name, '-?[0-9]+'), ',') AS vals FROM part")
def signed_template(spark, d):
    line = F.concat(F.lit("size "), (F.col("p_size") - 25).cast("string"), F.lit(" of "), F.col("p_name"))
    return S.table(spark, d, "part").select("p_partkey", T.signed_template(line).alias("template"), F.array_join(T.signed_numbers(line), ",").alias("vals"))


@query("typed_values", """WITH t AS (SELECT event_id, event_type, user_id, ts FROM events),
v AS (SELECT 'time' AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS text FROM t UNION ALL SELECT 'kv', 'st=ok' FROM t UNION ALL SELECT 'int', user_id::VARCHAR FROM t
  UNION ALL SELECT 'hex', '0x' || lower(to_hex(event_id)) FROM t UNION ALL SELECT 'float', (event_id % 100)::VARCHAR || '.25' FROM t)
SELECT kind, count(*) AS n, count(DISTINCT text) AS n_distinct FROM v GROUP BY kind""")
def typed_values(spark, d):
    """Typed values of generated lines: times, key=value, numbers, hex, floats."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" st=ok user "), F.col("user_id").cast("string"), F.lit(" at 0x"), F.lower(F.hex("event_id")), F.lit(" load "), (F.col("event_id") % 100).cast("string"), F.lit(".25 end"))
    v = S.table(spark, d, "events").select(F.explode(T.typed_values(line)).alias("v"))
    return v.groupBy("v.kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v.text").alias("n_distinct"))


@query("typed_roundtrip", "SELECT count(*) AS n, 0::BIGINT AS n_different FROM events")
def typed_roundtrip(spark, d):
    """Typed values put back into their template."""
    lines = _trace(spark, d)
    back = T.typed_refill(T.typed_template(F.col("line")), T.typed_values(F.col("line")))
    return lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.contains("line", F.lit("{}")) & (back != F.col("line"))).alias("n_different"))


# --- encodings ------------------------------------------------------------------------------------

CHANNELS = MATCHED + ",\nchan AS (" + " UNION ALL ".join(f"SELECT line_no, event_id::BIGINT AS event_id, {i} AS channel, {_param(i + 1)} AS value FROM matched" for i in range(5)) + "),\nvals AS (SELECT * FROM chan WHERE value IS NOT NULL)"


@query("channel_types", f"""WITH {CHANNELS}, v AS (SELECT *, CASE WHEN value <> '' THEN value END AS v FROM vals)
SELECT event_id, channel, count(v) AS n, count(DISTINCT v) AS n_distinct, CASE WHEN count(v) = 0 THEN 'raw' WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]+$')) THEN 'int'
  WHEN bool_and(regexp_matches(v, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$')) THEN 'ip' WHEN bool_and(regexp_matches(v, '^(0x)?[0-9a-fA-F]{{6,}}$')) THEN 'hex'
  WHEN count(v) - count(DISTINCT v) >= 12 THEN 'dict' ELSE 'raw' END AS kind FROM v GROUP BY event_id, channel""")
def channel_types(spark, d):
    return encode.channel_types(encode.channels(_matched(spark, d), ["line_no"]))


@query("slot_types", f"WITH {CHANNELS} SELECT event_id, channel, count(try_cast(value AS BIGINT)) AS n_int, count(*) AS n, CASE WHEN count(try_cast(value AS BIGINT)) >= 50 THEN 'int' ELSE 'dict' END AS kind FROM vals GROUP BY event_id, channel")
def slot_types(spark, d):
    return encode.slot_types(encode.channels(_matched(spark, d), ["line_no"]))


@query("channel_codec", f"WITH {CHANNELS} SELECT line_no, event_id, channel, value FROM vals")
def channel_codec(spark, d):
    """Parameters in the short form of their channel's type, and back."""
    found = encode.channels(_matched(spark, d), ["line_no"])
    typed = encode.typed_channels(found, encode.channel_types(found), sum(t.n_params for t in BANK))
    return typed.withColumn("value", encode.untyped(typed)).select("line_no", "event_id", "channel", "value")


@query("dict_channel", f"""WITH {CHANNELS}, g AS (SELECT channel, value, count(*) AS n, min(line_no) AS first FROM vals WHERE event_id = 2 AND channel IN (2, 3) GROUP BY channel, value)
SELECT channel, value, n, row_number() OVER (PARTITION BY channel ORDER BY n DESC, first) - 1 AS code FROM g""")
def dict_channel(spark, d):
    """Codes by frequency, without a cap."""
    c = encode.channels(_matched(spark, d), ["line_no"]).where("event_id = 2 AND channel IN (2, 3)")
    return encode.dictionary_by_count(c, "value", ["line_no"], "channel")


@query("dict_encode_lines", f"WITH {LINES}, f AS (SELECT line, min((doc_id, line_no)) AS first, count(*) AS n FROM lines GROUP BY line) SELECT line, row_number() OVER (ORDER BY first) - 1 AS id, n FROM f")
def dict_encode_lines(spark, d):
    """Dense line ids in order of first appearance."""
    return encode.dictionary(_lines(spark, d), "line", ["doc_id", "line_no"]).select("line", "id", "n")


@query("dict_encode_tokens", f"""WITH {TRACE}, t AS (SELECT line_no, unnest(range(len(regexp_extract_all(lower(line), '{T.TOKEN_A}')))) AS k, unnest(regexp_extract_all(lower(line), '{T.TOKEN_A}')) AS token FROM trace),
f AS (SELECT token, min((line_no, k)) AS first, count(*) AS n FROM t GROUP BY token) SELECT token, row_number() OVER (ORDER BY first) - 1 AS id, n FROM f""")
def dict_encode_tokens(spark, d):
    t = _trace(spark, d).select("line_no", F.posexplode(T.tokens_a(F.col("line"))).alias("k", "token"))
    return encode.dictionary(t, "token", ["line_no", "k"]).select("token", "id", "n")


_K = "SELECT event_id AS line_no, event_type AS template, json_extract_string(props, '$.k')::BIGINT AS value FROM events"


def _slots(spark, d):
    e = S.table(spark, d, "events")
    return e.select(F.col("event_id").alias("line_no"), F.col("event_type").alias("template"), F.get_json_object("props", "$.k").cast("long").alias("value"))


@query("delta_zigzag", f"WITH v AS ({_K}), x AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY template ORDER BY line_no), 0) AS delta FROM v) SELECT line_no, template, delta, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS zigzag FROM x")
def delta_zigzag(spark, d):
    return encode.deltas(_slots(spark, d), "value", ["template"], ["line_no"]).select("line_no", "template", "delta", N.zigzag(F.col("delta")).alias("zigzag"))


@query("delta_restore", f"SELECT count(*) AS n, 0::BIGINT AS n_different FROM ({_K})")
def delta_restore(spark, d):
    x = encode.deltas(_slots(spark, d), "value", ["template"], ["line_no"])
    back = encode.restore(x.withColumn("step", N.unzigzag(N.zigzag(F.col("delta")))), "step", ["template"], ["line_no"])
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("restored") != F.col("value")).alias("n_different"))


_BYTES = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END::BIGINT"


@query("adaptive_delta", f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey AS value FROM lineitem),
x AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, value), 0) AS delta FROM v),
z AS (SELECT *, {_BYTES.format('(2 * value)')} AS abs_bytes, {_BYTES.format('(CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END)')} AS delta_bytes FROM x)
SELECT CASE WHEN delta_bytes < abs_bytes THEN 'delta' ELSE 'abs' END AS choice, count(*) AS n, sum(abs_bytes)::BIGINT AS abs_bytes, sum(delta_bytes)::BIGINT AS delta_bytes FROM z GROUP BY 1""")
def adaptive_delta(spark, d):
    """The shorter of value and delta, by bytes of its variable-length form."""
    v = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("value"))
    x = encode.adaptive(v, "value", ["l_orderkey"], ["l_linenumber", "value"])
    return x.groupBy("choice").agg(F.count(F.lit(1)).alias("n"), F.sum("abs_bytes").alias("abs_bytes"), F.sum("delta_bytes").alias("delta_bytes"))


@query("slot_choice", f"""WITH v AS (SELECT l_orderkey // 256 AS packet, l_returnflag AS template, l_orderkey, l_linenumber, unnest([0, 1, 2]) AS slot, unnest([l_partkey, l_suppkey, l_quantity::BIGINT]) AS value FROM lineitem),
x AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY packet, template, slot ORDER BY l_orderkey, l_linenumber, value), 0) AS delta FROM v),
z AS (SELECT *, {_BYTES.format('(2 * value)')} AS a, {_BYTES.format('(CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END)')} AS b FROM x)
SELECT packet, template, slot, count(*) AS n, sum(a)::BIGINT AS abs_bytes, sum(b)::BIGINT AS delta_bytes, CASE WHEN sum(b) < sum(a) THEN 'delta' ELSE 'abs' END AS choice FROM z GROUP BY packet, template, slot""")
def slot_choice(spark, d):
    """For each slot of each packet's templates the shorter of values and deltas."""
    slots = F.posexplode(F.array("l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))).alias("slot", "value")
    v = S.table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 256).alias("packet"), F.col("l_returnflag").alias("template"), "l_orderkey", "l_linenumber", slots)
    return encode.slot_choice(v, "value", ["packet", "template", "slot"], ["l_orderkey", "l_linenumber", "value"])


@query("rle_runs", """WITH v AS (SELECT user_id % 8 AS stream, event_id, event_type FROM events), c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM v WINDOW w AS (PARTITION BY stream ORDER BY event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY event_id) AS run FROM c) SELECT stream, run::BIGINT AS run, min(event_type) AS value, count(*) AS length, min(event_id) AS first FROM r GROUP BY stream, run""")
def rle_runs(spark, d):
    v = S.table(spark, d, "events").select((F.col("user_id") % 8).alias("stream"), "event_id", "event_type")
    return encode.runs(v, "event_type", ["stream"], ["event_id"])


@query("mtf_positions", """WITH v AS (SELECT user_id % 64 AS stream, event_id, event_type FROM events),
p AS (SELECT a.stream, a.event_id, max(b.event_id) AS before FROM v a LEFT JOIN v b ON a.stream = b.stream AND a.event_type = b.event_type AND b.event_id < a.event_id GROUP BY a.stream, a.event_id)
SELECT p.stream, p.event_id, count(DISTINCT v.event_type) AS position FROM p LEFT JOIN v ON v.stream = p.stream AND v.event_id < p.event_id AND v.event_id > coalesce(p.before, -1) GROUP BY p.stream, p.event_id""")
def mtf_positions(spark, d):
    """Move-to-front positions of symbols in streams."""
    v = S.table(spark, d, "events").select((F.col("user_id") % 64).alias("stream"), "event_id", "event_type")
    return encode.move_to_front(v, "event_type", "stream", "event_id").select("stream", "event_id", "position")


@query("front_bits", """WITH v AS (SELECT event_id // 64 AS packet, event_id, event_type FROM events),
p AS (SELECT a.packet, a.event_id, max(b.event_id) AS before FROM v a LEFT JOIN v b ON a.packet = b.packet AND a.event_type = b.event_type AND b.event_id < a.event_id GROUP BY a.packet, a.event_id),
m AS (SELECT p.packet, p.event_id, count(DISTINCT v.event_type) AS position FROM p LEFT JOIN v ON v.packet = p.packet AND v.event_id < p.event_id AND v.event_id > coalesce(p.before, -1) GROUP BY p.packet, p.event_id)
SELECT packet, count(*) AS n, max(position) AS largest, greatest(1, length(bin(max(position))))::BIGINT AS bits, ceil(count(*) * greatest(1, length(bin(max(position)))) / 8.0)::BIGINT AS packed_bytes FROM m GROUP BY packet""")
def front_bits(spark, d):
    """Move-to-front positions of each packet at a fixed width."""
    v = S.table(spark, d, "events").select(F.floor(F.col("event_id") / 64).alias("packet"), "event_id", "event_type")
    return encode.front_widths(v, "event_type", "packet", "event_id")


@query("bit_widths", f"WITH v AS ({_K}), g AS (SELECT template, count(*) AS n, max(value) AS largest FROM v GROUP BY template) SELECT template, n, largest, greatest(1, length(bin(largest)))::BIGINT AS bits, ceil(n * greatest(1, length(bin(largest))) / 8.0)::BIGINT AS packed_bytes FROM g")
def bit_widths(spark, d):
    return encode.bit_widths(_slots(spark, d), "value", ["template"])


@query("huffman_lengths", """WITH RECURSIVE c AS (SELECT event_type AS s, count(*) AS n FROM events GROUP BY 1),
h(q, used) AS (SELECT list_sort(list({'n': n, 's': s, 'm': [s]})), []::VARCHAR[] FROM c
  UNION ALL SELECT list_sort(list_append(q[3:], {'n': q[1].n + q[2].n, 's': q[1].s, 'm': list_concat(q[1].m, q[2].m)})), list_concat(used, list_concat(q[1].m, q[2].m)) FROM h WHERE len(q) > 1),
l AS (SELECT s, n, greatest(1, len(list_filter(used, lambda x: x = s)))::INTEGER AS bits FROM c, h WHERE len(q) = 1),
k AS (SELECT *, (coalesce(sum(1::BIGINT << (40 - bits)) OVER (ORDER BY bits, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (40 - bits)) AS code FROM l)
SELECT s AS event_type, n, bits, lpad(bin(code), bits, '0') AS code FROM k""")
def huffman_lengths(spark, d):
    """Canonical Huffman codes of event types."""
    return encode.huffman(S.table(spark, d, "events"), "event_type")


@query("chunk_line_delta", """WITH l AS (SELECT doc_id, k // 4 AS c, k % 4 AS p, line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS line FROM documents)),
m AS (SELECT doc_id, max(c) AS last FROM l GROUP BY doc_id), b AS (SELECT l.doc_id, l.c + 1 AS c, l.p, l.line FROM l JOIN m USING (doc_id) WHERE l.c < m.last)
SELECT CASE WHEN b.line IS NULL THEN 'added' WHEN l.line IS NULL THEN 'removed' WHEN l.line = b.line THEN 'same' ELSE 'changed' END AS op, count(*) AS n
FROM l FULL JOIN b ON l.doc_id = b.doc_id AND l.c = b.c AND l.p = b.p GROUP BY 1""")
def chunk_line_delta(spark, d):
    """Chunks of four lines against the chunk before."""
    lines = _lines(spark, d).withColumn("chunk", F.floor(F.col("line_no") / 4)).withColumn("place", F.col("line_no") % 4)
    return encode.chunk_delta(lines, "chunk", "place", "line", ["doc_id"]).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("hybrid_mode", f"WITH {LINES}, t AS (SELECT *, regexp_replace(regexp_replace(line, '(variant=)[A-Za-z]', '\\1{{}}', 'g'), '[0-9]+', '{{}}', 'g') AS template FROM lines), c AS (SELECT template, count(*) AS n FROM t GROUP BY template) SELECT doc_id, line_no, CASE WHEN c.n > 1 THEN 'template' ELSE 'line' END AS mode FROM t JOIN c USING (template)")
def hybrid_mode(spark, d):
    return encode.hybrid(_lines(spark, d)).select("doc_id", "line_no", "mode")


@query("smallest_method", f"""WITH {LINES}, s AS (SELECT doc_id, 'lines' AS method, sum(length(line) + 1)::BIGINT AS size FROM lines GROUP BY doc_id
  UNION ALL SELECT doc_id, 'distinct', sum(length(line) + 1)::BIGINT + 2 * (SELECT count(*) FROM lines l WHERE l.doc_id = x.doc_id) FROM (SELECT DISTINCT doc_id, line FROM lines) x GROUP BY doc_id)
SELECT doc_id, method, size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, method) AS r FROM s) WHERE r = 1""")
def smallest_method(spark, d):
    """Per document the shorter of two encodings: all lines, or distinct lines with ids."""
    lines = _lines(spark, d)
    plain = lines.groupBy("doc_id").agg(F.sum(F.length("line") + 1).alias("size")).withColumn("method", F.lit("lines"))
    each = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg((F.sum(F.length("line") + 1) + 2 * F.sum("n")).alias("size")).withColumn("method", F.lit("distinct"))
    return encode.smallest(plain.unionByName(each), ["doc_id"])


def _form(name: str) -> None:
    sql = ORACLE_SQL["canon_lossy"].replace("AS canon", "AS line") if name == "lossy" else f"WITH {TRACE} SELECT line_no, line FROM trace"

    def run(spark, d):
        lines = index.packets(_trace(spark, d))
        return forms.decode(forms.encode(lines, None if name == "smallest" else name)).select("line_no", "line")

    run.__doc__ = f"Packets in the form {name}, and the lines out of them again."
    query(f"form_{name}", sql)(run)


for _name in (*forms.FORMS, "smallest"):
    _form(_name)


@query("form_sizes")
def form_sizes(spark, d):
    """Packets by the form that is the shortest of seven, with their bytes (no SQL: compressors)."""
    return forms.sizes(forms.encode(index.packets(_trace(spark, d))))


@query("trace_codec", f"WITH {TRACE} SELECT line_no, line, true AS coded FROM trace")
def trace_codec(spark, d):
    """Trace lines as typed columns, written, and the lines out of them again."""
    lines = _trace(spark, d)
    keys = [r["key"] for r in encode.json_keys(lines.withColumn("payload", trace.loose_payload(F.col("line"))), "payload", 256).collect()]
    stored = store.settled(trace.encode(lines, keys).withColumn("coded", F.col("raw").isNull()))
    return trace.decode(stored, keys).select("line_no", "line", "coded")


# --- memory ---------------------------------------------------------------------------------------

def _memory(spark, d):
    """Agent notes made of conversations: a marked header, a goal, turns as decisions and notes."""
    c = S.table(spark, d, "conversations")
    first = F.regexp_replace(F.substring_index("text", "\n", 1), "[\r\x85 ]", " ")
    lead = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Project: c"), F.col("conv_id").cast("string"), F.lit("\nGoal: answer\n"))).otherwise(F.lit(""))
    mark = F.when(F.col("role") == "assistant", "Decision: ").when(F.col("role") == "system", "Note: ").otherwise("")
    parts = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, first).alias("l")))).alias("t"))
    return parts.select("conv_id", F.concat(lead, F.array_join("t.l", "\n")).alias("text"))


MEMORY = """memory AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Project: c' || conv_id || chr(10) || 'Goal: answer' || chr(10) ELSE '' END ||
  string_agg(CASE role WHEN 'assistant' THEN 'Decision: ' WHEN 'system' THEN 'Note: ' ELSE '' END || split_part(text, chr(10), 1), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
ls AS (SELECT conv_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM memory),
sk AS (SELECT conv_id, any_value(text) AS text, coalesce(arg_min(l, k) FILTER (WHERE starts_with(l, 'Project:')), arg_min(l, k) FILTER (WHERE trim(l) <> ''), 'Chunk:') AS header,
  coalesce(arg_min(l, k) FILTER (WHERE starts_with(l, 'Goal:')), (list(l ORDER BY k) FILTER (WHERE trim(l) <> ''))[2], arg_min(l, k) FILTER (WHERE trim(l) <> ''), 'Chunk:') AS goal,
  coalesce(string_agg(trim(l), chr(10) ORDER BY k) FILTER (WHERE starts_with(trim(l), 'Decision:') OR starts_with(trim(l), 'Note:')), '') AS witness FROM ls GROUP BY conv_id)"""
_SPINE = "header || chr(10) || goal || CASE WHEN witness <> '' THEN chr(10) || witness ELSE '' END"


@query("memory_skeleton", f"WITH {MEMORY} SELECT conv_id, header, goal FROM sk")
def memory_skeleton(spark, d):
    return memory.packets(_memory(spark, d)).select("conv_id", "header", "goal")


@query("memory_witness", f"WITH {MEMORY} SELECT conv_id, witness FROM sk")
def memory_witness(spark, d):
    return memory.packets(_memory(spark, d)).select("conv_id", "witness")


@query("memory_checksum", f"WITH {MEMORY} SELECT conv_id, left(sha256({_SPINE}), 10) AS checksum, left(sha256({_SPINE}), 12) AS fingerprint FROM sk")
def memory_checksum(spark, d):
    return memory.packets(_memory(spark, d)).select("conv_id", "checksum", "fingerprint")


@query("memory_confidence", f"WITH {MEMORY} SELECT conv_id, CASE WHEN trim(header) <> '' AND trim(goal) <> '' THEN 70 ELSE 0 END AS confidence, CASE WHEN contains(text, 'Decision:') OR contains(text, 'Note:') THEN 80 ELSE 60 END AS needed FROM sk")
def memory_confidence(spark, d):
    p = memory.packets(_memory(spark, d), tier=0)
    return p.select("conv_id", F.round(F.col("confidence") * 100).cast("int").alias("confidence"), F.round(memory.needed(F.col("text")) * 100).cast("int").alias("needed"))


@query("tier_fallback", f"WITH {MEMORY} SELECT conv_id, CASE WHEN contains(text, 'Decision:') OR contains(text, 'Note:') THEN 3 ELSE 0 END AS tier FROM sk")
def tier_fallback(spark, d):
    return memory.packets(_memory(spark, d)).select("conv_id", memory.tier_for(F.col("text"), F.col("probe")).alias("tier"))


@query("memory_roundtrip", "SELECT count(DISTINCT conv_id) AS n, 0::BIGINT AS n_different FROM conversations")
def memory_roundtrip(spark, d):
    """Tier 3 packets give the text back."""
    p = memory.packets(_memory(spark, d)).withColumn("led", F.startswith("text", F.concat("header", F.lit("\n"), "goal", F.lit("\n"))))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(memory.restore(p) != F.col("text")).alias("n_different"))


@query("chunk_paragraphs", f"""WITH {LINES}, s AS (SELECT *, CASE WHEN trim(line) <> '' AND coalesce(trim(lag(line) OVER w) = '', false) THEN 1 ELSE 0 END AS st FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
c AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS chunk_id FROM s) SELECT doc_id, chunk_id::BIGINT AS chunk_id, count(*) AS n_lines, min(line_no) AS first FROM c GROUP BY doc_id, chunk_id""")
def chunk_paragraphs(spark, d):
    return memory.paragraphs(_lines(spark, d), ["doc_id"]).groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first"))


@query("chunk_lines", f"WITH {LINES} SELECT doc_id, line_no // 8 AS chunk_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY 1, 2")
def chunk_lines(spark, d):
    c = _lines(spark, d).withColumn("chunk_id", F.floor(F.col("line_no") / 8)).groupBy("doc_id", "chunk_id")
    return c.agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("t")).select("doc_id", "chunk_id", F.array_join("t.line", "\n").alias("text"))


@query("human_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.2f KB', round(n_chars / 1024.0, 2)) END AS size FROM documents")
def human_size(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.human_size(F.col("n_chars")).alias("size"))


# --- store, reports, streams ----------------------------------------------------------------------

def _store(kind: str):
    def run(spark, d):
        path = store.scratch_path(spark)
        store.write(_trace(spark, d), BANK, path, kind)
        back = store.read(spark, path).select("line_no", F.col("line").alias("restored"))
        met = _trace(spark, d).join(back, "line_no", "full")
        return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("line").eqNullSafe(F.col("restored"))).alias("n_different")).withColumn("kind", F.lit(store.kind_of(spark, path)))

    return run


for _kind in store.KINDS:
    query(f"store_roundtrip_{_kind}", f"SELECT count(*) AS n, 0::BIGINT AS n_different, '{_kind}' AS kind FROM events")(_store(_kind))


@query("store_indexed_search", f"WITH {TRACE} SELECT line_no, line FROM trace WHERE contains(line, 'rid=00') AND contains(line, 'view')")
def store_indexed_search(spark, d):
    """A store without an index gets one at the first search."""
    path = store.scratch_path(spark)
    store.write(_trace(spark, d), BANK, path)
    return search.indexed(store.read(spark, path), store.tokens(spark, path), ["rid=00", "view"]).hits.select("line_no", "line")


@query("store_unknown_lines", "SELECT count(*) AS n, count(*) AS n_raw, 0::BIGINT AS n_different, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS n_hits FROM events")
def store_unknown_lines(spark, d):
    """A store straight from a log, without templates, and a search by its index."""
    path = store.scratch_path(spark)
    store.write(_trace(spark, d), [], path, "hot")
    back = store.read(spark, path)
    hits = search.indexed(back, store.tokens(spark, path), ["tool_call::purchase"]).hits.agg(F.count(F.lit(1)).alias("n_hits"))
    met = _trace(spark, d).join(back.select("line_no", F.col("line").alias("restored"), "event_id"), "line_no", "full")
    found = met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id").isNull()).alias("n_raw"), F.count_if(~F.col("line").eqNullSafe(F.col("restored"))).alias("n_different"))
    return found.crossJoin(hits)  # one row each


@query("store_packet_range", f"WITH {TRACE} SELECT line_no, line FROM trace WHERE line_no // 60 BETWEEN 2 AND 3")
def store_packet_range(spark, d):
    path = store.scratch_path(spark)
    store.write(_trace(spark, d), BANK, path)
    return store.read_packets(spark, path, 2, 4).select("line_no", "line")


@query("commit_last", "SELECT seq, text_fingerprint, text FROM (SELECT conv_id * 1000 + turn AS seq, left(sha256(text), 12) AS text_fingerprint, text FROM conversations) ORDER BY seq DESC LIMIT 1")
def commit_last(spark, d):
    path = store.scratch_path(spark)
    c = S.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("1").alias("packet_version"), F.lit(3).alias("used_tier"), F.lit(0.95).alias("confidence"), "text")
    store.commit(spark, path, c.where("turn < 2"))
    store.commit(spark, path, c.where("turn >= 2"))
    return store.last_commit(spark.read.parquet(path)).select("seq", "text_fingerprint", "text")


@query("text_files", "SELECT row_number() OVER (ORDER BY f, k) - 1 AS line_no, line FROM (SELECT 0 AS f, r_regionkey AS k, r_name AS line FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)")
def text_files(spark, d):
    """Text files read in order of file and place."""
    path = store.scratch_path(spark)
    for name, table, key, line in (("b", "nation", "n_nationkey", "n_name"), ("a", "region", "r_regionkey", "r_name")):
        S.table(spark, d, table).repartition(1).sortWithinPartitions(key).select(line).write.text(f"{path}/{name}")
    return S.read_lines(spark, f"{path}/*")


@query("template_file", ORACLE_SQL["template_bank"])
def template_file(spark, d):
    """A template file, compiled."""
    path = store.scratch_path(spark)
    spark.createDataFrame(BANK_ROWS, "EventId string, EventTemplate string").coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return M.bank_table(spark, M.compile_bank(S.read_templates(spark, path))).select("event_id", "n_params", "anchor", "prio")


@query("manifest_sets", "SELECT 'nations' AS name, count(*) AS n_lines FROM nation UNION ALL SELECT 'regions', count(*) FROM region")
def manifest_sets(spark, d):
    """Data sets named in a manifest, each read from its log."""
    path = store.scratch_path(spark)
    rows = []
    for name, table, line in (("nations", "nation", "n_name"), ("regions", "region", "r_name")):
        S.table(spark, d, table).select(line).write.text(f"{path}/{name}")
        rows.append((name, f"{path}/{name}", ""))
    spark.createDataFrame(rows, "name string, log string, tpl string").coalesce(1).write.option("header", True).csv(f"{path}/manifest")
    sets = S.read_manifest(spark, f"{path}/manifest").collect()  # a manifest is a list of files
    counts = [S.read_lines(spark, r["log"]).agg(F.lit(r["name"]).alias("name"), F.count(F.lit(1)).alias("n_lines")) for r in sets]
    return counts[0].unionByName(counts[1])


@query("size_raw", f"WITH {TRACE} SELECT line_no // 4096 AS block_id, sum(length(line) + 1)::BIGINT - 1 AS raw_bytes FROM trace GROUP BY 1")
def size_raw(spark, d):
    """Bytes of the trace lines by blocks, as the size report counts them."""
    p = index.packets(_trace(spark, d), 4096, 1)
    return p.groupBy("block_id").agg((F.sum(F.octet_length("line") + 1) - 1).alias("raw_bytes"))


@query("size_report")
def size_report(spark, d):
    """Bytes of the trace lines under general compressors, by blocks (no SQL: compressors)."""
    return reports.compressed(index.packets(_trace(spark, d), 4096, 1), "block_id")


@query("trained_dictionary_report")
def trained_dictionary_report(spark, d):
    """Bytes of packets under zstd with a dictionary trained on the first packets (no SQL)."""
    return reports.trained(index.packets(_trace(spark, d)), "packet_id", 32)


@query("new_templates_per_window", f"WITH {TRACE}, t AS (SELECT min(line_no) // 60 AS w FROM (SELECT line_no, regexp_extract(line, 'tool_call::([^ ]+) ', 1) AS tool FROM trace) GROUP BY tool) SELECT w AS window_id, count(*) AS n_new FROM t GROUP BY w")
def new_templates_per_window(spark, d):
    """Batch form of the windowed stream: templates by the window that brings them."""
    t = _trace(spark, d).groupBy(trace.loose_tool(F.col("line")).alias("tool")).agg(F.min("line_no").alias("first"))
    return t.groupBy(F.floor(F.col("first") / 60).alias("window_id")).agg(F.count(F.lit(1)).alias("n_new"))


@query("stream_new_templates", "SELECT event_type AS template, min(event_id) AS first FROM events GROUP BY 1")
def stream_new_templates(spark, d):
    s = incremental.source(spark, f"{d}/events.parquet").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("template"))
    return incremental.drained(incremental.new_templates(s))


@query("stream_slot_deltas", f"WITH v AS ({_K}) SELECT line_no, template, value - coalesce(lag(value) OVER (PARTITION BY template ORDER BY line_no), 0) AS delta FROM v")
def stream_slot_deltas(spark, d):
    e = incremental.source(spark, f"{d}/events.parquet")
    s = e.select(F.col("event_id").alias("line_no"), F.col("event_type").alias("template"), F.get_json_object("props", "$.k").cast("long").alias("value"))
    return incremental.drained(incremental.slot_deltas(s))


def _streams(spark, d):
    """Sixteen streams of trace lines."""
    return S.trace_lines(incremental.source(spark, f"{d}/events.parquet")).withColumn("stream", F.pmod("line_no", F.lit(16)))


def _protocol(kind: str) -> None:
    def run(spark, d):
        written = incremental.drained(protocol.stream_records(_streams(spark, d), kind), protocol.PARTITIONS)
        return protocol.lines_of(written, kind).select("line_no", "line")

    run.__doc__ = f"Records of kind {kind} written by a stream, and the lines out of them again."
    query(f"stream_protocol_{kind}", f"WITH {TRACE} SELECT line_no, line FROM trace")(run)


for _name in protocol.KINDS:
    _protocol(_name)


@query("stream_protocol_reject", "SELECT event_id AS line_no, event_type || ' ' || user_id AS line, event_type NOT IN ('click', 'view') AS rejected FROM events")
def stream_protocol_reject(spark, d):
    """A closed dictionary: lines of other templates are rejected with their text."""
    e = incremental.source(spark, f"{d}/events.parquet")
    s = e.select(F.pmod("event_id", F.lit(16)).alias("stream"), F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("line"))
    known = ["click 1", "view 1"]
    return protocol.lines_of(incremental.drained(protocol.stream_records(s, "ints", known=known)), "ints", known=known).select("line_no", "line", "rejected")


@query("protocol_dictionary", """WITH v AS (SELECT event_id % 16 AS stream, event_type, (row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) - 1) // 64 AS packet FROM events),
f AS (SELECT stream, event_type, min(packet) AS packet FROM v GROUP BY stream, event_type) SELECT stream, packet, count(*) AS n_new FROM f GROUP BY stream, packet""")
def protocol_dictionary(spark, d):
    """Templates that each packet's dictionary record brings (batch): packets are told by the data records before."""
    e = S.table(spark, d, "events")
    s = e.select(F.pmod("event_id", F.lit(16)).alias("stream"), F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("line"))
    r = protocol.records(s, "ints").withColumn("packet", F.count_if(F.col("kind") == "DATA").over(Window.partitionBy("stream").orderBy("seq")))
    return r.where("kind = 'DICT'").select("stream", "packet", F.col("n_new"))


@query("stream_match", f"WITH {MATCHED} SELECT event_id::BIGINT AS event_id, count(*) AS n FROM matched GROUP BY 1")
def stream_match(spark, d):
    """Templates matched on a stream, counted in batch."""
    s = S.trace_lines(incremental.source(spark, f"{d}/events.parquet"))
    return incremental.drained(incremental.matched(s, BANK)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["trace_structured_kv_num"](spark, d)
