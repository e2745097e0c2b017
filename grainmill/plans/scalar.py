"""Scalar rules bound to columns: hashes, labels, clocks, model answers, JSON, numbers and log text."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import hashing as H
from grainmill.functions import scalars as S
from grainmill.functions.json_text import is_strict_json, json_first, json_last
from grainmill.plans.registry import query
from grainmill.plans.tables import CLASSES, CLOCKS, GEOMETRY, MANIFEST, bucket_sql, class_list_sql, clocks, dist_sql, geometry, manifest
from grainmill.session import table


@query("stable_bucket", f"select o_orderkey id, {bucket_sql('o_orderkey', '17', 100)} bucket from orders")
def stable_bucket(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), H.stable_bucket(F.col("o_orderkey"), "17", 100).alias("bucket"))


@query("lot_split", f"with {MANIFEST} select distinct lot, split from manifest")
def lot_split(spark, sf):
    return manifest(spark, sf).select("lot", "split").distinct()


@query("stable_sample", "select o_orderkey id from orders where cast(cast('0x' || substr(sha256('audit:' || o_orderkey), 1, 16) as ubigint) as double) / 18446744073709551616.0 < 0.05")
def stable_sample(spark, sf):
    return table(spark, sf, "orders").where(H.stable_sample(F.col("o_orderkey"), "audit", 0.05)).select(F.col("o_orderkey").alias("id"))


@query("make_id", "select c_custkey, lpad(regexp_extract(c_name, '(\\d+)', 1), cast(greatest(8, length(regexp_extract(c_name, '(\\d+)', 1))) as integer), '0') || '_' || lpad(cast(c_nationkey as varchar), 3, '0') sample_id from customer")
def make_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.make_id(F.col("c_name"), F.col("c_nationkey")).alias("sample_id"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("normalize_label", "select c_custkey, case when c_custkey % 7 = 0 then null else c_mktsegment end label from customer")
def normalize_label(spark, sf):
    """Messy spellings (case, spaces, brackets, unlabelled marks) come back to the vocabulary."""
    seg = F.col("c_mktsegment")
    messy = F.when(F.col("c_custkey") % 7 == 0, F.element_at(F.array(F.lit(" [] "), F.lit("NaN"), F.lit("unknown")), (F.col("c_custkey") % 3).cast("int") + 1)).when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("  ['"), F.lower(seg), F.lit("'] \n"))).otherwise(F.initcap(seg))
    return table(spark, sf, "customer").select("c_custkey", S.normalize_label(messy, SEGMENTS).alias("label"))


@query("label_domain", f"with {MANIFEST} select id, label from manifest where label in ('1-URGENT', '2-HIGH')")
def label_domain(spark, sf):
    return manifest(spark, sf).where(F.col("label").isin("1-URGENT", "2-HIGH")).select("id", "label")


@query("circular_distance", f"with {CLOCKS} select id, cast({dist_sql('clock', 'try_cast(answer as integer)')} as integer) d from clocks")
def circular_distance(spark, sf):
    return clocks(spark, sf).select("id", S.circular_distance(F.col("clock"), F.col("answer").try_cast("int")).alias("d"))


@query("clock_close", f"with {CLOCKS} select id, case when try_cast(answer as integer) is null then false else {dist_sql('clock', 'try_cast(answer as integer)')} <= 1 end near from clocks")
def clock_close(spark, sf):
    return clocks(spark, sf).select("id", S.clock_close(F.col("clock"), F.col("answer").try_cast("int")).alias("near"))


@query("rotate_clock", f"with {CLOCKS} select id, t turns, cast(((try_cast(answer as integer) - 1 - 3 * t) % 12 + 12) % 12 + 1 as integer) clock from clocks, (select unnest([1, 2, 3]) t)")
def rotate_clock(spark, sf):
    c = clocks(spark, sf).withColumn("turns", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return c.select("id", "turns", S.rotate_clock(F.col("answer").try_cast("int"), F.col("turns")).alias("clock"))


@query("expected_clock", f"with {CLOCKS} select id, case when size / 500 >= 0.25 then clock end clock from clocks")
def expected_clock(spark, sf):
    return clocks(spark, sf).select("id", F.when(F.col("size") / 500 >= 0.25, F.col("clock")).alias("clock"))


@query("graded_relevance", f"with {CLOCKS} select id, case when label = 'error' then 0 when size < 50 and {dist_sql('clock', 'try_cast(answer as integer)')} <= 1 then 2 else 1 end relevance from clocks")
def graded_relevance(spark, sf):
    c = clocks(spark, sf)
    close = S.clock_close(F.col("clock"), F.col("answer").try_cast("int"))
    return c.select("id", S.graded_relevance(F.col("label") != "error", F.col("size") < 50, close).alias("relevance"))


ZONE_SQL = "case when r < 0.35 then 'center' when r < 0.72 then 'middle' else 'edge' end"


@query("zone_of", f"with {GEOMETRY} select g, {ZONE_SQL} zone, count(*) n from geo group by 1, 2")
def zone_of(spark, sf):
    return geometry(spark, sf).groupBy("g", S.zone_of(F.col("r")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("strip_think", "select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') answer from conversations")
def strip_think(spark, sf):
    """Marked reasoning around each turn is removed again, over line breaks and in any case."""
    c = table(spark, sf, "conversations")
    raw = F.concat(F.lit("<Think>draft\nof "), F.col("role"), F.lit("</THINK>\n "), F.col("text"), F.lit(" <think>again</think>\n"))
    return c.select("conv_id", "turn", S.strip_thinking(raw).alias("answer"))


_ANSWERS = "a as (select event_id, 'note {x} then ' || props || ' or {\"k\": ' || (event_id % 7) || '} end' txt from events)"


def _answers(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.concat(F.lit("note {x} then "), "props", F.lit(' or {"k": '), (F.col("event_id") % 7).cast("string"), F.lit("} end")).alias("txt"))


@query("json_first", f"with {_ANSWERS} select event_id, regexp_extract_all(txt, '\\{{\"k\": (\\d+)\\}}', 1)[1] k from a")
def json_first_q(spark, sf):
    return _answers(spark, sf).select("event_id", F.get_json_object(json_first("txt"), "$.k").alias("k"))


@query("json_last", f"with {_ANSWERS} select event_id, regexp_extract_all(txt, '\\{{\"k\": (\\d+)\\}}', 1)[2] k from a")
def json_last_q(spark, sf):
    return _answers(spark, sf).select("event_id", F.get_json_object(json_last("txt"), "$.k").alias("k"))


@query("strict_json", "select event_id, event_id % 3 = 0 valid from events")
def strict_json(spark, sf):
    """The whole text must be one object with exactly the key k, holding a finite number of 0 or more."""
    e = table(spark, sf, "events")
    txt = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit('{"k": NaN}')).otherwise(F.concat(F.lit('{"k": 1, "x": "'), "event_type", F.lit('"}')))
    keys = F.json_object_keys("txt")
    k = F.get_json_object("txt", "$.k").try_cast("double")
    valid = F.coalesce(is_strict_json("txt") & (F.array_sort(keys) == F.array(F.lit("k"))) & (k >= 0), F.lit(False))
    return e.select("event_id", txt.alias("txt")).select("event_id", valid.alias("valid"))


@query("signature", "select doc_id, coalesce(nullif(regexp_extract(text, 'token = \"([0-9a-f]+)', 1), ''), case when contains(text, 'License') then 'License' when contains(text, '|') then '|' end, left(text, 40)) sig from documents")
def signature(spark, sf):
    """A marked value, else the first known term, else the text's head."""
    t = F.col("text")
    marked = F.nullif(F.regexp_extract(t, 'token = "([0-9a-f]+)', 1), F.lit(""))
    known = F.coalesce(*(F.when(t.contains(x), x) for x in ("License", "|")))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(marked, known, F.left(t, F.lit(40))).alias("sig"))


@query("parse_label", f"with {MANIFEST} select id, case when id % 4 = 3 then null else label end label from manifest")
def parse_label(spark, sf):
    """Labels as the last line, as a word in it, and inside running text."""
    m = manifest(spark, sf)
    words = {c: "".join(ch for ch in c if ch.isalpha() or ch == " ").strip().replace(" ", "_") for c in CLASSES}
    name = S.lookup(words)[F.col("label")]
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("it is\n"), name, F.lit("\n "))).when(F.col("id") % 4 == 1, F.concat(F.lit("so, "), F.upper(name), F.lit(".\n"))).when(F.col("id") % 4 == 2, F.concat(F.lit("x"), name, F.lit("x\nend"))).otherwise("nothing\nhere")
    back = S.lookup({v: k for k, v in words.items()})
    return m.select("id", F.try_element_at(back, S.parse_label(text, list(words.values()))).alias("label"))


@query("last_assistant", "select conv_id, arg_max(text, turn) filter (role = 'assistant' and text is not null) answer from conversations group by 1")
def last_assistant(spark, sf):
    c = table(spark, sf, "conversations")
    hit = (F.col("role") == "assistant") & F.col("text").isNotNull()
    return c.groupBy("conv_id").agg(F.max_by(F.when(hit, F.col("text")), F.when(hit, F.col("turn"))).alias("answer"))


@query("coerce_num", "select event_id, try_cast(case when event_id % 3 = 0 then cast(event_id as varchar) when event_id % 3 = 1 then event_type end as double) x from events")
def coerce_num(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type"))
    return table(spark, sf, "events").select("event_id", S.coerce_number(raw).alias("x"))


@query("numeral_parse", "select p_partkey, p_size % 99 + 1 n from part")
def numeral_parse(spark, sf):
    """Every number of 1 to 99 is written in numerals or digits and read back."""
    n = (F.col("p_size") % 99 + 1).cast("int")
    unit = F.array(*(F.lit(x) for x in ["", *[k for k in S.NUMERALS if k != "两"]]))
    at = lambda i: F.element_at(unit, i.cast("int") + 1)
    tens = F.floor(n / 10)
    words = F.when(n < 10, at(n)).otherwise(F.concat(F.when(tens > 1, at(tens)).otherwise(""), F.lit("十"), at(n % 10)))
    text = F.when(F.col("p_partkey") % 2 == 0, words).otherwise(n.cast("string"))
    return table(spark, sf, "part").select("p_partkey", S.numeral(text).alias("n"))


@query("json_dig", "select event_id, cast(json_extract_string(props, '$.k') as bigint) k, json_extract_string(props, '$.a.b') missing from events")
def json_dig(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


@query("json_numbers", "select event_id, cast(json_extract_string(props, '$.k') as double) x from events union all select event_id, value from events union all select event_id, cast(event_id % 5 as double) from events")
def json_numbers(spark, sf):
    """Every number inside nested JSON, numbers in strings too, booleans not."""
    e = table(spark, sf, "events")
    doc = F.to_json(F.struct(F.from_json("props", "k long").alias("p"), F.array(F.struct("value", F.lit(True).alias("flag"))).alias("list"), F.concat(F.lit("at "), (F.col("event_id") % 5).cast("string")).alias("s")))
    return e.select("event_id", F.explode(F.regexp_extract_all(doc, F.lit(r'(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?'), F.lit(0))).alias("x")).select("event_id", F.col("x").cast("double").alias("x"))


@query(
    "number_renderings",
    """with v as (select event_id, value v, printf('%.12f', value) l, cast(split_part(printf('%.6e', value), 'e', 1) as double) m from events where value is not null and isfinite(value)), d as (select cast(unnest(range(1, 7)) as integer) d)
select event_id, 'rounded' form, d, printf('%.' || d || 'f', v) s from v, d union all select event_id, 'truncated', d, substr(l, 1, instr(l, '.') + d) from v, d
union all select event_id, 'mantissa', d, printf('%.' || d || 'f', m) from v, d where v <> 0 and abs(v) < 0.01""",
)
def number_renderings(spark, sf):
    """Rounded, truncated and mantissa forms of every event's value, at 1 to 6 decimals."""
    return S.renderings(table(spark, sf, "events"), "event_id", "value")


@query(
    "regex_tokens",
    r"""with t as (select 'd' || doc_id k, text from documents union all select 'e' || event_id, 'run ' || event_id || ' loss -' || printf('%.5f', value) || ', see arXiv:2401.01234 and 1.22.333; was ' || printf('%.3f', value / 7) || '/' || printf('%.8f', value) from events),
l as (select k, unnest(string_split(text, chr(10))) line from t where text is not null),
c as (select k, regexp_replace(line, '(?i)arxiv[:\s]*\S+|\b\d+\.\d+\.\d+\b', ' ', 'g') line from l)
select k, unnest(regexp_extract_all(' ' || line, '[^.\d](-?\d+\.\d{3,6})', 1)) token from c""",
)
def regex_tokens(spark, sf):
    """Signed decimals of 3 to 6 fraction digits in documents and in lines written from events; citations are no numbers."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), "text")
    line = F.format_string("run %d loss -%.5f, see arXiv:2401.01234 and 1.22.333; was %.3f/%.8f", F.col("event_id"), F.col("value"), F.col("value") / 7, F.col("value"))
    lines = table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("k"), line.alias("text"))
    return docs.unionByName(lines).select("k", F.explode(S.decimal_tokens(F.col("text"))).alias("token"))


TAGS = {"section": r"^https?://[^/]+/([a-z]{2})/", "page": r"^https?://[^/]+/[a-z]{2}/(\d+)", "source": r"[?&]utm_source=(\w+)"}


@query("tag_parse", "select page_id, " + ", ".join(f"{'try_cast(' if n == 'page' else ''}nullif(regexp_extract(url, '{p}', 1), ''){' as bigint)' if n == 'page' else ''} {n}" for n, p in TAGS.items()) + " from pages")
def tag_parse(spark, sf):
    """Named parts of a tag, here of an address: its section, its number and its source; null where a part is missing."""
    found = {n: F.nullif(F.regexp_extract("url", p, 1), F.lit("")) for n, p in TAGS.items()}
    return table(spark, sf, "pages").select("page_id", *((c.cast("long") if n == "page" else c).alias(n) for n, c in found.items()))


@query("redact", "select event_id, replace(props, '\"k\"', '\"***\"') props from events")
def redact(spark, sf):
    return table(spark, sf, "events").select("event_id", F.replace("props", F.lit('"k"'), F.lit('"***"')).alias("props"))


@query("log_extract", "select event_id, round(value, 3) loss, event_id % 100 step from events")
def log_extract(spark, sf):
    """Metric dictionaries inside log lines."""
    e = table(spark, sf, "events")
    line = F.concat(F.lit("12:00 | {'loss': '"), F.format_string("%.3f", F.round("value", 3)), F.lit("', 'step': '"), (F.col("event_id") % 100).cast("string"), F.lit("'} done"))
    hit = F.element_at(F.regexp_extract_all("line", F.lit(r"\{'loss':.*?\}"), F.lit(0)), 1)
    return e.select("event_id", line.alias("line")).select("event_id", F.regexp_extract(hit, r"'loss': '([\d.]+)'", 1).cast("double").alias("loss"), F.regexp_extract(hit, r"'step': '(\d+)'", 1).cast("long").alias("step"))


@query("log_last", "select user_id, arg_max(props, event_id) filter (event_type = 'click') last_props from events group by 1")
def log_last(spark, sf):
    hit = F.col("event_type") == "click"
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.when(hit, F.col("props")), F.when(hit, F.col("event_id"))).alias("last_props"))


@query("base64_encode", "select item_id, 'data:text/plain;base64,' || base64(encode(text)) url from benchmark")
def base64_encode(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("data:text/plain;base64,"), F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit(""))).alias("url"))


@query("md_table_scan", "select p_brand label, round(avg(p_retailprice), 4) x from part group by 1")
def md_table_scan(spark, sf):
    """A Markdown table is written from an aggregate and scanned back: header and rule skipped, first row of a label wins."""
    a = table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("x"))
    doc = a.withColumn("x", F.format_string("%.4f", "x")).select(F.col("p_brand").alias("d"), F.concat(F.lit("| label | x |\n|---|---|\n| "), "p_brand", F.lit(" | "), "x", F.lit(" |\n| "), "p_brand", F.lit(" | - |")).alias("doc"))
    rows = doc.select("d", F.posexplode(F.split("doc", "\n")).alias("pos", "line"))
    rule = rows.where(F.col("line").rlike(r"^[|][ :|-]*-[ :|-]*[|]$")).groupBy("d").agg(F.min("pos").alias("rule"))
    cells = rows.join(rule, "d").where("pos > rule").withColumn("c", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)))
    first = cells.groupBy(F.col("c")[1].alias("label")).agg(F.min_by(F.col("c")[2], "pos").alias("v"))
    return first.select("label", F.when(~F.col("v").isin("-", "n/a", ""), F.col("v")).cast("double").alias("x"))
