"""DuckDB SQL of the training-data queries that SQL can express at the size of the comparison tables."""

from __future__ import annotations

from grainmill.llm.warc import DATE

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_EOL = "chr(13) || chr(10)"

OP1 = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
sym as (select a, b from e union select b, a from e),
r as (select a, b from sym union select r.a, sym.b from r join sym on r.b = sym.a),
low as (select a doc_id, min(b) m from r group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) component_id from documents d left join n using (doc_id) left join low using (doc_id)"""

OP6 = f"""with r as (select page_id, coalesce(html, '') payload, sha256(coalesce(cast(page_id as varchar), 'null') || '|' || coalesce(url, '')) k, url, html from pages),
b as (select page_id, concat_ws({_EOL}, 'WARC/1.1', 'WARC-Type: response',
 'WARC-Record-ID: <urn:uuid:' || substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4) || '-' || substr(k, 17, 4) || '-' || substr(k, 21, 12) || '>', 'WARC-Date: {DATE}',
 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), ''), chr(10), ''), 'WARC-Page-ID: ' || coalesce(cast(page_id as varchar), 'null'),
 'WARC-Missing: ' || concat_ws(',', case when url is null then 'url' end, case when html is null then 'html' end), 'WARC-Payload-Digest: sha256:' || sha256(payload),
 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(payload), {_EOL}) || payload || {_EOL} || {_EOL} record from r)
select page_id, strlen(record) length, sha256(record) sha256, case when page_id % 97 = 5 then 'changed' else 'same' end state from b"""

OP10 = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 k from documents where text is not null),
w as (select doc_id, k, line, doc_id * 10000000 + k pos, list_filter(regexp_split_to_array(lower(line), '[ \t\r\f\x0B]+'), lambda x: x <> '') w from l),
v as (select doc_id, k, pos, w, len(w) n, array_to_string(w, ' ') s from w where len(w) > 0),
d as (select s, any_value(w) w, any_value(n) n, min(pos) first from v group by s),
h as (select s, n, first, i, array_to_string(w[1:i - 1], ' ') || '|' || array_to_string(w[i + 1:], ' ') hole, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') closed from (select *, unnest(range(1, n + 1)) i from d where n >= 5)),
hm as (select n, i, hole, min(first) m from h group by all),
cm as (select closed, min(first) m from h group by 1),
near as (select h.s from h join hm using (n, i, hole) where hm.m < h.first union select h.s from h join d x on x.s = h.closed and x.n >= 5 where x.first < h.first union select d.s from d join cm on cm.closed = d.s where cm.m < d.first and d.n >= 5),
gone as (select v.doc_id, v.k from v join d using (s) where v.pos > d.first or v.s in (select s from near)),
o as (select w.doc_id, count(*) n_lines, count(gone.k) n_removed, coalesce(string_agg(w.line, chr(10) order by w.k) filter (gone.k is null), '') kept from w left join gone on gone.doc_id = w.doc_id and gone.k = w.k group by 1)
select d.doc_id, case when coalesce(n_removed, 0) > 0 then kept else text end as text, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed from documents d left join o using (doc_id)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP12 = f"""with w as (select doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') w from documents where text is not null),
d as (select doc_id, w, len(w) n from w where len(w) > 0), s as (select count(*) N, cast(sum(n) as bigint) L from d),
p as (select doc_id, n, t, count(*) tf from (select doc_id, n, unnest(w) t from d) group by all),
f as (select t, cast(floor(1000 * ln((2 * (select N from s) + 2) / (2 * count(*) + 1))) as bigint) w from p group by 1),
q as (select item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) t from benchmark),
m as (select item_id, doc_id, cast(sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * (select N from s)) // (select L from s))))) as bigint) score from q join p using (t) join f using (t) group by 1, 2),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) rank, doc_id, score from m where score > 0)
select * from r where rank <= 10"""


def _rounds(rounds: int) -> str:
    """The centroids after each round, c0 being the first ones, and the vectors' clusters a0, a1, ..."""
    near = "select vec_id, v, min(d * 16 + c) // 16 distance, min(d * 16 + c) % 16 c from (select x.vec_id, x.v, y.c, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i])))::bigint d from k x, c{i} y) group by vec_id, v"
    # one row a component; the quotient is rounded down for negative sums too
    mean = "select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) v from (select c, i, sum(v[i])::bigint s, count(*) n from a{i}, (select unnest(range(1, 65)) i) group by 1, 2) group by 1"
    out = []
    for i in range(rounds + 1):
        out.append(f"a{i} as ({near.format(i=i)})")
        if i < rounds:
            out.append(f"c{i + 1} as ({mean.format(i=i)} union all select c, v from c{i} where c not in (select c from a{i}))")
    return ",\n".join(out)


OP13 = f"""with k as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by h) - 1 c, v from (select sha256('1:' || vec_id) h, v from k order by h limit 16)),
{_rounds(3)},
i as (select c, sum(distance)::bigint cluster_inertia from a3 group by 1)
select vec_id, a3.c::integer "cluster", distance, cluster_inertia, (select sum(distance)::bigint from a3) inertia, sha256(array_to_string(c3.v, ',')) centroid_sha256 from a3 join i using (c) join c3 using (c)"""

ORACLE = {"op12_lexical_search": OP12, "op13_centroids": OP13, "op1_ngram_join": OP1, "op6_warc": OP6, "op10_line_dedup": OP10}
