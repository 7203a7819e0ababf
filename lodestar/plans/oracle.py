"""The registered queries in DuckDB's SQL, on the same tables."""

_PARAGRAPHS = r"""
t as (select doc_id, lang, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) as text from documents),
b as (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as block, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as i from t),
o as (select *, coalesce(sum(length(block) + 2) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s from b),
p as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as n, cast(s as int) as s, cast(s + length(block) as int) as e
      from o where regexp_matches(block, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'))
"""

# Chunks by recursion over their number: a and b are the first and last paragraph.
_CHUNKS = """
q as (select doc_id, list(s order by n) as s, list(e order by n) as e, count(*) as m from p group by doc_id),
c as (
  select doc_id, s, e, m, 0 as n, 1 as a,
         greatest(1, coalesce(list_max(list_filter(range(1, m + 1), lambda j: e[j] - s[1] <= {target})), 1)) as b
  from q
  union all
  select doc_id, s, e, m, n + 1, na, greatest(b + 1, coalesce(list_max(list_filter(range(1, m + 1), lambda j: e[j] - s[na] <= {target})), 1))
  from (select *, coalesce(list_max(list_filter(range(a, b + 1), lambda t: list_sum(list_transform(range(t, b + 1), lambda i: e[i] - s[i])) >= {overlap})), a) as na
        from c where b < m)
),
k as (select doc_id, cast(n as int) as n, s[a] as char_start, e[b] as char_end from c)
"""
_CHUNKED = "with recursive " + _PARAGRAPHS + "," + _CHUNKS.format(target=2000, overlap=300)
_STRIP = r"'^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g'"

_PLACED = r"""
m0 as (select doc_id, unnest(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10))) as block,
              generate_subscripts(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) - 1 as i from documents),
m1 as (select doc_id, i, case when i % 3 = 2 then block || chr(10) || chr(10) || '![img-' || cast(i // 3 as varchar) || '.png](img-' || cast(i // 3 as varchar) || '.png)' else block end as block from m0),
marked as (select cast(doc_id as varchar) as doc_id, string_agg(block, chr(10) || chr(10) order by i) as text from m1 group by 1),
placed as (select doc_id, text, unnest(regexp_extract_all(text, '!\[([^\]]+)\]\([^)]+\)', 1)) as asset_id,
                  generate_subscripts(regexp_extract_all(text, '!\[([^\]]+)\]\([^)]+\)', 1), 1) - 1 as position from marked),
assets as (select doc_id, asset_id, position, instr(text, '![' || asset_id || '](') - 1 as char_offset from placed)
"""
_MARKED_CHUNKS = (_PARAGRAPHS.replace("t as (select doc_id, lang, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) as text from documents)", "t as (select doc_id, text from marked)") + "," + _CHUNKS.format(target=2000, overlap=300))

_LINES = r"lines as (select doc_id, lang, source, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as seq from documents)"
_TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"
_LETTERS = r"length(regexp_replace({}, '\P{{L}}', '', 'g'))"
_CAPTION = "(" + " or ".join(f"starts_with(lower(text), '{p}')" for p in ("figure", "fig.", "fig ", "table", "tab.", "algorithm", "listing")) + ")"
_HEADING = rf"""(length(text) between 3 and 200 and {_LETTERS.format('text')} >= 4 and (
   regexp_matches(text, '^(\d+(?:\.\d+)*\.?)\s+\S') or (upper(text) = text and lower(text) <> text)
   or (regexp_matches(text, '^\p{{Lu}}') and right(text, 1) in ('.', ':', '-', '—') and len({_TOKENS}) <= 8
       and len(list_filter({_TOKENS}, lambda w: {_LETTERS.format('w')} >= 3)) > 0)))"""
_SECTIONS = rf"""{_LINES},
h as (select *, {_HEADING} as hd from lines),
g as (select *, sum(cast(hd as int)) over w - cast(first(hd) over (partition by doc_id order by seq rows between unbounded preceding and unbounded following) as int) as section_id
      from h window w as (partition by doc_id order by seq)),
sec as (select doc_id, cast(section_id as bigint) as section_id, max(case when hd then text end) as heading,
        max(case when hd then case when regexp_matches(text, '^(\d+(?:\.\d+)*\.?)\s+\S')
            then least(4, len(string_split(regexp_replace(regexp_extract(text, '^(\d+(?:\.\d+)*\.?)\s+\S', 1), '\.$', ''), '.'))) else 3 end end) as level,
        cast(sum(length(text)) + 2 * (count(*) - 1) as bigint) as chars from g group by doc_id, section_id)"""

_TERMS = r"""
qt as (select query_id, term, count(*) as n from (select item_id as query_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as term from benchmark) where term <> '' group by all),
dt as (select doc_id, term, count(*) as n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as term from documents) where term <> '' group by all)
"""
_BM25 = (
    _TERMS
    + """,
len as (select doc_id, sum(n) as length from dt group by doc_id), tot as (select count(*) as docs, avg(length) as mean from len),
df as (select term, count(*) as df from dt group by term),
bs as (select query_id, dt.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (dt.n * 2.2 / (dt.n + 1.2 * (0.25 + 0.75 * length / mean)))), 6) as score
       from dt join df using (term) join len on dt.doc_id = len.doc_id join qt using (term), tot group by query_id, dt.doc_id)
"""
)
_RANKED = "select query_id, doc_id, cast(rank as int) as rank, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {scores}) where rank <= {k}"
_V = "[" + ", ".join(f"length(lower(text)) - length(replace(lower(text), '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


def _cosines(queries: str, docs: str) -> str:
    norm = "sqrt(list_sum(list_transform({0}, lambda x: cast(x as double) * cast(x as double))))"
    return f"""select query_id, doc_id, round(case when nq * nd > 0 then list_sum(list_transform(list_zip(q, d), lambda p: cast(p[1] as double) * cast(p[2] as double))) / (nq * nd) else 0 end, 6) as score
      from (select *, {norm.format('q')} as nq from ({queries})), (select *, {norm.format('d')} as nd from ({docs}))"""


def _hybrid(where: str) -> str:
    return f"""with {_TERMS}, ok as (select doc_id from documents {where}),
ss as (select query_id, dt.doc_id, sum(dt.n * qt.n) as score from dt join qt using (term) where dt.doc_id in (select doc_id from ok) group by query_id, dt.doc_id),
ds as ({_cosines(f"select item_id as query_id, {_V} as q from benchmark", f"select doc_id, {_V} as d from documents {where}")}),
runs as ({_RANKED.format(scores='ss', k=20)} union all {_RANKED.format(scores='ds', k=20)}),
f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score from runs group by query_id, doc_id)
{_RANKED.format(scores='f', k=5)}"""


ORACLE_SQL = {
    "paragraph_spans": f"with {_PARAGRAPHS} select doc_id, cast(n as int) as n, s, e from p",
    "chunk_spans": f"{_CHUNKED} select doc_id, n, char_start, char_end from k",
    "chunk_stats_by_lang": f"""{_CHUNKED} select lang, count(*) as chunks, count(distinct k.doc_id) as docs, cast(max(char_end - char_start) as bigint) as longest,
        cast(sum(char_end - char_start) as bigint) as chars, count(*) filter (where char_end - char_start > 2000) as over_target from k join t on k.doc_id = t.doc_id group by lang""",
    "index_rows_text": f"""{_CHUNKED},
x as (select k.doc_id, k.n, regexp_replace(text[char_start + 1:char_end], {_STRIP}) as body from k join t on k.doc_id = t.doc_id),
y as (select *, left('Document ' || doc_id || chr(10) || chr(10) || body, 8192) as emb,
             sha1(unhex('6f4d4b7a000040008000726573656172') || encode(doc_id || ':0:text:' || n)) as h from x)
select left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] as id,
       doc_id, n as ord, cast(length(body) as int) as chars, cast(length(emb) as int) as embed_chars, md5(emb) as embed_md5 from y""",
    "asset_chunk_range_join": f"""with recursive {_PLACED}, {_MARKED_CHUNKS}
select k.doc_id, k.n, char_start, char_end, coalesce(string_agg(asset_id, ',' order by position), '') as assets
from k left join assets a on k.doc_id = a.doc_id and char_offset >= char_start and char_offset < char_end group by k.doc_id, k.n, char_start, char_end""",
    "placeholder_integrity": f"""with {_PLACED},
a as (select doc_id, case when (cast(doc_id as bigint) + position) % 5 = 0 then 'lost-' else '' end || asset_id as asset_id,
             char_offset + case when (cast(doc_id as bigint) + position) % 7 = 0 then 1 else 0 end as char_offset from assets),
f as (select 'no-placeholder' as fault from a anti join assets using (doc_id, asset_id)
      union all select 'no-asset' from assets anti join a using (doc_id, asset_id)
      union all select 'offset' from a join marked using (doc_id) semi join assets using (doc_id, asset_id)
        where text[char_offset + 1:char_offset + length('![' || asset_id || '](' || asset_id || ')')] <> '![' || asset_id || '](' || asset_id || ')')
select fault, count(*) as n from f group by fault""",
    "heading_sections": f"with {_SECTIONS} select doc_id, section_id, heading, cast(level as int) as level, chars from sec",
    "first_heading_titles": f"with {_SECTIONS} select doc_id, coalesce(arg_min(heading, section_id) filter (where coalesce(heading, '') <> ''), '') as title from sec group by doc_id",
    "running_heads": rf"""with {_LINES}, z as (select *, max(seq) over (partition by doc_id) as last from lines),
s as (select source, regexp_replace(trim(text), '\d+', '#', 'g') as masked, count(distinct doc_id) as on_pages from z where seq = 0 or seq = last group by 1, 2)
select s.source as doc_id, masked, on_pages from s join (select source, count(distinct doc_id) as pages from documents group by 1) p on s.source = p.source
where masked <> '' and on_pages >= greatest(3, pages * 0.01::double)""",
    "prose_lines": rf"""with {_LINES} select lang, count(*) as lines,
  count(*) filter (where {_CAPTION} or len(list_filter({_TOKENS}, lambda t: {_LETTERS.format('t')} >= 2)) >= 5) as prose, count(*) filter (where {_CAPTION}) as captions from lines group by lang""",
    "length_quantiles_exclusive": """with x as (select list(n_chars order by n_chars) as v, count(*) as m from documents where n_chars is not null),
c as (select unnest([1, 25, 50, 90, 99]) as cut), j as (select cut, v, m, least(greatest(cut * (m + 1) // 100, 1), m - 1) as j from c, x)
select cast(cut as int) as cut, round((v[j] * (100 - (cut * (m + 1) - j * 100)) + v[j + 1] * (cut * (m + 1) - j * 100)) / 100, 6) as value from j""",
    "threshold_counts": "select lang, count(*) as n, "
    + ", ".join(f"count(*) filter (where length(text) > {n}) as {name}, round(count(*) filter (where length(text) > {n}) / count(*), 6) as share_{name}" for name, n in (("over_2000_chars", 2000), ("over_512_tokens", 2048), ("over_2048_tokens", 8192), ("over_8192_tokens", 32768)))
    + " from documents group by lang",
    "density_stats": "select lang, round(avg(n), 6) as mean_lines, median(n) as median_lines, max(n) as most_lines from (select lang, len(string_split(coalesce(text, ''), chr(10))) as n from documents) group by lang",
    "modality_mix": "select role, count(*) as n, round(count(*) / (select count(*) from conversations), 6) as share from conversations group by role",
    "coverage_ratio": "select lang, count(*) as n, count(l.doc_id) as labelled, round(count(l.doc_id) / count(*), 6) as share from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id group by lang",
    "corpus_sizing": """with x as (select sum(length(text)) as chars from documents), s as (select cast(unnest([256, 300, 512]) as int) as size)
select size, cast(chars as bigint) as chars, cast(chars // 4 as bigint) as tokens, cast(ceil(chars / 4.0::double / size * 1.15::double) as bigint) as chunks,
  cast(ceil(chars / 4.0::double / size * 1.15::double) * 3072 as bigint) as bytes_fp32, cast(ceil(chars / 4.0::double / size * 1.15::double) * 768 as bigint) as bytes_int8 from s, x""",
    "failure_histogram": "select coalesce(case when event_type <> 'view' then event_type end, 'unknown') as reason, count(*) as n from events group by 1",
    "report_full_outer": """with s as (select o_custkey as top, month(o_orderdate) <= 6 as early, count(*) as files, cast(sum(floor(o_totalprice)) as bigint) as bytes from orders group by 1, 2),
b as (select coalesce(a.top, b.top) as top, coalesce(a.files, 0) as x, coalesce(b.files, 0) as y, a.bytes as i, b.bytes as j from (select * from s where early) a full join (select * from s where not early) b on a.top = b.top)
select top, x as local_files, y as remote_files, case when x = 0 and y = 0 then 'absent' when x = 0 then 'only-remote' when y = 0 then 'only-local' when x = y and i = j then 'in-sync' else 'differs' end as state from b""",
    "latency_summary": """select event_type as model, count(*) as n, count(*) filter (where not coalesce(value > 10, false)) as failures,
  list(value order by value) filter (where value is not null)[len(list(value) filter (where value is not null)) // 2 + 1] as median, round(avg(case when value > 10 then length(event_type) end), 6) as mean_chars from events group by event_type""",
    "bm25_topk": f"with {_BM25} {_RANKED.format(scores='bs', k=10)}",
    "sparse_topk": f"with {_TERMS}, ss as (select query_id, dt.doc_id, cast(sum(dt.n * qt.n) as bigint) as score from dt join qt using (term) group by query_id, dt.doc_id) {_RANKED.format(scores='ss', k=10)}",
    "dense_topk": "with mm as (select label, i, round(avg(cast(x as double)), 4) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i), "
    + f"ds as ({_cosines('select label as query_id, list(x order by i) as q from mm group by label', 'select vec_id as doc_id, embedding as d from embeddings')}) {_RANKED.format(scores='ds', k=10)}",
    "hybrid_rrf": _hybrid(""),
    "hybrid_rrf_filtered": _hybrid("where lang = 'en'"),
    "recall_at_k_by_modality": f"""with {_BM25}, run as ({_RANKED.format(scores='bs', k=10)}),
gold as (select item_id as query_id, doc_id from documents d join benchmark b on contains(d.text, b.text)),
e as (select g.query_id, (['text', 'text-image', 'text-table', 'text-table-image'])[g.query_id % 4 + 1] as source, count(r.doc_id) / count(*) as recall
      from gold g left join run r on g.query_id = r.query_id and g.doc_id = r.doc_id group by g.query_id)
select coalesce(source, 'ALL') as source, count(*) as n, round(avg(recall), 6) as recall from e group by grouping sets ((source), ())""",
    "pending_anti": "select doc_id, source from documents anti join labels using (doc_id)",
    "retry_semi": "select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 0)",
    "in_flight_anti": r"select doc_id from documents where cast(regexp_extract(source, '(\d+)$', 1) as int) % 2 = 1",
    "null_safe_merge": """with a as (select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '' else lang end as old from documents),
n as (select doc_id, case when quality = 1 then '' when toxic = 1 then 'en' end as new from labels)
select a.doc_id, case when n.doc_id is not null then new else old end as description, case when n.doc_id is not null then 'm' end as description_model,
  n.doc_id is not null and old is distinct from new as changed from a left join n on a.doc_id = n.doc_id""",
    "upsert_latest": """with o as (select user_id, min(event_id) as event_id from events group by 1), n as (select user_id, max(event_id) as event_id from events where event_type = 'purchase' group by 1),
u as (select * from n union all select * from o where user_id not in (select user_id from n)) select u.user_id, u.event_id, event_type from u join events e on u.event_id = e.event_id""",
    "request_batches_by_count": "select source, doc_id, cast((row_number() over (partition by source order by doc_id) - 1) // 7 as bigint) as batch from documents",
    "request_batches_by_bytes": """with recursive d as (select source, doc_id, coalesce(strlen(text), 0) as bytes, row_number() over (partition by source order by doc_id) as n from documents),
r as (select source, doc_id, n, bytes as held, cast(0 as bigint) as batch from d where n = 1
      union all select d.source, d.doc_id, d.n, case when held + bytes > 20000 then bytes else held + bytes end, batch + case when held + bytes > 20000 then 1 else 0 end
      from r join d on d.source = r.source and d.n = r.n + 1)
select source, doc_id, batch from r""",
    "backoff_schedule": """select event_id, least(60.0, greatest(pow(2.0, event_id % 9), coalesce(try_cast(case when event_id % 4 = 0 then 'soon' when event_id % 4 = 1 then cast(event_id % 90 as varchar) end as double), 0.0)))::double as seconds from events""",
    "parse_results_json": rf"""with c as (select *, conv_id * 31 + turn as n, regexp_replace(text, {_STRIP}) as content from conversations),
k as (select case when n % 11 = 0 then 'expired' when n % 13 = 0 then 'malformed line' when n % 7 = 0 then 'http' when coalesce(content, '') = '' then 'no content' else 'ok' end as kind, content from c)
select kind, count(*) as n, cast(sum(case when kind = 'ok' then length(content) else 0 end) as bigint) as chars from k group by kind""",
    "xy_cut_order": f"""with {_LINES} select cast(doc_id as varchar) as doc_id, cast(1 as int) as page, cast(seq as int) as seq,
  cast(row_number() over (partition by doc_id order by seq % 2, seq) - 1 as int) as place from lines where text <> ''""",
    "passages_numbered": """with c as (select *, row_number() over (partition by conv_id order by turn) as i from conversations)
select conv_id as query_id, md5(string_agg('[' || i || ']' || case when i % 3 = 0 then '' else ' ' || role end || chr(10) || text, chr(10) || chr(10) order by turn)) as passages_md5 from c group by conv_id""",
    "chat_prompt_assembly": """with q as (select conv_id, arg_min(text, turn) as question from conversations where role = 'user' group by conv_id),
a as (select *, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'assistant'),
p as (select conv_id, string_agg('[' || i || '] ' || role || chr(10) || text, chr(10) || chr(10) order by turn) as passages from a group by conv_id)
select q.conv_id as query_id, md5('Context passages:' || chr(10) || chr(10) || coalesce(passages, '(no passages retrieved)') || chr(10) || chr(10) || 'Question: ' || question) as prompt_md5 from q left join p on q.conv_id = p.conv_id""",
    "custom_id_codec": "select conv_id, turn, conv_id || '::' || role || '::' || turn as custom_id, cast(conv_id as varchar) as doc_id, role || '::' || turn as image_id from conversations",
    "snippets": "select doc_id, md5(replace(left(text, 200), chr(10), ' ')) as snippet_md5, left(sha256(text), 8) as version from documents",
    "near_box_captions": f"""with {_LINES},
x as (select cast(doc_id as varchar) as doc_id, seq, case when seq % 7 = 3 and seq % 4 <> 0 then 'Figure ' || seq else text end as text,
             seq % 2 * 300 + 10.0::double as x0, seq // 2 * 14 + 20.0::double as y0, seq % 2 * 300 + 10.0::double + least(270, length(text)) as x1, seq // 2 * 14 + 32.0::double as y1 from lines where text <> ''),
a as (select * from x where seq % 4 = 0), b as (select * from x where seq % 4 <> 0 and {_CAPTION}),
d as (select a.doc_id, a.seq, b.seq as place, b.text, case when b.y0 >= a.y1 then b.y0 - a.y1 when b.y1 <= a.y0 then a.y0 - b.y1 end as distance
      from a join b on a.doc_id = b.doc_id and least(a.x1, b.x1) > greatest(a.x0, b.x0)),
n as (select doc_id, seq, text, row_number() over (partition by doc_id, seq order by distance, place) as r from d where distance <= 80)
select a.doc_id, cast(1 as int) as page, 'img-' || a.seq as asset_id, n.text as caption from a left join n on a.doc_id = n.doc_id and a.seq = n.seq and r = 1""",
}
ORACLE_SQL["sparse_index_topk"] = ORACLE_SQL["sparse_topk"]
ORACLE_SQL["request_batches_by_pointers"] = ORACLE_SQL["request_batches_by_bytes"]
ORACLE_SQL["index_work_states"] = """with d as (select doc_id, lang, coalesce(text, '') as text from documents),
f as (select *, md5(concat_ws(chr(10), case when lang is null then '-' else '+' || md5(lang) end, '+' || md5(text))) as h from d),
w as (select doc_id, concat_ws(':', 1, ('0x' || left(h, 15))::bigint, ('0x' || substr(h, 16, 15))::bigint) as fingerprint from f where doc_id % 9 <> 0),
b as (select doc_id, doc_id % 5 = 0 or length(text || case when doc_id % 5 = 0 then '.' else '' end) > 4000 as other from d where doc_id % 7 <> 0)
select cast(coalesce(w.doc_id, b.doc_id) as varchar) as doc_id, 'text' as kind, case when b.doc_id is null then 'new' when w.doc_id is null then 'gone' else 'changed' end as state, fingerprint,
  case when w.doc_id is not null then '2000/300' else (select case when length(text || case when doc_id % 5 = 0 then '.' else '' end) > 4000 then '1000/300' else '2000/300' end from d where d.doc_id = b.doc_id) end as config
from w full join b on w.doc_id = b.doc_id where b.doc_id is null or w.doc_id is null or other"""
ORACLE_SQL["index_rows_by_function"] = ORACLE_SQL["index_rows_text"]
ORACLE_SQL["upsert_deltas"] = ORACLE_SQL["upsert_latest"]
ORACLE_SQL["placeholder_files"] = f"""with {_PLACED} select doc_id, asset_id, 'no-file' as fault from assets
where cast(doc_id as bigint) % 3 = 0 and cast(doc_id as bigint) not in (select doc_id from labels where doc_id is not null)"""
ORACLE_SQL["progress_report"] = """with d as (select doc_id, doc_id in (select doc_id from labels where doc_id is not null) as there, source in ('src1', 'src2', 'src3') as failed, case when source <> 'src3' then source else 'unknown' end as reason from documents)
select 'wanted' as measure, null as reason, count(*) as n from d union all select 'have', null, count(*) filter (where there) from d union all select 'failed', null, count(*) filter (where not there and failed) from d
union all select 'pending', null, count(*) filter (where not there and not failed) from d union all select 'reason', reason, count(*) from d where failed group by reason"""
