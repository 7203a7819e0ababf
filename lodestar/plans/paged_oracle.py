"""The queries over laid-out documents in DuckDB's SQL, on the same tables."""

from .oracle import _HEADING, _LINES, _STRIP

_EL = (
    _LINES
    + """,
el as (select cast(doc_id as varchar) as doc_id, cast(seq // 40 + 1 as int) as page, cast(seq as int) as seq, text,
  case when seq % 11 = 5 then 'table' when seq % 13 = 6 then 'image' else 'text' end as kind,
  seq % 2 * 300 + 10.0::double as x0, seq % 40 // 2 * 14 + 20.0::double as y0,
  seq % 2 * 300 + 10.0::double + least(270, length(text)) as x1, seq % 40 // 2 * 14 + 32.0::double as y1
  from lines where text <> '')"""
)
_ORDERED = (
    _EL
    + """,
o as (select *, cast(row_number() over (partition by doc_id, page order by seq % 2, seq) - 1 as int) as place from el),
na as (select *, case kind when 'table' then 'table-' || (row_number() over (partition by doc_id, kind order by page, place) - 1)
        when 'image' then 'img-' || (row_number() over (partition by doc_id, kind order by page, seq) - 1) || '.png' end as asset_id
      from o where not (kind = 'image' and seq % 5 = 0))"""
)
_LEVEL = r"""case when regexp_matches(text, '^(\d+(?:\.\d+)*\.?)\s+\S')
  then least(4, len(string_split(regexp_replace(regexp_extract(text, '^(\d+(?:\.\d+)*\.?)\s+\S', 1), '\.$', ''), '.'))) else 3 end"""
_PARAGRAPHS = (
    _ORDERED
    + f""",
hd as (select *, kind = 'text' and {_HEADING} as hd, {_LEVEL} as lev from na),
pa as (select *, case when kind <> 'text' then '![' || asset_id || '](' || asset_id || ')' when hd then repeat('#', cast(lev as int)) || ' ' || text else text end as para,
       sum(cast(hd as int)) over (partition by doc_id order by page, place)
       - cast(first(hd) over (partition by doc_id order by page, place rows between unbounded preceding and unbounded following) as int) as section_id from hd),
pp as (select *, coalesce(sum(length(para) + 2) over (partition by doc_id, section_id order by page, place rows between unbounded preceding and 1 preceding), 0) as char_offset from pa),
sec as (select doc_id, cast(section_id as bigint) as section_id, max(case when hd then text end) as heading, cast(max(case when hd then lev end) as int) as level,
        string_agg(para, chr(10) || chr(10) order by page, place) as body, array_to_string(list_sort(list(distinct page)), ',') as pages,
        coalesce(string_agg(asset_id || '@' || page || '@' || char_offset, ';' order by page, place) filter (where asset_id is not null), '') as elements
        from pp group by doc_id, section_id),
ass as (select doc_id, cast(section_id as bigint) as section_id, asset_id, kind, page, cast(char_offset as bigint) as char_offset,
        row_number() over (partition by doc_id, section_id order by page, place) - 1 as "order" from pp where asset_id is not null),
sm as (select doc_id, page, cast(sum(case when kind = 'text' then length(text) else 0 end) as bigint) as chars, count(*) filter (where kind = 'image') as images from el group by doc_id, page),
sp as (select *, chars < 50 and images * 40000 >= 600 * 320.125 * 0.6 as needs_ocr from sm),
dc as (select p.doc_id, count(*) as page_count, bool_or(needs_ocr) as needs_ocr,
       coalesce(any_value(s.n), 0) as sections, coalesce(any_value(a.images), 0) as images, coalesce(any_value(a.tables), 0) as tables
       from sp p left join (select doc_id, count(*) as n from sec group by doc_id) s on p.doc_id = s.doc_id
       left join (select doc_id, count(*) filter (where kind = 'image') as images, count(*) filter (where kind = 'table') as tables from ass group by doc_id) a on p.doc_id = a.doc_id
       group by p.doc_id)"""
)
_BLOCKS = (
    _EL
    + r""",
bl as (select doc_id, seq, text as whole, string_split(text, ' ') as w from el where kind = 'text'),
bs as (select *, array_to_string(w[1:greatest(len(w) - 3, 0)], ' ') as text, array_to_string(w[greatest(len(w) - 3, 0) + 1:], ' ') as tail from bl)"""
)
_FIGURES = """
fg as (select cast(conv_id as varchar) || '::img-' || turn || '.png' as custom_id, conv_id, turn, cast(conv_id as varchar) as doc_id, 'img-' || turn || '.png' as image_id,
  sha256(coalesce(text, '')) as image_sha256, case when turn % 2 = 0 then role end as caption, 'Talk ' || conv_id as title, 'S' as heading
  from conversations where (conv_id + turn) % 9 <> 0)"""
_RESULTS = """
rs as (select *, conv_id * 7 + turn as n, cast(conv_id as varchar) || '::img-' || turn || '.png' as custom_id from conversations),
re as (select *, n % 5 + conv_id % 2 as batch, case when n % 11 = 0 then null when n % 5 = 0 then '' when n % 7 = 0 then 'Unreadable scan' else text end as content,
       case when n % 11 = 0 then 'HTTP 500' end as error from rs),
rb as (select *, error is not null or coalesce(content, '') = '' as bad from re)"""
_ASSETS = (
    _EL
    + """,
ast as (select doc_id, seq, text, case when seq % 2 = 0 then 'figure' else 'table' end as kind, case when seq % 4 < 2 then 'Figure ' || seq end as caption,
       case when seq % 3 <> 0 then text end as description from el),
ar as (select a.kind, a.doc_id, a.kind || '-' || a.seq as ord, coalesce(d.lang, '') as heading, md5(concat_ws(chr(10) || chr(10), nullif(caption, ''), nullif(a.text, ''))) as text_md5
       from ast a join documents d on a.doc_id = cast(d.doc_id as varchar) where a.kind = 'table' or coalesce(description, '') <> '')"""
)
_OTHER = "x0 + 30 as ox0, y0 - 6 as oy0, x0 + 150 as ox1, y1 - 2 as oy1"
_INTS = "cast({0} as int) || ',' || cast({1} as int) || ',' || cast({2} as int) || ',' || cast({3} as int)"

ORACLE_SQL = {
    "page_element_order": f"with {_ORDERED} select doc_id, page, place, kind, seq, asset_id from na",
    "document_sections": f"with {_PARAGRAPHS} select doc_id, section_id, heading, level, md5(body) as text_md5, cast(length(body) as bigint) as chars, pages from sec",
    "document_assets": f"with {_PARAGRAPHS} select * from ass",
    "layout_side_table": f"with {_PARAGRAPHS} select doc_id, section_id, heading, elements from sec",
    "page_summaries": f"with {_PARAGRAPHS} select doc_id, page, 600.0::double as width, 320.12::double as height, chars, needs_ocr from sp",
    "document_counts": f"with {_PARAGRAPHS} select * from dc",
    "run_totals": f"""with {_PARAGRAPHS}, bad as (select distinct cast(doc_id as varchar) as doc_id from labels where quality = 0)
select count(*) as docs, cast(sum(sections) as bigint) as sections, cast(sum(images) as bigint) as images, cast(sum(tables) as bigint) as tables, (select count(*) from bad) as failed
from dc where doc_id not in (select doc_id from bad)""",
    "running_heads_removed": rf"""with {_LINES}, m as (select *, regexp_replace(trim(text), '\d+', '#', 'g') as masked from lines),
p as (select source, count(distinct doc_id) as pages from m group by source),
h as (select m.source, masked from m join p on m.source = p.source where seq < 2 and masked <> '' group by m.source, masked, pages having count(distinct doc_id) >= greatest(3, pages * 0.005::double))
select source as doc_id, count(*) as lines, cast(sum(length(text)) as bigint) as chars from m anti join h using (source, masked) group by source""",
    "margins": f"with {_EL} select doc_id, seq, not (y0 > 320.0::double * 0.08::double and y1 < 320.0::double * (1 - 0.08::double)) as in_margin from el",
    "body_sizes": f"with {_EL} select doc_id, coalesce(median(case when seq % 7 > 0 then (seq % 7 * 1.5)::double end), 0.0)::double as body_size from el group by doc_id",
    "block_styles": f"""with {_EL}, w as (select doc_id, seq as block, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as pos from el),
s as (select doc_id, block, pos, length(w) % 4 * 0.5::double + 9 as size, length(w) % 3 = 0 as bold, length(w) as n from w),
g as (select doc_id, block, size, sum(n) as n, min(pos) as first, sum(case when bold then n else 0 end) as b from s group by all),
r as (select *, row_number() over (partition by doc_id, block order by n desc, first) as r from g)
select doc_id, block, max(case when r = 1 then size end) as size, round(sum(b)::double / greatest(1, sum(n)), 6) as bold_share from r group by doc_id, block""",
    "box_algebra": f"""with {_EL}, b as (select *, {_OTHER} from el),
c as (select *, (x1 - x0) * (y1 - y0) as area, greatest(0.0, least(x1, ox1) - greatest(x0, ox0)) * greatest(0.0, least(y1, oy1) - greatest(y0, oy0)) as shared from b)
select doc_id, seq, area::double as area, shared::double as shared, area > 0 and shared >= area * 0.6::double as covered,
  {_INTS.format('least(x0, ox0)', 'least(y0, oy0)', 'greatest(x1, ox1)', 'greatest(y1, oy1)')} as hull,
  {_INTS.format('greatest(x0, ox0)', 'greatest(y0, oy0)', 'least(x1, ox1)', 'least(y1, oy1)')} as clipped,
  {_INTS.format('x0 - 4', 'y0 - 4', 'x1 + 4', 'y1 + 4')} as padded from c""",
    "text_outside_assets": f"""with {_EL}, a as (select doc_id, page, x0 + seq % 9 * 6 as ax0, y0 as ay0, x1 + seq % 9 * 6 as ax1, y1 as ay1 from el where seq % 4 = 0)
select doc_id, page, seq from el where not exists (select 1 from a where a.doc_id = el.doc_id and a.page = el.page
  and greatest(0.0, least(x1, ax1) - greatest(x0, ax0)) * greatest(0.0, least(y1, ay1) - greatest(y0, ay0)) >= (x1 - x0) * (y1 - y0) * 0.6::double)""",
    "raster_placements": f"""with {_EL} select doc_id, page, cast(seq % 6 as bigint) as xref, count(distinct y0 || '/' || x1) as n, round(min(x0), 0)::double as "left"
from el where seq % 2 = 0 and x1 - x0 >= 24 group by doc_id, page, seq % 6""",
    "real_tables": r"""with r as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: string_split(x, ',')) as c from documents),
f as (select doc_id, c, flatten(c) as f from r)
select doc_id, len(c) >= 2 and list_max(list_transform(c, lambda x: len(x))) >= 2
  and len(list_filter(f, lambda x: regexp_matches(x, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'))) >= len(f) * 0.35::double as real from f""",
    "span_rules": f"with {_EL} select doc_id, seq, (seq % 32) & 18 <> 0 or seq % 5 + 8.0::double >= 10.0::double * 1.10::double as emphatic, abs(seq % 3 * 0.006::double) > 0.01::double as rotated from el",
    "split_headings": f"""with {_BLOCKS}, h as (select *, {_HEADING} as hd from bs)
select doc_id, seq, case when hd then text end as heading, md5(case when hd then tail else whole end || ' of a broken line ' || seq) as body_md5 from h""",
    "block_texts": f"with {_BLOCKS} select doc_id, seq, md5(whole || ' of a broken line ' || seq) as text_md5 from bl",
    "index_asset_rows": f"with {_ASSETS} select * from ar",
    "index_rows_by_kind": f"with {_ASSETS} select kind, count(*) as n from ar group by kind",
    "pending_limited": "select doc_id from documents where doc_id % 2 = 0 and doc_id not in (select doc_id from labels) order by doc_id limit 100",
    "pending_index_kinds": """with w as (select doc_id, unnest(['text', 'figure', 'table']) as kind from documents),
l as (select doc_id, case when quality = 1 then 'text' else 'figure' end as kind from labels) select doc_id, kind from w anti join l using (doc_id, kind)""",
    "ledger_union": "select 'text' as kind, count(*) as n, cast(sum(doc_id) as bigint) as ids from (select distinct doc_id from labels where quality = 1 or doc_id % 3 = 0)",
    "sampled_figures": f"with {_FIGURES} select custom_id, caption from fg where coalesce(caption, '') <> '' order by md5('7:' || custom_id), custom_id limit 20",
    "figure_context": f"with {_FIGURES} select custom_id, image_sha256, caption, title, heading from fg",
    "describe_prompts": """select conv_id, turn, md5(concat_ws(chr(10), case when turn % 2 = 0 then 'Paper: T' end, case when turn % 3 = 0 then 'Section: H' end,
  case when turn % 5 <> 0 and role <> '' then 'Caption: ' || role end, case when turn % 7 <> 0 and text <> '' then 'Surrounding text: ' || text end, 'Describe the figure.')) as prompt_md5 from conversations""",
    "pending_figures": f"""with {_FIGURES} select custom_id from fg where image_id <> 'img-0.png' and image_sha256 not in (select image_sha256 from fg where conv_id % 4 = 2)""",
    "collected_descriptions": rf"""with {_FIGURES}, {_RESULTS}
select cast(rb.conv_id as varchar) as doc_id, 'img-' || rb.turn || '.png' as image_id,
  md5(case when upper(regexp_replace(content, {_STRIP})) like 'UNREADABLE%' then '' else regexp_replace(content, {_STRIP}) end) as description_md5,
  case when batch < 5 then 'm' || batch end as model, fg.image_sha256, batch from rb left join fg using (custom_id) where not bad""",
    "collected_failures": f"with {_RESULTS} select custom_id, coalesce(error, 'empty completion') as reason, batch from rb where bad",
    "collected_counts": f"with {_RESULTS} select batch, count(*) filter (where not bad) as ok, count(*) filter (where bad) as failed from rb group by batch",
    "enqueued_bytes": f"with {_RESULTS} select batch, count(*) as requests, cast(sum(strlen(coalesce(content, '')) + 1) as bigint) as bytes from rb where batch < 3 group by batch",
    "batch_phases": "select event_id, case when event_id % 7 = 0 then 'collected' when event_id % 4 = 0 then 'submit' when event_id % 6 >= 2 then 'collect' else 'wait' end as phase from events",
    "hash_checked_merge": f"""with {_FIGURES} select doc_id, image_id, case when turn % 3 <> 0 then 'd-' || image_id end as description, case when turn % 3 <> 0 then 'm' end as description_model,
  turn % 3 <> 0 as changed from fg""",
    "memoized_requests": """with a as (select distinct text from conversations where role = 'assistant')
select conv_id || '::' || turn as custom_id, case when a.text is not null then md5('A: ' || c.text) end as content_md5 from conversations c left join a on c.text = a.text""",
    "fallback_routes": "select event_id, case event_id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' end as provider from events",
    "model_comparison": f"""with {_FIGURES}, q as (select *, unnest(['short', 'long']) as model,
  concat_ws(chr(10), 'Paper: ' || title, 'Section: ' || heading, 'Caption: ' || nullif(caption, ''), 'Describe the figure.') as prompt from fg),
c as (select model, (conv_id * 31 + turn) % 1000 / 8.0::double + case when model = 'long' then 100 else 0 end as seconds, case when model = 'long' or length(prompt) < 45 then prompt end as said from q)
select model, count(*) as n, count(*) filter (where said is null) as failures, list(seconds order by seconds)[count(*) // 2 + 1] as median, round(avg(length(said)), 6) as mean_chars from c group by model""",
    "modality_sums": """with m as (select event_id % 7 % 4 as m from events) select count(*) as n, count(*) filter (where m in (1, 3)) as with_image,
  count(*) filter (where m in (2, 3)) as with_table, count(*) filter (where m = 0) as text_only from m""",
    "caption_coverage": f"""with {_ASSETS} select kind, count(*) as n, count(caption) as captioned, round(count(caption) / count(*), 6) as share, median(length(caption)) as median_chars from ast group by kind""",
    "call_costs": """with c as (select 'describe' as task, (select sum(len(string_split(text, chr(10)))) from documents where text is not null) as calls, 1050 as i, 120 as o
  union all select 'embed', (select count(*) from documents), 500, 0),
p as (select unnest(['flash', 'batch']) as model, unnest([1.0::double, 0.5::double]) as share)
select task, model, cast(calls as bigint) as calls, cast(calls * i as bigint) as input_tokens, cast(calls * o as bigint) as output_tokens,
  round((calls * i / 1e6 * 0.10::double + calls * o / 1e6 * 0.40::double) * share, 6) as cost from c, p""",
    "file_totals": """select case when page_id % 2 = 0 then 'local' else 'remote' end as side, 'd' || page_id % 5 as top, count(*) as files, cast(sum(strlen(html)) as bigint) as bytes
from pages where page_id % 7 <> 0 group by 1, 2""",
    "paper_urls": """with m as (select cast(page_id % 3 as varchar) as file, cast(page_id % 97 as varchar) as paper_id, max('u' || page_id) as url from pages group by 1, 2)
select paper_id, arg_max(url, file) as url from m group by paper_id""",
    "names_and_checks": """with e as (select event_id, event_id as n, ([200, 404, 408, 409, 425, 429, 500, 503])[event_id % 8 + 1] as status from events)
select event_id, n || '.pdf' as pdf, n % 2 = 0 as is_pdf, status in (408, 425, 429, 500, 503) as again, status in (408, 409, 425, 429, 500, 503) as call_again,
  'p' as provider, case n % 3 when 1 then 'm' when 2 then 'm:x' end as model, cast(n as int) as sparse_index, n * 2 as sparse_value from e""",
    "readable_descriptions": f"select conv_id, turn, md5(case when turn % 3 = 0 then '' else regexp_replace(text, {_STRIP}) end) as description_md5 from conversations",
    "most_common_hosts": """with h as (select regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, count(*) as n from pages where url is not null group by 1)
select host, n, cast(row_number() over (order by n desc, host) as int) as rank from h order by n desc, host limit 10""",
    "last_turns": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 2",
    "request_lines": "select conv_id || '::' || turn as custom_id, conv_id || '::' || turn as named, 'POST' as method, 'm' as model, cast(120 as int) as max_tokens, md5(text) as prompt_md5 from conversations",
}
