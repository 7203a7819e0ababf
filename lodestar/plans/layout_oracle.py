"""The layout queries in DuckDB's SQL: cuts, splits, claims, merges and labels as recursions over lists of boxes.

A box is a list of four numbers. Each recursion takes one step of all pages at
once and ends when no page has another.
"""

from .oracle import _CAPTION, _LETTERS, _LINES, _TOKENS


def _over(a: str, b: str) -> str:
    return f"(greatest(0, least({a}[3], {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0, least({a}[4], {b}[4]) - greatest({a}[2], {b}[2])))"


def _area(a: str) -> str:
    return f"(greatest(0, {a}[3] - {a}[1]) * greatest(0, {a}[4] - {a}[2]))"


def _hull(a: str, b: str) -> str:
    return f"[least({a}[1], {b}[1]), least({a}[2], {b}[2]), greatest({a}[3], {b}[3]), greatest({a}[4], {b}[4])]"


def _wide(a: str, by: float) -> str:
    return f"[{a}[1] - {by}, {a}[2] - {by}, {a}[3] + {by}, {a}[4] + {by}]"


def _side(a: str) -> str:
    return f"least({a}[3] - {a}[1], {a}[4] - {a}[2])"


def _part(n: int, most: int) -> str:
    return f"(('0x' || substr(md5(doc_id || ':' || seq), {4 * n + 1}, 4))::int % {most})"


_SCATTERED = rf"""{_LINES},
raw as (select cast(doc_id as varchar) as doc_id, cast(seq // 12 + 1 as int) as page, cast(seq as int) as seq,
          (['raster', 'cluster', 'cluster', 'drawing', 'drawing', 'table', 'text', 'text', 'text', 'text'])[{_part(0, 10)} + 1] as kind,
          case when {_part(1, 3)} = 0 then text else array_to_string((string_split(text, ' '))[1:2], ' ') end as text,
          {_part(2, 300)} as x, {_part(3, 400)} as y, {_part(4, 200)} as w, {_part(5, 200)} as h from lines where text <> ''),
el as (select doc_id, page, seq, kind, text, [x::double, y, x + case when kind = 'text' then w + 10 else w + 20 end, y + case when kind = 'text' then h % 30 + 8 else h + 20 end] as b from raw)
"""

_GRID = rf"""{_LINES},
el as (select cast(doc_id as varchar) as doc_id, cast(1 as int) as page, cast(seq as int) as seq, case when seq % 5 = 0 then 'cluster' else 'text' end as kind, text,
          [seq % 2 * 300 + 10.0::double, seq // 2 * 14 + 20.0, case when seq % 5 = 0 then seq % 2 * 300 + 100.0 else seq % 2 * 300 + 10.0 + least(270, length(text)) end, case when seq % 5 = 0 then seq // 2 * 14 + 90.0 else seq // 2 * 14 + 32.0 end] as b
       from lines where text <> '')
"""

_HITS = f"len(list_filter(prose, lambda p: {_over('p', '{0}')} > 0)) > 0"


def figures(elements: str) -> str:
    """Figures of the pages that ``elements`` places, in the order of their candidates."""
    inside = lambda b: f"len(list_filter(drawings, lambda d: {_over('d', b)} > 0)) > 0"
    cut = lambda n, f, of: f"list_{f}(list_transform(list_filter(drawings, lambda d: {_over('d', 'band')} > 0), lambda d: {of}(d[{n}], band[{n}])))"
    return f"""with recursive {elements},
em as (select *, kind = 'text' and ({_CAPTION} or len(list_filter({_TOKENS}, lambda t: {_LETTERS.format('t')} >= 2)) >= 5) as is_prose from el),
pg as (select doc_id, page, coalesce(list(b order by seq) filter (where is_prose), []) as prose, coalesce(list(b order by seq) filter (where kind = 'text' and not is_prose and length(text) <= 80), []) as labels,
         coalesce(list(b order by seq) filter (where kind = 'text'), []) as texts, coalesce(list(b order by seq) filter (where kind = 'drawing'), []) as drawings, coalesce(list(b order by seq) filter (where kind = 'table'), []) as tables from em group by doc_id, page),
ra as (select doc_id, page, min(seq) as seq, b from em where kind = 'raster' and {_side('b')} >= 24 group by doc_id, page, b),
cl as (select e.doc_id, e.page, e.seq, e.b, p.drawings, list_sort(list_transform(list_filter(p.prose, lambda p: {_over('p', 'e.b')} > 0 and least(e.b[3], p[3]) - greatest(e.b[1], p[1]) >= (e.b[3] - e.b[1]) * 0.5), lambda p: [p[2], p[4]])) as walls
       from em e join pg p using (doc_id, page) where kind = 'cluster'),
bd as (select *, unnest(range(1, len(walls) + 2)) as n from cl where len(walls) > 0),
bn as (select doc_id, page, seq, n, drawings, [b[1], greatest(b[2], coalesce(list_max(list_transform(walls[1:n - 1], lambda w: w[2])), b[2])), b[3], least(case when n <= len(walls) then walls[n][1] else b[4] end, b[4])] as band from bd),
tb as (select doc_id, page, seq, n, [{cut(1, 'min', 'greatest')}, {cut(2, 'min', 'greatest')}, {cut(3, 'max', 'least')}, {cut(4, 'max', 'least')}] as b from bn where band[4] > band[2] and {inside('band')}),
ca as (select doc_id, page, seq, n, b from tb where {_side('b')} >= 60 union all select doc_id, page, seq, 0, b from cl where len(walls) = 0 and {_side('b')} >= 60),
cs as (select doc_id, page, list(b order by seq, n) as waiting from ca group by doc_id, page),
rs as (select doc_id, page, list(b order by seq) as found from ra group by doc_id, page),
st as (select doc_id, page, 1 as k, coalesce(found, []) as found from pg left join rs using (doc_id, page)
       union all
       select doc_id, page, k + 1, case when len(list_filter(list_concat(tables, found), lambda c: {_over('waiting[k]', 'c')} > {_area('waiting[k]')} * 0.5)) = 0
           and coalesce(list_sum(list_transform(texts, lambda t: {_over('t', 'waiting[k]')})), 0) <= {_area('waiting[k]')} * 0.7 then list_append(found, waiting[k]) else found end
       from st join cs using (doc_id, page) join pg using (doc_id, page) where k <= len(waiting)),
cd as (select doc_id, page, arg_max(found, k) as groups from st group by doc_id, page),
mp as (select doc_id, page, 0 as k, groups, prose from cd join pg using (doc_id, page)
       union all
       select doc_id, page, k + 1, list_transform(list_filter(range(1, len(groups) + 1), lambda n: n <> pair[2]), lambda n: case when n = pair[1] then {_hull('groups[pair[1]]', 'groups[pair[2]]')} else groups[n] end), prose
       from (select *, list_filter(flatten(list_transform(range(1, len(groups) + 1), lambda i: list_transform(range(i + 1, len(groups) + 1), lambda j: [i, j]))),
                 lambda q: {_over(_wide('groups[q[1]]', 10), 'groups[q[2]]')} > 0 and not {_HITS.format(_hull('groups[q[1]]', 'groups[q[2]]'))})[1] as pair from mp) where pair is not null),
mg as (select doc_id, page, arg_max(groups, k) as groups from mp group by doc_id, page),
fg as (select doc_id, page, unnest(range(1, len(groups) + 1)) as n, groups from mg where len(groups) > 0),
lb as (select doc_id, page, n, 1 as k, groups[n] as b, {_area('groups[n]')} * 1.5 as most, list_concat(labels, labels, labels) as l, prose from fg join pg using (doc_id, page)
       union all
       select doc_id, page, n, k + 1, case when {_over('l[k]', _wide('b', 12))} > 0 and {_area(_hull('b', 'l[k]'))} <= most and not {_HITS.format(_hull('b', 'l[k]'))} then {_hull('b', 'l[k]')} else b end, most, l, prose from lb where k <= len(l)),
gr as (select doc_id, page, n, arg_max(b, k) as b, any_value(prose) as prose from lb group by doc_id, page, n),
sd as (select *, (b[1] + b[3]) / 2 as middle, list_filter(prose, lambda p: least(b[4], p[4]) > greatest(b[2], p[2])) as beside from gr),
tr as (select *, least(b[3], coalesce(list_min(list_transform(list_filter(beside, lambda p: p[1] >= middle), lambda p: p[1])), b[3])) as r,
              greatest(b[1], coalesce(list_max(list_transform(list_filter(beside, lambda p: p[1] < middle and p[3] <= middle), lambda p: p[3])), b[1])) as l from sd)
select doc_id, page, cast(n - 1 as int) as figure, case when r - l < 60 then b[1] else l end as x0, b[2] as y0, case when r - l < 60 then b[3] else r end as x1, b[4] as y1 from tr"""


def _gap(low: int, high: int, least: float) -> str:
    """Middle of the widest stretch of at least ``least`` that no box of g covers in one direction; the first of equals."""
    spans = f"list_sort(list_transform(g, lambda e: [e.b[{low}], e.b[{high}]]))"
    gaps = f"list_transform(range(2, len(g) + 1), lambda n: [list_max(list_transform(({spans})[1:n - 1], lambda s: s[2])), ({spans})[n][1]])"
    return f"list_transform(list_sort(list_transform(list_filter({gaps}, lambda q: q[2] > q[1] and q[2] - q[1] >= {least}), lambda q: [q[1] - q[2], q[1], q[2]])), lambda q: (q[2] + q[3]) / 2)[1]"


_XY_CUT = f"""with recursive {_SCATTERED},
sm as (select doc_id, page, seq, [b[1], b[2], floor(b[1] + (b[3] - b[1]) / 4), floor(b[2] + (b[4] - b[2]) / 4)] as b from el),
ct as (select doc_id, page, '' as path, list({{'seq': seq, 'b': b}} order by seq) as g, true as fresh from sm group by doc_id, page
       union all
       select doc_id, page, path || side, list_filter(g, lambda e: (e.b[axis] < middle) = (side = 'a')), true
       from (select *, unnest(['a', 'b']) as side from (select *, case when x is not null then 1 else 2 end as axis, coalesce(x, y) as middle from (select *, {_gap(1, 3, 10.0)} as x, {_gap(2, 4, 1.0)} as y from ct where len(g) > 1)) where middle is not null)),
lf as (select doc_id, page, path, g from ct c where not exists (select 1 from ct d where d.doc_id = c.doc_id and d.page = c.page and d.path = c.path || 'a')),
le as (select doc_id, page, path, unnest(g) as e from lf)
select doc_id, page, e.seq as seq, cast(row_number() over (partition by doc_id, page order by path, e.b[2], e.b[1], e.seq) - 1 as int) as place from le"""

ORACLE_SQL = {"figure_merge": figures(_GRID), "figures_scattered": figures(_SCATTERED), "xy_cut_scattered": _XY_CUT}
