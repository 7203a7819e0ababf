"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of


#: Key of the pseudonyms that the registered queries make. A real run brings its own.
PII_KEY = "registered-query-key"


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the package that holds them is outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents."""
    from .quality import judged

    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc.doc_id", *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "rule")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written as mail that quotes, back in reply order."""
    from .quotes import quoting, replies

    out = replies(quoting(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "n_quotes", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", "position", F.sha2(F.col("own").cast("binary"), 256).alias("own_sha256"))


OP2_SQL = """
with m as (select conv_id, turn, role, coalesce(text, '') as text,
                  trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) <> '' as says from conversations),
l as (select *, coalesce(lag(says, 1) over w, false) as p1, coalesce(lag(says, 2) over w, false) as p2,
             lag(turn) over w as before
      from m window w as (partition by conv_id order by turn)),
r as (select *, max(case when not p1 then turn end) over (partition by conv_id order by turn) as root from l),
d as (select *, row_number() over (partition by conv_id, root order by turn) - 1 as depth from r)
select conv_id, turn, role, cast(p1 as bigint) + cast(p2 as bigint) as n_quotes,
       cast(p1 as bigint) + cast(p2 as bigint) as n_linked,
       case when p1 then conv_id end as parent_conv, case when p1 then before end as parent_turn,
       conv_id as thread_conv, root as thread_turn, depth, depth as position, sha256(text) as own_sha256
from d
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of all documents: one row per piece."""
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85."""
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP4_SQL = """
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[p:p + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select l.a, l.b from l join n x on l.a = x.doc_id join n y on l.b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d join c on d.doc_id = c.doc_id left join n on d.doc_id = n.doc_id
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts that they decode to, as digests."""
    from .bpe import encode

    both = encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), with_text=True)
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a Katz model of most of them."""
    from .katz import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, and the number of values replaced by kind."""
    from .pii import KINDS, pseudonymised

    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, any_area=True)
    return out.select("doc.doc_id", "text", *[F.col(f"found.{k}").alias(f"n_{k}") for k in KINDS])


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated windows of twenty words."""
    from .substrings import without_repeats

    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(words_of(F.col("text")), " ")
    return out.select("doc.doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p from d),
v as (select doc_id, p, array_to_string(words[p:p + 19], ' ') as run
      from (select doc_id, words, unnest(range(1, len(words) - 18)) as p from d where len(words) >= 20)),
f as (select doc_id, p from (select doc_id, p, row_number() over (partition by run order by doc_id, p) as n from v) where n > 1),
g as (select distinct doc_id, p + i as p from f, range(20) t(i)),
k as (select w.doc_id, count(g.p) as n_removed, coalesce(string_agg(w.word, ' ' order by w.p) filter (where g.p is null), '') as kept
      from w left join g on w.doc_id = g.doc_id and w.p = g.p group by w.doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector."""
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
with u as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
           from embeddings where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select * from u qualify row_number() over (partition by vec_id order by len(v), v) = 1),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
             cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archive records, the revisits among them resolved."""
    from .revisits import captures, resolved

    out = resolved(captures(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    return out.select("record_id", "canonical_url", "ts", "status", "refers_to", F.size(F.map_keys("headers")).cast("long").alias("n_headers"), h["etag"].alias("etag"), h["date"].alias("date"), h["content-length"].alias("content_length"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


OP10_SQL = """
with p as (select page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare,
                  '"' || md5(coalesce(html, '')) || '"' as tag from pages),
h as (select *, regexp_extract(bare, '^[^/?]*') as host from p),
s as (select *, bare[len(host) + 1:] as rest from h),
c as (select page_id, html, tag,
             regexp_replace(regexp_replace(lower(host), ':(80|443)$', ''), '^www[.]', '')
             || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') as base,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
               lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=|$)'))), '&') as query from s),
k as (select page_id, html, tag, base || case when query <> '' then '?' || query else '' end as canonical_url,
             page_id * 600 as at, case when page_id % 11 = 0 then page_id * 600 - 1 else page_id * 600 + 300 end as later from c),
v as (select r.page_id as rid, r.canonical_url, r.later, o.page_id as oid, o.html, o.tag as otag, o.at,
             case when r.page_id % 5 = 0 then '"changed"' else r.tag end as rtag
      from k r asof left join (select * from k where html is not null) o on r.canonical_url = o.canonical_url and r.later > o.at)
select rid * 2 + 1 as record_id, canonical_url, later as ts,
       case when oid is null then 'no-original' when rtag = otag then 'resolved' else 'mismatch' end as status,
       case when rtag = otag then oid * 2 end as refers_to,
       cast(case when rtag = otag then 4 else 3 end as bigint) as n_headers,
       case when rid % 5 = 0 then rtag else 'W/' || rtag end as etag, cast(later as varchar) as date,
       case when rtag = otag then cast(strlen(html) as varchar) else '0' end as content_length,
       case when rtag = otag then sha256(html) end as body_sha256
from v
"""

def op11_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    from .kernel import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every hundredth vector."""
    from .negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"), relabelled=7)


OP12_SQL = """
with u as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
                  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select * from u qualify row_number() over (partition by vec_id order by len(v), v, label) = 1),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
             cast(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
      from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id,
       cast(row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as int) as rank,
       n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on p.anchor_id = n.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the commoner words that they are likely to stand for."""
    from .variants import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op2_quotation_linking": op2_quotation_linking, "op10_revisits": op10_revisits, "op1_quality_rules": op1_quality_rules, "op3_packing": op3_packing, "op4_minhash": op4_minhash, "op5_bpe": op5_bpe, "op6_substrings": op6_substrings, "op7_exact_topk": op7_exact_topk, "op8_katz": op8_katz, "op9_pii": op9_pii, "op11_kernel_quality": op11_kernel_quality, "op12_hard_negatives": op12_hard_negatives, "op13_variants": op13_variants}
ORACLE_SQL = {"op4_minhash": OP4_SQL, "op6_substrings": OP6_SQL, "op2_quotation_linking": OP2_SQL, "op10_revisits": OP10_SQL, "op7_exact_topk": OP7_SQL, "op12_hard_negatives": OP12_SQL}
