"""The registered queries of this package and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, language, mixing, near_dedup, packing, phrase_dedup, prefix_trie, suffix_dedup, token_file, url_filter, whitening, winnowing
from .common import documents, new_path

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end=1)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.filter("vec_id % 50 = 0"))


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeated(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(documents(spark, sf_dir))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.learn_and_identify(documents(spark, sf_dir))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    files = token_file.write_tokens(documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"), end=0)
    return token_file.read_tokens(spark, folder, files)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.filter_urls(documents(spark, sf_dir, "pages"), rules)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle_words=4)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(documents(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(documents(spark, sf_dir, "conversations"))


_ALL = (op1_mixing, op2_ann, op3_phrase_dedup, op4_language, op5_suffix_dedup, op6_token_file, op7_exact_dedup, op8_url_filter, op9_near_dedup, op10_packing, op11_whitening, op12_decontamination, op13_prefix_trie)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {
    "op1_mixing": r"""
with s as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) k,
    case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end :: bigint as size from documents),
src as (select source, sum(size)::bigint source_size from s group by source),
r as (select *, row_number() over (order by source nulls last) - 1 place from src),
w as (select *, case place % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end :: double weight from r),
f as (select *, source_size::double * 4 * sum(weight) over (order by source_size / weight, place rows between current row and unbounded following)
    <= (3 * sum(source_size) over ())::double * weight - weight * 4 * coalesce(sum(source_size) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0)::double full_ from w),
t as (select *, case when full_ then source_size::double * 2 else
    (3 * sum(source_size) over () - 4 * sum(case when full_ then source_size else 0 end) over ())::double * weight / (sum(case when full_ then 0.0::double else weight end) over () * 2) end target from f),
l as (select s.doc_id, s.size, t.source_size, t.target, t.place,
    coalesce(sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint ahead
    from s join t on s.source is not distinct from t.source),
p as (select *, floor(target + 0.5)::bigint goal, ahead::double / target u from l),
q as (select *, greatest(0, least(size, goal - ahead)) c0, greatest(0, least(size, goal - (ahead + source_size))) c1 from p)
select doc_id, size, source_size, target, (c0 + c1)::bigint taken,
  case when c0 > 0 then round(least(case place % 3
    when 0 then (sqrt(greatest(0.0::double, (u * 5.0::double) * (-8.0::double) + 49.0::double)) - 7.0::double) / (-4.0::double)
    when 1 then u * 2.0::double / 2.0::double
    else (sqrt(greatest(0.0::double, (u * 1.0::double) * 2.0::double + 0.25::double)) - 0.5::double) / 1.0::double end, 1.0::double), 9) end as position
from q""",
    "op7_exact_dedup": r"""
with n as (select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
  row_number() over w = 1 as kept, sha256(norm) as text_sha256
from n window w as (partition by norm order by n desc, doc_id nulls last)""",
    "op8_url_filter": r"""
with u as (select page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) h, regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) path from pages),
p as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from u),
r as (select *, case
  when ('.' || host) like '%.example.com' and path like '/en/7%' then 'example.com/en/7'
  when ('.' || host) like '%.example.net' and path like '/de/8%' then 'example.net/de/8'
  when ('.' || host) like '%.com' and path like '/en/%' then 'com/en/'
  when ('.' || host) like '%.net' and path like '/de/%' then 'net/de/'
  when ('.' || host) like '%.org' and path like '/es/%' then 'org/es/' end as rule from p)
select page_id, host, path, rule, case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' else 'allow' end as verdict from r""",
    "op12_decontamination": r"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select coalesce(item_id::varchar, '') item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
j as (select item, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) k from i where len(w) > 0),
iw as (select distinct item, n, array_to_string(w[k:k + n - 1], ' ') g from j),
x as (select r, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from iw)),
hit as (select r, k, x.n, item from x join iw on iw.n = x.n and iw.g = array_to_string(w[k:k + x.n - 1], ' ')),
c as (select r, count(distinct p) n_hit from (select r, unnest(range(k, k + n)) p from hit) group by r),
s as (select r, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct r, item from hit) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c on c.r = d.r left join s on s.r = d.r""",
    "op13_prefix_trie": r"""
with t as (select conv_id c, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 i from conversations where conv_id is not null),
o as (select c, count(*) n from t group by c),
b as (select c, n, c - c % 100 base, list_reduce(list_prepend(4294967295::bigint, flatten([[((ord(y) >> z) & 1)::bigint for z in range(0, 8)] for y in string_split(c::varchar, '')])), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))) crc from o),
v as (select b.c, b.base, xor(crc, 4294967295) % 6 h, least(xor(crc, 4294967295) % 6, coalesce(o.n, 0)) m from b left join o on o.c = b.base),
r as (select v.c, t.i pos, role, text from v join t on t.c = v.base where t.i < v.h union all select v.c, v.m + t.i - v.h, role, text from v join t on t.c = v.c where t.i >= v.h),
l as (select c, list(md5(length(role) || ':' || role || text) order by pos) m, list(length(text) order by pos) z from r group by c),
q as (select v.c, coalesce(l.m, []) m, coalesce(l.z, []) z from v left join l on l.c = v.c),
p as (select c, m, z, unnest(range(0, len(m) + 1)) depth from q),
nd as (select depth, coalesce(array_to_string(m, ''), '') k, min(c) conv_id, count(*) n_convs, coalesce(max(z[depth]), 0) chars
  from (select c, z, depth, m[1:depth] m from p) group by 1, 2),
e as (select depth - 1 as depth, left(k, 32 * (depth - 1)::int) k, count(*) n_children from nd where depth > 0 group by 1, 2),
f as (select nd.*, coalesce(e.n_children, 0) n_children from nd left join e on e.depth = nd.depth and e.k = nd.k),
g as (select a depth, left(k, 32 * a::int) k, sum((n_children = 0)::int)::bigint n_leaves, sum((n_convs - 1) * chars)::bigint saved_tokens from (select *, unnest(range(0, depth + 1)) a from f) group by 1, 2),
w as (select coalesce(array_to_string(m, ''), '') k, string_agg(c::varchar, ',' order by c) ends from q group by 1)
select f.conv_id, f.depth, up.conv_id parent_conv_id, f.n_convs, f.n_children, g.n_leaves, g.saved_tokens, sha256(coalesce(w.ends, '')) ends_sha256
from f join g on g.depth = f.depth and g.k = f.k left join nd up on up.depth = f.depth - 1 and up.k = left(f.k, 32 * greatest(0, f.depth - 1)::int) left join w on w.k = f.k""",
}
