"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS.format('text')} as w from documents),
 b as (select cast(item_id as varchar) as item, {_WORDS.format('text')} as w from benchmark),
 bw as (select item, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i, w from b where len(w) > 0),
 win as (select distinct item, m, list_slice(w, i, i + m - 1) as k from bw),
 spots as (select rid, m, w, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from win) where len(w) >= m),
 dw as (select rid, m, i, list_slice(w, i, i + m - 1) as k from spots),
 h as (select rid, i, m, item from dw join win using (m, k)),
 x as (select distinct rid, unnest(range(i, i + m)) as x from h),
 y as (select rid, min(x) - 1 as a, max(x) as b from (select rid, x, x - row_number() over (partition by rid order by x) as g from x) group by rid, g),
 p as (select rid, cast(sum(b - a) as bigint) as n_hit, string_agg(a || ':' || b, ',' order by a) as hit_spans from y group by 1),
 s as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct rid, item from h) group by 1),
 term as materialized (select k, off, k[off] as t from (select k, unnest(range(1, m + 1)) as off from (select distinct m, k from win))),
 post as materialized (select rid, t, i from (select rid, unnest(w) as t, unnest(range(1, len(w) + 1)) as i from d) semi join term using (t)),
 df as (select t, count(*) as n from post group by 1),
 rank as materialized (select term.*, row_number() over (partition by k order by n nulls first, off) as r from term left join df using (t)),
 c0 as materialized (select distinct rid, k, i - off + unnest(range(-2, 3)) as st from rank join post using (t) where r = 1),
""" + "".join(f" c{r - 1} as materialized (select * from c{r - 2} semi join (select distinct rid, k, i - off + unnest(range(-2, 3)) as st from rank join post using (t) join (select distinct rid, k from c{r - 2}) using (rid, k) where r = {r}) using (rid, k, st)" + (f" union all select * from c{r - 2} where len(k) < {r})" if r > 1 else ")") + ",\n" for r in range(2, 11)) + f"""
 near as (select rid, count(*) as n_near from (select distinct rid, item from c9 join win using (k) where item is not null except select rid, item from h) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near, coalesce(hit_spans, '') as hit_spans
from d left join p using (rid) left join s using (rid) left join near using (rid)
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark, sf):
    from inkspan.llm import positional

    items = table(spark, sf, "benchmark")
    found = positional.search(positional.build_index(table(spark, sf, "documents"), items), items)
    spans = F.array_join(F.transform("hit_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", spans.alias("hit_spans"))


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name=TOKENIZER):
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_bpe")
def op9(spark, sf):
    from inkspan.llm import bpe

    return bpe.round_trip(table(spark, sf, "documents"), tokenizer_path())


@query("op6_toxicity")
def op6(spark, sf):
    from inkspan.llm import toxicity

    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query("op7_quality")
def op7(spark, sf):
    from inkspan.llm import quality

    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf, "labels")))


@query("op8_language")
def op8(spark, sf):
    from inkspan.llm import langid

    docs = table(spark, sf, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op4_pii")
def op4(spark, sf):
    from inkspan.llm import pii

    return pii.report(table(spark, sf, "documents"))


@query("op5_url_filter")
def op5(spark, sf):
    from inkspan.llm import url_filter

    return url_filter.judge(table(spark, sf, "pages"), url_filter.fit(url_filter.labelled(spark)))


_TURN = "'<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10)"
_SPAN = "(began + length('<|im_start|>' || role) + 1)::varchar || ':' || (began + length('<|im_start|>' || role) + 1 + length(body) + 10)::varchar"

OP10_SQL = f"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, replace(replace(coalesce(text, ''), '<|im_start|>', '<||im_start||>'), '<|im_end|>', '<||im_end||>') as body from conversations where conv_id is not null),
 n as (select conv_id, cast((conv_id - (conv_id % 2 + 2) % 2) // 2 as bigint) as pair_id, conv_id % 2 = 0 as is_chosen, role, body, row_number() over (partition by conv_id order by turn nulls first, role, body) as i from t),
 pair as (select c.pair_id, c.i, c.role = r.role and c.body = r.body as same from n c join n r on c.pair_id = r.pair_id and c.i = r.i and c.is_chosen and not r.is_chosen),
 pre as (select pair_id, coalesce(min(i) filter (not same) - 1, max(i)) as n_prefix from pair group by 1),
 m as (select n.*, coalesce(n_prefix, 0) as n_prefix from n left join pre using (pair_id)),
 k as (select *, coalesce(sum(length({_TURN})) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) as began from m where i > n_prefix),
 s as (select pair_id, is_chosen, count(*) as n, string_agg({_TURN}, '' order by i) as said, coalesce(string_agg({_SPAN}, ',' order by i) filter (role = 'assistant'), '') as mask from k group by 1, 2),
 h as (select pair_id, bool_or(is_chosen) as has_c, bool_or(not is_chosen) as has_r, max(n_prefix) as n_prefix, coalesce(string_agg({_TURN}, '' order by i) filter (is_chosen and i <= n_prefix), '') as prompt from m group by 1)
select h.pair_id, n_prefix, prompt, case when has_c then coalesce(c.n, 0) end as n_chosen, case when has_c then coalesce(c.said, '') end as chosen, case when has_c then coalesce(c.mask, '') end as chosen_mask,
 case when has_r then coalesce(r.n, 0) end as n_rejected, case when has_r then coalesce(r.said, '') end as rejected, case when has_r then coalesce(r.mask, '') end as rejected_mask
from h left join s c on c.pair_id = h.pair_id and c.is_chosen left join s r on r.pair_id = h.pair_id and not r.is_chosen
"""


@query("op10_preference", OP10_SQL)
def op10(spark, sf):
    from inkspan.llm import preference

    return preference.format_pairs(table(spark, sf, "conversations"))


@query("op2_near_copies")
def op2(spark, sf):
    from inkspan.llm import bagminhash

    return bagminhash.groups(table(spark, sf, "documents"))


@query("op1_embedding_links")
def op1(spark, sf):
    from inkspan.llm import multi_index

    return multi_index.links(table(spark, sf, "embeddings"))


OP11_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 13) as bigint) as draw from documents),
 s as (select source, cast(sum(size) as bigint) as n, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source),
 o as (select *, sum(n) over () as total, coalesce(sum(3 * n) over b, 0) as stopped, sum(w) over () - coalesce(sum(w) over b, 0) as free, row_number() over (order by n * 6 // w, source nulls last) as i
  from s window b as (order by n * 6 // w, source nulls last rows between unbounded preceding and 1 preceding)),
 c as (select arg_min(total - stopped, i) as rest, arg_min(free, i) as free from o where 3 * n * free >= (total - stopped) * w),
 r as (select source, n, case when 3 * n * free < rest * w then 3.0::double * n else least(w::double * (rest::double / free::double), 3.0::double * n) end as target from s, c),
 t as (select *, case when n > 0 then target / n::double else 0 end as rate from r)
select doc_id, size, n as source_size, target, cast(size * (floor(rate) + case when draw < (rate - floor(rate)) * 4503599627370496.0::double then 1 else 0 end) as bigint) as taken
from d join t on d.source is not distinct from t.source
"""


@query("op11_mixing", OP11_SQL)
def op11(spark, sf):
    from inkspan.llm import mixing

    return mixing.plan(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _lloyd_sql(rounds=6):
    """Parts, then codebooks and assignments round by round, one common table each."""
    nearest = "arg_min(e, struct_pack(d := d, e := e)) as e, min(d) as d from (select k, p, e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v join b{r} b using (p)) group by k, p"
    sql = """
with recursive t as (select row_number() over (order by vec_id nulls last, embedding) as k, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * x::double) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 v as materialized (select k, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] as x from t, (select unnest(range(8)) as p)),
 b0 as materialized (select p, k - 1 as e, x from v where k <= 16)"""
    for r in range(rounds + 1):
        sql += f",\n a{r} as materialized (select k, p, {nearest.format(r=r)})"
        if r < rounds:
            sql += f""",
 s{r} as (select p, e, j, sum(x) as n, count(*) as c from (select a.p, a.e, unnest(v.x) as x, unnest(range(len(v.x))) as j from a{r} a join v using (k, p)) group by 1, 2, 3),
 b{r + 1} as materialized (select b.p, b.e, coalesce(any_value(m.x), any_value(b.x)) as x from b{r} b left join (select p, e, list(cast(floor(n / c) as bigint) order by j) as x from s{r} group by 1, 2) m on b.p = m.p and b.e = m.e group by 1, 2)"""
    return sql + f""",
 c as (select k, string_agg('0' || format('{{:x}}', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by 1),
 h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from t join c using (k), h
"""


@query("op12_vector_codes", _lloyd_sql())
def op12(spark, sf):
    from inkspan.llm import vector_codes

    return vector_codes.encode(table(spark, sf, "embeddings"))


def with_periods(words, doc_id):
    """A tenth of the documents, by their id, end in words that repeat with a period that the id gives."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


@query("op13_periodic_runs")
def op13(spark, sf):
    from inkspan.llm import periodic_runs

    return periodic_runs.report(table(spark, sf, "documents"), with_periods)


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
