"""The dealt operators as registered queries, with their SQL for the other engine."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm import (
    decontaminate, fill_middle, html_text, line_dedup, lm_score, mixture, ngram_join, pii, quality, token_counts, topk, toxicity, whitening,
)
from jobscope.llm.common import read, remainder
from jobscope.session import as_written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query()
def op1_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), modulus=4, held_out=2)
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query(rf"""
    with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
    k as (select *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
    c as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
    select doc_id, count(*) as n_lines, count(c.key) as n_dropped,
     sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.key is null), '')) as kept_sha256
    from k left join c on k.key = c.key group by doc_id""")
def op3_line_dedup(spark, sf_dir):
    made = line_dedup.drop_common_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep=["doc_id"])
    return made.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


WORDS = "regexp_extract_all(" + LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(rf"""
    with w as (select doc_id, {WORDS} as ws from documents),
    i as (select item_id, {WORDS} as ws from benchmark),
    iw as (select distinct item_id, len(ws[p:p + 9]) as n, array_to_string(ws[p:p + 9], ' ') as win
           from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as p from i where len(ws) > 0)),
    sizes as (select distinct n from iw),
    dw as (select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') as win
           from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from w, sizes where len(ws) >= n)),
    m as (select doc_id, p, iw.n, item_id from dw join iw on dw.n = iw.n and dw.win = iw.win),
    h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from m) group by doc_id),
    g as (select doc_id, count(s) as n_items, string_agg(s, ',' order by s) as ids
          from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
    select w.doc_id, coalesce(len(ws), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
     sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from w left join h on w.doc_id = h.doc_id left join g on w.doc_id = g.doc_id""")
def op5_benchmark_decontamination(spark, sf_dir):
    made = decontaminate.mark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    return made.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size("leak.item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("leak.item_ids", ","), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


@query(r"""
    with s as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
                      md5('0:' || coalesce(cast(doc_id as varchar), '')) as ord from documents),
    t as (select source, sum(size)::double as s, row_number() over (order by encode(source) nulls last) - 1 as place from s group by source),
    w as (select source, s, ([5.0, 2.0, 1.0]::double[])[1 + place % 3] as w, 2 * s as cap, 1.5 * sum(s) over () as total from t),
    o as (select *, row_number() over (order by cap / w, source) as k from w),
    c as (select *, coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0) as held,
                    sum(w) over (order by k rows between current row and unbounded following) as free from o),
    f as (select k, held, free, total from c where w * (total - held) / free <= cap order by k limit 1),
    g as (select c.source, c.s, case when f.k is null or c.k < f.k then cap else c.w * (f.total - f.held) / f.free end as target
          from c left join f on true),
    n as (select s.*, g.s as ss, target, case when g.s > 0 then floor(target / g.s) else 0 end as whole,
           sum(size) over (partition by s.source order by ord, size rows unbounded preceding) - size as before
          from s join g on s.source is not distinct from g.source)
    select doc_id, cast(size as bigint) as size, cast(ss as bigint) as source_size, target,
     cast(whole * size + greatest(0, least(size, round(target - whole * ss) - before)) as bigint) as taken from n""")
def op7_source_mixture(spark, sf_dir):
    made = mixture.mix(read(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5, max_epochs=2)
    return made.select("doc_id", "size", "source_size", "target", "taken")


@query(rf"""
    with recursive w as (select doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') as ws from documents),
    s as (select distinct doc_id, array_to_string(ws[p:p + 2], ' ') as g
          from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) as p from w where len(ws) > 0)),
    z as (select doc_id, count(*) as n from s group by doc_id),
    l as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
          join z za on za.doc_id = a.doc_id join z zb on zb.doc_id = b.doc_id
          group by all having 100 * count(*) >= 90 * (any_value(za.n) + any_value(zb.n) - count(*))),
    r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
    c as (select a, min(b) as component_id from r group by a)
    select doc_id, coalesce(n, 0) as n_shingles, component_id
    from documents left join z using (doc_id) join c on c.a = doc_id""")
def op10_ngram_jaccard(spark, sf_dir):
    return ngram_join.linked_documents(read(spark, sf_dir, "documents"), n=3, percent=90)


@query("""
    with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
               where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
    s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
          from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 20""")
def op6_exact_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


@query()
def op4_lm_score(spark, sf_dir):
    return lm_score.score(read(spark, sf_dir, "documents"), modulus=7, held_out=2)


@query()
def op8_html_text(spark, sf_dir):
    made = html_text.main_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return made.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query()
def op9_pii_surrogates(spark, sf_dir):
    made = pii.replace(read(spark, sf_dir, "documents"), key="a key of this query", keep=["doc_id"])
    return made.select("doc_id", "safe.n_mentions", "safe.n_entities", F.array_join("safe.kinds", ",").alias("kinds"), "safe.text")


def three_edits(text: Column) -> Column:
    """Edits of every text: one replaces a stretch, one inserts a paragraph, one deletes."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("bigint")

    def one(start: Column, end: Column, replacement: str) -> Column:
        return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(replacement).alias("replacement"))

    return F.when(
        n > 0,
        F.array(one(quarter, quarter + 12, "[edited] "), one(2 * quarter, 2 * quarter, "\n\nA new paragraph, 42 words.\n\n"), one(3 * quarter, 3 * quarter + 20, "")),
    )


@query()
def op2_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = token_counts.count_trees(docs, ranks, pattern, keep=["doc_id", "text"])
    made = token_counts.apply_edits(trees, three_edits(F.col("text")), ranks, pattern, keep=["doc_id", "tree"])
    return made.select(
        "doc_id", "tree.n_tokens", F.col("edited.tree.n_tokens").alias("n_tokens_edited"), F.col("edited.n_encoded").alias("n_encoded"),
        F.coalesce(F.char_length("edited.text"), F.lit(0)).cast("bigint").alias("n_chars_edited"),
    )


@query()
def op11_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    described = as_written(quality.describe(docs, keep=["doc_id"]), "statistics")
    model = quality.train(described, read(spark, sf_dir, "labels"), modulus=3, held_out=1)
    return quality.score(described, model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query(r"""
    with u as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as us,
                      sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
    d as (select *, len(us) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
                 cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from u),
    c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
                      when h4 % 100 < 50 then 'spm' else 'psm' end as form from d),
    p as (select *, array_to_string(us[1:a], '') as p, array_to_string(us[a + 1:b], '') as m, array_to_string(us[b + 1:n], '') as s from c)
    select doc_id, cast(n as bigint) as n, form,
     case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
     sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
     sha256(text) as restored_sha256 from p""")
def op12_fill_in_middle(spark, sf_dir):
    made = fill_middle.transform(read(spark, sf_dir, "documents"), keep=["doc_id"], seed=7, rate=100, spm_rate=50)
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.text", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("fim.text"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


@query()
def op13_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=32, scale=64.0)
