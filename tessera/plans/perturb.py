"""Perturbation queries (B1-B15) on the F8 fixture: F1 token entropies as
context units, N = 3 masks per unit sequence, hashed mask candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.functions.hashing import hash32, hash_u
from tessera.operators import perturb as B
from tessera.operators.by_name import apply_metric
from tessera.operators.segments import segment_steps
from tessera.operators.words import BLANK_CLASS
from tessera.plans.fixtures import f1_sequences, f2_prompts, qa_pairs
from tessera.plans.tokens import _f1_sql
from tessera.session import materialize

N_MASKS = 3
SEED = 42


def f8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = f1_sequences(spark, sf_dir)
    units = seq.select("eval_id", F.inline_outer(M.token_entropy(F.col("steps"))))
    return units.where(F.col("index").isNotNull())


def f8_candidates(ranked: DataFrame) -> DataFrame:
    """Stand-in fill-mask output: 5 candidates per mask; a candidate is
    blank when ``h('blank', eval, mask, c) % 7 = 0``; scores are hashed and
    normalised to sum to 1 per mask."""
    mw = Window.partitionBy("eval_id", "masked").orderBy("index")
    masks = ranked.where("masked").withColumn("mask_no", F.row_number().over(mw) - 1)
    c = masks.select("eval_id", "mask_no", F.explode(F.sequence(F.lit(0), F.lit(B.TOP_K - 1))).alias("cand_no"))
    hb = hash32(F.lit("blank"), F.col("eval_id"), F.col("mask_no"), F.col("cand_no"))
    raw = hash_u(F.lit("cand"), F.col("eval_id"), F.col("mask_no"), F.col("cand_no"))
    c = c.withColumn("token_str", F.when(hb % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" w"), (hb % 1000).cast("string"))))
    c = c.withColumn("raw", raw)
    return c.withColumn("score", F.col("raw") / F.sum("raw").over(Window.partitionBy("eval_id", "mask_no"))).drop("raw")


def q_mask_top_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = B.rank_units(f8_units(spark, sf_dir), "eval_id", N_MASKS)
    t = B.masked_texts(ranked, "eval_id")
    return t.select(
        F.col("eval_id").cast("bigint"), "masked_text",
        F.array_join(F.transform("masked_idx", lambda i: i.cast("string")), ",").alias("masked_idx"),
    )


def q_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = B.rank_units(f8_units(spark, sf_dir), "eval_id", N_MASKS)
    ch = B.sentence_chunks(B.masked_texts(ranked, "eval_id"), "eval_id")
    return ch.select(
        F.col("eval_id").cast("bigint"), F.col("chunk_no").cast("bigint"), "text",
        F.col("n_words").cast("bigint"), F.col("n_masks").cast("bigint"),
    )


def q_inverse_prob_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = B.rank_units(materialize(f8_units(spark, sf_dir)), "eval_id", N_MASKS)
    d = B.inverse_prob_draws(f8_candidates(ranked), "eval_id", SEED)
    return d.select(F.col("eval_id").cast("bigint"), F.col("mask_no").cast("bigint"), "draw")


def q_perturb_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The units are read by the masking and the candidate branches: persist
    # them once, as the reference persists its scores table between stages.
    units = materialize(f8_units(spark, sf_dir))
    ranked = B.rank_units(units, "eval_id", N_MASKS)
    ptb = B.perturb(units, f8_candidates(ranked), "eval_id", N_MASKS, seed=SEED)
    merged = B.merge_perturbed(qa_pairs(spark, sf_dir), ptb, "eval_id")
    return merged.select(
        F.col("eval_id").cast("bigint"), "context",
        F.array_join(
            F.transform(F.map_entries("change_set"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"])),
            ";",
        ).alias("change_set"),
    )


def q_prompt_perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over the perturbed context; the passage is the fallback
    when a row has no perturbed context (SURVEY Q7)."""
    from tessera.operators.prompts import context_prompts
    from tessera.sources.tables import read_table

    units = materialize(f8_units(spark, sf_dir))
    ranked = B.rank_units(units, "eval_id", N_MASKS)
    ptb = B.perturb(units, f8_candidates(ranked), "eval_id", N_MASKS, seed=SEED).select("eval_id", "context")
    qa = qa_pairs(spark, sf_dir).join(ptb, "eval_id", "left")
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("passage_id"), F.col("text").alias("passage")
    )
    out = context_prompts(qa, docs, context_col="context")
    return out.select(F.col("eval_id").cast("bigint"), "ok", "prompt")


def context_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the context segment of the F2 prompts: what the scores file
    of the token entropy holds for them."""
    seg = segment_steps(f2_prompts(spark, sf_dir).where(F.col("ok")), clustered=True)
    units = apply_metric(seg, M.TOKEN_ENTROPY).where(F.col("segment") == "context")
    return units.select("eval_id", F.col("idx").cast("int").alias("index"), "text_unit", "value")


def candidate_cache(calls: DataFrame) -> DataFrame:
    """Stand-in for a table of earlier fill-mask results, by chunk text: five
    candidates per mask as in F8, keyed by the text's digest; one text in
    thirteen is missing (its call fails), and in one of five with several
    masks the last mask has no candidates."""
    c = calls.select("text", "n_masks").distinct().withColumn("d", F.md5("text"))
    c = c.where(hash32(F.lit("fail"), F.col("d")) % 13 != 0)
    got = F.col("n_masks") - F.when((F.col("n_masks") > 1) & (hash32(F.lit("part"), F.col("d")) % 5 == 0), 1).otherwise(0)

    def mask(j: Column) -> Column:
        def raw(k: Column) -> Column:
            return hash_u(F.lit("cand"), F.col("d"), j, k)

        numbers = F.sequence(F.lit(0), F.lit(B.TOP_K - 1))
        total = F.aggregate(numbers, F.lit(0.0), lambda s, k: s + raw(k))

        def one(k: Column) -> Column:
            hb = hash32(F.lit("blank"), F.col("d"), j, k)
            token = F.when(hb % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" w"), (hb % 1000).cast("string")))
            return F.struct(token.alias("token_str"), (raw(k) / total).alias("score"))

        return F.transform(numbers, one)

    return c.select("text", F.transform(F.sequence(F.lit(0), got - 1), mask).alias("masks"))


def _context_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units = materialize(context_units(spark, sf_dir))
    return units, materialize(B.mask_calls(B.rank_units(units, "eval_id", N_MASKS), "eval_id"))


def q_mask_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of the context chain (chunks with masks only) and which of them failed."""
    _, calls = _context_calls(spark, sf_dir)
    filled = B.fill_with_table(calls, candidate_cache(calls), "eval_id")
    return filled.select(
        F.col("eval_id").cast("bigint"), F.col("chunk_no").cast("bigint"), F.col("first_mask").cast("bigint"),
        F.col("n_masks").cast("bigint"), F.coalesce(F.size("masks"), F.lit(0)).cast("bigint").alias("n_answers"), "ok", "error",
    ).withColumn("n_answers", F.when(F.col("ok"), F.col("n_answers")).otherwise(0))


def q_mask_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks -> scorer -> candidates per mask of the whole context."""
    _, calls = _context_calls(spark, sf_dir)
    c = B.mask_candidates(B.fill_with_table(calls, candidate_cache(calls), "eval_id"), "eval_id")
    return c.select(
        F.col("eval_id").cast("bigint"), F.col("mask_no").cast("bigint"), F.col("cand_no").cast("bigint"), "token_str",
        F.round("score", 6).alias("score"),
    )


def q_perturb_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B15 and E3 over the context segment: the perturbed context of each
    F2 row, its change set, and the prompt over it (the passage where the
    call failed)."""
    from tessera.operators.prompts import context_prompts
    from tessera.sources.tables import read_table

    units = context_units(spark, sf_dir)
    ptb, status = B.perturb_with_model(units, lambda c: B.fill_with_table(c, candidate_cache(c), "eval_id"), "eval_id", N_MASKS, seed=SEED)
    rows = f2_prompts(spark, sf_dir).where(F.col("ok")).select("eval_id", F.col("passage_id").cast("string").alias("passage_id"), "question")
    merged = B.merge_perturbed(rows, ptb, "eval_id").join(status.select("eval_id", F.col("ok").alias("filled"), F.col("error").alias("why")), "eval_id", "left")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("passage_id"), F.col("text").alias("passage"))
    out = context_prompts(merged, docs, context_col="context")
    return out.select(
        F.col("eval_id").cast("bigint"), "filled", "why", F.md5("context").alias("context_md5"),
        F.array_join(
            F.transform(F.map_entries("change_set"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"])), ";"
        ).alias("change_set"),
        F.md5("prompt").alias("prompt_md5"),
    )


QUERIES = {
    "mask_calls": q_mask_calls,
    "mask_candidates": q_mask_candidates,
    "perturb_context": q_perturb_context,
    "prompt_perturbed": q_prompt_perturbed,
    "mask_top_units": q_mask_top_units,
    "sentence_chunks": q_sentence_chunks,
    "inverse_prob_draw": q_inverse_prob_draw,
    "perturb_join": q_perturb_join,
}


# From mt(eval_id, masked_text) to ch(eval_id, chunk, text, n_words); needs "with recursive".
_CHUNK_SQL = f"""
sp as (select eval_id, string_split(masked_text, '.') as parts from mt),
sp2 as (select eval_id, unnest(parts) as p, unnest(range(len(parts))) as k, len(parts) as np from sp),
sents as (
  select eval_id, k, case when k < np - 1 then p || '.' else p end as s from sp2
),
sn as (
  select eval_id, s, row_number() over (partition by eval_id order by k) - 1 as i,
         len(list_filter(regexp_split_to_array(s, '[{BLANK_CLASS}]+'), lambda x: x <> '')) as w
  from sents where s <> ''
),
rec as (
  select eval_id, i, w as cur, 0 as chunk from sn where i = 0
  union all
  select sn.eval_id, sn.i,
         case when rec.cur + sn.w >= 200 then sn.w else rec.cur + sn.w end,
         case when rec.cur + sn.w >= 200 then rec.chunk + 1 else rec.chunk end
  from rec join sn on sn.eval_id = rec.eval_id and sn.i = rec.i + 1
),
ch as (
  select sn.eval_id, rec.chunk, string_agg(sn.s, '' order by sn.i) as text, sum(sn.w) as n_words
  from sn join rec using (eval_id, i) group by sn.eval_id, rec.chunk
)"""

# From cands2(eval_id, mask_no, cand_no, token_str, score), rk and masks to ptb.
_DRAW_SQL = f"""cb as (
  select *, regexp_replace(token_str, '^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+$', '', 'g') = '' as blank from cands2
),
cb2 as (
  select *, max((not blank)::INT) over (partition by eval_id, mask_no) as anyv,
            min(cand_no) over (partition by eval_id, mask_no) as firstc
  from cb
),
kept as (
  select * from cb2 where (anyv = 1 and not blank) or (anyv = 0 and cand_no = firstc)
),
kw as (
  select *, sum(1.0 - score) over (partition by eval_id, mask_no) as tot,
            count(*) over (partition by eval_id, mask_no) as n
  from kept
),
kw2 as (
  select *, case when tot > 0 then (1.0 - score) / tot else 1.0 / n end as w from kw
),
kw3 as (
  select *, sum(w) over (partition by eval_id, mask_no order by cand_no rows between unbounded preceding and current row) as cum,
            sum(w) over (partition by eval_id, mask_no) as wsum,
            ('0x' || substr(md5(concat_ws('|', '42', eval_id, mask_no)), 1, 8))::BIGINT / 4294967296.0 as u
  from kw2
),
draws as (
  select eval_id, mask_no,
         regexp_replace(arg_min(token_str, cand_no), '^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+$', '', 'g') as draw
  from kw3 where cum / wsum > u group by eval_id, mask_no
),
applied as (
  select r.eval_id, r.pos, r.tok, r.masked, d.draw
  from rk r left join masks m on m.eval_id = r.eval_id and m.pos = r.pos
  left join draws d on d.eval_id = m.eval_id and d.mask_no = m.mask_no
),
ptb as (
  select eval_id,
         string_agg(case when masked then coalesce(draw, '<mask>') else tok end, '' order by pos) as context,
         coalesce(string_agg(cast(pos as varchar) || ':' || draw, ';' order by pos) filter (where masked and draw is not null), '') as change_set,
         count(*) filter (where masked) as n_m, count(*) filter (where masked and draw is not null) as n_d
  from applied group by eval_id
)
"""


def _f8_sql() -> str:
    return _f1_sql() + f""",
rk as (
  select eval_id, pos, tok, h, row_number() over (partition by eval_id order by h desc, pos asc) <= {N_MASKS} as masked
  from ent
),
mt as (
  select eval_id, string_agg(case when masked then '<mask>' else tok end, '' order by pos) as masked_text,
         coalesce(string_agg(cast(pos as varchar), ',' order by pos) filter (where masked), '') as masked_idx
  from rk group by eval_id
),
masks as (
  select eval_id, pos, row_number() over (partition by eval_id order by pos) - 1 as mask_no from rk where masked
),
cands as (
  select eval_id, mask_no, r.c as cand_no,
         ('0x' || substr(md5(concat_ws('|', 'blank', eval_id, mask_no, r.c)), 1, 8))::BIGINT as hb,
         ('0x' || substr(md5(concat_ws('|', 'cand', eval_id, mask_no, r.c)), 1, 8))::BIGINT / 4294967296.0 as raw
  from masks, range(5) r(c)
),
cands2 as (
  select eval_id, mask_no, cand_no,
         case when hb % 7 = 0 then ' ' else ' w' || cast(hb % 1000 as varchar) end as token_str,
         raw / sum(raw) over (partition by eval_id, mask_no) as score
  from cands
),
""" + _DRAW_SQL


def _context_sql() -> str:
    """Calls and candidates over the context segment, up to ``cands2`` and ``ptb``."""
    from tessera.plans.sequences import SEG_SQL

    def h(*parts: str) -> str:
        return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"

    return "with recursive " + SEG_SQL + f""",
units as (
  select eval_id, tok, h, row_number() over (partition by eval_id order by pos) - 1 as pos from sent where segment = 'context'
),
rk as (
  select eval_id, pos, tok, row_number() over (partition by eval_id order by h desc, pos) <= {N_MASKS} as masked from units
),
mt as (
  select eval_id, string_agg(case when masked then '<mask>' else tok end, '' order by pos) as masked_text from rk group by eval_id
),
masks as (
  select eval_id, pos, row_number() over (partition by eval_id order by pos) - 1 as mask_no from rk where masked
),
""" + _CHUNK_SQL + f""",
filled as (
  select *, (sum(n_masks) over (partition by eval_id order by chunk) - n_masks) as first_mask, {h("'fail'", 'd')} % 13 <> 0 as ok,
         n_masks - case when n_masks > 1 and {h("'part'", 'd')} % 5 = 0 then 1 else 0 end as got
  from (
    select eval_id, chunk, md5(text) as d, (length(text) - length(replace(text, '<mask>', ''))) // 6 as n_masks from ch
  ) where n_masks > 0
),
cands as (
  select eval_id, first_mask + j as mask_no, r.c as cand_no, {h("'blank'", 'd', 'j', 'r.c')} as hb,
         {h("'cand'", 'd', 'j', 'r.c')} / 4294967296.0 as raw
  from (select *, unnest(range(got)) as j from filled where ok), range({B.TOP_K}) r(c)
),
cands2 as (
  select eval_id, mask_no, cand_no, case when hb % 7 = 0 then ' ' else ' w' || cast(hb % 1000 as varchar) end as token_str,
         raw / sum(raw) over (partition by eval_id, mask_no) as score
  from cands
),
state as (
  select eval_id, bool_and(ok) as filled, min(chunk) filter (where not ok) as bad from filled group by eval_id
),
""" + _DRAW_SQL


def oracle() -> dict[str, str]:
    ctx = _context_sql()
    f8 = _f8_sql()
    return {
        "mask_top_units": f8 + "select eval_id::BIGINT as eval_id, masked_text, masked_idx from mt",
        "sentence_chunks": "with recursive " + f8[len("with "):] + "," + _CHUNK_SQL + """
select eval_id::BIGINT as eval_id, chunk::BIGINT as chunk_no, text, n_words::BIGINT as n_words,
       ((length(text) - length(replace(text, '<mask>', ''))) // 6)::BIGINT as n_masks
from ch
""",
        "mask_calls": ctx + """
select eval_id::BIGINT as eval_id, chunk::BIGINT as chunk_no, first_mask::BIGINT as first_mask, n_masks::BIGINT as n_masks,
       (case when ok then got else 0 end)::BIGINT as n_answers, ok,
       case when not ok then 'KeyError: no candidates for chunk ' || cast(chunk as varchar) end as error
from filled
""",
        "mask_candidates": ctx + """
select eval_id::BIGINT as eval_id, mask_no::BIGINT as mask_no, cand_no::BIGINT as cand_no, token_str, round(score, 6) as score from cands2
""",
        "perturb_context": ctx + """
select f.eval_id::BIGINT as eval_id, s.filled, case when not s.filled then 'KeyError: no candidates for chunk ' || cast(s.bad as varchar) end as why,
       md5(p.context) as context_md5, p.change_set,
       md5('context: ' || coalesce(p.context, f.passage) || chr(10) || 'question: ' || f.question) as prompt_md5
from (select * from f2p where ok) f left join state s using (eval_id)
left join (select ptb.* from ptb left join state using (eval_id) where coalesce(filled, true)) p using (eval_id)
""",
        "inverse_prob_draw": f8 + "select eval_id::BIGINT as eval_id, mask_no::BIGINT as mask_no, draw from draws",
        "prompt_perturbed": f8 + """,
qa as (
  select q.conv_id * 100 + q.turn as eval_id, q.text as question,
         cast((q.conv_id * 37 + q.turn) % ((select count(*) from documents) + 50) as varchar) as passage_id
  from conversations q
  join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
       and q.role = 'user' and a.role = 'assistant'
),
j as (
  select qa.eval_id, qa.question, coalesce(p.context, d.text) as ctx
  from qa left join (select * from ptb where n_m = 0 or n_d > 0) p using (eval_id)
  left join documents d on cast(d.doc_id as varchar) = qa.passage_id
)
select eval_id::BIGINT as eval_id, ctx is not null as ok,
       case when ctx is not null then 'context: ' || ctx || chr(10) || 'question: ' || question end as prompt
from j
""",
        "perturb_join": f8 + """,
qa as (
  select q.conv_id * 100 + q.turn as eval_id
  from conversations q
  join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
       and q.role = 'user' and a.role = 'assistant'
)
select qa.eval_id::BIGINT as eval_id, p.context, p.change_set
from qa left join (select * from ptb where n_m = 0 or n_d > 0) p using (eval_id)
""",
    }
