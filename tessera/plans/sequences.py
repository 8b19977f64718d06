"""Queries on the F2 prompts: sequence metrics (M7-M10), segment mapping
(G1-G10) with per-segment metrics (M12), prompt building and passage join
(E1, E2, J1, J2) and the ok filter / quarantine (P1, P2, K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators import prompts as PR
from tessera.operators.segments import segment_steps
from tessera.operators.words import BLANK_CLASS, word_units
from tessera.plans.fixtures import f2_prompts, qa_pairs
from tessera.plans.reports import F2_SQL, round_doubles
from tessera.sources.tables import read_table


def _ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f2_prompts(spark, sf_dir).where(F.col("ok"))


def q_sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7-M10 per answer: PPL, CME and their inverted forms."""
    d = _ok(spark, sf_dir).select(
        "eval_id",
        "label",
        M.sequence_ppl(F.col("prompt_logprob"), F.col("prefix_length")).alias("ppl"),
        M.sequence_cme(F.col("prompt_logprob"), F.col("prefix_length")).alias("cme"),
    )
    d = d.withColumn("inv_ppl", M.invert_ppl(F.col("ppl"))).withColumn(
        "inv_cme", M.invert_entropy(F.col("cme"))
    )
    return round_doubles(d.select(F.col("eval_id").cast("bigint"), "label", "ppl", "cme", "inv_ppl", "inv_cme"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_steps(_ok(spark, sf_dir), clustered=True)


def q_segment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer and segment, the step count and the joined text."""
    seg = _segments(spark, sf_dir)
    return seg.groupBy("eval_id", "segment").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", F.col("step")[0]["decoded_token"].alias("t")))),
                lambda x: x["t"],
            ),
            "",
        ).alias("text"),
    ).select(F.col("eval_id").cast("bigint"), "segment", "n_steps", "text")


def _segment_units(seg: DataFrame, value_fn) -> DataFrame:
    """M12 for step metrics in the long shape: index = rank inside the
    segment; the window reuses the eval_id partitioning of ``seg``."""
    w = Window.partitionBy("eval_id", "segment").orderBy("pos")
    return seg.select(
        F.col("eval_id").cast("bigint").alias("eval_id"),
        "segment",
        (F.row_number().over(w) - 1).cast("bigint").alias("idx"),
        F.col("step")[0]["decoded_token"].alias("text_unit"),
        F.round(value_fn(F.col("step")), 6).alias("value"),
    )


def q_segment_token_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_units(_segments(spark, sf_dir), M.step_ll)


def q_segment_token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_units(_segments(spark, sf_dir), M.step_entropy)


def q_segment_word_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir).select(
        "eval_id", "segment", "pos",
        F.col("step")[0]["decoded_token"].alias("token"),
        M.step_entropy(F.col("step")).alias("value"),
    )
    w = word_units(seg, ["eval_id", "segment"])
    return w.select(
        F.col("eval_id").cast("bigint"), "segment",
        F.col("index").cast("bigint").alias("idx"), "text_unit",
        F.round("value", 6).alias("value"),
    )


def q_prompt_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + J1: context prompts; a missing passage fails only that row."""
    qa = qa_pairs(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents")
    passages = docs.select(F.col("doc_id").cast("string").alias("passage_id"), F.col("text").alias("passage"))
    out = PR.context_prompts(qa, passages)
    return out.select(F.col("eval_id").cast("bigint"), "passage_id", "ok", "error", "prompt", "answer")


def q_prompt_noctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-only prompts."""
    qa = qa_pairs(spark, sf_dir)
    return PR.no_context_prompts(qa).select(F.col("eval_id").cast("bigint"), "prompt", "answer")


def q_ok_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + R14: rows kept by ``ok`` per label."""
    f2 = f2_prompts(spark, sf_dir)
    return f2.groupBy("label").agg(
        F.count_if(F.col("ok")).cast("bigint").alias("ok_rows"),
        F.count_if(~F.col("ok")).cast("bigint").alias("failed_rows"),
    )


def q_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + K5: failed rows with their error text (what the reference writes
    to its failed-rows CSV)."""
    f2 = f2_prompts(spark, sf_dir)
    return f2.where(~F.col("ok")).select(F.col("eval_id").cast("bigint"), "passage_id", "error")


def q_segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer, count/mean/min/max/stddev of token entropy in each
    segment, pivoted wide (the training table's feature columns)."""
    from tessera.operators.training import segment_features

    seg = _segments(spark, sf_dir).select(
        "eval_id", "segment", M.step_entropy(F.col("step")).alias("value")
    )
    wide = segment_features(seg)
    return round_doubles(wide.withColumn("eval_id", F.col("eval_id").cast("bigint")))


QUERIES = {
    "segment_features": q_segment_features,
    "sequence_scores": q_sequence_scores,
    "segment_tokens": q_segment_tokens,
    "segment_token_ll": q_segment_token_ll,
    "segment_token_entropy": q_segment_token_entropy,
    "segment_word_entropy": q_segment_word_entropy,
    "prompt_ctx": q_prompt_ctx,
    "prompt_noctx": q_prompt_noctx,
    "ok_filter": q_ok_filter,
    "quarantine": q_quarantine,
}


# ------------------------------------------------------------------ oracle

SEG_SQL = F2_SQL + r""",
mk as (
  select eval_id, label, question, prompt || ' <end> <model>' as full_prompt, n_prompt, answer
  from f2p where ok
),
mk2 as (select *, case when strpos(full_prompt, 'context: ') > 0 then strpos(full_prompt, 'context: ') - 1 + 9 else -1 end as ctx_start from mk),
mk3 as (
  select *, case when strpos(substr(full_prompt, greatest(ctx_start, 0) + 1), 'question: ') > 0
                 then greatest(ctx_start, 0) + strpos(substr(full_prompt, greatest(ctx_start, 0) + 1), 'question: ') - 1
                 else -1 end as qpos
  from mk2
),
mk4 as (
  select *, case when qpos >= 0 then qpos + 10 else -1 end as q_start,
            case when qpos >= 0 then qpos + 10 + length(question) else -1 end as q_end,
            case when ctx_start >= 0 then (case when qpos >= 0 then qpos else length(full_prompt) end) else -1 end as ctx_end
  from mk3
),
ptok as (
  select eval_id, ctx_start, ctx_end, q_start, q_end,
         unnest(string_split(full_prompt, ' ')) as raw, unnest(range(len(string_split(full_prompt, ' ')))) as j
  from mk4
),
pt as (select *, case when j = 0 then raw else ' ' || raw end as tok, 1 + j as pos from ptok),
pt2 as (
  select *, coalesce(sum(length(tok)) over (partition by eval_id order by pos rows between unbounded preceding and 1 preceding), 0) as st,
         length(tok) as ln
  from pt
),
pt3 as (
  select *, (ctx_start >= 0 and ln > 0 and ctx_end > ctx_start and st < ctx_end and st + ln > ctx_start) as in_ctx,
            (q_start >= 0 and ln > 0 and q_end > q_start and st < q_end and st + ln > q_start) as in_q
  from pt2
),
pt4 as (
  select *, min(case when in_ctx or in_q then pos end) over (partition by eval_id) as fni,
            max(in_q::INT) over (partition by eval_id) as has_q
  from pt3
),
atok as (
  select eval_id, n_prompt, unnest(string_split(answer, ' ')) as raw, unnest(range(len(string_split(answer, ' ')))) as j
  from mk
),
segs as (
  select eval_id, pos, tok, case when pos < fni then 'instruct' when in_ctx then 'context' when in_q then 'question' end as segment
  from pt4 where has_q = 1
  union all
  select eval_id, 1 + n_prompt + j as pos, case when j = 0 then raw else ' ' || raw end as tok, 'answer' as segment
  from atok where eval_id in (select eval_id from pt4 where has_q = 1)
),
segs2 as (select * from segs where segment is not null),
salts as (
  select s.eval_id, s.pos, s.tok, s.segment, r.k,
         -(0.1 + 8 * ('0x' || substr(md5(concat_ws('|', s.eval_id, s.pos, r.k)), 1, 6))::BIGINT / 16777216.0) as lp
  from segs2 s, range(5) r(k)
),
sst as (
  select eval_id, pos, any_value(tok) as tok, any_value(segment) as segment, count(*) as kn, max(lp) as m,
         max(lp) filter (where k = 0) as ll
  from salts group by eval_id, pos
),
slse as (
  select a.eval_id, a.pos, any_value(st.m) + ln(sum(exp(a.lp - st.m))) as lse
  from salts a join sst st using (eval_id, pos) group by a.eval_id, a.pos
),
sent as (
  select a.eval_id, a.pos, any_value(st.tok) as tok, any_value(st.segment) as segment, any_value(st.ll) as ll,
         case when any_value(st.kn) <= 1 then 0.0
              else -sum(exp(a.lp - l.lse) * (a.lp - l.lse)) / ln(any_value(st.kn)) end as h
  from salts a join sst st using (eval_id, pos) join slse l using (eval_id, pos)
  group by a.eval_id, a.pos
)
"""

ANS_ALTS_SQL = F2_SQL + r""",
aalts as (
  select a.eval_id, a.label, a.pos, r.k,
         -(0.1 + 8 * ('0x' || substr(md5(concat_ws('|', a.eval_id, a.pos, r.k)), 1, 6))::BIGINT / 16777216.0) as lp
  from ans_ll a, range(5) r(k) where a.ok
),
astep as (
  select eval_id, any_value(label) as label, pos, sum(exp(lp)) as mass from aalts group by eval_id, pos
),
aent as (
  select a.eval_id, a.pos, -sum(case when exp(a.lp) / s.mass > 0 then exp(a.lp) / s.mass * ln(exp(a.lp) / s.mass) else 0 end) as h
  from aalts a join astep s using (eval_id, pos) where s.mass > 0 group by a.eval_id, a.pos
),
okrows as (select eval_id, label from f2p where ok),
per as (
  select o.eval_id, o.label,
         (select avg(ll) from ans_ll x where x.eval_id = o.eval_id) as mean_ll,
         (select avg(h) from aent e where e.eval_id = o.eval_id) as mean_h
  from okrows o
)
"""

QA_SQL = """
qa as (
  select q.conv_id * 100 + q.turn as eval_id,
         cast((q.conv_id * 37 + q.turn) % ((select count(*) from documents) + 50) as varchar) as passage_id,
         q.text as question, a.text as answer
  from conversations q
  join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
       and q.role = 'user' and a.role = 'assistant'
)
"""


def oracle() -> dict[str, str]:
    words_sql = (
        "with " + SEG_SQL + r""",
f as (
  select eval_id, segment, pos, tok, h,
         left(tok, 1) in (' ', 'Ġ', chr(10), chr(9)) as cand,
         regexp_matches(tok, '[^BLANKS]') as nb,
         row_number() over (partition by eval_id, segment order by pos) - 1 as rn
  from sent
),
g as (
  select *,
    max(case when nb then rn end) over (partition by eval_id, segment order by rn rows between unbounded preceding and 1 preceding) as last_nb,
    coalesce(max(case when cand then rn end) over (partition by eval_id, segment order by rn rows between unbounded preceding and 1 preceding), 0) as prev_cand
  from f
),
s as (
  select *, sum(case when cand and rn > 0 and coalesce(last_nb >= prev_cand, false) then 1 else 0 end)
            over (partition by eval_id, segment order by rn rows between unbounded preceding and current row) as word
  from g
)
select eval_id::BIGINT as eval_id, segment, word::BIGINT as idx,
       string_agg(tok, '' order by rn) as text_unit, round(avg(h), 6) as value
from s group by eval_id, segment, word
having string_agg(tok, '' order by rn) <> ''
""".replace("BLANKS", BLANK_CLASS)
    )
    return {
        "sequence_scores": "with " + ANS_ALTS_SQL + """
select eval_id::BIGINT as eval_id, label,
       round(case when mean_ll is null then 'infinity'::DOUBLE else exp(-mean_ll) end, 6) as ppl,
       round(case when mean_h is null then 'infinity'::DOUBLE else mean_h end, 6) as cme,
       round(-ln(case when mean_ll is null then 'infinity'::DOUBLE else exp(-mean_ll) end), 6) as inv_ppl,
       round(1 - case when mean_h is null then 'infinity'::DOUBLE else mean_h end, 6) as inv_cme
from per
""",
        "segment_tokens": "with " + SEG_SQL + """
select eval_id::BIGINT as eval_id, segment, count(*)::BIGINT as n_steps, string_agg(tok, '' order by pos) as text
from segs2 group by eval_id, segment
""",
        "segment_token_ll": "with " + SEG_SQL + """
select eval_id::BIGINT as eval_id, segment,
       (row_number() over (partition by eval_id, segment order by pos) - 1)::BIGINT as idx,
       tok as text_unit, round(ll, 6) as value
from sent
""",
        "segment_token_entropy": "with " + SEG_SQL + """
select eval_id::BIGINT as eval_id, segment,
       (row_number() over (partition by eval_id, segment order by pos) - 1)::BIGINT as idx,
       tok as text_unit, round(h, 6) as value
from sent
""",
        "segment_word_entropy": words_sql,
        "segment_features": "with " + SEG_SQL + ", "
        + "fx as (select eval_id, "
        + ", ".join(
            f"count(h) filter (where segment = '{sg}') as {sg}_n, "
            f"coalesce(round(avg(h) filter (where segment = '{sg}'), 6), 0.0) as {sg}_mean, "
            f"coalesce(round(min(h) filter (where segment = '{sg}'), 6), 0.0) as {sg}_min, "
            f"coalesce(round(max(h) filter (where segment = '{sg}'), 6), 0.0) as {sg}_max, "
            f"coalesce(round(stddev_samp(h) filter (where segment = '{sg}'), 6), 0.0) as {sg}_std"
            for sg in ("instruct", "context", "question", "answer")
        )
        + " from sent group by eval_id) select eval_id::BIGINT as eval_id, "
        + ", ".join(
            f"{sg}_n::BIGINT as {sg}_n, {sg}_mean, {sg}_min, {sg}_max, {sg}_std"
            for sg in ("instruct", "context", "question", "answer")
        )
        + " from fx",
        "prompt_ctx": "with " + QA_SQL + """
select qa.eval_id::BIGINT as eval_id, qa.passage_id,
       d.text is not null as ok,
       case when d.text is null then 'KeyError: ' || qa.passage_id end as error,
       case when d.text is not null then 'context: ' || d.text || chr(10) || 'question: ' || qa.question end as prompt,
       qa.answer
from qa left join documents d on cast(d.doc_id as varchar) = qa.passage_id
""",
        "prompt_noctx": "with " + QA_SQL + """
select eval_id::BIGINT as eval_id, 'question: ' || question as prompt, answer from qa
""",
        "ok_filter": "with " + F2_SQL + """
select label, (count(*) filter (where ok))::BIGINT as ok_rows, (count(*) filter (where not ok))::BIGINT as failed_rows
from f2 group by label
""",
        "quarantine": "with " + F2_SQL + """
select eval_id::BIGINT as eval_id, cast(passage_id as varchar) as passage_id, 'ScorerError: no logprobs' as error
from f2 where not ok
""",
    }
