"""The binary report of every evaluator, metrics by name, and the step scorer.

Each evaluator gives a scored set (``label``, ``score``); its class report,
AUC / AP and threshold come from the shared report operators.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators import prompts as PR
from tessera.operators import report as R
from tessera.operators import scoring as S
from tessera.operators.by_name import apply_metric, apply_metrics, parted_scores
from tessera.operators.segments import segment_steps
from tessera.plans import scoring
from tessera.plans.evalsets import q_nli_rows
from tessera.plans.fixtures import f2_prompts, qa_pairs
from tessera.plans.reports import _report_sql, round_doubles
from tessera.plans.sequences import ANS_ALTS_SQL, QA_SQL
from tessera.sources.tables import read_table


def cme_scores(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """Mean answer entropy: the inverted score for curves, the raw one for ranks."""
    f2 = f2_prompts(spark, sf_dir).where(F.col("ok"))
    cme = M.sequence_cme(F.col("prompt_logprob"), F.col("prefix_length"))
    return f2.select("label", (cme if raw else M.invert_entropy(cme)).alias("score"))


def cme_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cme_scores(spark, sf_dir, raw=True)


def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.f4_pairs(spark, sf_dir).where("ok").select("label", "score")


def _labelled(spark: SparkSession, sf_dir: str, scored: DataFrame, score: str) -> DataFrame:
    """Scores per answer with the quality label of the answer's passage (0 without one)."""
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("passage_id"), F.col("quality").cast("int").alias("quality")
    )
    qa = qa_pairs(spark, sf_dir).select("eval_id", "passage_id").join(labels, "passage_id", "left")
    return scored.select("eval_id", F.col(score).alias("score")).join(qa, "eval_id").select(
        F.coalesce("quality", F.lit(0)).alias("label"), "score"
    )


def nli_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, q_nli_rows(spark, sf_dir).where("ok"), "entailment")


def faithfulness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, scoring.q_faithfulness(spark, sf_dir), "faithfulness")


def correctness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, scoring.q_correctness(spark, sf_dir), "answer_correctness")


EVALUATORS = {
    "cme": cme_scores,
    "similarity": similarity_scores,
    "nli": nli_scores,
    "faithfulness": faithfulness_scores,
    "correctness": correctness_scores,
}
REPORTS = {"class_report": R.class_report, "auc_ap": R.auc_ap, "youden": R.youden}
RANKS = {"mwu": R.mann_whitney_less, "median_by_label": R.median_by_label}


def _report(op, source):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(op(R.score_table(source(spark, sf_dir))))

    return q


NAMED = (M.TOKEN_ENTROPY, M.TOKEN_LL, M.TOKEN_NLL, M.WORD_MEAN_ENTROPY)


def q_scores_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named metric on every segment: units and the sum of their values."""
    seg = segment_steps(f2_prompts(spark, sf_dir).where(F.col("ok")), clustered=True)
    out = apply_metrics(seg, NAMED).groupBy("metric", "eval_id", "segment").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("metric", F.col("eval_id").cast("bigint"), "segment", "n", F.round("total", 6).alias("total"))


def q_parted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores file's layout: units per segment, here counted from it."""
    seg = segment_steps(f2_prompts(spark, sf_dir).where(F.col("ok")), clustered=True)
    wide = parted_scores(apply_metric(seg, M.TOKEN_LL))
    return wide.select(
        F.col("eval_id").cast("bigint"), *(F.size(s).cast("bigint").alias(f"n_{s}") for s in ("instruct", "context", "question", "answer"))
    )


def step_scorer_factory():
    """Stand-in model: a step for every blank-separated piece of the prompt
    and the answer, logprobs hashed from the id and the position; ids whose
    hash is a multiple of 19 raise, like a refused call."""

    def score(rec: dict):
        if int(hashlib.md5(f"steps|{rec['eval_id']}".encode()).hexdigest()[:8], 16) % 19 == 0:
            raise ValueError("no logprobs")
        prompt, answer = rec["question"].split(" "), rec["answer"].split(" ")
        steps = [None]
        for i, token in enumerate(prompt + answer, 1):
            h = int(hashlib.md5(f"{rec['eval_id']}|{i}|0".encode()).hexdigest()[:6], 16)
            steps.append([(token, -(0.1 + 8.0 * h / 16777216.0), 1)])
        return steps, 1 + len(prompt)

    return score


def q_logprob_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, prefix length, ok and error per row, then PPL from them."""
    out = S.steps_with_function(qa_pairs(spark, sf_dir), step_scorer_factory, "eval_id", ["question", "answer"])
    ppl = M.sequence_ppl(F.col("prompt_logprob"), F.col("prefix_length"))
    return out.select(
        F.col("eval_id").cast("bigint"), "ok", "error", F.size("prompt_logprob").cast("bigint").alias("n_steps"),
        F.col("prefix_length").cast("bigint").alias("prefix_length"), F.round(F.when(F.col("ok"), ppl), 6).alias("ppl"),
    )


def q_passage_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage of each answer, '' where there is none."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("passage_id"), F.col("text").alias("passage"))
    out = PR.passage_or_empty(qa_pairs(spark, sf_dir), docs)
    return out.select(F.col("eval_id").cast("bigint"), F.length("passage").cast("bigint").alias("n_chars"), F.md5("passage").alias("digest"))


EMBED_TASK = "Find the answer"


def q_embed_instruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction-prefixed questions."""
    return qa_pairs(spark, sf_dir).select(F.col("eval_id").cast("bigint"), PR.embed_instruct(EMBED_TASK, F.col("question")).alias("text"))


QUERIES = {f"{name}_{e}": _report(op, src) for e, src in EVALUATORS.items() for name, op in REPORTS.items()}
QUERIES |= {f"{name}_cme": _report(op, cme_raw) for name, op in RANKS.items()}
QUERIES |= {
    "scores_by_metric": q_scores_by_metric,
    "parted_scores": q_parted_scores,
    "logprob_batch": q_logprob_batch,
    "passage_or_empty": q_passage_or_empty,
    "embed_instruct": q_embed_instruct,
}


def oracle() -> dict[str, str]:
    from tessera.operators.prompts import EMBED_INSTRUCT
    from tessera.plans import evalsets, sequences

    faith, nli = scoring.oracle(), evalsets.oracle()["nli_rows"]
    labelled = f"""
with {QA_SQL}, v as ({{inner}})
select coalesce(l.quality, 0)::INT as label, v.{{score}} as score
from v join qa using (eval_id) left join labels l on cast(l.doc_id as varchar) = qa.passage_id
"""
    scored = {
        "cme": f"with {ANS_ALTS_SQL} select label, 1 - case when mean_h is null then 'infinity'::DOUBLE else mean_h end as score from per",
        "similarity": f"with {scoring.F4_SQL} select label, score from f4 where ok",
        "nli": labelled.format(inner=f"select * from ({nli}) where ok", score="entailment"),
        "faithfulness": labelled.format(inner=faith["faithfulness_from_verdicts"], score="faithfulness"),
        "correctness": labelled.format(inner=faith["correctness_from_verdicts"], score="answer_correctness"),
    }
    out = {}
    for e, sql in scored.items():
        report = _report_sql(sql)
        out |= {f"{name}_{e}": report[name] for name in REPORTS}
    raw = _report_sql(scored["cme"].replace("1 - case", "case"))
    out |= {f"{name}_cme": raw[name] for name in RANKS}
    seq = sequences.oracle()
    unit = {M.TOKEN_LL: ("segment_token_ll", "value"), M.TOKEN_NLL: ("segment_token_ll", "-value"),
            M.TOKEN_ENTROPY: ("segment_token_entropy", "value"), M.WORD_MEAN_ENTROPY: ("segment_word_entropy", "value")}
    exact = {q: seq[q].replace("round(ll, 6)", "ll").replace("round(h, 6)", "h").replace("round(avg(h), 6)", "avg(h)") for q, _ in unit.values()}
    out["scores_by_metric"] = " union all ".join(
        f"select '{name}' as metric, eval_id, segment, count(*)::BIGINT as n, round(sum({value}), 6) as total from ({exact[q]}) group by eval_id, segment"
        for name, (q, value) in unit.items()
    )
    out["parted_scores"] = f"select eval_id, " + ", ".join(
        f"(count(*) filter (where segment = '{s}'))::BIGINT as n_{s}" for s in ("instruct", "context", "question", "answer")
    ) + f" from ({seq['segment_token_ll']}) group by eval_id"
    out["logprob_batch"] = f"""
with {QA_SQL}, h as (
  select *, ('0x' || substr(md5('steps|' || cast(eval_id as varchar)), 1, 8))::BIGINT % 19 <> 0 as ok,
         len(string_split(question, ' ')) as nq, len(string_split(answer, ' ')) as na from qa
), p as (
  select eval_id, avg(0.1 + 8 * ('0x' || substr(md5(concat_ws('|', eval_id, i, 0)), 1, 6))::BIGINT / 16777216.0) as nll
  from (select eval_id, unnest(range(1 + nq, 1 + nq + na)) as i from h) group by 1
)
select eval_id::BIGINT as eval_id, ok, case when not ok then 'ValueError: no logprobs' end as error,
       (case when ok then 1 + nq + na else 0 end)::BIGINT as n_steps, (case when ok then 1 + nq else 0 end)::BIGINT as prefix_length,
       round(case when ok then exp(nll) end, 6) as ppl
from h join p using (eval_id)
"""
    out["passage_or_empty"] = f"""
with {QA_SQL}
select eval_id::BIGINT as eval_id, length(coalesce(d.text, ''))::BIGINT as n_chars, md5(coalesce(d.text, '')) as digest
from qa left join documents d on cast(d.doc_id as varchar) = qa.passage_id
"""
    head, tail = (x.replace("{task}", EMBED_TASK).replace("'", "''") for x in EMBED_INSTRUCT.split("{text}"))
    out["embed_instruct"] = f"with {QA_SQL} select eval_id::BIGINT as eval_id, '{head}' || question || '{tail}' as text from qa"
    return out
