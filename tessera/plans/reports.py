"""Report queries (R1-R14) on the F7 scored sets and the F2 PPL flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import metrics as M
from tessera.operators import report as R
from tessera.plans.fixtures import f2_prompts
from tessera.session import materialize
from tessera.sources.tables import read_table


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle rule: 6 decimals in both engines)."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ------------------------------------------------------------ scored sets


def f7_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 large: ``y = (l_returnflag = 'R')``, ``score = l_quantity``."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_quantity").cast("double").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def f7_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 small: labels joined to documents, ``y = quality``."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    return j.select(
        F.round((F.col("n_chars") + 10 * F.col("quality")) / 10, 2).alias("score"),
        F.col("quality").cast("int").alias("label"),
    )


def f2_ppl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship input: ok rows of F2, score = -ln(PPL) = mean answer LL."""
    f2 = f2_prompts(spark, sf_dir).where(F.col("ok"))
    return f2.select(
        "eval_id",
        "label",
        M.sequence_mean_ll(F.col("prompt_logprob"), F.col("prefix_length")).alias("score"),
    )


def f7_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 with nearly as many distinct scores as rows: ``score = l_extendedprice``."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_extendedprice").cast("double").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def f2_ppl_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator's own value, PPL: what ranks and medians compare (label 1 lower)."""
    return f2_ppl_scores(spark, sf_dir).select("label", F.exp(-F.col("score")).alias("score"))


SETS = {"": f7_lineitem, "_docs": f7_docs, "_ppl": f2_ppl_scores, "_price": f7_price}

# Statistics of the raw score where the set has one.
RAW = {"_ppl": f2_ppl_raw}

OPS = {
    "roc_points": R.roc_points,
    "pr_points": R.pr_points,
    "auc_ap": R.auc_ap,
    "youden": R.youden,
    "class_report": R.class_report,
    "report_scalars": R.report_scalars,
    "confusion": R.confusion,
    "mwu": R.mann_whitney_less,
    "median_by_label": R.median_by_label,
    "score_hist": R.score_hist,
    "score_box": R.score_box,
    "score_kde": R.score_kde,
}


def _make(op, src):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(op(R.score_table(src(spark, sf_dir))))

    q.__name__ = f"q_{op.__name__}_{src.__name__}"
    return q


RAW_OPS = ("mwu", "median_by_label")

QUERIES = {
    f"{name}{suffix}": _make(op, RAW.get(suffix, src) if name in RAW_OPS else src)
    for suffix, src in SETS.items() for name, op in OPS.items()
}


def _make_all(src, raw):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranks = R.score_table(raw(spark, sf_dir)) if raw else None
        return round_doubles(R.report_all(R.score_table(src(spark, sf_dir)), ranks))

    return q


QUERIES |= {f"report_all{suffix}": _make_all(src, RAW.get(suffix)) for suffix, src in SETS.items()}


def q_distplot_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(R.score_distplot(R.score_table(f7_docs(spark, sf_dir)), bin_size=10.0))


def q_distplot_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(R.score_distplot(R.score_table(f2_ppl_scores(spark, sf_dir))))


def q_rug_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(f2_ppl_scores(spark, sf_dir))  # else filters evaluate the score again
    return round_doubles(R.score_rug(scored)).withColumn("id", F.col("id").cast("bigint"))


QUERIES |= {"score_distplot_docs": q_distplot_docs, "score_distplot": q_distplot_ppl, "score_rug": q_rug_ppl}
QUERIES |= {f"score_hist{suffix}_raw": _make(R.score_hist, src) for suffix, src in RAW.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPL of F2 answers -> Youden threshold -> class report."""
    return QUERIES["class_report_ppl"](spark, sf_dir)


# ------------------------------------------------------------------ oracle

SCORED_SQL = {
    "": "select l_quantity::DOUBLE as score, (l_returnflag = 'R')::INT as label from lineitem",
    "_docs": """select round((d.n_chars + 10 * l.quality) / 10, 2)::DOUBLE as score,
                       l.quality::INT as label
                from labels l join documents d using (doc_id)""",
}

F2_SQL = """
f2 as (
  select q.conv_id * 100 + q.turn as eval_id, d.doc_id as passage_id,
         q.text as question, a.text as answer, coalesce(l.quality, 0)::INT as label,
         d.text as passage,
         d.text as ctx,
         ('0x' || substr(md5(concat_ws('|', 'ok', q.conv_id, q.turn)), 1, 8))::BIGINT % 20 <> 0 as ok
  from conversations q
  join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
       and q.role = 'user' and a.role = 'assistant'
  join documents d on d.doc_id = (q.conv_id * 8 + q.turn) % (select count(*) from documents)
  left join labels l on l.doc_id = d.doc_id
),
f2p as (
  select *, 'context: ' || ctx || chr(10) || 'question: ' || question as prompt,
         len(string_split('context: ' || ctx || chr(10) || 'question: ' || question || ' <end> <model>', ' ')) as n_prompt
  from f2
),
ans_tok as (
  select eval_id, label, ok, n_prompt,
         unnest(string_split(answer, ' ')) as raw_tok,
         unnest(range(len(string_split(answer, ' ')))) as j
  from f2p
),
ans_ll as (
  select eval_id, label, ok, 1 + n_prompt + j as pos,
         -(0.1 + 8 * ('0x' || substr(md5(concat_ws('|', eval_id, 1 + n_prompt + j, 0)), 1, 6))::BIGINT / 16777216.0) as ll
  from ans_tok
)
"""

SCORED_SQL["_price"] = "select l_extendedprice::DOUBLE as score, (l_returnflag = 'R')::INT as label from lineitem"
RAW_SQL = {"_ppl": "select label, exp(-avg(ll)) as score from ans_ll where ok group by eval_id, label"}
SCORED_SQL["_ppl"] = "select label, avg(ll) as score from ans_ll where ok group by eval_id, label"


def _report_sql(scored: str, bin_size: float = R.BIN_SIZE) -> dict[str, str]:
    head = f"""
with s as ({scored}),
fin as (select score::DOUBLE as score, label from s where score is not null and isfinite(score)),
g as (select score, sum(label)::BIGINT as pos, sum(1 - label)::BIGINT as neg from fin group by score),
t as (
  select *,
    sum(pos) over (order by score desc rows between unbounded preceding and current row) as tp,
    sum(neg) over (order by score desc rows between unbounded preceding and current row) as fp,
    sum(pos) over () as P, sum(neg) over () as N,
    lead(pos) over (order by score desc) as dn_pos,
    lead(neg) over (order by score desc) as dn_neg,
    row_number() over (order by score desc) as rk
  from g
),
yj as (
  select * from (
    select 0.0::DOUBLE as j, 'infinity'::DOUBLE as thr, 0.0::DOUBLE as tpr, 0.0::DOUBLE as fpr
    union all
    select (case when P = 0 then 0.0 else tp / P end) - (case when N = 0 then 0.0 else fp / N end),
           score, case when P = 0 then 0.0 else tp / P end, case when N = 0 then 0.0 else fp / N end
    from t
  ) order by j desc, thr desc limit 1
),
cc as (
  select coalesce(sum(pos) filter (where score >= (select thr from yj)), 0)::BIGINT as tp,
         coalesce(sum(neg) filter (where score >= (select thr from yj)), 0)::BIGINT as fp,
         coalesce(sum(pos), 0)::BIGINT as P, coalesce(sum(neg), 0)::BIGINT as N
  from g
),
m as (
  select *, P - tp as fn, N - fp as tn,
    case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as p1,
    case when P = 0 then 0.0 else tp / P end as r1,
    case when (N - fp) + (P - tp) = 0 then 0.0 else (N - fp) / ((N - fp) + (P - tp)) end as p0,
    case when N = 0 then 0.0 else (N - fp) / N end as r0
  from cc
),
m2 as (
  select *, case when p1 + r1 = 0 then 0.0 else 2 * p1 * r1 / (p1 + r1) end as f1,
            case when p0 + r0 = 0 then 0.0 else 2 * p0 * r0 / (p0 + r0) end as f0,
            (P + N)::DOUBLE as tot
  from m
),
rep as (
  select 'Ложь' as class_name, 'precision' as metric, p0 as value from m2
  union all select 'Ложь', 'recall', r0 from m2
  union all select 'Ложь', 'f1-score', f0 from m2
  union all select 'Ложь', 'support', N::DOUBLE from m2
  union all select 'Истина', 'precision', p1 from m2
  union all select 'Истина', 'recall', r1 from m2
  union all select 'Истина', 'f1-score', f1 from m2
  union all select 'Истина', 'support', P::DOUBLE from m2
  union all select 'accuracy', 'accuracy', case when tot = 0 then 0.0 else (tp + tn) / tot end from m2
  union all select 'macro avg', 'precision', (p0 + p1) / 2 from m2
  union all select 'macro avg', 'recall', (r0 + r1) / 2 from m2
  union all select 'macro avg', 'f1-score', (f0 + f1) / 2 from m2
  union all select 'macro avg', 'support', tot from m2
  union all select 'weighted avg', 'precision', case when tot = 0 then 0.0 else (p0 * N + p1 * P) / tot end from m2
  union all select 'weighted avg', 'recall', case when tot = 0 then 0.0 else (r0 * N + r1 * P) / tot end from m2
  union all select 'weighted avg', 'f1-score', case when tot = 0 then 0.0 else (f0 * N + f1 * P) / tot end from m2
  union all select 'weighted avg', 'support', tot from m2
),
rk as (
  select *, (sum(pos + neg) over (order by score rows between unbounded preceding and current row)) - (pos + neg) as below,
         (sum(pos) over (order by score rows between unbounded preceding and current row)) - pos as below_pos,
         (sum(neg) over (order by score rows between unbounded preceding and current row)) - neg as below_neg
  from g
),
mw as (
  select sum(pos * (below + (pos + neg + 1) / 2.0)) as R1,
         sum(((pos + neg) * (pos + neg) * (pos + neg) - (pos + neg))::DOUBLE) as ties,
         sum(pos)::DOUBLE as n1, sum(neg)::DOUBLE as n0
  from rk
),
mw2 as (
  select n1, n0, R1 - n1 * (n1 + 1) / 2 as u1,
         sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) as sd
  from mw
),
mw3 as (select *, (n1 * n0 - u1 - n1 * n0 / 2 - 0.5) / sd as z from mw2),
mw4 as (
  select *, abs(z / sqrt(2.0)) as az, 1.0 / (1.0 + 0.5 * abs(z / sqrt(2.0))) as tt from mw3
),
mm as (select min(score) as lo, max(score) as hi from fin)
"""
    erfc_poly = (
        "tt * exp(-az * az + (-1.26551223 + tt * (1.00002368 + tt * (0.37409196 + tt * (0.09678418"
        " + tt * (-0.18628806 + tt * (0.27886807 + tt * (-1.13520398 + tt * (1.48851587"
        " + tt * (-0.82215223 + tt * 0.17087277))))))))))"
    )
    return {
        "roc_points": head
        + """
select 'infinity'::DOUBLE as threshold, 0.0::DOUBLE as fpr, 0.0::DOUBLE as tpr
union all
select round(score, 6), round(fp / N, 6), round(tp / P, 6) from t
where rk = 1 or dn_pos is null or dn_pos <> pos or dn_neg <> neg
""",
        "pr_points": head
        + """
select round(score, 6) as threshold, round(case when tp + fp = 0 then 0.0 else tp / (tp + fp) end, 6) as precision,
       round(case when P = 0 then 1.0 else tp / P end, 6) as recall from t
union all select null::DOUBLE, 1.0, 0.0
""",
        "auc_ap": head
        + f"""
select (P + N)::BIGINT as n_rows, P::BIGINT as n_pos, N::BIGINT as n_neg,
       (select count(*) from s where score is null or not isfinite(score::DOUBLE))::BIGINT as n_nonfinite,
       round(sum(pos * ((N - fp) + neg / 2.0)) / (P * N)::DOUBLE, 6) as auc,
       round(sum(pos * tp / (tp + fp)) / P::DOUBLE, 6) as ap
from t group by P, N
""",
        "youden": head
        + "select round(thr, 6) as threshold, round(j, 6) as j, round(tpr, 6) as tpr, round(fpr, 6) as fpr from yj",
        "class_report": head + "select class_name, metric, round(value, 6) as value from rep",
        "report_scalars": head
        + """
select 'test_' || replace(class_name, ' ', '_') || '_' || metric as name, round(round(value, 3), 6) as value
from rep where class_name in ('Ложь', 'Истина')
union all select 'best_roc_threshold', round(round(thr, 4), 6) from yj
""",
        "confusion": head
        + """
select 0 as y_true, 0 as y_pred, tn as n from m2 union all
select 0, 1, fp from m2 union all select 1, 0, fn from m2 union all select 1, 1, tp from m2
""",
        "mwu": head
        + f"""
select n1::BIGINT as n1, n0::BIGINT as n0, round(u1, 6) as u1, round(z, 6) as z,
       round((case when z >= 0 then {erfc_poly} else 2.0 - {erfc_poly} end) / 2, 6) as p_value
from mw4
""",
        "median_by_label": head
        + """
, k as (select sum(pos) as P, sum(neg) as N from g),
med as (
  select
    (max(score) filter (where below_pos < floor((k.P + 1) / 2) and below_pos + pos >= floor((k.P + 1) / 2))
     + max(score) filter (where below_pos < ceil((k.P + 1) / 2) and below_pos + pos >= ceil((k.P + 1) / 2))) / 2 as med1,
    (max(score) filter (where below_neg < floor((k.N + 1) / 2) and below_neg + neg >= floor((k.N + 1) / 2))
     + max(score) filter (where below_neg < ceil((k.N + 1) / 2) and below_neg + neg >= ceil((k.N + 1) / 2))) / 2 as med0,
    any_value(k.P) as P, any_value(k.N) as N
  from rk, k
)
select 0 as label, N::BIGINT as n, round(med0, 6) as median from med
union all select 1, P::BIGINT, round(med1, 6) from med
""",
        "score_hist": head
        + """
, b as (
  select case when mm.hi = mm.lo then 1
              else least(floor((score - mm.lo) / ((mm.hi - mm.lo) / 50))::INT + 1, 50) end as bin,
         label, mm.lo, mm.hi
  from fin, mm
)
select bin::BIGINT as bin, label::BIGINT as label,
       round(any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / 50), 6) as bin_lo,
       count(*)::BIGINT as n
from b group by bin, label
""",
        "score_box": head
        + """
select count(*)::BIGINT as n, round(min(score), 6) as min,
       round(quantile_cont(score, 0.25), 6) as q1, round(quantile_cont(score, 0.5), 6) as median,
       round(quantile_cont(score, 0.75), 6) as q3, round(max(score), 6) as max, round(avg(score), 6) as mean
from fin
""",
        "score_distplot": _distplot_sql(head, bin_size),
        "score_kde": head
        + """
, gl as (select label, score, count(*) as cnt from fin group by label, score),
mu as (select label, avg(score) as mu, count(*) as n from fin group by label),
st as (select f.label, sqrt(sum((f.score - mu.mu) * (f.score - mu.mu)) / (any_value(mu.n) - 1)) * pow(any_value(mu.n), -0.2) as bw,
              any_value(mu.n) as n from fin f join mu using (label) group by f.label),
grid as (select i, mm.lo + (mm.hi - mm.lo) * i / 499 as x from range(500) r(i), mm)
select gl.label::BIGINT as label, grid.i::BIGINT as i, round(any_value(grid.x), 6) as x,
       round(sum(gl.cnt * exp(-pow((grid.x - gl.score) / st.bw, 2) / 2)) / (any_value(st.n) * nullif(any_value(st.bw), 0) * sqrt(2 * pi())), 6) as density
from gl join st using (label), grid
group by gl.label, grid.i
""",
    }


def _distplot_sql(head: str, bin_size: float) -> str:
    """Linear binning and truncated kernel as in ``report.binned_kde``, and bins from each label's least score."""
    last = R.KDE_CELLS * (R.KDE_POINTS - 1)
    return head + f"""
, mu as (select label, avg(score) as mu, count(*) as n, min(score) as low from fin group by label),
st as (select f.label, nullif(sqrt(sum((f.score - mu.mu) * (f.score - mu.mu)) / (any_value(mu.n) - 1)) * pow(any_value(mu.n), -0.2), 0) as bw,
              any_value(mu.n) as n from fin f join mu using (label) group by f.label),
place as (select label, case when hi > lo then (score - lo) / (hi - lo) * {last} else 0.0 end as spot from fin, mm),
cell as (select label, spot, least(floor(spot), {last - 1})::INT as c from place),
w as (
  select label, j, sum(w) as w from (
    select label, c as j, 1 - (spot - c) as w from cell union all select label, c + 1, spot - c from cell
  ) group by all
),
grid as (select i, lo + (hi - lo) * i / {R.KDE_POINTS - 1} as x, (hi - lo) / {last} as d from range({R.KDE_POINTS}) r(i), mm),
dens as (
  select st.label, i, any_value(x) as x,
         coalesce(sum(case when abs(j - i * {R.KDE_CELLS}) <= least(ceil({R.KDE_REACH} * bw / d), {last})
                  then w * exp(-pow((j - i * {R.KDE_CELLS}) * d / bw, 2) / 2) end), 0) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) as y
  from w join st using (label), grid group by st.label, i
),
hist as (
  select f.label, floor((score - low) / {bin_size})::BIGINT as i, any_value(low) as low, count(*) as c, any_value(mu.n) as n
  from fin f join mu using (label) group by all
)
select 'density' as part, label::BIGINT as label, i::BIGINT as i, round(x, 6) as x, round(y, 6) as y from dens
union all
select 'histogram', label::BIGINT, i, round(low + i * {bin_size}, 6), round(c / (n * {bin_size}), 6) from hist
"""


def _all_sql(sqls: dict[str, str]) -> str:
    """All scalars of the single reports as ``section, name, value``."""

    def wide(section: str, query: str, names: dict[str, str]) -> str:
        return (
            f"select '{section}' as section, unnest([{', '.join(repr(n) for n in names)}]) as name, "
            f"unnest([{', '.join(f'({c})::DOUBLE' for c in names.values())}]) as value from ({sqls[query]})"
        )

    def plain(section: str, query: str, *names: str) -> str:
        return wide(section, query, {n: n for n in names})

    return " union all ".join([
        f"select 'class:' || class_name as section, metric as name, value::DOUBLE as value from ({sqls['class_report']})",
        plain("auc_ap", "auc_ap", "n_rows", "n_pos", "n_neg", "n_nonfinite", "auc", "ap"),
        plain("youden", "youden", "threshold", "j", "tpr", "fpr"),
        "select 'confusion' as section, case when y_true = 0 then (case when y_pred = 0 then 'tn' else 'fp' end)"
        f" else (case when y_pred = 0 then 'fn' else 'tp' end) end as name, n::DOUBLE as value from ({sqls['confusion']})",
        plain("box", "score_box", "min", "max", "mean", "q1", "median", "q3"),
        plain("mwu", "mwu", "n1", "n0", "u1", "z", "p_value"),
        f"select 'median' as section, label::BIGINT::VARCHAR as name, median::DOUBLE as value from ({sqls['median_by_label']})",
    ])


def oracle() -> dict[str, str]:
    out: dict[str, str] = {}
    for suffix in SETS:
        scored = SCORED_SQL[suffix]
        sqls = _report_sql(scored, 10.0 if suffix == "_docs" else R.BIN_SIZE)
        if suffix in RAW_SQL:
            raw = _report_sql(RAW_SQL[suffix])
            sqls |= {name: raw[name] for name in RAW_OPS} | {"score_hist_raw": raw["score_hist"]}
        if suffix == "_ppl":
            sqls = {k: v.replace("with s as (", "with " + F2_SQL + ", s as (", 1) for k, v in sqls.items()}
        out[f"report_all{suffix}"] = _all_sql(sqls)
        distplot = sqls.pop("score_distplot")
        if suffix in ("_docs", "_ppl"):
            out["score_distplot_docs" if suffix == "_docs" else "score_distplot"] = distplot
        for name, sql in sqls.items():
            out[f"score_hist{suffix}_raw" if name == "score_hist_raw" else f"{name}{suffix}"] = sql
    out["score_rug"] = "with " + F2_SQL + """
select label::BIGINT as label, round(avg(ll), 6) as score, eval_id::BIGINT as id from ans_ll where ok group by eval_id, label
"""
    return out
