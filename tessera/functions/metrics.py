"""Token and sequence metrics as Catalyst expressions (no Python UDF).

Every function maps Columns to a Column, so it runs inside whole-stage
codegen on either shape:

* step level: ``step -> double`` (used on the long shape, one row per step);
* sequence level: ``array<step> -> array<unit>`` (used on the array shape).

Lambdas re-evaluate outer sub-expressions on every call, so repeated values
(max, log-sum-exp) are bound once by mapping over a one-element array.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.steps import chosen

# Fixed values from the reference: the metric names of the registry and the
# setting for the "uncertain token" flag.
TOKEN_LL = "token_ll"
TOKEN_NLL = "token_nll"
TOKEN_ENTROPY = "token_entropy"
WORD_MEAN_ENTROPY = "word_mean_entropy"
UNCERTAIN_TOKEN_THRESHOLD = 0.8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (HOF let-binding)."""
    return F.get(F.transform(F.array(value), body), 0)


def _logprobs(step: Column) -> Column:
    return F.transform(step, lambda a: a["logprob"])


# ---------------------------------------------------------------- step level


def step_ll(step: Column) -> Column:
    """M1: log-likelihood of the chosen token."""
    return chosen(step)["logprob"]


def step_nll(step: Column) -> Column:
    """M2: negative log-likelihood of the chosen token."""
    return -chosen(step)["logprob"]


def step_entropy(step: Column) -> Column:
    """M4/M5: Shannon entropy of the renormalised alternatives / ln K.

    Log-sum-exp with the max subtracted; K <= 1 gives 0.0 (SURVEY Q1).
    An empty or null step gives null, so callers drop it (SURVEY Q2).
    """
    lps = _logprobs(step)
    k = F.size(lps)

    def with_lse(lse: Column) -> Column:
        h = -F.aggregate(
            lps, F.lit(0.0), lambda s, x: s + F.exp(x - lse) * (x - lse)
        )
        return h / F.log(k.cast("double"))

    lse = _let(
        F.array_max(lps),
        lambda m: m + F.log(F.aggregate(lps, F.lit(0.0), lambda s, x: s + F.exp(x - m))),
    )
    return (
        F.when(step.isNull() | (k == 0), F.lit(None).cast("double"))
        .when(k == 1, F.lit(0.0))
        .otherwise(_let(lse, with_lse))
    )


def step_entropy_nats(step: Column) -> Column:
    """M8 step term: entropy in nats of exp(lp)/sum(exp(lp)), terms p > 0 only.

    Null when the step is null/empty or carries no probability mass, as the
    reference skips such steps.
    """

    def with_masses(masses: Column) -> Column:
        def with_total(total: Column) -> Column:
            def term(s: Column, x: Column) -> Column:
                p = x / total
                return s + F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))

            return F.when(total > 0, -F.aggregate(masses, F.lit(0.0), term))

        return _let(F.aggregate(masses, F.lit(0.0), lambda s, x: s + x), with_total)

    masses = F.transform(step, lambda a: F.exp(a["logprob"]))
    return F.when(step.isNotNull() & (F.size(step) > 0), _let(masses, with_masses)).cast("double")


def uncertain(value: Column, threshold: float = UNCERTAIN_TOKEN_THRESHOLD) -> Column:
    """Flag a unit whose metric exceeds the setting."""
    return value > F.lit(threshold)


# ------------------------------------------------------------ sequence level


def _units(steps: Column, value_fn: Callable[[Column], Column]) -> Column:
    """Map a step list to ``array<struct<value,index,text_unit>>``; null or
    empty steps are dropped, indexes count the kept steps."""
    kept = F.filter(steps, lambda s: s.isNotNull() & (F.size(s) > 0))
    return F.transform(
        kept,
        lambda s, i: F.struct(
            value_fn(s).alias("value"),
            i.alias("index"),
            chosen(s)["decoded_token"].alias("text_unit"),
        ),
    )


def token_ll(steps: Column) -> Column:
    return _units(steps, step_ll)


def token_nll(steps: Column) -> Column:
    return _units(steps, step_nll)


def token_entropy(steps: Column) -> Column:
    return _units(steps, step_entropy)


def token_inflection(steps: Column) -> Column:
    """M3: LL_t - LL_{t-1} over the kept steps; null at the first one.

    Row-local (``i - 1`` inside the array), so no window and no shuffle.
    """
    kept = F.filter(steps, lambda s: s.isNotNull() & (F.size(s) > 0))
    return F.transform(
        kept,
        lambda s, i: F.struct(
            F.when(i > 0, step_ll(s) - step_ll(F.get(kept, i - 1))).alias("value"),
            i.alias("index"),
            chosen(s)["decoded_token"].alias("text_unit"),
        ),
    )


def answer_steps(steps: Column, prefix_length: Column) -> Column:
    """Steps at or after ``prefix_length`` (the generated answer)."""
    n = F.size(steps)
    start = F.least(F.greatest(prefix_length, F.lit(0)), n)
    return F.slice(steps, start + 1, F.greatest(n - start, F.lit(0)))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def sequence_ppl(steps: Column, prefix_length: Column) -> Column:
    """M7: exp(-mean chosen logprob) over answer steps; none -> +inf.

    ``exp`` overflows to +inf in Spark, matching the reference's guard.
    """
    lls = F.transform(
        F.filter(answer_steps(steps, prefix_length), lambda s: F.size(s) > 0),
        lambda s: step_ll(s),
    )
    return _let(lls, lambda v: F.when(F.size(v) > 0, F.exp(-_mean(v))).otherwise(F.lit(float("inf"))))


def sequence_mean_ll(steps: Column, prefix_length: Column) -> Column:
    """M9 without the exp/log round trip: -ln(ppl) == mean chosen logprob."""
    lls = F.transform(
        F.filter(answer_steps(steps, prefix_length), lambda s: F.size(s) > 0),
        lambda s: step_ll(s),
    )
    return _let(lls, lambda v: F.when(F.size(v) > 0, _mean(v)))


def sequence_cme(steps: Column, prefix_length: Column) -> Column:
    """M8: mean step entropy (nats) over answer steps; none valid -> +inf."""
    ents = F.filter(
        F.transform(answer_steps(steps, prefix_length), step_entropy_nats),
        lambda e: e.isNotNull(),
    )
    return _let(ents, lambda v: F.when(F.size(v) > 0, _mean(v)).otherwise(F.lit(float("inf"))))


def invert_ppl(score: Column) -> Column:
    """M9: larger is better."""
    return -F.log(score)


def invert_entropy(score: Column) -> Column:
    """Larger is better."""
    return F.lit(1.0) - score


# ------------------------------------------------------------------ registry

# A metric is one expression of one of three kinds:
#   step      a step -> its value
#   sequence  an array of steps -> array<struct<value, index, text_unit>>
#   word      a step -> its token's value, averaged over each word
MetricFn = Callable[[Column], Column]
KINDS = ("step", "sequence", "word")


class Metric(NamedTuple):
    kind: str
    fn: MetricFn


METRICS: dict[str, Metric] = {}


def register(name: str, fn: MetricFn, kind: str = "step") -> None:
    """The one registry of named metrics, built-in and the user's. A
    registered metric works on segments (``by_name.apply_metric``), on tables
    of step arrays (``by_name.apply_to_sequences``) and, but for words, as an
    expression over a step array (:func:`get_metric`)."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {KINDS}")
    if name in METRICS:
        raise RuntimeError(f"metric {name!r} is already registered")
    METRICS[name] = Metric(kind, fn)


def find_metric(name: str) -> Metric:
    try:
        return METRICS[name]
    except KeyError:
        raise KeyError(f"unknown metric {name!r}; known: {sorted(METRICS)}") from None


def get_metric(name: str) -> MetricFn:
    """The metric as ``array<step> -> array<unit>``."""
    kind, fn = find_metric(name)
    if kind == "word":
        raise ValueError(f"{name!r} groups tokens to words: apply it to a table")
    return fn if kind == "sequence" else lambda steps: _units(steps, fn)


register(TOKEN_LL, step_ll)
register(TOKEN_NLL, step_nll)
register(TOKEN_ENTROPY, step_entropy)
register(WORD_MEAN_ENTROPY, step_entropy, kind="word")
