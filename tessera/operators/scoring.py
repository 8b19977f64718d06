"""External scores and the table work around them.

Models (LLM logprobs, embeddings, NLI, LLM judges) are outside the engine.
What runs here: vector similarity and softmax as Catalyst expressions, the
verdict aggregates behind faithfulness / answer correctness, and a batch
scorer contract:

* ``results_with_function`` (and ``score_with_function``,
  ``steps_with_function`` on it) -- a scorer factory is called once per task
  (model/client setup), rows are scored with bounded concurrency across the
  task's batches and come out as calls end, a failing or late row gets ``ok =
  false`` and ``error = 'Type: message'`` while the others go on (E4, E5);
* ``score_with_table`` -- scores that already exist as a table (a cache of
  earlier calls, or a test double) are joined by key.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from the reference: default concurrency of model calls and
# the NLI label that carries the entailment probability.
DEFAULT_CONCURRENCY = 5
DEFAULT_TIMEOUT = 50.0
ENTAILMENT = "entailment"


# ------------------------------------------------------------ expressions


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equal-length vectors (the reference's
    "cosine" is a plain dot product, SURVEY Q10)."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def softmax_at(logits: Column, index: int) -> Column:
    """Numerically stable softmax, probability at ``index``."""
    m = F.array_max(logits)
    xs = F.transform(logits, lambda x: F.exp(x - m))
    return F.get(xs, index) / F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def entailment_index(id2label: dict[int, str]) -> int:
    """Index of the entailment label; the reference silently falls back to
    the last index (SURVEY Q14) -- here it is an error."""
    for i, name in id2label.items():
        if name.lower() == ENTAILMENT:
            return int(i)
    raise ValueError(f"no '{ENTAILMENT}' label in {id2label}")


def entailment_prob(logits: Column, id2label: dict[int, str]) -> Column:
    return softmax_at(logits.cast("array<double>"), entailment_index(id2label))


# ------------------------------------------------------------ row scoring


def similarity_rows(
    pairs: DataFrame, vectors: DataFrame, a_key: str, b_key: str, vec_key: str, vec: str
) -> DataFrame:
    """score = dot(vector[a_key], vector[b_key]); a missing vector
    fails only that row. Two many-to-one lookups of the vector table."""
    va = vectors.select(F.col(vec_key).alias(a_key), F.col(vec).alias("_va"))
    vb = vectors.select(F.col(vec_key).alias(b_key), F.col(vec).alias("_vb"))
    j = pairs.join(va, a_key, "left").join(vb, b_key, "left")
    ok = F.col("_va").isNotNull() & F.col("_vb").isNotNull()
    return j.withColumn("ok", ok).withColumn(
        "score", F.when(ok, dot(F.col("_va"), F.col("_vb")))
    ).withColumn(
        "error", F.when(~ok, F.lit("KeyError: missing vector"))
    ).drop("_va", "_vb")


def faithfulness(verdicts: DataFrame, key: str = "eval_id") -> DataFrame:
    """Supported statements / all statements per answer."""
    return verdicts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_statements"),
        F.avg(F.col("supported").cast("double")).alias("faithfulness"),
    )


def correctness_f1(verdicts: DataFrame, key: str = "eval_id") -> DataFrame:
    """E13 with weights [1, 0]: factual F1 = TP / (TP + (FP + FN) / 2)."""
    tp = F.count_if(F.col("kind") == "TP")
    fp = F.count_if(F.col("kind") == "FP")
    fn = F.count_if(F.col("kind") == "FN")
    g = verdicts.groupBy(key).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    den = F.col("tp") + (F.col("fp") + F.col("fn")) / 2.0
    return g.withColumn("answer_correctness", F.when(den > 0, F.col("tp") / den))


def score_with_table(
    rows: DataFrame, scores: DataFrame, key: str, score_col: str = "score"
) -> DataFrame:
    """Scores looked up by key; rows without one fail with an error."""
    j = rows.join(scores.select(key, score_col), key, "left")
    ok = F.col(score_col).isNotNull() & ~F.isnan(F.col(score_col))
    return j.withColumn("ok", ok).withColumn(
        "error", F.when(~ok, F.concat(F.lit("KeyError: "), F.col(key).cast("string")))
    )


ScoreFn = Callable[[dict], float]


def calls_in_flight(fn: Callable, items: Iterable, concurrency: int, timeout: float | None) -> Iterator[tuple]:
    """E5: ``(item, value, error)`` in the order in which calls end.

    At most ``concurrency`` calls run at once, and each has ``timeout`` seconds
    from its own start. A call over its time is given up: its item fails, its
    place goes to the next item, and what it returns later is not looked at. So
    a hung call delays no other. ``items`` is read as places become free.
    """
    ended: queue.SimpleQueue = queue.SimpleQueue()
    waiting, running, number = iter(items), {}, 0

    def work(k: int, item) -> None:
        try:
            ended.put((k, fn(item), None))
        except Exception as e:  # noqa: BLE001 - a failed call fails its item only
            ended.put((k, None, f"{type(e).__name__}: {e}"))

    more = True
    while True:
        while more and len(running) < max(1, concurrency):
            try:
                item = next(waiting)
            except StopIteration:
                more = False
                break
            running[number] = item, None if timeout is None else time.monotonic() + timeout
            threading.Thread(target=work, args=(number, item), daemon=True).start()  # a hung call must not hold the task
            number += 1
        if not running:
            return
        # Calls start in order and have the same time, so the first one running is due first.
        due = next(iter(running.values()))[1]
        try:
            k, value, error = ended.get(timeout=None if due is None else max(0.0, due - time.monotonic()))
        except queue.Empty:
            item, _ = running.pop(next(iter(running)))
            yield item, None, f"TimeoutError: no answer in {timeout:g} s"
            continue
        if k in running:
            yield running.pop(k)[0], value, error


def results_with_function(
    rows: DataFrame,
    scorer_factory: Callable[[], Callable],
    key: str | list[str],
    inputs: list[str],
    result: str,
    convert: Callable = lambda value: value,
    concurrency: int = DEFAULT_CONCURRENCY,
    timeout: float | None = DEFAULT_TIMEOUT,
    batch: bool = False,
    progress=None,
    out_rows: int = 256,
) -> DataFrame:
    """An external call per row (per Arrow batch of rows, with
    ``batch``); any result type.

    ``scorer_factory()`` runs once per task and returns ``fn(row_dict) ->
    value``, or ``fn([row_dict]) -> [value]``; ``convert`` makes a dict of the
    columns ``result`` (DDL) of a value. Output: the keys, those columns (null
    where the call failed), ``ok`` and ``error = 'Type: message'``, in the
    order in which calls end. ``progress``: a Spark accumulator of rows done.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fields = T.StructType.fromDDL(result)
    schema = T.StructType(
        [rows.schema[k] for k in keys] + fields.fields + [T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]
    )
    names = fields.fieldNames()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        fn = scorer_factory()

        def one(recs: list[dict]) -> list[dict]:
            values = fn(recs) if batch else [fn(recs[0])]
            done = [convert(v) for v in values]
            if len(done) != len(recs):
                raise ValueError(f"{len(done)} results for {len(recs)} rows")
            return done

        def items():
            for part in batches:
                recs = part.to_pylist()
                yield from ([recs] if batch else ([r] for r in recs))

        out: list[dict] = []
        for recs, values, error in calls_in_flight(one, items(), concurrency, timeout):
            if progress is not None:
                progress.add(len(recs))
            for i, r in enumerate(recs):
                value = dict.fromkeys(names) if error else values[i]
                out.append({k: r[k] for k in keys} | value | {"ok": error is None, "error": error})
            if len(out) >= out_rows:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select(*keys, *[c for c in inputs if c not in keys]).mapInArrow(run, schema)


def score_with_function(
    rows: DataFrame,
    scorer_factory: Callable[[], ScoreFn],
    key: str,
    inputs: list[str],
    score_name: str = "score",
    concurrency: int = DEFAULT_CONCURRENCY,
    progress=None,
    timeout: float | None = DEFAULT_TIMEOUT,
) -> DataFrame:
    """One number per row: ``key, ok, score, error``."""
    out = results_with_function(
        rows, scorer_factory, key, inputs, f"`{score_name}` double", lambda v: {score_name: float(v)}, concurrency, timeout, progress=progress
    )
    return out.select(key, "ok", score_name, "error")


STEPS_TYPE = "array<array<struct<decoded_token:string,logprob:double,rank:int>>>"


def steps_with_function(
    rows: DataFrame,
    scorer_factory: Callable[[], Callable],
    key: str,
    inputs: list[str],
    concurrency: int = DEFAULT_CONCURRENCY,
    timeout: float = DEFAULT_TIMEOUT,
    batch: bool = False,
) -> DataFrame:
    """Token steps from an external model, ``key, prompt_logprob,
    prefix_length, ok, error`` (the columns of the logprobs file, K1).

    ``scorer_factory()`` runs once per task and returns ``fn(row_dict) ->
    (steps, prefix_length)``, or with ``batch`` ``fn([row_dict]) -> [...]``; a
    step is a list of ``(decoded_token, logprob, rank)`` or None. A call that
    raises, or takes longer than ``timeout`` seconds, fails its row only
    (its rows, with ``batch``): no steps and prefix 0.
    """
    names = ("decoded_token", "logprob", "rank")

    def convert(value) -> dict:
        steps, prefix = value
        return {"prompt_logprob": [None if s is None else [dict(zip(names, a)) for a in s] for s in steps], "prefix_length": int(prefix)}

    out = results_with_function(
        rows, scorer_factory, key, inputs, f"prompt_logprob {STEPS_TYPE}, prefix_length int", convert, concurrency, timeout, batch
    )
    return out.select(
        key, F.coalesce("prompt_logprob", F.array().cast(STEPS_TYPE)).alias("prompt_logprob"),
        F.coalesce("prefix_length", F.lit(0)).alias("prefix_length"), "ok", "error",
    )
