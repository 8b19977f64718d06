"""Perturb a context at its most significant text units.

Units (``key, index, text_unit, value``) come from a context metric. Per key:
rank units by value (descending by default; ties keep text order), mask the
top N, split the masked text into sentences and pack them into chunks of
fewer than 200 words (only chunks with a mask go to the fill-mask model),
draw one candidate per mask with weights ``1 - score`` and put the draws
back in order. The model is outside the engine: its output is a candidate
table ``key, mask_no, cand_no, token_str, score`` (from a scorer or a cache).

Draws are hashed (``hash_u(seed, key, mask_no)``) instead of a shared random
stream, so results do not depend on row order (SURVEY Q21).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_u
from tessera.operators.words import BLANK_CLASS

# Fixed values from the reference: mask token, candidates per mask, chunk
# word limit (the code's 200, not the docstring's 300, SURVEY Q9).
MASK = "<mask>"
TOP_K = 5
CHUNK_WORDS = 200


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: trim the characters ``str.isspace`` accepts."""
    return F.regexp_replace(c, f"^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+$", "")


def word_count(c: Column) -> Column:
    """``len(s.split())`` with Python's whitespace rules."""
    return F.size(F.filter(F.split(c, f"[{BLANK_CLASS}]+", -1), lambda x: x != ""))


def rank_units(units: DataFrame, key: str, n: int, ascending: bool = False) -> DataFrame:
    """B1-B2: ``rn`` by value (ties: lower index first) and ``masked``."""
    order = F.col("value").asc() if ascending else F.col("value").desc()
    w = Window.partitionBy(key).orderBy(order, F.col("index").asc())
    return units.withColumn("rn", F.row_number().over(w)).withColumn(
        "masked", F.col("rn") <= n
    )


def masked_texts(ranked: DataFrame, key: str) -> DataFrame:
    """Per key, the text with the top units replaced by ``<mask>`` and
    the masked unit indexes in text order (``mask_no`` = position there)."""
    piece = F.when(F.col("masked"), F.lit(MASK)).otherwise(F.col("text_unit"))
    g = ranked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("index", piece.alias("t")))).alias("_u"),
        F.array_sort(F.collect_list(F.when(F.col("masked"), F.col("index")))).alias("masked_idx"),
    )
    return g.select(
        key,
        F.array_join(F.transform("_u", lambda x: x["t"]), "").alias("masked_text"),
        "masked_idx",
    )


def _count_le(sorted_arr: Column, x: Column, steps: int = 32) -> Column:
    """Number of elements ``<= x`` in an ascending int array (binary search)."""

    def step(acc: Column, _k: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        right = F.element_at(sorted_arr, mid + 1) <= x
        return F.when(
            lo < hi,
            F.when(right, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi"))),
        ).otherwise(acc)

    init = F.struct(F.lit(0).alias("lo"), F.size(sorted_arr).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda a: a["lo"])


def sentence_chunks(texts: DataFrame, key: str, text: str = "masked_text") -> DataFrame:
    """Sentences split after every '.', empty pieces dropped, packed
    greedily: a chunk is closed when ``words + next >= 200`` and it is not
    empty. The greedy fold runs inside the row (``aggregate``), linear in
    the sentence count.

    Output: ``key, chunk_no, text, n_words, n_masks, has_mask``.
    """
    sents = F.filter(F.split(F.col(text), r"(?<=\.)", -1), lambda s: s != "")
    t = texts.select(key, sents.alias("_s")).withColumn(
        "_w", F.transform("_s", lambda s: word_count(s))
    )
    # The fold only records where chunks start (appended once per chunk, so
    # the array grows with the chunk count, not the sentence count); each
    # sentence's chunk number is then a binary search over those starts.
    init = F.struct(
        F.lit(0).alias("cur"), F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, w: Column) -> Column:
        flush = (acc["cur"] + w >= CHUNK_WORDS) & (acc["i"] > 0)
        return F.struct(
            F.when(flush, w).otherwise(acc["cur"] + w).alias("cur"),
            (acc["i"] + 1).alias("i"),
            F.when(flush, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    t = t.withColumn("_starts", F.aggregate("_w", init, step)["starts"])
    t = t.withColumn(
        "_ids", F.transform("_s", lambda _s, i: _count_le(F.col("_starts"), i))
    )
    ex = t.select(
        key,
        F.posexplode_outer(F.arrays_zip(F.col("_s").alias("s"), F.col("_w").alias("w"), F.col("_ids").alias("c"))).alias("i", "z"),
    )
    ex = ex.where(F.col("i").isNotNull())
    g = ex.groupBy(key, F.col("z.c").alias("chunk_no")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("z.s").alias("s")))), lambda x: x["s"]),
            "",
        ).alias("text"),
        F.sum("z.w").alias("n_words"),
    )
    n_masks = (F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit(MASK), F.lit("")))) / len(MASK)
    return g.withColumn("n_masks", n_masks.cast("int")).withColumn("has_mask", F.col("n_masks") > 0)


def inverse_prob_draws(cands: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One stripped draw per ``(key, mask_no)``.

    Blank candidates are dropped unless all are blank (then the first one is
    kept); weights ``(1 - score) / sum(1 - score)``, uniform when the sum is
    not positive; the draw is the first candidate whose normalised running
    weight exceeds ``hash_u(seed, key, mask_no)`` (inverse-CDF sampling).
    """
    grp = Window.partitionBy(key, "mask_no")
    c = cands.withColumn("_blank", py_strip(F.col("token_str")) == "")
    c = c.withColumn("_any", F.max((~F.col("_blank")).cast("int")).over(grp))
    c = c.withColumn("_first", F.min("cand_no").over(grp))
    kept = c.where(
        ((F.col("_any") == 1) & ~F.col("_blank")) | ((F.col("_any") == 0) & (F.col("cand_no") == F.col("_first")))
    )
    inv = F.lit(1.0) - F.col("score")
    kept = kept.withColumn("_inv", inv).withColumn("_tot", F.sum("_inv").over(grp)).withColumn(
        "_n", F.count(F.lit(1)).over(grp)
    )
    kept = kept.withColumn(
        "_w", F.when(F.col("_tot") > 0, F.col("_inv") / F.col("_tot")).otherwise(F.lit(1.0) / F.col("_n"))
    )
    ordw = grp.orderBy("cand_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = kept.withColumn("_cum", F.sum("_w").over(ordw)).withColumn(
        "_wsum", F.sum("_w").over(grp)
    )
    u = hash_u(F.lit(seed), F.col(key), F.col("mask_no"))
    hit = kept.where(F.col("_cum") / F.col("_wsum") > u)
    return hit.groupBy(key, "mask_no").agg(
        F.min_by(F.col("token_str"), F.col("cand_no")).alias("_tok")
    ).select(key, "mask_no", py_strip(F.col("_tok")).alias("draw"))


def apply_draws(ranked: DataFrame, draws: DataFrame, key: str) -> DataFrame:
    """Rebuild the text with the draws in mask order (a mask
    without a draw stays ``<mask>``) and the change set index -> draw.
    ``n_masks`` / ``n_draws`` come from the same aggregate."""
    mw = Window.partitionBy(key, "masked").orderBy("index")
    r = ranked.withColumn("mask_no", F.when(F.col("masked"), F.row_number().over(mw) - 1))
    r = r.join(draws, [key, "mask_no"], "left")
    piece = F.when(F.col("masked"), F.coalesce(F.col("draw"), F.lit(MASK))).otherwise(F.col("text_unit"))
    drawn = F.col("masked") & F.col("draw").isNotNull()
    g = r.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("index", piece.alias("t")))).alias("_u"),
        F.array_sort(F.collect_list(F.when(drawn, F.struct("index", "draw")))).alias("_c"),
        F.count_if(F.col("masked")).alias("n_masks"),
        F.count_if(drawn).alias("n_draws"),
    )
    return g.select(
        key,
        F.array_join(F.transform("_u", lambda x: x["t"]), "").alias("context"),
        F.map_from_entries("_c").alias("change_set"),
        "n_masks",
        "n_draws",
    )


MASKS_TYPE = "array<array<struct<token_str:string,score:double>>>"


def mask_calls(ranked: DataFrame, key: str) -> DataFrame:
    """The model's inputs, one row per chunk that has a mask (no other
    reaches it): ``key, chunk_no, text, n_masks, first_mask``; ``first_mask``
    counts the key's masks in earlier chunks."""
    chunks = sentence_chunks(masked_texts(ranked, key), key).where("has_mask")
    before = Window.partitionBy(key).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(
        key, "chunk_no", "text", "n_masks", F.coalesce(F.sum("n_masks").over(before), F.lit(0)).cast("int").alias("first_mask")
    )


def fill_with_function(calls: DataFrame, scorer_factory, key: str, **how) -> DataFrame:
    """B7 by an external model: ``fn({'text': ...})`` returns per mask a list
    of ``(token_str, score)``. Adds ``masks, ok, error``; ``how`` goes to
    :func:`tessera.operators.scoring.results_with_function`."""
    from tessera.operators.scoring import results_with_function

    def convert(value) -> dict:
        return {"masks": [[{"token_str": t, "score": float(p)} for t, p in mask] for mask in value]}

    return results_with_function(calls, scorer_factory, [key, "chunk_no", "first_mask", "n_masks"], ["text"], f"masks {MASKS_TYPE}", convert, **how)


def fill_with_table(calls: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """B7 from earlier results ``text, masks``: a chunk whose text has none fails."""
    found = cache.select(F.sha2("text", 256).alias("_h"), "masks")
    out = calls.withColumn("_h", F.sha2("text", 256)).join(found, "_h", "left")
    ok = F.col("masks").isNotNull()
    return out.select(
        key, "chunk_no", "first_mask", "n_masks", "masks", ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("KeyError: no candidates for chunk "), F.col("chunk_no").cast("string"))).alias("error"),
    )


def mask_candidates(filled: DataFrame, key: str) -> DataFrame:
    """``key, mask_no, cand_no, token_str, score`` of all answered calls,
    masks numbered over the key's whole text."""
    masks = filled.where("ok").select(key, "first_mask", F.posexplode("masks").alias("_m", "cands"))
    return masks.select(
        key, (F.col("first_mask") + F.col("_m")).alias("mask_no"), F.posexplode("cands").alias("cand_no", "c")
    ).select(key, "mask_no", "cand_no", "c.token_str", "c.score")


def call_status(filled: DataFrame, key: str) -> DataFrame:
    """``key, ok, error``: a key fails with the first of its calls that failed."""
    return filled.groupBy(key).agg(
        F.bool_and("ok").alias("ok"), F.min_by("error", F.when(~F.col("ok"), F.col("chunk_no"))).alias("error")
    )


def perturb(
    units: DataFrame, cands: DataFrame, key: str, n: int, ascending: bool = False, seed: int = 42,
    status: DataFrame | None = None,
) -> DataFrame:
    """B1-B14 end to end: ``key, context, change_set``. A mask without a draw
    stays in the text. Keys whose ``status`` (:func:`call_status`) says that a
    call failed are left out, so the B15 left join gives them a null context;
    a key without a status had no call to fail."""
    ranked = rank_units(units, key, n, ascending)
    draws = inverse_prob_draws(cands, key, seed)
    out = apply_draws(ranked, draws, key).drop("n_masks", "n_draws")
    if status is not None:
        out = out.join(status.where(~F.col("ok")).select(key), key, "left_anti")
    return out


def perturb_with_model(units: DataFrame, fill, key: str, n: int, ascending: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The whole chain from units to ``(key, context, change_set)`` and the
    status of the keys that had calls. ``fill`` answers :func:`mask_calls`
    (:func:`fill_with_function` or :func:`fill_with_table`); its results are
    written once, as both candidates and status read them."""
    from tessera.session import materialize

    units = materialize(units)
    filled = materialize(fill(mask_calls(rank_units(units, key, n, ascending), key)))
    status = call_status(filled, key)
    return perturb(units, mask_candidates(filled, key), key, n, ascending, seed, status), status


def merge_perturbed(qa: DataFrame, ptb: DataFrame, key: str) -> DataFrame:
    """Left join of the QA set to ``(key, context, change_set)``."""
    return qa.join(ptb, key, "left")
