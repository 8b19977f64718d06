"""M6: glue tokens into words and average their metric (gap-and-island).

The reference walks the tokens of a sequence and starts a new word at a token
that begins with a word-start character *and* when the text gathered so far is
not blank. As a set computation (SURVEY 7.4):

1. ``cand`` = token starts with a word-start character;
2. a token with ``cand`` starts a word iff the last non-blank token before it
   lies at or after the previous ``cand`` token (i.e. the previous group has
   a non-blank token); ``word_no`` = running count of starts.

Both are running windows over ``(key..., pos)``; the caller partitions the
long shape by the key once and every window here reuses that partitioning.
A key is one token sequence (the steps of one array-shape row), whose length
the model's context bounds; ``eval_id`` must be unique per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values from the reference: characters that open a new word in the
# usual tokenizers (space, the byte-level-BPE space mark, newline, tab).
WORD_START_CHARS = (" ", "Ġ", "\n", "\t")

# The characters Python's str.strip() treats as blank
# (str.isspace), written as one class that Java and RE2 regexes both accept.
BLANK_CLASS = (
    r"\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_NOT_BLANK = "[^" + BLANK_CLASS + "]"


def is_word_start(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(list(WORD_START_CHARS))


def is_not_blank(token: Column) -> Column:
    return F.coalesce(token.rlike(_NOT_BLANK), F.lit(False))


def word_places(long_df: DataFrame, keys: list[str], pos: str = "pos", token: str = "token") -> DataFrame:
    """Adds ``_rn`` (a token's place, from 0) and ``_word`` (its word's number, from 0)."""
    w = Window.partitionBy(*keys).orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    t = (
        long_df.withColumn("_cand", is_word_start(F.col(token)))
        .withColumn("_rn", F.row_number().over(w) - 1)
        .withColumn(
            "_last_nb",
            F.max(F.when(is_not_blank(F.col(token)), F.col("_rn"))).over(before),
        )
        .withColumn(
            "_prev_cand",
            F.coalesce(F.max(F.when(F.col("_cand"), F.col("_rn"))).over(before), F.lit(0)),
        )
        .withColumn(
            "_start",
            (
                F.col("_cand")
                & (F.col("_rn") > 0)
                & F.coalesce(F.col("_last_nb") >= F.col("_prev_cand"), F.lit(False))
            ).cast("int"),
        )
        .withColumn("_word", F.sum("_start").over(upto))
    )
    return t.drop("_cand", "_last_nb", "_prev_cand", "_start")


def word_units(
    long_df: DataFrame,
    keys: list[str],
    pos: str = "pos",
    token: str = "token",
    value: str = "value",
) -> DataFrame:
    """Per key: ``index`` (word number from 0), ``text_unit``, ``value`` (mean)."""
    t = word_places(long_df, keys, pos, token)
    words = t.groupBy(*keys, "_word").agg(
        F.avg(value).alias("value"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.col(token).alias("t")))),
                lambda x: x["t"],
            ),
            "",
        ).alias("text_unit"),
    )
    # The reference emits the trailing buffer only when its text is non-empty.
    return words.where(F.col("text_unit") != "").select(
        *keys, F.col("_word").cast("int").alias("index"), "text_unit", "value"
    )
