"""Chat rendering proved by reparsing, with DataFrame expressions only.

Grammar of a conversation (``ROLE`` and ``TEXT`` hold no control string):

    conversation := turn*
    turn         := open body
    open         := "<s>" | "<e>"           plain or escaped content
    body         := "[INST]" ROLE NL TEXT "[/INST]"    any role but the assistant
                  | ROLE NL TEXT "</s>"                 the assistant, under the loss mask

A turn is first rendered plain, parsed again and compared with its source;
when that differs it is rendered escaped: a backslash doubles, and each control string (and a line end in a
role) gets a backslash after its first character.  Unescaping drops each
backslash that introduces a character, so it is exact.

Rows of one conversation are put in order in one row of the result; that is
the unit the output is defined on.  Defined results: null text and null role
count as empty, a null conversation id is a conversation, turns are ordered by
(turn, role, text) with null turns first, so ties and repeated rows are kept in
a fixed order; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
CONTROL = r"<s>|<e>|</s>|\[INST\]|\[/INST\]"


def escape(x: Column, role: bool = False) -> Column:
    doubled = F.regexp_replace(x, r"\\", r"\\\\")
    out = F.regexp_replace(doubled, r"([<\[])(?=s>|e>|/s>|INST\]|/INST\])", r"$1\\")
    return F.regexp_replace(out, "\n", r"\\n") if role else out


def unescape(x: Column, role: bool = False) -> Column:
    """Undo ``escape``: each backslash introduces one character."""
    if role:  # "\n" after an even number of backslashes is a line end
        x = F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def body(role: Column, text: Column) -> Column:
    inner = F.concat(role, F.lit("\n"), text)
    return F.when(role == ASSISTANT, F.concat(inner, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), inner, F.lit("[/INST]"))
    )


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation; a turn the grammar rejects has a null role."""
    opens = F.filter(F.split(formatted, r"(?=<[se]>)", -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        rest = F.substring(t, 4, 2147483647)
        inst = rest.startswith("[INST]") & rest.endswith("[/INST]")
        ends = ~rest.startswith("[INST]") & rest.endswith("</s>")
        content = F.when(inst, rest.substr(F.lit(7), F.length(rest) - 13)).when(
            ends, rest.substr(F.lit(1), F.length(rest) - 4)
        )
        at = F.instr(content, "\n")
        ok = (at > 0) & ~content.rlike(CONTROL)
        role = F.when(ok, content.substr(F.lit(1), at - 1))
        text = F.when(ok, content.substr(at + 1, F.length(content)))
        escaped = t.startswith("<e>")
        role = F.when(escaped, unescape(role, True)).otherwise(role)
        text = F.when(escaped, unescape(text)).otherwise(text)
        right = ends == (role == ASSISTANT)
        return F.struct(F.when(right, role).alias("role"), F.when(right, text).alias("text"))

    return F.transform(opens, turn)


def render_turn(role: Column, text: Column) -> Column:
    """Plain if the grammar gives the same turn back, else escaped."""
    plain = F.concat(F.lit("<s>"), body(role, text))
    back = parse(plain)
    same = (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == role) & (F.get(back, F.lit(0))["text"] == text)
    safe_role = F.when(role == ASSISTANT, role).otherwise(escape(role, True))
    safe = F.concat(F.lit("<e>"), body(safe_role, escape(text)))
    return F.when(F.coalesce(same, F.lit(False)), plain).otherwise(safe)


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, formatted, source turns, parsed turns, identical (the round trip's verdict)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("_k"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_r"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_x"),
    )
    # Rendered turn by turn before grouping, so the work is spread by rows.
    rows = rows.withColumn("_f", render_turn(F.col("_r"), F.col("_x")))
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_k", "_r", "_x", "_f"))).alias("_turns")
    )
    out = grouped.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["_f"]), "").alias("formatted"),
        F.transform("_turns", lambda t: F.struct(t["_r"].alias("role"), t["_x"].alias("text"))).alias("source"),
    )
    out = out.withColumn("turns", parse(F.col("formatted")))
    return out.withColumn("identical", F.coalesce(F.col("turns") == F.col("source"), F.lit(False)))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the parser reads back from the rendered text."""
    turns = F.col("turns")
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter(turns, lambda t: t["role"] == ASSISTANT), lambda t: t["text"])
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(F.array_join(loss, "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(loss, ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
