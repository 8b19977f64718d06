import pytest
from pyspark.sql import functions as F

from conftest import step
from tessera.functions.steps import SEQ
from tessera.operators.segments import segment_quarantine, segment_steps


def py_segments(steps, question, prefix):
    """Character-overlap rule, original positions for every step."""
    toks = [(i, s[0]["decoded_token"]) for i, s in enumerate(steps[:prefix]) if s]
    text, starts = "", {}
    for i, t in toks:
        starts[i] = len(text)
        text += t
    c = text.find("context: ")
    cs = c + 9 if c >= 0 else -1
    q = text.find("question: ", cs if cs >= 0 else 0)
    qs, qe = (q + 10, q + 10 + len(question)) if q >= 0 else (-1, -1)
    ce = (q if q >= 0 else len(text)) if cs >= 0 else -1
    ctx = {i for i, t in toks if cs >= 0 and len(t) and starts[i] < ce and starts[i] + len(t) > cs}
    qq = {i for i, t in toks if qs >= 0 and len(t) and starts[i] < qe and starts[i] + len(t) > qs}
    if not qq:
        return None
    fni = min(ctx | qq)
    out = []
    for i, t in toks:
        seg = "instruct" if i < fni else "context" if i in ctx else "question" if i in qq else None
        if seg:
            out.append((seg, i))
    out += [("answer", i) for i, s in enumerate(steps) if i >= prefix and s]
    return out


def toks(*ts):
    return [step(-0.5, -1.0, tok=t) for t in ts]


CASES = [
    # leading null step, null in the middle, empty step, marker split across tokens
    ([None] + toks("sys ", "cont", "ext: ", "pas", "sage\nquest", "ion: ", "wh", "at?", " <end>") + [None, []] + toks("ans", "wer"),
     "what?", 10),
    # no context marker
    (toks("question: ", "hi", " there", "<e>") + toks("a"), "hi there", 4),
    # question marker inside the context text: first match after the context start
    (toks("context: ", "a question: b", "\nquestion: ", "q1") + toks("x"), "q1", 4),
    # emoji and combining characters
    (toks("context: ", "😀é", "́", "\nquestion: ", "😀", "?") + toks("y"), "😀?", 6),
    # no question marker -> quarantine
    (toks("context: ", "abc") + toks("z"), "abc", 2),
    # empty question -> quarantine
    (toks("context: ", "abc", "\nquestion: ") + toks("z"), "", 3),
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, q, pl, s) for i, (s, q, pl) in enumerate(CASES)]
    return spark.createDataFrame(rows, f"eval_id int, question string, prefix_length int, prompt_logprob {SEQ.simpleString()}")


def test_segments_match_rule(frame):
    got = {}
    for r in segment_steps(frame).collect():
        got.setdefault(r["eval_id"], []).append((r["segment"], r["pos"]))
    for i, (s, q, pl) in enumerate(CASES):
        want = py_segments(s, q, pl)
        if want is None:
            assert i not in got
        else:
            assert sorted(got[i], key=lambda x: x[1]) == want, i


def test_quarantine(frame):
    bad = {r["eval_id"]: r["error"] for r in segment_quarantine(frame).collect()}
    assert bad == {4: "question is empty tokens", 5: "question is empty tokens"}


def test_top_logprob_steps_append_to_answer(spark):
    s = toks("context: ", "c", "\nquestion: ", "q")
    df = spark.createDataFrame([(1, "q", 4, s, [step(-0.3, tok="g1"), step(-0.4, tok="g2")])],
                               f"eval_id int, question string, prefix_length int, prompt_logprob {SEQ.simpleString()}, top {SEQ.simpleString()}")
    seg = segment_steps(df, top_steps="top").where("segment = 'answer'").orderBy("pos")
    assert [r["step"][0]["decoded_token"] for r in seg.collect()] == ["g1", "g2"]


def test_segment_counts_within_steps(spark):
    from conftest import SF_SMALL
    from tessera.plans.fixtures import f2_prompts

    f2 = f2_prompts(spark, SF_SMALL).where("ok")
    seg = segment_steps(f2).groupBy("eval_id").agg(F.count(F.lit(1)).alias("n_seg"))
    steps = f2.select("eval_id", F.size(F.filter("prompt_logprob", lambda s: s.isNotNull())).alias("n_steps"))
    bad = seg.join(steps, "eval_id").where(F.col("n_seg") > F.col("n_steps")).count()
    assert bad == 0 and seg.count() == f2.count()


def test_an_empty_question_holds_no_token(spark):
    # The token " x" spans the place after the marker, but an empty question has no character there.
    s = toks("context: ", "c", "\nquestion:", " x", "a")
    df = spark.createDataFrame([(1, "", 4, s)], f"eval_id int, question string, prefix_length int, prompt_logprob {SEQ.simpleString()}")
    assert segment_steps(df).count() == 0 and segment_quarantine(df).count() == 1


def test_no_row_carries_the_whole_step_array(spark):
    """A long text costs its steps once: beside the generator only narrow columns stay."""
    import re

    df = spark.createDataFrame([(1, "q", 2, [])], f"eval_id int, question string, prefix_length int, prompt_logprob {SEQ.simpleString()}")
    plan = segment_steps(df, clustered=True)._jdf.queryExecution().executedPlan().toString()
    made, kept = re.search(r"Generate posexplode\((\w+#\d+)\), \[([^\]]*)\]", plan).groups()
    assert made not in kept and "prompt_logprob" not in kept


def test_prompts_are_mapped_without_sort_or_window(spark, frame):
    """A long prompt is mapped in its row: its steps are neither sorted nor kept in a window."""
    for top in (None, "prompt_logprob"):
        plan = segment_steps(frame, top_steps=top)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan and plan.count("Generate ") == 1


def test_rows_of_one_key_are_one_prompt(spark):
    """As before, rows that share a key have their characters counted over the steps of all of them."""
    s = toks("in ", "context: ", "aa", "bb", "\nquestion: ", "cc", "dd", "<end>") + toks("x", "y")
    rows = [(1, "ccdd", 8, s), (None, "ccdd", 8, s), (1, "ccdd", 8, s), (2, "ccdd", 8, s), (None, "ccdd", 8, s), (1, "ccdd", 8, s)]
    df = spark.createDataFrame(rows, f"eval_id int, question string, prefix_length int, prompt_logprob {SEQ.simpleString()}")
    got = {}
    for r in segment_steps(df).collect():
        got.setdefault(r["eval_id"], []).append((r["pos"], r["segment"]))
    text = "".join(x[0]["decoded_token"] for x in s[:8])
    cs, qp = text.find("context: ") + 9, text.find("question: ")
    marks = [("context", cs, qp), ("question", qp + 10, qp + 14)]
    for key, copies in ((1, 3), (2, 1), (None, 2)):
        want, at, first = [], 0, None
        for pos in range(10):
            for _ in range(copies):
                n = len(s[pos][0]["decoded_token"]) if pos < 8 else 0
                name = next((m for m, lo, hi in marks if pos < 8 and at < hi and at + n > lo), "answer" if pos >= 8 else None)
                at += n
                if name in ("context", "question") and first is None:
                    first = pos
                want.append((pos, name))
        want = [(p, "instruct" if p < first else m) for p, m in want if p < first or m]
        assert sorted(got[key]) == sorted(want), key
