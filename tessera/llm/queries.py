"""Registered queries of the llm operators over the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    chat, collocations, decontamination, hmm, jaccard, merkle, neighbours, packing, pii, quality, tokenfile, toxicity, urls,
)
from tessera.llm.common import fold, table
from tessera.session import ensure_checkpoint_dir

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_failed_lines", "lost_chars",
    )


def q_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def q_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(
        F.inline(F.array(*(
            F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
            for k, role in enumerate(("user", "assistant"))
        )))
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(turns)).drop("identical")


#: Categories of the shared labels, in chain order.
TOXICITY = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), TOXICITY)
    return toxicity.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= chain.thresholds[chain.categories.index("toxic")])


def q_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokenfile.read_tokens(spark, path).drop("ids")


def q_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The SQL has no number of links; op10_jaccard_links has.
    return q_jaccard_links(spark, sf_dir).drop("n_links")


def q_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def q_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    now = F.when(changed, fold(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), LEAF_FIELDS, "doc_id", "source", {"text": now})


def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def q_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": q_packing,
    "op2_quality_rules": q_quality,
    "op3_hmm_scoring": q_hmm,
    "op4_chat_formatting": q_chat,
    "op5_toxicity": q_toxicity,
    "op6_url_filters": q_urls,
    "op7_token_files": q_tokens,
    "op8_pii": q_pii,
    "op9_decontamination": q_decontamination,
    "op10_jaccard_join": q_jaccard,
    "op10_jaccard_links": q_jaccard_links,
    "op11_merkle_manifest": q_merkle,
    "op12_nearest_neighbours": q_neighbours,
    "op13_collocations": q_collocations,
}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION_SQL = rf"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), items as (
  select distinct item, m, array_to_string(w[i : i + m - 1], ' ') as win
  from (select item, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), windows as (
  select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as win
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select distinct m from items) where len(w) >= m)
), hits as (
  select doc_id, i, windows.m, item from windows join items using (win)
), n as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hits) group by 1
), names as (
  select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by 1
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join n using (doc_id) left join names using (doc_id)
"""

JACCARD_SQL = rf"""
with recursive w as (
  select doc_id, {_WORDS.format(t=f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by 1),
links as (
  select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), edges as (
  select x, y from links join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 80 * (p.n + q.n - i)
), reach(doc_id, c) as (
  select doc_id, doc_id from documents union select e.y, r.c from reach r join edges e on e.x = r.doc_id where r.c < e.y
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id
from w left join n using (doc_id) join (select doc_id, min(c) as c from reach group by 1) m using (doc_id)
"""

URL_SQL = """
with p as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '%s', '%s') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from p
), rules(rh, rp, v) as (values %s),
fits as (
  select page_id, rh || rp as rule, v, row_number() over (partition by page_id order by length(rh || rp) desc, length(rh) desc) as k
  from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
)
select h.page_id, host, path, rule, coalesce(v, 'allow') as verdict from h left join fits on fits.page_id = h.page_id and k = 1
""" % (UPPER, UPPER.lower(), ", ".join(str(r) for r in URL_RULES))


_CONTROL = r"<s>|<e>|</s>|\[INST\]|\[/INST\]"

CHAT_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f as (
  select *, regexp_matches(x, '{_CONTROL}') or regexp_matches(r, '{_CONTROL}') or contains(r, chr(10)) as escaped,
         3 + length(r) + 1 + length(x) + case when r = '{chat.ASSISTANT}' then 4 else 13 end as plain,
         length(r || x) - length(replace(r || x, chr(92), '')) + length(r) - length(replace(r, chr(10), ''))
           + len(regexp_extract_all(x, '{_CONTROL}')) + len(regexp_extract_all(r, '{_CONTROL}')) as extra
  from t
), g as (
  select conv_id, count(*)::BIGINT as n_turns,
         string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x) as turns,
         coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (where r = '{chat.ASSISTANT}'), '') as loss,
         sum(plain + case when escaped then extra else 0 end)::BIGINT as formatted_chars
  from f group by conv_id
)
select conv_id::BIGINT as conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::BIGINT as loss_chars,
       sha256(loss) as loss_sha256, formatted_chars from g
"""

_Q = quality
#: DuckDB's patterns have no possessive forms and need none.
_MENU_SQL = quality.MENU.replace("*+", "*").replace("++", "+").replace("(?iu)", "(?i)")
QUALITY_SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, {_WORDS.format(t="coalesce(text, '')")} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{_Q.BLANKS}]')) as lines
  from documents
), s as (
  select doc_id, i, array_to_string(w[i : i + {_Q.REPEAT_WINDOW - 1}], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - {_Q.REPEAT_WINDOW} + 2)) as i from d)
), again as (
  select doc_id, count(distinct p) as n
  from (select doc_id, unnest(range(i, i + {_Q.REPEAT_WINDOW})) as p
        from (select doc_id, i, count(*) over (partition by doc_id, g) as c from s) where c > 1)
  group by doc_id
), m as (
  select doc_id, l, length(regexp_replace(l, '[{_Q.BLANKS}]+', '', 'g')) as size,
         length(l) - length(regexp_replace(l, '[{_Q.SYMBOLS}]', '', 'g')) as symbols,
         length(regexp_replace(l, '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')) as letters,
         length(l) - length(translate(l, '|»·•', '')) as bars, len(regexp_extract_all(l, '[^{_Q.BLANKS}]+')) as nw
  from (select doc_id, unnest(lines) as l from d)
), bad as (
  select doc_id, count(*) as n, sum(size) as lost from m
  where symbols * 100 > size * {_Q.MAX_SYMBOL_PERCENT} or letters * 100 < size * {_Q.MIN_LETTER_PERCENT}
     or ((regexp_matches(l, '{_MENU_SQL}') or bars >= {_Q.NAV_BARS}) and nw <= {_Q.NAV_WORDS}) or (length(l) <= {_Q.BOILERPLATE_CHARS} and regexp_matches(lower(l), '{_Q.BOILERPLATE}'))
  group by doc_id
), o as (
  select doc_id, len(w)::BIGINT as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT as word_chars,
         (length(t) - length(regexp_replace(t, '[{_Q.SYMBOLS}]', '', 'g')))::BIGINT as n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT as n_dup_lines, coalesce(again.n, 0)::BIGINT as n_repeat_words,
         coalesce(bad.n, 0)::BIGINT as n_failed_lines, coalesce(bad.lost, 0)::BIGINT as lost_chars
  from d left join again using (doc_id) left join bad using (doc_id)
), b as (
  select *, n_words < {_Q.MIN_WORDS} or 100 * n_repeat_words > {_Q.MAX_REPEAT_PERCENT} * n_words as base_failed from o
)
select *, not base_failed and lost_chars * 100 <= word_chars * {_Q.MAX_LOST_PERCENT} as kept from b
"""


def _merkle_sql(levels: int = 5) -> str:
    """The tree with ``levels`` levels below and above the subroots: enough for 16 ** levels rows a source and sources."""
    fields = " || ".join(
        f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end" for c in LEAF_FIELDS
    )
    changed = fields.replace("text", "now")
    crc = (
        "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), c -> ascii(c)), lambda c, b: "
        "list_reduce([xor(c, b)] || range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"
    ).replace("c -> ascii(c)", "lambda c: ascii(c)::bigint")

    def up(name: str, count: int) -> str:
        steps = ""
        for k in range(1, count + 1):
            steps += f"""
, {name}{k} as (
  select g, i // 16 as i, sha256(string_agg(h, '' order by i)) as h, max(m + 15) // 16 as m from {name}{k - 1} where m > 1 group by g, i // 16
), {name}p{k - 1} as (
  select g, i, h, m, coalesce(string_agg(h, '') over (partition by g, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(h, '') over (partition by g, i // 16 order by i rows between 1 following and unbounded following), '') as r
  from {name}{k - 1} where m > 1
)"""
        return steps

    def walk(name: str, count: int, start: str, cur: str) -> str:
        """Folds ``cur`` and gathers siblings along the levels of one tree; ``n``: its place, 0 after the first level."""
        steps, last = "", start
        for k in range(count):
            steps += f"""
, {cur}{k} as (
  select f.* exclude (cur, proof, i), i // 16 as i,
         case when p.g is null then cur else sha256(p.l || cur || p.r) end as cur, proof || coalesce(p.l || p.r, '') as proof
  from {last} f left join {name}p{k} p using (g, i)
)"""
            last = f"{cur}{k}"
        return steps

    return f"""
with d as (
  select *, case when {crc} % 5 = 0 then translate(text, '{UPPER}', '{UPPER.lower()}') else text end as now from documents
), a0 as (
  select coalesce('=' || source, '') as g, doc_id, sha256({fields}) as h, sha256({changed}) as cur from d
), lv0 as (
  select *, row_number() over (partition by g order by doc_id nulls first, h, cur) - 1 as i, count(*) over (partition by g) as m from a0
){up('lv', levels)}
, ends as ({' union all '.join(f'select g, h as subroot from lv{k} where m = 1' for k in range(levels + 1))})
, tp0 as (
  select '' as g, g as of, subroot as h, row_number() over (order by g) - 1 as i, count(*) over () as m from ends
){up('tp', levels)}
, top as ({' union all '.join(f'select h as root from tp{k} where m = 1' for k in range(levels + 1))})
, s0 as (select g, i, doc_id, h as leaf, cur, '' as proof from lv0){walk('lv', levels, 's0', 'w')}
, s1 as (
  select w.g as of, '' as g, tp0.i as i, doc_id, leaf, tp0.h as subroot, cur, proof from w{levels - 1} w join tp0 on tp0.of = w.g
){walk('tp', levels, 's1', 'v')}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, cur as folded_root, cur = root as verified from v{levels - 1}, top
"""


COLLOCATIONS_SQL = rf"""
with p as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p
), total as (select lang, sum(len(w))::bigint as n from w group by lang
), f as (
  select lang, m, phrase, count(*) as f from (
    select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase
    from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest(range(1, {collocations.MAX_WORDS + 1})) as m) where len(w) >= m)
  ) group by all having count(*) >= {collocations.MIN_COUNT}
), cuts as (
  select lang, m, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m > 1
), scored as (
  select c.lang, c.m, c.phrase, c.a, k, x.f as l, y.f as r, n, 1000::hugeint * c.a * n // (x.f::hugeint * y.f) as score
  from cuts c join total using (lang)
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : k], ' ') and x.m = k
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1 : c.m], ' ') and y.m = c.m - k
  qualify row_number() over (partition by c.lang, c.phrase order by score, k) = 1
), parts as (
  select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, max(a) as c
  from (select lang, w, a, k, unnest(range(1, m - k + 2)) as i from cuts) group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from scored left join parts using (lang, phrase) where c is null or 100 * c < {collocations.COVER_PERCENT} * a
qualify rank <= {collocations.TOP}
"""


def oracle() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op2_quality_rules": QUALITY_SQL,
        "op4_chat_formatting": CHAT_SQL,
        "op6_url_filters": URL_SQL,
        "op9_decontamination": DECONTAMINATION_SQL,
        "op10_jaccard_join": JACCARD_SQL,
        "op11_merkle_manifest": _merkle_sql(),
        "op13_collocations": COLLOCATIONS_SQL,
    }
