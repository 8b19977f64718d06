"""Line-first cleaning with DataFrame expressions only.

Each line is judged by itself: punctuation rules (too many symbols, too few
letters), navigation rules (separator bars, menus of a few known words) and
boilerplate rules (legal, cookie, sign-up and script notices, in lines no longer
than notices are).  Terms are English, German, French and Spanish.  Failing lines
go; a document that loses too much of its text goes too.  Everything is a
row-local expression over arrays of lines and words: no shuffle, no Python.

Defined results: a null or wordless text has no words, fails the base rules
and is cleaned to an empty text; an empty table gives no rows; repeated rows are judged one by one; other
columns are not read.  Very long texts cost n log n in their own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: A document may lose this share of its words' characters to line rules.
MAX_LOST_PERCENT = 50
#: Symbols per hundred characters of words above which a line is junk.
MAX_SYMBOL_PERCENT = 30
#: Letters and digits per hundred characters of words that a line needs.
MIN_LETTER_PERCENT = 50
NAV_BARS = 3
NAV_WORDS = 12

SYMBOLS = "#*$%&|<>"
WORD = rf"[^{BLANKS}]+"

#: A line of at most NAV_WORDS words that consists of these only (and bars) is a menu.
#: A term stands before any shorter one it begins with, since the pattern takes the first that fits.
NAV_TERMS = (
    "home|menu|login|log in|logout|log out|sign in|search|about us|about|contactez-nous|contacto|contact us|contact|help|faq|sitemap|"
    "next|previous|back|top|share|print|skip to content|read more|more|"
    "startseite|menü|anmelden|abmelden|suche|über uns|kontakt|hilfe|weiterlesen|weiter|zurück|teilen|drucken|mehr|"
    "accueil|connexion|déconnexion|rechercher|à propos|aide|plan du site|suivant|précédent|partager|imprimer|lire la suite|"
    "inicio|menú|iniciar sesión|buscar|sobre nosotros|ayuda|mapa del sitio|siguiente|anterior|compartir|imprimir|leer más"
)
#: Possessive, so that a very long line of such words is matched in a loop, not by recursion.
MENU = rf"(?iu)^[{BLANKS}|>/»·•-]*+(?:(?:{NAV_TERMS})[{BLANKS}|>/»·•-]*+)++$"
#: A notice is short: such a phrase (in lower case) in a longer line (in characters) is part of a text.
BOILERPLATE_CHARS = 300
BOILERPLATE = (
    r"(all rights reserved|copyright (\(c\)|©|[0-9])|©|cookie(s)? (policy|settings|notice)|uses cookies|"
    r"accept (all )?cookies|privacy policy|terms (of|and) (use|service|conditions)|enable javascript|"
    r"subscribe to|sign up for|click here|lorem ipsum|licensed under|released under the|spdx-license|"
    r"alle rechte vorbehalten|datenschutzerklärung|cookie-richtlinie|verwendet cookies|cookies akzeptieren|nutzungsbedingungen|"
    r"newsletter abonnieren|hier klicken|javascript aktivieren|"
    r"tous droits réservés|politique de confidentialité|conditions d.utilisation|mentions légales|utilise des cookies|"
    r"accepter (tous )?les cookies|abonnez-vous|inscrivez-vous|cliquez ici|activer javascript|"
    r"todos los derechos reservados|política de (privacidad|cookies)|utiliza cookies|aceptar (todas )?las cookies|"
    r"términos (de|y) (uso|servicio|condiciones)|aviso legal|suscríbete|haga clic aquí|habilitar javascript)"
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{BLANKS}]+"), lambda w: w != "")


def window_hashes(words: Column, window: int = REPEAT_WINDOW) -> Column:
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window))),
    )
    return F.when(F.size(words) > window, hashes).otherwise(F.array().cast("array<bigint>"))


def sorted_windows(hashes: Column) -> Column:
    """Window hashes with their positions, sorted, so that equal ones are neighbours (empty if none are)."""
    spans = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(spans)).otherwise(none)


def repeated_starts(windows: Column, words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Positions, in order, of windows equal to a neighbour: hashes first, then the words themselves."""

    def same(s: Column, t: Column) -> Column:
        return (s["h"] == t["h"]) & (F.slice(words, s["i"] + 1, window) == F.slice(words, t["i"] + 1, window))

    starts = F.transform(
        windows,
        lambda s, k: F.when(same(s, F.get(windows, k - 1)) | same(s, F.get(windows, k + 1)), s["i"]),
    )
    return F.sort_array(F.filter(starts, lambda i: i.isNotNull()))


def covered(starts: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words under windows at the given starts."""
    gaps = F.transform(
        starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(window)), F.lit(window))
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def _without(text: Column, pattern: str) -> Column:
    """Characters left when the pattern's matches go."""
    return F.length(F.regexp_replace(text, pattern, ""))


def measured(lines: Column) -> Column:
    """Lines with their characters in words, their symbols and their letters, each counted once."""
    return F.transform(
        lines,
        lambda line: F.struct(
            line.alias("line"),
            _without(line, rf"[{BLANKS}]+").alias("size"),
            (F.length(line) - _without(line, f"[{SYMBOLS}]")).alias("symbols"),
            _without(line, r"[^\p{L}\p{M}\p{N}]+").alias("letters"),
        ),
    )


def line_fails(m: Column) -> Column:
    """Punctuation, navigation or boilerplate rule for one measured line with a word."""
    line, size = m["line"], m["size"]
    punctuation = (m["symbols"] * 100 > size * MAX_SYMBOL_PERCENT) | (m["letters"] * 100 < size * MIN_LETTER_PERCENT)
    bars = F.length(line) - F.length(F.translate(line, "|»·•", ""))
    navigation = (F.size(words_of(line)) <= NAV_WORDS) & (line.rlike(MENU) | (bars >= NAV_BARS))
    return punctuation | navigation | ((F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, cleaned text, counts, base_failed, lost (characters), kept."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t"))
    base = base.select(
        "doc_id",
        "_t",
        words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(rf"[^{BLANKS}]")).alias("_lines"),
        (F.length("_t") - _without(F.col("_t"), f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
    )
    base = base.withColumn("_h", window_hashes(F.col("_w")))
    base = base.withColumn("_o", sorted_windows(F.col("_h"))).drop("_h")
    base = base.withColumn("_s", repeated_starts(F.col("_o"), F.col("_w"))).drop("_o")
    base = base.withColumn("_m", measured(F.col("_lines")))
    base = base.withColumn("_good", F.filter("_m", lambda m: ~line_fails(m)))
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, m: a + m["size"])
    base = base.withColumn("word_chars", total(F.col("_m"))).withColumn("_left", total(F.col("_good")))
    out = base.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("_s")).alias("n_repeat_words"),
        F.array_join(F.transform("_good", lambda m: m["line"]), "\n").alias("cleaned"),
        (F.col("word_chars") - F.col("_left")).alias("lost_chars"),
        (F.size("_m") - F.size("_good")).cast("long").alias("n_failed_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)
    )
