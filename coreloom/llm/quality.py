"""Line-first quality rules.

Each line is held against rules on punctuation (too many marks; a few words that no punctuation ends, as headings and
menus have), navigation (entries between separators), repetition (most words repeat the one before) and boilerplate, in
the four languages of the corpus; lines that break one go, and a document that loses too much of its text goes too. Documents of too few words, or in which the same word windows recur too
often, go before that.

A null text is empty: no words, so rejected. Blank lines break no rule and weigh nothing. Repeated rows are judged
alike, an empty table gives no rows, other columns pass through; of two columns of one name, ours replaces theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_of, words_of

WINDOW = 8
#: A line fails if over this percentage of its characters are marks that prose hardly has.
MARKS, MARK_PERCENT = r"!#*$%&|<>{}=_~^\\", 8
#: Or if it has so many separators between its entries.
SEPARATORS, SEPARATOR_COUNT = r"[\x20\t][|>/•·»][\x20\t]", 3
#: Or one of these phrases, in English, German, French or Spanish.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "enable javascript", "subscribe to our", "sign up for our", "log in to", "click here", "read more", "share this", "skip to content", "back to top", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "javascript aktivieren", "newsletter abonnieren", "hier klicken", "mehr lesen", "weiterlesen", "zum inhalt springen", "nach oben",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "activer javascript", "abonnez-vous", "cliquez ici", "lire la suite", "aller au contenu", "haut de page", "mentions légales",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso", "utiliza cookies", "habilitar javascript", "suscríbete", "haga clic aquí", "haz clic aquí", "leer más", "ir al contenido", "volver arriba", "aviso legal",
)
#: Where no letter of A-Z is before them; what is tried at each letter costs most of the time.
PHRASES = "(?:^|[^A-Za-z])(?:" + "|".join(BOILERPLATE) + ")"
#: Or under so many words and no mark at its end that ends a sentence, a clause, a quotation or a bracket.
SHORT, ENDS = 6, r"[.!?…:;,\x22'»”’)\]][\x20\x09-\x0D]*\z"
#: A document fails if over this percentage of its characters were in lines that failed.
LOST_PERCENT = 30


#: Fewer than SHORT words, and at least one.
FEW = rf"\A{SPACE}*+(?:[^\x20\x09-\x0D]++{SPACE}++){{0,{SHORT - 2}}}[^\x20\x09-\x0D]++{SPACE}*+\z"


def _stutters(line: Column) -> Column:
    """Over half the words repeat the one before."""
    again = lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
    return let(words_of(line), lambda w: again(w) * 2 > F.size(w))


def line_fails(line: Column, thrice: Column | None = None) -> Column:
    """thrice: whether any word of the text follows itself twice, without which no line stutters. Speed only."""
    marks = F.char_length(F.regexp_replace(line, f"[^{MARKS}]+", ""))
    stutters = _stutters(line) if thrice is None else thrice & _stutters(line)
    return (
        (marks * 100 > F.char_length(line) * MARK_PERCENT)
        | (F.regexp_count(line, F.lit(SEPARATORS)) >= SEPARATOR_COUNT)
        | (line.rlike(FEW) & ~line.rlike(ENDS))
        | line.rlike("(?iu)" + PHRASES)
        | stutters
    )


def of_hashes(words: Column, body) -> Column:
    """body(64-bit hashes of the words), with these computed once."""
    return let(F.transform(words, lambda x: F.xxhash64(x)), body)


def word_thrice(h: Column) -> Column:
    return F.exists(F.transform(h, lambda x, i: F.coalesce((F.get(h, i - 1) == x) & (F.get(h, i - 2) == x), F.lit(False))), lambda x: x)


def repeat_words(h: Column, window: int = WINDOW) -> Column:
    """Words in windows that are found twice or more among the words of hashes h. Windows are told apart by a 64-bit hash."""
    def of_windows(h: Column) -> Column:
        key = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        return let(F.transform(F.sequence(F.lit(0), F.size(h) - window), key), covered)

    def covered(k: Column) -> Column:
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.coalesce(F.when(j > 0, F.get(s, j - 1)["k"] == x["k"]), F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        step = lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).alias("n"), (i + window).alias("end"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])

    return F.when(F.size(h) <= window, F.lit(0)).otherwise(of_windows(h))


def judge(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_failed, chars_lost, clean_text,
    base_failed and kept."""
    text = text_of()
    lines = F.split(text, "\n")
    counts = lambda h: F.struct(repeat_words(h).cast("long").alias("n_repeat_words"), word_thrice(h).alias("thrice"))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), of_hashes(w, counts).alias("h")))

    def of_lines(ls: Column, thrice: Column) -> Column:
        full = F.filter(ls, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        dup = let(full, lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long"))
        good = F.filter(ls, lambda x: ~line_fails(x, thrice))
        return F.struct(dup.alias("n_dup_lines"), let(good, lambda g: F.struct((F.size(ls) - F.size(g)).alias("n_lines_failed"), F.array_join(g, "\n").alias("clean_text"))).alias("c"))

    before = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_failed", "chars_lost", "clean_text", "base_failed", "kept", "_w", "_l")
    both = let(of_words, lambda w: F.struct(w.alias("w"), let(lines, lambda ls: of_lines(ls, w["h"]["thrice"])).alias("l")))
    found = before.withColumns({"_w": both, "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")})
    n, r = F.col("_w.w.n_words"), F.col("_w.w.h.n_repeat_words")
    out = found.withColumns({
        "n_words": n, "word_chars": F.col("_w.w.word_chars"), "n_repeat_words": r, "n_dup_lines": F.col("_w.l.n_dup_lines"),
        "n_lines_failed": F.col("_w.l.c.n_lines_failed"), "clean_text": F.col("_w.l.c.clean_text"),
        "base_failed": (n < 20) | (100 * r > 30 * n),
    }).drop("_w")
    lost = F.char_length(text) - F.char_length("clean_text")
    return out.withColumn("chars_lost", lost).withColumn("kept", ~F.col("base_failed") & (F.col("chars_lost") * 100 <= F.char_length(text) * LOST_PERCENT))
