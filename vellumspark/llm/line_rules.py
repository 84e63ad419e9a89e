"""Line-first quality rules, with DataFrame functions only.

Every line is judged alone by three rules; lines that fail are removed; a document that
loses too large a share of its text is rejected. Document-wide base measures (length,
symbols, repeated lines, repeated 8-word windows) stand beside the verdict.

Cases: a null text counts as empty; an empty text has no words and fails the base rule; an empty
table gives no rows; lines without a word are neither judged nor removed; a line or text exactly at a
limit passes; repeated rows are judged one by one;
other columns pass through, but for those named like a result, which the result replaces;
working columns begin with ``_lr_``. Work and memory per row are linear in the text, but for sorting the windows of
texts that do repeat a window.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_chars", "kept"]
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A line fails if more than this share of its words carry a run of signs.
MAX_SIGN_SHARE = 0.25
#: A line fails if it has more than this many separators for a word.
MAX_SEPARATOR_SHARE = 0.25
#: A document is rejected if more than this share of its characters is removed.
MAX_LOST_SHARE = 0.3

# Signs, separators and phrases of the line rules.
SIGNS = r"[#*$%&<>~^=]{2,}|!{2,}|\?{3,}"
SEPARATORS = r"\||»|›|•|→|·|¦"
PHRASES = [
    "accept all cookies", "add to cart", "all rights reserved", "back to top", "by continuing to browse", "click here", "cookie policy", "cookie settings", "copyright ©",
    "enable javascript", "follow us on", "forgot your password", "javascript is disabled", "leave a reply", "log in to", "lorem ipsum", "privacy policy", "read more",
    "share this", "sign up for", "skip to content", "skip to main content", "subscribe to our", "terms of service", "terms of use", "this site uses cookies", "unsubscribe",
    "alle rechte vorbehalten", "datenschutzerklärung", "diese website verwendet cookies", "hier klicken", "jetzt anmelden", "mehr lesen", "newsletter abonnieren", "nutzungsbedingungen", "zum inhalt springen",
    "aller au contenu", "cliquez ici", "conditions d'utilisation", "en savoir plus", "lire la suite", "mentions légales", "politique de confidentialité", "tous droits réservés",
    "aviso legal", "haga clic aquí", "iniciar sesión", "leer más", "política de cookies", "política de privacidad", "suscríbete", "términos de uso", "todos los derechos reservados",
]


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_phrase(text: Column) -> Column:
    lower, found = F.lower(text), F.lit(False)
    for p in PHRASES:
        found = found | lower.contains(p)
    return found


def line_fails(line: Column, marked: Column, phrased: Column) -> Column:
    """Whether a line with a word breaks a rule: punctuation, navigation or boilerplate. ``marked`` and
    ``phrased`` tell whether the text has any sign or separator, and any phrase, that a line could break."""
    n = F.size(F.split(F.btrim(line, F.lit(" \t\x0b\x0c\r")), SPACE))
    signs, parts = F.regexp_count(line, F.lit(SIGNS)), F.regexp_count(line, F.lit(SEPARATORS))
    by_marks = F.when(marked, (signs > n * MAX_SIGN_SHARE) | (parts > n * MAX_SEPARATOR_SHARE)).otherwise(False)
    return by_marks | F.when(phrased, has_phrase(line)).otherwise(False)


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0


def covered_words(win: Column) -> Column:
    """Words in windows whose hash stands twice or more in ``win`` (hashes in text order)."""

    def positions(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def lengths(p: Column) -> Column:
        return F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW)))

    pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    parts = bound(bound(pairs, positions), lengths)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean_text, lost_chars and kept to ``docs``."""
    own = [c for c in docs.columns if c not in RESULTS]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a = docs.select(
        *[F.col(f"`{c}`") for c in own],
        F.filter(F.split(t, SPACE), lambda w: w != "").alias("_lr_words"),
        F.split(t, "\n").alias("_lr_lines"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.length(t).cast("long").alias("_lr_chars"),
        (F.regexp_like(t, F.lit(SIGNS)) | F.regexp_like(t, F.lit(SEPARATORS))).alias("_lr_marked"),
        has_phrase(t).alias("_lr_phrased"),
    )
    lines, words = F.col("_lr_lines"), F.col("_lr_words")
    b = a.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_lr_hashes"),
        F.filter(lines, has_word).alias("_lr_full"),
        F.filter(lines, lambda x: ~(has_word(x) & line_fails(x, F.col("_lr_marked"), F.col("_lr_phrased")))).alias("_lr_good"),
    ).drop("_lr_words")
    h, full = F.col("_lr_hashes"), F.col("_lr_full")
    window = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)])
    c = b.select(
        "*",
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        F.array_join("_lr_good", "\n").alias("clean_text"),
        F.when(F.size(h) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), window)).alias("_lr_win"),
    ).drop("_lr_hashes", "_lr_full", "_lr_lines", "_lr_good")
    win = F.col("_lr_win")
    d = c.select(
        "*",
        F.when(F.size(F.array_distinct(win)) < F.size(win), covered_words(win)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.greatest(F.col("_lr_chars") - F.length("clean_text"), F.lit(0)).cast("long").alias("lost_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    e = d.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.col("_lr_chars") * MAX_LOST_SHARE)
    # A generator of one row: filters on what it makes stay above it. Pushed below, they would put
    # the expressions above into one another, to be evaluated for each word again.
    return e.select(*[F.col(f"`{c}`") for c in own], F.stack(F.lit(1), *RESULTS[:-1], kept).alias(*RESULTS))
