"""Porter stemming (F5, X1) as column expressions, from the published algorithm (M. F. Porter, "An
algorithm for suffix stripping", Program 14(3), 1980) with the two rule changes of the author's reference
C version (``bli`` → ``ble`` in place of ``abli`` → ``able``, and ``logi`` → ``log``).

A word's letters are first marked so that one regular expression can tell vowels from consonants: a y at
the beginning or after a vowel is a consonant and becomes Y.  The measure of a stem, that is how often a
run of vowels is followed by a consonant, is then a pattern.  Each step finds its longest suffix with one
pattern that is anchored at the end, and looks at what is left.

The steps run on the *distinct* vocabulary; the stems are joined back to counted terms, so a term is
stemmed once however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns over marked letters.
VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"
ONCE = f"^{CONSONANT}*{VOWEL}+{CONSONANT}"  # measure above 0
TWICE = f"{ONCE}+{VOWEL}+{CONSONANT}"  # measure above 1
SHORT = f"{CONSONANT}{VOWEL}[^aeiouywxY]$"  # consonant, vowel, consonant other than w, x, y
# Marking: a y that is a consonant, then every second one of what is left in a run.
MARKS = (("(^|[aeiou])y", "Y"), ("yy", "yY"))

# Suffix rules of steps 2, 3 and 4 (longest match within a step wins; the lists
# are in the paper's order).
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("logi", "log"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
)
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)




def ending(suffixes) -> str:
    """Pattern of the longest of these suffixes: a search finds the leftmost, so longest, one."""
    return f"({'|'.join(suffixes)})$"


def marked(w: Column) -> Column:
    w = F.regexp_replace(w, MARKS[0][0], f"$1{MARKS[0][1]}")
    return F.regexp_replace(w, *MARKS[1])


def _cut(w: Column, n: int | Column) -> Column:
    return F.left(w, F.length(w) - (F.lit(n) if isinstance(n, int) else n))


def _step1a(w: Column) -> Column:
    return F.when(w.rlike("(sses|ies)$"), _cut(w, 2)).when(w.rlike("[^s]s$|^s$"), _cut(w, 1)).otherwise(w)


def _step1b(w: Column) -> Column:
    past = F.when(w.rlike("ed$"), _cut(w, 2)).when(w.rlike("ing$"), _cut(w, 3))
    left = marked(past)
    twice = (F.right(past, F.lit(1)) == F.substring(past, -2, 1)) & (F.length(past) >= 2) & left.rlike("[^aeiouylsz]$")
    mended = (F.when(past.rlike("(at|bl|iz)$"), F.concat(past, F.lit("e"))).when(twice, _cut(past, 1))
              .when(left.rlike(ONCE) & ~left.rlike(TWICE) & left.rlike(SHORT), F.concat(past, F.lit("e"))).otherwise(past))
    return (F.when(w.rlike("eed$"), F.when(marked(_cut(w, 3)).rlike(ONCE), _cut(w, 1)).otherwise(w))
            .when(past.isNotNull() & left.rlike(VOWEL), mended).otherwise(w))


def _step1c(w: Column) -> Column:
    return F.when(w.rlike("y$") & marked(_cut(w, 1)).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _rules(rules) -> Callable[[Column], Column]:
    def step(w: Column) -> Column:
        suffix = F.regexp_extract(w, ending([s for s, _ in rules]), 1)
        stem = _cut(w, F.length(suffix))
        new = F.lit("")
        for s, r in rules:
            new = F.when(suffix == s, F.lit(r)).otherwise(new)
        return F.when((suffix != "") & marked(stem).rlike(ONCE), F.concat(stem, new)).otherwise(w)
    return step


def _step4(w: Column) -> Column:
    suffix = F.regexp_extract(w, ending(_STEP4), 1)
    stem = _cut(w, F.length(suffix))
    goes = (suffix != "") & marked(stem).rlike(TWICE) & ((suffix != "ion") | stem.rlike("[st]$"))
    return F.when(goes, stem).otherwise(w)


def _step5a(w: Column) -> Column:
    stem = marked(_cut(w, 1))
    return F.when(w.rlike("e$") & (stem.rlike(TWICE) | (stem.rlike(ONCE) & ~stem.rlike(SHORT))), _cut(w, 1)).otherwise(w)


def _step5b(w: Column) -> Column:
    return F.when(w.rlike("ll$") & marked(w).rlike(TWICE), _cut(w, 1)).otherwise(w)


STEPS = (_step1a, _step1b, _step1c, _rules(_STEP2), _rules(_STEP3), _step4, _step5a, _step5b)


def stem_terms(vocab: DataFrame, term_col: str = "term", out: str = "stem") -> DataFrame:
    """F5 (X1): stems of a distinct vocabulary of lower-case words (term → stem), to be joined back to terms.

    Words of one or two letters are left alone; a null term has a null stem."""
    words = vocab.select(F.col(term_col)).distinct().withColumn(out, F.col(term_col))
    for step in STEPS:
        words = words.withColumn(out, step(F.col(out)))
    return words.withColumn(out, F.when(F.length(term_col) <= 2, F.col(term_col)).otherwise(F.col(out)))
