"""English words for text search: without possessives and stop words, cut to their stems by Porter's rules (V5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search leaves out, and the endings of Porter's second to fourth step.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: A vowel; one run of vowels and consonants or more; exactly one; two or more; and consonant, vowel, consonant at the end.
VOWEL, SOME = f"^(?:{CONSONANTS})?[aeiouy]", f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
ONE, TWO = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$", f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"


def _less(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _ends(w: Column, ending: str) -> Column:
    return F.endswith(w, F.lit(ending)) & (F.length(w) > len(ending))


def _plurals(w: Column) -> Column:
    return F.when(w.rlike("(?:ss|i)es$"), _less(w, 2)).when(w.rlike("[^s]s$"), _less(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    """Without ed and ing; a mark that the word was cut stays behind it for the next step."""
    cut = lambda n: F.concat(_less(w, n), F.lit("#"))
    return F.when(_ends(w, "eed"), F.when(_less(w, 3).rlike(SOME), _less(w, 1)).otherwise(w)).when(_ends(w, "ed") & _less(w, 2).rlike(VOWEL), cut(2)).when(_ends(w, "ing") & _less(w, 3).rlike(VOWEL), cut(3)).otherwise(w)


def _mended(w: Column) -> Column:
    s = _less(w, 1)
    mended = F.when(s.rlike("(?:at|bl|iz)$"), F.concat(s, F.lit("e"))).when(s.rlike(r"([^aeiouylsz])\1$"), _less(w, 2)).when(s.rlike(SHORT), F.concat(s, F.lit("e"))).otherwise(s)
    return F.when(F.endswith(w, F.lit("#")), mended).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(_ends(w, "y") & _less(w, 1).rlike(VOWEL), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)


def _replaced(endings: dict[str, str]) -> Callable[[Column], Column]:
    """The longest of the endings that a word has decides, whether what is before it is long enough or not."""

    def step(w: Column) -> Column:
        out = w
        for ending in sorted(endings, key=len):
            out = F.when(_ends(w, ending), F.when(_less(w, len(ending)).rlike(SOME), F.concat(_less(w, len(ending)), F.lit(endings[ending]))).otherwise(w)).otherwise(out)
        return out

    return step


def _removed(w: Column) -> Column:
    out = F.when(w.rlike("[st]ion$") & _less(w, 3).rlike(TWO), _less(w, 3)).otherwise(w)
    for ending in sorted(FOURTH, key=len):
        out = F.when(_ends(w, ending), F.when(_less(w, len(ending)).rlike(TWO), _less(w, len(ending))).otherwise(w)).otherwise(out)
    return out


def _last_e(w: Column) -> Column:
    s = _less(w, 1)
    return F.when(_ends(w, "e") & (s.rlike(TWO) | (s.rlike(ONE) & ~s.rlike(SHORT))), s).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(_ends(w, "ll") & _less(w, 1).rlike(TWO), _less(w, 1)).otherwise(w)


#: A y that opens a word is a consonant: it is set in capitals while the word is cut.
STEPS = (
    lambda w: F.when(F.startswith(w, F.lit("y")), F.concat(F.lit("Y"), F.substr(w, F.lit(2)))).otherwise(w),
    _plurals, _past, _mended, _last_y, _replaced(SECOND), _replaced(THIRD), _removed, _last_e, _last_l, F.lower,
)


def stems(words: Column) -> Column:
    """Each of an array of lower-case words cut to its stem; words of one or two letters stay, as do those with other signs."""

    def fit(w: Column) -> Column:
        return (F.length(w) > 2) & w.rlike("^[a-z]+$")

    def over(words: Column, step: Callable[[Column], Column]) -> Column:
        return F.transform(words, lambda x: F.struct(F.when(x["fit"], step(x["w"])).otherwise(x["w"]).alias("w"), x["fit"].alias("fit")))

    # a step sees each word as a variable, so that the steps before it are worked out once
    out = F.transform(words, lambda w: F.struct(w.alias("w"), fit(w).alias("fit")))
    for step in STEPS:
        out = over(out, step)
    return F.transform(out, lambda x: x["w"])


def english(c: Column | str) -> Column:
    """The terms of a text: words and numbers in lower case, without 's and stop words, as stems, in order."""
    words = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:['’][a-z]+)?"), F.lit(0)), lambda w: F.regexp_replace(w, r"['’]s?$", ""))
    kept = F.filter(words, lambda w: (F.length(w) > 0) & ~w.isin(*STOPWORDS))
    return stems(kept)
