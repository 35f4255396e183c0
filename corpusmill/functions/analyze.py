"""The text analyser of the sparse index.

Unicode words, lower case, compatibility decomposition, everything but letters
and digits dropped, English stop words removed, English (Porter2) stems.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The common English stop words.
STOP_WORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which
    who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will
    just don should now
    """.split()
)

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
# Words with stems of their own, and words that stay as they are.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti",
    "ous", "ive", "ize", "ion", "al", "er", "ic",
)


def _after_first_vc(word: str, start: int) -> int:
    for k in range(start + 1, len(word)):
        if word[k] not in _VOWEL and word[k - 1] in _VOWEL:
            return k + 1
    return len(word)


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _after_first_vc(word, 0) if first is None else first
    return r1, _after_first_vc(word, r1)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    return (
        len(word) > 2
        and word[-1] not in _VOWEL + "wxY"
        and word[-2] in _VOWEL
        and word[-3] not in _VOWEL
    )


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    w = "".join(
        "Y" if c == "y" and (k == 0 or w[k - 1] in "aeiouy") else c for k, c in enumerate(w)
    )
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")):
        if any(c in _VOWEL for c in w[:-2]):
            w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    # past and progressive forms
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(end):
            continue
        if end in ("eed", "eedly"):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
        elif any(c in _VOWEL for c in w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end, put in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[at - 1 : at] and w[at - 1] in _LI else w
                else:
                    w = w[:at] + put
            break
    for end, put in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + put
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def analyze(text: str | None) -> list[str]:
    """Index terms of a text, in order, repeated ones too; none for a null."""
    terms = []
    for word in _WORD.findall(text or ""):
        plain = unicodedata.normalize("NFKD", word.lower())
        plain = "".join(c for c in plain if c.isalnum())
        if plain and plain not in STOP_WORDS:
            terms.append(stem(plain))
    return terms


@F.pandas_udf(T.ArrayType(T.StringType()))
def _analyze_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(analyze)


def stemmed_tokens(c: Column) -> Column:
    """The analyser as a Column; NFKD and stems need Python, in Arrow batches."""
    return _analyze_udf(c)
