"""English lexemes: stop words out, the rest stemmed by the published Porter2 (Snowball English) algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from confab.functions.text import tokenise

# The English stop words of text-search databases.
DATABASE_STOPWORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Words the algorithm treats specially, and its suffix tables.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
VOWEL = "aeiouy"
REGION = re.compile(f"[{VOWEL}][^{VOWEL}]")
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    m = REGION.search(w)
    r1 = len(head) if head else m.end() if m else len(w)
    m = REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _ends_short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWEL and w[1] not in VOWEL
    return len(w) > 2 and w[-3] not in VOWEL and w[-2] in VOWEL and w[-1] not in VOWEL + "wxY"


def _vowel_in(s: str) -> bool:
    return any(c in VOWEL for c in s)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of one lower-case word."""
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    if w in UNCHANGED:
        return w
    chars = list(w)  # y that starts a word or follows a vowel is a consonant, written Y
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in VOWEL):
            chars[i] = "Y"
    w = "".join(chars)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _vowel_in(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    # 1b
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if _vowel_in(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLE):
                        w = w[:-1]
                    elif _ends_short(w) and r1 >= len(w):
                        w += "e"
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    # 2
    for s, to in STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1 : at] == "l") and (s != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    # 3
    for s, to in STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= (r2 if s == "ative" else r1):
                w = w[:at] + to
            break
    # 4
    for s in STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def english_lexemes(text: str | None) -> list[str]:
    """Stems of the tokens that aren't stop words, one an occurrence, in order."""
    return [stem(t) for t in tokenise(text) if t not in DATABASE_STOPWORDS]


def english(text: Column) -> Column:
    """`english_lexemes` as an Arrow-batched function."""
    @F.pandas_udf("array<string>")
    def analyse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: english_lexemes(t) if isinstance(t, str) else [])

    return analyse(text)
