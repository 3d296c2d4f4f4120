"""Sound keys and spelling similarity of single words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "AEIOU"
FRONT = "EIY"


@lru_cache(maxsize=200_000)
def metaphone(word: str, longest: int = 12) -> str:
    """Metaphone key by the published rules."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out: list[str] = []
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    i = 0
    while i < len(w) and len(out) < longest:
        c, before, after = w[i], at(i - 1), at(i + 1)
        step = 1
        if c == before and c != "C":
            pass
        elif c in VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (before == "M" and i == len(w) - 1):
                out.append("B")
        elif c == "C":
            if after and after in FRONT:
                if before == "S":
                    pass
                else:
                    out.append("X" if w[i : i + 3] == "CIA" else "S")
            elif after == "H":
                out.append("K" if before == "S" or (i == 0 and at(i + 2) not in VOWELS) else "X")
                step = 2
            else:
                out.append("K")
                step = 2 if after == "K" else 1
        elif c == "D":
            if after == "G" and at(i + 2) and at(i + 2) in FRONT:
                out.append("J")
                step = 2
            else:
                out.append("T")
        elif c == "G":
            if after == "H" and not (i + 2 >= len(w) or at(i + 2) in VOWELS):
                step = 2
            elif after == "H" and i + 2 >= len(w):
                step = 2
            elif after == "N" and (i + 2 >= len(w) or w[i + 1 :] in ("NED", "NS")):
                pass
            else:
                out.append("J" if after and after in FRONT and before != "G" else "K")
                step = 2 if after == "H" else 1
        elif c == "H":
            if after and after in VOWELS and before not in ("C", "G", "P", "S", "T"):
                out.append("H")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
            step = 2 if after == "H" else 1
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if after == "H" or w[i : i + 3] in ("SIO", "SIA"):
                out.append("X")
                step = 2 if after == "H" else 1
            elif w[i : i + 3] == "SCH":
                out += ["S", "K"]
                step = 3
            else:
                out.append("S")
        elif c == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                out.append("X")
            elif after == "H":
                out.append("0")
                step = 2
            elif w[i : i + 3] != "TCH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if after and after in VOWELS:
                out.append(c)
        elif c == "X":
            out += ["K", "S"]
        elif c == "Z":
            out.append("S")
        elif c in "FJLMNR":
            out.append(c)
        i += step
    return "".join(out)[:longest]


class _Codes:
    def __init__(self) -> None:
        self.first, self.second = "", ""

    def add(self, first: str, second: str | None = None) -> None:
        self.first += first
        self.second += first if second is None else second


@lru_cache(maxsize=200_000)
def double_metaphone(word: str, longest: int = 4) -> tuple[str, str]:
    """Primary and alternate sound codes in the manner of Double Metaphone; the alternate equals the primary where a word
    has one reading. Covers the rules for English, Germanic, Slavic, Romance and Greek spellings that change a code."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    codes = _Codes()
    n, last = len(w), len(w) - 1
    slavic = any(s in w for s in ("W", "K", "CZ", "WITZ"))
    has = lambda k, *options: any(k >= 0 and w[k : k + len(o)] == o for o in options)
    vowel = lambda k: 0 <= k < n and w[k] in VOWELS + "Y"
    i = 1 if has(0, "GN", "KN", "PN", "WR", "PS") else 0
    if has(0, "X"):
        codes.add("S")
        i = 1
    while i < n and min(len(codes.first), len(codes.second)) < longest:
        c, step = w[i], 1
        doubled = has(i + 1, c)
        if c in VOWELS + "Y":
            if i == 0:
                codes.add("A")
        elif c == "B":
            codes.add("P")
            step += doubled
        elif c == "C":
            if i > 1 and not vowel(i - 2) and has(i - 1, "ACH") and not has(i + 2, "I", "E"):
                codes.add("K")
                step = 2
            elif i == 0 and has(0, "CAESAR"):
                codes.add("S")
                step = 2
            elif has(i, "CH"):
                if i > 0 and has(i, "CHAE"):
                    codes.add("K", "X")
                elif i == 0 and has(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not has(0, "CHORE"):
                    codes.add("K")
                elif has(0, "VAN ", "VON ", "SCH") or has(i - 2, "ORCHES", "ARCHIT", "ORCHID") or has(i + 2, "T", "S") or ((has(i - 1, "A", "O", "U", "E") or i == 0) and has(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W")):
                    codes.add("K")
                elif i == 0:
                    codes.add("X")
                elif has(0, "MC"):
                    codes.add("K")
                else:
                    codes.add("X", "K")
                step = 2
            elif has(i, "CZ") and not has(i - 2, "WICZ"):
                codes.add("S", "X")
                step = 2
            elif has(i + 1, "CIA"):
                codes.add("X")
                step = 3
            elif has(i, "CC") and not (i == 1 and has(0, "M")):
                if has(i + 2, "I", "E", "H") and not has(i + 2, "HU"):
                    codes.add("KS" if (i == 1 and has(0, "A")) or has(i - 1, "UCCEE", "UCCES") else "X")
                    step = 3
                else:
                    codes.add("K")
                    step = 2
            elif has(i, "CK", "CG", "CQ"):
                codes.add("K")
                step = 2
            elif has(i, "CI", "CE", "CY"):
                codes.add("S", "X" if has(i, "CIO", "CIE", "CIA") else None)
                step = 2
            else:
                codes.add("K")
                step = 2 if has(i + 1, "C", "K", "Q") and not has(i + 1, "CE", "CI") else 1
        elif c == "D":
            if has(i, "DG"):
                soft = has(i + 2, "I", "E", "Y")
                codes.add("J" if soft else "TK")
                step = 3 if soft else 2
            else:
                codes.add("T")
                step = 2 if has(i, "DT", "DD") else 1
        elif c == "F":
            codes.add("F")
            step += doubled
        elif c == "G":
            if has(i + 1, "H"):
                if i > 0 and not vowel(i - 1):
                    codes.add("K")
                elif i == 0:
                    codes.add("J" if has(2, "I") else "K")
                elif has(i - 2, "B", "H", "D") or has(i - 3, "B", "H", "D") or has(i - 4, "B", "H"):
                    pass
                elif i > 2 and has(i - 1, "U") and has(i - 3, "C", "G", "L", "R", "T"):
                    codes.add("F")
                elif i > 0 and not has(i - 1, "I"):
                    codes.add("K")
                step = 2
            elif has(i + 1, "N"):
                if i == 1 and vowel(0) and not slavic:
                    codes.add("KN", "N")
                elif not has(i + 2, "EY") and not slavic:
                    codes.add("N", "KN")
                else:
                    codes.add("KN")
                step = 2
            elif has(i + 1, "LI") and not slavic:
                codes.add("KL", "L")
                step = 2
            elif i == 0 and has(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
                codes.add("K", "J")
                step = 2
            elif has(i + 1, "E", "I", "Y") or has(i - 1, "AGGI", "OGGI"):
                if has(0, "SCH") or has(i + 1, "ET"):
                    codes.add("K")
                else:
                    codes.add("J", None if has(i + 1, "IER") else "K")
                step = 2
            else:
                codes.add("K")
                step += doubled
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                codes.add("H")
                step = 2
        elif c == "J":
            if has(i, "JOSE"):
                codes.add("H")
            elif i == 0:
                codes.add("J", "A")
            elif vowel(i - 1) and not slavic and has(i + 1, "A", "O"):
                codes.add("J", "H")
            elif i == last:
                codes.add("J", "")
            elif not has(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not has(i - 1, "S", "K", "L"):
                codes.add("J")
            step += doubled
        elif c == "K":
            codes.add("K")
            step += doubled
        elif c == "L":
            spanish = doubled and ((i == n - 3 and has(i - 1, "ILLO", "ILLA", "ALLE")) or (has(last - 1, "AS", "OS") or has(last, "A", "O")) and has(i - 1, "ALLE"))
            codes.add("L", "" if spanish else None)
            step += doubled
        elif c == "M":
            codes.add("M")
            step += doubled or (has(i - 1, "UMB") and (i + 1 == last or has(i + 2, "ER")))
        elif c == "N":
            codes.add("N")
            step += doubled
        elif c == "P":
            if has(i + 1, "H"):
                codes.add("F")
                step = 2
            else:
                codes.add("P")
                step += has(i + 1, "P", "B")
        elif c == "Q":
            codes.add("K")
            step += doubled
        elif c == "R":
            silent = i == last and not slavic and has(i - 2, "IE") and not has(i - 4, "ME", "MA")
            codes.add("" if silent else "R", "R")
            step += doubled
        elif c == "S":
            if has(i - 1, "ISL", "YSL"):
                pass
            elif i == 0 and has(0, "SUGAR"):
                codes.add("X", "S")
            elif has(i, "SH"):
                codes.add("S" if has(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X")
                step = 2
            elif has(i, "SIO", "SIA"):
                codes.add("S", None if slavic else "X")
                step = 3
            elif (i == 0 and has(1, "M", "N", "L", "W")) or has(i + 1, "Z"):
                codes.add("S", "X")
                step += has(i + 1, "Z")
            elif has(i, "SC"):
                if has(i + 2, "H"):
                    if has(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        codes.add("X" if has(i + 3, "ER", "EN") else "SK", "SK")
                    else:
                        codes.add("X", "S" if i == 0 and not vowel(3) and not has(3, "W") else None)
                else:
                    codes.add("S" if has(i + 2, "I", "E", "Y") else "SK")
                step = 3
            else:
                codes.add("" if i == last and has(i - 2, "AI", "OI") else "S", "S")
                step += has(i + 1, "S", "Z")
        elif c == "T":
            if has(i, "TION", "TIA", "TCH"):
                codes.add("X")
                step = 3
            elif has(i, "TH", "TTH"):
                codes.add("T" if has(i + 2, "OM", "AM") or has(0, "SCH") else "0", "T")
                step = 2
            else:
                codes.add("T")
                step += has(i + 1, "T", "D")
        elif c == "V":
            codes.add("F")
            step += doubled
        elif c == "W":
            if has(i, "WR"):
                codes.add("R")
                step = 2
            elif i == 0 and (vowel(1) or has(0, "WH")):
                codes.add("A", "F" if vowel(1) else None)
            elif (i == last and vowel(i - 1)) or has(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or has(0, "SCH"):
                codes.add("", "F")
            elif has(i, "WICZ", "WITZ"):
                codes.add("TS", "FX")
                step = 4
        elif c == "X":
            if not (i == last and (has(i - 3, "IAU", "EAU") or has(i - 2, "AU", "OU"))):
                codes.add("KS")
            step += has(i + 1, "C", "X")
        elif c == "Z":
            if has(i + 1, "H"):
                codes.add("J")
                step = 2
            else:
                codes.add("S", "TS" if has(i + 1, "ZO", "ZI", "ZA") or (slavic and i > 0 and not has(i - 1, "T")) else None)
                step += doubled
        i += int(step)
    return codes.first[:longest], codes.second[:longest]


def sound_keys(word: Column) -> Column:
    """struct<metaphone, first, second> of each word; meant for distinct vocabularies, not for running text."""

    @F.pandas_udf("struct<metaphone string, first string, second string>")
    def keys(words: pd.Series) -> pd.DataFrame:
        rows = [(metaphone(w), *double_metaphone(w)) if isinstance(w, str) else ("", "", "") for w in words]
        return pd.DataFrame(rows, columns=["metaphone", "first", "second"])

    return keys(word)


def trigrams(word: Column) -> Column:
    """Distinct trigrams of a word padded by two spaces before and one after."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram arrays."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def substring_share(token: Column, term: Column) -> Column:
    """Length of the longest common substring over the length of the token."""
    starts = F.sequence(F.lit(1), F.length(token))
    longest = F.aggregate(
        starts, F.lit(0),
        # Grow from each start only beyond the longest found so far.
        lambda best, i: F.aggregate(F.sequence(F.lit(1), F.length(token)), best, lambda m, n: F.when((n == m + 1) & (i + n - 1 <= F.length(token)) & term.contains(F.substring(token, i, n)), n).otherwise(m)),
    )
    return longest / F.greatest(F.length(token), F.lit(1))
