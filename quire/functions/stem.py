"""English stems of single words, by the published Porter2 rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published rules: words with stems of their own, words that stay after the plural is gone, suffixes.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]").search
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$").search
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$").search


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _after(w, 0)
    r2 = _after(w, r1)

    s = _longest(w, ["sses", "ied", "ies", "us", "ss", "s"])
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and _VOWEL(w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w

    s = _longest(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if s in ("eed", "eedly"):
        w = w[: len(w) - len(s) + 2] if len(w) - len(s) >= r1 else w
    elif s and _VOWEL(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE(w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    s = _longest(w, STEP_2)
    at = len(w) - len(s)
    if s and at >= r1 and (s != "ogi" or w[:at].endswith("l")) and (s != "li" or w[at - 1] in "cdeghkmnrt"):
        w = w[:at] + STEP_2[s]

    s = _longest(w, STEP_3)
    at = len(w) - len(s)
    if s and at >= r1 and (s != "ative" or at >= r2):
        w = w[:at] + STEP_3[s]

    s = _longest(w, STEP_4)
    at = len(w) - len(s)
    if s and at >= r2 and (s != "ion" or w[:at].endswith(("s", "t"))):
        w = w[:at]

    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _SHORT(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """stem() of a column of words; null stays null."""
    for part in words:
        yield part.map(stem, na_action="ignore")
