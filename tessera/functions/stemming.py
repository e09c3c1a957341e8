"""Porter's stemmer (1980) with diacritics folded, as a vectorised function over distinct words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CONSONANT = "[^aeiou]"
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MEASURE_1 = re.compile(f"^({_C})?{_V}{_C}")
_MEASURE_IS_1 = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_MEASURE_2 = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_HAS_VOWEL = re.compile(f"^({_C})?{_V}")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")

# The published endings of steps 2, 3 and 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def _replace(word: str, table: dict[str, str]) -> str:
    for ending in sorted(table, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + table[ending] if _MEASURE_1.match(stem) else word
    return word


def stem(word: str) -> str:
    w = fold(word)
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    w = re.sub("^y", "Y", w)
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _MEASURE_1.match(w[:-3]):
            w = w[:-1]
    else:
        for ending in ("ed", "ing"):
            if w.endswith(ending) and _HAS_VOWEL.match(w[: -len(ending)]):
                w = w[: -len(ending)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif _CVC.match(w):
                    w += "e"
                break
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP_2), STEP_3)
    for ending in sorted((*STEP_4, "ion"), key=len, reverse=True):
        if w.endswith(ending):
            s = w[: -len(ending)]
            if _MEASURE_2.match(s) and (ending != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        s = w[:-1]
        if _MEASURE_2.match(s) or (_MEASURE_IS_1.match(s) and not _CVC.match(s)):
            w = s
    if w.endswith("ll") and _MEASURE_2.match(w):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def porter(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda w: None if w is None else known.setdefault(w, "") or known.__setitem__(w, stem(w)) or known[w])


#: Own groups of words that stand for each other, the closest first; members of several words are searched as phrases, and
#: those of two are also recognised in a question. A word of two groups would be ambiguous and never expands.
SYNONYMS = (
    ("agreement", "contract", "deal"), ("lawyer", "attorney", "counsel"), ("buy", "purchase", "acquire"), ("begin", "start", "commence"), ("end", "finish", "terminate"),
    ("price", "cost", "fee"), ("large", "big", "huge"), ("small", "little", "tiny"), ("help", "assist", "support"), ("error", "mistake", "fault"),
    ("staff", "employee", "personnel", "workforce", "team member"), ("car", "vehicle", "automobile", "motor car"), ("house", "home", "dwelling", "place of residence"), ("show", "display", "present"), ("delete", "remove", "erase", "take out"),
    ("lease", "tenancy", "rental agreement", "letting"), ("landlord", "lessor", "property owner"), ("tenant", "lessee", "occupier"), ("invoice", "bill", "payment request"), ("salary", "wage", "remuneration", "rate of pay"),
    ("dismissal", "layoff", "redundancy", "end of employment"), ("court", "tribunal", "court of law"), ("judge", "magistrate", "presiding officer"), ("witness", "deponent", "eye witness"), ("appeal", "review", "second instance"),
    ("damage", "harm", "injury", "loss"), ("compensation", "redress", "damages award"), ("insurance", "cover", "insurance policy"), ("tax", "levy", "public charge"), ("loan", "credit", "borrowed money"),
    ("deadline", "due date", "time limit", "cutoff", "last day", "final date", "closing date", "end date"), ("meeting", "conference", "gathering"), ("report", "account", "written statement"), ("plan", "scheme", "course of action"), ("rule", "regulation", "standing order"),
    ("supplier", "vendor", "provider"), ("customer", "client", "buyer"), ("delivery", "shipment", "consignment"), ("storm", "tempest", "force of nature"), ("proof", "evidence", "supporting document"),
)
#: Synonyms of one word, at most.
MOST_SYNONYMS = 6


def synonym_pairs() -> list[tuple[str, str]]:
    """(word, synonym): of each word, or pair of words, the first MOST_SYNONYMS others of its group."""
    counts: dict[str, int] = {}
    for g in SYNONYMS:
        for w in g:
            counts[w] = counts.get(w, 0) + 1
    return [(a, b) for g in SYNONYMS for a in g if counts[a] == 1 and len(a.split()) <= 2 for b in [x for x in g if x != a][:MOST_SYNONYMS]]
