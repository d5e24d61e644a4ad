"""Russian stemming by the published Snowball algorithm, as an Arrow UDF with a memo per worker."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "аеиоуыэюя"
#: The endings of the published algorithm.
PERFECTIVE_1, PERFECTIVE_2 = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE_1, PARTICIPLE_2 = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
REFLEXIVE = ("ся", "сь")
VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
SUPERLATIVE, DERIVATIONAL = ("ейш", "ейше"), ("ост", "ость")


def _ending(region: str, free: list[str] | tuple[str, ...], after_a: list[str] | tuple[str, ...] = ()) -> int | None:
    """Length of the longest ending in the region; after_a: endings that must follow а or я within it."""
    for e in sorted({*free, *after_a}, key=len, reverse=True):
        if region.endswith(e) and (e in free or region[: -len(e)].endswith(("а", "я"))):
            return len(e)
    return None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of one lower-case word; words without Russian vowels are left alone."""
    word = word.replace("ё", "е")
    first = re.search(f"[{VOWELS}]", word)
    if not first:
        return word
    rv = first.end()
    r1 = re.search(f"[{VOWELS}][^{VOWELS}]", word)
    r1 = r1.end() if r1 else len(word)
    r2 = re.search(f"[{VOWELS}][^{VOWELS}]", word[r1:])
    r2 = r1 + r2.end() if r2 else len(word)

    def cut(n: int | None) -> bool:
        nonlocal word
        if n:
            word = word[:-n]
        return bool(n)

    region = lambda: word[rv:]
    if not cut(_ending(region(), PERFECTIVE_2, PERFECTIVE_1)):
        cut(_ending(region(), REFLEXIVE))
        if cut(_ending(region(), ADJECTIVE)):
            cut(_ending(region(), PARTICIPLE_2, PARTICIPLE_1))
        elif not cut(_ending(region(), VERB_2, VERB_1)):
            cut(_ending(region(), NOUN))
    if region().endswith("и"):
        word = word[:-1]
    cut(_ending(word[max(rv, r2) :], DERIVATIONAL))
    if region().endswith("нн"):
        word = word[:-1]
    elif cut(_ending(region(), SUPERLATIVE)):
        if region().endswith("нн"):
            word = word[:-1]
    elif region().endswith("ь"):
        word = word[:-1]
    return word


def stem_text(text: str) -> str:
    return " ".join(stem(w) for w in text.split())


@F.pandas_udf(T.StringType())
def _stemmed(texts: pd.Series) -> pd.Series:
    return texts.map(stem_text, na_action="ignore")


def stemmed(c: Column) -> Column:
    """Stemmed words of a normalised text."""
    return _stemmed(c)
