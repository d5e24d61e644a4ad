"""Text expressions: normalisation, weighted fields, filter strings. All are built-in columns; null reads as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain: filter keys, those that items' parameters can answer, and words of no weight.
FILTER_KEYS = [
    "Тип услуги автосервиса", "Вид услуги", "Тип услуги", "Кто оказывает услуги", "Онлайн-запись", "Срочная услуга",
    "Предмет или направление", "Предмет или специальность", "Аренда авто", "Поиск по слотам", "Рейтинг пользователя",
]
CHECKABLE_KEYS = ["Вид услуги", "Тип услуги", "Тип услуги автосервиса", "Предмет или специальность"]
COMPACT_KEYS = ["вид услуги", "тип услуги", "предмет или специальность"]
STOP_WORDS = ["вид", "услуги", "услуга", "тип", "и", "выше", "звезды", "звезд", "рейтинг", "пользователя", "не", "важно", "любой", "любая", "любое"]
RATING = r"(?iu)рейтинг[^0-9]{0,40}?(\d+(?:[.,]\d+)?)"
RATING_PHRASE = r"(?iuU)рейтинг\s+пользователя\s*\d+(?:[.,]\d+)?\s*звезд\w*(?:\s+и\s+выше)?"
#: Characters kept after a compacted key.
COMPACT_TAIL = 120


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clip(c: Column, n: int) -> Column:
    """At most n characters from the start."""
    return F.substring(or_empty(c), 1, n)


def normalize(c: Column) -> Column:
    """Lower case, ё as е, everything but digits, Latin and Cyrillic letters as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(or_empty(c)), "ё", "е"), r"[^0-9a-zа-я]+", " "))


def tokens(c: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def n_tokens(c: Column) -> Column:
    return F.size(tokens(c))


def weighted(title: Column, params: Column, description: Column, repeat: int = 5, params_max: int = 600, description_max: int = 400) -> Column:
    """Normalised item text: the title several times, then the start of the parameters and of the description."""
    return normalize(F.concat_ws(" ", *[or_empty(title)] * repeat, clip(params, params_max), clip(description, description_max)))


def rating_threshold(c: Column) -> Column:
    """The number after 'рейтинг'; null if there is none."""
    return F.regexp_replace(F.nullif(F.regexp_extract(or_empty(c), RATING, 1), F.lit("")), ",", ".").cast("double")


def clean_filter(c: Column) -> Column:
    """Filter text without rating phrases, words of no weight and numbers."""
    words = tokens(normalize(F.regexp_replace(or_empty(c), RATING_PHRASE, " ")))
    return F.array_join(F.filter(words, lambda w: ~w.isin(STOP_WORDS) & ~w.rlike(r"^[0-9]+$")), " ")


def query_text(query: Column, filters: Column, repeat: int = 2) -> Column:
    """The query several times, then its clean filters."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *[normalize(query)] * repeat, clean_filter(filters)), r" +", " "))


def query_only_text(query: Column) -> Column:
    """The query without its filters."""
    return normalize(query)


def filter_only_text(filters: Column) -> Column:
    """The filters' words of weight."""
    return clean_filter(filters)


def query_key(stems: Column) -> Column:
    """Identity of a query whatever its word order: sorted distinct stems."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(stems))), " ")


def _quoted(key: str) -> str:
    return r"\Q" + key + r"\E"


def filter_pairs(c: Column, keys: list[str] = FILTER_KEYS) -> Column:
    """array<struct<key, value>>: known keys, longest first, and the trimmed text up to the next key."""
    either = "|".join(_quoted(k) for k in sorted(keys, key=len, reverse=True))
    pattern = F.lit(rf"(?s)({either})(.*?)(?=(?:{either})|$)")
    pairs = F.arrays_zip(F.regexp_extract_all(or_empty(c), pattern, 1).alias("key"), F.regexp_extract_all(or_empty(c), pattern, 2).alias("value"))
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), F.trim(p["value"]).alias("value")))


def checkable_filters(c: Column, keys: list[str] = FILTER_KEYS, checkable: list[str] = CHECKABLE_KEYS) -> Column:
    """'key value' in lower case of the pairs that items' parameters can answer."""
    held = F.filter(filter_pairs(c, keys), lambda p: p["key"].isin(checkable) & (p["value"] != ""))
    return F.transform(held, lambda p: F.lower(F.concat(p["key"], F.lit(" "), p["value"])))


def compact_params(c: Column, keys: list[str] = COMPACT_KEYS, tail: int = COMPACT_TAIL) -> Column:
    """Each key with what follows it, so that long parameter texts keep their checkable parts; pieces may overlap."""
    low = F.lower(or_empty(c))
    pieces = []
    for k in keys:
        pattern = F.lit(rf"(?s)({_quoted(k)})(?=(.{{0,{tail}}}))")
        pieces.append(F.zip_with(F.regexp_extract_all(low, pattern, 1), F.regexp_extract_all(low, pattern, 2), lambda a, b: F.concat(a, b)))
    return F.array_join(F.concat(*pieces), " | ")


def filters_hold(filters: Column, params: Column) -> Column:
    """Does every filter occur in the compacted parameters? True without filters."""
    return F.forall(filters, lambda f: F.contains(params, f))


#: What encoders want before a query and before an item, by the encoder's kind.
PREFIXES = {"asymmetric": ("query: ", "passage: "), "plain": ("", "")}


def prefixed(c: Column, kind: str, is_query: bool) -> Column:
    """An encoder's text with the prefix of its kind."""
    return F.concat(F.lit(PREFIXES[kind][0 if is_query else 1]), or_empty(c))


def embedder_query(query: Column, filters: Column) -> Column:
    return F.concat_ws(". ", F.nullif(F.trim(clip(query, 200)), F.lit("")), F.nullif(F.trim(clip(filters, 300)), F.lit("")))


def embedder_item(title: Column, params: Column, description: Column) -> Column:
    whole = F.concat(clip(title, 150), F.lit(". "), clip(params, 500), F.lit(". "), clip(description, 500))
    return F.trim(F.regexp_replace(whole, r"\s+", " "))
