"""Street names in free text, as column expressions.

A text is cut at its words for kinds of street; what stands between two cuts is a run of words, and a name is what is
left of a run without the cities at its ends, without a house and all that follows it, and without a number at its end.
Texts that yield no name so are read word by word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.text import STREET_MARKERS, STREET_TYPES, normalize_ocr, normalize_street, tokens, trimmed

# Where a house begins in a run of words, a number at its end, and an ordinal.
HOUSE_ON = r"(?isuU)\b(?:д|дом)\s*\.?\s*\d+(?:/\d+)?[a-zа-я]?\b.*$"
NUMBER_AT_END = r"(?iuU)(?<=\s)(?:\d{1,4}/\d{1,4}[a-zа-я]?|\d+[a-zа-я]?)\s*$"
ORDINAL_ALONE = r"(?iuU)^\d{1,3}\s*-\s*[йяеё]$"


def between_cities(words: Column, cities: Column) -> Column:
    """An array of words without those of ``cities`` at either end."""
    other = F.transform(words, lambda w: ~F.array_contains(cities, w))
    first, last = F.array_position(other, True), F.array_position(F.reverse(other), True)
    length = F.size(words) - (first - 1) - (last - 1)
    return F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.greatest(length, F.lit(0)).cast("int")))


def names_by_kind(text: Column, cities: Column) -> Column:
    """Names between the words for kinds of street (empty without such a word); ``text`` is OCR-normalised."""
    runs = F.transform(F.split(F.regexp_replace(text, STREET_TYPES, "\n"), "\n"), lambda run: F.split(trimmed(run), " "))
    bare = F.transform(runs, lambda run: F.array_join(between_cities(run, cities), " "))
    named = F.transform(bare, lambda run: normalize_street(F.regexp_replace(F.regexp_replace(run, HOUSE_ON, ""), NUMBER_AT_END, "")))
    found = F.array_distinct(F.filter(named, lambda n: (F.length(n) >= 2) & ~F.array_contains(cities, n)))
    return F.when(text.rlike(STREET_TYPES), found).otherwise(F.array().cast("array<string>"))


def names_by_word(words: Column, cities: Column) -> Column:
    """Words of four characters and more that are neither a city nor a kind of street; an ordinal takes the next such word along."""
    none = F.lit(None).cast("string")

    def step(state: Column, word: Column) -> Column:
        found, held = state["found"], state["held"]
        apart = F.array_contains(cities, word) | word.isin(STREET_MARKERS)
        # An ordinal that finds no word after it counts as a word itself.
        alone = F.when(F.length(held) >= 4, F.array_append(found, held)).otherwise(found)
        joined = F.array_append(found, F.concat(held, F.lit(" "), word))
        long = F.when(F.length(word) >= 4, F.array_append(found, word)).otherwise(found)
        return (
            F.when(held.isNotNull() & ~apart, F.struct(joined.alias("found"), none.alias("held")))
            .when(apart, F.struct(F.when(held.isNull(), found).otherwise(alone).alias("found"), none.alias("held")))
            .when(word.rlike(ORDINAL_ALONE), F.struct(found.alias("found"), word.alias("held")))
            .otherwise(F.struct(long.alias("found"), none.alias("held")))
        )

    start = F.struct(F.array().cast("array<string>").alias("found"), none.alias("held"))
    taken = F.aggregate(words, start, step, lambda s: F.when(F.length(s["held"]) >= 4, F.array_append(s["found"], s["held"])).otherwise(s["found"]))
    return F.array_distinct(F.filter(F.transform(taken, normalize_street), lambda n: (n != "") & ~F.array_contains(cities, n)))


def street_candidates(text: Column, cities: Column) -> Column:
    """Array of normalised street names; ``cities`` are the seed table's names and aliases that the text holds as words."""
    by_kind = names_by_kind(normalize_ocr(text), cities)
    return F.when(F.size(by_kind) > 0, by_kind).otherwise(names_by_word(tokens(text), cities))
