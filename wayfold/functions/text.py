"""Text functions as column expressions: normal forms, tokens, scripts, house numbers, OCR scores.

Patterns carry ``(?iu)`` or ``(?U)``, so that case folding, word ends and white space go by Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for kinds of street, and the letters that plates share between alphabets.
STREET_TYPES = r"(?iuU)\b(?:ул|улица|пр-?т|проспект|переулок|шоссе|бул|бульвар|наб|набережная|пл|площадь)\b\.?"
STREET_MARKERS = ["ул", "улица", "проспект", "пр-т", "переулок", "шоссе", "бульвар", "набережная", "площадь"]
PLATE_LATIN, PLATE_CYRILLIC = "ABEKMHOPCTYX", "АВЕКМНОРСТУХ"

#: White space: all that the class s of patterns has with (?U).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

ALNUM = "A-Za-zА-Яа-яЁё0-9"
# Patterns of ordinals and house numbers.
TOKEN = rf"(?<![{ALNUM}])\d{{1,3}}[^{ALNUM}]+[йяеё](?![{ALNUM}])|[{ALNUM}]+"
ORDINAL = r"(?iuU)\b\d{1,3}\s*-\s*[йяеё](?![\w])"
HOUSE = r"(?iuU)\b(?:д|дом)\s*\.?\s*(\d+(?:/\d+)?[a-zа-я]?)\b"
COMPOUND = r"(?iuU)\b(\d{1,4}/\d{1,4}[a-zа-я]?)\b"
BARE_NUMBER = r"(?iuU)\b(\d+[a-zа-я]?)\b"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends; no pattern, as every row of an import is trimmed."""
    return F.btrim(c, F.lit(SPACES))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def runs_collapsed(c: Column) -> Column:
    """Any character three or more times in a row becomes two."""
    return F.regexp_replace(c, r"(?s)(.)\1{2,}", "$1$1")


def normalize(c: Column) -> Column:
    """Trimmed, lower case, ё as е, single spaces; null is empty."""
    return squeezed(F.replace(F.lower(trimmed(F.coalesce(c, F.lit("")))), F.lit("ё"), F.lit("е")))


def normalize_import(c: Column) -> Column:
    """``normalize`` with runs collapsed."""
    return trimmed(runs_collapsed(normalize(c)))


def normalize_ocr(c: Column) -> Column:
    """``normalize``, commas as spaces, Cyrillic letters and digits apart, runs collapsed; in this order."""
    s = F.regexp_replace(normalize(c), r"(?iuU),\s*(\d+[a-zа-я]?)\b", " $1")
    s = F.regexp_replace(s, r"(?U),\s*", " ")
    s = F.regexp_replace(s, r"([А-Яа-яЁё])(\d)", "$1 $2")
    s = F.regexp_replace(s, r"(\d)([А-Яа-яЁё])", "$1 $2")
    return runs_collapsed(s)


def normalize_street(c: Column) -> Column:
    """Street name without words for its kind; the same on both sides of a match."""
    return trimmed(squeezed(F.regexp_replace(normalize_ocr(c), STREET_TYPES, " ")))


def normalize_house(c: Column, compat: bool = True) -> Column:
    """House key without spaces.  ``compat`` collapses runs of digits as well (111 becomes 11); else letters only."""
    if compat:
        return F.replace(normalize_import(c), F.lit(" "), F.lit(""))
    return F.replace(F.regexp_replace(normalize(c), r"(?u)(\p{L})\1{2,}", "$1$1"), F.lit(" "), F.lit(""))


def tokens(c: Column) -> Column:
    """Alphanumeric runs of two or more characters; a number of up to three digits before й, я or е is one ordinal."""
    found = F.regexp_extract_all(normalize_ocr(c), F.lit(f"({TOKEN})"), F.lit(1))
    joined = F.transform(found, lambda t: F.regexp_replace(t, rf"^(\d{{1,3}})[^{ALNUM}]+([йяе])$", "$1-$2"))
    return F.filter(joined, lambda t: F.length(t) >= 2)


def script(c: Column) -> Column:
    cyrillic, latin = c.rlike("[А-Яа-яЁё]"), c.rlike("[A-Za-z]")
    return F.when(cyrillic & latin, "mixed").when(cyrillic, "cyrillic").when(latin, "latin").otherwise("unknown")


def street_marker_count(c: Column) -> Column:
    named = F.size(F.filter(tokens(c), lambda t: t.isin(STREET_MARKERS)))
    return F.greatest(F.regexp_count(normalize_ocr(c), F.lit(STREET_TYPES)), named)


def name_tokens(c: Column, cities: Column) -> Column:
    """Distinct tokens of four or more letters that are neither a city (array ``cities``) nor only a street word."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 4) & ~F.array_contains(cities, t) & (F.length(normalize_street(t)) >= 2)))


def house_number(c: Column, bare_too: bool = True) -> Column:
    """After ``д`` or ``дом`` the first number, else the last a/b, else (if ``bare_too``) the last bare number; null if none."""
    s = F.regexp_replace(normalize_ocr(c), ORDINAL, " ")
    marked = F.regexp_extract(s, HOUSE, 1)
    compound = F.regexp_extract_all(s, F.lit(COMPOUND), F.lit(1))
    bare = F.regexp_extract_all(F.regexp_replace(s, COMPOUND, " "), F.lit(BARE_NUMBER), F.lit(1))
    found = [F.when(marked != "", marked), F.try_element_at(compound, F.lit(-1)), F.try_element_at(bare, F.lit(-1))]
    return F.coalesce(*found[: 3 if bare_too else 2])


def house_number_int(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1).try_cast("long")


def house_keys(c: Column) -> Column:
    """Keys to try in order: the number as it is, then with ``к`` in place of ``/`` and the other way round."""
    key = normalize_house(c)
    return F.array_distinct(F.array(key, F.regexp_replace(key, r"^(\d+)/(\d+)", "$1к$2"), F.regexp_replace(key, r"^(\d+)к(\d+)", "$1/$2")))


def street_kind(c: Column) -> Column:
    s = normalize(c)
    kinds = (("pereulok", r"(?uU)\b(?:пер|переулок)\b"), ("prospekt", r"(?uU)\b(?:пр-?т|проспект)\b"), ("ploshchad", r"(?uU)\b(?:пл|площадь)\b"), ("ulitsa", r"(?uU)\b(?:ул|улица)\b"))
    out = F.when(F.lit(False), "")
    for name, pattern in kinds:
        out = out.when(s.rlike(pattern), name)
    return out


def ordinal_parts(c: Column) -> Column:
    """``N-й base`` as a struct (number, base); null if the name has no ordinal."""
    pattern = r"(?iuU)^(\d{1,3})\s*-\s*[йяеё]\s+(.+)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).cast("int").alias("number"), F.regexp_extract(c, pattern, 2).alias("base")))


def in_text(key: Column, text: Column, text_tokens: Column) -> Column:
    """Keys of up to three characters must be a token; longer ones a part of the text."""
    return F.when(F.length(key) <= 3, F.array_contains(text_tokens, key)).otherwise(F.contains(text, key))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Nd}]", ""))


def text_score(c: Column) -> Column:
    """Weight of an OCR reading: letters, digits, length, words and spaces; short garbage loses 50."""
    s = trimmed(F.coalesce(c, F.lit("")))
    spaces, words = F.length(s) - F.length(F.regexp_replace(s, r"(?U)\s", "")), F.size(F.split(s, r"(?U)\s+"))
    score = letters(s) * 5 + digits(s) * 2 + F.length(s) + words * 12 + F.least(F.lit(6), spaces) * 2
    short = (letters(s) <= 2) & (words <= 1) & (F.length(s) <= 4)
    return F.when(F.length(s) <= 2, 0).otherwise(F.greatest(F.lit(0), score - F.when(short, 50).otherwise(0)))


#: Spelling repairs (pattern, replacement) of OCR readings, in order (fixed values).
REPAIRS = [
    (r"(?iuU)\bули\s+ца\b", "улица"), (r"(?iuU)\bул\s+ица\b", "улица"), (r"(?iuU)\bказбекс\s*кая\b", "Казбекская"),
    (r"(?iuU)\bказбекск(?:ая|ой|ую)?\b", "Казбекская"), (r"(?iuU)\bул\.?(?!\w)", "улица"),
]


def repaired(c: Column, repairs: list[tuple[str, str]] = REPAIRS) -> Column:
    """Without quotation marks and backslashes, spellings repaired, single spaces."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[„“”«»]", "")
    s = F.translate(s, "\\—", " -")
    for pattern, to in repairs:
        s = F.regexp_replace(s, pattern, to)
    return trimmed(squeezed(s))


def is_garbage(c: Column) -> Column:
    """Readings without words: empty, three or more bare numbers, rows of single digits, one or two characters."""
    s = repaired(c)
    parts = F.split(s, " ")
    numbers = F.size(F.filter(parts, lambda p: p.rlike(r"^\p{Nd}+$")))
    long_words = F.size(F.filter(parts, lambda p: p.rlike("(?iu)[а-яa-z]{4,}")))
    cyrillic = F.size(F.filter(parts, lambda p: p.rlike("(?iu)[а-яё]{3,}")))
    return (
        (s == "") | ((numbers >= 3) & (long_words == 0)) | (s.rlike(r"(?U)(?:\b\d\b\s+){3,}") & (cyrillic == 0))
        | ((F.length(s) <= 2) & ~s.rlike(r"\d{2,}"))
    )


def plate_text(c: Column) -> Column:
    """Upper case, Ё as Е, look-alike Latin letters as Cyrillic, all else but letters and digits a space."""
    s = F.translate(F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("Ё"), F.lit("Е")), PLATE_LATIN, PLATE_CYRILLIC)
    return F.regexp_replace(s, rf"[^{ALNUM}]+", " ")


def grams(c: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; a shorter text has none."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def joined_text(parts: Column) -> Column:
    """Distinct non-blank parts in order, joined by line ends."""
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda p: trimmed(F.coalesce(p, F.lit("")))), lambda p: p != "")), "\n")


def pairs(names: Column, most: int = 6, limit: int = 20) -> Column:
    """Unordered pairs of the first ``most`` distinct names, by position, at most ``limit``."""
    n = F.slice(F.array_distinct(names), 1, most)
    made = F.flatten(F.transform(n, lambda x, i: F.transform(F.slice(n, i + 2, F.lit(most)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return F.slice(made, 1, limit)
