"""Clues in short texts (plates, highways, phone codes) and the typing of fragments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.text import PLATE_CYRILLIC, digits, letters, plate_text, trimmed

# Patterns of plates, roads, dialling codes and words for streets.
PLATE = r"(?iu)(?<![A-ZА-Я0-9])[A-ZА-Я]\s*\d{3}\s*[A-ZА-Я]{2}\s*(\d{2,3})(?![A-ZА-Я0-9])"
LOOSE_PLATE = r"(?<![0-9])(\d{2,3})(?![0-9])"
LOOSE_WORDS = r"(?iu)регион|номер|код|гос"
HIGHWAY = r"(?iuU)\b([МАРЕMRAE]\s*[-–]?\s*\d{1,3})\b"
PHONE = r"(?:\+7|8)[\s\-()]*(\d{3})|\(\s*(\d{3})\s*\)"
STREET_HINT = r"(?iuU)\b(?:УЛ|УЛИЦА|ПР[- ]?Т|ПРОСПЕКТ|ПЕР|ПЕРЕУЛОК|ШОССЕ|ПЛОЩАДЬ|ДОМ)\b"
STRICT_PLATE = rf"([{PLATE_CYRILLIC}])\s*(\d{{3}})\s*([{PLATE_CYRILLIC}]{{2}})\s*(\d{{2,3}})"
# Scores by kind of clue, the order of kinds, and what each fragment type allows.
SCORES = {"plate": 0.95, "loose_plate": 0.55, "highway": 0.75, "phone": 0.65, "intersection": 0.92, "listed_intersection": 0.8}
KIND_PRIORITY = {"plate_region": 0, "highway": 1, "phone_code": 2, "heraldry": 3, "heraldry_region": 3, "street_centroid": 4, "house": 4, "city": 5}
OTHER_PRIORITY = 50
CLUE_LABELS = {
    "auto": "Авто", "plate": "Номер", "heraldry": "Герб", "flag": "Флаг", "highway": "Трасса", "street": "Улица / адрес", "text": "Текст", "ignore": "Не анализировать",
}
CLUE_TYPES = list(CLUE_LABELS)


def _upper(c: Column) -> Column:
    return F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("Ё"), F.lit("Е"))


def plate_codes(c: Column) -> Column:
    """Region codes of whole plates, in text order."""
    return F.regexp_extract_all(_upper(c), F.lit(PLATE), F.lit(1))


def loose_plate_codes(c: Column) -> Column:
    """Numbers of two or three digits where the text speaks of regions or plates."""
    found = F.regexp_extract_all(_upper(c), F.lit(LOOSE_PLATE), F.lit(1))
    return F.when(c.rlike(LOOSE_WORDS), found).otherwise(F.array().cast("array<string>"))


def highway_codes(c: Column) -> Column:
    """Codes like ``M-4``, letters as Latin."""
    found = F.regexp_extract_all(_upper(c), F.lit(HIGHWAY), F.lit(1))
    return F.transform(found, lambda m: F.concat(F.translate(F.substring(m, 1, 1), "МАРЕ", "MARE"), F.lit("-"), F.regexp_extract(m, r"(\d+)", 1)))


def phone_codes(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PHONE), F.lit(0))
    return F.transform(found, lambda m: F.regexp_extract(m, r"(\d{3})\D*$", 1))


def plate_repairs(code: Column) -> Column:
    """Codes to look up in order: as read, with its first 3 as 8, with its first 8 as 3 ($1 is the only group)."""
    return F.array(code, F.regexp_replace(code, "^([^3]*)3", "$18"), F.regexp_replace(code, "^([^8]*)8", "$13"))


def strict_plates(c: Column) -> Column:
    """(plate, code) of plates in the twelve shared letters after folding alphabets; no guards at the ends."""
    s = plate_text(c)
    groups = [F.regexp_extract_all(s, F.lit(STRICT_PLATE), F.lit(k)) for k in range(1, 5)]
    both = lambda a, b: F.concat(a, b)
    whole = F.zip_with(F.zip_with(groups[0], groups[1], both), groups[2], both)
    return F.zip_with(whole, groups[3], lambda p, code: F.struct(F.concat(p, code).alias("plate"), code.alias("code")))


def is_plate_shaped(width: Column, height: Column) -> Column:
    return (width > 0) & (height > 0) & (width / height).between(2.0, 6.5)


def guessed_type(c: Column, known_plate: Column, known_highway: Column) -> Column:
    """By the clues that the text yields; plates and highways count where the seed tables know one of their codes."""
    return F.when(known_plate, "plate").when(known_highway, "highway").when(F.size(phone_codes(c)) > 0, "text").otherwise("auto")


def fragment_blob(note: Column, ocr: Column) -> Column:
    return trimmed(F.concat_ws("\n", F.when(note != "", note), F.when(ocr != "", ocr)))


def effective_type(given: Column, note: Column, ocr: Column, width: Column, height: Column, known_plate: Column, known_highway: Column) -> Column:
    """A given type, else a street word, else the guess by clues, else by shape."""
    named = F.lower(trimmed(F.coalesce(given, F.lit("auto"))))
    blob = fragment_blob(note, ocr)
    guess = guessed_type(blob, known_plate, known_highway)
    shaped = F.when((digits(blob) >= 4) & (digits(blob) >= letters(blob)), "plate").otherwise("street")
    return (
        F.when(named.isin([t for t in CLUE_TYPES if t != "auto"]), named).when(blob.rlike(STREET_HINT), "street")
        .when(guess != "auto", guess).when(is_plate_shaped(width, height), shaped).otherwise("auto")
    )


def allows_emblems(kind: Column) -> Column:
    return kind.isin("auto", "heraldry", "flag")


def allows_text(kind: Column) -> Column:
    return ~kind.isin("ignore", "heraldry", "flag")


def emblem_floor(kind: Column) -> Column:
    return F.when(kind.isin("heraldry", "flag"), 0.35).otherwise(0.72)


def type_label(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, label in CLUE_LABELS.items():
        out = out.when(kind == name, label)
    return F.coalesce(out, F.nullif(kind, F.lit("")), F.lit(CLUE_LABELS["auto"]))


def kind_priority(kind: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, p in KIND_PRIORITY.items():
        out = out.when(kind == name, p)
    return out.otherwise(OTHER_PRIORITY)
