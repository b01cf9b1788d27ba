"""Text, clue, score and recognition functions against values worked out by hand."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.functions import clues, geo, text
from wayfold.functions.fuzzy import partial_ratio, similarity
from wayfold.functions.streets import street_candidates
from wayfold.operators import ocr


def each(spark, expr, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.v for r in rows.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (text.normalize, {"  Ёлка \t  ПАРК ": "елка парк", None: "", "": ""}),
        (text.normalize_import, {"Аааа  111": "аа 11"}),
        (text.normalize_ocr, {"ул. Вертковская, 36": "ул. вертковская 36", "народная12345": "народная 12345", "10а": "10 а", "a,b": "a b", "1000": "100"}),
        (text.normalize_street, {"пр-т Академика Лаврентьева": "академика лаврентьева", "Невский проспект": "невский", "пер. Тихий": "пер. тихий"}),
        (text.normalize_house, {"10 / 2 А": "10/2а", "111": "11"}),
        (text.tokens, {"1-й Примерный, дом 6": ["1-й", "примерный", "дом"], "1й Проезд": ["1-й", "проезд"], "": []}),
        (text.script, {"Москва": "cyrillic", "Moscow": "latin", "Mосква": "mixed", "12": "unknown"}),
        (text.house_number, {"Невского д. 10/2 кв 5": "10/2", "ул Мира 36/1 7": "36/1", "ул Мира 5 7": "7", "1-й проезд": None}),
        (text.house_keys, {"10/2": ["10/2", "10к2"], "10к2": ["10к2", "10/2"], "7": ["7"]}),
        (text.street_kind, {"пер. Мира ул.": "pereulok", "ул Мира": "ulitsa", "Мира": None}),
        (text.text_score, {"": 0, "ГЕ": 0, "ул Мира 5": 6 * 5 + 2 + 9 + 36 + 4, "абв": 3 * 5 + 3 + 12}),
        (text.repaired, {"«ули ца» Мира": "улица Мира", "ул. Мира": "улица Мира", "Аул": "Аул"}),
        (text.is_garbage, {"1 1 7 1": True, "улица": False, "": True, "5": True, "12": False}),
        (text.plate_text, {"a123bc77": "А123ВС77", "Ё-1": "Е 1"}),
        (clues.plate_codes, {"А123ВС 77 и о 777 оо 177": ["77", "177"], "1А123ВС77": []}),
        (clues.loose_plate_codes, {"регион 54": ["54"], "дом 54": []}),
        (clues.highway_codes, {"трасса М-4 и р 255, P5": ["M-4", "R-255"]}),
        (clues.phone_codes, {"+7 (383) 111, (495) 8812": ["383", "495", "812"]}),
        (clues.plate_repairs, {"33": ["33", "83", "33"]}),
        (lambda c: F.transform(clues.strict_plates(c), lambda p: p["code"]), {"A123BC77": ["77"], "Ж123ВС77": []}),
    ],
)
def test_text_functions(spark, function, cases):
    assert each(spark, function, list(cases)) == list(cases.values())


def test_pairs_and_joined_text(spark):
    row = spark.range(1).select(text.pairs(F.array(*map(F.lit, "abca"))).alias("p"), text.joined_text(F.array(F.lit(" x "), F.lit(None), F.lit("x"), F.lit("y"))).alias("t")).first()
    assert [tuple(p) for p in row.p] == [("a", "b"), ("a", "c"), ("b", "c")] and row.t == "x\ny"


def test_scores(spark):
    n = F.lit
    row = spark.range(1).select(
        geo.street_score(n(1)).alias("s"), geo.pair_score(n(1)).alias("p"), *(geo.house_score(n(100.0), n(d)).alias(f"h{d}") for d in (0, 2, 10, 11)),
        F.round(geo.haversine_km(n(55.7558), n(37.6173), n(59.9386), n(30.3141)), 0).alias("km"), geo.percent_text(n(0.5)).alias("t"), geo.percent_text(n(0.055)).alias("u"),
        geo.unit(F.array(n(3.0), n(4.0))).alias("v"), geo.unit(F.array(n(0.0))).alias("z"),
    ).first()
    assert (row.s, row.p, row.h0, row.h2, row.h10, row.h11, row.km, row.t, row.u) == (0.43, 0.62, 1.0, 0.85, 0.75, 0.65, 634.0, "50%", "5.5%")
    assert row.v == pytest.approx([0.6, 0.8]) and row.z == [0.0]


def test_similarity(spark):
    assert similarity("москва", "москва тверская") == 100 and similarity("", "") == 100 and similarity("", "a") == 0 and similarity(None, "a") is None
    assert similarity("abcd", "xxabedxx") == 75
    rows = spark.createDataFrame([("казнь", "казань"), (None, "a")], "a string, b string")
    assert [r.p for r in rows.select(partial_ratio("a", "b").alias("p")).collect()] == [80.0, None]


STREETS = {
    "новосельская степная тихвинская": ["новосельская", "степная", "тихвинская"], "москва ул. александра невского 40": ["александра невского"],
    "ул ленина ул мира д 5": ["ленина", "мира"], "москва": [], "ул. москва": [], "": [], "1-й примерный": ["1-й примерный"], "москва ул. 8-го марта, 36/1 москва": ["8-го марта"],
    "2-й 3-й степной москва 12-й": ["2-й 3-й", "степной", "12-й"], "1-й москва тверская": ["тверская"], "проспект мира дом 4 корпус 2 площадь труда": ["мира", "труда"],
    "пер. мира": ["мира"], "ул 10": ["10"],
}


def test_street_names(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(STREETS)], "i int, t string")
    found = [r.s for r in df.select("i", street_candidates(F.col("t"), F.array(F.lit("москва"))).alias("s")).orderBy("i").collect()]
    assert dict(zip(STREETS, found, strict=True)) == STREETS


def test_clue_types(spark):
    rows = [("plate", "", "", 1, 1), ("x", "", "ул Мира", 1, 1), ("auto", "", "А123ВС77", 1, 1), ("auto", "", "+7 383", 1, 1), (None, "", "12345", 100, 30), ("", "", "", 100, 30), ("auto", "", "", 10, 10)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, note string, ocr string, w int, h int")
    kind = clues.effective_type(F.col("t"), F.col("note"), F.col("ocr"), F.col("w"), F.col("h"), F.array_contains(clues.plate_codes(F.col("ocr")), "77"), F.lit(False))
    assert [r.x for r in spark.createDataFrame([("flag",), ("x",), (None,)], "k string").select(clues.type_label(F.col("k")).alias("x")).collect()] == ["Флаг", "x", "Авто"]
    assert [r.k for r in df.select("i", kind.alias("k")).orderBy("i").collect()] == ["plate", "street", "plate", "text", "plate", "street", "auto"]


def test_lines_bands_and_readings(spark):
    words = spark.createDataFrame([("i", 0, y, x, t, c) for y, x, t, c in [(10.0, 5.0, "b", 0.9), (9.0, 1.0, "a", 0.9), (40.0, 1.0, "c", 0.9), (41.0, 1.0, "noise", 0.1)]], ocr.WORDS)
    assert [(r.line, r.text) for r in ocr.text_lines(words).orderBy("line").collect()] == [(1, "a b"), (2, "c")]
    ink = spark.createDataFrame([("i", y, 100.0 if 20 <= y < 35 or 40 <= y < 50 or y == 90 else 1.0) for y in range(100)], "image_id string, y int, ink double")
    assert [(r.top, r.bottom) for r in ocr.text_bands(ink).collect()] == [(17, 52)]
    readings = spark.createDataFrame([("i", 0, "ГЕ"), ("i", 1, "улица Мира"), ("i", 2, "улица Мира")], "image_id string, variant int, text string")
    assert ocr.best_readings(readings).first().variant == 1
    lines = spark.createDataFrame([("i", 0, "ул Мира"), ("i", 1, "ул Мира дом"), ("i", 2, "5"), ("i", 3, "ул М")], "image_id string, seq int, text string")
    assert [r.text for r in ocr.merged_lines(lines).orderBy("line").collect()] == ["5", "ул Мира дом"]
    assert sorted(ocr.merged_lines_in_order(lines).toPandas().text) == ["5", "ул М", "ул Мира дом"]


def test_plates_agree_and_codes_are_repaired(spark):
    rows = spark.createDataFrame([("i", 0, "A123BC34"), ("i", 1, "a123bc34"), ("i", 2, "О777ОО77"), ("j", 0, "нет")], "image_id string, variant int, text string")
    regions = spark.createDataFrame([("84",)], "code string")
    assert [tuple(r) for r in ocr.best_plates(rows, regions).collect()] == [("i", "А123ВС34", "84", True)]


def test_confidence_and_crops(spark):
    words = spark.createDataFrame([("i", 0, 0.0, 0.0, "a", 90.6), ("i", 0, 0.0, 0.0, "b", -1.0), ("j", 0, 0.0, 0.0, "c", 0.0)], ocr.WORDS)
    assert {r.image_id: r.conf for r in ocr.mean_confidence(words).collect()} == {"i": 90.0, "j": 0.0}
    boxes = spark.createDataFrame([("i", -5, 0, 50, 50), ("i", 95, 0, 200, 50)], "image_id string, x1 int, y1 int, x2 int, y2 int")
    sizes = spark.createDataFrame([("i", 100, 100)], "image_id string, width int, height int")
    assert [(r.x1, r.x2) for r in ocr.crops(boxes, sizes).collect()] == [(0, 50)]


def test_streaming_import_and_windows(spark, tmp_path):
    from wayfold.streaming.ingest import ADDRESS, KEY, address_stream, append_addresses, windowed_counts

    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for k, rows in enumerate(([("А", "Мира", "1", 1.0, 2.0, 0), ("А", "ул Мира", "1", 9.0, 9.0, 1)], [("А", "Мира", "1", 5.0, 5.0, 0), ("А", "Мира", "2", 3.0, 4.0, 1)])):
        spark.createDataFrame(rows, ADDRESS).write.mode("append").parquet(source)
        append_addresses(address_stream(spark, source), table, str(tmp_path / "check")).awaitTermination()
        found = spark.read.parquet(table)
        assert found.count() == k + 1 and found.select(*KEY).distinct().count() == k + 1
    assert [r.lat for r in found.orderBy("house_norm").collect()] == [1.0, 3.0]
    events = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:07"]), "k": ["a", "a", "a"]}))
    assert sorted(r.n for r in windowed_counts(events, "ts", "k").collect()) == [1, 2]


def windows_best(a: str, b: str) -> float:
    """The definition, by brute force: the shorter string against every window of the longer one that is at most as long."""
    short, long = sorted((a, b), key=len)

    def common(x: str, y: str) -> int:
        row = [0] * (len(y) + 1)
        for ch in x:
            before = row
            row = [0]
            for k, other in enumerate(y):
                row.append(before[k] + 1 if ch == other else max(before[k + 1], row[k]))
        return row[-1]

    if not short:
        return 100.0 if not long else 0.0
    cuts = {(max(0, e - len(short)), min(len(long), e)) for e in range(1, len(long) + len(short))}
    return max(200 * common(short, long[i:j]) / (len(short) + j - i) for i, j in cuts)


def test_similarity_equals_brute_force(spark):
    from wayfold import queries

    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, n))) for n in (8, 14))
        assert similarity(a, b) == pytest.approx(windows_best(a, b))
    sf = "/root/testdata/sf0.001"
    found = {r.name: (r.other, r.similarity) for r in queries.queries()["fuzzy_best"](spark, sf).collect()}
    names = sorted({r.n for r in spark.read.parquet(f"{sf}/part.parquet").select(F.lower("p_name").alias("n")).collect()})
    best = {w: max((windows_best(w, n), -len(n), n) for n in names if n != w) for w in names}
    assert {w: (n, pytest.approx(s)) for w, (n, s) in found.items()} == {w: (n, s) for w, (s, _, n) in best.items() if s >= 70} and found
