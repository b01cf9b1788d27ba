"""The resolver on a small gazetteer: the golden cases, clues, and hand-derived scores."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wayfold.operators.gazetteer import addresses, appended, build_gazetteer, build_intersections
from wayfold.plans import locate as plan
from wayfold.plans import regression
from wayfold.plans.health import health
from wayfold.plans.locate import Seeds, city_scores, locate, located, numbered_houses, queried, request_texts, responses, street_matches, with_analysis
from wayfold.sources import osm, seeds

ROWS = [  # city, street, house, lat, lon
    ("Новосибирск", "улица Степная", "1", 55.00, 82.90), ("Новосибирск", "улица Степная", "3", 55.01, 82.90),
    ("Новосибирск", "улица Тихвинская", "2", 55.00, 82.91), ("Новосибирск", "улица Тихвинская", "4", 55.01, 82.91),
    ("Новосибирск", "Новосельская улица", "5", 55.05, 82.95), ("Новосибирск", "улица Александра Невского", "40", 55.06, 82.96),
    ("Рубцовск", "Степная улица", "1", 51.50, 81.20), ("Рубцовск", "Тихвинская улица", "9", 51.60, 81.40),
    ("Москва", "Тверская улица", "1", 55.76, 37.61), ("Москва", "Тверская улица", "7", 55.77, 37.60),
    ("Новосибирск", "улица Степная", "1", 0.0, 0.0),
]
CASES = """id,enabled,expect_kind,expect_contains_all,expect_not_contains,manual_text,note
three,1,intersection|intersection_approx,новосибирск|степная|тихвинская,рубцовск,"Новосельская Степная Тихвинская",
two,1,intersection|intersection_approx,новосибирск|степная|тихвинская,,"Степная Тихвинская",
house,1,house,новосибирск|невского|40,,"Новосибирск ул. Александра Невского 40",
city,1,city,москва,,Москва,
street,1,street_centroid,москва|тверская,,"Москва Тверская",
alias,1,city,санкт,,СПб,
lines,1,intersection|intersection_approx,новосибирск|степная|тихвинская,рубцовск,"Новосельская
Степная
Тихвинская",
off,0,house,nothing,,Москва,
"""


@pytest.fixture(scope="module")
def gazetteer(spark):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "city string, street string, house string, lat double, lon double, seq long")
    return build_gazetteer(rows.withColumn("seq", F.struct(F.lit(0).alias("kind"), "seq")))


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("seeds")
    (base / "cities.csv").write_text('name,lat,lon,aliases\nМосква,"55,7558",37.6173,мск|moscow\nСанкт-Петербург,59.9386,30.3141,питер|спб\nНовосибирск,55.0084,82.9357,новосиб\nбез,x,1,\n')
    (base / "plates.csv").write_text("﻿code,region,lat,lon\n54,Новосибирская область,55.0,82.9\n77,Город,1,2\n77,Москва,55.7,37.6\n")
    (base / "roads.csv").write_text("code,name,lat,lon,hint\nM-4,Дон,50.0,39.0,юг\n")
    phones = seeds.phone_cities(spark)
    return Seeds(seeds.cities(spark, str(base / "cities.csv")), seeds.plate_regions(spark, str(base / "plates.csv")), seeds.highways(spark, str(base / "roads.csv")), phones)


def ask(spark, *texts, fragments=None):
    rows = [(i, "s", 0, t, "geoguess", (fragments or {}).get(i, [])) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "request_id long, " + seeds.REQUEST)


def test_golden_cases(spark, gazetteer, known, tmp_path):
    (tmp_path / "cases.csv").write_text(CASES)
    cases = regression.cases(spark, str(tmp_path / "cases.csv")).withColumn("request_id", F.xxhash64("id")).cache()
    requests = cases.select("request_id", F.lit("s").alias("schema"), F.lit(0).cast("long").alias("created_at_ms"), "manual_text", F.lit("geoguess").alias("mode"), F.array().cast(ask(spark, "x").schema["fragments"].dataType).alias("fragments"))
    best = locate(requests, gazetteer, known).where("rank = 1").join(cases.select("id", "request_id"), "request_id").select("id", "kind", "name")
    results = {r.id: (r.ok, r.kind, r.name) for r in regression.checked(cases, best).collect()}
    assert len(results) == 7 and all(ok for ok, _, _ in results.values()), results


def test_first_address_of_a_key_stays(gazetteer):
    houses = gazetteer.houses.join(gazetteer.streets, "street_id").where("name_norm = 'степная' and house = '1'").select(gazetteer.houses.lat).collect()
    assert sorted(r.lat for r in houses) == [51.50, 55.00]
    ids = [r.house_id for r in gazetteer.houses.orderBy("house_id").collect()]
    assert ids == list(range(1, 11))


def test_nearest_house_is_marked(spark, gazetteer, known):
    row = locate(ask(spark, "Новосибирск ул. Александра Невского 28"), gazetteer, known).where("rank = 1").first()
    assert (row.kind, row.detail, row.score) == ("house", "house_approx", 0.65)
    assert row.name == "Новосибирск, улица Александра Невского, 40"


def test_city_scores_by_hand(spark, gazetteer, known):
    q = queried(request_texts(ask(spark, "Москва", "СПб")), known, gazetteer)
    found = {r.request_id: (r.name, round(r.score, 2)) for r in city_scores(q, known).where("rank = 1").collect()}
    assert found[0] == ("Москва", 10.03)
    assert found[1] == ("Санкт-Петербург", 6.5)


def test_clues_come_before_places_and_plates_silence_emblems(spark, gazetteer, known):
    known.emblems = spark.createDataFrame([("e", "Герб", "city", 1.0, 2.0, [1.0, 0.0])], seeds.EMBLEMS)
    fragment = lambda i, ocr, kind: (i, 0, (0, 0, 100, 30), "", ocr, "", kind)
    requests = ask(spark, "", "трасса М-4 тел. +7 (383) 1", "", fragments={0: [fragment("a", "А123ВС 77", "auto"), fragment("b", "", "heraldry")], 2: [fragment("c", "", "heraldry")]})
    vectors = spark.createDataFrame([(0, "b", [1.0, 0.0]), (2, "c", [0.9, 0.1])], "request_id long, fragment_id string, vector array<double>")
    rows = locate(requests, gazetteer, known, vectors).orderBy("request_id", "rank").collect()
    known.emblems = None
    assert [(r.request_id, r.kind, r.name) for r in rows] == [(0, "plate_region", "Москва (77)"), (1, "highway", "Дон (M-4)"), (1, "phone_code", "Новосибирск (383)"), (2, "heraldry", "Герб")]


def test_response_document(spark, gazetteer, known):
    requests = ask(spark, "Москва Тверская")
    row = responses(requests, *located(requests, gazetteer, known)).first()
    assert row.fragments == [] and row.script == "cyrillic" and row.tokens == ["москва", "тверская"] and row.best.kind == "street_centroid"
    assert '"schema":"wayfold.response.v1"' in row.json


def test_analysis_comes_back_with_the_response(spark, gazetteer, known):
    asked = ask(spark, "", fragments={0: [("a", 0, (0, 0, 100, 30), "", "А123ВС 77", "", "auto"), ("b", 0, (0, 0, 10, 10), "", "", "", "auto")]})
    found, analysis = located(asked, gazetteer, known)
    row = responses(asked, found, analysis).first()
    assert [(f.id, f.clue_type, f.detected_kind, f.detected_label, f.score) for f in row.fragments] == [("a", "plate", "plate_region", "Москва", 0.95), ("b", "auto", None, None, 0.0)]
    assert '"detected_label":"Москва"' in row.json
    shown = with_analysis(asked.selectExpr("request_id", "inline(fragments)"), analysis).orderBy("id").collect()
    assert [(r.id, r.detected_label) for r in shown] == [("a", "Москва"), ("b", None)]


def test_names_are_found_inside_words(spark, gazetteer, known):
    """A name that begins a word, or stands inside one, meets the longer name."""
    q = queried(request_texts(ask(spark, "Новосибирск ул. Тихвин", "Новосибирск ул. епная", "ул. ая")), known, gazetteer)
    found = {(r.request_id, r.query, r.name, r.similarity) for r in street_matches(q, gazetteer).collect()}
    assert {(0, "тихвин", "улица Тихвинская", 100.0), (1, "епная", "улица Степная", 100.0)} <= found and all(r[0] != 2 or r[1] == "ая" for r in found)
    assert (2, "ая", "Тверская улица", 100.0) in found


def test_misread_crossing_of_the_seed_table(spark, gazetteer, known):
    known.intersections = spark.createDataFrame([("Омск", "улица Красный Путь", "улица Березовая", 1.0, 2.0), ("Омск", "улица Мира", "улица Березовая", 3.0, 4.0)], "city string, street_a string, street_b string, lat double, lon double")
    rows = locate(ask(spark, "ул. Красный Пугь ул. Березовая", "ул. Красный Путь ул. Зелёная"), gazetteer, known).collect()
    known.intersections = None
    assert [(r.request_id, r.kind, r.lat, r.score) for r in rows if r.detail == "listed"] == [(0, "intersection", 1.0, 0.8)]


def test_cities_inside_words(spark, gazetteer, known):
    q = queried(request_texts(ask(spark, "подмосква речная", "мск")), known, gazetteer)
    found = {r.request_id: r.name for r in city_scores(q, known).where("rank = 1").collect()}
    assert found == {0: "Москва", 1: "Москва"}


def test_report(spark, gazetteer, known):
    from wayfold.plans.report import report

    samples = spark.createDataFrame([("city", float(x)) for x in range(1, 101)], "class string, ms double")
    results = spark.createDataFrame([(True,), (False,)], "ok boolean")
    lines = [r.line for r in report(gazetteer, known, samples, results).orderBy("nth").collect()]
    assert "houses: 10 rows" in lines and lines[-2:] == ["city: median 50.50 ms, p95 95.00 ms of 100", "cases passed: 1 of 2 (50.0 %)"]


def test_health_counts_tables(gazetteer, known):
    found = {r.name: (r.n, r.empty) for r in health(gazetteer, known).collect()}
    assert found["houses"] == (10, False) and found["intersections"] == (0, True) and found["seed_plates"] == (2, False)


def test_missing_and_empty_tables(spark, tmp_path):
    assert seeds.houses(spark, str(tmp_path / "none.csv")).count() == 0
    assert seeds.cities(spark, str(tmp_path / "none.csv")).count() == len(seeds.CITIES)


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(*values):
    return b"".join(varint((v << 1) ^ (v >> 63)) for v in values)


@pytest.fixture()
def extract(tmp_path):
    """A map extract with two crossing roads, an address point and an address area."""
    import zlib

    strings = ["", "addr:housenumber", "7", "addr:street", "улица Степная", "addr:city", "Новосибирск", "highway", "residential", "name", "улица Тихвинская", "4"]
    table = b"".join(field(1, s.encode()) for s in strings)
    dense = field(1, zigzag(1, 1, 1)) + field(8, zigzag(550000000, 100000, 100000)) + field(9, zigzag(829000000, 100000, 100000))
    dense += field(10, b"".join(map(varint, [1, 2, 3, 4, 5, 6, 0, 0, 0])))
    ways = [(10, [1, 2, 3], [7, 9], [8, 4]), (11, [2], [7, 9], [8, 10]), (12, [1, 3, 1], [1, 3, 5], [11, 10, 6])]
    group = field(2, dense)
    group2 = b"".join(field(3, field(1, i) + field(2, b"".join(map(varint, k))) + field(3, b"".join(map(varint, v))) + field(8, zigzag(*[b - a for a, b in zip([0, *refs], refs)]))) for i, refs, k, v in ways)
    block = field(1, table) + field(2, group) + field(2, group2)
    data = zlib.compress(block)
    blob = field(2, len(block)) + field(3, data)
    out = b""
    for kind, body in ((b"OSMHeader", field(1, b"x")), (b"OSMData", blob)):
        head = field(1, kind) + field(3, len(body))
        out += len(head).to_bytes(4, "big") + head + body
    (tmp_path / "a.osm.pbf").write_bytes(out)
    return str(tmp_path / "a.osm.pbf")


def test_map_extract_to_gazetteer(spark, extract):
    nodes, ways = osm.read_pbf(spark, extract, 2)
    assert [(r.id, round(r.lat, 4), round(r.lon, 4)) for r in nodes.orderBy("id").collect()] == [(1, 55.0, 82.9), (2, 55.01, 82.91), (3, 55.02, 82.92)]
    assert {r.id: r.refs for r in ways.collect()} == {10: [1, 2, 3], 11: [2], 12: [1, 3, 1]}
    rows = addresses(nodes, ways)
    found = {(r.street, r.house): round(r.lat, 5) for r in rows.collect()}
    assert found == {("улица Степная", "7"): 55.0, ("улица Тихвинская", "4"): round((55.0 + 55.02 + 55.0) / 3, 5)}
    gazetteer = build_gazetteer(rows)
    crossing = build_intersections(ways, nodes, gazetteer, spark.createDataFrame([("новосибирск",)], "name_norm string"), most=5).collect()
    assert [(r.inter_id, round(r.lat, 4)) for r in crossing] == [(1, 55.01)]


def test_broken_and_packed_extracts(spark, extract, tmp_path):
    import lzma
    import zlib

    data = Path(extract).read_bytes()
    (tmp_path / "b.osm.pbf").write_bytes(data[:-40])
    assert osm.read_pbf(spark, [extract, str(tmp_path / "b.osm.pbf")], 2, strict=False)[0].count() == 3
    with pytest.raises(Exception, match="ends inside"):
        osm.read_pbf(spark, [extract, str(tmp_path / "b.osm.pbf")], 2)[0].count()
    block = b"block" * 100
    assert osm.unpacked(field(1, block)) == osm.unpacked(field(3, zlib.compress(block))) == osm.unpacked(field(4, lzma.compress(block))) == block
    with pytest.raises(ValueError, match="not read"):
        osm.unpacked(field(6, block))


def test_files_come_in_their_order(spark, extract, tmp_path):
    """The same key in two files: the first file's row stays, wherever it stands in its file."""
    data = Path(extract).read_bytes()
    (tmp_path / "b.osm.pbf").write_bytes(data)
    rows = addresses(*osm.read_pbf(spark, [str(tmp_path / "b.osm.pbf"), extract], 2))
    first = rows.orderBy("seq").collect()
    assert [r.seq.path.rsplit("/", 1)[1][0] for r in first] == ["a", "a", "b", "b"] and build_gazetteer(rows).houses.count() == 2


def test_append_keeps_known_keys(spark):
    old = spark.createDataFrame([(1, "a", 1.0)], "id long, key string, lat double")
    new = spark.createDataFrame([(1, "a", 9.0), (2, "b", 2.0)], "id long, key string, lat double")
    assert sorted(map(tuple, appended(old, new, ["key"], "id").collect())) == [(1, "a", 1.0), (2, "b", 2.0)]


def test_commands(spark, extract, tmp_path, capsys):
    from wayfold.__main__ import main

    (tmp_path / "cases.csv").write_text("id,enabled,expect_kind,expect_contains_all,expect_not_contains,manual_text,note\na,1,house,степная|7,,Новосибирск ул. Степная 7,\n")
    where = ["--seeds", str(tmp_path), "--gazetteer", str(tmp_path / "g")]
    assert main([*where, "health"], spark) == 2
    assert main([*where, "build", str(tmp_path), "--exclude", "other", "--log", str(tmp_path / "log")], spark) == 0
    assert main([*where, "health"], spark) == 0
    assert main([*where, "regression", "--csv", str(tmp_path / "cases.csv")], spark) == 0
    assert main([*where, "report", "--csv", str(tmp_path / "cases.csv")], spark) == 0
    assert "cases passed: 1 of 1 (100.0 %)" in capsys.readouterr().out
    assert main([*where, "regression", "--csv", str(tmp_path / "none.csv")], spark) == 2
    (tmp_path / "asked.json").write_text('{"schema": "x", "manual_text": "Новосибирск Степная Тихвинская"}\n')
    assert main([*where, "locate", str(tmp_path / "asked.json"), str(tmp_path / "out")], spark) == 0
    assert '"kind":"intersection"' in spark.read.text(str(tmp_path / "out")).first().value


def test_models_and_payloads(spark):
    from wayfold.operators.perception import apply_model, dry_run, fragment_payload, needs_retry

    images = spark.createDataFrame([("a", bytearray(b"xyz"))], "path string, content binary")
    assert apply_model(images, lambda: lambda f: f.assign(n=f.content.map(len))[["path", "n"]], "path string, n long").first().n == 3
    f = lambda i, kind, ocr: (i, 0, None, "", ocr, "aW1n", kind)
    asked = ask(spark, "", "", fragments={0: [f("a", None, ""), f("b", "text", "words"), f("c", "flag", "")], 1: [f("d", "auto", "")]})
    sent = {x.id: x.image_b64 for r in fragment_payload(asked).collect() for x in r.fragments}
    assert sent == {"a": None, "b": None, "c": "aW1n", "d": "aW1n"}
    row = dry_run(asked).first()
    assert (row.requests, row.fragments, row.images, row.ocr_chars) == (2, 4, 4, 5)
    assert spark.range(1).select(needs_retry(F.lit("ГЕ")).alias("x")).first().x


def test_houses_by_number_equal_brute_force(spark):
    """The exact key first, then the nearest number: ties by key, then id; each street and number is looked up once."""
    rng = random.Random(3)
    houses = [(k, 1 + s % 2, s, h, h, float(k), 0.0) for k, (s, h) in enumerate((rng.randrange(4), rng.choice(["", "x"]) + str(rng.randrange(40)) + rng.choice(["", "/2", "а", "к2"])) for _ in range(150))]
    asked = sorted({(1 + s % 2, s, n) for s in range(5) for n in ("1", "7/2", "9к2", "20а", "39", "400")})
    table = spark.createDataFrame(houses, "house_id long, city_id long, street_id long, house string, house_norm string, lat double, lon double")
    got = {(r.street_id, r.number): (r.house, r.lat, r.distance) for r in numbered_houses(spark.createDataFrame(asked, "city_id long, street_id long, number string"), table).collect()}
    digits = lambda h: int(re.search(r"\d+", h).group())
    want = {}
    for _, street, number in asked:
        own = [(h, k) for k, _, s, h, *_ in houses if s == street]
        keys = list(dict.fromkeys([number, re.sub(r"^(\d+)/(\d+)", r"\1к\2", number), re.sub(r"^(\d+)к(\d+)", r"\1/\2", number)]))
        exact = [(keys.index(h), k, h) for h, k in own if h in keys]
        if exact:
            _, k, h = min(exact)
            want[street, number] = (h, float(k), 0)
        elif own:
            d, h, k = min((abs(digits(h) - digits(number)), h, k) for h, k in own)
            want[street, number] = (h, float(k), d)
    assert got == want and len({d for _, _, d in want.values()}) > 3


def test_requests_of_equal_texts_are_resolved_once(spark, known, gazetteer, monkeypatch):
    seen = []
    monkeypatch.setattr(plan, "queried", lambda texts, *a: (seen.append(texts.count()), queried(texts, *a))[1])
    said = ["Москва", "мск", "Москва"] * 5
    rows = locate(ask(spark, *said), gazetteer, known).collect()
    assert seen == [2]
    by = {}
    for r in rows:
        by.setdefault(r.request_id, []).append((r.rank, r.stage, r.kind, r.name, r.score))
    assert len(by) == 15 and len({tuple(sorted(v)) for v in by.values()}) == 2
