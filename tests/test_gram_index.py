"""The name index against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions.fuzzy import similarities, similarity
from wayfold.operators import gram_index


def names(rng, n, letters="абвг д"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 18))).strip() for _ in range(n)]


def edited(rng, word):
    """A word with a few characters lost, put in or changed."""
    out = list(word)
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(out))
        out[at : at + rng.randint(0, 1)] = rng.choice(["", "ж", "а"])
    return "".join(out)


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(7)
    known = sorted(set(names(rng, 250)) | set(names(rng, 100, "клмнопрстуфхцчшщ")) - {""})
    known = [k for k in known if k]
    asked = sorted({q for k in known[::4] for q in (edited(rng, k), k[1:-1], "ул " + k)} | set(names(rng, 40)) | {"нет", "а"})
    gram_index.POSTING = 20
    index = gram_index.build_index(spark.createDataFrame([(k,) for k in known * 2], "name string"), "name")
    yield known, asked, index, spark.createDataFrame([(q,) for q in asked] + [(None,), ("",)], "q string")
    gram_index.POSTING = 10_000


def test_names_that_hold_a_text(both):
    known, asked, index, queries = both
    got = sorted(map(tuple, gram_index.names_holding(queries, "q", index).collect()))
    assert got == sorted((q, k) for q in asked if q for k in known if q in k) and len(got) > 100


@pytest.mark.parametrize("least", [70, 72, 75, 78, 100])
def test_similar_names(both, least):
    known, asked, index, queries = both
    got = {(r.q, r.text): r.similarity for r in gram_index.names_similar(queries, "q", index, least).collect()}
    want = {(q, k): s for q in asked if q for k in known if (s := similarity(q, k)) >= least}
    assert got == pytest.approx(want) and len(want) > 50


def test_no_key_stands_for_many_names(both, spark, tmp_path):
    known, _, index, queries = both
    largest = index.postings.groupBy("gram", "part").count().agg(F.max("count")).first()[0]
    assert largest <= 45 and index.grams.agg(F.max("df")).first()[0] > 100
    index.save(str(tmp_path / "i"))
    again = gram_index.GramIndex.load(spark, str(tmp_path / "i"))
    assert gram_index.names_holding(queries, "q", again).count() == gram_index.names_holding(queries, "q", index).count()
    with pytest.raises(ValueError, match="from 70 on"):
        gram_index.names_similar(queries, "q", index, 50)


def test_lanes_equal_one_pair_at_a_time(monkeypatch):
    monkeypatch.setattr("wayfold.functions.fuzzy.CELLS", 3000)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("абвгд ") for _ in range(n))
    pairs = [(word(rng.randint(0, 14)), word(rng.randint(0, 40))) for _ in range(2000)] + [(word(rng.randint(60, 70)), word(rng.randint(50, 90))) for _ in range(20)]
    pairs += [("\U0001f600aé", "xx\U0001f600aéx"), ("", ""), ("", "a"), ("a" * 64, "a" * 300)]
    assert similarities(pairs).tolist() == [similarity(*p) for p in pairs] and not len(similarities([]))


def test_patterns_are_dealt_by_number(spark, monkeypatch):
    """How many tasks have the patterns makes no difference to what is found."""
    names = spark.createDataFrame([(f"lower street {k}",) for k in range(40)] + [("aaaa aaaa",), ("upper",)], "name string")
    found = lambda: sorted(map(tuple, gram_index.names_similar(names, "name", gram_index.build_index(names, "name"), 80).select("name", "text").collect()))
    whole = found()
    monkeypatch.setattr(gram_index, "PATTERNS", 5)
    assert found() == whole and ("aaaa aaaa", "aaaa aaaa") in whole
