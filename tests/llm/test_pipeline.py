"""The pipeline's stages on a small table, and the registered queries with SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from wayfold.llm import minhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit(1), "size": F.lit(2)})
    junk = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "size": F.lit(2)})
    docs = docs.union(junk)
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, SF))
        seen[name] = now
    assert seen["language_id"].columns == seen["near_dedup"].columns == seen["mixing"].columns == docs.columns
    assert docs.count() - 2 == seen["language_id"].count()
    groups = minhash.near_duplicates(seen["language_id"], shingle=5, percent=80)
    assert sorted(r.doc_id for r in seen["near_dedup"].collect()) == sorted(r.doc_id for r in groups.where("kept").collect())
    times = seen["mixing"].groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] == 2 and 0 < times.count() < seen["near_dedup"].count()
    pieces = seen["packing"].where("piece = 0").groupBy("doc_id").count()
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, times.collect()))


@pytest.mark.parametrize("name", ["op3_warc_revisit", "op8_dual_tree", "op9_url_filter"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.sql(entry.oracle_sql()[name]).df()
    mine = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(theirs)
    rows = lambda df: sorted(repr(tuple(None if v != v else v for v in r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert sorted(mine) == columns and rows(mine) == rows(theirs)


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}


SHAPES = {  # name: result columns and types that the contracts fix
    "op1_media_jpeg": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_mixing_flow": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_warc_revisit": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op4_html_blocks": "page_id bigint, url string, text string, n_chars bigint",
    "op5_context_tree": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_minhash_tensor": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7_language_bloom": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_dual_tree": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_genetic_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_rank_merge": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op13_period_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "pipeline": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", list(SHAPES))
def test_registered_queries_have_the_stated_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for column in SHAPES[name].split(", "):
        key, kind = column.split()
        assert types[key] == kind, column
    table = {"op3": "pages", "op4": "pages", "op9": "pages"}.get(name.split("_")[0], "documents")
    rows = df.toPandas()
    if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9", "op12", "op13"):
        id = "page_id" if table == "pages" else "doc_id"
        assert sorted(rows[id]) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(id).collect())
    assert len(rows)


def test_packing_query_packs_every_token(spark):
    rows = entry.queries()["op10_genetic_packing"](spark, SF).toPandas()
    assert set(rows.doc_id) == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    filled = rows.sort_values("offset").groupby("sequence_id")
    assert all((g.offset.to_numpy() == [0, *g.length.cumsum()[:-1]]).all() and g.length.sum() <= 2048 for _, g in filled)
    assert len(filled) <= -(-rows.length.sum() // 2048) + 2


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("id", "size", "taken", "__size", "__lang", "__mix_size", "lang_pred", "kept", "uid", "times", "__id")})


@pytest.mark.parametrize("kind", ["empty", "nulls", "repeated", "long"])
def test_edge_cases_pass_all_stages(spark, kind):
    words = {"en": "the and of with that from this have which were", "de": "der die und das nicht mit ein auch sich wird"}
    plain = [(i, " ".join(f"{w}{i}" if k % 3 else w for k, w in enumerate(words[x].split() * 4)), x, "a", 1) for i in range(20) for x in [["en", "de"][i % 2]]]
    rows = {
        "empty": [], "nulls": [*plain, (None, None, None, None, None), (None, plain[0][1], None, None, None), (50, None, "en", None, 0), (51, "", "en", "b", 0), (52, " \n", None, "a", 3)],
        "repeated": [*plain, *plain, *plain[:3]], "long": [*plain, (77, "the and of with that " * 40_000, "en", "b", 1), (78, "x" * 300_000 + " the and of", "en", "b", 1)],
    }[kind]
    now = documents(spark, rows)
    columns, ids = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, SF))
        assert name == "packing" or now.columns == columns
        ids[name] = sorted((r.doc_id for r in now.select("doc_id").collect()), key=repr)
    if kind == "empty":
        assert not any(ids.values())
    if kind == "nulls":
        assert 50 not in ids["language_id"] and 51 not in ids["language_id"] and 52 not in ids["language_id"] and None in ids["near_dedup"]
    if kind == "repeated":
        assert ids["near_dedup"] == sorted(range(20), key=repr) and len(ids["language_id"]) == 43
    if kind == "long":
        assert 77 in ids["near_dedup"] and sorted(set(ids["mixing"])) == sorted(set(ids["packing"]))


def test_run_is_all_stages(spark):
    """The registered pipeline gives what the stages give one after another."""
    rows = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))
