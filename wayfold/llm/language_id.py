"""Language identification by bit-sliced Bloom filters over byte n-grams.

One filter array serves all languages: a slot holds a bit mask of languages (one 64-bit word for each 63), and
the AND of an n-gram's slots returns every language that contains it.  A language's hits in a text are its
popcount over the text's n-grams, corrected for the filter's false positives (h - n f) / (1 - f), f the
language's fill to the power of the number of hashes.  The most corrected hits decide, ties to the smaller name; the
score is the share of the text's n-grams that the chosen language contains, after correction.

Training uses about ``sample`` labelled rows a language, chosen by a hash of the id (a documented bound; the
filter is then bounded too).  N-grams are counted, weighed and turned into slots by Spark.  An n-gram is a language's if its relative frequency there is at least MIN_SHARE of
its largest over all languages and it occurs MIN_COUNT times.

Text is reduced to lower case ASCII letters and bytes of longer characters; all else is a space.  Defined
cases: null text or no letter: ``und`` with score 0.  No labelled rows: ``und`` for all.  Repeated rows are judged
row by row.  Null ids count as training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.byte_tools import TALLY_BYTES, Tally, mixed, padded, slices
from wayfold.llm.scratch import stored

GRAM = 4
SAMPLE = 3000
MIN_COUNT = 3
MIN_SHARE = 0.25
HASHES = 3
MAX_SLOTS = 1 << 20
CLEAN = np.full(256, 32, np.uint8)
CLEAN[97:123] = np.arange(97, 123)
CLEAN[65:91] = np.arange(97, 123)
CLEAN[128:] = np.arange(128, 256)


def text_grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text (never one of spaces alone) and where each text's begin."""
    ext, new = padded(CLEAN[buf], off, 1, GRAM - 1, 32)
    key = np.zeros(max(0, len(ext) - GRAM + 1), np.int64)
    for k in range(GRAM):
        key = (key << 8) | ext[k : k + len(key)]
    keep = np.ones(len(key), bool)
    for k in range(1, GRAM):  # grams that would run into the next text
        keep[new[1:-1] - k] = False
    keep &= (key & 0xFFFF) != 0x2020
    at = np.flatnonzero(keep)
    return key[at], np.searchsorted(at, new)


def slots_of(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mixed(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(21 * k)) % np.uint64(slots)).astype(np.int64) for k in range(HASHES)]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, slots) from (id, text, lang) rows; slots has shape (words, slots)."""
    known = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r.c for r in known.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1, 1), np.int64)
    spark = labelled.sparkSession
    share = spark.createDataFrame([(n, i, min(1.0, sample / counts[n])) for i, n in enumerate(langs)], "lang string, code int, share double")
    # A row for each language, counted just before; without the hint Spark does not know how few they are and would shuffle the texts.
    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            code = batch.column(0).to_numpy()
            for at, to, buf, off in slices(batch.column(1), TALLY_BYTES):
                grams, begin = text_grams(buf, off)
                tally.add((np.repeat(code[at:to].astype(np.int64), np.diff(begin)) << 32) | grams)
        yield pa.RecordBatch.from_arrays([pa.array(tally.keys), pa.array(tally.counts)], ["key", "n"])

    n = chosen.select("code", "text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    n = stored(n.where(F.col("n") >= MIN_COUNT).select(F.shiftright("key", 32).cast("int").alias("code"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("gram"), "n"))
    rates = n.join(n.groupBy("code").agg(F.sum("n").alias("all")), "code").select("code", "gram", (F.col("n") / F.col("all")).alias("rate"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = stored(rates.join(top, "gram").where(F.col("rate") >= MIN_SHARE * F.col("top")).select("code", "gram"))
    most = kept.groupBy("code").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    slots = 1 << 10
    while slots < 12 * most and slots < MAX_SLOTS:
        slots *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, where = batch.column(0).to_numpy().astype(np.int64), slots_of(batch.column(1).to_numpy(), slots)
            at = np.concatenate([code // 63 * slots + s for s in where])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.int64(1) << (code % 63), len(where)))], ["at", "mask"])

    # What reaches the driver is the filter itself: at most MAX_SLOTS words for each 63 languages.
    words = kept.mapInArrow(fill, "at bigint, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(-(-len(langs) // 63) * slots, np.int64)
    masks[words.column("at").to_numpy()] = words.column("mask").to_numpy()
    return langs, masks.reshape(-1, slots)


def identify(docs: DataFrame, langs: list[str], masks: np.ndarray, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """id, the columns ``keep`` (which may hold the text), and language and score under ``names`` for every row."""
    model = docs.sparkSession.sparkContext.broadcast((langs, masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, masks = model.value
        slots = masks.shape[1]
        bit = [(masks[k // 63] >> (k % 63)) & 1 for k in range(len(langs))]
        false = np.array([b.mean() ** HASHES for b in bit])
        for batch in batches:
            pred, score = [], []
            texts = batch.column(place)
            for at, to, buf, off in slices(texts, 1 << 18):
                grams, begin = text_grams(buf, off)
                where = slots_of(grams, slots)
                hits = np.zeros((to - at, len(langs)))
                lo, full = begin[:-1], np.flatnonzero(np.diff(begin))
                for w in range(len(masks)):
                    both = masks[w][where[0]]
                    for s in where[1:]:
                        both &= masks[w][s]
                    for k in range(w * 63, min(len(langs), w * 63 + 63)):
                        if len(full):
                            hits[full, k] = np.add.reduceat((both >> (k % 63)) & 1, lo[full])
                n = np.maximum(1, np.diff(begin))[:, None]
                right = np.clip((hits - n * false) / np.maximum(1e-9, 1 - false), 0, n)
                for i in range(to - at):
                    value = texts[at + i].as_py()
                    if not langs or value is None or not any(map(str.isalpha, value)):
                        pred.append("und"), score.append(0.0)
                        continue
                    best = int(np.argmax(right[i]))
                    pred.append(langs[best]), score.append(float(right[i, best] / n[i, 0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:out], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:out], *names])

    src = docs.select(F.col(id), *keep) if text in keep else docs.select(F.col(id), *keep, F.col(text).alias("__text"))
    out, place = 1 + len(keep), src.columns.index(text if text in keep else "__text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:out])
    return src.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def language_predictions(docs: DataFrame, keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, the columns ``keep``, language and score under ``names``; learns from the labelled rows that are not held out."""
    langs, masks = fit(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs, langs, masks, keep=keep, names=names)


def op7_language_bloom(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from labelled rows that are not held out; null or letterless text is und."""
    found = language_predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
