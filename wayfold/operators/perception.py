"""Models over images: the engine reads tables of words, boxes and vectors; a site's own models fill them in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import text_score, trimmed


def apply_model(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, rows: int = 32) -> DataFrame:
    """Rows of ``schema`` that a model makes of image rows; ``load`` runs once a task and returns the model.

    The model sees at most ``rows`` images at once, so its memory does not grow with the partition.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), rows):
                yield model(frame.iloc[at : at + rows])

    return images.mapInPandas(run, schema)


def needs_retry(reading: Column, least: int = 25) -> Column:
    """Weak readings that another variant of the image should be tried for."""
    return text_score(reading) < least


def has_text(fragments: Column) -> Column:
    """Whether any fragment has recognised text or a note."""
    blank = lambda c: trimmed(F.coalesce(c, F.lit(""))) == ""
    return F.exists(F.coalesce(fragments, F.array()), lambda f: ~(blank(f["ocr_text"]) & blank(f["note"])))


def picture_url(name: Column, base: str) -> Column:
    """Address of a named picture: blanks as underscores, ``.svg`` where the name has no suffix, the rest percent-coded."""
    plain = F.replace(trimmed(name), F.lit(" "), F.lit("_"))
    full = F.when(plain.rlike(r"\.[A-Za-z0-9]{2,4}$"), plain).otherwise(F.concat(plain, F.lit(".svg")))
    return F.when(plain != "", F.concat(F.lit(base), F.replace(F.url_encode(full), F.lit("+"), F.lit("%20"))))


def fragment_payload(requests: DataFrame) -> DataFrame:
    """Requests whose fragments carry an image only where their type can use it and no sibling has text that goes first."""
    kind = lambda f: F.coalesce(f["clue_type"], F.lit("auto"))
    has_text = lambda f: kind(f).isin("street", "text", "highway") & (trimmed(F.coalesce(f["ocr_text"], F.lit(""))) != "")
    open_ = ~F.exists("fragments", has_text)
    shown = lambda f: F.when(kind(f).isin("heraldry", "flag") | ((kind(f) == "auto") & open_), f["image_b64"])
    return requests.withColumn("fragments", F.transform("fragments", lambda f: f.withField("clue_type", kind(f)).withField("image_b64", shown(f))))


def dry_run(requests: DataFrame) -> DataFrame:
    """What sending requests would carry: fragments, images, characters of recognised text."""
    f = F.coalesce("fragments", F.array())
    return requests.agg(
        F.count("*").alias("requests"), F.sum(F.size(f)).alias("fragments"), F.sum(F.size(F.filter(f, lambda x: F.coalesce(x["image_b64"], F.lit("")) != ""))).alias("images"),
        F.sum(F.aggregate(f, F.lit(0), lambda n, x: n + F.length(F.coalesce(x["ocr_text"], F.lit(""))))).alias("ocr_chars"),
    )
