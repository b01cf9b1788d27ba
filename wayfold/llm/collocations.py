"""Phrases that occur more often than their parts suggest, mined level by level.

Everything is per language.  Phrases are contiguous words within a piece of text.

1. Level k counts phrases of k words by 64-bit hashes; hashes with a count of ``least`` and more are broadcast as a
   Bloom filter (at most MOST_BLOCKS words of 64 bits, whatever their number).  A phrase of k words is counted only where
   both its parts of k - 1 words pass the filter of the level before.  A hash counts no less than each of its phrases, so no
   frequent phrase is lost; one that passes in vain is counted in vain.
2. One more pass spells out the phrases that pass the filters of all their levels and counts them exactly: these are
   the level tables (lang, phrase, words, f), with f >= ``least``.  Tasks count a slice at once, Spark sums before and after its
   shuffle, so a frequent phrase is a row a task.
3. A candidate is dropped if a longer one that holds it is nearly as frequent: every phrase sends its count to its parts
   (their greatest is kept, before the shuffle too).
4. Each cut of a candidate meets the counts of both parts in two joins with the level tables (Spark splits joins of
   frequent parts); the lowest-scoring cut counts.
5. First phrases of a language: in rounds, over ever fewer salted groups, so that no task sorts all of a language.

Sums and products are exact (decimals of 38 digits).

Defined cases: a null language is ``und``; null, empty and wordless texts have no phrases.  Repeated rows count
again; ids do not matter.  Ties go by count, then by phrase in byte order.  Very long texts are slices of their own.
Other columns do not matter.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.byte_tools import LOWER, WORD, mixed, slices, span_hashes, word_numbers
from wayfold.llm.id_filter import bloom, holds
from wayfold.llm.scratch import dropped, stored

#: Words of 64 bits in a level's filter at most (16 MiB).
MOST_BLOCKS = 1 << 21
#: Bytes of text that are counted together before Spark sums.
COUNTED_BYTES = 1 << 20
#: First phrases that a task compares in a round: so many groups of them.
GROUPS = 16
#: Bytes that end a piece.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(10, 14)]] = True
PHRASE_WORD = WORD & ~ENDS


def _spelt_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each binary value."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return span_hashes(buf, off[:-1], off[1:])


def _numbers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers of equal codes, and a place of each."""
    coded = pa.array(codes).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    place = np.zeros(len(coded.dictionary), np.int64)
    place[number] = np.arange(len(codes))
    return number, place


class Words:
    """The words of a slice of texts: number in the slice's dictionary, hash, language, and how far a piece goes on."""

    def __init__(self, langs: pa.Array, names: pa.Array, buf: np.ndarray, off: np.ndarray):
        buf = LOWER[buf]
        self.number, self.known, first, starts = word_numbers(buf, off, PHRASE_WORD)
        row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(first))
        # Pieces end at a byte of ENDS or with the text.
        self.piece = np.cumsum(ENDS[buf], dtype=np.int32)[starts] + row
        self.lang, self.names = langs.astype(np.int64)[row], names
        self.spelt = _spelt_hashes(self.known)[self.number]
        self.chain = _spelt_hashes(names)[self.lang]

    def longer(self, k: int) -> None:
        """``chain`` holds the hashes of the phrases of k words from each word on, after those of k - 1 words."""
        n = max(0, len(self.number) - k + 1)
        self.chain = mixed(self.chain[:n] * np.uint64(0x2545F4914F6CDD1D) + self.spelt[k - 1 :][:n])

    def begins(self, k: int, passing: np.ndarray | None) -> np.ndarray:
        """Where phrases of k words begin, both of whose parts pass."""
        here = np.arange(max(0, len(self.number) - k + 1))
        here = here[self.piece[here] == self.piece[here + k - 1]]
        return here if passing is None else here[passing[here] & passing[here + 1]]


def word_slices(batch: pa.RecordBatch) -> Iterator[Words]:
    coded = batch.column(0).dictionary_encode()
    langs = coded.indices.to_numpy()
    for at, to, buf, off in slices(batch.column(1), COUNTED_BYTES):
        yield Words(langs[at:to], coded.dictionary, buf, off)


def frequent_hashes(docs: DataFrame, k: int, before: np.ndarray | None, least: int) -> DataFrame:
    """Hashes (id) of phrases of k words in (lang, text) with a count of ``least`` or more; ``before``: the filter of the level before."""
    shared = docs.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch):
                for j in range(1, k):
                    words.longer(j)
                passing = holds(shared.value, words.chain) if k > 1 else None
                words.longer(k)
                counted = pa.array(words.chain[words.begins(k, passing)].view(np.int64)).value_counts()
                yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], ["id", "f"])

    counts = docs.mapInArrow(run, "id bigint, f bigint").groupBy("id").agg(F.sum("f").alias("f"))
    return stored(counts.where(F.col("f") >= least).select("id"))


def phrase_counts(docs: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """lang, words, phrase and f of the phrases in (lang, text) that pass the filters of all their levels; with 0 words: all words of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch):
                every = np.bincount(words.lang, minlength=len(words.names))
                yield _rows(words.names, np.flatnonzero(every), pa.array([""] * np.count_nonzero(every)), 0, every[every > 0])
                passing = None
                for k, own in enumerate(shared.value, 1):
                    words.longer(k)
                    here = words.begins(k, passing)
                    passing = np.zeros(len(words.chain), bool)
                    passing[here] = holds(own, words.chain[here])
                    here = here[passing[here]]
                    if not len(here):
                        break
                    code = words.lang[here]
                    for j in range(k):
                        code, place = _numbers(code * len(words.known) + words.number[here + j])
                    place = here[place]
                    parts = [words.known.take(pa.array(words.number[place + j])).cast(pa.large_string()) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
                    yield _rows(words.names, words.lang[place], phrase.cast(pa.string()), k, np.bincount(code))

    return docs.mapInArrow(run, "lang string, phrase string, words int, f bigint").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _rows(names: pa.Array, lang: np.ndarray, phrase: pa.Array, words: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([names.take(pa.array(lang)), phrase, pa.array(np.full(len(f), words, np.int32)), pa.array(f)], ["lang", "phrase", "words", "f"])


def first_of(rows: DataFrame, group: str, order: list[Column], key: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their rank: groups are divided by a salt, the first of each GROUPS parts meet in the next round."""
    largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, math.ceil(largest / (GROUPS * most)))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)))
    while True:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
        if parts == 1:
            return ranked.drop("__part")
        parts = math.ceil(parts / GROUPS)
        rows = ranked.drop("rank").withColumn("__part", F.pmod(F.col("__part"), F.lit(parts)))


def exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, longest: int = 4, covered: int = 80, scale: int = 2_000_000, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (counts of its parts at the cut), n (words of the language) and score.

    The score of a cut is floor(scale * a / (l + r)).  Candidates have 2 to ``longest`` words and a count of at least
    ``least``; one inside a longer one with at least ``covered`` per cent of its count is dropped.
    """
    src = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    filters = []
    for k in range(1, longest + 1):
        found = frequent_hashes(src, k, filters[-1] if filters else None, least)
        filters.append(bloom(found, found.count(), MOST_BLOCKS))
        dropped(found)
    every = stored(phrase_counts(src, filters).where((F.col("f") >= least) | (F.col("words") == 0)))
    levels = [every.where(F.col("words") == k).select("lang", "phrase", "f") for k in range(1, longest + 1)]

    def part(first: int | Column, length: int | Column) -> Column:
        return F.array_join(F.slice("words", first, length), " ")

    split = lambda level: level.withColumn("words", F.split("phrase", " "))
    inner = [
        split(levels[m - 1]).select("lang", F.explode(F.array(*(part(i, k) for k in range(2, m) for i in range(1, m - k + 2)))).alias("phrase"), "f")
        for m in range(3, longest + 1)
    ]
    found = reduce(DataFrame.union, levels[1:])
    if inner:
        longer = reduce(DataFrame.union, inner).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        open_ = F.col("longer").isNull() | (100 * exact("longer") < covered * exact("f"))
        found = found.join(longer, ["lang", "phrase"], "left").where(open_).drop("longer")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.size("words") - k).alias("right"))))
    cuts = split(found).select("lang", "phrase", F.col("f").alias("a"), cut.alias("c")).select("lang", "phrase", "a", "c.*")
    parts = reduce(DataFrame.union, levels[: longest - 1])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cuts.withColumns({"whole": exact("a") * F.lit(scale).cast("decimal(10,0)"), "both": exact("l") + exact("r")}).withColumn("score", F.expr("whole div both"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    lowest = stored(lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    ranked = first_of(lowest, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", most)
    total = every.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """First phrases of every language of the documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), worded as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), grams as (
  select lang, k, unnest([array_to_string(words[i:i + k - 1], ' ') for i in range(1, len(words) - k + 2)]) as phrase
  from worded, range(1, 5) as sizes(k)
), f as (
  select lang, phrase, any_value(k) as k, count(*) as f from grams group by lang, phrase
), total as (
  select lang, sum(f)::bigint as n from f where k = 1 group by lang
), level as (
  select *, string_split(phrase, ' ') as words from f where f >= 30
), inner_parts as (
  select lang, f, unnest([array_to_string(words[i:i + m - 1], ' ') for i in range(1, k - m + 2)]) as phrase
  from level, range(2, 4) as sizes(m) where m < k
), longer as (
  select lang, phrase, max(f) as longer from inner_parts group by lang, phrase
), candidate as (
  select c.lang, c.phrase, c.f as a, c.k, c.words from level c left join longer using (lang, phrase)
  where c.k > 1 and (longer is null or 100::hugeint * longer < 80::hugeint * c.f)
), cut as (
  select lang, phrase, a, i, array_to_string(words[1:i], ' ') as head, array_to_string(words[i + 1:], ' ') as tail
  from candidate, range(1, 4) as cuts(i) where i < k
), scored as (
  select cut.*, x.f as l, y.f as r, (2000000::hugeint * a) // (x.f::hugeint + y.f) as score
  from cut join f x on x.lang = cut.lang and x.phrase = head join f y on y.lang = cut.lang and y.phrase = tail
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, i) = 1
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""
