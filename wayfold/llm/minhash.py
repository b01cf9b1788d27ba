"""Near-duplicate documents by MinHash with tensored banding.

Each document's set of word shingles gets two small collections of ``tables`` hashes, each hash joining
``rows`` minhashes.  A table key is a pair (i-th of the left collection, j-th of the right one): tables**2
tables of 2 * rows minhashes each cost only 2 * tables * rows minhash computations.

1. One Python pass (numpy on Arrow buffers) gives each document its set's size and fingerprint, both collections
   and a parity sketch.
2. Documents with equal sets form a class; only its smallest id goes on.
3. Keys shared by two or more representatives give candidates.  First each member meets its key's hub, the member
   that meets most others over all its keys (the original of a group of copies meets more than any copy), and pairs are
   confirmed on full sets.  Members of one component are never paired again.  While the pairs of a key's members that
   lie in different components are more than PAIRS a member, another round takes another hub of each such key, as long
   as a round at least halves them.  What is then left is paired across components, size by size, so that groups of many
   near copies cost about a pair per member, and no link between components is left out.
4. Before full sets meet, pairs are held against their parity sketches: SKETCH bits, each the parity of the
   shingles that fall on it.  Two sketches differ in at most as many bits as the sets have shingles that are
   not shared, so the test loses no pair; it spares the texts of those that are clearly too far apart.
5. Components by minimum labels over stored tables.

Defined cases: null or wordless text: empty set, linked with nothing.  Null id: linked with nothing,
component null, kept.  Repeated ids are one node.  An empty table gives an empty result.  Sets are sets of
64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.byte_tools import LOWER, mixed, shingles, slices, span_hashes, words
from wayfold.llm.components import components
from wayfold.llm.id_filter import divided
from wayfold.llm.names import unused
from wayfold.llm.scratch import dropped, stored


#: Bits of a parity sketch.
SKETCH = 2048
#: Pairs a member, on average, that need no further round of hubs.
PAIRS = 16


def tables_for(similarity: float, rows: int, recall: float = 0.997) -> int:
    """The smallest collection size that meets ``recall`` for a pair of exactly this similarity."""
    return math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - similarity**rows))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) over slices of the texts."""
    for at, to, buf, off in slices(texts):
        buf = LOWER[buf]
        starts, ends, first = words(buf, off)
        h, begin = shingles(span_hashes(buf, starts, ends), first, n)
        yield at, [np.unique(h[begin[i] : begin[i + 1]]) for i in range(to - at)]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set, as rows of 64-bit words."""
    out = np.zeros((len(sets), SKETCH // 64), np.int64)
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        row = np.repeat(np.arange(len(part)), [len(s) for s in part])
        bit = (np.concatenate([*part, np.zeros(0, np.uint64)]) >> np.uint64(17)) % np.uint64(SKETCH)
        odd = np.bincount(row * SKETCH + bit.astype(np.int64), minlength=len(part) * SKETCH) & 1
        out[at : at + 256] = np.packbits(odd.astype(bool).reshape(len(part), SKETCH), axis=1).view(np.int64)
    return out


def could_link(a: str, b: str, percent: int) -> Column:
    """Whether the sketches and sizes (``n``) of two sides leave room for the similarity; never false for a link."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = sum((F.bit_count(F.get(f"{a}.sketch", i).bitwiseXOR(F.get(f"{b}.sketch", i))) for i in range(SKETCH // 64)), F.lit(0))
    near = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return near & (apart * (100 + percent) <= n * (100 - percent))


def signatures(docs: DataFrame, shingle: int, tables: int, rows: int) -> DataFrame:
    """id, n, fp (16 bytes; null for empty sets), sketch, left and right (arrays of ``tables`` hashes)."""
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 1 << 63, 2 * tables * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 1 << 63, 2 * tables * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            for at, sets in shingle_sets(batch.column(1), shingle):
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                both = np.zeros((len(sets), 2 * tables), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for t in range(2 * tables):
                        h = np.zeros(len(full), np.uint64)
                        for r in range(rows):
                            k = t * rows + r
                            h = mixed(h * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(flat * a[k] + b[k], begin))
                        both[full, t] = h
                fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                signed = both.view(np.int64)
                side = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (parities(sets), signed[:, :tables], signed[:, tables:])]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), pa.array(sizes), pa.array(fps, pa.binary()), *side], ["id", "n", "fp", "sketch", "left", "right"])

    return docs.mapInArrow(run, "id bigint, n bigint, fp binary, sketch array<bigint>, left array<bigint>, right array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` with 100 * |A & B| >= percent * |A | B| on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left = [s for _, part in shingle_sets(batch.column(2), shingle) for s in part]
            right = [s for _, part in shingle_sets(batch.column(3), shingle) for s in part]
            keep = []
            for x, y in zip(left, right, strict=True):
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(bool(len(x) and len(y)) and 100 * same >= percent * (len(x) + len(y) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = stored(ids)
    texts = stored(divided(docs, ids)[0].join(ids, "id", "left_semi").dropDuplicates(["id"]))
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _across(rest: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of one key in different components that could link.

    Sets that could link differ in size by at most the threshold, so members meet only within steps of that ratio.
    """
    step = F.floor(F.log("n") / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n").cast("int")
    whole = rest.join(sketches, "id").withColumn("step", step)
    near = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))
    x, y = whole.alias("x"), whole.withColumn("step", near).alias("y")
    fits = (F.col("x.key") == F.col("y.key")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.comp") < F.col("y.comp")) & could_link("x", "y", percent)
    return x.join(y, fits).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, rows: int = 3, tables: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    tables = tables or tables_for(percent / 100, rows)
    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sigs = stored(signatures(src, shingle, tables, rows))
    linked = sigs.where(F.col("id").isNotNull() & F.col("fp").isNotNull())
    reps = stored(linked.groupBy("fp").agg(F.min(F.struct("id", "n", "sketch", "left", "right")).alias("r")).select("fp", "r.*"))
    sketches = reps.select("id", "n", "sketch")
    keys = reps.select("id", F.posexplode("left").alias("i", "l"), "right").select("id", "i", "l", F.posexplode("right").alias("j", "r"))
    keys = keys.select("id", F.xxhash64("i", "j", "l", "r").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(shared, "key"))
    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    met = stored(met)
    hubs = stored(members.join(met, "id").groupBy("key").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("hub")))

    def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    def linked_pairs(pairs: DataFrame) -> DataFrame:
        x, y = sketches.alias("x"), sketches.alias("y")
        near = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(could_link("x", "y", percent)).select("a", "b")
        return stored(confirmed(stored(near), src, shingle, percent))

    compared = stored(ordered(members.join(hubs, "key").where("id <> hub"), "hub", "id"))
    edges = linked_pairs(compared)
    labels = components(edges)
    open_, before = members.select("key", "id"), None
    while True:
        placed = open_.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        # Hubs have met all members of their keys.
        rest = stored(placed.join(split, "key").join(hubs, "key").where("id <> hub").select("key", "id", "comp"))
        sizes = rest.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("same"))
        left = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0.0)).alias("pairs")).first()
        if not left.pairs:
            break
        if left.pairs <= PAIRS * left.n or (before is not None and left.pairs > before / 2):
            more = stored(confirmed(stored(_across(rest, sketches, percent).join(compared, ["a", "b"], "left_anti")), src, shingle, percent))
            if not more.isEmpty():
                labels = components(edges.union(more))
            break
        before = left.pairs
        best = F.max_by(F.struct("id", "comp"), F.struct("met", -F.col("id"))).alias("h")
        chosen = stored(rest.join(met, "id").groupBy("key").agg(best).select("key", F.col("h.id").alias("hub"), F.col("h.comp").alias("hub_comp")))
        pairs = ordered(rest.join(chosen, "key").where("comp <> hub_comp"), "hub", "id").join(compared, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        edges, compared = edges.union(linked_pairs(pairs)), compared.union(pairs)
        labels = components(edges)
        open_, hubs = rest.select("key", "id"), chosen.select("key", "hub")

    dropped(members, met, hubs, rest, compared, edges)
    comps = reps.select("fp", "id").join(labels, "id", "left").select("fp", F.coalesce("comp", "id").alias("component_id"))
    done = sigs.select("id", "n", F.when(F.col("id").isNotNull(), F.col("fp")).alias("fp")).join(comps, "fp", "left")
    comp = F.coalesce("component_id", "id")
    return done.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, and of rows that repeat its id one."""
    found = near_duplicates(docs, id, text, **options).where(F.col(id).isNotNull())
    key, keep, repeated = unused(docs.columns, "__id", "__kept", "__repeated")
    # Only documents that go, and those whose id repeats, are looked up; the others pass without a shuffle of their texts.
    touched = found.groupBy(F.col(id).alias(key)).agg(F.first("kept").alias(keep), (F.count("*") > 1).alias(repeated))
    touched = stored(touched.where(~F.col(keep) | F.col(repeated)))
    some, rest = divided(docs.withColumn(key, F.col(id).cast("long")), touched, key)
    met = some.join(touched, key, "left")
    kept = rest.select(docs.columns).union(met.where(F.col(keep).isNull()).select(docs.columns))
    if touched.where(F.col(keep) & F.col(repeated)).isEmpty():
        return kept
    return kept.union(met.where(keep).dropDuplicates([key]).select(docs.columns))


def op6_minhash_tensor(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document at three words and 85 %; null and wordless texts are linked with nothing."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)
