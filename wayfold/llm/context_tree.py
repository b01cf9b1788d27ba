"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions (255 binary nodes, high bit first).  Each binary node has a tree of
contexts, the up to ``depth`` bytes before it.  A context holds zero and one counts; its Krichevsky-Trofimov
estimate is mixed in equal parts with the product over its longer contexts, at all depths (context-tree
weighting).  The log10 probability of a text is the sum over its bytes and one end byte (0); the start is
padded with bytes 0.

All training text is counted: (depth + 1)-byte strings and words are tallied inside tasks and summed by a
shuffle.  Every context that occurs takes part in the mixture; none is dropped or lumped together:

1. A binary node's tree meets others only in its own contexts, and a context holds its longer contexts, so the
   byte strings that end in one context of CUT + 1 bytes make up subtrees that need nothing else.  Tasks climb them
   and send up the log weights and counts of their binary nodes, summed per context of CUT bytes.
2. The driver mixes the contexts of at most CUT bytes, whose number does not grow with the corpus: 65,793 contexts with
   255 binary nodes each at most (16.8 million rows), of which those arrive that occur (44,060 rows at scale 0.1).
3. Tasks go down the subtrees again and give each byte string of any row its log10 probability, a stored table.
4. Texts meet that table: the strings that are frequent (at most HEAD_GRAMS, by a count threshold) in a broadcast
   array, the others in a join, once per row and string, as rows of four numbers; a row's own figures go once.

The base score needs each token's training count.  Words of the head (at most HEAD, by a count threshold from a
histogram) are looked up in a broadcast array; the other tokens join the word table in the same shuffle.

Defined cases: null text is empty and has only its end.  Null ids count as training rows.  Repeated rows and
ids are scored row by row.  No training rows: every bit is 1/2, and the base is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.byte_tools import LOWER, TALLY_BYTES, Tally, padded, slices, span_hashes, words
from wayfold.llm.scratch import stored

DEPTH = 5
#: Contexts of at most this many bytes are mixed on the driver, longer ones in tasks.
CUT = 2
HEAD = 1 << 20
HEAD_GRAMS = 1 << 20
FLUSH = 1 << 20
#: Byte strings whose subtrees are worked out at once, but for those of one context of CUT + 1 bytes.
SUBTREES = 1 << 17
#: Rows of a batch whose texts are counted at once.
RUN = 2048
#: Byte strings and words of training rows, and byte strings of the other rows.
GRAM, TERM, OTHER = 0, 1, 2


def grams(buf: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """For each byte and end byte: the ``depth`` bytes before it and itself, in one integer (itself lowest)."""
    ext, new = padded(buf, off, depth, 1, 0)
    key = np.zeros(len(ext), np.int64)
    for k in range(depth + 1):
        key[k:] |= ext[: len(ext) - k].astype(np.int64) << (8 * k)
    keep = np.ones(len(ext), bool)
    for k in range(depth):
        keep[new[:-1] + k] = False
    return key[keep]


def corpus_counts(texts: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): counts of byte strings and, in training rows, of word hashes, from (text, out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {kind: Tally() for kind in (GRAM, TERM, OTHER)}

        def out(kind: int) -> pa.RecordBatch:
            t, tallies[kind] = tallies[kind], Tally()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(t.keys), kind, np.int32)), pa.array(t.keys), pa.array(t.counts)], ["kind", "key", "n"])

        for batch in batches:
            # Rows are told apart in short runs, so that no second copy of a whole batch is held.
            runs = (batch.slice(at, RUN) for at in range(0, batch.num_rows, RUN))
            for part, kind in ((run.column(0).filter(run.column(1) if kind == OTHER else pc.invert(run.column(1))), kind) for run in runs for kind in (GRAM, OTHER)):
                for _, _, buf, off in slices(part, TALLY_BYTES):
                    tallies[kind].add(grams(buf, off, depth))
                    if kind == GRAM:
                        low = LOWER[buf]
                        starts, ends, _ = words(low, off)
                        tallies[TERM].add(span_hashes(low, starts, ends).view(np.int64))
                    for k in tallies:
                        if len(tallies[k].keys) > FLUSH:
                            yield out(k)
        for kind in tallies:
            yield out(kind)

    return texts.mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the counts in sequence, and the estimate that the next bit is one."""
    log_e = _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - 2 * 0.5723649429247001  # lgamma(0.5)
    return log_e, (ones + 0.5) / (zeros + ones + 1)


def binary_nodes(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of a byte's eight bits: the place of each string's node, its bit, and (context, node), zeros and ones by place."""
    for j in range(8):
        bit = (keys >> (7 - j)) & 1
        ids, at = np.unique((keys & ~255) | ((1 << j) - 1 + ((keys & 255) >> (8 - j))), return_inverse=True)
        yield at, bit, ids, np.bincount(at, n * (1 - bit), len(ids)), np.bincount(at, n * bit, len(ids))


def climb(ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None, depth: int, top: int):
    """Mix (context, node) of ``depth`` and the shorter ones down to ``top``; ``longer`` has the log weights below them.

    Gives (parent, stop, estimate) of each depth, then id, zeros, ones and summed log weight of those one above.
    """
    steps = []
    for d in range(depth, top - 1, -1):
        log_w, one = _kt(zeros, ones)
        stop = np.ones(len(ids))
        if longer is not None:
            log_e = log_w + np.log(0.5)
            log_w = np.logaddexp(log_e, longer + np.log(0.5))
            stop = np.exp(log_e - log_w)
        ids, parent = np.unique(ids & ((1 << 8 * d) - 1), return_inverse=True)
        zeros, ones, longer = (np.bincount(parent, x, len(ids)) for x in (zeros, ones, log_w))
        steps.append((parent, stop, one))
    return steps, ids, zeros, ones, longer


def descend(steps: list, so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate so far and the share left to longer contexts, from those one above the steps of ``climb``."""
    for parent, stop, one in reversed(steps):
        so_far, left = so_far[parent] + left[parent] * stop * one, left[parent] * (1 - stop)
    return so_far, left


def string_logs(counts: DataFrame, depth: int) -> DataFrame:
    """(key, seen, log) of each byte string of stored corpus counts: its count in all rows and its log10 probability."""
    cut = max(0, min(CUT, depth - 1))
    n = F.sum(F.when(F.col("kind") == GRAM, F.col("n")).otherwise(0))
    context = F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * (cut + 1)) - 1)
    # Counts are sums by kind and string already, so they are dealt by context at once: strings and contexts share one shuffle.
    dealt = counts.where(F.col("kind") != TERM).select(context.alias("ctx"), "key", "kind", "n").repartition("ctx")
    strings = dealt.groupBy("ctx", "key").agg(n.alias("n"), F.sum("n").alias("seen")).sortWithinPartitions("ctx")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """ctx, key, n and seen in pieces that end where a context ends."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy() for c in batch.columns]
            if sum(len(h[0]) for h in held) >= SUBTREES:
                at = int(np.searchsorted(new[0], held[-1][0][-1], "right"))
                if at < len(new[0]):
                    yield [np.concatenate(c) for c in zip(*held, [c[:at] for c in new], strict=True)]
                    held, new = [], [c[at:] for c in new]
            held.append(new)
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n, _ in whole(batches):
            for _, _, *nodes in binary_nodes(keys, n):
                _, *above = climb(*nodes, None, depth, cut + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in above], ["id", "zeros", "ones", "longer"])

    sent = strings.mapInArrow(up, "id bigint, zeros double, ones double, longer double")
    short = sent.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "longer")]).toArrow().sort_by("id")
    ids, *nodes = (short.column(c).to_numpy() for c in ("id", "zeros", "ones", "longer"))
    steps, *_ = climb(ids, *nodes, cut, 0)
    model = counts.sparkSession.sparkContext.broadcast((ids, *descend(steps, np.zeros(1), np.ones(1))))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, so_far, left = model.value
        for _, keys, n, seen in whole(batches):
            log = np.zeros(len(keys))
            for at, bit, *nodes in binary_nodes(keys, n):
                steps, above, *_ = climb(*nodes, None, depth, cut + 1)
                found = np.searchsorted(short, above)
                one = descend(steps, so_far[found], left[found])[0][at]
                log += np.log10(np.where(bit == 1, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, seen, log)], ["key", "seen", "log"])

    return strings.mapInArrow(down, "key bigint, seen bigint, log double")


def threshold(by_log: dict[int, int], room: int) -> int:
    """The least power of two such that at most ``room`` entries reach it, from entries by floor(log2)."""
    least = 1 << 62
    for e in sorted(by_log, reverse=True):
        room -= by_log[e]
        if room < 0:
            break
        least = 1 << e
    return least


def score_documents(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    spark = docs.sparkSession
    src = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("out"), F.col(text).alias("text"))
    train = src.where(~F.col("out"))
    n_train = train.count()
    counts = stored(corpus_counts(src.select("text", "out"), depth))
    strings = stored(string_logs(counts, depth))
    often = threshold({r.e: r.c for r in strings.groupBy(F.floor(F.log2("seen")).alias("e")).agg(F.count("*").alias("c")).collect()}, HEAD_GRAMS)
    frequent = strings.where(F.col("seen") >= often).select("key", "log").toArrow().sort_by("key")

    terms = counts.where(F.col("kind") == TERM).select("key", "n")
    by_log = {r.e: (r.v, r.s) for r in terms.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("v"), F.sum("n").alias("s")).collect()}
    distinct, tokens = sum(v for v, _ in by_log.values()) + (n_train > 0), sum(s for _, s in by_log.values()) + n_train
    least = threshold({e: v for e, (v, _) in by_log.items()}, HEAD)
    head = terms.where(F.col("n") >= least).toArrow()
    order = np.argsort(head.column("key").to_numpy().view(np.uint64))
    below = float(np.log10(tokens + distinct + 1))
    model = spark.sparkContext.broadcast((frequent.column("key").to_numpy(), frequent.column("log").to_numpy(), head.column("key").to_numpy().view(np.uint64)[order], np.log10(head.column("n").to_numpy()[order] + 1.0)))
    end = float(np.log10(n_train + 1.0)) - below
    own = pa.struct([("id", pa.int64()), ("out", pa.bool_()), *[(c, pa.int64()) for c in ("bytes", "tokens", "known")], ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string, string_log, known, known_log = model.value
        for batch in batches:
            for at, to, buf, off in slices(batch.column(2), 1 << 18):
                n = to - at
                key = grams(buf, off, depth)
                by_key = np.argsort(key)
                sorted_key = key[by_key]
                pos = np.minimum(np.searchsorted(string, sorted_key), max(0, len(string) - 1))
                hit = string[pos] == sorted_key if len(string) else np.zeros(len(key), bool)
                each = np.zeros(len(key))
                each[by_key[hit]] = string_log[pos[hit]]
                score = np.add.reduceat(each, off[:-1] + np.arange(n))
                lost = by_key[~hit]
                owner = np.searchsorted(off[:-1] + np.arange(n), lost, "right") - 1
                order = np.lexsort((key[lost], owner))
                owner, rare = owner[order], key[lost][order]
                begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1])])[: len(rare)])
                owner, rare, times = owner[begin], rare[begin], np.diff([*begin, len(rare)])
                low = LOWER[buf]
                starts, ends, first = words(low, off)
                h = span_hashes(low, starts, ends)
                pos = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[pos] == h if len(known) else np.zeros(len(h), bool)
                row = np.repeat(np.arange(n), np.diff(first))
                base = np.bincount(row[hit], known_log[pos[hit]] - below, n) + end
                n_known = np.bincount(row[hit], minlength=n) + (n_train > 0)
                tail = np.flatnonzero(~hit)
                uid = batch.column(0).slice(at, n)
                nulls = len(tail) + len(rare)
                kinds = np.repeat([TERM, GRAM], [len(tail), len(rare)]).astype(np.int32)
                parts = [batch.column(1).slice(at, n), batch.column(3).slice(at, n), *[pa.array(x.astype(np.int64)) for x in (np.diff(off), np.diff(first) + 1, n_known)], pa.array(base), pa.array(score)]
                figures = pa.StructArray.from_arrays(parts, fields=list(own))
                cols = [
                    pa.concat_arrays([uid, uid.take(pa.array(np.concatenate([row[tail], owner])))]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(kinds)]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate([h[tail].view(np.int64), rare]))]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate([np.ones(len(tail), np.int64), times.astype(np.int64)]))]),
                    pa.concat_arrays([figures, pa.nulls(nulls, own)]),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "kind", "key", "times", "own"])

    made = src.select(F.monotonically_increasing_id().alias("uid"), "id", "text", "out").mapInArrow(
        run, "uid bigint, kind int, key bigint, times bigint, own struct<id: bigint, out: boolean, bytes: bigint, tokens: bigint, known: bigint, base: double, score: double>"
    )
    rare = terms.where(F.col("n") < least).select(F.lit(TERM).alias("of"), F.col("key").alias("k"), F.log10(F.col("n") + 1.0).alias("log"))
    rare = rare.union(strings.where(F.col("seen") < often).select(F.lit(GRAM).alias("of"), F.col("key").alias("k"), "log"))
    keyed = made.withColumn("k", F.coalesce("key", F.xxhash64("uid"))).withColumn("of", F.coalesce("kind", F.lit(-1)))
    seen = keyed.join(rare, ["of", "k"], "left")
    is_term, is_gram = F.col("of") == TERM, F.col("of") == GRAM
    missing = F.assert_true(~is_gram | F.col("log").isNotNull(), "a byte string without probability").isNull()
    found = seen.where(missing).groupBy("uid").agg(
        *[F.max(f"own.{c}").alias(c) for c in ("id", "out", "bytes", "tokens")],
        F.sum(F.when(is_gram, F.col("log") * F.col("times")).otherwise(F.col("own.score"))).alias("score"),
        (F.coalesce(F.sum("own.known"), F.lit(0)) + F.count_if(is_term & F.col("log").isNotNull())).alias("known"),
        F.sum(F.when(is_term, F.coalesce("log", F.lit(0.0)) - below).otherwise(F.col("own.base"))).alias("base"),
    )
    return found.select(
        F.col("id").alias(id), F.col("out").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )


def op5_context_tree(spark, sf_dir: str) -> DataFrame:
    """Base and tree scores of every document, learned from those that are not held out; null text is its end alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
