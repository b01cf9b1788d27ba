"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``size`` tokens; only longer documents are cut, from their end, so that the
first piece may be the shorter one.  Pieces of full size are sequences of their own.  The others are dealt by a
hash into shards of about SHARD pieces.  A shard starts from best fit in decreasing order; where that meets a lower
bound on the number of sequences (by total length, and by pieces too long to share one) nothing can be saved.  Every
other shard is evolved on ISLANDS islands (Spark rows): a chromosome is an assignment of pieces to bins; crossover
injects the other parent's best-filled bins whole, drops the bins that hold duplicates of the injected pieces, lets
displaced pieces take the place of smaller ones in bins that they fill better, and best-fits the rest.  After each
epoch an island's elite moves to the next island (a join), and a shard's best chromosome of all islands places its
pieces.  A shard's size is bounded by a parameter, so no task gets more with more data; splitting costs at most about
one sequence a shard.

Token ids are those of the byte-level BPE file; tiktoken encodes with the same vocabulary as ranks (tests hold
it against ``tokenizers``).  Strings that look like special tokens are ordinary text.

Defined cases: null text is empty, so its only token is the end id 0.  Repeated rows and null or repeated ids
are packed each on their own.  Pieces without a length, or of one outside 1 to ``size``, raise an error.  Columns
sequence_id and offset are replaced, all others pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import cache
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.names import unused
from wayfold.llm.scratch import stored

SIZE = 2048
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 6

#: Words whose ids a worker keeps; beyond that it starts anew.
CACHED_WORDS = 1 << 18
#: Two white-space characters in a row; without any, words can be cut by plain string operations.
RUN = re.compile(r"\s\s")
#: A lone space: the pattern of the tokenizer always begins a new word there.
LONE = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[tuple[str, str], Callable[[str], bytes]] = {}


class WordIds(dict):
    """Little-endian ids of a word with the space before it (a word that begins with a line end has none)."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.encode(word if word[:1] == "\n" else " " + word)
        if len(word) < 40:
            self[word] = ids
        return ids


def encoder(json_path: str, ranks_path: str) -> Callable[[str], bytes]:
    """text -> bytes of its little-endian unsigned 32-bit ids; made once in a worker.

    The tokenizer's pattern never joins a word with the one before a lone space or line end, so words are
    looked up one by one.
    """
    if (json_path, ranks_path) not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        @cache
        def slow() -> Tokenizer:
            made = Tokenizer.from_file(json_path)
            made.encode_special_tokens = True
            return made

        def encode(text: str) -> bytes:
            # tiktoken's pattern engine gives up on very long runs of one kind; such words go to the other library.
            ids = fast.encode_ordinary(text) if len(text) < 10_000 else slow().encode(text, add_special_tokens=False).ids
            return pack_ids(f"<{len(ids)}I", *ids)

        words = WordIds(encode)

        def by_word(text: str) -> bytes:
            head, *rest = LONE.split(text) if RUN.search(text) else text.replace("\n", " \n").split(" ")
            return encode(head) + b"".join(map(words.__getitem__, rest))

        _encoders[json_path, ranks_path] = by_word
    return _encoders[json_path, ranks_path]


def token_pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, json_path: str | None = None, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, if asked for) of each piece of each document."""
    import public_tokenizers

    json_path = json_path or str(public_tokenizers.path("byte_bpe_50k.json"))
    ranks_path = ranks_path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.frombuffer((encode(text) if text else b"") + bytes(4), "<u4")
                n, at, k = len(tokens), 0, 0
                while at < n:
                    to = at + ((n - at) % size or size)
                    part = tokens[at:to]
                    row.append(i), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
                    at, k = to, k + 1
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Bins:
    """Bins under best fit: for each free space the bins that have it, and a bit mask of the spaces in use."""

    def __init__(self, size: int):
        self.size, self.mask, self.by_free = size, 0, [[] for _ in range(size + 1)]
        self.items: list[list[int]] = []

    def add(self, items: list[int], used: int) -> None:
        self._put(len(self.items), self.size - used)
        self.items.append(items)

    def _put(self, b: int, free: int) -> None:
        self.by_free[free].append(b)
        self.mask |= 1 << free

    def fit(self, item: int, length: int) -> None:
        """Into the fullest bin that has room, else a new one."""
        room = self.mask >> length
        if not room:
            self.add([item], length)
            return
        free = length + (room & -room).bit_length() - 1
        spot = self.by_free[free]
        b = spot.pop()
        if not spot:
            self.mask &= ~(1 << free)
        self.items[b].append(item)
        self._put(b, free - length)


def fitness(bins: list[list[int]], lengths: list[int], size: int) -> float:
    return sum((sum(lengths[i] for i in b) / size) ** 2 for b in bins) / max(1, len(bins))


def lower_bound(lengths: list[int], size: int) -> int:
    """No packing has fewer bins: for each length a, pieces over size - a are alone, those over half a bin never share one."""
    x = np.sort(np.array(lengths, np.int64))
    before = np.concatenate(([0], np.cumsum(x)))
    half = int(np.searchsorted(x, size / 2, "right"))
    small = np.unique(np.concatenate(([0], x[:half])))
    first = np.searchsorted(x, small, "left")
    alone = np.searchsorted(x, size - small, "right")
    spare = (alone - half) * size - (before[alone] - before[half])
    more = np.maximum(0, -(-(before[half] - before[first] - spare) // size))
    return int((len(x) - half + more).max(initial=0))


def swapped(bins: list[list[int]], displaced: list[int], lengths: list[int], size: int, order: list[int]) -> None:
    """Displaced pieces take the place of one or two smaller ones where they fill a bin better; those become displaced."""
    out = sorted((lengths[i], i) for i in displaced)
    for b in order:
        own = bins[b]
        free = size - sum(lengths[i] for i in own)
        while free and out:
            gain, gone, came = 0, (), -1
            for k, i in enumerate(own):
                for rest in ((), *(((j,) for j in own[k + 1 :]) if len(own) <= 8 else ())):
                    held = lengths[i] + sum(lengths[j] for j in rest)
                    at = bisect_right(out, (held + free, len(lengths))) - 1
                    if at >= 0 and out[at][0] - held > gain:
                        gain, gone, came = out[at][0] - held, (i, *rest), at
            if not gain:
                break
            own.append(out.pop(came)[1])
            for i in gone:
                own.remove(i)
                insort(out, (lengths[i], i))
            free -= gain
    displaced[:] = [i for _, i in reversed(out)]


def refilled(bins: list[list[int]], displaced: list[int], lengths: list[int], size: int, rng: np.random.Generator) -> list[list[int]]:
    """``bins`` with the ``displaced`` pieces placed again, by exchange in some bins and then by best fit."""
    swapped(bins, displaced, lengths, size, rng.permutation(len(bins))[: 4 * len(displaced) + 16].tolist())
    out = Bins(size)
    for bin_ in bins:
        out.add(bin_, sum(lengths[i] for i in bin_))
    for i in displaced:
        out.fit(i, lengths[i])
    return out.items


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], size: int, rng: np.random.Generator) -> list[list[int]]:
    """A child of ``a`` with some of ``b``'s best-filled bins."""
    fill = sorted(range(len(b)), key=lambda k: -sum(lengths[i] for i in b[k]))
    take = fill[: max(1, len(fill) // 2)]
    chosen = [b[k] for k in take if rng.random() < 0.4] or [b[take[0]]]
    injected = {i for bin_ in chosen for i in bin_}
    kept, displaced = [list(bin_) for bin_ in chosen], []
    for bin_ in a:
        if injected.isdisjoint(bin_):
            kept.append(list(bin_))
        else:
            displaced += [i for i in bin_ if i not in injected]
    return refilled(kept, displaced, lengths, size, rng)


def mutated(a: list[list[int]], lengths: list[int], size: int, rng: np.random.Generator) -> list[list[int]]:
    """``a`` without its emptiest bin and up to two random ones, whose pieces are placed again."""
    least = min(range(len(a)), key=lambda k: sum(lengths[i] for i in a[k]))
    gone = {least, *rng.integers(0, len(a), 2).tolist()}
    return refilled([list(x) for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k]], lengths, size, rng)


def best_fit(lengths: list[int], size: int, order: np.ndarray) -> list[list[int]]:
    bins = Bins(size)
    for i in order.tolist():
        bins.fit(i, lengths[i])
    return bins.items


def first_population(lengths: list[int], size: int, rng: np.random.Generator, population: int = POPULATION) -> list[list[list[int]]]:
    """Best fit in decreasing order, then in orders that are more and more blurred."""
    x = np.array(lengths)
    return [best_fit(lengths, size, np.argsort(-x * (1 + 0.15 * k * rng.random(len(x))), kind="stable")) for k in range(population)]


def evolve(population: list[list[list[int]]], lengths: list[int], size: int, rng: np.random.Generator, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """``population`` after some generations, the best first; it stops at the lower bound."""
    rank = lambda c: (len(c), -fitness(c, lengths, size))
    low, most = lower_bound(lengths, size), len(population)
    population = sorted(population, key=rank)
    for _ in range(generations):
        if len(population[0]) <= low:
            break
        children = []
        for _ in range(max(2, most // 2)):
            i, j = sorted(rng.integers(0, len(population), 2).tolist())
            child = crossover(population[i], population[j], lengths, size, rng) if i != j else population[i]
            children.append(mutated(child, lengths, size, rng))
        population = sorted(population + children, key=rank)[: most + 1]
    return population[:most]


def _pack(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.uint16)
    for b, items in enumerate(bins):
        out[items] = b
    return out.tobytes()


def _unpack(chrom: bytes) -> list[list[int]]:
    of = np.frombuffer(chrom, np.uint16)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _evolved(size: int, epoch: int, generations: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, np.uint32).astype(int).tolist()
                rng = np.random.default_rng([int(r.shard), int(r.island), epoch])
                population = [_unpack(c) for c in r.chroms] if r.chroms is not None else first_population(lengths, size, rng)
                population = evolve(population, lengths, size, rng, generations)
                rows.append((r.shard, r.island, r.lengths, [_pack(c, len(lengths)) for c in population], len(population[0]), fitness(population[0], lengths, size)))
            yield pd.DataFrame(rows, columns=["shard", "island", "lengths", "chroms", "bins", "fit"])

    return run


ISLAND_SCHEMA = "shard bigint, island int, lengths binary, chroms array<binary>, bins bigint, fit double"


def pack(pieces: DataFrame, size: int = SIZE, shard: int = SHARD, generations: int = GENERATIONS) -> DataFrame:
    """``pieces`` (with a column length from 1 to ``size``) with sequence_id and offset."""
    if shard > 1 << 16:
        raise ValueError("a shard has at most 65,536 pieces")
    fits = F.assert_true(F.coalesce(F.col("length").between(1, size), F.lit(False)), f"a piece has 1 to {size} tokens").isNull()
    uid, = unused(pieces.columns, "__uid")
    named = stored(pieces.drop("sequence_id", "offset").where(fits).withColumn(uid, F.monotonically_increasing_id()))
    small = named.where(F.col("length") < size)
    # Hash shards vary in size around the mean, so the mean keeps clear of the 16-bit limit of a chromosome.
    shards = max(1, -(-small.count() // min(shard, 1 << 15)))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True])
        lengths = frame.length.tolist()
        bins = best_fit(lengths, size, np.arange(len(lengths)))
        low = lower_bound(lengths, size)
        return pd.DataFrame({"shard": frame.shard.iloc[:1], "uids": [frame.uid.to_numpy(np.int64).tobytes()], "lengths": [frame.length.to_numpy(np.uint32).tobytes()], "first": [_pack(bins, len(lengths))], "bins": [len(bins)], "low": [low]})

    dealt = small.select(F.pmod(F.xxhash64(uid), F.lit(shards)).alias("shard"), F.col(uid).alias("uid"), "length")
    spread = min(shards * ISLANDS, 20_000)  # a number of its own: by bytes alone, AQE would put all shards into one task
    groups = stored(dealt.repartition(min(shards, 20_000), "shard").groupBy("shard").applyInPandas(gather, "shard bigint, uids binary, lengths binary, first binary, bins bigint, low bigint"))
    open_ = groups.where("bins > low").select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("chroms"))
    islands = stored(open_.repartition(spread, "shard", "island").mapInPandas(_evolved(size, 0, generations), ISLAND_SCHEMA))
    for epoch in range(1, EPOCHS):
        elite = islands.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("chroms", 1, 1).alias("elite"))
        met = islands.join(elite, ["shard", "island"]).repartition(spread, "shard", "island").select("shard", "island", "lengths", F.concat("chroms", "elite").alias("chroms"))
        islands = stored(met.mapInPandas(_evolved(size, epoch, generations), ISLAND_SCHEMA))
    best = islands.groupBy("shard").agg(F.min_by(F.get("chroms", 0), F.struct("bins", -F.col("fit"), "island")).alias("chrom"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                of = np.frombuffer(r.chrom, np.uint16).astype(np.int64)
                lengths = np.frombuffer(r.lengths, np.uint32).astype(np.int64)
                order = np.argsort(of, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate(([True], np.diff(of[order]) > 0))
                at = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(of))))
                yield pd.DataFrame({uid: np.frombuffer(r.uids, np.int64)[order], "sequence_id": (np.int64(r.shard) << 20) + of[order], "offset": at})

    chosen = groups.join(best, "shard", "left").select("shard", "uids", "lengths", F.coalesce("chrom", "first").alias("chrom"))
    placed = chosen.mapInPandas(place, f"`{uid}` bigint, sequence_id bigint, offset bigint")
    full = named.where(F.col("length") >= size).select("*", (-F.col(uid) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.join(placed, uid).select(*named.columns, "sequence_id", "offset").union(full).drop(uid)


def op10_genetic_packing(spark, sf_dir: str) -> DataFrame:
    """Token pieces of every document, placed in sequences of 2,048; null text is its end alone."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs)).withColumnRenamed("id", "doc_id")
