"""Exact top-k inner products by a dual-tree search over trees of queries and data.

1. Vectors are rounded to integers.  Equal vectors form a class; a class keeps its k + 1 smallest ids (found with
   salted windows), as no later id can be in a result.
2. Above blocks, the tree is grown in rounds, all nodes of a level at once: each node of more than BLOCK classes takes FANOUT
   pivots from a bounded sample of its own members (half of them farthest first, half by hash), and each member goes
   to its nearest pivot.  Depth grows with the data; what ends is a block of at most BLOCK classes.  Queries are those
   members of a block that are asked for.
3. Every block, and every group of queries, has a cover tree: the centres of a level are more than its radius apart
   (separation), are centres of all finer levels too (nesting), and have every row within that radius of one of them
   (covering).  Centres come farthest first, so one sequence gives all levels.  Rows are stored in the tree's order, a node is a
   range of rows that begins with its centre, and a level is the sizes of its nodes.
4. Each query group starts with the k-th best scores that its own block gives.
5. Both trees are descended together, level by level: above blocks by joins from node pairs to child pairs, inside a
   pair of group and block by arrays of node pairs.  A pair goes where the bound, that is the product of the
   centres plus what both covering radii can add, is below the worst of the queries' k-th scores.
6. Query groups are dealt to lanes of about LANE queries.  A block is sent to a lane once, if any group of the lane
   needs it.  Tasks hold a lane's running results, take blocks by falling bound, descend the two cover trees with the
   k-th scores reached so far, then multiply matrices of what is left.

Nothing but counts reaches the driver, nothing is broadcast.  Where data has no structure nothing can be pruned and
each query meets each row, the work that the exact answer needs; blocks are then sent once to each lane, which is rows x
queries / LANE.  A level of a cover tree that would need a centre for every SPARSE rows or fewer is not made.

Defined cases: null ids, null vectors, and those with null or non-finite components take no part.  Shorter vectors
have zeros in the components they lack.  Rows that repeat an id and vector count once; a query's results never
have its own id.  Ties go to the smaller id.  Fewer candidates than k: all.  Empty tables, and no queries, give an
empty result.  Components and scores beyond 64 bits are cut to the ends of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.scratch import dropped, stored

BLOCK = 4096
FANOUT = 32
#: Members of a node (on average) that its pivots are taken from.
SAMPLE = 640
LEAF = 64
#: Queries of a leaf of theirs.
FEW = 4
#: Radius of a level over that of the next finer one, and rows a centre that a level needs at least.
RATIO, SPARSE = 1.2, 4
GROUP = 512
LANE = 1 << 15
#: Members of a node that one task deals to their pivots.
DEAL = 1 << 16
SALTS = 16
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def rounded(vectors: DataFrame, is_query: Column, id: str, vector: str, scale: int) -> DataFrame:
    """id, q (integers) and asked of the rows that take part."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    q = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(fine & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), q.alias("q"), F.coalesce(is_query, F.lit(False)).alias("asked"))


def coded(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """``rows`` with v, the bytes of q as ``dim`` numbers of numpy type ``kind``, in place of q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1)
            sizes = np.diff(q.offsets.to_numpy())
            x = np.zeros((len(q), dim), kind)
            row = np.repeat(np.arange(len(q)), sizes)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = q.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["id", "v", "asked"])

    return rows.mapInArrow(run, "id bigint, v binary, asked boolean")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """v, ids (the k + 1 smallest of each distinct vector, ascending) and asked."""
    salted = rows.select("v", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["v", "salt"], ["v"]):
        salted = salted.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("nth") <= k + 1)
    known = salted.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.where("asked").select("v").distinct().withColumn("asked", F.lit(True))
    return known.join(asked, "v", "left").select("v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def farthest(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``x`` (at most ``size``, no two alike), each the farthest from those before it."""
    far, chosen = np.full(len(x), np.inf), []
    while len(chosen) < size:
        k = int(np.argmax(far))
        if far[k] <= 0:
            break
        chosen.append(k)
        far = np.minimum(far, ((x - x[k]) ** 2).sum(1))
    return np.array(chosen)


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)


def reach(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and covering radius."""
    centre = x.mean(0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(1).max()))


def cover_tree(x: np.ndarray, leaf: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of ``x`` in the order of a cover tree, and the sizes of the nodes of each level from the root on."""
    leaf = LEAF if leaf is None else leaf
    far = ((x - x[0]) ** 2).sum(1)
    centres, near, radius = [0], np.zeros(len(x), int), float(np.sqrt(far.max()))
    parents: list[np.ndarray] = []
    largest = len(x)
    while largest > leaf and radius > 1e-9:
        radius /= RATIO
        before, known, distance, owner = len(centres), list(centres), far.copy(), near.copy()
        while distance.max() > radius * radius and len(known) * SPARSE <= len(x):
            k = int(distance.argmax())
            closer = ((x - x[k]) ** 2).sum(1)
            owner[closer < distance] = len(known)
            distance = np.minimum(distance, closer)
            known.append(k)
        if len(known) * SPARSE > len(x):
            break
        if len(known) > before:
            # A centre hangs below the one of the level above that is nearest to it, an old one below itself.
            parents.append(np.concatenate([np.arange(before), near[np.array(known[before:], int)]]))
            centres, far, near = known, distance, owner
            largest = np.bincount(near).max()
    at_level, node = [near], near
    for up in reversed(parents):
        node = up[node]
        at_level.append(node)
    at_level.reverse()
    is_centre = np.full(len(x), -1)
    is_centre[centres] = np.arange(len(centres))
    # At each level a node's own centre comes first.
    keys = [np.where(child == parent, -1, child) for parent, child in zip(at_level[:-1], at_level[1:], strict=True)]
    order = np.lexsort([(is_centre != near).astype(int), *reversed(keys), at_level[0]])
    sizes = []
    for level in at_level:
        own = level[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sizes.append(np.diff(np.concatenate((starts, [len(x)]))).astype(np.int32))
    return order, sizes


class Tree:
    """A cover tree over rows in its order: per level where nodes begin, their centres, covering radii and centres' lengths."""

    def __init__(self, x: np.ndarray, sizes: list[np.ndarray]):
        self.begin = [np.cumsum(n) - n for n in sizes]
        self.centre = [x[b] for b in self.begin]
        self.far = [np.sqrt(np.maximum.reduceat(((x - np.repeat(c, n, axis=0)) ** 2).sum(1), b)) for c, n, b in zip(self.centre, sizes, self.begin, strict=True)]
        self.norm = [np.sqrt((c**2).sum(1)) for c in self.centre]
        # Children of a node are the nodes of the next level from first to last.
        self.first = [np.searchsorted(fine, coarse) for coarse, fine in zip(self.begin[:-1], self.begin[1:], strict=True)]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children, on the next level or, below the last one, the nodes themselves."""
        if level + 1 >= len(self.begin):
            return nodes, np.ones(len(nodes), np.int64)
        first = self.first[level]
        return first[nodes], np.append(first, len(self.begin[level + 1]))[nodes + 1] - first[nodes]


def node_pairs(queries: Tree, data: Tree, worst: np.ndarray) -> tuple[np.ndarray, int]:
    """Which (leaf of the queries, leaf of the data) may hold a score of at least ``worst`` (by query row), and how many node pairs were looked at."""
    a = b = np.zeros(1, np.int64)
    looked, depth = 0, max(len(queries.begin), len(data.begin))
    for level in range(depth):
        i, j = min(level, len(queries.begin) - 1), min(level, len(data.begin) - 1)
        if level:
            (fa, na), (fb, nb) = queries.children(level - 1, a), data.children(level - 1, b)
            pair = np.repeat(np.arange(len(a)), na * nb)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            a, b = fa[pair] + nth // nb[pair], fb[pair] + nth % nb[pair]
        looked += len(a)
        floor = np.minimum.reduceat(worst, queries.begin[i])
        q, d, qn, dn = queries.far[i][a], data.far[j][b], queries.norm[i][a], data.norm[j][b]
        bound = (queries.centre[i] @ data.centre[j].T)[a, b] + q * dn + d * qn + q * d
        keep = slack(bound, (q + qn) * (d + dn)) >= floor[a]
        a, b = a[keep], b[keep]
    open_ = np.zeros((len(queries.begin[-1]), len(data.begin[-1])), bool)
    open_[a, b] = True
    return open_, looked


def levels_to_bytes(sizes: list[np.ndarray]) -> bytes:
    return b"".join(np.concatenate(([len(n)], n)).astype(np.int32).tobytes() for n in sizes)


def levels_from_bytes(data: bytes) -> list[np.ndarray]:
    flat, at, out = np.frombuffer(data, np.int32), 0, []
    while at < len(flat):
        out.append(flat[at + 1 : at + 1 + flat[at]].astype(np.int64))
        at += 1 + flat[at]
    return out


def scores(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of integer rows as 64-bit integers."""
    most = np.sqrt((queries.astype(float) ** 2).sum(1).max() * (x.astype(float) ** 2).sum(1).max())
    if most < 1 << 52:
        return (queries.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < 1 << 62:
        return queries.astype(np.int64) @ x.astype(np.int64).T
    ends = np.iinfo(np.int64)
    return np.clip(queries.astype(object) @ x.astype(object).T, ends.min, ends.max).astype(np.int64)


def kth_scores(product: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th entry of each row reaches, -inf if there are fewer; column c stands for counts[c] entries."""
    if counts.sum() < k:
        return np.full(len(product), -np.inf)
    if product.shape[1] > k:
        top = np.argpartition(product, product.shape[1] - k, axis=1)[:, -k:]
    else:
        top = np.broadcast_to(np.arange(product.shape[1]), product.shape)
    value = np.take_along_axis(product, top, 1)
    order = np.argsort(-value, axis=1)
    full = np.cumsum(np.take_along_axis(counts[top], order, 1), 1) >= k
    return np.take_along_axis(np.take_along_axis(value, order, 1), full.argmax(1)[:, None], 1)[:, 0].astype(float)


class Best:
    """The k best entries (score, then smaller id) of each query so far, and its k-th score."""

    def __init__(self, kth: np.ndarray, k: int):
        self.k, self.kth = k, kth.copy()
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, row: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        row, score, id = (np.concatenate(p) for p in ((self.row, row), (self.score, score), (self.id, id)))
        order = np.lexsort((id, -score, row))
        row, score, id = row[order], score[order], id[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        self.row, self.score, self.id = row[keep], score[keep], id[keep]
        last = nth == self.k - 1
        self.kth[row[last]] = np.maximum(self.kth[row[last]], score[last])


def slack(bound, size):
    """Bounds leave room for rounding."""
    return bound + 1e-9 * size + 1e-6


def grown(known: DataFrame, dim: int, kind: str) -> DataFrame:
    """``known`` (v, ids, asked) with the path of its block in the tree."""
    as_matrix = lambda v: np.frombuffer(b"".join(v), kind).reshape(-1, dim).astype(float)
    placed, done = known.withColumn("path", F.array().cast("array<int>")), None

    def pivots(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        x = as_matrix(frame.v)
        first = farthest(x, FANOUT // 2)
        rest = np.setdiff1d(np.arange(len(x)), first)
        chosen = x[np.concatenate([first, rest[:: max(1, -(-len(rest) // (FANOUT // 2)))]]).astype(int)]
        return pd.DataFrame({"path": frame.path.iloc[:1], "salts": frame.salts.iloc[:1], "v": [chosen.tobytes()]})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            leads = np.flatnonzero(batch.column("lead").to_numpy(zero_copy_only=False)).tolist()
            for lead, begin, end in zip([None, *leads], [0, *(x + 1 for x in leads)], [*leads, batch.num_rows], strict=True):
                if lead is not None:
                    own = np.frombuffer(batch.column("v")[lead].as_py(), float).reshape(-1, dim)
                for at in range(begin, end, 4096):
                    part = batch.slice(at, min(4096, end - at))
                    to = nearest(as_matrix(part.column("v").to_pylist()), own)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("v", "ids", "asked", "path")), pa.array(to.astype(np.int32))], ["v", "ids", "asked", "path", "to"])

    while True:
        sizes = placed.groupBy("path").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > BLOCK).withColumn("salts", F.ceil(F.col("n") / DEAL).cast("int")))
        if large.isEmpty():
            return placed if done is None else done.union(placed)
        ready = placed.join(large, "path", "left_anti").select("v", "ids", "asked", "path")
        done = ready if done is None else done.union(ready)
        # The nodes of a round are few against their members; Spark broadcasts them by their size, or sorts.
        members = placed.join(large, "path")
        sampled = members.where(F.pmod(F.xxhash64("v", F.size("path")), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n") < SAMPLE)
        made = sampled.groupBy("path").applyInPandas(pivots, "path array<int>, salts int, v binary")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<bigint>"), ("asked", "boolean"))]
        leads = made.select("path", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("lead"), "v", *none)
        rest = members.select("path", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("lead"), "v", "ids", "asked")
        both = leads.union(rest).repartition("path", "salt").sortWithinPartitions("path", "salt", F.desc("lead"))
        placed = stored(both.mapInArrow(deal, "v binary, ids array<bigint>, asked boolean, path array<int>, to int").select("v", "ids", "asked", F.concat("path", F.array("to")).alias("path")))


PACKED = "path array<int>, part int, is_block boolean, centre array<double>, far double, worst double, n int, x binary, counts binary, ids binary, levels binary, kth binary"


def packed(placed: DataFrame, dim: int, kind: str, k: int) -> DataFrame:
    """PACKED: a row for each block, its rows in leaf order, and one for each group of queries in it."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v").reset_index(drop=True)
        x = np.frombuffer(b"".join(frame.v), kind).reshape(-1, dim)
        order, sizes = cover_tree(x.astype(float))
        x, frame = x[order], frame.iloc[order]
        counts, path = frame.ids.map(len).to_numpy(np.int32), frame.path.iloc[0]
        rows = [(path, -1, True, *_reach(x), -np.inf, len(x), x.tobytes(), counts.tobytes(), np.concatenate(frame.ids.to_list()).astype(np.int64).tobytes(), levels_to_bytes(sizes), None)]
        asked = x[frame.asked.to_numpy(bool)]
        for part, at in enumerate(range(0, len(asked), GROUP)):
            q = asked[at : at + GROUP]
            order, sizes = cover_tree(q.astype(float), FEW)
            q = q[order]
            kth = kth_scores(scores(q, x), counts, k)
            rows.append((path, part, False, *_reach(q), float(kth.min()), len(q), q.tobytes(), None, None, levels_to_bytes(sizes), kth.tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

    return placed.groupBy("path").applyInPandas(pack, PACKED)


def _reach(x: np.ndarray) -> tuple[list[float], float]:
    centre, far = reach(x.astype(float))
    return centre.tolist(), far


def needed(made: DataFrame) -> DataFrame:
    """q_path, q_part, path and bound of the (group, block) pairs that no bound rules out."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    depth = made.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    items = made.select("is_block", F.array_append("path", F.lit(-1)).alias("path"), "part", "centre", "far", "worst")

    def nodes(level: int) -> DataFrame:
        """A covering ball of what lies below each node of a level, queries (by their groups) and data apart."""
        node = F.slice("path", 1, level)
        own = items.select("is_block", node.alias("node"), "centre", "far", "worst", F.when(F.size("path") <= level, F.col("part")).otherwise(-2).alias("part"))
        first = own.groupBy("is_block", "node", "part").agg(F.first("centre").alias("middle"))
        met = own.join(first, ["is_block", "node", "part"])
        balls = met.groupBy("is_block", "node", "part").agg(F.first("middle").alias("centre"), F.max(apart(F.col("middle"), F.col("centre")) + F.col("far")).alias("far"), F.min("worst").alias("worst"))
        return balls.withColumns({"up": F.slice("node", 1, level - 1), "norm": F.sqrt(dot(F.col("centre"), F.col("centre")))})

    pairs = stored(made.sparkSession.createDataFrame([([], [])], "q_up array<int>, d_up array<int>"))
    for level in range(1, depth + 2):
        ball = stored(nodes(level))
        q, d = (ball.where(which).select(*(F.col(c).alias(f"{s}_{c}") for c in ball.columns)) for s, which in (("q", "not is_block"), ("d", "is_block")))
        size = (F.col("q_norm") + F.col("q_far")) * (F.col("d_norm") + F.col("d_far"))
        bound = slack(dot(F.col("q_centre"), F.col("d_centre")) + F.col("q_far") * F.col("d_norm") + F.col("d_far") * F.col("q_norm") + F.col("q_far") * F.col("d_far"), size)
        pairs = pairs.join(q, "q_up").join(d, "d_up").withColumn("bound", bound).where("bound >= q_worst")
        if level <= depth:
            pairs = stored(pairs.select(F.col("q_node").alias("q_up"), F.col("d_node").alias("d_up")).distinct())
    without_end = lambda c: F.filter(c, lambda x: x >= 0)
    return pairs.select(without_end("q_node").alias("q_path"), F.col("q_part"), without_end("d_node").alias("path"), "bound")


def searched(made: DataFrame, pairs: DataFrame, dim: int, kind: str, k: int) -> DataFrame:
    """v, score, id: the k best entries of each query class in each task of its lane."""
    groups, blocks = made.where("not is_block"), made.where("is_block")
    lanes = max(1, -(-groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // LANE))
    tasks = max(1, min(64, blocks.count() // 4))
    groups = groups.select(F.col("path").alias("q_path"), F.col("part").alias("q_part"), "x", "levels", "kth", "centre", "far")
    groups = stored(groups.repartitionByRange(lanes, "q_path", "q_part").withColumn("lane", F.spark_partition_id()))
    wanted = pairs.join(groups.select("lane", "q_path", "q_part"), ["q_path", "q_part"])
    wanted = wanted.groupBy("lane", "path").agg(F.max("bound").alias("bound"), F.collect_list(F.struct("q_path", "q_part")).alias("groups"))
    sent = wanted.join(blocks.select("path", "x", "counts", "ids", "levels"), "path")
    sent = sent.select("lane", F.pmod(F.xxhash64("path"), F.lit(tasks)).cast("int").alias("task"), "bound", "groups", "x", "counts", "ids", "levels", F.lit(None).cast("binary").alias("kth"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("counts", "ids")]
    held = groups.select("lane", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(float("inf")).alias("bound"), F.array(F.struct("q_path", "q_part")).alias("groups"), "x", *none, "levels", "kth")
    both = held.union(sent).repartition(min(20_000, lanes * tasks), "lane", "task").sortWithinPartitions("lane", "task", F.desc("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lambda b: np.frombuffer(b, kind).reshape(-1, dim)
        name = lambda g: (*g["q_path"], -1, g["q_part"])
        place, own = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            for q, _, best, _ in own.values():
                for at in range(0, len(best.row), 1 << 14):
                    part = slice(at, at + (1 << 14))
                    v = [q[r].tobytes() for r in best.row[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array(best.score[part]), pa.array(best.id[part])], ["v", "score", "id"])

        for batch in batches:
            for r in range(batch.num_rows):
                lane, task, _, groups, x, counts, ids, levels, kth = (c[r].as_py() for c in batch.columns)
                if place != (lane, task):
                    yield from out()
                    place, own = (lane, task), {}
                if kth is not None:
                    q = matrix(x)
                    own[name(groups[0])] = q, np.sqrt((q.astype(float) ** 2).sum(1)), Best(np.frombuffer(kth, float), k), Tree(q.astype(float), levels_from_bytes(levels))
                    continue
                block, sizes = matrix(x), levels_from_bytes(levels)
                counts, ids = np.frombuffer(counts, np.int32), np.frombuffer(ids, np.int64)
                first_id, leaf, tree = np.cumsum(counts) - counts, np.repeat(np.arange(len(sizes[-1])), sizes[-1]), Tree(block.astype(float), sizes)
                centres, far, length = tree.centre[-1], tree.far[-1], tree.norm[-1]
                for g in groups:
                    q, norms, best, asked = own[name(g)]
                    pairs, _ = node_pairs(asked, tree, best.kth)
                    q_leaf = np.searchsorted(asked.begin[-1], np.arange(len(q)), "right") - 1
                    top = slack(q.astype(float) @ centres.T + norms[:, None] * far, norms[:, None] * (length + far))
                    open_ = pairs[q_leaf] & (top >= best.kth[:, None])
                    asking, rows = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0)[leaf])
                    if not len(asking):
                        continue
                    product = scores(q[asking], block[rows])
                    a, c = np.nonzero(product >= best.kth[asking][:, None])
                    n = counts[rows[c]]
                    each = np.repeat(np.arange(len(a)), n)
                    entry = ids[np.repeat(first_id[rows[c]], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
                    best.add(asking[a[each]], product[a, c][each], entry)
        yield from out()

    return both.mapInArrow(run, "v binary, score bigint, id bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """RESULT: for each row with ``is_query`` the k other rows with the largest inner products."""
    spark = vectors.sparkSession
    src = rounded(vectors, is_query, id, vector, scale)
    most = F.max(F.greatest(F.array_max("q"), F.lit(-1) - F.array_min("q")))
    about = src.agg(F.max(F.size("q")).alias("dim"), most.alias("most"), F.count_if("asked").alias("asked")).first()
    if not about.asked:
        return spark.createDataFrame([], RESULT)
    dim = max(1, about.dim)
    kind = next(t for t in ("<i2", "<i4", "<i8") if (about.most or 0) <= np.iinfo(t).max)
    rows = coded(src, dim, kind)
    known = stored(classes(rows, k))
    made = stored(packed(grown(known, dim, kind), dim, kind, k + 1))
    found = stored(searched(made, needed(made), dim, kind, k + 1))
    dropped(known, made)
    # At most k + 1 entries of each task of the lane meet here.
    entry = F.struct("score", (-1 - F.col("id")).alias("back"))
    results = found.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, k + 1).alias("entries"))
    results = results.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    queries = rows.where("asked").select(F.col("id").alias("query_id"), "v").distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    others = F.slice(F.filter("entries", lambda e: e["back"] != -1 - F.col("query_id")), 1, k)
    done = queries.join(results, ["v", "salt"]).select("query_id", F.posexplode(others).alias("at", "e"))
    return done.select("query_id", (F.col("at") + 1).alias("rank"), (-1 - F.col("e.back")).alias("vec_id"), F.col("e.score").alias("score"))


def op8_dual_tree(spark, sf_dir: str) -> DataFrame:
    """The twenty best rows for every vector whose id is divisible by 20; vectors that are null or hold null or non-finite components take no part."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
