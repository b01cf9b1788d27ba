"""Mixing sources to target weights by a min-cost flow over membership patterns.

1. Documents are summed by membership pattern, the sorted set of sources that hold them.  A document may be in
   several sources (an array column) or in one (a string column).
2. Targets: sources in code point order, null last, take ``weights`` in turn and share ``share`` times all words
   of the sources; a target stops at ``repeats`` times its source's size, and the excess is shared again.
3. Pattern words flow to the targets of the pattern's sources.  The r-th repetition of a word costs 2 r - 1, so
   costs are convex and nothing is repeated while unrepeated words of another pattern could serve.  Sources and patterns
   that hang together are a component (a source that overlaps with none is one of its own, with one pattern), and a Spark task solves each
   component: one largest flow for each price.  Its graph has a node for each source and pattern, not for documents; a
   component of more than MOST_PATTERNS patterns is an error that asks for coarser memberships.
4. A pattern's flow is a number of whole repetitions of all its documents and a rest.  The rest is chosen by a
   seeded hash: within each pattern, size classes from long to short documents each take their share of what is
   still missing, by whole hash buckets, so that short documents make up for what long ones overshoot.  Sums by
   bucket are at most BUCKETS rows for each class, whatever the number of documents.

A document is taken whole, none, or several times; the choice depends on its id, size and sources alone, so reruns
agree.  Defined cases: a null size is 0; a document of size 0 (null text, or text without words) is never taken.  Rows that are equal in
id, size and sources are taken alike.  Null sources are a source of their own; an empty or null array has no
source, is never taken and has null for source_size and target.  An empty table gives an empty result.  Columns of the same name as those added here
are replaced.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from wayfold.llm.components import components
from wayfold.llm.names import unused
from wayfold.llm.scratch import stored
from wayfold.tables import numbered

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
MOST_PATTERNS = 100_000


def capped_targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """name, size and target of (name, size): weights in turn by name, none above ``repeats`` times its size, the excess reshared.

    A target is the smaller of that limit and a rate times its weight.  Each round gives those that are free what the
    others leave; the rate only rises, so rounds end when no more sources reach their limit.
    """
    nth = (F.col("nth") - 1) % len(weights) + 1
    listed = numbered(sources, "nth", "name").select("name", "size", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), nth.cast("int")).alias("weight"), (F.lit(float(repeats)) * F.col("size")).alias("most"))
    all_ = listed.agg(F.sum("size").alias("size"), F.sum("most").alias("most")).first()
    left, rate, before = min(share * (all_.size or 0), all_.most or 0.0), 0.0, -1
    while True:
        over = F.col("most") < rate * F.col("weight")
        r = listed.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("most"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r.n == before or not r.weight:
            return listed.select("name", "size", F.least(F.col("most"), F.lit(rate) * F.col("weight")).alias("target"))
        rate, before = (left - (r.full or 0.0)) / r.weight, r.n


def route(supplies: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], repeats: int) -> dict[tuple[int, str], int]:
    """Words that flow from each pattern to each source: the largest flow, at the least cost of repetition.

    Only edges into patterns have a price, 2 r - 1 for the r-th copy, and a cheapest path never comes back to the
    start.  So paths of one price are taken together: the r-th copies are opened in turn, and each time the flow is
    made as large as it can be by shortest augmenting paths, a whole layer at once.
    """
    names = list(quotas)
    at = {s: len(supplies) + k for k, s in enumerate(names)}
    graph: list[list[int]] = [[] for _ in range(len(supplies) + len(names))]
    ends, room, links = [], [], {}
    for p, (sources, size) in enumerate(supplies):
        for s in sources:
            if s in at:
                links[p, s] = len(ends)
                for a, b, capacity in ((p, at[s], repeats * size), (at[s], p, 0)):
                    graph[a].append(len(ends))
                    ends.append(b), room.append(capacity)
    supply, demand = [0] * len(graph), [0] * len(supplies) + [quotas[s] for s in names]
    for _ in range(repeats):
        for p, (_, size) in enumerate(supplies):
            supply[p] += size
        while True:
            layer, queue = {n: 0 for n in range(len(supplies)) if supply[n]}, deque(n for n in range(len(supplies)) if supply[n])
            while queue:
                a = queue.popleft()
                for e in graph[a]:
                    if room[e] and ends[e] not in layer:
                        layer[ends[e]] = layer[a] + 1
                        queue.append(ends[e])
            goals = [layer[n] for n in layer if demand[n]]
            if not goals:
                break
            depth, following = min(goals), [0] * len(graph)
            for start in range(len(supplies)):
                path, node = [], start
                while supply[start]:
                    if demand[node] and layer.get(node) == depth:
                        amount = min(supply[start], demand[node], *(room[e] for e in path))
                        supply[start] -= amount
                        demand[node] -= amount
                        for e in path:
                            room[e] -= amount
                            room[e ^ 1] += amount
                        path, node = [], start
                        continue
                    while following[node] < len(graph[node]):
                        e = graph[node][following[node]]
                        if room[e] and layer.get(ends[e]) == layer[node] + 1 <= depth:
                            break
                        following[node] += 1
                    else:
                        if not path:
                            break
                        node = ends[path.pop() ^ 1]
                        following[node] += 1
                        continue
                    path.append(e)
                    node = ends[e]
    return {link: room[e ^ 1] for link, e in links.items()}


def _routed(links: pd.DataFrame) -> pd.DataFrame:
    """Of one component's links (pattern, name, words, target): the words that flow along each."""
    supplies, quotas = {}, {}
    for r in links.sort_values(["pattern", "name"]).itertuples(index=False):
        supplies.setdefault(r.pattern, ([], int(r.words)))[0].append(r.name)
        quotas[r.name] = round(r.target)
    if len(supplies) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources that overlap: use coarser memberships")
    repeats, patterns = int(links.repeats.iloc[0]), list(supplies)
    flows = route([(tuple(names), words) for names, words in supplies.values()], dict(sorted(quotas.items())), repeats)
    return pd.DataFrame([(patterns[p], name, words) for (p, name), words in flows.items()], columns=["pattern", "name", "flow"])


def routed(links: DataFrame, repeats: int) -> DataFrame:
    """(pattern, name, flow): the least-cost flow over links (pattern, name, words, target), component by component."""
    shared = stored(links.groupBy("pattern").agg(F.collect_list("name").alias("names")).where(F.size("names") > 1))
    if shared.isEmpty():
        parts = links.withColumn("part", F.col("name"))
    else:
        # The first source of a pattern stands for it, so the graph is one of sources.
        edges = shared.select(F.get("names", 0).alias("a"), F.explode("names").alias("b")).where("a <> b").distinct()
        parts = links.join(components(edges).withColumnRenamed("id", "name"), "name", "left").withColumn("part", F.coalesce("comp", "name"))
    rows = parts.select("part", "pattern", "name", "words", "target", F.lit(repeats).alias("repeats"))
    return rows.groupBy("part").applyInPandas(_routed, "pattern string, name string, flow long")


def _cuts(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one pattern's sums by size class and bucket: the first bucket of each class that is not in the rest."""
    frame = frame.sort_values(["grade", "bucket"], ascending=[False, True])
    missing, remaining, rows = float(frame.rest.iloc[0]), float(frame.words.sum()), []
    for grade, part in frame.groupby("grade", sort=False):
        sums = np.concatenate(([0.0], np.cumsum(part.words.to_numpy(float))))
        goal = missing * sums[-1] / remaining if remaining else 0.0
        n = int(np.argmin(np.abs(sums - goal)))
        rows.append((frame.pattern.iloc[0], int(grade), int(part.bucket.iloc[n]) if n < len(part) else BUCKETS))
        missing, remaining = missing - sums[n], remaining - sums[-1]
    return pd.DataFrame(rows, columns=["pattern", "grade", "cut"])


ADDED = ("size", "source_size", "target", "times", "taken")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def mix(docs: DataFrame, size: Column, id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 20240131, keep: tuple[str, ...] | None = None, prefix: str = "") -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, source_size, target (sums over the document's sources), times and taken.

    ``prefix`` stands before the names of the added columns.
    """
    spark = docs.sparkSession
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in {prefix + a for a in ADDED})
    one = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("~"))  # noqa: E731  "~": the null source, after all others
    if isinstance(docs.schema[source].dataType, ArrayType):
        members = F.coalesce(F.array_sort(F.array_distinct(F.transform(source, one))), F.array().cast("array<string>"))
    else:
        members = F.array(one(F.col(source)))
    # The separator is escaped, so that distinct sets give distinct patterns.
    pattern = F.array_join(F.transform(members, lambda m: F.replace(F.replace(m, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,"))), ",")

    id_, size_, members_, pattern_, bucket_, grade_, cut_, whole_, source_size_, target_ = unused(
        [*docs.columns, *(prefix + a for a in ADDED)], "__id", "__size", "__members", "__pattern", "__bucket", "__grade", "__cut", "__whole", "__source_size", "__target"
    )

    def sized(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        frame = frame.select(*(F.col(f"`{c}`") for c in columns), F.col(id).alias(id_), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias(size_), members.alias(members_), pattern.alias(pattern_))
        h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_, size_, pattern_), 64 - (BUCKETS.bit_length() - 1))
        return frame.withColumns({bucket_: h.cast("int"), grade_: F.floor(F.log2(F.greatest(size_, F.lit(1)))).cast("int")})

    sums = stored(
        sized(docs, ()).groupBy(F.col(pattern_).alias("pattern"), F.col(grade_).alias("grade"), F.col(bucket_).alias("bucket"))
        .agg(F.first(members_).alias("members"), F.sum(size_).alias("words"))
    )
    found = stored(sums.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("words").alias("words")))
    members_of = found.select("pattern", F.explode("members").alias("name"), "words")
    targets = stored(capped_targets(members_of.groupBy("name").agg(F.sum("words").alias("size")), weights, share, repeats))
    met = stored(members_of.join(targets, "name"))
    sums_of = met.groupBy("pattern").agg(F.sum("size").alias("source_size"), F.sum("target").alias("target"), F.first("words").alias("words"))
    flows = routed(met.select("pattern", "name", "words", "target"), repeats).groupBy("pattern").agg(F.sum("flow").alias("flow"))
    words = F.greatest("words", F.lit(1))
    planned = stored(sums_of.join(flows, "pattern").select("pattern", "source_size", "target", ((F.col("flow") - F.pmod("flow", words)) / words).cast("long").alias("whole"), F.pmod("flow", words).alias("rest")))
    cuts = stored(sums.join(planned.select("pattern", "rest"), "pattern").select("pattern", "grade", "bucket", "words", "rest").groupBy("pattern").applyInPandas(_cuts, "pattern string, grade int, cut int"))
    # A row for each pattern and size class, stored so that Spark knows its size when it chooses the join.
    steps = stored(cuts.join(planned, "pattern").select(F.col("pattern").alias(pattern_), F.col("grade").alias(grade_), F.col("cut").alias(cut_), F.col("whole").alias(whole_), F.col("source_size").cast("long").alias(source_size_), F.col("target").alias(target_)))
    times = F.when(F.col(size_) > 0, F.col(whole_) + (F.col(bucket_) < F.col(cut_)).cast("long")).otherwise(0)
    done = sized(docs, keep).join(steps, [pattern_, grade_], "left")
    times = F.coalesce(times, F.lit(0))
    added = (F.col(size_), F.col(source_size_), F.col(target_), times, times * F.col(size_))
    return done.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(prefix + n) for n, c in zip(ADDED, added, strict=True)))


def op2_mixing_flow(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null and wordless texts have size 0 and are not taken, null sources are one source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = stored(docs.select("doc_id", "source", word_count("text").alias("words")))  # texts are read once
    return mix(counted, F.col("words"), keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")
