"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of a label are dealt to overlapping shards, those of pivots that stand
apart. A vector's home is its nearest pivot; it is dealt to every pivot that may
be the home of a vector in its range (see ``_deal``). In each shard a graph is
built: near candidates, robust-pruned, so that a neighbour is kept only where no
kept one leads to it. The adjacency lists of
all shards are united. Each vector then searches its home shard: greedily from
the medoid, and from what it finds within the range it expands until nothing
new is in range. What is in range is verified in double precision.

Equal vectors are one vertex with a weight, so copies are never paired. Shards
beyond ``SHARD`` rows are split by hash; a search then visits all their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from .components import connected_components

SHARD = 2000
# Pivots of all labels, and rows that show how vectors spread: tables of fixed size.
PIVOTS = 4096
# Pivots drawn for the rows of a shard: near copies of a row make it several times as large.
PER_SHARD = 8
# Standard deviations of a step within range, seen along one direction, that dealing allows for.
SIGMAS = 3.0
# Angles of the range between two pivots: a group within range of each other has one.
APART = 4
# Cosines with pivots that are handled at once.
CHUNK = 1 << 17
DEGREE, CANDIDATES, BEAM, ALPHA = 24, 48, 48, 1.2
# Rows this far below the range still lead on while expanding.
SLACK = 0.02


def robust_prune(near: np.ndarray, cosine: np.ndarray, own: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE):
    """Neighbours to keep of ``near`` (nearest first), given the vectors' cosines.

    A candidate goes when a kept one is nearer to it than ``1 / alpha`` of its
    distance to the vector. Places left over go to the nearest that went.
    """
    distance = np.sqrt(np.maximum(2 - 2 * own[near], 0))
    between = np.sqrt(np.maximum(2 - 2 * cosine[np.ix_(near, near)], 0))
    alive, kept = np.ones(len(near), bool), []
    for i in range(len(near)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * between[i] > distance
    rest = [i for i in range(len(near)) if i not in set(kept)]
    return near[np.array(kept + rest[: degree - len(kept)], int)]


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of the rows of ``x`` (unit vectors): pruned lists, made mutual."""
    if len(x) < 2:
        return [np.zeros(0, int) for _ in x]
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    k = min(CANDIDATES, len(x) - 1)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    lists: list[set[int]] = [set() for _ in x]
    for i, row in enumerate(near):
        row = row[np.argsort(-cosine[i, row], kind="stable")]
        for j in robust_prune(row, cosine, cosine[i]):
            lists[i].add(int(j))
            lists[j].add(i)
    return [np.array(sorted(s), int) for s in lists]


def search(x: np.ndarray, graph: list[np.ndarray], medoid: int, query: np.ndarray, least: float) -> np.ndarray:
    """Rows with a cosine of at least ``least``: greedy search, then range expansion."""
    seen = np.zeros(len(x), bool)
    seen[medoid] = True
    pool, score = np.array([medoid]), np.array([x[medoid] @ query])
    done: set[int] = set()
    while True:
        ready = next((int(p) for p in pool if int(p) not in done), None)
        if ready is None:
            break
        done.add(ready)
        new = graph[ready][~seen[graph[ready]]]
        if len(new):
            seen[new] = True
            pool, score = np.r_[pool, new], np.r_[score, x[new] @ query]
            order = np.argsort(-score, kind="stable")[:BEAM]
            pool, score = pool[order], score[order]
    found, front = [], pool[score >= least - SLACK]
    taken = np.zeros(len(x), bool)
    taken[front] = True
    while len(front):
        found.append(front)
        new = np.unique(np.concatenate([graph[i] for i in front]))
        new = new[~taken[new]]
        front = new[x[new] @ query >= least - SLACK]
        taken[front] = True
    hits = np.concatenate(found) if found else np.zeros(0, int)
    # A product of one row at a time, as exact as the sum of its doubles.
    return hits[np.einsum("ij,j->i", x[hits], query) >= least]


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    # Scale first: squares of the largest doubles would overflow.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vertices(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """One row for each different usable vector of a label: ``(v, label, x, w)``."""
    fits = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(
        "x", lambda e: e != 0
    )
    named = rows.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).alias("label")
    )
    named = named.where(F.col("label").isNotNull() & F.col("id").isNotNull() & fits)
    # Vectors of different lengths have no cosine: they are compared apart.
    return named.groupBy("label", "x").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("w"))


def apart(x: np.ndarray, angle: float) -> np.ndarray:
    """The rows of ``x`` (unit vectors), in order, that are more than ``angle`` from every row kept before."""
    kept, free = [], np.ones(len(x), bool)
    for i in range(len(x)):
        if free[i]:
            kept.append(i)
            free &= x @ x[i] < np.cos(min(angle, np.pi))
    return x[kept]


def directions(groups: list[np.ndarray]) -> float:
    """How many directions the rows of ``groups`` spread over, each about its own mean.

    That is the squared sum of the variances over the sum of their squares: the
    dimension where all directions count alike, and one where there is but one.
    """
    centred = np.concatenate([g - g.mean(0) for g in groups])
    spread = centred.T @ centred
    squares = float((spread * spread).sum())
    return float(np.trace(spread)) ** 2 / squares if squares > 0 else 1.0


def homes(x: np.ndarray, pivots: np.ndarray, angle: float, reach: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot, and which pivots can be nearest to a vector within ``angle`` of it.

    Such a vector lies on the pivot's side of the plane between the two pivots,
    so the row is at most ``angle`` away from that plane. With ``reach`` below 1
    a step of ``angle`` is taken to go that share of its length towards the
    plane at most, as steps in many directions do.
    """
    cosine = x @ pivots.T
    home = cosine.argmax(1)
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    ahead = cosine[np.arange(len(x)), home][:, None] - cosine
    return home, ahead <= reach * np.sin(min(angle, np.pi / 2)) * gap + 1e-9


def _deal(vertices: DataFrame, least: float) -> DataFrame:
    """Vertices with shard and rank, the home shard at rank 0 and others they can be met from at 1.

    A pair is met unless its step goes more than ``SIGMAS`` standard deviations
    of a step in any of the directions vectors spread over towards a plane; where
    they spread over nine or fewer, no pair is lost here.
    """
    spark = vertices.sparkSession
    total = vertices.count()
    share = min(1.0, PIVOTS / max(total, 1))
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    drawn = vertices.where(place < F.lit(int(share * (1 << 30)))).orderBy(F.xxhash64("v")).limit(PIVOTS)
    drawn = drawn.select("label", "x", (place < F.lit(int(min(share, PER_SHARD / SHARD) * (1 << 30)))).alias("pivot"))
    drawn = drawn.toArrow()
    shown: dict = {}
    pivots: dict = {}
    for name, x, pivot in zip(*(drawn[c].to_pylist() for c in ("label", "x", "pivot"))):
        shown.setdefault(len(x), {}).setdefault(name, []).append(x)
        if pivot:
            pivots.setdefault((name, len(x)), []).append(x)
    over = {d: directions([_unit(v) for v in groups.values()]) for d, groups in shown.items()}
    reach = {d: min(1.0, SIGMAS / np.sqrt(max(n, 1.0))) for d, n in over.items()}
    angle = float(np.arccos(np.clip(least, -1, 1)))
    sent = spark.sparkContext.broadcast({k: apart(_unit(v), APART * angle) for k, v in pivots.items()})
    chunk = CHUNK

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict = {}
            for i, (name, x) in enumerate(zip(batch["label"].to_pylist(), batch["x"].to_pylist())):
                groups.setdefault((name, len(x)), []).append((i, x))
            for group, members in groups.items():
                centres = sent.value.get(group)
                step = max(chunk // (1 if centres is None else len(centres)), 1)
                for at in range(0, len(members), step):
                    part = members[at : at + step]
                    rows = np.array([i for i, _ in part])
                    if centres is None:
                        home, meets = np.zeros(len(part), int), np.ones((len(part), 1), bool)
                    else:
                        home, meets = homes(_unit([x for _, x in part]), centres, angle, reach[group[1]])
                    row, shard = np.nonzero(meets)
                    dealt = batch.take(pa.array(rows[row], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*dealt.columns, pa.array(shard, pa.int32()), pa.array(shard != home[row]).cast(pa.int32())],
                        [*batch.schema.names, "shard", "rank"],
                    )

    kind = vertices.schema["label"].dataType.simpleString()
    rows = vertices.select("label", "x", "v", "w")
    dealt = rows.mapInArrow(near, f"label {kind}, x array<double>, v long, w long, shard int, rank int")
    dealt = stage(dealt.withColumn("d", F.size("x")), "dealt")
    counts = dealt.groupBy("label", "d", "shard").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(SHARD)).cast("int")
    return dealt.join(counts, ["label", "d", "shard"]).withColumn("parts", parts).drop("n")


_GROUP = ["label", "d", "shard", "part", "block"]


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row.

    Rows link where labels are equal and not null and the cosine is at least
    ``least``. Null, empty or zero vectors, those with null or non-finite
    components, and null labels link with nothing. Rows with equal keys are one
    vertex each by their vector; a null key has a null component.
    """
    vertices = stage(_vertices(rows, key, vector, label), "vertices")
    dealt = _deal(vertices, least)
    own = F.pmod(F.xxhash64("v", F.lit("part")), F.col("parts")).cast("int")
    members = stage(dealt.withColumn("part", own).withColumn("block", F.lit(0)), "members")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        graph = build_graph(_unit(frame["x"]))
        names = frame["v"].to_numpy()
        return pd.DataFrame({"v": names, "near": [names[g].tolist() for g in graph]})

    lists = members.groupBy(*_GROUP).applyInPandas(build, "v long, near array<long>")
    # A vertex has a list from each of its shards.
    union = lists.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    union = stage(union, "graph")

    blocks = F.ceil(F.col("n") / F.lit(SHARD)).cast("int")
    home = members.where(F.col("rank") == 0)
    sizes = home.groupBy("label", "d", "shard").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("label", "d", "shard", blocks.alias("blocks"))
    index = members.drop("block", "rank").join(union, "v").join(sizes, ["label", "d", "shard"])
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = home.drop("part", "block").join(sizes, ["label", "d", "shard"])
    asked = asked.withColumn("block", F.pmod(F.xxhash64("v", F.lit("block")), F.col("blocks")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.withColumn("near", F.lit(None).cast("array<long>"))
    columns = [*_GROUP, "v", "w", "x", "near"]

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        held = frame[frame["near"].notna()].reset_index(drop=True)
        want = frame[frame["near"].isna()]
        if held.empty:
            return pd.DataFrame({"v": want["v"], "links": 0, "other": None})
        x, names, weight = _unit(held["x"]), held["v"].to_numpy(), held["w"].to_numpy()
        at = {int(v): i for i, v in enumerate(names)}
        graph = [np.array([at[int(u)] for u in near if int(u) in at], int) for near in held["near"]]
        medoid = int((x @ x.sum(0)).argmax())
        # Which part of the graph a row is in; searches start in each, so none is lost.
        starts, reached = [], np.zeros(len(x), bool)
        for first in [medoid, *range(len(x))]:
            if not reached[first]:
                starts.append(first)
                reached[first] = True
                stack = [first]
                while stack:
                    new = graph[stack.pop()]
                    new = new[~reached[new]]
                    reached[new] = True
                    stack.extend(new.tolist())
        parent = {}

        def root(v: int) -> int:
            while parent.get(v, v) != v:
                parent[v] = v = parent.get(parent[v], parent[v])
            return v

        out = []
        for v, q in zip(want["v"].to_numpy(), _unit(want["x"])):
            hits = np.unique(np.concatenate([search(x, graph, s, q, least) for s in starts]))
            hits = hits[names[hits] != v]
            # Of the links, a spanning forest is enough for components.
            links = int(weight[hits].sum())
            first = len(out)
            for u in names[hits].tolist():
                a, b = root(int(v)), root(int(u))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(v), 0, int(u)))
            if len(out) == first:
                out.append((int(v), links, None))
            else:
                out[first] = (out[first][0], links, out[first][2])
        return pd.DataFrame(out, columns=["v", "links", "other"]).astype({"other": "Int64"})

    met = index.select(*columns).unionByName(asked.select(*columns)).groupBy(*_GROUP)
    found = stage(met.applyInPandas(look, "v long, links long, other long"), "links")
    counts = found.groupBy("v").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("other").isNotNull()).select(F.col("v").alias("a"), F.col("other").alias("b"))
    joined = connected_components(edges)

    facts = vertices.join(counts, "v", "left").join(joined, "v", "left").select(
        F.col("label").alias("_label"),
        F.col("x").alias("_x"),
        (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "v").alias("component_id"),
    )
    named = rows.select(
        F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).alias("label")
    )
    met = named.join(facts, (F.col("x") == F.col("_x")) & (F.col("label") == F.col("_label")), "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return met.select(
        F.col("_id").alias(key),
        F.when(F.col("_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )


def audit_recall(rows: DataFrame, found: DataFrame, sample: int = 200, key="vec_id", vector="embedding", label="label", least=0.98) -> float:
    """Links found of ``sample`` keys over all their links, counted by brute force.

    The sampled vectors, a bounded table, are compared with every row in blocks.
    """
    vertices = _vertices(rows, key, vector, label)
    drawn = vertices.orderBy(F.xxhash64("v"), "v").limit(sample).select("v", "label", "x").toArrow().to_pylist()
    if not drawn:
        return 1.0
    sent = rows.sparkSession.sparkContext.broadcast([(r["v"], r["label"], _unit([r["x"]])[0]) for r in drawn])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for batch in batches:
            groups: dict = {}
            for name, x, w in zip(batch["label"].to_pylist(), batch["x"].to_pylist(), batch["w"].to_pylist()):
                groups.setdefault((name, len(x)), []).append((x, w))
            for (name, d), members in groups.items():
                x, w = _unit([m[0] for m in members]), np.array([m[1] for m in members])
                for v, other, q in sent.value:
                    if other == name and len(q) == d:
                        totals[v] = totals.get(v, 0) + int(w[np.einsum("ij,j->i", x, q) >= least].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], ["v", "n"])

    true = vertices.select("label", "x", "w").mapInArrow(count, "v long, n long").groupBy("v").agg((F.sum("n") - 1).alias("n"))
    met = true.join(found.select(F.col(key).alias("v"), "n_links"), "v")
    total = met.agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("k")).first()
    return 1.0 if not total["n"] else total["k"] / total["n"]
