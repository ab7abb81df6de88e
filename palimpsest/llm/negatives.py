"""Hard negatives of anchors by cover trees over norm-augmented vectors.

Scores are inner products of vectors of whole numbers. A candidate ``x`` gets one
more component, ``sqrt(M * M - |x| ** 2)``, and an anchor ``q`` a zero there: all
candidates then lie on one sphere, inner products stay as they are, and a ball of
radius ``r`` around ``c`` holds scores from ``q.c - |q| r`` to ``q.c + |q| r`` only.

Rows are dealt to the nearest of at most ``PIVOTS`` pivots, picked far apart from
a sample of at most ``SAMPLE`` rows that fixes where rows go and never what is
found. Rows of a pivot are cut into trees of about ``TREE`` rows. A tree holds
nested nets: each level covers all rows within a radius that shrinks by ``BASE``,
each node knows its farthest row. An anchor first visits the pivot whose rows can
score best, then every other one that its bounds do not exclude. Inside a tree it
goes down level by level, visits leaves best first, and stops where no leaf left
can hold a row of its window above what it has. Leaves are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import stage

PIVOTS, SAMPLE = 4096, 32_768
# Rows of a tree, anchors that search it together.
TREE, BLOCK = 2048, 1024
BASE = 1.5
# A level with more than one node per so many rows is too fine to prune.
LEAST_LEAF = 4
_EXACT = 2.0**53
# Distances on the sphere are roots of differences: exact to this share of its radius.
ROUNDING = 1e-7

_ROW = "id bigint, label bigint, x array<double>"
_NEED = "array<struct<w:int,low:bigint,high:bigint>>"
_TREE = (
    "tree int, ids array<bigint>, labels array<bigint>, x array<double>, norm double, starts array<int>,"
    " levels array<struct<centers:array<int>,parents:array<int>,radii:array<double>>>"
)
_NONE, _ALL = -(2**63), 2**63 - 1


def _matrix(arrays, width: int) -> np.ndarray:
    """Vectors as rows; missing components count as zero."""
    out = np.zeros((len(arrays), width))
    for row, a in zip(out, arrays):
        row[: len(a)] = a
    return out


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    """The component that brings vectors to the sphere of radius ``norm``."""
    return np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))


def _distances(x: np.ndarray, c: np.ndarray, norm: float) -> np.ndarray:
    """Distances on the sphere between the rows of ``x`` and of ``c``."""
    inner = x @ c.T + np.outer(_lift(x, norm), _lift(c, norm))
    return np.sqrt(np.maximum(2 * (norm * norm - inner), 0))


def pick_pivots(x: np.ndarray, norm: float, many: int) -> np.ndarray:
    """Rows of ``x`` that stand far apart, the farthest from those before each time."""
    if not len(x):
        return x
    picked = [0]
    near = _distances(x, x[:1], norm)[:, 0]
    while len(picked) < many and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[picked[-1:]], norm)[:, 0])
    return x[picked]


def build_tree(x: np.ndarray) -> tuple[np.ndarray, float, list[int], list[dict]]:
    """``(order, norm, starts, levels)``: rows by leaf, and nested nets from the root down.

    A level is ``centers`` (rows), ``parents`` (places in the level above) and
    ``radii`` (to the farthest row below). Leaf ``i`` of the last level holds
    ``order[starts[i]:starts[i + 1]]``.
    """
    norm = float(np.sqrt((x * x).sum(axis=1).max()))
    apart = _distances(x, x, norm)
    centers = [int(apart.max(axis=1).argmin())]
    nets = [np.array(centers)]
    reach = float(apart[centers[0]].max()) / BASE
    while reach > 0 and np.isfinite(reach):
        bare = apart[centers].min(axis=0) > reach
        while bare.any() and len(centers) * LEAST_LEAF <= len(x):
            centers.append(int(bare.argmax()))
            bare &= apart[centers[-1]] > reach
        if len(centers) * LEAST_LEAF > len(x):
            break
        if len(centers) > len(nets[-1]):
            nets.append(np.array(centers))
        reach /= BASE
        if reach < 1e-9 * norm:
            break
    of = apart[:, nets[-1]].argmin(axis=1)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(nets[-1]) + 1)).tolist()
    levels: list[dict] = []
    for depth in range(len(nets) - 1, -1, -1):
        net = nets[depth]
        radii = np.zeros(len(net))
        np.maximum.at(radii, of, apart[np.arange(len(x)), net[of]])
        radii += ROUNDING * norm
        up = apart[np.ix_(net, nets[depth - 1])].argmin(axis=1) if depth else np.zeros(len(net), int)
        levels.insert(0, {"centers": net.tolist(), "parents": up.tolist(), "radii": radii.tolist()})
        of = up[of]
    return order, norm, starts, levels


def _scores(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; beyond 2 ** 53 in whole numbers of any size, at most a long."""
    if bound < _EXACT:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array([min(max(s, _NONE), _ALL) for s in whole], np.int64)


def _bounds(inner: np.ndarray, size: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score of anchors (rows) with what lies in balls (columns)."""
    spread = np.outer(size, radii)
    slack = 1e-9 * (1 + np.abs(inner) + spread)
    # Scores end where a long does.
    return np.clip(inner - spread - slack, _NONE, _ALL), np.clip(inner + spread + slack, _NONE, _ALL)


def _alive(low: np.ndarray, high: np.ndarray, needs: list[list]) -> np.ndarray:
    """Which balls may hold a score that an anchor needs. What is no number stays."""
    out = np.zeros(low.shape, bool)
    for j, wanted in enumerate(needs):
        for _, least, most in wanted:
            out[j] |= ~(high[j] < least) & ~(low[j] > most)
    return out


def search_tree(tree: dict, q: np.ndarray, same: bool, label, own, needs: list[list], many: int) -> list[tuple]:
    """``(anchor, window, score, id)``: per window the ``many`` best rows of one tree.

    ``needs`` lists ``(window, least, most)`` of each anchor. ``same`` asks for
    rows of the anchor's label other than itself, else for those of others.
    """
    x, ids, labels = tree["x"], tree["ids"], tree["labels"]
    size = np.sqrt((q * q).sum(axis=1))
    alive = None
    for level in tree["levels"]:
        low, high = _bounds(q @ x[level["centers"]].T, size, level["radii"])
        now = _alive(low, high, needs)
        alive = now if alive is None else now & alive[:, level["parents"]]
    out = []
    for j, wanted in enumerate(needs):
        leaves = np.flatnonzero(alive[j])
        leaves = leaves[np.argsort(-high[j, leaves], kind="stable")]
        best = {w: (np.empty(0, np.int64), np.empty(0, np.int64)) for w, _, _ in wanted}
        least = {w: lo for w, lo, _ in wanted}
        at, step = 0, 1
        while at < len(leaves):
            if all(high[j, leaves[at]] < least[w] for w in least):
                break
            rows = np.concatenate([np.arange(*tree["starts"][i : i + 2]) for i in leaves[at : at + step].tolist()])
            at, step = at + step, step * 2
            fits = (labels[rows] == label[j]) & (ids[rows] != own[j]) if same else labels[rows] != label[j]
            rows = rows[fits]
            scores = _scores(x[rows], q[j], size[j] * tree["norm"])
            for w, _, most in wanted:
                inside = (scores >= least[w]) & (scores <= most)
                s = np.concatenate([best[w][0], scores[inside]])
                i = np.concatenate([best[w][1], ids[rows[inside]]])
                top = np.lexsort((i, -s))[:many]
                best[w] = s[top], i[top]
                if len(top) == many:
                    least[w] = max(least[w], int(s[top[-1]]))
        out += [(j, w, int(s), int(i)) for w in best for s, i in zip(*best[w])]
    return out


class _Places:
    """Pivots with what every row is told by them: a table of fixed size."""

    def __init__(self, pivots: np.ndarray, norm: float, width: int):
        self.pivots, self.norm, self.width = pivots, norm, width
        self.radii = np.zeros(len(pivots))
        self.trees: list[int] = []

    def deal(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            far = _distances(_matrix(rows["x"], self.width), self.pivots, self.norm)
            node = far.argmin(axis=1)
            yield rows.assign(node=node.astype("int32"), far=far[np.arange(len(far)), node])

    def visits(self, first: bool):
        """The trees each anchor visits: of the pivot that can score best for a need, or of all others."""
        firsts = np.concatenate(([0], np.cumsum(self.trees))).astype(int)

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                q = _matrix(rows["x"], self.width)
                low, high = _bounds(q @ self.pivots.T, np.sqrt((q * q).sum(axis=1)), self.radii)
                needs = [[(n["w"], n["low"], n["high"]) for n in ns] for ns in rows["needs"]]
                open_ = _alive(low, high, needs)
                home = np.where(open_, high, -np.inf).argmax(axis=1)
                picked = []
                for j, node in enumerate(home):
                    if first:
                        nodes = [node] if open_[j, node] else []
                    else:
                        nodes = [n for n in np.flatnonzero(open_[j]) if n != rows["home"].iloc[j]]
                    picked.append([t for n in nodes for t in range(firsts[n], firsts[n + 1])])
                yield rows.assign(home=home.astype("int32") if first else rows["home"], trees=picked)

        return choose


def _grow(width: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows["x"], width)
        with np.errstate(all="ignore"):
            order, norm, starts, levels = build_tree(x)
        places = np.empty(len(order), int)
        places[order] = np.arange(len(order))
        for level in levels:
            level["centers"] = places[level["centers"]].tolist()
        data = {
            "tree": [int(rows["tree"].iloc[0])], "ids": [rows["id"].to_numpy()[order]],
            "labels": [rows["label"].to_numpy()[order]], "x": [x[order].ravel()], "norm": [norm],
            "starts": [starts], "levels": [levels],
        }
        return pd.DataFrame(data)

    return grow


def _visit(width: int, same: bool, many: int):
    def visit(anchors: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(trees):
            t = trees.iloc[0]
            levels = [
                {"centers": np.asarray(v["centers"]), "parents": np.asarray(v["parents"]), "radii": np.asarray(v["radii"])}
                for v in t["levels"]
            ]
            tree = {
                "x": np.asarray(t["x"]).reshape(len(t["ids"]), width), "ids": np.asarray(t["ids"]), "norm": t["norm"],
                "labels": np.asarray(t["labels"]), "starts": list(t["starts"]), "levels": levels,
            }
            q, own = _matrix(anchors["x"], width), anchors["id"].to_numpy()
            needs = [[(n["w"], n["low"], n["high"]) for n in ns] for ns in anchors["needs"]]
            with np.errstate(all="ignore"):
                rows = search_tree(tree, q, same, anchors["label"].to_numpy(), own, needs, many)
            found = [(int(own[j]), w, s, i) for j, w, s, i in rows]
        return pd.DataFrame(found, columns=["id", "w", "score", "hit"])

    return visit


def _round(anchors: DataFrame, trees: DataFrame, places: _Places, first: bool, same: bool, many: int, name: str):
    """One visit of anchors to trees: ``(anchors with home, found)``."""
    schema = f"{_ROW}, block int, home int, needs {_NEED}, trees array<int>"
    bound = anchors.mapInPandas(places.visits(first), schema)
    if first:
        bound = stage(bound, f"{name}-visits")
    calls = bound.select("block", F.explode("trees").alias("tree"), "id", "label", "x", "needs")
    wanted = calls.select(F.col("block").alias("for_block"), "tree").distinct().join(trees, "tree")
    wanted = wanted.withColumnRenamed("tree", "for_tree")
    found = (
        calls.groupBy("block", "tree")
        .cogroup(wanted.groupBy("for_block", "for_tree"))
        .applyInPandas(_visit(places.width, same, many), "id bigint, w int, score bigint, hit bigint")
    )
    return bound.drop("trees"), stage(found, f"{name}-found")


def _best(found: DataFrame, many: int) -> DataFrame:
    order = Window.partitionBy("id", "w").orderBy(F.desc("score"), "hit")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def _search(anchors: DataFrame, trees: DataFrame, places: _Places, same: bool, many: int, name: str) -> DataFrame:
    """The ``many`` best rows of each window, over all trees that bounds leave."""
    homed, near = _round(anchors, trees, places, True, same, many, name)
    # What the first visit found raises the least score that still matters.
    full = _best(near, many).where(F.col("rank") == many)
    told = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("told"))

    def raise_(n: Column) -> Column:
        least = F.coalesce(F.greatest(F.element_at("told", n["w"]), n["low"]), n["low"])
        return n.withField("low", least)

    raised = homed.join(told, "id", "left").withColumn("needs", F.transform("needs", raise_)).select(*homed.columns)
    _, rest = _round(raised, trees, places, False, same, many, name)
    return _best(near.unionByName(rest), many)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Negatives of each anchor and positive, best first, from a window of scores.

    ``rows`` has an integer key, an integer label and vectors of whole numbers
    (as doubles); ``anchor`` is a condition on them. Positives of an anchor are
    its best ``positives`` rows of the same label and another key; negatives are
    the best ``negatives`` rows of another label whose score is from ``low`` to
    ``high`` percent of the positive's. Scores are exact (beyond a long, the
    last long); equal scores come by key, smallest first.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``; a pair without a negative has no row. Rows with a null key,
    label or vector, or a component that is null or not finite, take no part. A
    shorter vector counts as filled up with zeros. Repeated rows are rows of
    their own as candidates; a repeated anchor counts once, by its least label
    and vector. Empty tables give no rows; other columns are not read.
    """
    spark = rows.sparkSession
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    fit = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))
    base = rows.where(fit).select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), x.alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    told = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.sqrt(F.max(square)).alias("norm")).first()
    n, width, norm = told["n"], max(1, told["width"] or 0), told["norm"] or 0.0
    many = min(PIVOTS, -(-n // TREE))
    # At most SAMPLE rows come to the driver, by the hash of their key.
    some = base.select("x", F.xxhash64("id").alias("h")).orderBy("h").limit(min(SAMPLE, 8 * many)).toArrow()
    with np.errstate(all="ignore"):
        pivots = pick_pivots(_matrix(some["x"].to_pylist(), width), norm, many)
    if not len(pivots):
        pivots = np.zeros((1, width))
    places = _Places(pivots, norm, width)
    dealt = stage(base.mapInPandas(places.deal, f"{_ROW}, anchor boolean, node int, far double"), "negatives-dealt")
    # One row for each pivot and for each pivot's anchors.
    nodes = dealt.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.count_if("anchor").alias("anchors")
    ).toPandas().set_index("node")
    every = nodes.reindex(range(len(pivots)), fill_value=0)
    places.radii = every["far"].to_numpy(float) + ROUNDING * norm
    places.trees = (-(-every["n"] // TREE)).astype(int).tolist()
    # Blocks of about BLOCK anchors of pivots in a row; those of one pivot with more are cut by hash.
    cuts, base_, filled = [], 0, 0
    first_tree = np.concatenate(([0], np.cumsum(places.trees)))
    for node, c in enumerate(every["anchors"].astype(int).tolist()):
        parts = max(1, -(-c // BLOCK))
        if filled and filled + c > BLOCK:
            base_, filled = base_ + 1, 0
        cuts.append((node, int(first_tree[node]), max(1, places.trees[node]), base_, parts))
        base_, filled = (base_ + parts, 0) if parts > 1 else (base_, filled + c)
    cut = F.broadcast(spark.createDataFrame(cuts, "node int, first int, trees int, block int, parts int"))
    # Rows are read from files: their numbers do not change when a task is run again.
    spread = F.xxhash64(F.monotonically_increasing_id())
    grown = dealt.withColumn("_spread", spread).join(cut, "node")
    grown = grown.select("id", "label", "x", (F.col("first") + F.pmod("_spread", F.col("trees"))).cast("int").alias("tree"))
    trees = stage(grown.groupBy("tree").applyInPandas(_grow(width), _TREE), "negatives-trees")
    least = F.min(F.struct("label", "x", "node")).alias("a")
    own = dealt.where("anchor").groupBy("id").agg(least).select("id", "a.*").join(cut, "node")
    block = (F.col("block") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(_NONE).alias("low"), F.lit(_ALL).alias("high"))).cast(_NEED)
    asked = stage(own.select("id", "label", "x", block.alias("block"), F.col("node").alias("home"), whole.alias("needs")), "anchors")
    pairs = stage(_search(asked, trees, places, True, positives, "positives"), "positives")
    share = lambda p, up: F.call_function(
        "div", F.col("score").cast("decimal(20,0)") * F.lit(p) + F.lit(up), F.lit(100).cast("decimal(3,0)")
    ).cast("bigint")
    window = F.struct((F.col("rank") - 1).alias("w"), share(low, 99).alias("low"), share(high, 0).alias("high"))
    # Below a score of zero the window is empty.
    windows = pairs.where(F.col("score") >= 0).groupBy("id").agg(F.collect_list(window).cast(_NEED).alias("needs"))
    found = _search(asked.drop("needs").join(windows, "id"), trees, places, False, negatives, "negatives")
    named = pairs.select(
        "id", (F.col("rank") - 1).alias("w"), F.col("hit").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return found.join(named, ["id", "w"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("hit").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def scaled(rows: DataFrame, vector: str = "embedding", by: int = 256) -> DataFrame:
    """``rows`` with each component times ``by``, rounded down, as a double."""

    def whole(x: Column) -> Column:
        value = x.cast("double") * by
        # From 2 ** 52 on doubles are whole.
        return F.when(F.abs(value) < 2.0**52, F.floor(value).cast("double")).otherwise(value)

    return rows.withColumn(vector, F.transform(vector, whole))
