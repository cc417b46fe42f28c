"""Exact embedding near-dedup by dual traversal of cover trees.

Unit vectors are at distance sqrt(2 - 2 cos), so cosine >= t means distance <= tau.
The top of the tree are centres from a bounded sample; every vector goes to its nearest
centre, and each cell becomes nodes of bounded size. Below, each node has nested nets
with halving radii: every net keeps the centres of the one above, and each centre has
its covering radius, the largest distance to a vector under it. Two subtrees further
apart than their covering radii plus tau hold no pair and are pruned; what is left is
compared in double precision. All pairs of nodes are looked at, so nothing is missed
whatever the sample was.

Equal vectors are one row with a count. Of the pairs found, each task returns the link
count of each vector and a spanning forest of the links, so that a large group of near
copies isn't written out as pairs.

Nodes meet in two steps. First their tops alone (a centre and a radius each) are compared,
in blocks, and a pair further apart than its radii plus tau is pruned. Then the vectors of
what is left go to the cells of a grid of node groups, each to as many cells as hold a
partner for it; a task compares the nodes of two groups, so that a node is sent once for a
group of partners, not once for each. With vectors that are all about equally far from
each other no bound prunes anything, and the work is that of all pairs.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .graph import connected_components

#: Added to pruning bounds, which are computed in single precision: a distance is off by
#: less than 3e-3 near 0 and by far less elsewhere.
SLACK = 5e-3
#: Most nodes of a group, and most bytes of their vectors as single floats: a task holds two groups.
GROUP, GROUP_BYTES = 32, 16 << 20
#: Tops of nodes that are compared at a time with as many others.
BLOCK = 4096


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit rows."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Node:
    """A subtree: nets of centres (indices of rows), for each centre its parent in the net above and its covering radius."""

    def __init__(self, rows: np.ndarray, smallest: float, nets: list | None = None):
        self.rows, self.fast = rows, rows.astype(np.float32)
        if nets is not None:
            self.nets = nets
            return
        n = len(rows)
        root_d = distances(rows[:1], rows)[0]
        group = np.zeros(n, np.int64)  # of each row: its centre's position in the net
        self.nets = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([root_d.max()]))]
        radius = root_d.max() / 2
        while radius > smallest and len(self.nets[-1][0]) < n:
            centres, parents, cover = [], [], []
            below = np.empty(n, np.int64)
            order = np.argsort(group, kind="stable")
            for g, members in enumerate(np.split(order, np.flatnonzero(np.diff(group[order])) + 1)):
                first = self.nets[-1][0][g]
                todo = members
                centre = first
                while len(todo):
                    d = distances(rows[centre : centre + 1], rows[todo])[0] if len(todo) > 1 else np.zeros(1)
                    near = d <= radius
                    near[todo == centre] = True
                    below[todo[near]] = len(centres)
                    centres.append(centre), parents.append(g), cover.append(d[near].max())
                    todo = todo[~near]
                    centre = todo[0] if len(todo) else None
            self.nets.append((np.array(centres), np.array(parents), np.array(cover)))
            group, radius = below, radius / 2
        centres, parents, cover = self.nets[-1]
        if len(centres) == n and not cover.any():  # every row is a centre already
            self.nets.pop()
            group = parents[np.argsort(centres)]
        self.nets.append((np.arange(n), group, np.zeros(n)))


def close_pairs(a: Node, b: Node, tau: float) -> np.ndarray | None:
    """A mask of pairs of rows that the bounds leave open; None if there are none."""
    depth = max(len(a.nets), len(b.nets))
    open_ = np.ones((1, 1), bool)
    for level in range(depth):
        (ca, up_a, ra), (cb, up_b, rb) = (x.nets[min(level, len(x.nets) - 1)] for x in (a, b))
        if level:  # children of what is open
            open_ = open_[up_a if level < len(a.nets) else np.arange(len(ca))][:, up_b if level < len(b.nets) else np.arange(len(cb))]
        ia, ib = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(ia):
            return None
        # d <= bound, as 1 - bound ** 2 / 2 <= cosine
        near = a.fast[ca[ia]] @ b.fast[cb[ib]].T
        if ra[ia].any() or rb[ib].any():
            bound = (ra[ia].astype(np.float32) + np.float32(tau + SLACK))[:, None] + rb[ib].astype(np.float32)[None, :]
            np.square(bound, out=bound)
            near *= 2
            near += bound
            part = near >= 2
        else:
            part = near >= np.float32(1 - (tau + SLACK) ** 2 / 2)
        if part.shape == open_.shape:
            open_ = part if open_.all() else open_ & part
            continue
        part &= open_[np.ix_(ia, ib)]
        open_ = np.zeros_like(open_)
        open_[np.ix_(ia, ib)] = part
    return open_ if open_.any() else None


def linked(a: Node, b: Node, threshold: float, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a and b with cosine >= threshold."""
    mask = close_pairs(a, b, tau)
    if mask is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if np.count_nonzero(mask) * 16 > mask.size:
        return np.nonzero(mask & (a.rows @ b.rows.T >= threshold))
    i, j = np.nonzero(mask)
    keep = np.empty(len(i), bool)
    for k in range(0, len(i), 100_000):
        keep[k : k + 100_000] = (a.rows[i[k : k + 100_000]] * b.rows[j[k : k + 100_000]]).sum(axis=1) >= threshold
    return i[keep], j[keep]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: from each of these to the smallest that it is connected to."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(names))
    while len(i):
        x, y = low[i], low[j]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, low[low]):
            low = low[low]
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
    own = np.flatnonzero(low != np.arange(len(names)))
    return names[own], names[low[own]]


def _open_cells(a: tuple, b: tuple, tau: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b: (numbers, groups in order, centres, radii) of nodes. Of each pair that the
    bounds leave open: the lower and the higher group and a node, without repeats."""
    out = []
    for k in range(0, len(a[0]), 512):
        near = 2 * (a[2][k : k + 512] @ b[2].T) + np.square(a[3][k : k + 512, None] + b[3][None, :] + tau + SLACK) >= 2
        for (no, group, _, _), (_, other, _, _), mask in ((tuple(x[k : k + 512] for x in a), b, near), (b, tuple(x[k : k + 512] for x in a), near.T)):
            first = np.flatnonzero(np.concatenate(([True], other[1:] != other[:-1])))
            i, g = np.nonzero(np.logical_or.reduceat(mask, first, axis=1))
            out.append(np.stack((np.minimum(group[i], other[first][g]), np.maximum(group[i], other[first][g]), no[i])))
            if same:
                break
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, node_size: int = 2048, sample: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links all pairs with cosine >= threshold. Returns vec_id, n_links, component_id
    and kept for each input row.

    Null, empty or zero vectors, and those with a null or non-finite component, link
    with nothing and are kept. Vectors of different lengths don't link. Equal vectors
    link with each other. A null id is kept with no links and a null component. Rows that
    share an id are copies if their vectors are equal, and one node of the graph in any
    case. Empty table: no rows. Other columns are ignored.
    sample bounds the vectors that the centres come from; every vector is indexed.
    """
    spark = vectors.sparkSession
    tau = math.sqrt(2 - 2 * threshold)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = written(rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & finite, F.lit(False))), "cover-rows")
    distinct = written(rows.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "cover-distinct")

    # Top of the tree: so many centres of the sample that cells have about one node.
    total = distinct.count()
    head = distinct.orderBy(F.xxhash64("v")).limit(min(sample, max(1, math.ceil(total / node_size)))).select("v").collect()
    centres: dict[int, np.ndarray] = {}
    for n in {len(r["v"]) for r in head}:
        centres[n] = units(np.array([r["v"] for r in head if len(r["v"]) == n]))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            lists = batch.column(0)
            lengths = np.diff(lists.offsets.to_numpy())
            cells = np.zeros(len(lengths), np.int64)
            flat = lists.flatten().to_numpy()
            offsets = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x = units(flat[offsets[at][:, None] + np.arange(n)])
                if n in shared.value:
                    cells[at] = (x @ shared.value[n].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int64)), pa.array(cells)], ["v", "rep", "copies", "dim", "cell"])

    placed = written(distinct.mapInArrow(assign, "v array<double>, rep long, copies long, dim long, cell long"), "cover-placed")
    full = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / node_size).alias("parts"))
    nodes = placed.join(full, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))

    def plant(pdf):
        """One row for a node: its vectors, ids and counts as bytes."""
        import pandas as pd

        pdf = pdf.sort_values("rep")
        x = np.stack(pdf["v"].to_numpy())
        nets = Node(units(x), tau / 8).nets
        half = x.astype(np.float32)
        raw = half if np.array_equal(half.astype(np.float64), x) else x  # as it came in: half the bytes for floats
        centre = units(x)[nets[0][0]].tobytes()
        row = {"ids": pdf["rep"].to_numpy(np.int64).tobytes(), "counts": pdf["copies"].to_numpy(np.int64).tobytes(), "x": raw.tobytes(), "nets": pickle.dumps(nets), "centre": centre, "radius": float(nets[0][2][0])}
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1].to_numpy(), "cell": pdf["cell"].iloc[:1].to_numpy(), **{k: [v] for k, v in row.items()}})

    packed = nodes.groupBy("dim", "cell", "part").applyInPandas(plant, "dim long, cell long, ids binary, counts binary, x binary, nets binary, centre binary, radius double")
    packed = written(packed.withColumn("node", F.xxhash64("ids")), "cover-nodes")

    # Tops of nodes, a row each: numbered so that those of a cell are together, in groups and in blocks of groups.
    own = Window.partitionBy("dim")
    tops = packed.select("node", "dim", "centre", "radius", (F.row_number().over(own.orderBy("cell", "node")) - 1).alias("no"), F.count("*").over(own).alias("all"))
    fit = F.greatest(F.lit(1).cast("long"), F.least(F.lit(GROUP), F.floor(F.lit(GROUP_BYTES) / (F.col("dim") * 4 * node_size))))
    each = F.least(fit, F.ceil(F.col("all") / 8))
    tops = tops.withColumn("group", F.floor(F.col("no") / each)).withColumn("block", F.floor(F.col("group") * each / BLOCK)).withColumn("blocks", F.floor(F.col("all") / BLOCK) + 1)
    tops = written(tops, "cover-tops")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = tops.withColumn("other", other).select("dim", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "no", "group", "centre", "radius")

    def prune(pdf):
        import pandas as pd

        sides = []
        for _, side in pdf.sort_values("no").groupby("block"):
            centres = np.stack([np.frombuffer(c, np.float64) for c in side["centre"]])
            sides.append((side["no"].to_numpy(), side["group"].to_numpy(), centres, side["radius"].to_numpy()))
        if len(sides) == 1 and pdf["p"].iloc[0] != pdf["q"].iloc[0]:
            return pd.DataFrame({"dim": [], "p": [], "q": [], "no": []}, dtype="int64")  # the other block is empty
        p, q, no = _open_cells(sides[0], sides[-1], tau, len(sides) == 1)
        return pd.DataFrame({"dim": np.full(len(p), pdf["dim"].iloc[0]), "p": p, "q": q, "no": no})

    cells = written(met.groupBy("dim", "p", "q").applyInPandas(prune, "dim long, p long, q long, no long"), "cover-cells")
    pairs = packed.drop("centre", "radius", "cell", "dim").join(tops.select("node", "dim", "no", "group"), "node").join(cells, ["dim", "no"])

    def compare(pdf):
        import pandas as pd

        def read(r):
            ids = np.frombuffer(r.ids, np.int64)
            x = np.frombuffer(r.x, np.float64 if len(r.x) == 8 * len(ids) * r.dim else np.float32).reshape(-1, r.dim)
            return ids, np.frombuffer(r.counts, np.int64), Node(units(x), 0.0, pickle.loads(r.nets))

        pdf = pdf.sort_values("no")
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        lower = [(r.no, *read(r)) for r in pdf[pdf["group"] == p].itertuples()]
        links: dict[int, np.ndarray] = {}
        ties = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        sizes: dict[int, np.ndarray] = {}
        for no, ids, n, node in lower if p == q else ((r.no, *read(r)) for r in pdf[pdf["group"] == q].itertuples()):
            for before, ids_b, n_b, node_b in lower:
                if p == q and before > no:
                    break
                i, j = linked(node_b, node, threshold, tau)
                if p == q and before == no:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                for at, names, places, weights in ((before, ids_b, i, n[j]), (no, ids, j, n_b[i])):
                    sizes[at] = names
                    links.setdefault(at, np.zeros(len(names), np.int64))
                    np.add.at(links[at], places, weights)
                ties.append(_stars(ids_b[i], ids[j]))
        a, b = _stars(*(np.concatenate(x) for x in zip(*ties, strict=True)))
        some = {at: np.flatnonzero(n) for at, n in links.items()}
        linked_ids = np.concatenate([np.empty(0, np.int64), *(sizes[at][k] for at, k in some.items())])
        counted = np.concatenate([np.empty(0, np.int64), *(links[at][k] for at, k in some.items())])
        return pd.DataFrame({"a": np.concatenate((linked_ids, a)), "b": np.concatenate((np.full(len(linked_ids), -1), b)), "n": np.concatenate((counted, np.zeros(len(a), np.int64)))})

    columns = ["dim", "p", "q", "no", "group", "ids", "counts", "x", "nets"]
    found = pairs.select(columns).groupBy("dim", "p", "q").applyInPandas(compare, "a long, b long, n long")
    found = written(found, "cover-found")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    comps_table = connected_components(found.where("n = 0"), "a", "b", "cover-links")
    comps = comps_table.select(F.col("node").alias("rep"), "component")
    groups = distinct.join(counts, "rep", "left").join(comps, "rep", "left")
    groups = written(groups.select("v", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "cover-groups")
    forget(distinct, placed, packed, tops, cells, found, comps_table)
    groups = groups.withColumnRenamed("v", "w")
    out = rows.join(groups, (rows["v"] == groups["w"]) & rows["ok"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
