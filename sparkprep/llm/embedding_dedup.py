"""Near-duplicate vectors within labels: tiles compared in the order of principal components.

Equal vectors of a label are one class. Classes are normalised and sorted by (label, first principal coordinate) over all
tasks, and cut into tiles. Two unit vectors with cosine t are at most ``sqrt(2 - 2 t)`` apart in every coordinate, so only
tiles of one label whose ranges come that near are paired. A pair of tiles is compared on the leading principal coordinates
first: the products so far plus the product of the remaining norms bound the cosine from above, and pairs that cannot reach
the threshold are dropped before the next coordinates are added. What is left is decided by the cosine of the vectors as
they are, in double precision. A pair of tiles gives the number of links of each vector and a spanning forest of the
links, never all links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.graph import components
from sparkprep.session import cut

TILE = 2048
PAIRS_IN_TASK = 8
_ROWS = 256
_SPARSE = 0.05


def link_tile(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float, same: bool):
    """Places (i, j) of all pairs with cosine at or above ``threshold``; in one tile, those with i < j."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ra, rb = (a / na[:, None]) @ turn, (b / nb[:, None]) @ turn
    dims = ra.shape[1]
    steps = [0]
    while steps[-1] < dims:
        steps.append(min(dims, max(8, 2 * steps[-1])))
    tail = lambda r: [np.sqrt(np.maximum((r[:, s:] ** 2).sum(axis=1), 0)) for s in steps]
    ta, tb = tail(ra), tail(rb)
    low = threshold - 1e-9
    for first in range(0, len(a), _ROWS):
        rows = np.arange(first, min(first + _ROWS, len(a)))
        total, i, j = np.zeros((len(rows), len(b))), None, None
        for k in range(len(steps) - 1):
            s, e = steps[k], steps[k + 1]
            if i is None:
                total += ra[rows, s:e] @ rb[:, s:e].T
                alive = total + np.outer(ta[k + 1][rows], tb[k + 1]) >= low
                if same:
                    alive &= np.arange(len(b)) > rows[:, None]
                if alive.mean() <= _SPARSE or k == len(steps) - 2:
                    x, j = np.nonzero(alive)
                    i, sums = rows[x], total[x, j]
            else:
                keep = np.zeros(len(i), bool)
                for p in range(0, len(i), 100_000):
                    q = slice(p, p + 100_000)
                    sums[q] += np.einsum("ij,ij->i", ra[i[q], s:e], rb[j[q], s:e])
                    keep[q] = sums[q] + ta[k + 1][i[q]] * tb[k + 1][j[q]] >= low
                i, j, sums = i[keep], j[keep], sums[keep]
        if i is None:
            continue
        for p in range(0, len(i), 100_000):
            q = slice(p, p + 100_000)
            exact = np.einsum("ij,ij->i", a[i[q]], b[j[q]]) / (na[i[q]] * nb[j[q]]) >= threshold
            yield i[q][exact], j[q][exact]


def _join_up(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give linked places the least place of their set, in ``label``."""
    while len(u):
        # Links between sets, by the sets' least places, until every link is inside a set.
        for _ in range(64):
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        lu, lv = label[u], label[v]
        open_ = lu != lv
        u, v = u[open_], v[open_]
        np.minimum.at(label, np.maximum(lu[open_], lv[open_]), np.minimum(lu[open_], lv[open_]))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other rows linked directly, copies too; ``component_id`` is the smallest id reachable by links,
    itself included. Null labels, null or zero vectors, and vectors with null or non-finite numbers link with nothing, and
    neither do vectors of different lengths. Ids should be unique; rows with a null id are linked and counted, and their
    component is the smallest id that is not null. Other columns are not looked at.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", "label", "v", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)).alias("ok"))
    rows = rows.select("id", "ok", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", "v")), 256)).alias("key"), "label", "v")
    classes = rows.where("ok").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    # Classes get numbers of their own: an id may be null.
    classes = cut(classes.select(F.xxhash64("key").alias("node"), "key", "id", "n", F.col("label").cast("string").alias("label"), F.size("v").alias("dim"), "v"), "classes")

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in _by_length(b.column(0)):
                x = x / np.linalg.norm(x, axis=1)[:, None]
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["d", "cell", "m"])

    turns = {}
    found = classes.select("v").mapInArrow(moments, "d int, cell long, m double").groupBy("d", "cell").agg(F.sum("m").alias("m")).collect()
    for d in {r["d"] for r in found}:  # squares of the vectors' lengths: they do not grow with the data
        m = np.zeros(d * d)
        for r in found:
            if r["d"] == d:
                m[r["cell"]] = r["m"]
        values, axes = np.linalg.eigh(m.reshape(d, d))
        turns[d] = np.ascontiguousarray(axes[:, np.argsort(-values)])
    lead = F.lit(0.0)
    for d, t in turns.items():
        axis = F.array(*[F.lit(float(x)) for x in t[:, 0]])
        lead = F.when(F.col("dim") == d, F.aggregate(F.zip_with("v", axis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).otherwise(lead)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    count = classes.count()
    parts = max(1, -(-count // tile))

    def lay(batches):
        part, number, held = TaskContext.get().partitionId() << 32, 0, []

        def close(ids, counts, x, first):
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part + number]), pa.array([first[0]]), pa.array([first[1]], pa.int32()), pa.array([first[2]]), pa.array([first[3]]),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([x.astype("<f8").tobytes()])],
                ["tile", "label", "dim", "low", "high", "nodes", "counts", "data"])

        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)):
                if held and (len(held) == tile or held[0][2:4] != row[2:4]):
                    yield close([r[0] for r in held], [r[1] for r in held], np.array([r[5].values.to_numpy() for r in held]), (held[0][2], held[0][3], held[0][4], held[-1][4]))
                    held = []
                held.append(row)
        if held:
            yield close([r[0] for r in held], [r[1] for r in held], np.array([r[5].values.to_numpy() for r in held]), (held[0][2], held[0][3], held[0][4], held[-1][4]))

    order = ["label", "dim", "lead", "node"]
    tiles = cut(
        classes.select("node", "n", "label", "dim", F.when(norm > 0, lead / norm).otherwise(0.0).alias("lead"), "v")
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(lay, "tile long, label string, dim int, low double, high double, nodes array<long>, counts array<long>, data binary"), "tiles")

    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    width = max(reach, 0.05)
    slot = lambda x: F.floor(x / width).cast("int")
    meta = tiles.select("tile", "label", "dim", "low", "high")
    left = meta.select("tile", "label", "dim", "low", "high", F.explode(F.sequence(slot(F.col("low") - reach), slot(F.col("high") + reach))).alias("slot"))
    right = meta.select(F.col("tile").alias("other"), "label", "dim", F.col("low").alias("low2"), F.col("high").alias("high2"),
                        F.explode(F.sequence(slot(F.col("low")), slot(F.col("high")))).alias("slot"))
    near = left.join(right, ["label", "dim", "slot"]).where(
        (F.col("tile") <= F.col("other")) & (F.col("low2") <= F.col("high") + reach) & (F.col("low") <= F.col("high2") + reach))
    near = cut(near.select("tile", "other").distinct(), "pairs")
    one = tiles.select("tile", "dim", F.struct("nodes", "counts", "data").alias("x"))
    two = tiles.select(F.col("tile").alias("other"), F.struct("nodes", "counts", "data").alias("y"))
    # A few pairs of tiles in a task: each takes a fixed amount of memory and work.
    pairs = near.join(one, "tile").join(two, "other").select("tile", "other", "dim", "x", "y").repartition(max(1, -(-near.count() // PAIRS_IN_TASK)))

    def compare(batches):
        for b in batches:
            for k in range(b.num_rows):
                first, second, dim = (b.column(c)[k].as_py() for c in range(3))
                x, y = b.column(3)[k], b.column(4)[k]
                same = first == second
                read = lambda s: (s["nodes"].values.to_numpy(), s["counts"].values.to_numpy(), np.frombuffer(s["data"].as_buffer(), "<f8").reshape(-1, dim))  # noqa: E731, B023
                (nodes_x, counts_x, vx), (nodes_y, counts_y, vy) = read(x), read(y)
                shift = 0 if same else len(nodes_x)
                nodes = nodes_x if same else np.concatenate((nodes_x, nodes_y))
                links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                for i, j in link_tile(vx, vy, turns[dim], threshold, same):
                    np.add.at(links, i, counts_y[j])
                    np.add.at(links, j + shift, counts_x[i])
                    _join_up(label, i, j + shift)
                for _ in range(64):
                    label = label[label]
                some, tree = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((nodes[some], nodes[tree]))),
                     pa.array(np.concatenate((nodes[some], nodes[label[tree]]))), pa.array(np.concatenate((links[some], np.zeros(len(tree), np.int64))))], ["a", "b", "links"])

    found = cut(pairs.mapInArrow(compare, "a long, b long, links long"), "found")
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    group = components(found.select("a", "b"), "vectors")
    known = classes.select("node", "key", "id", "n").join(degree, "node", "left").join(group, "node", "left")
    known = cut(known.select("key", "id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "known")
    least = known.groupBy("component").agg(F.min("id").alias("least"))
    known = known.join(least, "component").select("key", "n_links", "least")
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _by_length(lists):
    """(length, matrix) for the vectors of each length in an Arrow list array."""
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy()
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0)
    for d in np.unique(sizes):
        at = starts[sizes == d].astype(np.int64)
        yield int(d), flat[at[:, None] + np.arange(d)]
