"""The k nearest other nodes of every node of the Poincaré disk.

Method. Lifted to the hyperboloid, the nearest node is the one of maximum inner product: cosh d(u, v) = -<u, v> with
the Lorentz product. So the search is a maximum inner product search with score-aware quantisation:

1. Of nodes at one position only the k + 1 smallest ids take part in the search: they are all that any list can need of
   it. The lists of the others follow without a search.
2. Cells: a tree that splits the disk by radius and angle is fitted on a sample of about ``SAMPLE`` positions at most, with
   one cell for ``CELL`` positions; *every* position is then assigned by going down the tree. A cell is one task's work. Beyond
   ``MAX_CELLS`` cells (134 million positions) cells grow, and the tree inside them with them.
3. Inside a cell a tree of the same kind has leaves of at most ``LEAF`` positions. In the frame of its leaf (the disk moved so
   that the leaf's centre is the origin) a position is quantised to three four-bit codes. The codebooks minimise an
   anisotropic loss that weighs the residual parallel to the vector ``ETA`` times.
4. A query scans the codes of a leaf with tables of sixteen entries. Every scanned value has a bound of its error; what may be
   among the k best by these bounds, and no other, goes to exact reranking by the distance formula itself.
5. Leaves are probed from the nearest, by the least distance their radii and angles allow, until that exceeds the k-th
   distance so far. So are cells: first the own one, then the nearest other that may hold more, then what is left. Only queries
   near the border of their cell are sent to others.

Accuracy loss: none by construction (steps 4 and 5 prune by bounds alone); recall against brute force is tested.

A node counts once; nodes with null positions or px^2 + py^2 >= 1 take no part. Equal distances go to the smaller id.
With fewer than k other nodes the lists are shorter; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship, written

SAMPLE = 262_144
CELL = 2048
MAX_CELLS = 65_536
#: Cells a task searches one after another; beyond MOST_PARTS tasks they grow instead.
TASK_CELLS = 4
MOST_PARTS = 16_384
LEAF = 256
ETA = 4.0
CODES = 16
#: Positions with more nodes than this, and than a hundred thousandth of all, are joined by broadcast: at most 100,000 positions.
HOT = 10_000
NOBODY = np.iinfo(np.int64).max


def chord(ux, uy, vx, vy):
    """cosh d - 1: what the distances are ordered by."""
    return 2 * ((ux - vx) ** 2 + (uy - vy) ** 2) / ((1 - (ux * ux + uy * uy)) * (1 - (vx * vx + vy * vy)))


def polar(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(radius in the disk, angle)."""
    return np.sqrt(x * x + y * y), np.arctan2(y, x)


def _local(x, y, cx, cy):
    """Lorentz coordinates (t, a, b) in the frame in which (cx, cy) is the origin."""
    z, c = x + 1j * y, cx + 1j * cy
    below = 1 - np.conj(c) * z
    moved = (z - c) / below
    room = (1 - (x * x + y * y)) * (1 - (cx * cx + cy * cy)) / np.abs(below) ** 2
    return (1 + np.abs(moved) ** 2) / room, 2 * moved.real / room, 2 * moved.imag / room


def least_chord(r, angle, box) -> np.ndarray:
    """The least cosh d - 1 between points (r, angle) and boxes (least and greatest radius, least and greatest angle).

    Within the angles of a box the nearest point lies on the same ray; else on one of the two rays that border the box, at the
    foot of the perpendicular or, if the box doesn't reach it, at an end. Lowered by what rounding can amount to.
    """
    low, high, first, last = box
    turn = lambda a: np.abs((a + np.pi) % (2 * np.pi) - np.pi)
    away = np.where((angle >= first) & (angle <= last), 0.0, np.minimum(turn(angle - first), turn(angle - last)))
    whole = 2 * r / (1 + r * r)  # tanh of the distance from the origin
    along = whole * np.maximum(np.cos(away), 0.0)
    turned = np.where(away < np.pi / 2, whole * np.sin(away), 1.0)
    foot = np.clip(along / (1 + np.sqrt(((1 - r) * (1 + r) / (1 + r * r)) ** 2 + turned**2)), low, high)
    own, other = np.maximum((1 - r) * (1 + r), 1e-17), np.maximum((1 - foot) * (1 + foot), 1e-17)
    least = 2 * ((r - foot) ** 2 + 4 * r * foot * np.sin(away / 2) ** 2) / (own * other)
    far = 1 + 4 / (own * other)
    return least - (least * (1e-9 + 1e-15 * (1 / own + 1 / other)) + 1e-13 * np.sqrt(np.maximum(least, 0) * far) + 1e-26 * far)


class Tree:
    """Boxes of radius and angle, split at medians, along the longer side, until a box holds at most ``size`` positions."""

    def __init__(self, r: np.ndarray, angle: np.ndarray, size: int) -> None:
        self.dim, self.value, self.left, self.right, self.leaf = [], [], [], [], []
        self.members: list[np.ndarray] = []
        self._grow(r, angle, size)
        self.dim, self.left, self.right, self.leaf = (np.array(v, dtype=np.int64) for v in (self.dim, self.left, self.right, self.leaf))
        self.value = np.array(self.value)
        self.fit([(r[m].min(initial=2), r[m].max(initial=-1), angle[m].min(initial=4), angle[m].max(initial=-4)) for m in self.members])

    def _node(self) -> int:
        for own, blank in ((self.dim, 0), (self.value, 0.0), (self.left, -1), (self.right, -1), (self.leaf, -1)):
            own.append(blank)
        return len(self.dim) - 1

    def _grow(self, r: np.ndarray, angle: np.ndarray, size: int) -> None:
        depth = np.log1p(r) - np.log(np.maximum(1 - r, 1e-16))  # hyperbolic distance from the origin
        todo = [(self._node(), np.arange(len(r)))]
        while todo:
            node, own = todo.pop()
            if len(own) > size:
                sides = [(np.ptp(depth[own]), 0, r), (np.ptp(angle[own]) * min(np.sinh(min(np.median(depth[own]), 40.0)), 1e15), 1, angle)]
                for _, dim, at in sorted(sides, key=lambda s: -s[0]):
                    value = np.partition(at[own], (len(own) - 1) // 2)[(len(own) - 1) // 2]
                    under = at[own] <= value
                    if under.all():  # the median is the greatest value: split below it
                        under = at[own] < value
                        value = at[own][under].max() if under.any() else value
                    if under.any():
                        self.dim[node], self.value[node] = dim, value
                        self.left[node], self.right[node] = self._node(), self._node()
                        todo += [(self.left[node], own[under]), (self.right[node], own[~under])]
                        break
            if self.left[node] < 0:  # few enough, or all at one place
                self.leaf[node] = len(self.members)
                self.members.append(own)

    def fit(self, boxes: list[tuple[float, float, float, float]]) -> None:
        """Give the leaves their boxes and the nodes the boxes around those."""
        self.box = np.tile([2.0, -1.0, 4.0, -4.0], (len(self.dim), 1))
        self.box[self.leaf >= 0] = np.array(boxes)[self.leaf[self.leaf >= 0]]
        for node in range(len(self.dim) - 1, -1, -1):  # children come behind their parent
            if self.left[node] >= 0:
                a, b = self.box[self.left[node]], self.box[self.right[node]]
                self.box[node] = min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])

    def assign(self, r: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """The leaf of every position."""
        node = np.zeros(len(r), dtype=np.int64)
        while True:
            inner = self.left[node] >= 0
            if not inner.any():
                return self.leaf[node]
            below = np.where(self.dim[node] == 0, r, angle) <= self.value[node]
            node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)

    def within(self, r: np.ndarray, angle: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, least chord) for all leaves that may hold something not beyond a query's bound, going down the tree."""
        query, node = np.arange(len(r)), np.zeros(len(r), dtype=np.int64)
        found = []
        while len(query):
            box = self.box[node]
            least = least_chord(r[query], angle[query], box.T)
            near = (least <= bound[query]) & (box[:, 0] <= box[:, 1])
            query, node, least = query[near], node[near], least[near]
            done = self.left[node] < 0
            found.append((query[done], self.leaf[node[done]], least[done]))
            query, node = query[~done], node[~done]
            query, node = np.concatenate([query, query]), np.concatenate([self.left[node], self.right[node]])
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (query, node, np.zeros(0))


def codebooks(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score-aware quantisation of (n, 3) vectors: (codebooks (3, 16), codes (n, 3), largest residuals (3,)).

    The loss of a residual r of x is |r|^2 + (ETA - 1) (r . x / |x|)^2. Codes and codebooks are improved in turn: each
    coordinate takes the code, and each codebook entry the value, that is best given the other two coordinates.
    """
    n = len(parts)
    ordered = np.sort(parts, axis=0)
    books = ordered[np.minimum(((np.arange(CODES) + 0.5) * n / CODES).astype(np.int64), n - 1)].T.copy()
    unit = parts / np.maximum(np.linalg.norm(parts, axis=1, keepdims=True), 1e-300)
    codes = np.stack([np.argmin(np.abs(parts[:, j, None] - books[j][None]), axis=1) for j in range(3)], axis=1)
    for _ in range(2):
        for j in range(3):
            rest = sum(((parts[:, i] - books[i][codes[:, i]]) * unit[:, i] for i in range(3) if i != j), np.zeros(n))
            residual = parts[:, j, None] - books[j][None]
            loss = residual**2 + (ETA - 1) * (residual * unit[:, j, None] + rest[:, None]) ** 2
            codes[:, j] = np.argmin(loss, axis=1)
            weight = 1 + (ETA - 1) * unit[:, j] ** 2  # the entry's optimum is a weighted mean
            target = parts[:, j] + (ETA - 1) * unit[:, j] * rest / weight
            total = np.bincount(codes[:, j], weights=weight, minlength=CODES)
            books[j] = np.where(total > 0, np.bincount(codes[:, j], weights=weight * target, minlength=CODES) / np.maximum(total, 1e-300), books[j])
    worst = np.array([np.abs(parts[:, j] - books[j][codes[:, j]]).max() for j in range(3)])
    return books, codes, worst


class Leaf:
    """The positions of one leaf, quantised in its frame."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.y, self.ids = x, y, ids
        room = 1 - (x * x + y * y)
        t, a, b = ((1 + x * x + y * y) / room).sum(), (2 * x / room).sum(), (2 * y / room).sum()
        norm = np.sqrt(max(t * t - a * a - b * b, 1e-300))
        self.cx, self.cy = a / (norm + t), b / (norm + t)
        if not self.cx**2 + self.cy**2 < 1 - 1e-15:
            self.cx, self.cy = x[0], y[0]
        parts = np.stack(_local(x, y, self.cx, self.cy), axis=1)
        self.top = float(np.abs(parts).max())
        parts[:, 0] -= 1.0
        self.books, codes, self.worst = codebooks(parts)
        self.packed = codes[:, 0] | codes[:, 1] << 4
        self.third = codes[:, 2]

    def scan(self, x: np.ndarray, y: np.ndarray, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, chord) of all that can be among a query's k + 1 best here and isn't beyond ``most``."""
        t, a, b = _local(x, y, self.cx, self.cy)
        books = self.books
        # t * code0 - a * code1 - b * code2 approximates cosh d - t; the tables of the first two are joined into one of 256
        first = (t[:, None, None] * books[0][None, None, :] - a[:, None, None] * books[1][None, :, None]).reshape(len(x), CODES * CODES)
        last = -b[:, None] * books[2][None, :]
        rough = np.take(first, self.packed, axis=1) + np.take(last, self.third, axis=1) + (t - 1)[:, None]
        error = t * self.worst[0] + np.abs(a) * self.worst[1] + np.abs(b) * self.worst[2] + 1e-12 * t * self.top
        error = np.where(np.isfinite(error), error, np.inf)
        keep = min(k, len(self.x) - 1)
        edge = np.partition(rough, keep, axis=1)[:, keep] + 2 * error if len(self.x) > k else np.full(len(x), np.inf)
        query, at = np.nonzero(~(rough > np.minimum(edge, most + error)[:, None]))
        exact = chord(x[query], y[query], self.x[at], self.y[at])
        return query, at, exact


class Points:
    """The positions of a cell in leaves; the codes of a leaf are made when it is first probed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.y, self.ids = x, y, ids
        self.tree = Tree(*polar(x, y), LEAF)
        self.leaves: dict[int, Leaf] = {}

    def leaf(self, k: int) -> Leaf:
        if k not in self.leaves:
            own = self.tree.members[k]
            self.leaves[k] = Leaf(self.x[own], self.y[own], self.ids[own])
        return self.leaves[k]

    def improve(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, score: np.ndarray, near: np.ndarray, own: bool) -> None:
        """Let the lists of the k nearest (score, near; (n, k), ascending) of queries take in what lies here."""
        k = score.shape[1]
        r, angle = polar(x, y)
        visited = np.full(len(x), -1, dtype=np.int64)
        if own:  # the leaf a query lies in gives the first bound
            visited = self.tree.assign(r, angle)
            self._probe(np.arange(len(x)), visited, x, y, ids, score, near)
        query, leaf, least = self.tree.within(r, angle, score[:, k - 1])
        other = leaf != visited[query]
        query, leaf, least = query[other], leaf[other], least[other]
        order = np.lexsort((leaf, least, query))
        query, leaf, least = query[order], leaf[order], least[order]
        turn = np.arange(len(query)) - np.searchsorted(query, query)
        for now in range(int(turn.max(initial=-1)) + 1):
            live = (turn == now) & (least <= score[query, k - 1])
            self._probe(query[live], leaf[live], x, y, ids, score, near)

    def _probe(self, query: np.ndarray, leaf: np.ndarray, x, y, ids, score, near) -> None:
        k = score.shape[1]
        order = np.argsort(leaf, kind="stable")
        query, leaf = query[order], leaf[order]
        for own in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1) if len(leaf) else []:
            held, asked = self.leaf(int(leaf[own[0]])), query[own]
            q, at, exact = held.scan(x[asked], y[asked], k, score[asked, k - 1])
            fresh = held.ids[at] != ids[asked[q]]
            q, at, exact = q[fresh], at[fresh], exact[fresh]
            row = np.concatenate([np.repeat(np.arange(len(asked)), k), q])
            value = np.concatenate([score[asked].ravel(), exact])
            name = np.concatenate([near[asked].ravel(), held.ids[at]])
            best = np.lexsort((name, value, row))
            row = row[best]
            best = best[np.arange(len(row)) - np.searchsorted(row, row) < k].reshape(len(asked), k)
            score[asked], near[asked] = value[best], name[best]


def _listed(df: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([df[f"s{j}"].to_numpy(dtype=float) for j in range(k)], axis=1), np.stack([df[f"n{j}"].to_numpy(dtype=np.int64) for j in range(k)], axis=1)


def _lists(score: np.ndarray, near: np.ndarray) -> dict[str, np.ndarray]:
    k = score.shape[1]
    return {f"s{j}": score[:, j] for j in range(k)} | {f"n{j}": near[:, j] for j in range(k)}


def neighbours(nodes: DataFrame, k: int = 5) -> DataFrame:
    """(node_id, neighbour_id, rank, distance): the k nearest other nodes of every valid node."""
    spark = nodes.sparkSession
    ship(spark)
    valid = nodes.where("node_id is not null and px is not null and py is not null and px * px + py * py < 1")
    valid = valid.select("node_id", (F.col("px") + 0.0).alias("px"), (F.col("py") + 0.0).alias("py")).dropDuplicates(["node_id"])
    valid = written(valid, "nodes")
    # limited before the shuffle, so a hot position stays small
    low = valid.withColumn("at", F.row_number().over(W.partitionBy("px", "py").orderBy("node_id"))).where(F.col("at") <= k + 1)
    low = written(low.select("node_id", "px", "py", "at"), "positions")
    number = low.count()
    if number == 0:
        return spark.createDataFrame([], "node_id long, neighbour_id long, rank int, distance double")
    rate = min(1.0, SAMPLE / number)
    sample = low.where(F.pmod(F.xxhash64("px", "py"), F.lit(1 << 20)) < F.lit(int(np.ceil(rate * (1 << 20))))).select("px", "py").toPandas()  # about SAMPLE rows at most
    cells = min(MAX_CELLS, max(1, number // CELL))
    r, angle = polar(sample.px.to_numpy(), sample.py.to_numpy())
    tree = Tree(r, angle, max(1, -(-len(r) // cells)))
    tree.members = []  # the sample itself isn't needed further
    shape = spark.sparkContext.broadcast(tree)  # at most 2 x MAX_CELLS nodes

    def assign(batches):
        for b in batches:
            r, angle = polar(b.px.to_numpy(), b.py.to_numpy())
            yield b.assign(cell=shape.value.assign(r, angle), r=r, angle=angle)

    points = written(low.select("node_id", "px", "py").mapInPandas(assign, "node_id long, px double, py double, cell long, r double, angle double"), "cells")
    held = points.groupBy("cell").agg(F.min("r"), F.max("r"), F.min("angle"), F.max("angle")).collect()  # a row a cell
    boxes = [(2.0, -1.0, 4.0, -4.0)] * int(tree.leaf.max() + 1)
    for row in held:
        boxes[row[0]] = tuple(row[1:])
    tree.fit(boxes)
    shared = spark.sparkContext.broadcast(tree)
    points = points.select("node_id", "px", "py", "cell")
    wide = ", ".join([f"s{j} double" for j in range(k)] + [f"n{j} long" for j in range(k)])
    schema = f"node_id long, px double, py double, {wide}, cells array<long>"
    columns = ["node_id", "px", "py", *_lists(np.zeros((0, k)), np.zeros((0, k))), "cells"]

    def answered(asked: pd.DataFrame, score: np.ndarray, near: np.ndarray, skip: list[np.ndarray]) -> pd.DataFrame:
        """The lists, with the cells that may still improve them, the nearest first."""
        r, angle = polar(asked.px.to_numpy(), asked.py.to_numpy())
        query, cell, least = shared.value.within(r, angle, score[:, k - 1])
        fresh = np.all([cell != s[query] for s in skip], axis=0)
        query, cell, least = query[fresh], cell[fresh], least[fresh]
        order = np.lexsort((cell, least, query))
        ends = np.searchsorted(query[order], np.arange(len(r) + 1))
        left = [cell[order[a:b]] for a, b in zip(ends, ends[1:])]
        return pd.DataFrame({"node_id": asked.node_id.to_numpy(), "px": asked.px.to_numpy(), "py": asked.py.to_numpy(), **_lists(score, near), "cells": pd.Series(left, dtype=object)})

    def own_cell(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x, y, ids = own.px.to_numpy(), own.py.to_numpy(), own.node_id.to_numpy()
        score, near = np.full((len(x), k), np.inf), np.full((len(x), k), NOBODY)
        Points(x, y, ids).improve(x, y, ids, score, near, True)
        return answered(own, score, near, [np.full(len(x), int(key[0]))])

    def other_cell(key: tuple, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or own.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        x, y, ids = asked.px.to_numpy(), asked.py.to_numpy(), asked.node_id.to_numpy()
        score, near = (a.copy() for a in _listed(asked, k))
        Points(own.px.to_numpy(), own.py.to_numpy(), own.node_id.to_numpy()).improve(x, y, ids, score, near, False)
        if "home" not in asked:
            return pd.DataFrame({"node_id": ids, "px": x, "py": y, **_lists(score, near), "cells": pd.Series([[]] * len(x), dtype=object)})
        return answered(asked, score, near, [np.full(len(x), int(key[0])), asked.home.to_numpy()])

    # explicit, as the work of a cell is far more than its bytes, by which partitions would be merged
    parts = min(-(-len(held) // TASK_CELLS), MOST_PARTS)
    points = points.repartition(parts, "cell")
    first = written(points.groupBy("cell").applyInPandas(own_cell, schema), "own-cell")
    # the own cell is skipped in every later round, so it travels along
    asked = first.where(F.size("cells") > 0).join(points.select("node_id", F.col("cell").alias("home")), "node_id")
    asked = asked.select("node_id", "px", "py", *columns[3:-1], "home", F.col("cells")[0].alias("cell"))
    second = written(asked.repartition(parts, "cell").groupBy("cell").cogroup(points.groupBy("cell")).applyInPandas(other_cell, schema), "next-cell")
    late = second.where(F.size("cells") > 0).select("node_id", "px", "py", *columns[3:-1], F.explode("cells").alias("cell"))
    third = late.repartition(parts, "cell").groupBy("cell").cogroup(points.groupBy("cell")).applyInPandas(other_cell, schema)
    lists = F.array(*[F.struct(F.col(f"s{j}").alias("score"), F.col(f"n{j}").alias("id")) for j in range(k)])
    rows = lambda df: df.select("node_id", F.filter(lists, lambda s: s["id"] != F.lit(int(NOBODY))).alias("near"))
    merged = rows(third).groupBy("node_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))  # a row a cell that was asked
    searched = rows(first.where(F.size("cells") == 0)).unionByName(rows(second.where(F.size("cells") == 0))).unionByName(merged)
    # nodes beyond the k + 1 smallest of their position: the k smallest lie at distance zero
    crowds = valid.groupBy("px", "py").agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    few = low.groupBy("px", "py").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    crowds = written(crowds.join(few, ["px", "py"]), "crowds")
    hot = F.col("n") > F.greatest(F.lit(HOT), F.lit(number // 100_000))
    lists_of = lambda side: side.select("px", "py", "ids")
    beside = valid.join(F.broadcast(lists_of(crowds.where(hot))), ["px", "py"]).unionByName(valid.join(lists_of(crowds.where(~hot)), ["px", "py"]))
    beside = beside.where(F.col("node_id") > F.col("ids")[k]).select("node_id", F.transform(F.slice("ids", 1, k), lambda i: F.struct(F.lit(0.0).alias("score"), i.alias("id"))).alias("near"))
    each = searched.unionByName(beside).select("node_id", F.posexplode("near").alias("at", "s"))
    return each.select("node_id", F.col("s.id").alias("neighbour_id"), (F.col("at") + 1).cast("int").alias("rank"), F.acosh(F.lit(1.0) + F.col("s.score")).alias("distance"))
