"""Exact nearest neighbours by a tree of cells, and the three over-samplers built on them.

Rows of equal vectors become one point. Cells are split at the medians of a bounded sample; a block is a cell, or a part of
a large one, with the box of its points. The distance of a point's k-th neighbour in its own block bounds its search. Groups
of neighbouring blocks are compared as a whole: a group goes to the groups whose boxes lie within its bounds, a few at a time,
and inside a task boxes leave out blocks and points, the nearest blocks first, which tightens the bounds. So a vector is sent
once for every group that needs its block, not once for every point or cell that does. Long vectors are compared by matrix products,
whose rounding is bounded; what may be near is then measured exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.scaling import hash_rank, lookup, order_hash
from netsift.session import materialize

SAMPLED = 1 << 20  # numbers in the sample that the tree is made from
GROUP_ROWS = 16_384  # search points of a group of blocks
AT_ONCE = 4  # a task compares a group with as many points as this many groups have
COPIES_AT_ONCE = 1_000  # synthetic rows of a seed that one task makes together
SLACK = 1e-9  # rounding of the bounds; wider bounds only cost comparisons


def _matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=float).reshape(len(vectors), -1)


def _distinct(points: DataFrame, k: int) -> DataFrame:
    """One row per scope and vector: vid (its least id), x (packed vector), q, m (search rows, k + 1 at most) and
    their ids `rows`. Of equal vectors only the k + 1 least ids can be anybody's neighbours."""
    clean = points.where(F.col("scope").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
                         & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    w = Window.partitionBy("scope", "vec", "q", "s").orderBy("id")
    few = clean.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    mine = F.slice(F.array_sort(F.collect_list(F.when(F.col("s"), F.struct("id", "cls")))), 1, k + 1)
    grouped = few.groupBy("scope", "vec").agg(F.min("id").alias("vid"), F.max("q").alias("q"), mine.alias("rows")).withColumn("m", F.size("rows"))

    def pack(frames):
        for pdf in frames:
            yield pdf.assign(x=[np.asarray(v, dtype=float).tobytes() for v in pdf["vec"]])

    return grouped.mapInPandas(pack, grouped.schema.simpleString()[7:-1] + ",x:binary")


def _split_at(x: np.ndarray) -> tuple[int, float] | None:
    """The widest column and a value of it that parts the rows; None if all rows are equal."""
    lo, hi = x.min(axis=0), x.max(axis=0)
    axis = int(np.argmax(hi - lo))
    if not lo[axis] < hi[axis]:
        return None
    cut = float(np.median(x[:, axis]))
    return axis, cut if cut > lo[axis] else float(x[x[:, axis] > lo[axis], axis].min())


class Tree:
    """Cells of one scope, split at medians of a sample. A cell's group is its last ancestor that holds `group_rows` or less."""

    def __init__(self, root: str, sample: np.ndarray, share: float, pivots: int, leaf_rows: int, group_rows: int, levels: int):
        self.axis, self.cut, self.child, self.cell, self.group = [], [], [], [], []
        todo, at = [(sample, root, None, 0)], 0
        while at < len(todo):  # children are entered side by side, the left one first
            x, name, group, depth = todo[at]
            at += 1
            rows = len(x) / share
            group = name if group is None and rows <= group_rows else group
            split = _split_at(x) if rows > leaf_rows and len(x) > pivots and depth < levels else None
            self.axis.append(-1 if split is None else split[0])
            self.cut.append(0.0 if split is None else split[1])
            self.child.append(len(todo))
            self.cell.append(name)
            self.group.append(group or name)
            if split is not None:
                left = x[:, split[0]] < split[1]
                mark = "" if "/" in name else "/"
                todo += [(x[left], f"{name}{mark}0", group, depth + 1), (x[~left], f"{name}{mark}1", group, depth + 1)]
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node of the cell of every row."""
        node, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
        while True:
            axis = self.axis[node]
            if (axis < 0).all():
                return node
            node = np.where(axis < 0, node, self.child[node] + (x[rows, axis] >= self.cut[node]))


def _placed(distinct: DataFrame, pivots: int, leaf_rows: int, block_rows: int, group_rows: int, levels: int) -> DataFrame:
    """The points with their cell, its group, and the block of the cell that they are in."""
    held = distinct.where("m > 0")
    size = held.agg(F.count("*").alias("n"), F.max(F.octet_length("x")).alias("b")).first()
    most = max(SAMPLED // max((size["b"] or 8) // 8, 1), 1_024)  # rows of the sample, which is all that the driver sees
    share = min(1.0, most / max(size["n"], 1))
    drawn = held if share == 1.0 else held.where(F.pmod(F.xxhash64("vid", F.lit("tree")), F.lit(1 << 30)) < int(share * (1 << 30)))
    samples: dict[str, list] = {}
    for r in drawn.select("vid", F.md5("scope").alias("root"), "x").orderBy("vid").collect():
        samples.setdefault(r["root"], []).append(r["x"])
    trees = {root: Tree(root, _matrix(x), share, pivots, leaf_rows, group_rows, levels) for root, x in samples.items() if len(x) / share > leaf_rows}

    def place(frames):
        for pdf in frames:
            cell, group = pdf["root"].to_numpy(dtype=object).copy(), pdf["root"].to_numpy(dtype=object).copy()
            for root, rows in pdf.groupby("root", sort=False).indices.items():
                if root in trees:
                    node = trees[root].place(_matrix(pdf["x"].iloc[rows].tolist()))
                    cell[rows] = np.array(trees[root].cell, dtype=object)[node]
                    group[rows] = np.array(trees[root].group, dtype=object)[node]
            yield pdf.assign(cell=cell, grp=group)

    rows = distinct.select("vid", "x", "m", "q", F.md5("scope").alias("root"))
    located = materialize(rows.mapInPandas(place, "vid string, x binary, m int, q boolean, root string, cell string, grp string"), "knn-cells", codec="zstd")
    parts = F.ceil(F.count("*") / F.lit(block_rows)).cast("long")
    full = located.groupBy("cell").agg(parts.alias("parts")).where("parts > 1")  # cells that are larger than a block
    part = F.pmod(F.xxhash64("vid"), F.coalesce("parts", F.lit(1).cast("long"))).cast("int")
    split = located.join(full, "cell", "left").withColumn("part", part).drop("parts")
    few = max(group_rows // block_rows, 1)  # blocks of one cell that share a group
    return split.withColumn("grp", F.concat_ws(":", "grp", F.when(F.col("part") >= few, F.floor(F.col("part") / F.lit(few)))))


def _box(x: np.ndarray) -> tuple[bytes | None, bytes | None]:
    return (x.min(axis=0).tobytes(), x.max(axis=0).tobytes()) if len(x) else (None, None)


def _far(lo, hi, at, end) -> np.ndarray:
    """Least distances, squared, between boxes; a point is a box without extent."""
    gap = np.maximum(np.maximum(lo - end, at - hi), 0.0)
    return (gap * gap).sum(axis=-1)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Squared distances, and how far rounding may put them off for each row of `a`."""
    if a.shape[1] > 16:
        centre = b.mean(axis=0)
        x, y = a - centre, b - centre
        with np.errstate(all="ignore"):
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            if np.isfinite(xx.max() + yy.max()):
                return xx[:, None] + yy - 2.0 * (x @ y.T), 2e-15 * (a.shape[1] + 16) * (xx + yy.max())
    total = np.zeros((len(a), len(b)))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            gap = a[:, i, None] - b[:, i]
            gap *= gap
            total += gap
    return total, 0.0


class Nearest:
    """The k + 1 nearest of the points shown so far, for many points. `limit` holds squared distances beyond which no point counts."""

    def __init__(self, x: np.ndarray, limit: np.ndarray, k: int):
        self.x, self.k, self.limit = x, k, limit.copy()
        self.slack = np.zeros(len(x))  # rounding of a point's squares
        self.found = [np.empty(0, int), np.empty(0, int), np.empty(0)]  # point, number of the other, squared distance
        self.more, self.compared = [], 0

    def show(self, rows: np.ndarray, y: np.ndarray, first: int) -> None:
        """`y` are the points `first`, `first` + 1 ..; only the points `rows` are compared with them."""
        step = max(1, 2_000_000 // len(y))
        for at in range(0, len(rows), step):
            own = rows[at:at + step]
            square, off = _squares(self.x[own], y)
            self.slack[own] = np.maximum(self.slack[own], 2 * off)
            i, j = np.nonzero(square <= (self.limit[own] * (1 + SLACK) + self.slack[own])[:, None])
            self.more.append((own[i], j + first, square[i, j]))
            self.compared += square.size
        if sum(len(m[0]) for m in self.more) > len(self.x):
            self.tighten()

    def tighten(self) -> None:
        who, other, square = (np.concatenate([a, *b]) for a, b in zip(self.found, zip(*self.more))) if self.more else self.found
        order = np.lexsort((square, who))
        who, other, square = who[order], other[order], square[order]
        start = np.searchsorted(who, np.arange(len(self.x)))
        rank = np.arange(len(who)) - start[who]
        last = rank == self.k
        self.limit[who[last]] = np.minimum(self.limit[who[last]], np.maximum(square[last], 0.0))
        near = square <= self.limit[who] * (1 + SLACK) + self.slack[who]
        self.found, self.more = [who[near], other[near], square[near]], []

    def best(self, y: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, number of the other, distance): the first k + 1 by distance and name."""
        self.tighten()
        who, other, _ = self.found
        distance = np.empty(len(who))
        for at in range(0, len(who), 100_000):
            part = slice(at, at + 100_000)
            with np.errstate(all="ignore"):
                distance[part] = np.sqrt(((self.x[who[part]] - y[other[part]]) ** 2).sum(axis=1))
        order = np.lexsort((names[other], distance, who))
        who, other, distance = who[order], other[order], distance[order]
        first = np.arange(len(who)) - np.searchsorted(who, np.arange(len(self.x)))[who] <= self.k
        return who[first], other[first], distance[first]


_BLOCK = ("root string, grp string, bid long, n int, lo binary, hi binary, sx binary, sid array<string>, sm array<int>, "
          "qn int, qlo binary, qhi binary, qx binary, qid array<string>, reach binary, widest double")


def _blocks(placed: DataFrame, k: int) -> DataFrame:
    """One row per block: its box, search points and query points, and for each of these a squared distance within which the
    block itself has k + 1 points (infinity if it has fewer). Where all points are both, they are written once."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid", kind="stable")
        s, q = pdf[pdf["m"] > 0], pdf[pdf["q"]]
        dims = len(pdf["x"].iloc[0]) // 8
        y, x = (_matrix(t["x"].tolist()) if len(t) else np.empty((0, dims)) for t in (s, q))
        limit = np.full(len(x), np.inf)
        if len(y) > k and len(x):
            step = max(1, 2_000_000 // len(y))
            for at in range(0, len(x), step):
                square, off = _squares(x[at:at + step], y)
                limit[at:at + step] = np.maximum(np.partition(square, k, axis=1)[:, k], 0.0) + off
            limit = np.where(np.isnan(limit), np.inf, limit * (1 + SLACK))
        (lo, hi), (qlo, qhi) = _box(y), _box(x)
        both = len(s) == len(q) == len(pdf)
        return pd.DataFrame([{"root": key[0], "grp": key[1], "bid": key[4], "n": len(y), "lo": lo, "hi": hi, "sx": y.tobytes(), "sid": s["vid"].tolist(), "sm": s["m"].tolist(),
                              "qn": len(x), "qlo": qlo, "qhi": qhi, "qx": None if both else x.tobytes(), "qid": None if both else q["vid"].tolist(), "reach": limit.tobytes(), "widest": limit.max() if len(x) else 0.0}])

    named = placed.withColumn("bid", F.xxhash64("cell", "part"))  # two of the same name are only sent together
    return materialize(named.groupBy("root", "grp", "cell", "part", "bid").applyInPandas(pack, _BLOCK), "knn-blocks", codec="zstd")


def _routes(blocks: DataFrame, k: int) -> DataFrame:
    """(grp, chunk, other, wanted): which blocks of other groups the points of a group are compared with, the nearest first, in
    chunks of about the points of AT_ONCE groups.

    The driver holds one box per group, that is per `group_rows` points; blocks are chosen where two groups may meet.
    """
    def bound(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, asked = pdf[pdf["n"] > 0], pdf[pdf["qn"] > 0]
        row = dict.fromkeys(("lo", "hi", "qlo", "qhi", "widest", "slo", "shi", "sn", "bids"))
        if len(held):
            slo, shi = _matrix(held["lo"].tolist()), _matrix(held["hi"].tolist())
            lo, hi = slo.min(axis=0), shi.max(axis=0)
            row |= {"lo": lo.tobytes(), "hi": hi.tobytes(), "slo": slo.tobytes(), "shi": shi.tobytes(), "sn": held["n"].tolist(), "bids": held["bid"].tolist()}
        if len(asked):
            qlo, qhi, widest = _matrix(asked["qlo"].tolist()), _matrix(asked["qhi"].tolist()), asked["widest"].to_numpy(dtype=float)
            if held["n"].sum() > k:  # a block with few search points: the whole group has enough of them
                with np.errstate(all="ignore"):
                    widest = np.fmin(widest, (np.maximum(np.abs(qhi - lo), np.abs(hi - qlo)) ** 2).sum(axis=1) * (1 + SLACK))
            row |= {"qlo": qlo.tobytes(), "qhi": qhi.tobytes(), "widest": widest.tobytes()}
        return pd.DataFrame([{"root": key[0], "grp": key[1], **row}])

    facts = blocks.select("root", "grp", "bid", "n", "lo", "hi", "qn", "qlo", "qhi", "widest").groupBy("root", "grp")
    groups = materialize(facts.applyInPandas(bound, "root string, grp string, lo binary, hi binary, qlo binary, qhi binary, widest binary, "
                                             "slo binary, shi binary, sn array<int>, bids array<long>"), "knn-groups")
    boxes: dict[str, list] = {}
    for r in groups.where("lo is not null").select("root", "grp", "lo", "hi").orderBy("grp").collect():
        boxes.setdefault(r["root"], []).append(r)
    known = {root: ([r["grp"] for r in rs], _matrix([r["lo"] for r in rs]), _matrix([r["hi"] for r in rs])) for root, rs in boxes.items()}

    def reached(r, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which boxes the bounds of a group's blocks reach, and how far they are at least."""
        qlo, qhi = (np.frombuffer(v, dtype=float).reshape(-1, lo.shape[1]) for v in (r.qlo, r.qhi))
        least, near = np.full(len(lo), np.inf), np.zeros(len(lo), dtype=bool)
        for a, b, w in zip(qlo, qhi, np.frombuffer(r.widest, dtype=float)):
            far = _far(lo, hi, a, b)
            near |= ~(far * (1 - SLACK) > w)
            least = np.fmin(least, far)
        return near, least

    def route(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.root in known:
                    names, lo, hi = known[r.root]
                    met = [names[i] for i in np.flatnonzero(reached(r, lo, hi)[0])]
                    yield pd.DataFrame({"grp": r.grp, "qlo": r.qlo, "qhi": r.qhi, "widest": r.widest, "other": met}, index=range(len(met)))

    def choose(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                lo, hi = (np.frombuffer(v, dtype=float).reshape(len(r.sn), -1) for v in (r.slo, r.shi))
                near, least = reached(r, lo, hi)
                if near.any():
                    out.append((r.grp, r.other, np.asarray(r.bids)[near].tolist(), np.asarray(r.sn)[near].tolist(), least[near].tolist()))
            yield pd.DataFrame(out, columns=["grp", "other", "bids", "sn", "least"])

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("other", kind="stable")
        at = np.repeat(np.arange(len(pdf)), pdf["bids"].map(len).to_numpy(dtype=int))
        bids, sn, least = (np.concatenate([np.asarray(v) for v in pdf[c]]) for c in ("bids", "sn", "least"))
        order = np.argsort(least, kind="stable")
        at, bids, sn = at[order], bids[order], sn[order].astype(int)
        rows = pd.DataFrame({"chunk": (np.cumsum(sn) - sn) // (AT_ONCE * GROUP_ROWS), "at": at, "bid": bids}).groupby(["chunk", "at"])["bid"].agg(list)
        return pd.DataFrame([(key[0], chunk, pdf["other"].iloc[i], wanted) for (chunk, i), wanted in rows.items()], columns=["grp", "chunk", "other", "wanted"])

    sides = "grp string, qlo binary, qhi binary, widest binary, other string"
    met = groups.where("widest is not null").select("root", "grp", "qlo", "qhi", "widest").repartition("grp").mapInPandas(route, sides)
    met = met.join(groups.where("lo is not null").select(F.col("grp").alias("other"), "slo", "shi", "sn", "bids"), "other")
    chosen = met.mapInPandas(choose, "grp string, other string, bids array<long>, sn array<int>, least array<double>")
    return materialize(chosen.groupBy("grp").applyInPandas(deal, "grp string, chunk int, other string, wanted array<long>"), "knn-routes")


def _compare(blocks: DataFrame, routes: DataFrame, k: int, counted: bool) -> DataFrame:
    """Per point and chunk the k + 1 nearest points: vid, nid, m, distance; `counted`: per root the pairs compared."""
    ids = lambda c: [F.get(c, F.lit(0)).alias("first"), *([] if counted else [c])]  # noqa: E731  (pairs are counted without them)
    points = blocks.withColumn("qx", F.coalesce("qx", "sx")).withColumn("qid", F.coalesce("qid", "sid"))
    asked = points.where("qn > 0").join(routes.select("grp", "chunk").distinct(), "grp").select("grp", "chunk", "root", "qn", "qlo", "qhi", "qx", "reach", *ids("qid"))
    held = blocks.where("n > 0").select(F.col("grp").alias("other"), "bid", "n", "lo", "hi", "sx", "sm", *ids("sid")).join(routes, "other").where(
        F.array_contains("wanted", F.col("bid"))).select(F.col("grp").alias("of"), F.col("chunk").alias("no"), "n", "lo", "hi", "sx", "first", *([] if counted else ["sid", "sm"]))

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if q.empty or s.empty:
            return pd.DataFrame(columns=["root", "compared"] if counted else ["vid", "nid", "m", "distance"])
        q, s = (t.iloc[np.argsort(t["first"].tolist())] for t in (q, s))
        qlo, qhi, lo, hi = (_matrix(t[c].tolist()) for t, c in ((q, "qlo"), (q, "qhi"), (s, "lo"), (s, "hi")))
        x, limit = (np.frombuffer(b"".join(q[c]), dtype=float) for c in ("qx", "reach"))
        x = x.reshape(-1, lo.shape[1])
        asks, sizes = q["qn"].to_numpy(dtype=int), s["n"].to_numpy(dtype=int)
        owner, begins, firsts = np.repeat(np.arange(len(q)), asks), np.cumsum(asks) - asks, np.cumsum(sizes) - sizes
        far = np.stack([_far(lo, hi, a, b) for a, b in zip(qlo, qhi)])  # query block, search block
        near = Nearest(x, limit, k)
        for at in np.argsort(far.min(axis=0), kind="stable"):
            widest = np.maximum.reduceat(near.limit, begins)
            rows = np.flatnonzero(~(far[:, at] * (1 - SLACK) > widest)[owner])
            if len(rows):
                rows = rows[~(_far(lo[at], hi[at], x[rows], x[rows]) * (1 - SLACK) > near.limit[rows] * (1 + SLACK))]
            if len(rows):
                near.show(rows, np.frombuffer(s["sx"].iloc[at], dtype=float).reshape(-1, x.shape[1]), int(firsts[at]))
        if counted:
            return pd.DataFrame([(q["root"].iloc[0], near.compared)], columns=["root", "compared"])
        nid, m, vid = (np.concatenate([np.asarray(v, dtype=kind) for v in t[c]]) for t, c, kind in ((s, "sid", object), (s, "sm", int), (q, "qid", object)))
        y = np.frombuffer(b"".join(s["sx"]), dtype=float).reshape(-1, x.shape[1])
        name = np.empty(len(nid), dtype=int)
        name[np.argsort(nid, kind="stable")] = np.arange(len(nid))
        i, j, distance = near.best(y, name)
        return pd.DataFrame({"vid": vid[i], "nid": nid[j], "m": m[j], "distance": distance})

    shape = "root string, compared long" if counted else "vid string, nid string, m int, distance double"
    return asked.groupBy("grp", "chunk").cogroup(held.groupBy("of", "no")).applyInPandas(block, shape)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 first points by distance and id. They hold the first k + 1 rows, whatever their copies are: a point's rows
    come after its own id, and k + 1 points before it are k + 1 rows before it."""
    w = Window.partitionBy("vid").orderBy("distance", "nid")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).drop("_n")


def _search(points: DataFrame, k: int, pivots: int, leaf_rows: int, block_rows: int, levels: int):
    """(distinct points, their blocks, the groups to compare), all written tables; None without rows."""
    distinct = materialize(_distinct(points, k), "knn-points", codec="zstd")
    if distinct.isEmpty():
        return None
    blocks = _blocks(_placed(distinct, pivots, leaf_rows, block_rows, max(GROUP_ROWS, block_rows), levels), k)
    return distinct, blocks, _routes(blocks, k)


def nearest(points: DataFrame, k: int, pivots: int = 16, block_rows: int = 2_000, leaf_rows: int = 256, levels: int = 24) -> DataFrame:
    """The k nearest search rows of every query row within its scope, self excluded, ties by id.

    `points`: id string (unique), scope string, cls string, vec array<double> (of one length), q boolean (wants
    neighbours), s boolean (can be a neighbour). Result: id, cls, rank, neighbour, neighbour_cls, distance.
    Rows without a scope, and vectors that are null, empty or hold null or non-finite entries, take no part.
    A cell that is still large after `levels` splits is searched in blocks.
    """
    points = materialize(points.select("id", "scope", "cls", "vec", F.coalesce("q", F.lit(False)).alias("q"), F.coalesce("s", F.lit(False)).alias("s")), "knn-rows")
    done = _search(points, k, pivots, min(leaf_rows, block_rows), block_rows, levels)
    if done is None:
        return points.sparkSession.createDataFrame([], "id string, cls string, rank int, neighbour string, neighbour_cls string, distance double")
    distinct, blocks, routes = done
    best = materialize(_best(_compare(blocks, routes, k, False), k), "knn-best")
    rows = best.join(distinct.select(F.col("vid").alias("nid"), F.explode("rows").alias("r")), "nid")
    answers = rows.groupBy("vid").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", F.col("r.id").alias("id"), F.col("r.cls").alias("cls")))), 1, k + 1).alias("near"))
    known = distinct.where("q").select("scope", "vec", "vid").join(answers, "vid")
    asked = points.where("q").select("id", "scope", "cls", "vec").join(known, ["scope", "vec"])
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
    return asked.select("id", "cls", F.posexplode(others).alias("at", "n")).select(
        "id", "cls", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("neighbour"), F.col("n.cls").alias("neighbour_cls"), F.col("n.distance").alias("distance"))


def search_cost(points: DataFrame, k: int, pivots: int = 16, block_rows: int = 2_000, leaf_rows: int = 256, levels: int = 24) -> DataFrame:
    """What a search compares, per scope: queries and search points (distinct vectors), compared (pairs of them)."""
    done = _search(points, k, pivots, min(leaf_rows, block_rows), block_rows, levels)
    if done is None:
        return points.sparkSession.createDataFrame([], "scope string, queries long, candidates long, compared long")
    distinct, blocks, routes = done
    inside = blocks.groupBy("root").agg(F.sum(F.col("n").cast("long") * F.col("qn")).alias("compared"))  # for the first bound
    pairs = inside.unionByName(_compare(blocks, routes, k, True)).groupBy("root").agg(F.sum("compared").alias("compared"))
    sides = distinct.groupBy("scope").agg(F.count_if("q").alias("queries"), F.count_if(F.col("m") > 0).alias("candidates"))
    return sides.withColumn("root", F.md5("scope")).join(pairs, "root", "left").select("scope", "queries", "candidates", F.coalesce("compared", F.lit(0)).alias("compared"))


def _uniform(*cols) -> F.Column:
    """A repeatable number in [0, 1) from hashed columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / 4294967296.0


def interpolate(points: DataFrame, seeds: DataFrame, links: DataFrame, seed: int = 42) -> DataFrame:
    """Synthetic rows on segments between a seed row and one of its neighbours.

    `seeds`: id, cls, copies (rows wanted). `links`: id, rank, neighbour. The neighbour and the
    position on the segment are drawn by hashing (seed row, copy number).
    """
    sizes = links.groupBy("id").agg(F.max("rank").alias("k"))
    first = F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(COPIES_AT_ONCE).cast("long"))
    blocks = seeds.where("copies > 0").join(sizes, "id").select("id", "cls", "k", "copies", F.explode(first).alias("first"))
    draws = (
        blocks.repartition("id", "first")  # a seed of a tiny class may have to give most of the rows
        .select("id", "cls", "k", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES_AT_ONCE - 1, F.col("copies")))).alias("copy"))
        .withColumn("rank", (F.floor(_uniform("id", "copy", F.lit(f"n{seed}")) * F.col("k")) + 1).cast("int"))
        .withColumn("gap", _uniform("id", "copy", F.lit(f"g{seed}")))
    )
    picked = draws.join(links.select("id", "rank", "neighbour"), ["id", "rank"])
    own = points.select("id", F.col("vec").alias("a"))
    other = points.select(F.col("id").alias("neighbour"), F.col("vec").alias("b"))
    return picked.join(own, "id").join(other, "neighbour").select(
        F.concat_ws("#", "id", "copy").alias("id"), "cls", F.zip_with("a", "b", lambda x, y: x + F.col("gap") * (y - x)).alias("vec"),
        F.col("id").alias("seed_id"), "neighbour", "gap")


def _even_copies(seeds: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Spread each class's `wanted` rows evenly over its seed rows: q/m each, the first q mod m one more."""
    ranked = hash_rank(seeds.withColumn("_h", order_hash("id", seed=seed)), "_h", ["cls"], "_r")
    n = seeds.groupBy("cls").agg(F.count("*").alias("m"))
    j = lookup(lookup(ranked, n, ["cls"]), wanted, ["cls"], "inner")
    return j.select("id", "cls", (F.floor(F.col("wanted") / F.col("m")) + (F.col("_r") <= F.col("wanted") % F.col("m")).cast("long")).cast("long").alias("copies"))


def _class_sizes(points: DataFrame) -> dict[str, int]:
    return {r["cls"]: r["n"] for r in points.groupBy("cls").agg(F.count("*").alias("n")).collect()}


def _wanted(spark, sizes: dict[str, int], target: int) -> DataFrame:
    return spark.createDataFrame([(c, target - n) for c, n in sizes.items() if n < target], "cls string, wanted long")


def smote(points: DataFrame, k: int = 5, seed: int = 42, shrink_k: bool = False, **search) -> DataFrame:
    """Synthetic rows that bring every class to the size of the largest. `points`: id, cls, vec.

    Nothing is made when the smallest class has fewer than two rows; `shrink_k` limits k to its size - 1.
    """
    sizes = _class_sizes(points)
    if not sizes or min(sizes.values()) < 2:
        return points.limit(0).select("id", "cls", "vec", F.lit("").alias("seed_id"), F.lit("").alias("neighbour"), F.lit(0.0).alias("gap"))
    k = min(k, min(sizes.values()) - 1) if shrink_k else k
    small = [c for c, n in sizes.items() if n < max(sizes.values())]
    mine = points.where(F.col("cls").isin(small)) if small else points.limit(0)
    links = nearest(mine.select("id", F.col("cls").alias("scope"), "cls", "vec", F.lit(True).alias("q"), F.lit(True).alias("s")), k, **search)
    copies = _even_copies(mine.select("id", "cls"), _wanted(points.sparkSession, sizes, max(sizes.values())), seed)
    return interpolate(mine, copies, materialize(links, "knn-links"), seed)


def _all_neighbours(points: DataFrame, classes: list[str], k: int, **search) -> DataFrame:
    """Neighbours over all classes of the rows of `classes`."""
    return nearest(points.select("id", F.lit("all").alias("scope"), "cls", "vec", F.col("cls").isin(classes).alias("q"), F.lit(True).alias("s")), k, **search)


def danger_rows(points: DataFrame, classes: list[str], m: int = 10, **search) -> DataFrame:
    """Rows with at least half, but not all, of their m neighbours in other classes."""
    near = _all_neighbours(points, classes, m, **search)
    foreign = near.groupBy("id", "cls").agg(F.count_if(F.col("neighbour_cls") != F.col("cls")).alias("foreign"), F.count("*").alias("m"))
    return foreign.where((F.col("foreign") >= F.col("m") / 2.0) & (F.col("foreign") < F.col("m")))


def borderline_smote(points: DataFrame, minimum: int = 12_000, k: int = 5, m: int = 10, seed: int = 42, **search) -> DataFrame:
    """Raises classes under `minimum` rows to it, from danger rows only; a class without any is left."""
    sizes = _class_sizes(points)
    small = [c for c, n in sizes.items() if n < minimum]
    k = max(min(k, min(sizes.values()) - 1), 1)
    danger = materialize(danger_rows(points, small, m, **search).select("id", "cls"), "knn-danger")
    flagged = points.where(F.col("cls").isin(small)).join(danger.select("id", F.lit(True).alias("q")), "id", "left").withColumn("q", F.coalesce("q", F.lit(False)))
    links = nearest(flagged.select("id", F.col("cls").alias("scope"), "cls", "vec", "q", F.lit(True).alias("s")), k, **search)
    copies = _even_copies(danger, _wanted(points.sparkSession, sizes, minimum), seed)
    return interpolate(points, copies, materialize(links, "knn-links"), seed)


def adasyn_quota(points: DataFrame, k: int = 5, **search) -> DataFrame:
    """Copies per minority row: its share of foreign neighbours times the rows its class is short of."""
    sizes = _class_sizes(points)
    top = max(sizes.values())
    small = [c for c, n in sizes.items() if n < top]
    near = _all_neighbours(points, small, k, **search)
    ratio = near.groupBy("id", "cls").agg((F.count_if(F.col("neighbour_cls") != F.col("cls")) / F.count("*")).alias("ratio"))
    ratio = materialize(ratio, "knn-ratio")
    total = ratio.groupBy("cls").agg(F.sum("ratio").alias("total"))
    short = _wanted(points.sparkSession, sizes, top)
    j = lookup(lookup(ratio, total, ["cls"]), short, ["cls"], "inner")
    return j.where("total > 0").select("id", "cls", "ratio", F.bround(F.col("ratio") / F.col("total") * F.col("wanted"), 0).cast("long").alias("copies"))


def adasyn(points: DataFrame, k: int = 5, seed: int = 42, **search) -> DataFrame:
    quota = materialize(adasyn_quota(points, k, **search), "knn-quota")
    classes = [r["cls"] for r in quota.select("cls").distinct().collect()]
    mine = points.where(F.col("cls").isin(classes)) if classes else points.limit(0)
    links = nearest(mine.select("id", F.col("cls").alias("scope"), "cls", "vec", F.lit(True).alias("q"), F.lit(True).alias("s")), k, **search)
    return interpolate(mine, quota, materialize(links, "knn-links"), seed)


def oversample_table(df: DataFrame, features: list[str], target: str, key: list[str], method: str = "smote", k: int = 5, seed: int = 42, **search) -> DataFrame:
    """Original rows plus synthetic ones, as columns again; other columns of synthetic rows are NULL."""
    tagged = df.withColumn("_id", F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in key])))
    points = tagged.select(F.col("_id").alias("id"), F.col(target).cast("string").alias("cls"),
                           F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("vec"))
    make = {"smote": smote, "adasyn": adasyn, "borderline": borderline_smote}[method]
    new = make(materialize(points, "oversample"), k=k, seed=seed, **search)
    kinds = dict(df.dtypes)
    back = [F.get("vec", F.lit(i)).cast(kinds[c]).alias(c) for i, c in enumerate(features)]
    return df.unionByName(new.select(F.col("cls").cast(kinds[target]).alias(target), *back), allowMissingColumns=True)
