"""Embedding near-dedup by dual traversal of cover trees.

Vectors are compared as unit vectors, where cosine >= c means distance <= sqrt(2 - 2c). The upper levels
of each label's tree are nested centres with halving radii, found on a bounded sample; every vector
goes to its nearest finest centre, and large cells are cut into blocks of bounded size. Pairs of blocks are
dropped where the distance of their centres exceeds the sum of their covering radii and the
threshold. Each pair of blocks that is left is one task: it builds a cover tree for either block and
traverses both at once. A pair of nodes whose balls are too far apart is pruned; one whose balls
lie within the threshold counts all of its pairs at once; others are opened; pairs of single vectors
are decided by their cosine in double precision. So every pair at or over the threshold is found and none below.

A task returns the number of links of each vector and a spanning forest of the links, never all pairs.
Components are then found on the forests' edges.

Defined results: null labels, null or zero vectors, and vectors with null or non-finite components
link with nothing and form their own component; vectors of different lengths do not link. Rows without an id keep a
null component, link with nothing and are kept. Repeated rows of one id are one vector, the least by label and components. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, table

COSINE = 0.93
#: Vectors sampled (about so many, by a hash) over the whole table for the upper levels, centres of a label, and vectors of a block.
SAMPLE, CENTRES, BLOCK = 8192, 32, 2048
#: Slack on bounds, over the error of a small distance (2e-8); decisions are made by the cosine itself.
SLACK = 1e-7


def unit(rows) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows are valid; rows are of one length, or else only the longest are."""
    wide = max((len(v) for v in rows if v is not None), default=0)
    x, good = np.zeros((len(rows), wide)), np.zeros(len(rows), dtype=bool)
    for i, v in enumerate(rows):
        if v is not None and len(v) == wide and wide:
            a = np.array([np.nan if c is None else c for c in v], dtype=float) if getattr(v, "dtype", None) == object else np.asarray(v, dtype=float)
            if np.isfinite(a).all() and (norm := np.linalg.norm(a)) > 0:
                x[i], good[i] = a / norm, True
    return x, good


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class Node:
    """A ball: the row of its centre, its covering radius, its rows and its children."""

    __slots__ = ("centre", "children", "radius", "rows")

    def __init__(self, centre: int, radius: float, rows: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, level: float = 1.0, finest: float = 0.02) -> Node:
    """Nested nets: a node's rows are covered by centres that are over `level` apart, the node's own centre first;
    each centre's rows make a child with half the level."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = int(rows[0])
    if len(rows) == 1:
        return Node(centre, 0.0, rows, [])
    own_x = x[rows]
    nearest = distances(own_x, x[[centre]])[:, 0]
    radius = float(nearest.max())
    if radius <= finest:
        return Node(centre, radius, rows, [])
    while radius <= level:  # levels at which the centre covers all
        level /= 2
    owner, centres = np.zeros(len(rows), dtype=np.int64), [0]
    far = np.flatnonzero(nearest > level)
    while len(far):
        some = far[:128]  # the next centres, as many at once as are apart from each other
        apart, new = distances(own_x[some], own_x[some]) > level, [0]
        for i in range(1, len(some)):
            if apart[i, new].all():
                new.append(i)
        d = distances(own_x, own_x[some[new]])
        best = d.argmin(1)
        least = d[np.arange(len(rows)), best]
        closer = least < nearest
        owner[closer], nearest[closer] = len(centres) + best[closer], least[closer]
        centres += some[new].tolist()
        far = far[nearest[far] > level]
    children = []
    for k, c in enumerate(centres):
        own = rows[owner == k]
        if len(own):
            children.append(cover_tree(x, np.concatenate(([rows[c]], own[own != rows[c]])), level / 2, finest))
    return Node(centre, radius, rows, children)


class Forest:
    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[a] = b
            self.edges.append((i, j))


def dual_traversal(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of x and of y, and a spanning forest over (row of x, len(x) + row of y) or, for
    the same block twice, over its rows."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    nx, ny = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    shift = 0 if same else len(x)
    forest = Forest(len(x) + (0 if same else len(y)))
    tx = cover_tree(x)
    ty = tx if same else cover_tree(y)

    def link(a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> None:
        """Count the links of a matrix of rows; its connected parts are walked so that each row is reached once."""
        nx[a] += hit.sum(1)
        ny[b] += hit.sum(0)
        new_a, new_b = hit.any(1), hit.any(0)
        for start in np.flatnonzero(new_a).tolist():
            if not new_a[start]:
                continue
            new_a[start] = False
            todo = [(start, True)]
            while todo:
                i, is_a = todo.pop()
                if is_a:
                    more = np.flatnonzero(hit[i] & new_b)
                    new_b[more] = False
                    pairs = [(i, j) for j in more.tolist()]
                else:
                    more = np.flatnonzero(hit[:, i] & new_a)
                    new_a[more] = False
                    pairs = [(j, i) for j in more.tolist()]
                for i2, j2 in pairs:
                    forest.join(int(a[i2]), shift + int(b[j2]))
                todo += [(k, not is_a) for k in more.tolist()]

    stack = [([tx], [ty])]
    while stack:
        left, right = stack.pop()
        d = distances(x[[n.centre for n in left]], y[[n.centre for n in right]])
        ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        reach = ra[:, None] + rb[None, :]
        near = d <= limit + reach + SLACK
        inside = d + reach <= limit - SLACK
        one_x, one_y = np.array([len(n.rows) == 1 for n in left]), np.array([len(n.rows) == 1 for n in right])
        if (both := inside[one_x][:, one_y]).any():
            link(np.array([n.centre for n, o in zip(left, one_x, strict=True) if o]), np.array([n.centre for n, o in zip(right, one_y, strict=True) if o]), both)
        for i, j in zip(*np.nonzero(inside & ~(one_x[:, None] & one_y[None, :])), strict=True):
            a, b = left[i].rows, right[j].rows
            nx[a] += len(b)
            ny[b] += len(a)
            for r in a.tolist():
                forest.join(r, shift + int(b[0]))
            for r in b.tolist():
                forest.join(int(a[0]), shift + r)
        open_ = near & ~inside
        single = np.array([not n.children for n in left])[:, None] & np.array([not n.children for n in right])[None, :]
        for i, j in zip(*np.nonzero(open_ & single), strict=True):
            a, b = left[i].rows, right[j].rows
            link(a, b, x[a] @ y[b].T >= cosine)
        opened = open_ & ~single
        for i in np.flatnonzero(opened.any(1)):
            js = np.flatnonzero(opened[i])
            ca = left[i].children or [left[i]]
            cb = [c for j in js for c in (right[j].children or [right[j]])]
            for k in range(0, len(cb), 4096):
                stack.append((ca, cb[k : k + 4096]))
    if same:
        nx -= 1  # each row meets itself
    return nx, ny, forest.edges


def _valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, rows in batch.groupby("label"):  # of one length
            x, good = unit(list(rows["v"]))
            yield pd.DataFrame({"id": rows["id"][good], "label": rows["label"][good], "v": [r.tolist() for r in x[good]]})


def upper_levels(x: np.ndarray, most: int = CENTRES) -> np.ndarray:
    """The finest nested net, of radii 1, 1/2, 1/4 ..., that has at most `most` centres (one at least)."""
    net = [0]
    radius = 1.0
    while radius > 0.05:
        grown, nearest = list(net), distances(x, x[net]).min(1)
        while len(grown) <= most and nearest.max() > radius:
            grown.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(x, x[[grown[-1]]])[:, 0])
        if len(grown) > most:
            break
        net, radius = grown, radius / 2
    return x[net]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    # of rows that repeat an id the least (label, vector) stands; vectors of different lengths are never compared, so the length is part of the label
    good = rows.where("id is not null and label is not null and v is not null").groupBy("id").agg(F.min(F.struct("label", F.col("v").cast("array<double>").alias("v"))).alias("x"))
    good = good.select("id", F.concat_ws("|", F.size("x.v"), "x.label").alias("label"), "x.v")
    good = materialise(good.mapInPandas(_valid, "id long, label string, v array<double>"))

    # by a threshold on a hash, so that no more than the sample leaves the executors
    part = min(1.0, sample / max(1, good.count()))
    some = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(part * (1 << 20))).select("id", "label", "v").collect()
    some.sort(key=lambda r: r["id"])
    by_label: dict[str, list] = {}
    for r in some:
        by_label.setdefault(r["label"], []).append(r["v"])
    nets = {label: upper_levels(np.array(v)) for label, v in by_label.items()}  # about `sample` vectors in all

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, d = np.zeros(len(batch), dtype=np.int32), np.full(len(batch), 2.0)
            for label, at in batch.groupby("label").indices.items():
                if label in nets:
                    all_d = distances(np.stack(batch["v"].iloc[at].to_list()), nets[label])
                    cell[at], d[at] = all_d.argmin(1), all_d.min(1)
            yield batch.assign(cell=cell, d=d)

    placed = good.mapInPandas(to_cells, "id long, label string, v array<double>, cell int, d double")
    cells = placed.groupBy("label", "cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    cells = materialise(cells)
    placed = placed.drop("d").join(cells.select("label", "cell", "parts"), ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    # pairs of cells of a label whose balls come within reach of each other, then pairs of their blocks
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    distance = {label: distances(net, net) for label, net in nets.items()}
    a, b = cells.select("label", F.struct("cell", "radius", "parts").alias("a")), cells.select("label", F.struct("cell", "radius", "parts").alias("b"))
    pairs = a.join(b, "label").where("a.cell <= b.cell")

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [label not in distance or distance[label][p["cell"], q["cell"]] <= p["radius"] + q["radius"] + limit + SLACK for label, p, q in zip(batch["label"], batch["a"], batch["b"], strict=True)]
            out = batch[keep]
            yield pd.DataFrame({"label": out["label"], "ca": [p["cell"] for p in out["a"]], "cb": [q["cell"] for q in out["b"]], "pa": [p["parts"] for p in out["a"]], "pb": [q["parts"] for q in out["b"]]})

    pairs = pairs.mapInPandas(reachable, "label string, ca int, cb int, pa int, pb int")
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pa") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pb") - 1))).where("ca < cb or i <= j")
    pairs = materialise(pairs.select("label", "ca", "cb", "i", "j", F.xxhash64("label", "ca", "cb", "i", "j").alias("pair")))
    left = pairs.select("pair", "label", F.col("ca").alias("cell"), F.col("i").alias("part"), F.lit(0).alias("side"))
    right = pairs.where("ca < cb or i < j").select("pair", "label", F.col("cb").alias("cell"), F.col("j").alias("part"), F.lit(1).alias("side"))
    sides = placed.join(left.unionByName(right), ["label", "cell", "part"]).select("pair", "side", "id", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = not len(two)
        if not len(one):
            return pd.DataFrame({"id": [], "n": [], "other": []}).astype("int64")
        other = one if same else two
        x = np.stack(one["v"].to_list())
        nx, ny, edges = dual_traversal(x, x if same else np.stack(other["v"].to_list()), cosine, same)
        ids = one["id"].to_numpy() if same else np.concatenate((one["id"].to_numpy(), other["id"].to_numpy()))
        n = nx if same else np.concatenate((nx, ny))
        some = np.flatnonzero(n)
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"id": np.concatenate((ids[some], ids[e[:, 0]])), "n": np.concatenate((n[some], np.zeros(len(e), dtype=np.int64))), "other": np.concatenate((ids[some], ids[e[:, 1]]))})

    links = materialise(sides.groupBy("pair").applyInPandas(compare, "id long, n long, other long"))
    counts = links.where("n > 0").groupBy("id").agg(F.sum("n").alias("n_links"))
    group = components(links.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    out = rows.select("id").join(counts, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op2_sql() -> str:
    """All pairs of a label, then the closure of the links."""
    return f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
g as (select vec_id, label, e from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {COSINE}),
r as (select vec_id as id, vec_id as reached from embeddings union select r.id, l.b from r join l on r.reached = l.a),
c as (select id, min(reached) as component_id from r group by id),
n as (select a, count(*) as n_links from l group by a)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, c.component_id::bigint as component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.id = e.vec_id left join n on n.a = e.vec_id"""
