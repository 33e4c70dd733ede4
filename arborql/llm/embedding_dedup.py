"""Embedding near-dedup: PCA-ordered tiled comparison by cosine.

Equal vectors are merged first (a vector with its number of rows). The directions of most variance come from
the centred second moments of all vectors. A tree of splits along the leading directions, fitted on a bounded sample,
cuts the rows into leaves, and leaves into tiles of ROWS_A_TILE at most, ties by their number. The tiles' boxes over the
leading directions are a table of their own; tiles whose boxes are too far apart for any link are not compared, and
those that may be near find one another by the grid cells that they cover.

Two tiles first meet in their leading dimensions: with x = (x1, x2) rotated and of length 1,
x.y <= x1.y1 + |x2||y2|, which is a matrix product over the leading dimensions and one more column of suffix norms.
Only the rows with a pair that reaches the threshold come again with whole vectors; where a few pairs of tiles show that
most do, all come at once. Their products go on dimension by
dimension, over the rows and columns that still have such a pair, and what remains is decided in double precision. Two
tiles return link counts and a spanning forest, never links, so a large group of near copies costs rows in proportion
to its size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborql.llm.common import connected_components
from arborql.llm.tiles import components

#: Leading dimensions after which pairs are tested, as shares of all.
STAGES = (0.25, 0.5, 1.0)
ROWS_A_TILE = 4096
ROWS_AT_ONCE = 256
#: Directions of the tiles' boxes and of the tree's splits, those of the grid, and vectors that the tree is fitted on.
BOX, GRID, SAMPLE = 8, 3, 1 << 16
#: Parts that the sample's share of the vectors is counted in, and the least width of a grid cell.
SHARES, CELL = 1 << 40, 0.25
#: Pairs of tiles that are tried first (about), and the share of their rows beyond which all rows go on.
PROBED, MOST_GO_ON = 8, 0.5
#: Room for rounding in the bounds; what passes is decided on the whole vectors.
ROOM = 1e-9


def parsed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): little-endian doubles of usable vectors, null for null, empty, zero, and non-finite ones."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            sizes = np.asarray(pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes)
            out = []
            for e, n in zip(ends, sizes):
                v = flat[e - n:e] + 0.0  # -0.0 becomes 0.0
                out.append(v.tobytes() if n and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "id long, vec binary")


def unit(batch_col) -> np.ndarray:
    x = np.frombuffer(b"".join(batch_col), dtype="<f8").reshape(len(batch_col), -1)
    # scaled first, so that the squares of very large or small components stay in range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors(vec) the orthonormal directions by falling variance. Centred second moments are summed
    within partitions, then in two rounds of groups, as one block a length; a block a length comes to the driver."""
    kind = "d int, part int, n long, m binary"

    def block(d: int, part: int, n: int, m: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([n]), pa.array([m.tobytes()], pa.binary())], ["d", "part", "n", "m"])

    def run(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            by: dict[int, list[bytes]] = {}
            for v in b.column("vec").to_pylist():
                by.setdefault(len(v) // 8, []).append(v)
            for d, vs in by.items():
                x = unit(vs)
                n, m = total.get(d, (0, 0))
                total[d] = n + len(x), m + np.vstack([x.T @ x, x.sum(axis=0)])
        for k, (d, (n, m)) in enumerate(total.items()):
            yield block(d, (n + k) % 16, n, m)

    def add(key, t):
        d = t.column("d")[0].as_py()
        m = sum(np.frombuffer(x, "<f8") for x in t.column("m").to_pylist())
        return pa.Table.from_batches([block(d, 0, sum(t.column("n").to_pylist()), m)])

    sums = vectors.select("vec").mapInArrow(run, kind).groupBy("d", "part").applyInArrow(add, kind).groupBy("d").applyInArrow(add, kind)
    out = {}
    for r in sums.collect():
        m = np.frombuffer(r["m"], "<f8").reshape(r["d"] + 1, r["d"])
        mean = m[-1] / r["n"]
        c = m[:-1] / r["n"] - np.outer(mean, mean)
        out[r["d"]] = np.linalg.eigh((c + c.T) / 2)[1][:, ::-1].copy()
    return out


class Splits:
    """A tree of splits at medians of a sample, along the direction of most spread, with at most ``leaves`` leaves."""

    def __init__(self, z: np.ndarray, leaves: int):
        self.dim, self.at, self.kids, self.leaf = [], [], [], []
        self._grow(z, leaves)
        self.dim, self.at, self.kids, self.leaf = np.array(self.dim), np.array(self.at), np.array(self.kids), np.array(self.leaf)

    def _grow(self, z: np.ndarray, leaves: int) -> int:
        me = len(self.dim)
        self.dim.append(-1), self.at.append(0.0), self.kids.append([me, me]), self.leaf.append(me)
        if leaves > 1 and len(z) > 1:
            k = int(np.argmax(z.max(axis=0) - z.min(axis=0)))
            cut = float(np.median(z[:, k]))
            right = z[:, k] >= cut
            if right.all():
                cut = float(z[:, k].max())
                right = z[:, k] >= cut
            if not right.all():
                self.dim[me], self.at[me] = k, cut
                self.kids[me] = [self._grow(z[~right], leaves // 2), self._grow(z[right], leaves - leaves // 2)]
        return me

    def find(self, z: np.ndarray) -> np.ndarray:
        at = np.zeros(len(z), np.int64)
        while True:
            k = self.dim[at]
            inner = k >= 0
            if not inner.any():
                return at
            go = z[np.arange(len(z)), np.maximum(k, 0)] >= self.at[at]
            at = np.where(inner, self.kids[at, go.astype(int)], at)


def leading(x: np.ndarray, basis: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(the rotated rows, their leading dimensions with the norm of the rest as one more column)."""
    z = x if basis is None else x @ basis
    m = cuts_of(x.shape[1])[0]
    return z, np.hstack([z[:, :m], np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", z[:, m:], z[:, m:])))[:, None]])


def cuts_of(d: int) -> list[int]:
    return sorted({min(d, max(1, math.ceil(d * s))) for s in STAGES})


def reaching(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a and of b (None: of a itself) have a pair that their leading dimensions let reach the threshold."""
    own = b is None
    b = a if own else b
    rows, cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for s in range(0, len(a), ROWS_AT_ONCE):
        hit = a[s:s + ROWS_AT_ONCE] @ b.T >= threshold - ROOM
        if own:
            hit[np.arange(len(hit)), s + np.arange(len(hit))] = False
        rows[s:s + ROWS_AT_ONCE] = hit.any(axis=1)
        cols |= hit.any(axis=0)
    return (rows | cols, rows | cols) if own else (rows, cols)


def compare(x: np.ndarray, y: np.ndarray, basis: np.ndarray | None, threshold: float):
    """Yields (row indices, column indices) of the pairs of unit rows with cosine >= threshold, by blocks of rows. Each
    stage adds the products over its dimensions, for the rows and columns that still have a pair within the bound."""
    cuts, low = cuts_of(x.shape[1]), threshold - ROOM
    zx, zy = (x, y) if basis is None else (x @ basis, y @ basis)
    rest = lambda z, m: np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", z[:, m:], z[:, m:])))
    rx, ry = {m: rest(zx, m) for m in cuts}, {m: rest(zy, m) for m in cuts}
    for s in range(0, len(x), ROWS_AT_ONCE):
        i, j, part, begin = np.arange(s, min(len(x), s + ROWS_AT_ONCE)), np.arange(len(y)), None, 0
        on = None
        for m in cuts:
            more = zx[i, begin:m] @ zy[j, begin:m].T
            part = more if part is None else part + more
            hit = part + np.outer(rx[m][i], ry[m][j]) >= low
            on = hit if on is None else on & hit
            r, c = np.flatnonzero(on.any(axis=1)), np.flatnonzero(on.any(axis=0))
            i, j, part, on, begin = i[r], j[c], part[np.ix_(r, c)], on[np.ix_(r, c)], m
            if not len(i):
                break
        if not len(i):
            continue
        sure = on & (part >= threshold + ROOM)
        a, b = np.nonzero(on & ~sure)  # too near to call by a sum in stages
        for k in range(0, len(a), 1 << 16):
            p, q = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
            sure[p, q] = np.einsum("ij,ij->i", x[i[p]], y[j[q]]) >= threshold
        a, b = np.nonzero(sure)
        if len(a):
            yield i[a], j[b]


def tile_pairs(tiles: DataFrame, gap: float) -> DataFrame:
    """(d, i, j), i <= j, of the tiles(d, tile, lo, hi) whose boxes are at most ``gap`` apart. A tile is filed under the
    cells of a grid that its box covers and asks for those that the box and a margin cover, so near tiles meet by an
    equi-join. Cells are CELL wide at least, so that a tile has some hundreds of them at most, however small the gap."""
    lo, hi = (lambda k: F.get(F.col("lo"), F.lit(k))), (lambda k: F.get(F.col("hi"), F.lit(k)))
    wide = max(gap, CELL)
    cell = lambda x, more: (F.floor(x / wide) + more).cast("int")

    def filed(margin: int, name: str) -> DataFrame:
        t = tiles.select("d", F.col("tile").alias(name), F.col("lo").alias(f"lo_{name}"), F.col("hi").alias(f"hi_{name}"), *[
            F.sequence(cell(lo(k), -margin), cell(hi(k), margin)).alias(f"c{k}") for k in range(GRID)])
        for k in range(GRID):
            t = t.withColumn(f"c{k}", F.explode(f"c{k}"))
        return t

    j = filed(0, "i").join(filed(1, "j"), ["d", *[f"c{k}" for k in range(GRID)]]).where("i <= j")
    apart = F.lit(0.0)
    for k in range(BOX):
        at = lambda c: F.get(F.col(c), F.lit(k))  # noqa: E731, B023
        off = F.greatest(F.lit(0.0), at("lo_i") - at("hi_j"), at("lo_j") - at("hi_i"))
        apart = apart + off * off
    return j.where(apart <= gap * gap).select("d", "i", "j").distinct()


def tiled(reps: DataFrame, tables, rows_a_tile: int, seed_bases: dict) -> DataFrame:
    """reps(node, w, vec) with d, tile, z (its place along BOX directions) and lead (as ``leading`` has it). Lengths of
    one tile at most need no directions."""
    sizes = {r["d"]: r["n"] for r in reps.groupBy((F.octet_length("vec") / 8).cast("int").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > rows_a_tile).collect()}
    many = reps.where((F.octet_length("vec") / 8).cast("int").isin(list(sizes)))
    bases = seed_bases
    bases.update(directions(many) if sizes else {})

    def boxed(z: np.ndarray) -> np.ndarray:
        return np.hstack([z[:, :BOX], np.zeros((len(z), max(0, BOX - z.shape[1])))])

    # a sample by the vectors' own hashes: every task projects its share, and nothing is sorted
    share = F.try_element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(SHARES, SAMPLE * SHARES // n))]), (F.octet_length("vec") / 8).cast("int")) if sizes else F.lit(0)

    def project(batches):
        for b in batches:
            by: dict[int, list[bytes]] = {}
            for v in b.column(0).to_pylist():
                by.setdefault(len(v) // 8, []).append(v)
            for d, vs in by.items():
                z = boxed(unit(vs) @ bases[d][:, :BOX])
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([z.tobytes()], pa.binary())], ["d", "z"])

    points: dict[int, list[bytes]] = {d: [] for d in sizes}
    for r in many.where(F.pmod(F.xxhash64("vec"), F.lit(SHARES)) < share).select("vec").mapInArrow(project, "d int, z binary").collect() if sizes else []:
        points[r["d"]].append(r["z"])
    # batches come in any order; the splits are those of the set
    trees = {}
    for d, z in points.items():
        z = np.frombuffer(b"".join(z), "<f8").reshape(-1, BOX)
        trees[d] = Splits(z[np.lexsort(z.T)], -(-sizes[d] // rows_a_tile))

    def place(batches):
        for b in batches:
            vecs = b.column("vec").to_pylist()
            d = np.array([len(v) // 8 for v in vecs], np.int32)
            leaf, z8, lead = np.zeros(len(vecs), np.int64), np.zeros((len(vecs), BOX)), [b""] * len(vecs)
            for k in np.unique(d):
                on = np.flatnonzero(d == k)
                z, front = leading(unit([vecs[i] for i in on]), bases.get(int(k)))
                z8[on] = boxed(z)
                if int(k) in trees:
                    leaf[on] = trees[int(k)].find(z8[on])
                for i, f in zip(on, front):
                    lead[i] = f.tobytes()
            z_col = pa.FixedSizeListArray.from_arrays(pa.array(z8.ravel()), BOX).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("w"), b.column("vec"), pa.array(d), pa.array(leaf), z_col, pa.array(lead, pa.binary())], ["node", "w", "vec", "d", "leaf", "z", "lead"])

    out = tables.write(reps.select("node", "w", "vec").mapInArrow(place, "node long, w long, vec binary, d int, leaf long, z array<double>, lead binary"))
    parts = out.groupBy("d", "leaf").agg(F.expr(f"(count(*) + {rows_a_tile - 1}) div {rows_a_tile}").alias("parts"))
    tile = F.col("leaf") * (1 << 24) + F.pmod(F.xxhash64("node"), F.col("parts"))
    return out.join(parts, ["d", "leaf"]).withColumn("tile", tile).drop("leaf", "parts")


def boxes(rows: DataFrame) -> DataFrame:
    """(d, tile, n, lo, hi): the boxes of tiled rows."""
    at = lambda f: F.array(*[f(F.get(F.col("z"), F.lit(k))) for k in range(BOX)])
    return rows.groupBy("d", "tile").agg(F.count("*").alias("n"), at(F.min).alias("lo"), at(F.max).alias("hi"))


def dedup(df: DataFrame, tables, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", rows_a_tile: int = ROWS_A_TILE) -> DataFrame:
    """A row per row of df: id_col, n_links (other rows linked directly), component_id (least id reachable,
    itself included), kept (id = component_id).

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors link
    within one length only. Repeated rows and equal vectors are rows of their own, linked with one another. A
    row with a null id counts as a link, has its component's least id, and is not kept. An empty table gives
    an empty result; extra columns are not looked at. Label columns play no part."""
    rows = tables.write(parsed(df, id_col, vec_col).withColumn("fp", F.md5("vec")))
    reps = rows.where("vec is not null").groupBy("fp").agg(F.min("vec").alias("vec"), F.count("*").alias("w"), F.min("id").alias("id"))
    reps = tables.write(reps.withColumn("node", F.monotonically_increasing_id()))
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) + ROOM
    basis: dict[int, np.ndarray] = {}
    placed = tables.write(tiled(reps, tables, rows_a_tile, basis))
    pairs = tables.write(tile_pairs(boxes(placed), max(gap, 1e-3)))

    def met(row: DataFrame, pairs: DataFrame = pairs) -> DataFrame:
        """Rows of both tiles of each pair; ``left`` tells the first one's."""
        one = row.join(pairs.withColumnRenamed("i", "tile"), ["d", "tile"]).withColumn("i", F.col("tile")).withColumn("left", F.lit(True))
        two = row.join(pairs.where("i <> j").withColumnRenamed("j", "tile"), ["d", "tile"]).withColumn("j", F.col("tile")).withColumn("left", F.lit(False))
        return one.drop("tile").unionByName(two.drop("tile"))

    def near(key, t):
        lead = np.frombuffer(b"".join(t.column("lead").to_pylist()), "<f8").reshape(t.num_rows, -1)
        left = t.column("left").to_numpy(zero_copy_only=False)
        on = np.zeros(len(left), bool)
        on[left], hits = reaching(lead[left], None if left.all() else lead[~left], threshold)
        if not left.all():
            on[~left] = hits
        return t.select(["d", "i", "j", "node", "left"]).filter(pa.array(on))

    def may_link(pairs: DataFrame) -> DataFrame:
        return met(placed.select("d", "tile", "node", "lead"), pairs).groupBy("d", "i", "j").applyInArrow(near, "d int, i long, j long, node long, left boolean")

    # where a few pairs of tiles, by hash, show that the leading dimensions let most rows go on, all of them do at once:
    # the bound is then only kept within blocks, and the result is the same
    few = pairs.where(F.pmod(F.xxhash64("d", "i", "j"), F.lit(max(1, pairs.count() // PROBED))) == 0)
    every = met(placed.select("d", "tile", "node"), few).count()
    some = tables.write(may_link(pairs) if may_link(few).count() <= MOST_GO_ON * every else met(placed.select("d", "tile", "node")).select("d", "i", "j", "node", "left"))

    def block(key, t):
        d, i, j = (k.as_py() for k in key)
        mine = t.column("left").to_numpy(zero_copy_only=False)
        node, w = t.column("node").to_numpy(), t.column("w").to_numpy()
        x_all = unit(t.column("vec").to_pylist())
        xi = np.flatnonzero(mine)
        yi = xi if i == j else np.flatnonzero(~mine)
        links, a, b = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, c in compare(x_all[xi], x_all[yi], basis.get(d), threshold):
            r, c = xi[r], yi[c]
            if i == j:
                once = r < c
                r, c = r[once], c[once]
            np.add.at(links, r, w[c])
            np.add.at(links, c, w[r])
            # of a block's links only a forest is kept
            lab = components(len(node), r, c)
            on = np.flatnonzero(lab != np.arange(len(node)))
            a.append(on)
            b.append(lab[on])
        lab = components(len(node), np.concatenate(a), np.concatenate(b))
        on = np.flatnonzero(links)
        return pa.table({"node": node[on], "links": links[on], "root": node[lab[on]]})

    whole = some.join(placed.select("node", "w", "vec"), "node")
    found = tables.write(whole.groupBy("d", "i", "j").applyInArrow(block, "node long, links long, root long"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), tables)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    r = reps.select("fp", "node", "w", "id").join(counted, "node", "left").join(groups, "node", "left")
    r = r.withColumn("component", F.coalesce("component", "node"))
    least = r.groupBy("component").agg(F.min("id").alias("low"))
    r = r.join(least, "component").select(F.col("fp").alias("f"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), "low")
    j = rows.join(r, rows["fp"] == r["f"], "left")
    comp = F.when(F.col("f").isNull(), F.col("id")).otherwise(F.col("low"))
    return j.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                    F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))
