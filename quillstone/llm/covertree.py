"""Embedding near-duplicates by dual traversal of cover trees.

On unit vectors cosine >= c is distance <= sqrt(2 - 2c). Equal vectors are one class, so that a vector which many rows hold
is compared once. The upper level of the tree, for each length of vectors, is a set of pivots: every vector lives in the
cell of its nearest pivot, cells too large for one task are cut into blocks, and a vector visits another block only if its
distance to that cell's pivot is within the cell's covering radius plus the threshold distance. Of two blocks one is at
home and the other visits, in turns, so that each block is host to about half of the others. In a task the block at home
and each visiting block get a cover tree (nested levels, halving radii, exact covering radii, built when asked for), and
pairs of nodes are expanded together: a pair is dropped if its centres are farther apart than both radii and the threshold
distance together. Where the nodes left over have few members, these are compared at once. What is left is decided by the
cosine in double precision, so the pairs are exact; the pivots only decide how much work is saved.

Kernels return a count and one edge for each linked vector, never the pairs. Visitors stream past a block at home, some
thousands at a time. Nodes and members are compared in tiles, one path down the trees at a time, and pairs are counted and
joined as they are found, so that a task holds a block, its tree and one tile, whatever links or stays in reach. Where vectors are so far apart that no bound prunes, each travels once for every second block: blocks
grow with the table up to ``MOST`` numbers, so that up to millions of vectors a vector travels to a fixed number of tasks.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import groups, representative, resolve, roots
from .util import Scratch, bounded_batches, lowest, slices

COSINE = 0.95
#: Blocks that vectors of one length are cut into, unless they would have fewer vectors than ``LEAST`` or more numbers than
#: ``MOST``; the most pivots of a length, the lengths that get any, the vectors that all pivots are chosen from, and the
#: visitors treated at a time.
BLOCKS, LEAST, MOST, PIVOTS, LENGTHS, SAMPLE, VISITORS = 16, 256, 1 << 22, 1024, 16, 4096, 8192
#: Vectors of a block and numbers of visitors treated at a time: bounds for short and for long vectors.
ROWS, VISITING = 1 << 18, 1 << 20
#: Tasks for each block, as long as they are not more than so many together.
TASKS, MOST_TASKS = 8, 4096
#: Slack on distances and on cosines in single precision: bounds must never drop a pair that the cosine would link.
SLACK = 1e-5
#: Candidates for centres looked at together, and pairs of members that are compared without looking further down.
CENTRES, SMALL = 256, 4096
#: Side of the tiles that nodes and members are compared in, so that they stay in a core's cache; found pairs held at most,
#: but for one tile's.
SIDE, PAIRS = 512, 1 << 18


def unit(x: np.ndarray) -> np.ndarray:
    """The rows scaled to length 1; first by their largest component, so that no square overflows or vanishes. Rows that
    are zero or hold non-finite numbers become NaN."""
    with np.errstate(all="ignore"):
        most = np.abs(x).max(1, initial=0.0)
        x = x / np.where(np.isfinite(most) & (most > 0), most, np.nan)[:, None]
        return x / np.sqrt((x * x).sum(1))[:, None]


def matrix(column) -> np.ndarray:
    """A column of lists of one length, without nulls, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def scaled(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The lists of a column scaled to length 1, chunk by chunk, so that little is held beside the result."""
    x, at = np.empty((len(column), dim)), 0
    for chunk in column.chunks:
        x[at : at + len(chunk)] = unit(matrix(chunk))
        at += len(chunk)
    return x


class Node:
    __slots__ = ("centre", "radius", "children", "members", "_table")

    def __init__(self, centre: int, radius: float, members: np.ndarray, children: list | None = None):
        self.centre, self.radius, self.members, self.children, self._table = centre, radius, members, children, None

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and sizes of the children."""
        if self._table is None:
            self._table = tuple(np.array(x) for x in zip(*((n.centre, n.radius, len(n.members)) for n in self.children)))
        return self._table


class CoverTree:
    """Nodes over rows of ``x``; a node's children have centres farther apart than half its radius and cover it. Levels are
    built when they are asked for."""

    def __init__(self, x: np.ndarray):
        self.x, self.short = x, x.astype(np.float32)
        self.root = Node(0, 2.0, np.arange(len(x))) if len(x) else None

    def children(self, node: Node) -> list[Node]:
        """The next level below, small nodes first: radius halved; a single vector, or equal ones, stay."""
        if node.children is None:
            node.children = []
            if len(node.members) > 1 and node.radius > SLACK:
                near_enough, left = 1 - (node.radius / 2) ** 2 / 2, node.members
                while len(left):
                    # of the next vectors those are centres that no centre before them covers
                    seeds = self.x[left[:CENTRES]]
                    covers, free, chosen = seeds @ seeds.T >= near_enough, np.ones(len(seeds), bool), []
                    for k in range(len(seeds)):
                        if free[k]:
                            chosen.append(k)
                            free &= ~covers[k]
                    # and each vector goes to the first centre that covers it
                    first, cosine = np.empty(len(left), int), np.empty(len(left))
                    for at in range(0, len(left), SIDE):
                        c = self.x[left[at : at + SIDE]] @ seeds[chosen].T
                        near = c >= near_enough
                        k = near.argmax(1)
                        first[at : at + SIDE] = np.where(near.any(1), k, -1)
                        cosine[at : at + SIDE] = c[np.arange(len(c)), k]
                    first[chosen], cosine[chosen] = np.arange(len(chosen)), 1.0
                    order = np.argsort(first, kind="stable")
                    cuts = np.searchsorted(first[order], np.arange(len(chosen) + 1))
                    for k, centre in enumerate(left[chosen]):
                        at = order[cuts[k] : cuts[k + 1]]
                        radius = sqrt(max(0.0, 2 - 2 * float(cosine[at].min()))) if len(at) > 1 else 0.0
                        node.children.append(Node(int(centre), radius, left[at]))
                    left = left[first < 0]
                node.children.sort(key=lambda n: len(n.members))
        return node.children


def _floor(reach: float, *radii) -> np.ndarray:
    """The cosine of two centres below which no members of their nodes can be within reach."""
    return 1 - np.minimum(reach + sum(radii), 2.0) ** 2 / 2 - SLACK


def tiles(m: int, n: int, itself: bool):
    """Ranges that cover m by n; of something with itself each two ranges once."""
    for u in range(0, m, SIDE):
        for v in range(u if itself else 0, n, SIDE):
            yield slice(u, u + SIDE), slice(v, v + SIDE)


def compared(a: CoverTree, i: np.ndarray, b: CoverTree, j: np.ndarray, least: float, itself: bool):
    """Index pairs (of i, of j) with cosine >= ``least``, those of one tile at a time."""
    for u, v in tiles(len(i), len(j), itself):
        left, right = i[u], j[v]
        if len(left) * len(right) > SMALL:
            near = a.short[left] @ b.short[right].T >= np.float32(least - SLACK)
            if not near.any():
                continue
            if np.count_nonzero(near) <= 2 * SIDE:
                p, q = np.nonzero(np.triu(near, 1) if itself and u == v else near)
                p, q = left[p], right[q]
                exact = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= least
                yield p[exact], q[exact]
                continue
        near = a.x[left] @ b.x[right].T >= least
        p, q = np.nonzero(np.triu(near, 1) if itself and u == v else near)
        if len(p):
            yield left[p], right[q]


def pairs(a: CoverTree, p: Node, b: CoverTree, q: Node, reach: float, least: float):
    """Index pairs (below p of a, below q of b) with cosine >= ``least``, some at a time; of a node with itself each pair
    once, either way round. Only the path down to the tile at hand is held."""
    itself = a is b and p is q
    if len(p.members) * len(q.members) <= SMALL or not (a.children(p) or b.children(q)):
        yield from compared(a, p.members, b, q.members, least, itself)
        return
    left, right = a.children(p) or [p], b.children(q) or [q]
    lc, lr, ln = p.table() if p.children else (np.array([p.centre]), np.array([p.radius]), np.array([len(p.members)]))
    rc, rr, rn = q.table() if q.children else (np.array([q.centre]), np.array([q.radius]), np.array([len(q.members)]))
    for u, v in tiles(len(left), len(right), itself):
        if ln[u][-1] == rn[v][-1] == 1:  # single vectors, as the small nodes come first
            yield from compared(a, lc[u], b, rc[v], least, itself and u == v)
            continue
        near = a.short[lc[u]] @ b.short[rc[v]].T >= _floor(reach, lr[u].astype(np.float32)[:, None], rr[v].astype(np.float32))
        if itself and u == v:
            near = np.triu(near)
        some = np.count_nonzero(near)
        if some and int(ln[u].sum()) * int(rn[v].sum()) <= SMALL * some:
            members = [np.concatenate([n.members for n in nodes]) for nodes in (left[u], right[v])]
            yield from compared(a, members[0], b, members[1], least, itself and u == v)
        else:
            for s, t in zip(*np.nonzero(near)):
                yield from pairs(a, left[u.start + s], b, right[v.start + t], reach, least)


def traversal(a: CoverTree, b: CoverTree, reach: float, least: float):
    """Index pairs (i of a, j of b) with cosine >= ``least``, some at a time; for a tree with itself each pair once."""
    if a.root and b.root:
        yield from pairs(a, a.root, b, b.root, reach, least)


def dual(a: CoverTree, b: CoverTree, reach: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the traversal together; for a tree with itself with i < j."""
    found = [(np.array([], int),) * 2, *traversal(a, b, reach, least)]
    i, j = (np.concatenate(x) for x in zip(*found))
    return (np.minimum(i, j), np.maximum(i, j)) if a is b else (i, j)


def links_of(ids: np.ndarray, copies: np.ndarray, found) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``ids`` the copies that it is linked to, and the least id that the links connect it to, from index pairs
    that come some at a time."""
    links, label = np.zeros(len(ids)), np.arange(len(ids))
    order = np.argsort(ids, kind="stable")  # the root is the least class
    rank = np.argsort(order, kind="stable")

    def fold(held: list) -> None:
        nonlocal links, label
        i, j = (np.concatenate(x) for x in zip(*held))
        links += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        p, q = label[rank[i]], label[rank[j]]
        apart = p != q
        if apart.any():
            label = roots(len(ids), p[apart], q[apart])[label]

    held, n = [], 0
    for i, j in found:
        held.append((i, j))
        n += len(i)
        if n >= PAIRS or len(held) >= PAIRS >> 6:
            fold(held)
            held, n = [], 0
    if held:
        fold(held)
    return links.astype(np.int64), ids[order[label[rank]]]


def pivots_of(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of ``x``, each the farthest from those before."""
    chosen, d = [0], np.full(len(x), np.inf)
    while len(chosen) < min(most, len(x)):
        d = np.minimum(d, 1 - x @ x[chosen[-1]])
        if d.max() <= SLACK:
            break
        chosen.append(int(d.argmax()))
    return x[chosen]


def upper_level(classes: DataFrame) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """How many vectors there are of each of the ``LENGTHS`` commonest lengths, and pivots for those that fill more than one
    block: a row for each length and at most ``SAMPLE`` vectors come to the driver."""
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    wanted = {d: min(PIVOTS, parts_of(n, d)) for d, n in sizes.items() if parts_of(n, d) > 1}
    if not wanted:
        return sizes, {}
    enough = 2 * SAMPLE / sum(sizes[d] for d in wanted)
    drawn = classes.where(F.col("dim").isin(list(wanted)) & lowest(F.xxhash64("digest"), enough)).orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE)
    found: dict[int, list] = {}
    for r in drawn.select("dim", "v").collect():
        found.setdefault(r["dim"], []).append(r["v"])
    return sizes, {d: pivots_of(unit(np.array(v, np.float64)), wanted[d]) for d, v in found.items()}


def parts_of(n: int, dim: int) -> int:
    """Into how many blocks n vectors of a length are cut."""
    return max(1, min(BLOCKS, n // LEAST), -(-n * dim // MOST), -(-n // ROWS))


def links_between(classes: DataFrame, kind: str, cosine: float, scratch: Scratch) -> DataFrame:
    """(cls, links, root, settled) for ``resolve``, from classes (cls, digest, dim, copies, v) of distinct vectors."""
    spark = classes.sparkSession
    reach = sqrt(2 - 2 * cosine) + SLACK
    sizes, chosen = upper_level(classes)
    pivots = spark.sparkContext.broadcast(chosen)

    def assign(batches):
        """The cell of each vector and its distance to the pivot; a length without pivots is one cell of radius 2."""
        p = pivots.value
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell, d = np.zeros(len(dims), np.int32), np.full(len(dims), 2.0)
            for dim in np.unique(dims):
                if dim in p:
                    at = np.flatnonzero(dims == dim)
                    c = unit(matrix(b.column("v").take(pa.array(at)))) @ p[dim].T
                    cell[at] = c.argmax(1)
                    d[at] = np.sqrt(np.maximum(0, 2 - 2 * c.max(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d)], names=[*b.schema.names, "cell", "d"])

    homes = classes.select("cls", "dim", "copies", "v").mapInArrow(assign, f"cls long, dim int, copies long, v {kind}, cell int, d double")
    homes = scratch.table(homes, "cells")
    cells = homes.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("d").alias("r"))
    # a row for each pivot: the blocks of each cell, numbered through within a length
    units: dict[int, list[tuple[int, float, int]]] = {}
    for r in cells.where(F.col("dim").isin(list(sizes))).orderBy("dim", "cell").collect() if sizes else []:
        share = -(-sizes[r["dim"]] // parts_of(sizes[r["dim"]], r["dim"]))
        units.setdefault(r["dim"], []).extend((r["cell"], r["r"], part) for part in range(-(-r["n"] // max(1, share))))
    placed = spark.sparkContext.broadcast(units)
    # rarer lengths have no pivots; how many blocks they have stays in a table
    parts = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("n") / LEAST)), F.ceil(F.col("n") * F.col("dim") / MOST), F.ceil(F.col("n") / ROWS)).cast("int")
    homes = homes.join(cells.groupBy("dim").agg(F.sum("n").alias("n")).select("dim", parts.alias("parts")), "dim")

    def visit(batches):
        """Every vector at home in its block, and as a visitor of the blocks in reach that are host to its own."""
        p, known = pivots.value, placed.value
        for b in batches:
            dims, cell = b.column("dim").to_numpy(), b.column("cell").to_numpy()
            hashed = b.column("cls").to_numpy() * 2654435761 % (1 << 31)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                blocks = known.get(dim) or [(0, 2.0, part) for part in range(b.column("parts")[int(at[0])].as_py())]
                of_cell = np.array([c for c, *_ in blocks])
                first, count = np.searchsorted(of_cell, cell[at]), np.searchsorted(of_cell, cell[at], "right") - np.searchsorted(of_cell, cell[at])
                home = first + hashed[at] % count
                near = np.ones((len(at), len(blocks)), bool)
                if dim in p:
                    x = unit(matrix(b.column("v").take(pa.array(at))))
                    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ p[dim].T)))
                    near = d[:, of_cell] <= np.array([r for _, r, _ in blocks]) + reach
                number = np.arange(len(blocks))
                hosts = ((home[:, None] + number) % 2 == 0) == (number < home[:, None])  # of two blocks the lesser if their sum is even
                row, block = np.nonzero((near & hosts) | (number == home[:, None]))
                cols = [np.full(len(row), dim, np.int32), block.astype(np.int32), np.where(block == home[row], -1, home[row]).astype(np.int32)]
                took = [b.column(c).take(pa.array(at[row])) for c in ("cls", "copies", "v")]
                yield from slices([pa.RecordBatch.from_arrays([*map(pa.array, cols), *took], names=["dim", "block", "visitor", "cls", "copies", "v"])], 4096)

    def compare(batches):
        def linked(ids, copies, found):
            links, root = links_of(ids, copies, found)
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some]), pa.array([False] * len(some))], names=["cls", "links", "root", "settled"])

        here, tree, ids, copies = None, None, None, None
        for (dim, block, visitor), rows in streamed(batches):
            x, cls, times = scaled(rows.column("v"), dim), rows.column("cls").to_numpy(), rows.column("copies").to_numpy()
            del rows
            if visitor < 0:
                here, ids, copies, tree = (dim, block), cls, times, CoverTree(x)
                found = linked(ids, copies, traversal(tree, tree, reach, cosine))
            elif here == (dim, block):
                shifted = ((i, j + len(ids)) for i, j in traversal(tree, CoverTree(x), reach, cosine))
                found = linked(np.concatenate([ids, cls]), np.concatenate([copies, times]), shifted)
            else:
                continue
            if found.num_rows:
                yield from slices([found], 4096)

    def streamed(batches):
        """Home rows of a block together; each visiting block's rows a bounded number at a time."""

        def taken():
            table = pa.concat_tables(held)
            held.clear()
            return table

        held, last = [], None
        for b in slices(batches, VISITORS):
            for k, rows in groups([b], ["dim", "block", "visitor"]):
                if held and (k != last or (k[2] >= 0 and sum(t.num_rows for t in held) >= min(VISITORS, VISITING // k[0]))):
                    yield last, taken()
                last = k
                held.append(rows)
        if held:
            yield last, taken()

    dealt = homes.mapInArrow(visit, f"dim int, block int, visitor int, cls long, copies long, v {kind}")
    # by number, so that Spark does not put small blocks together, which take much computing; and into more tasks than there
    # are blocks, so that few have two
    blocks = sum(map(len, units.values()))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks, min(TASKS * blocks, MOST_TASKS))
    dealt = dealt.repartition(tasks, "dim", "block").sortWithinPartitions("dim", "block", "visitor")
    return scratch.table(dealt.mapInArrow(compare, "cls long, links long, root long, settled boolean"), "links")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors with cosine >= ``cosine``), component_id (least id reachable by links),
    kept (the row has that id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep their own id.
    Vectors of different lengths do not link with each other. Repeated rows are vectors of their own. A null id is kept.
    Only ``key`` and ``vector`` are read, so labels and other columns play no part; an empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    scratch = Scratch()
    # single-precision vectors travel as such and are scaled where they are compared: half the bytes, the same cosines
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"

    def digests(batches):
        for b in batches:
            column = b.column(2)
            dims = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            digest: list[bytes | None] = [None] * len(dims)
            for dim in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == dim)
                part = column.take(pa.array(at)).flatten()
                whole = ~part.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(1)
                x = part.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0  # no negative zeros
                for k in np.flatnonzero(whole & np.isfinite(x).all(1) & (x != 0).any(1)):
                    digest[at[k]] = xxhash.xxh3_128_digest(x[k].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(digest, pa.binary())], names=["rid", "vec_id", "v", "dim", "digest"])

    source = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    rows = scratch.table(source.mapInArrow(digests, f"rid long, vec_id {source.schema['vec_id'].dataType.simpleString()}, v {kind}, dim int, digest binary"), "vectors")
    grouped = rows.where("digest is not null").groupBy("digest", "dim")
    classes = grouped.agg(representative("vec_id", "rid").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = scratch.table(classes.withColumn("cls", F.col("rep.rid")), "classes")
    found = links_between(classes, kind, cosine, scratch)
    out = resolve(rows.drop("v", "dim"), classes, found, "vec_id", scratch)
    scratch.close(rows, scratch.tables[-1][0])  # the result reads the vectors' ids and what resolve wrote last
    return out.select("vec_id", "n_links", "component_id", "kept")
