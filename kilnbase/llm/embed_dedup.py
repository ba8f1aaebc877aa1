"""Embedding near-duplicates by cosine: subspace pigeonhole join.

Method. Vectors of unit length with cosine >= c lie within squared distance D = 2 - 2c. They are
rotated and split into blocks of dimensions; the blocks' squared distances sum to the whole, so a pair
within D is within its share of D, proportional to the block's size, in one block at least. Each
block is range-joined on a grid over its first coordinates: a vector is at home in one cell and
visits the cells that its range reaches. The union over blocks of pairs within a block's budget is
then verified exactly: cosine in double precision on the vectors as they came.

A grid only helps where vectors spread over many cells. `plan` counts, on a bounded sample, the pairs that
grids of one to `GRID_DIMS` coordinates would compare in all blocks; if none compares fewer than the label as a
whole would, a label is one cell, all blocks are tested in it, and a vector is there once and not once for
each block. Either way every pair within some block's budget is verified.

No pair is emitted. In a grid a pair counts in the first block whose budget it meets, which the task can tell
as it has both vectors; a task gives link counts, and links of a spanning forest of what it saw.

Scale. Equal vectors of a label are joined as one class with a weight. Cells with more rows than fit
`CELL_BYTES` are cut into chunks, each pair of chunks a task group of its own, so no group outgrows memory and
a label or cell that a third of all rows share is spread. A vector is sent once for each chunk of its cell. What
is joined back at the end are ids and counts, not vectors.

Edge cases. Null, empty or zero vectors, and null or non-finite components: linked with nothing, as
are rows with null labels. Lengths that differ: never linked. Repeated rows are vectors of their own;
rows that share a vec_id share what is linked to any of them. Null vec_id: linked with nothing,
component null, kept false. Empty table: no rows. Further columns are ignored. Equal vectors are told by
128 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .graph import components
from .topk_search import _by_length, usable

BLOCKS = 4
GRID_DIMS = 4
SAMPLE_ROWS = 10_000
#: Bytes of vectors in one chunk of a cell.
CELL_BYTES = 4 << 20
TILE = 2048
#: Rounding of squared distances in single precision.
SLACK = 4e-6


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A fixed random rotation: it spreads a vector's mass evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Pigeonhole:
    """Blocks, budgets and cells for vectors of one length."""

    def __init__(self, dims: int, least_cosine: float, blocks: int = BLOCKS, grid: int = GRID_DIMS):
        self.turn = rotation(dims)
        edges = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
        self.blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        squared = max(0.0, 2 - 2 * least_cosine)
        # a hair wider than exact, for rounding; verification is exact
        self.budget = [squared * (b - a) / dims + 1e-9 for a, b in self.blocks]
        self.grid = grid

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.turn

    def cells(self, unit: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell number, at home) for every cell that a row's range reaches in this block."""
        a, b = self.blocks[block]
        radius = np.sqrt(self.budget[block])
        coords = unit[:, a : min(b, a + self.grid)]
        width = 2 * radius
        home = np.floor(coords / width).astype(np.int64)
        low = np.floor((coords - radius) / width).astype(np.int64)
        high = np.floor((coords + radius) / width).astype(np.int64)
        rows, cells, homes = [], [], []
        for corner in np.ndindex(*(2,) * coords.shape[1]):
            pick = np.array(corner, bool)
            at = np.where(pick, high, low)
            fresh = ~((pick & (high == low)).any(1))
            number = np.zeros(len(at), np.int64)
            for d in range(at.shape[1]):
                number = number * 100_003 + at[:, d]
            rows.append(np.flatnonzero(fresh))
            cells.append(number[fresh])
            homes.append((at == home).all(1)[fresh])
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)

    def within(self, left: np.ndarray, right: np.ndarray, block: int) -> np.ndarray:
        """Pairs within the block's budget and `SLACK`; `left` and `right` are unit vectors in single precision."""
        a, b = self.blocks[block]
        x, y = left[:, a:b], right[:, a:b]
        # |x|^2 + |y|^2 - 2xy <= budget, with one comparison over the pairs
        return x @ y.T >= ((x * x).sum(1)[:, None] - np.float32(self.budget[block] + SLACK) + (y * y).sum(1)[None, :]) / 2

    def meets(self, unit: np.ndarray, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        """Of the pairs (a, b), those within the block's budget, in double precision."""
        low, high = self.blocks[block]
        return ((unit[a, low:high] - unit[b, low:high]) ** 2).sum(1) <= self.budget[block]

    def any_within(self, left: np.ndarray, right: np.ndarray, blocks: range) -> np.ndarray:
        met = np.zeros((len(left), len(right)), bool)
        for k in blocks:
            met |= self.within(left, right, k)
        return met


def plan(members: DataFrame, least_cosine: float, grid_dims: int = GRID_DIMS, sample_rows: int = SAMPLE_ROWS) -> int:
    """Coordinates of the grid that compares the fewest pairs on a sample; 0: none fewer than the labels as wholes.

    Only the work depends on the answer, not the result.
    """
    count = members.count()
    draw = F.pmod(F.xxhash64("rep", F.lit(23)), F.lit(1 << 30))
    sample = members.where(draw < F.lit(int((1 << 30) * min(1.0, sample_rows / max(1, count))))).select("label", "embedding").limit(2 * sample_rows).toArrow()
    if not len(sample):
        return 0
    labels = sample["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    cost = dict.fromkeys(range(grid_dims + 1), 0)
    for dims, (at, values) in _by_length(pa.array(np.arange(len(sample))), sample["embedding"].combine_chunks()).items():
        of = labels[at]
        cost[0] += int((np.bincount(of).astype(np.int64) ** 2).sum()) // 2
        for g in range(1, grid_dims + 1):
            hole = Pigeonhole(dims, least_cosine, grid=g)
            unit = hole.unit(values.astype(np.float64))
            for block in range(len(hole.blocks)):
                row, cell, home = hole.cells(unit, block)
                _, key = np.unique(np.stack([of[row], cell]), axis=1, return_inverse=True)
                cost[g] += int((np.bincount(key, home) * np.bincount(key)).sum())
    return min(cost, key=lambda g: (cost[g], g))


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.93, cell_bytes: int = CELL_BYTES, grid: int | None = None) -> DataFrame:
    """`vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept for every row.

    `grid` sets the number of the grid's coordinates, 0 for none; by default `plan` chooses.
    """
    every = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"), F.col("label").cast("string").alias("label"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & (norm > 0), F.lit(False))
    h0, h1 = F.xxhash64("embedding").alias("h0"), F.xxhash64(F.lit(1), "embedding").alias("h1")
    classes = common.written(
        every.where(fit).withColumns({"h0": h0, "h1": h1}).groupBy("label", "h0", "h1")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("embedding").alias("embedding")), "vector-classes")
    members = classes.select("rep", "weight", "label", "embedding")
    widest = members.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = max(16, cell_bytes // (4 * widest))

    grid = plan(members, least_cosine) if grid is None else grid
    groups = _grid_groups(members, least_cosine, grid, rows) if grid else _label_groups(members, rows)
    seen = common.written(groups.applyInArrow(lambda t: _group(t, least_cosine), "rep long, links long, other long"), "cell-links")

    counts = seen.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(seen.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    facts = (
        classes.select("label", "h0", "h1", "rep", "weight").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "h0", "h1", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = every.where(fit).select("vec_id", "label", h0, h1).join(facts, ["label", "h0", "h1"]).select("vec_id", "n_links", "component_id")
    apart = every.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _label_groups(members: DataFrame, rows: int):
    """A label is one cell: every unordered pair of its chunks is a group. `h` is the chunk of the rows that count."""
    sizes = members.groupBy("label").agg(F.ceil(F.count("*") / rows).cast("int").alias("chunks"))
    dealt = members.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("rep", "weight", "label", "embedding", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("cell"), F.least("own", "other").alias("h"),
                         F.greatest("own", "other").alias("v"), (F.col("own") <= F.col("other")).alias("asks"))
    return dealt.groupBy("label", "block", "cell", "h", "v")


def _grid_groups(members: DataFrame, least_cosine: float, grid: int, rows: int):
    """A cell's home rows against its visiting rows, chunk by chunk."""
    schema = T.StructType(list(members.schema.fields)).add("block", "integer").add("cell", "long").add("home", "boolean")
    visits = members.mapInArrow(lambda batches: _visits(batches, least_cosine, grid), schema)
    sizes = common.written(visits.groupBy("label", "block", "cell").agg(F.count("*").alias("n")), "cell-sizes")
    full = sizes.where(F.col("n") > rows).select("label", "block", "cell", F.ceil(F.col("n") / rows).cast("int").alias("chunks"))
    dealt = visits.join(full, ["label", "block", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    every_chunk = F.sequence(F.lit(0), F.col("chunks") - 1)
    # A row takes part at home in its own chunk against every visiting chunk, and on visit the other way round.
    at_home = F.when(F.col("home"), F.transform(every_chunk, lambda c: F.struct(own.alias("h"), c.alias("v"), F.lit(True).alias("asks")))).otherwise(F.array())
    on_visit = F.transform(every_chunk, lambda c: F.struct(c.alias("h"), own.alias("v"), F.lit(False).alias("asks")))
    spread = dealt.select("rep", "weight", "label", "embedding", "block", "cell", F.explode(F.concat(at_home, on_visit)).alias("at"))
    return spread.select("rep", "weight", "label", "embedding", "block", "cell", "at.*").groupBy("label", "block", "cell", "h", "v")


def _visits(batches, least_cosine: float, grid: int):
    holes: dict[int, Pigeonhole] = {}
    for batch in batches:
        label = batch.column("label")
        vectors = batch.column("embedding")
        for dims, (at, values) in _by_length(pa.array(np.arange(batch.num_rows)), vectors).items():
            hole = holes.setdefault(dims, Pigeonhole(dims, least_cosine, grid=grid))
            unit = hole.unit(values.astype(np.float64))
            for block in range(len(hole.blocks)):
                row, cell, home = hole.cells(unit, block)
                index = pa.array(at[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").take(index), batch.column("weight").take(index), label.take(index),
                     vectors.take(index), pa.array(np.full(len(row), block, np.int32)), pa.array(cell), pa.array(home)],
                    names=["rep", "weight", "label", "embedding", "block", "cell", "home"])


def _group(table: pa.Table, least_cosine: float) -> pa.Table:
    """Rows that ask against the others of one cell: link counts and a forest. In a cell that is a whole label
    (block -1) rows that don't ask count as well, and rows of one chunk meet each other."""
    block = table["block"][0].as_py()
    whole, same = block < 0, table["h"][0].as_py() == table["v"][0].as_py()
    asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
    rep, weight = table["rep"].to_numpy(), table["weight"].to_numpy()
    out_rep, out_links, out_other = [], [], []
    for dims, (at, values) in _by_length(pa.array(np.arange(len(table))), table["embedding"].combine_chunks()).items():
        hole = Pigeonhole(dims, least_cosine)
        raw = values.astype(np.float64)
        length = np.sqrt((raw * raw).sum(1))
        exact = hole.unit(raw)
        unit = exact.astype(np.float32)
        tested = range(len(hole.blocks)) if whole else range(block, block + 1)
        left = np.flatnonzero(asks[at])
        right = left if whole and same else np.flatnonzero(~asks[at])
        links = np.zeros(len(at), np.int64)
        tree_a, tree_b = [], []
        for i in range(0, len(left), TILE):
            x = left[i : i + TILE]
            for j in range(i if right is left else 0, len(right), TILE):
                y = right[j : j + TILE]
                a, b = np.nonzero(hole.any_within(unit[x], unit[y], tested))
                keep = rep[at[x[a]]] != rep[at[y[b]]]
                if right is left and i == j:
                    keep &= a < b
                a, b = x[a[keep]], y[b[keep]]
                a, b = _linked(a, b, raw, length, least_cosine)
                if not whole and len(a):  # a pair counts in the first block whose budget it meets
                    first = hole.meets(exact, a, b, block)
                    for k in range(block):
                        first &= ~hole.meets(exact, a, b, k)
                    a, b = a[first], b[first]
                if not len(a):
                    continue
                links += np.bincount(a, weight[at[b]], len(at)).astype(np.int64)
                if whole:
                    links += np.bincount(b, weight[at[a]], len(at)).astype(np.int64)
                a, b = _forest(rep[at[a]], rep[at[b]])
                tree_a.append(a)
                tree_b.append(b)
        counted = np.flatnonzero(links)
        out_rep += [rep[at[counted]], *tree_a]
        out_links += [links[counted], *(np.zeros(len(a), np.int64) for a in tree_a)]
        out_other += [np.full(len(counted), -1), *tree_b]
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    links = join(out_links)
    return pa.table({"rep": join(out_rep), "links": links, "other": pa.array(join(out_other), mask=links > 0)})


def _linked(a: np.ndarray, b: np.ndarray, raw: np.ndarray, length: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose cosine, in double precision, is at least that asked for."""
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        keep[k : k + (1 << 16)] = np.einsum("ij,ij->i", raw[x], raw[y]) / (length[x] * length[y]) >= least_cosine
    return a[keep], b[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links (a, b): each node to the smallest it reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]
