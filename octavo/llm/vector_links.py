"""Near-duplicate vectors by a random-projection tree forest.

Each tree splits the unit vectors along a random direction, at its median if possible, again and again,
until a node of the fitting sample is small or no split tried leaves its linked pairs together (a dense
group); a vector close to a split goes to both sides.  The trees are fitted on a
sample bounded by ``SAMPLE`` vectors, but every vector is sent down every tree.  A leaf that comes out larger than
``MOST`` is split further by a tree fitted, by an executor, on a bounded sample of its own vectors, and so on until no
leaf is larger but dense groups.  Every leaf is compared whole: its vectors meet in blocks, and a leaf of any size is
compared exactly by pairs of blocks.

Vectors of different lengths never link.  Each length has its own trees; one that is too rare to be in the sample has a
single leaf per length, which grows no larger than others do.

Equal vectors are compared once.  A link is counted in the first leaf (of the first tree) that holds both
ends, so counts are sums and no table of pairs is made; a leaf hands on, per vector, its number of links
and one link per vector at most that keeps its linked vectors connected.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; repeated rows link like copies; a null id counts
as a copy but is never a component's id unless all are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import hash_cutoff, keep, rows_per_batch

#: Vectors the trees are fitted on and their bytes, vectors wanted in a leaf, most levels, trees, share that spills over on each side.
SAMPLE, SAMPLE_BYTES, LEAF, LEVELS, TREES, SPILL = 20_000, 128 << 20, 800, 12, 6, 0.08
#: A leaf of more vectors is split further by a tree fitted on about so many of them.
MOST, REFIT = 16_384, 2000
#: Vectors of a block; a leaf of more is compared by pairs of blocks.
BLOCK = 4096
#: Vectors of a node among which linked pairs are looked for, pairs tested (about), the share of them that a split may part, and the places (quantiles) tried in turn.
SEEN, PAIRS, PARTED, PLACES = 1500, 20_000, 0.05, (0.5,) * 8 + (0.35, 0.65) * 4 + (0.2, 0.8) * 4
Tree = list[tuple[np.ndarray, float, float] | None]


def _linked(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows whose cosine reaches the limit."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.nonzero(np.triu(x @ x.T >= least, 1))


def fit_tree(sample: np.ndarray, leaf: int, seed: int, least: float = 0.9) -> Tree:
    """Nodes of a binary heap: direction, middle, margin; None where the split ends.

    A split may part ``PARTED`` of the linked pairs seen in its node at most: other directions and places are
    tried, and a node that none of them splits so, such as a dense group, stays a leaf of whatever size.
    """
    rng, tree, todo = np.random.default_rng(seed), [], {0: np.arange(len(sample))}
    for k in range(2 ** (LEVELS + 1) - 1):
        own = todo.pop(k, None)
        if own is None and not todo:
            break
        tree.append(None)
        if own is None or len(own) <= leaf or k >= 2**LEVELS - 1:
            continue
        seen = own if len(own) <= SEEN else rng.choice(own, SEEN, replace=False)
        one, two = _linked(sample[seen], least)
        if len(one) > PAIRS:
            some = rng.choice(len(one), PAIRS)
            one, two = one[some], two[some]
        for place in PLACES:
            way = rng.standard_normal(sample.shape[1])
            at, of = sample[own] @ way, sample[seen] @ way
            middle = float(np.quantile(at, place))
            margin = float(np.quantile(np.abs(at - middle), 2 * SPILL))
            low, high = own[at <= middle + margin], own[at >= middle - margin]
            if max(len(low), len(high)) > 0.95 * len(own):
                continue  # copies of one vector can't be split
            least_at, most_at = np.minimum(of[one], of[two]), np.maximum(of[one], of[two])
            if ((least_at < middle - margin) & (most_at > middle + margin)).sum() <= PARTED * len(one):
                tree[k] = way, middle, margin
                todo[2 * k + 1], todo[2 * k + 2] = low, high
                break
    return tree


def route(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a row comes to."""
    rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        k, own = todo.pop()
        if not len(own):
            continue
        if k >= len(tree) or tree[k] is None:
            rows.append(own)
            leaves.append(np.full(len(own), k))
            continue
        way, middle, margin = tree[k]
        at = x[own] @ way
        todo += [(2 * k + 1, own[at <= middle + margin]), (2 * k + 2, own[at >= middle - margin])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


def unit(v: list | None) -> np.ndarray | None:
    """The vector at length one in double precision, or None if it links with nothing."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return None if top == 0 else (x / top) / np.sqrt(((x / top) ** 2).sum())


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``node`` (of equal unit vectors; null if it links with nothing), ``size`` and ``unit``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [unit(v) for v in b["v"].to_pylist()]
            raw = [None if x is None else (x + 0.0).tobytes() for x in found]
            node = [None if x is None else int(np.int64(np.uint64(xxhash.xxh64_intdigest(x)))) for x in raw]
            size = [None if x is None else len(x) // 8 for x in raw]
            yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "node": pa.array(node, pa.int64()), "size": pa.array(size, pa.int32()), "unit": pa.array(raw, pa.binary())})

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows_per_batch(table.sparkSession, 2000)
    return rows.mapInArrow(read, "vec_id long, node long, size int, unit binary")


def _compare(least: float):
    """For two blocks of a leaf (or one with itself): links not met in an earlier leaf, counted with their copies, and enough links to connect."""

    def run(table: pa.Table) -> pa.Table:
        leaf, low, high = (table[c][0].as_py() for c in ("leaf", "low", "high"))
        node, copies, block = (table[c].to_numpy() for c in ("node", "copies", "block"))
        x = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(node), -1)
        # a leaf's number grows with its tree; a pair counts where its first common leaf is
        own = [np.frombuffer(v, np.int64) for v in table["leaves"].to_pylist()]
        row, at = np.repeat(np.arange(len(node)), [len(v) for v in own]), np.concatenate(own)
        row, at = row[at < leaf], at[at < leaf]
        earlier, col = np.unique(at, return_inverse=True)
        been = np.zeros((len(node), len(earlier)), np.float32)
        been[row, col] = 1
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        links, label, edges = np.zeros(len(node), np.int64), np.arange(len(node)), []
        for i in range(0, len(left), 512):
            part = left[i : i + 512]
            fresh = (x[part] @ x[right].T >= least) & (been[part] @ been[right].T == 0)
            if low == high:
                fresh[np.arange(len(part)), np.arange(i, i + len(part))] = False
            else:
                links[right] += copies[part] @ fresh
            links[part] += fresh @ copies[right]
            for k in np.flatnonzero(fresh.any(axis=1)).tolist():
                p, near = part[k], right[fresh[k]]
                near = near[label[near] != label[p]]
                found, first = np.unique(label[near], return_index=True)
                for was, q in zip(found.tolist(), near[first].tolist(), strict=True):
                    edges.append((int(node[p]), 0, int(node[q])))
                    label[label == was] = label[p]
        got = [(int(node[k]), int(links[k]), None) for k in np.flatnonzero(links)] + edges
        cols = list(zip(*got, strict=True)) if got else [[]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "links", "other"), cols, strict=True)})

    return run


def _packed_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [np.array(v, np.int64).tobytes() for v in b["own"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"leaf": b["leaf"], "leaves": pa.array(packed, pa.binary())} | {c: b[c] for c in ("node", "copies", "unit")})


def _split_large(placed: DataFrame, counts: DataFrame, leaf: int, least: float) -> tuple[DataFrame, DataFrame] | None:
    """``leaf``, ``node`` of every vector in every leaf, and the leaves' ``n``, once those of more than ``MOST`` are split as far as they can be; None if none could.

    Each round writes the members of large leaves only, fits a tree per leaf on about ``REFIT`` of them, and sends them
    down it in parts of bounded size.
    """

    def fit(table: pa.Table) -> pa.Table:
        sample = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(table.num_rows, -1)
        no, n = table["leaf"][0].as_py(), table["n"][0].as_py()
        tree = fit_tree(sample, max(8, leaf * table.num_rows // n), no & 0xFFFF, least)
        got = [(no, n, pickle.dumps(tree))] if tree and tree[0] is not None else []
        cols = list(zip(*got, strict=True)) or [[]] * 3
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("leaf", "n", "tree"), cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    def send(members: pa.Table, trees: pa.Table) -> pa.Table:
        if not members.num_rows or not trees.num_rows:
            return pa.table({"leaf": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        x = np.frombuffer(b"".join(members["unit"].to_pylist()), np.float64).reshape(members.num_rows, -1)
        row, at = route(x, pickle.loads(trees["tree"][0].as_py()))
        no = trees["leaf"][0].as_py()
        # numbers that no leaf of another tree has
        named = {k: int(np.int64(np.uint64(xxhash.xxh64_intdigest(f"{no},{k}")))) for k in np.unique(at).tolist()}
        return pa.table({"leaf": pa.array([named[k] for k in at.tolist()], pa.int64()), "node": members["node"].take(pa.array(row))})

    done, todo = [], placed
    while True:
        large = counts.where(F.col("n") > MOST)
        if large.isEmpty():
            break
        members = keep(todo.join(F.broadcast(large) if large.count() < 10_000 else large, "leaf"), "large")
        drawn = F.xxhash64("node", "leaf").cast("double") <= F.lit(2.0**64) * REFIT / F.col("n") - F.lit(2.0**63)
        trees = keep(members.where(drawn).groupBy("leaf").applyInArrow(fit, "leaf long, n long, tree binary"), "trees")
        if trees.isEmpty():
            break
        parts = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = members.join(trees.select("leaf"), "leaf", "left_semi").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
        copies = trees.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        fresh = keep(dealt.groupBy("leaf", "part").cogroup(copies.groupBy("leaf", "part")).applyInArrow(send, "leaf long, node long"), "split")
        done.append(todo.select("leaf", "node").join(trees.select("leaf"), "leaf", "left_anti"))
        units = placed.select("node", "unit").dropDuplicates(["node"])
        todo = fresh.join(units, "node").select("leaf", "node", "unit")
        counts = keep(fresh.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf_sizes")
    if not done:
        return None
    at = todo.select("leaf", "node")
    for part in done:
        at = at.unionByName(part)
    at = keep(at, "in_leaves")
    return at, keep(at.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf_sizes")


def near_vectors(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Per vector ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    spark = table.sparkSession
    known = keep(vectors(table, id_col, vector_col), "vectors")
    live = known.where("node is not null")
    first = [F.first(c).alias(c) for c in ("size", "unit")]
    distinct = keep(live.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), *first), "distinct")
    n, widest = distinct.agg(F.count(F.lit(1)), F.max("size")).first()
    most = max(16, min(SAMPLE, SAMPLE_BYTES // (8 * (widest or 1))))
    cutoff, share = hash_cutoff(distinct.select("node"), most), min(1.0, most / max(n, 1))
    fitted = distinct.where(F.col("node") <= F.lit(cutoff if cutoff is not None else 0).cast("long")).select("node", "size", "unit").toPandas().sort_values("node")
    grown: dict[int, list[Tree]] = {}
    for size, own in fitted.groupby("size"):
        sample = np.frombuffer(b"".join(own["unit"]), np.float64).reshape(len(own), -1)
        if len(own) > (least_leaf := max(8, int(leaf * share))):
            grown[int(size)] = [fit_tree(sample, least_leaf, seed, least) for seed in range(trees)]
    forest = spark.sparkContext.broadcast(grown)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                b = batch.filter(pa.array(sizes == size))
                x = np.frombuffer(b"".join(b["unit"].to_pylist()), np.float64).reshape(b.num_rows, -1)
                # the trees of a length are numbered within it; without trees there is one leaf
                rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k, tree in enumerate(forest.value.get(size, [[None]])):
                    r, at = route(x, tree)
                    rows.append(r)
                    leaves.append(at + (size << 32 | k << 24))
                row, at = np.concatenate(rows), np.concatenate(leaves)
                order = np.lexsort((at, row))
                row, at = row[order], at[order]
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
                mine = [at[i:j].astype(np.int64).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                take = pa.array(row)
                cols = {"leaf": pa.array(at, pa.int64()), "leaves": pa.array(mine, pa.binary()).take(take)}
                yield pa.RecordBatch.from_pydict(cols | {c: b[c].take(take) for c in ("node", "copies", "unit")})

    # sent twice, once to count: routing is cheaper than a table of every vector in every leaf
    placed = distinct.select("node", "copies", "size", "unit").mapInArrow(send, "leaf long, leaves binary, node long, copies long, unit binary")
    counts = keep(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf_sizes")
    split = _split_large(placed.select("leaf", "node", "unit"), counts, leaf, least)
    if split is not None:
        at, counts = split
        own = F.array_sort(F.collect_list("leaf")).alias("own")
        placed = at.join(keep(at.groupBy("node").agg(own), "own_leaves"), "node").join(distinct.select("node", "copies", "unit"), "node")
        placed = placed.mapInArrow(_packed_leaves, "leaf long, leaves binary, node long, copies long, unit binary")
    sizes = counts.select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    met = keep(dealt.groupBy("leaf", "low", "high").applyInArrow(_compare(least), "node long, links long, other long"), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = distinct.join(links, "node", "left").join(roots, "node", "left")
    named = keep(named.select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "named")
    ids = keep(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    by_node = keep(named.join(ids, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("links"), "component_id"), "by_node")
    got = known.select("vec_id", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    got = got.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
