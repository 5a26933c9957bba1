"""Documents whose sets of word n-grams have a Jaccard similarity of a limit or more, joined exactly.

The incidence matrix of documents by n-grams is cut into column blocks by n-gram hash, and products are
only accumulated where a bound on sizes leaves a pair possible:

1. Every text's set is made once and written, in gathers: runs of sets that one task made.  Column blocks count each
   n-gram's documents.  An n-gram that repeats within a gather is sent once, as "several", so a block holds an n-gram
   once per gather at most, however many documents have it.  A document can only have a partner if enough of its
   n-grams occur in another document; what comes back is a bitmap per gather, and most documents leave here.
2. For the rest, distinct sets are kept once.  Two sets that reach the limit share one of the rarest
   n-grams of each (as many as the size bound leaves uncovered); only those columns are multiplied.
3. Within a column, a pair is dropped by its sizes and by a bound on its symmetric difference, from
   parity bitmaps; pairs already connected are not compared.  What is left is compared exactly, set
   against set.  First every set tries the pair with most shared rare n-grams, then its nearest one for a
   few rounds, so that copies of one text connect without multiplying out; the last round takes all pairs left.

What comes out are the classes of documents connected by links, not the number of links: pairs of one class are not all
compared.  n-grams and sets are compared by 64-bit hashes.  Long columns are cut into segments that meet in pairs.

Defined cases: a text of fewer words than n is one n-gram; a text without words, empty or null, has no
n-grams and is connected to nothing; rows with equal sets are connected, whatever their ids; a null id is
never a component's id unless all of the component's are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.views import get_bit
from .components import components
from .key_sets import matched
from .shared import bucketed, drop, keep, rows_per_batch, split_words, take_memory, texts

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = np.random.default_rng(9).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text per column block, n-grams and documents of a gather.
BLOCK_BYTES, GATHER, GATHER_DOCS = 24 << 20, 2 << 20, 60_000
#: Words whose hashes a Python worker remembers, and the longest of them.
MEMORY_WORDS, MEMORY_CHARS = 150_000, 64
BITMAP_BITS, SEGMENT, NEAREST_ROUNDS, PAIRS_AT_ONCE = 1024, 2048, 3, 2 << 20


@dataclass(frozen=True)
class Limit:
    """Similarity as a fraction of integers, so that ties are exact."""

    percent: int = 75

    def least_overlap(self, size):
        """Of a set of this size with any partner."""
        return -(-size * self.percent // 100)

    def sizes_fit(self, a, b):
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def most_apart(self, a, b):
        """Largest symmetric difference of linked sets."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return 100 * overlap >= self.percent * (a + b - overlap)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= MEMORY_CHARS:
            if len(self) > MEMORY_WORDS:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def forget_words() -> None:
    """Steps call this, as one that named the memory itself would carry a copy of it to the workers and empty that."""
    _words.clear()


def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams."""
    if not text:
        return np.zeros(0, np.uint64)
    words = split_words(text.lower() if text.isascii() else text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h += codes[k : k + len(h)] * _ODD[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def _node(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes()))))


def _block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Grows with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)


#: Stands for the place of an n-gram that several documents of a gather have.
SEVERAL = 0xFFFF
_GATHERED = "block int, gather long, hashes binary, places binary, counts binary, own binary"
_KINDS = {"block": pa.int32(), "gather": pa.int64()}


def _table(rows: list[tuple], schema: str) -> dict[str, pa.Array]:
    names = [x.split()[0] for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return {n: pa.array(c, _KINDS.get(n, pa.binary())) for n, c in zip(names, cols, strict=True)}


class _Gather:
    """Collects sets of one gather, and hands them on as one row per column block, with a row of its own documents."""

    def __init__(self, blocks: int, exact: bool):
        self.blocks, self.exact = blocks, exact
        self._clear()

    def _clear(self) -> None:
        self.sets, self.places, self.meta, self.size = [], [], [], 0

    def add(self, place: int, s: np.ndarray, meta: int) -> bool:
        self.sets.append(s)
        self.places.append(place)
        self.meta.append((place, meta, len(s)))
        self.size += len(s)
        return self.size >= GATHER

    def rows(self, gather: int) -> pa.RecordBatch:
        h = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        place = np.repeat(np.array(self.places, np.uint16), [len(s) for s in self.sets])
        meta = np.array(self.meta, np.int64).tobytes()
        self._clear()
        order = np.argsort(h)
        h, place = h[order], place[order]
        del order
        new = np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(h)))
        one = np.where(count > 1, SEVERAL, place[first]).astype(np.uint16)
        each, block = h[first], _block_of(h[first], self.blocks)
        repeated = np.repeat(count > 1, count)
        if self.exact:
            # what the gather has to know again when the counts of its repeated n-grams come back
            own = np.concatenate([place[repeated].view(np.uint8), h[repeated].view(np.uint8)]).tobytes()
        else:
            own = np.bincount(place[repeated], minlength=1).astype("<u4").tobytes()
        cuts = np.flatnonzero(np.concatenate([np.ones(min(len(block), 1), bool), block[1:] != block[:-1]])).tolist()
        kind = "<u8" if self.exact else "<u4"
        rows = []
        for i, j in zip(cuts, [*cuts[1:], len(block)], strict=True):
            counts = count[i:j].astype("<u4").tobytes() if self.exact else None
            rows.append((int(block[i]), gather, each[i:j].astype(kind).tobytes(), one[i:j].tobytes(), counts, None))
        rows.append((gather % self.blocks, gather, None, meta, None, own))
        return pa.RecordBatch.from_pydict(_table(rows, _GATHERED))


def _gathered(blocks: int, exact: bool):
    """From rows (gather, place, node, hashes), those of a gather together; or from rows (node, hashes), which are placed in gathers here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("shingles", forget_words)
        g, was, part, no = _Gather(blocks, exact), None, TaskContext.get().partitionId() << 24, 0
        for b in batches:
            placed = "gather" in b.schema.names
            at = zip(b["gather"].to_pylist(), b["place"].to_pylist(), strict=True) if placed else itertools.repeat((None, None), b.num_rows)
            for (gather, place), node, hashes in zip(at, b["node"].to_pylist(), b["hashes"], strict=True):
                if not placed:
                    gather, place = part | no, len(g.sets)
                if gather != was and g.sets:
                    yield g.rows(was)
                was = gather
                if g.add(place, np.frombuffer(hashes.as_buffer(), np.uint64), node) or (not placed and place + 1 >= GATHER_DOCS):
                    yield g.rows(was)
                    no += 1
        if g.sets:
            yield g.rows(was)

    return run


_COUNTED = "gather long, places binary, counts binary, hashes binary, meta binary, own binary"


def _column_counts(exact: bool):
    """For one column block: per gather the places of single n-grams that other gathers have too, and how many; or which n-grams, and in how many documents."""
    kind = "<u8" if exact else "<u4"

    def run(table: pa.Table) -> pa.Table:
        out, gathers, places, hashes, counts = [], [], [], [], []
        # the block's columns are read where they lie: a copy of each would stay until its end
        for gather, h, p, c, own in zip(table["gather"].to_pylist(), *(table[x] for x in ("hashes", "places", "counts", "own")), strict=True):
            if not h.is_valid:
                out.append((gather, None, None, None, p.as_py(), own.as_py()))
            else:
                gathers.append(gather)
                places.append(np.frombuffer(p.as_buffer(), np.uint16))
                hashes.append(np.frombuffer(h.as_buffer(), kind))
                if exact:
                    counts.append(np.frombuffer(c.as_buffer(), "<u4"))
        if gathers:
            every = np.concatenate(hashes)
            order = np.argsort(every)
            every = every[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            del every
            times = np.diff(np.append(first, len(order)))
            size = np.add.reduceat(np.concatenate(counts)[order], first) if exact else times
            df = np.empty(len(order), np.uint32)
            df[order] = np.repeat(size.astype(np.uint32), times)
            del order, first, times, size
            at = 0
            for gather, p, h in zip(gathers, places, hashes, strict=True):
                n = df[at : at + len(p)]
                at += len(p)
                if exact:
                    shared = n > 1
                    if shared.any():
                        out.append((gather, p[shared].tobytes(), n[shared].tobytes(), h[shared].tobytes(), None, None))
                elif (shared := (n > 1) & (p != SEVERAL)).any():
                    found, count = np.unique(p[shared], return_counts=True)
                    out.append((gather, found.tobytes(), count.astype(np.uint32).tobytes(), None, None, None))
        return pa.table(_table(out, _COUNTED))

    return run


def _counted(sets: DataFrame, blocks: int, exact: bool) -> DataFrame:
    """The blocks' answers about sets, placed in gathers or not; tasks are as many as the blocks ask for, whatever the session's number of shuffle partitions."""
    parts = max(blocks // 2, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = sets.select(*[c for c in ("gather", "place", "node", "hashes") if c in sets.columns]).mapInArrow(_gathered(blocks, exact), _GATHERED)
    return sent.repartition(parts, "block").groupBy("block").applyInArrow(_column_counts(exact), _COUNTED).repartition(parts, "gather")


def _meta(table: pa.Table) -> np.ndarray:
    """Place, node and size of a gather's sets."""
    return np.concatenate([np.frombuffer(m, np.int64) for m in table["meta"].to_pylist() if m is not None]).reshape(-1, 3)


def written_sets(docs: DataFrame, blocks: int, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``key`` (of its text), ``gather``, ``place``, ``node`` (of its set), ``n`` and ``hashes``: a table bucketed by gather, so that a gather's bitmap finds its sets in place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("shingles", forget_words)
        part, no, place, size = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            sets = [ngram_set(t.as_py(), n) for t in b["text"]]
            gathers, places = [], []
            for s in sets:
                if size >= GATHER or place >= GATHER_DOCS:
                    no, place, size = no + 1, 0, 0
                gathers.append(part << 24 | no)
                places.append(place)
                place, size = place + 1, size + len(s)
            cols = {"doc_id": b["doc_id"], "key": b["key"], "gather": pa.array(gathers, pa.int64()), "place": pa.array(places, pa.int32())}
            cols |= {"node": pa.array([_node(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32())}
            yield pa.RecordBatch.from_pydict(cols | {"hashes": pa.array([s.tobytes() for s in sets], pa.binary())})
        forget_words()

    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text")
    made = rows.mapInArrow(read, "doc_id long, key long, gather long, place int, node long, n int, hashes binary")
    return bucketed(made, "gather", max(32, min(blocks, 4096)))


def candidate_bitmaps(sets: DataFrame, blocks: int, limit: Limit) -> DataFrame:
    """``gather`` and a bitmap (``marks``) of the places whose sets have enough n-grams that others have."""

    def decide(table: pa.Table) -> pa.Table:
        meta = _meta(table)
        shared = np.zeros(int(meta[:, 0].max()) + 1, np.int64)
        for p, c, own in zip(*(table[x].to_pylist() for x in ("places", "counts", "own")), strict=True):
            if own is not None:
                own = np.frombuffer(own, "<u4")
                shared[: len(own)] += own[: len(shared)]
            else:
                shared[np.frombuffer(p, np.uint16)] += np.frombuffer(c, np.uint32)
        place, size = meta[:, 0], meta[:, 2]
        maybe = np.zeros(len(shared), np.uint8)
        maybe[place[(size > 0) & (shared[place] >= limit.least_overlap(size))]] = 1
        if not maybe.any():
            return pa.table({"gather": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
        return pa.table({"gather": table["gather"][:1], "marks": pa.array([np.packbits(maybe, bitorder="little").tobytes()], pa.binary())})

    return _counted(sets, blocks, False).groupBy("gather").applyInArrow(decide, "gather long, marks binary")


def candidate_sets(sets: DataFrame, marks: DataFrame) -> DataFrame:
    """``node``, ``n``, ``hashes`` and parity ``bits`` of the marked sets, several times if sets repeat."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for b in batches:
            fresh = []
            for k, node in enumerate(b["node"].to_pylist()):
                if node not in done:
                    done.add(node)
                    fresh.append(k)
            if fresh:
                b = b.take(pa.array(fresh))
                bits = []
                for s in b["hashes"].to_pylist():
                    low = (np.frombuffer(s, np.uint64) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
                    bits.append(np.packbits(np.bincount(low, minlength=BITMAP_BITS).astype(np.uint8) & 1).tobytes())
                yield pa.RecordBatch.from_arrays([b["node"], b["n"], b["hashes"], pa.array(bits, pa.binary())], names=["node", "n", "hashes", "bits"])

    found = sets.where("n > 0").join(marks, "gather").where(get_bit(F.col("marks"), F.col("place")))
    return found.select("node", "n", "hashes").mapInArrow(read, "node long, n int, hashes binary, bits binary")


def rare_columns(sets: DataFrame, blocks: int, limit: Limit) -> DataFrame:
    """``h``, ``node``, ``n``: for each set the rarest of its shared n-grams, as many as the size bound leaves uncovered."""

    def choose(table: pa.Table) -> pa.Table:
        meta = _meta(table)
        node, total = np.zeros(int(meta[:, 0].max()) + 1, np.int64), np.zeros(int(meta[:, 0].max()) + 1, np.int64)
        node[meta[:, 0]], total[meta[:, 0]] = meta[:, 1], meta[:, 2]
        got = [(p, c, h) for p, c, h in zip(*(table[x].to_pylist() for x in ("places", "counts", "hashes")), strict=True) if p is not None]
        place, df, h = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*got, strict=True) if got else ([], [], []), (np.uint16, np.uint32, np.uint64), strict=True))
        several = place == SEVERAL
        # a repeated n-gram's count goes to all of the gather's sets that have it
        many, many_df = h[several], df[several]
        order = np.argsort(many, kind="stable")
        many, many_df = many[order], many_df[order]
        places, hashes, dfs = [place[~several]], [h[~several]], [df[~several]]
        for own in table["own"].to_pylist():
            if own:
                k = len(own) // 10
                own_place, own_hash = np.frombuffer(own, np.uint16, k), np.frombuffer(own, np.uint64, k, 2 * k)
                places.append(own_place)
                hashes.append(own_hash)
                dfs.append(many_df[np.searchsorted(many, own_hash)])
        place, h, df = np.concatenate(places), np.concatenate(hashes), np.concatenate(dfs)
        order = np.lexsort((h, df, place))
        place, h = place[order].astype(np.int64), h[order]
        shared = np.bincount(place, minlength=len(node))
        rank = np.arange(len(place)) - (np.cumsum(shared) - shared)[place]
        # shared - least + 1: the unshared ones, rarest of all, can't meet anything
        take = rank < (shared - limit.least_overlap(total) + 1)[place]
        return pa.table({"h": h[take].view(np.int64), "node": node[place[take]], "n": total[place[take]].astype(np.int32)})

    return _counted(sets, blocks, True).groupBy("gather").applyInArrow(choose, "h long, node long, n int")


def by_node(sets: DataFrame, parts: int) -> DataFrame:
    """Each set once, as a table bucketed by node: comparing pairs then moves one set of each pair, and the table itself never."""
    spark = sets.sparkSession
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    once = sets.repartition(parts, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "hashes", "bits")])
    return bucketed(once, "node", parts)


def verified(pairs: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets, compared whole, reach the limit.

    ``b`` is joined first: it may be in very many pairs, which are still short then.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("shingles", forget_words)
        for b in batches:
            hit = []
            for x, y in zip(b["ha"].to_pylist(), b["hb"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                hit.append(limit.linked(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()), len(x), len(y)))
            yield b.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "hb").mapInArrow(compare, "a long, b long")


def near_enough(pairs: DataFrame, nodes: DataFrame, limit: Limit) -> DataFrame:
    """The pairs that the bound on the symmetric difference leaves; nothing but bitmaps is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("bits_a", "bits_b"))
                na, nb = (b[c].to_numpy().astype(np.int64) for c in ("na", "nb"))
                ok = np.bitwise_count(x ^ y).sum(axis=1) <= limit.most_apart(na, nb)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _each_pair(found: list[np.ndarray], all_pairs: bool) -> np.ndarray:
    """Each pair (a, b, distance) once; of pairs that are only asked for the nearest of each end, those that are it for one."""
    x = np.concatenate(found)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    x = x[np.concatenate([np.ones(min(len(x), 1), bool), (x[1:, :2] != x[:-1, :2]).any(axis=1)])]
    if not all_pairs and len(x):
        keep_ = np.zeros(len(x), bool)
        for end in (0, 1):
            order = np.lexsort((x[:, 1], x[:, 0], x[:, 2], x[:, end]))
            keep_[order[np.concatenate([[True], x[order][1:, end] != x[order][:-1, end]])]] = True
        x = x[keep_]
    return x


def _near_pairs(limit: Limit, all_pairs: bool):
    """Of the lists in a group of columns: pairs of different components that sizes and bitmaps allow; for each set the nearest one, or all."""

    def run(table: pa.Table) -> pa.Table:
        take_memory("shingles", forget_words)
        names = ["h", "low", "high", "segment", "node", "n", "root"]
        h, low, high, segment, node, n, root = (table[c].to_numpy() for c in names)
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(h), -1)
        order = np.lexsort((node, segment, high, low, h))
        h, low, high, segment, node, n, root, bits = (x[order] for x in (h, low, high, segment, node, n, root, bits))
        n = n.astype(np.int64)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        bounds = np.append(np.flatnonzero(new), len(h)).tolist()
        found, waiting = [np.zeros((0, 3), np.int64)], 0
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j - i < 2 or (root[i:j] == root[i]).all():
                continue
            cross = low[i] != high[i]
            for k in range(i, j - 1):
                rest = slice(k + 1, j)
                fit = limit.sizes_fit(n[k], n[rest]) & (root[rest] != root[k])
                if cross:
                    fit &= segment[rest] != segment[k]
                at = np.flatnonzero(fit) + k + 1
                if not len(at):
                    continue
                apart = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1)
                close = apart <= limit.most_apart(n[k], n[at])
                other, d = node[at[close]], apart[close]
                if len(other):
                    found.append(np.stack([np.minimum(node[k], other), np.maximum(node[k], other), d.astype(np.int64)], axis=1))
                    waiting += len(other)
                    if waiting > PAIRS_AT_ONCE:
                        found, waiting = [_each_pair(found, all_pairs)], 0
        pairs = _each_pair(found, all_pairs)
        if not all_pairs:
            # for each end the nearest, the least of equally near ones
            x = np.concatenate([np.column_stack([pairs[:, k], pairs[:, 2], pairs[:, :2]]) for k in (0, 1)])
            x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
            x = x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:, 0] != x[:-1, 0]])]
        else:
            x = np.column_stack([pairs[:, 0], pairs[:, 2], pairs[:, :2]])
        return pa.table({c: pa.array(x[:, k], pa.int64()) for k, c in enumerate(("node", "d", "a", "b"))})

    return run


def open_columns(columns: DataFrame, nodes: DataFrame) -> DataFrame:
    """The columns whose sets are not all connected yet, with how many segments each is cut into.  What is closed stays closed."""
    with_root = columns.select("h", "node", "n").join(nodes.select("node", "root"), "node")
    size = F.count(F.lit(1))
    found = with_root.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(size / SEGMENT).cast("int").alias("segments")).where("r0 <> r1")
    return keep(columns.select("h", "node", "n").join(keep(found.select("h", "segments"), "open"), "h"), "columns")


def near_pairs(columns: DataFrame, nodes: DataFrame, limit: Limit, all_pairs: bool) -> DataFrame:
    """Pairs worth comparing among sets not yet connected, of ``open_columns``; ``nodes``: node, root, bits."""
    lists = columns.join(nodes, "node")
    lists = lists.withColumn("segment", F.pmod(F.xxhash64("node"), F.col("segments")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("other")
    lists = lists.select("h", "segment", "node", "n", "root", "bits", other)
    lists = lists.select("h", F.least("segment", "other").alias("low"), F.greatest("segment", "other").alias("high"), "segment", "node", "n", "root", "bits")
    groups = max(64, columns.count() // 4000)
    grouped = lists.groupBy(F.pmod(F.xxhash64("h", "low", "high"), F.lit(groups)).alias("group"))
    got = grouped.applyInArrow(_near_pairs(limit, all_pairs), "node long, d long, a long, b long")
    if not all_pairs:
        got = got.groupBy("node").agg(F.min(F.struct("d", "a", "b")).alias("x")).select("x.a", "x.b")
    return got.select("a", "b").distinct()


def most_shared(columns: DataFrame, limit: Limit) -> DataFrame:
    """For each set the pair with the set that most often comes first in its columns (in an order of its own)."""
    first = columns.groupBy("h").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node", "n")).alias("x"), F.count(F.lit(1)).alias("m"))
    first = keep(first.where("m > 1").select("h", F.col("x.node").alias("b"), F.col("x.n").alias("nb")), "first")
    fit = (F.col("node") != F.col("b")) & (100 * F.least("n", "nb") >= limit.percent * F.greatest("n", "nb"))
    votes = columns.join(first, "h").where(fit).groupBy("node", "b").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("node").agg(F.max(F.struct("votes", "b")).alias("x")).select(F.col("node").alias("a"), F.col("x.b").alias("b"))


def _joined(docs: DataFrame, percent: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """Per row ``doc_id``, ``key`` (of its text), ``n_shingles``, ``root`` (a number of its component, null without n-grams) and ``component_id``."""
    spark, limit = docs.sparkSession, Limit(percent)
    rows_per_batch(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = max(32, -(-size // BLOCK_BYTES))
    written = written_sets(docs, blocks, n, id_col, text_col)
    marks = keep(candidate_bitmaps(written.where("n > 0"), blocks, limit), "marks")
    sets = by_node(candidate_sets(written, marks), blocks)
    known = keep(written.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "node"), "known")
    drop(written)  # what is needed of it is in the two
    columns = keep(rare_columns(sets, blocks, limit), "columns")
    first = keep(near_enough(most_shared(columns, limit), keep(sets.select("node", "n", "bits"), "bits"), limit), "first_pairs")
    links = keep(verified(first, sets, limit), "links")
    last = False
    for k in range(NEAREST_ROUNDS + 1):
        roots = components(links)
        nodes = keep(sets.select("node", "bits").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "bits"), "nodes")
        last = last or k == NEAREST_ROUNDS
        columns = open_columns(columns, nodes)
        pairs = keep(near_pairs(columns, nodes, limit, last), "pairs")
        found = keep(verified(pairs, sets, limit), "links")
        links = links.unionByName(found)
        if last:
            break
        last = found.isEmpty()
    roots = components(links)
    ids = known.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = keep(ids.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "ids")
    named = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    known_ids = keep(ids.select("node", "root").join(keep(named, "named"), "root").select("node", "root", "component_id"), "known_ids")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    root = F.when(F.col("n_shingles") > 0, F.col("root"))
    return known.join(known_ids, "node", "left").select("doc_id", "key", "n_shingles", root.alias("root"), own.alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable by links, its own included."""
    return _joined(docs, percent, n, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the least id (null after all others), then of the least text hash.

    Of repeated rows with that id and text one is kept, by a hash of all columns.  Rows without n-grams all stay.
    """
    found = keep(_joined(docs, percent, n, id_col, text_col).where("root IS NOT NULL").select("root", "doc_id", "key"), "joined")
    same = found.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "rows")
    first = keep(same.groupBy("root").agg(F.min(order).alias("x"), F.sum("rows").alias("rows")).where("rows > 1").select("root", "x"), "first")
    row = F.xxhash64("doc_id", "key")
    others = ~(F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("key").eqNullSafe(F.col("x.key")))
    copies = found.join(first, "root").where(others).select(row.alias("key"), F.lit(True).alias("octavo_copy"))
    repeated = first.where("x.rows > 1").select(F.xxhash64("x.doc_id", "x.key").alias("key"), F.lit(False).alias("octavo_copy"))
    told = keep(copies.unionByName(repeated).groupBy("key").agg(F.max("octavo_copy").alias("octavo_copy")), "told")
    own = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    alone, rest = matched(docs, own, told)
    single = F.col("octavo_copy").isNull()
    if told.where(~F.col("octavo_copy")).isEmpty():
        out = rest.where(single).select(*docs.columns)
    else:
        rest = keep(rest.where(single | ~F.col("octavo_copy")), "maybe_repeated")
        columns = [F.col(c) for c in docs.columns]
        hashed = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
        one = rest.where(~single).groupBy("octavo_key").agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("octavo_row")).select("octavo_row.*")
        out = rest.where(single).select(*docs.columns).unionByName(one)
    return out if alone is None else alone.unionByName(out)
