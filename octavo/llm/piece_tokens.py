"""SentencePiece BPE with byte fallback, encoded by vectorised merge rounds and decoded by table gathers.

Words (a run of spaces and what follows up to the next space) are merged independently, because no piece
of the vocabulary has a space mark after another character; ``PieceTokens`` checks that.  All words not met before by a
Python worker are merged together: their symbols lie in one flat array, each round finds every word's
pair of least rank by a segmented minimum, merges its occurrences leftmost first, looks up the new pairs beside
them in a hash table of arrays, and compacts the array, until no word has a pair left.  Words of ``LONG`` characters or more
would need as many rounds as they have merges, each over the whole word: they are merged by a queue of pairs instead, in
the same order, and not remembered.

Defined cases of the Spark operator: null and empty texts have no ids and decode to the empty text; a
document id may be null or repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import rows_per_batch, take_memory, texts

SPACE = "▁"
_WORDS = re.compile(" +[^ ]*")
NONE = np.int32(2**31 - 1)
#: Words that one Python worker remembers in each of two generations, and their characters and ids' bytes (a batch's new words may
#: go beyond them); from how many characters on a word is long, and characters of words merged at once.
MEMORY_WORDS, MEMORY_BYTES, LONG, ROUND_CHARS = 600_000, 1 << 26, 128, 1 << 20
ENCODED = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"


class PieceTokens:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        normal = {p: i for i, p in enumerate(self.pieces) if i not in special and not sp.is_unused(i)}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece crosses words")
        if sp.normalize("a  ﬁ\té ") != f"{SPACE}a{SPACE * 2}ﬁ\té{SPACE}":
            raise ValueError("the model changes texts before it splits them")
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        # symbols: pieces by id, then characters that only occur inside pieces
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.n, self.symbols = n, symbols
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = s
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None:
                    pairs[a << 32 | b] = i
        order = sorted(normal.values(), key=lambda i: (-sp.get_score(i), i))
        rank = np.full(n, NONE, np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.by_rank = np.array(order, np.int32)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = rank[[pairs[k] for k in self.keys.tolist()]]
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        self._fill_slots()
        # a piece that, once made, can take part in a better pair: its occurrences are merged one at a time
        self.eager = np.zeros(n + len(symbols) + 1, bool)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            in_piece = side < n
            self.eager[side[in_piece][self.ranks[in_piece] < rank[side[in_piece]]]] = True
        # decoding: the bytes of each id
        shown = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        shown[sp.unk_id()] = " ⁇ ".encode()
        self.sizes = np.array([len(x) for x in shown], np.int64)
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        # each id in decimal with a comma, filled up with zero bytes
        self.decimals = np.array([f"{i},".encode() for i in range(n)], "S8").view("<u8")
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def _fill_slots(self) -> None:
        """A hash table of the pairs, with linear probing; a free slot has the key -1 and no rank."""
        bits = max(4, int(4 * len(self.keys)).bit_length())
        self.shift, self.slots = np.uint32(32 - bits), 1 << bits
        self.slot_keys = np.full(self.slots, -1, np.int64)
        self.slot_ranks = np.full(self.slots, NONE, np.int32)
        keys, ranks = self.keys, self.ranks
        at = self._slot((keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32))
        while len(keys):
            free = self.slot_keys[at] == -1
            self.slot_keys[at[free]] = keys[free]
            placed = self.slot_keys[at] == keys
            self.slot_ranks[at[placed]] = ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], (at[~placed] + 1) % self.slots

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.view(np.uint32) * np.uint32(0x9E3779B1) + right.view(np.uint32) * np.uint32(0x85EBCA77) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; a symbol below 0 makes a key below 0, that no pair has."""
        key, at = left.astype(np.int64) << 32 | right, self._slot(left, right)
        found = self.slot_keys[at]
        same = found == key
        rank = np.where(same, self.slot_ranks[at], NONE)
        todo = np.flatnonzero(~same & (found != -1))
        while len(todo):
            at = (at if len(at) == len(todo) else at[todo]) + 1 & self.slots - 1
            found, key = self.slot_keys[at], key if len(key) == len(todo) else key[todo]
            same = found == key
            rank[todo[same]] = self.slot_ranks[at[same]]
            more = ~same & (found != -1)
            todo, at, key = todo[more], at[more], key[more]
        return rank

    def _symbols_of(self, text: str) -> np.ndarray:
        """A symbol per character; one without a symbol is kept as a negative number, so that it can fall back to bytes."""
        return self.symbol_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def merge_long(self, word: str) -> np.ndarray:
        """As ``merge``, of one word: the pair of least rank, then of least place, comes first from a queue."""
        sym = self._symbols_of(word)
        n = len(sym)
        pair = np.full(n, NONE, np.int64)
        near = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        pair[near] = self._rank(sym[near], sym[near + 1])
        at = np.flatnonzero(pair != NONE)
        queue = np.sort(pair[at] << 40 | at).tolist()  # a sorted list is a heap
        sym, pair, by_rank, rank_of = sym.tolist(), pair.tolist(), self.by_rank.tolist(), self.rank_of
        after, before, none = list(range(1, n + 1)), list(range(-1, n - 1)), int(NONE)
        pop, push, low = heapq.heappop, heapq.heappush, (1 << 40) - 1
        while queue:
            x = pop(queue)
            i, rank = x & low, x >> 40
            if pair[i] != rank:
                continue  # one of its symbols has gone into another pair
            j = after[i]
            sym[i] = a = by_rank[rank]
            pair[j] = none
            after[i] = k = after[j]
            sym[j] = None
            pair[i] = none
            if k < n:
                before[k] = i
                if sym[k] >= 0 and (r := rank_of.get(a << 32 | sym[k])) is not None:
                    pair[i] = r
                    push(queue, r << 40 | i)
            h = before[i]
            if h >= 0:
                pair[h] = none
                if sym[h] >= 0 and (r := rank_of.get(sym[h] << 32 | a)) is not None:
                    pair[h] = r
                    push(queue, r << 40 | h)
        out = np.array([s for s in sym if s is not None], np.int64)
        if (odd := np.flatnonzero((out < 0) | (out >= self.n))).size:
            out, _ = self._fall_back(out, np.zeros(len(out), np.int64), odd)
        return out.astype(np.int32)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; its spaces are already marked."""
        ids, bounds = self._merge("".join(words), np.fromiter(map(len, words), np.int64, len(words)))
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _merge(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of a text that is cut into words of these sizes, and where each word's begin and the last one's end."""
        sym = self._symbols_of(text)
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        pair = np.full(len(sym), NONE, np.int32)
        pair[:-1] = np.where(of[:-1] == of[1:], self._rank(sym[:-1], sym[1:]), NONE)
        done_sym, done_of = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.repeat(np.minimum.reduceat(pair, starts), np.diff(np.append(starts, len(sym))))
            left = least != NONE
            if not left.all():
                done_sym.append(sym[~left])
                done_of.append(of[~left])
            hit = np.flatnonzero((pair == least) & left)
            if not len(hit):
                break
            made = self.by_rank[least[hit]]
            first = np.concatenate([[True], of[hit][1:] != of[hit][:-1]])
            # among touching occurrences every second one is covered by its left neighbour
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1]) | first
            k = np.arange(len(hit))
            odd = (k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 1
            take = ~odd & (first | ~self.eager[made])
            hit, made = hit[take], made[take]
            sym[hit] = made
            left[hit + 1] = False
            at = np.cumsum(left)[hit] - 1
            sym, of, pair = sym[left], of[left], pair[left]
            # only pairs with a new symbol have changed
            pair[at] = NONE
            at = np.concatenate([at[at + 1 < len(sym)], at[at > 0] - 1])
            at = at[of[at] == of[at + 1]]
            pair[at] = self._rank(sym[at], sym[at + 1])
        sym, of = np.concatenate([np.zeros(0, np.int32), *done_sym]), np.concatenate([np.zeros(0, np.int32), *done_of])
        order = np.argsort(of, kind="stable")
        sym, of = sym[order], of[order]
        if (odd := np.flatnonzero((sym < 0) | (sym >= self.n))).size:
            sym, of = self._fall_back(sym, of, odd)
        return sym.astype(np.int32, copy=False), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))])

    def _fall_back(self, sym: np.ndarray, of: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = {s: c for c, s in self.symbols.items() if s >= self.n}
        repl = [self.byte_ids[np.frombuffer((chr(-1 - s) if s < 0 else names[s]).encode("utf-8", "replace"), np.uint8)] for s in sym[odd].tolist()]
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(x) for x in repl]
        out = np.repeat(sym, size)
        begin = np.cumsum(size) - size
        for i, ids in zip(odd.tolist(), repl, strict=True):
            out[begin[i] : begin[i] + len(ids)] = ids
        return out, np.repeat(of, size)

    def split(self, text: str) -> list[str]:
        text = " " + text.replace(SPACE, " ")
        if "  " not in text and text[-1] != " ":
            return text[1:].split(" ")
        return [w[1:] for w in _WORDS.findall(text)]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct words that the younger generation of the memory hasn't, as ``encode_batch`` gives them; words that
        aren't long are remembered there.  A full one becomes the older one, so that words still in use aren't merged again.
        A word is keyed without its first space."""
        fresh, long, todo, size = {}, {}, [], 0
        for w in words:
            if len(w) >= LONG:
                long[w] = self.merge_long((" " + w).replace(" ", SPACE)).astype("<u4").tobytes()
            elif (ids := self.older.get(w)) is not None:
                fresh[w] = ids
            else:
                todo.append(w)
                size += len(w) + 1
                if size >= ROUND_CHARS:
                    fresh |= self._merged(todo)
                    todo, size = [], 0
        fresh |= self._merged(todo)
        size = sum(map(len, fresh)) + sum(map(len, fresh.values()))
        if len(self.memory) + len(fresh) > MEMORY_WORDS or self.size + size > MEMORY_BYTES:
            self.older, self.memory, self.size = self.memory, {}, 0
        self.memory |= fresh
        self.size += size
        return fresh | long if long else fresh

    def _merged(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ids, bounds = self._merge((" " + " ".join(words)).replace(" ", SPACE) if words else "", sizes)
        raw, bounds = ids.astype("<u4", copy=False).tobytes(), (4 * bounds).tolist()
        return ((w, raw[a:b]) for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True))

    def encode_batch(self, batch: list[str | None]) -> list[tuple[bytes, str]]:
        """Per text: its ids as little-endian unsigned 32-bit integers, and in decimal joined by commas."""
        split = [self.split(t) if t else [] for t in batch]
        words = list(chain.from_iterable(split))
        got = list(map(self.memory.get, words))
        if new := {w for w, ids in zip(words, got, strict=True) if ids is None}:
            fresh = self.learn(new)
            got = [fresh[w] if ids is None else ids for w, ids in zip(words, got, strict=True)]
        out, at = [], 0
        for ws in split:
            ids = b"".join(got[at : at + len(ws)])
            at += len(ws)
            shown = self.decimals[np.frombuffer(ids, "<u4")].tobytes().translate(None, b"\0")
            out.append((ids, shown[:-1].decode()))
        return out

    def decode_batch(self, batch: list[bytes]) -> list[str]:
        """The texts of ids: pieces' bytes gathered into one array, the first space of each text left out, a byte that is no UTF-8 replaced."""
        ids = np.frombuffer(b"".join(batch), "<u4").astype(np.int64)
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.first[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        bounds = ends[np.cumsum([0] + [len(x) // 4 for x in batch])].tolist()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            raw = flat[a:b]
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = _decode_bytewise(raw)
            out.append(text[1:] if text[:1] == " " else text)
        return out


def _decode_bytewise(raw: bytes) -> str:
    """Each byte that begins no whole character becomes U+FFFD."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


_made = functools.cache(PieceTokens)


def piece_tokens(path: str) -> PieceTokens:
    """One per Python worker and file, until another operator takes the worker's memory."""
    take_memory("pieces", _made.cache_clear)
    return _made(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """Ids, their number and digest, and the text decoded from them with its digest, of every whole text.

    Without ``whole`` the ids and the decoded text are not handed on.
    """
    schema = ENCODED if whole else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digests(xs: list[str]) -> pa.Array:
        return pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in xs], pa.string())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_tokens(model)
        for b in batches:
            got = pieces.encode_batch(b["text"].to_pylist())
            ids = [x for x, _ in got]
            back = pieces.decode_batch(ids)
            cols = {"doc_id": b["doc_id"], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            cols |= {"ids": pa.array(ids, pa.binary())} if whole else {}
            cols |= {"ids_sha256": digests([x for _, x in got])}
            cols |= {"decoded": pa.array(back, pa.string())} if whole else {}
            yield pa.RecordBatch.from_pydict(cols | {"decoded_sha256": digests(back)})

    rows_per_batch(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(encode, schema)
