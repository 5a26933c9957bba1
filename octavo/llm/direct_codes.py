"""Token ids as directly addressable codes, in files of their own format.

An id is cut into chunks from its low bits up, one level of chunks per row of ``WIDTHS``.  Every level
keeps a bitmap that says which of its chunks go on in the next level, and a directory with the number of
such chunks before every block of the bitmap; the place of a chunk's continuation is therefore a directory
entry plus the set bits of one block, and any id can be had without decoding its neighbours.

File: ``MAGIC``, counts, document ids, document starts, levels.  All integers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"OCTDAC01"
WIDTHS = (8, 8, 16)
#: Bits of a bitmap per directory entry.
BLOCK = 512
_TYPES = {8: "u1", 16: "<u2"}
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
#: Stands for a null document id.
NULL_ID = -(1 << 63)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: its chunks, its continuation bitmap, its rank directory."""
    rest, out = ids.astype(np.uint32), []
    for k, width in enumerate(WIDTHS):
        chunks = (rest & np.uint32((1 << width) - 1)).astype(_TYPES[width])
        rest = rest >> np.uint32(width)
        goes_on = rest != 0 if k + 1 < len(WIDTHS) else np.zeros(len(rest), bool)
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, np.uint8)
        padded[: len(rest)] = goes_on
        per_block = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(per_block, dtype=np.uint64)]).astype("<u8")
        out.append((chunks, np.packbits(padded, bitorder="little"), ranks))
        rest = rest[goes_on]
    return out


def to_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's content."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    named = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    parts = [MAGIC, struct.pack("<QQ", len(doc_ids), len(ids)), named.tobytes(), starts.tobytes()]
    for chunks, bitmap, ranks in encode_levels(ids):
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class TokenFile:
    """Reads a file's content; ``buffer`` may be mapped, only what is asked for is touched."""

    def __init__(self, buffer):
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens = struct.unpack_from("<QQ", buffer, 8)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(buffer, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.starts = take("<i8", n_docs), take("<u8", n_docs + 1)
        self.levels = []
        for width in WIDTHS:
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((width, take(_TYPES[width], n), take("u1", blocks * BLOCK // 8), take("<u8", blocks + 1)))

    def __len__(self) -> int:
        return self.n_tokens

    def get(self, places) -> np.ndarray:
        """The ids at any places, each by its own chain of chunks."""
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.n_tokens):
            raise IndexError("no such token")
        out, open_, at, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), places, 0
        for width, chunks, bitmap, ranks in self.levels:
            out[open_] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            goes_on = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            open_, at = open_[goes_on], at[goes_on]
            if not len(at):
                break
            # set bits before ``at``: a directory entry, the whole bytes of its block, part of a byte
            first = at // BLOCK * (BLOCK // 8)
            cols = first[:, None] + np.arange(BLOCK // 8)
            whole = np.where(cols < (at >> 3)[:, None], _BITS[bitmap[cols]], 0).sum(axis=1)
            part = _BITS[bitmap[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)]
            at, shift = ranks[at // BLOCK].astype(np.int64) + whole + part, shift + width
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, open_, shift = np.zeros(self.n_tokens, np.uint32), None, 0
        for width, chunks, bitmap, _ in self.levels:
            if open_ is None:
                out |= chunks
            else:
                out[open_] |= chunks.astype(np.uint32) << np.uint32(shift)
            goes_on = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))
            if not len(goes_on):
                break
            open_, shift = goes_on if open_ is None else open_[goes_on], shift + width
        return out

    def range(self, first: int, last: int) -> np.ndarray:
        """The ids from place ``first`` up to ``last``: on each level the chunks of a range lie together, from the rank of its first place on."""
        if not 0 <= first <= last <= self.n_tokens:
            raise IndexError("no such tokens")
        out, open_, shift = np.zeros(last - first, np.uint32), None, 0
        for width, chunks, bitmap, ranks in self.levels:
            part = chunks[first:last]
            if open_ is None:
                out |= part
            else:
                out[open_] |= part.astype(np.uint32) << np.uint32(shift)
            block = first // BLOCK
            # from the block's first bit on: those before the range add to the rank, those in it say what goes on
            bits = np.unpackbits(bitmap[block * (BLOCK // 8) : (last + 7) >> 3], count=last - block * BLOCK, bitorder="little")
            before = first - block * BLOCK
            goes_on = np.flatnonzero(bits[before:])
            if not len(goes_on):
                break
            open_, shift = goes_on if open_ is None else open_[goes_on], shift + width
            first = int(ranks[block]) + int(np.count_nonzero(bits[:before]))
            last = first + len(goes_on)
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))
