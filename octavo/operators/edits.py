"""Edits of byte sequences, and the log of edits.

A log is a table ``(data_id, seq, op, offset, length, payload)``; ``op`` is ``ins``, ``ovr`` or ``del``,
offsets count in the sequence as it is when the edit's turn comes.  Two physical forms give the same
result: ``fold_log`` replays a log over the content in one expression (small sequences), ``piece_table``
replays it over references to the content's and payloads' ranges and touches bytes only once, at the end.

Defined cases: an insert beyond the end first fills with zeros; an overwrite may extend the sequence; a
delete removes what there is; an empty result is an empty sequence; a log without base data is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import byte_text
from ..functions.views import byte_slice, gather
from ..sources.binary import framed_random

MODS = "data_id, seq, op, offset, length, payload"


def _int(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def _filled(x: Column, size: Column) -> Column:
    return F.when(F.octet_length(x) < size, F.rpad(x, size, b"\0")).otherwise(x)


def insert(x: Column, offset: Column | int, payload: Column) -> Column:
    at = _int(offset)
    return F.concat(F.substring(_filled(x, at), F.lit(1), at), payload, F.substring(x, at + 1, F.octet_length(x)))


def delete(x: Column, offset: Column | int, length: Column | int) -> Column:
    at, n = _int(offset), _int(length)
    return F.concat(F.substring(x, F.lit(1), at), F.substring(x, at + n + 1, F.octet_length(x)))


def overwrite(x: Column, offset: Column | int, payload: Column) -> Column:
    at, n = _int(offset), F.octet_length(payload)
    return F.concat(F.substring(_filled(x, at), F.lit(1), at), payload, F.substring(x, at + n + 1, F.octet_length(x)))


def delete_segments(x: Column, segments: Column) -> Column:
    """Without an array of disjoint closed intervals, all of them in the original's positions."""
    highest_first = F.reverse(F.array_sort(segments))
    return F.aggregate(highest_first, x, lambda a, s: delete(a, s["first"], s["last"] - s["first"] + 1))


def replace_segments(x: Column, segments: Column, payload: Column) -> Column:
    """The selection replaced: overwritten where it is one interval of the payload's size, else deleted and the payload inserted at its start."""
    one = F.try_element_at(segments, F.lit(1))
    same = (F.size(segments) == 1) & (one["last"] - one["first"] + 1 == F.octet_length(payload))
    start = F.array_min(F.transform(segments, lambda s: s["first"]))
    return F.when(same, overwrite(x, one["first"], payload)).otherwise(insert(delete_segments(x, segments), start, payload))


def replaced_selection(segments: Column, payload: Column) -> Column:
    """The selection after ``replace_segments``: the payload's place."""
    start = F.array_min(F.transform(segments, lambda s: s["first"])).cast("long")
    return F.struct(start.alias("first"), (start + F.octet_length(payload) - 1).alias("last"))


def delete_by_gather(x: Column, rest: Column) -> Column:
    """Deletion as a gather of the complement's intervals."""
    return gather(x, rest)


def apply_one(x: Column, op: Column, offset: Column, length: Column, payload: Column) -> Column:
    return F.when(op == "ins", insert(x, offset, payload)).when(op == "ovr", overwrite(x, offset, payload)).when(op == "del", delete(x, offset, length)).otherwise(x)


def as_of(mods: DataFrame, seq: int) -> DataFrame:
    """The log up to an edit: folding it undoes what came later."""
    return mods.where(F.col("seq") <= seq)


def fold_log(base: DataFrame, mods: DataFrame, data_id: str = "data_id", content: str = "content") -> DataFrame:
    """``base`` with each sequence's log applied in order of ``seq``; without a log a sequence is as it was."""
    log = mods.groupBy(F.col("data_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "offset", "length", "payload"))).alias("_log"))
    got = F.aggregate("_log", F.col(content), lambda a, m: apply_one(a, m["op"], m["offset"], m["length"], m["payload"]))
    return base.join(log, F.col(data_id) == F.col("_id"), "left").withColumn(content, F.coalesce(got, F.col(content))).drop("_id", "_log")


def pieces_after(length: int, log: list[tuple[str, int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces ``(source, first, length)`` of a sequence after a log of ``(op, offset, length, source)``; source -1 is the base, -2 zeros."""
    pieces = [(-1, 0, length)] if length else []

    def cut(at: int) -> int:
        """The place in ``pieces`` where a piece begins at ``at``, splitting one if need be."""
        for k, (source, first, size) in enumerate(pieces):
            if at <= 0:
                return k
            if at < size:
                pieces[k : k + 1] = [(source, first, at), (source, first + at if source != -2 else 0, size - at)]
                return k + 1
            at -= size
        if at > 0:
            pieces.append((-2, 0, at))
        return len(pieces)

    for op, offset, size, source in log:
        total = sum(p[2] for p in pieces)
        if op == "del":
            if offset < total:
                a = cut(offset)
                b = cut(min(offset + size, total))
                del pieces[a:b]
        elif op in ("ins", "ovr"):
            a = cut(offset)
            if op == "ovr":
                b = cut(min(offset + size, max(total, offset)))
                del pieces[a:b]
            if size:
                pieces.insert(a, (source, 0, size))
    return pieces


def piece_table(base: DataFrame, mods: DataFrame, data_id: str = "data_id", length: str = "length") -> DataFrame:
    """``data_id, piece_no, seq, first, size, start``: the pieces of every edited sequence, without touching a byte.

    ``seq`` names the edit whose payload a piece is part of; -1 is the base, -2 are zeros.  A sequence's log meets in one
    row, whose pieces are found in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for k, (total, log) in enumerate(zip(b["total"].to_pylist(), b["log"].to_pylist(), strict=True)):
                got = pieces_after(total, [(m["op"], m["offset"], m["size"], m["seq"]) for m in log])
                start = 0
                for no, (seq, first, size) in enumerate(got):
                    out.append((no, seq, first, size, start))
                    start += size
                row += [k] * len(got)
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ("piece_no", "seq", "first", "size", "start")
            yield pa.RecordBatch.from_pydict({"data_id": b["data_id"].take(pa.array(row, pa.int64()))} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    size = F.when(F.col("op") == "del", F.col("length")).otherwise(F.octet_length("payload")).cast("long").alias("size")
    entry = F.struct(F.col("seq").cast("long").alias("seq"), "op", F.col("offset").cast("long").alias("offset"), size)
    log = mods.groupBy("data_id").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    sized = log.join(base.select(F.col(data_id).alias("data_id"), F.col(length).cast("long").alias("total")), "data_id")
    kind = base.schema[data_id].dataType.simpleString()
    return sized.select("data_id", "total", "log").mapInArrow(run, f"data_id {kind}, piece_no int, seq long, first long, size long, start long")


def materialise(base: DataFrame, mods: DataFrame, pieces: DataFrame, data_id: str = "data_id", content: str = "content") -> DataFrame:
    """The bytes of a piece table: each sequence's content, payloads and pieces meet once, in one row."""
    own = base.select(F.col(data_id).alias("data_id"), F.col(content).alias("_base"))
    paid = mods.where("payload IS NOT NULL").groupBy("data_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seq").cast("long"), "payload"))).alias("_paid"))
    listed = pieces.groupBy("data_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "seq", "first", "size"))).alias("p"))

    def part(p: Column) -> Column:
        return (
            F.when(p["seq"] == -1, byte_slice(F.col("_base"), p["first"], p["size"]))
            .when(p["seq"] == -2, F.rpad(F.lit(b"").cast("binary"), p["size"].cast("int"), b"\0"))
            .otherwise(byte_slice(F.try_element_at("_paid", p["seq"]), p["first"], p["size"]))
        )

    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, part(p)))
    return listed.join(own, "data_id").join(paid, "data_id", "left").select("data_id", joined.alias(content))


def span(pieces: DataFrame) -> DataFrame:
    """Start and length of the merged view of each sequence."""
    end = F.max(F.col("start") + F.col("size"))
    return pieces.groupBy("data_id").agg(F.min("start").alias("start"), (end - F.min("start")).alias("length"))


def chunked(base: DataFrame, size: int, data_id: str = "data_id", content: str = "content") -> DataFrame:
    """Rows of at most ``size`` bytes ``(data_id, chunk_no, chunk_start, bytes)``, for content too large for one cell's operators."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, x in zip(f["data_id"], f["content"], strict=True):
                if x is not None:
                    starts = list(range(0, len(x), size))
                    yield pd.DataFrame({"data_id": key, "chunk_no": range(len(starts)), "chunk_start": starts, "bytes": [bytes(x[s : s + size]) for s in starts]})

    kind = base.schema[data_id].dataType.simpleString()
    rows = base.select(F.col(data_id).alias("data_id"), F.col(content).alias("content"))
    return rows.mapInPandas(cut, f"data_id {kind}, chunk_no long, chunk_start long, bytes binary")


def command_edit(x: Column, pos: Column | int, text: Column) -> Column:
    """One byte, given as text, written over position ``pos``; unchanged where the text is no byte."""
    byte = byte_text(text)
    return F.when(byte.isNotNull(), overwrite(x, pos, F.unhex(F.lpad(F.hex(F.pmod(byte, F.lit(256))), 2, "0")))).otherwise(x)


def insert_block(x: Column, offset: Column | int, n: int = 64, seed: int = 0) -> Column:
    """A framed random block of ``n`` bytes inserted."""
    return insert(x, offset, F.lit(framed_random(n, seed)))
