"""Edits and selection changes as streams.

``live_pieces`` keeps each sequence's pieces as state and applies edits in order of ``seq``: an edit that
comes early waits in the state until those before it are there.  ``live_content`` instead appends each
micro-batch to a log table and folds the log again.  ``live_changes`` joins the changes of a gesture.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edits import fold_log, pieces_after

PIECES = "data_id long, seq long, pieces string, length long"
_STATE = "next long, pieces string, waiting string"


def _apply(pieces: list[tuple[int, int, int]], edit: tuple[str, int, int, int]) -> list[tuple[int, int, int]]:
    """One edit on pieces: replayed over their concatenation as if that were the base, then mapped back."""
    total = sum(p[2] for p in pieces)
    out = []
    for source, first, size in pieces_after(total, [edit]):
        if source != -1:
            out.append((source, first, size))
            continue
        at = 0
        for s, f, n in pieces:
            a, b = max(first, at), min(first + size, at + n)
            if a < b:
                out.append((s, f + a - at if s != -2 else 0, b - a))
            at += n
    return out


def live_pieces(mods: DataFrame) -> DataFrame:
    """A stream of edits ``(data_id, seq, op, offset, length)`` (``seq`` from 1 without gaps per sequence, from an empty sequence on; ``length``
    of an insert or overwrite is its payload's) as a stream of the pieces after each batch.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, pieces, waiting = 1, [], {}
        if state.exists:
            following, shown, held = state.get
            pieces, waiting = [tuple(p) for p in json.loads(shown)], {int(k): v for k, v in json.loads(held).items()}
        for f in frames:
            for seq, op, offset, length in zip(f["seq"], f["op"], f["offset"], f["length"], strict=True):
                if int(seq) >= following:
                    waiting[int(seq)] = (op, int(offset), int(length), int(seq))
        moved = False
        while following in waiting:
            pieces = _apply(pieces, tuple(waiting.pop(following)))
            following, moved = following + 1, True
        state.update((following, json.dumps(pieces), json.dumps(waiting)))
        if moved:
            yield pd.DataFrame({"data_id": [key[0]], "seq": [following - 1], "pieces": [json.dumps(pieces)], "length": [sum(p[2] for p in pieces)]})

    return mods.groupBy("data_id").applyInPandasWithState(run, PIECES, _STATE, "update", GroupStateTimeout.NoTimeout)


def live_content(base: DataFrame, log_path: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append the batch to the log and hand the sequences it touched, with their whole log folded, to ``sink``."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/epoch={epoch}")  # the same epoch again replaces itself
        log = batch.sparkSession.read.schema(batch.schema).parquet(f"{log_path}/epoch=*")
        touched = batch.select("data_id").distinct()
        sink(fold_log(base.join(touched, "data_id", "left_semi"), log.join(touched, "data_id", "left_semi")), epoch)

    return run


def live_changes(events: DataFrame, gap: str = "5 seconds", late: str = "1 minute", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Selection changes ``(key, ts, first, last)`` as one change per gesture, which ends after ``gap`` without a change."""
    session = F.session_window(ts, gap)
    got = events.withWatermark(ts, late).groupBy(key, session.alias("gesture"))
    got = got.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("changes"))
    return got.select(key, F.col("gesture.start").alias("begun"), "first", "last", "changes")


def tagged(events: DataFrame, kinds: dict[str, str], kind: str = "event_type") -> DataFrame:
    """Events of several sources in one stream, by the names that listeners know them by."""
    named = F.lit(None).cast("string")
    for raw, name in kinds.items():
        named = F.when(F.col(kind) == raw, name).otherwise(named)
    return events.withColumn("event", named).where("event is not null")
