"""Interval algebra against sets of positions, edits against Python bytes."""

import random

import pytest
from pyspark.sql import functions as F

from octavo.operators import edits, intervals

K = ["k"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, first long, last long")


def spots(rows):
    out = {}
    for k, a, b in rows:
        out.setdefault(k, set()).update(range(a, b + 1))
    return out


def islands(sets):
    out = set()
    for k, s in sets.items():
        for p in sorted(s):
            if p - 1 not in s:
                start = p
            if p + 1 not in s:
                out.add((k, start, p))
    return out


def rows(df):
    return {tuple(r) for r in df.select("k", "first", "last").collect()}


@pytest.fixture(scope="module")
def two(spark):
    r = random.Random(5)
    a, b = ([(r.randrange(6), s, s + r.randrange(12)) for s in (r.randrange(150) for _ in range(80))] for _ in range(2))
    return a, b


def test_vectors(spark):
    assert rows(intervals.union(frame(spark, [(0, 0, 3), (0, 4, 6), (1, 0, 3), (1, 5, 6)]), K)) == {(0, 0, 6), (1, 0, 3), (1, 5, 6)}
    assert rows(intervals.union(frame(spark, [(0, 0, 8), (0, 8, 16), (1, 0, 8), (1, 9, 16)]), K, half_open=True)) == {(0, 0, 16), (1, 0, 8), (1, 9, 16)}
    assert rows(intervals.difference(frame(spark, [(0, 0, 9)]), frame(spark, [(0, 3, 5)]), K)) == {(0, 0, 2), (0, 6, 9)}
    assert rows(intervals.slice_positions(frame(spark, [(0, 0, 9), (0, 20, 29)]), K, 7, 8)) == {(0, 7, 9), (0, 20, 24)}
    assert rows(intervals.slice_positions(frame(spark, [(0, 0, 9)]), K, -2, 4)) == {(0, 0, 1)}
    assert rows(intervals.difference(frame(spark, [(0, 8, 24)]), frame(spark, [(0, 12, 16)]), K, half_open=True)) == {(0, 8, 12), (0, 16, 24)}


def test_set_model(spark, two):
    a, b = two
    fa, fb, sa, sb = frame(spark, a), frame(spark, b), spots(a), spots(b)
    keys = set(sa) | set(sb)
    assert rows(intervals.union(fa, K)) == islands(sa)
    assert rows(intervals.difference(fa, fb, K)) == islands({k: sa.get(k, set()) - sb.get(k, set()) for k in keys})
    assert rows(intervals.intersection(fa, fb, K)) == islands({k: sa.get(k, set()) & sb.get(k, set()) for k in keys})
    normal = intervals.union(fa, K)
    assert rows(intervals.slice_positions(normal, K, 5, 17)) == islands({k: set(sorted(s)[5:22]) for k, s in sa.items()})
    stats = {r["k"]: (r["lowest"], r["highest"], r["positions"]) for r in intervals.stats(normal, K).collect()}
    assert stats == {k: (min(s), max(s), len(s)) for k, s in sa.items()}
    points = spark.createDataFrame([(k, p) for k in range(6) for p in range(0, 180, 3)], "k long, pos long")
    got = {tuple(r) for r in intervals.members(points, normal, K, bucket=16).collect()}
    assert got == {(k, p) for k in range(6) for p in range(0, 180, 3) if p in sa.get(k, ())}
    assert rows(intervals.union(intervals.insert_space(normal, K, F.lit(60), F.lit(7)), K)) == islands({k: {p + 7 if p >= 60 else p for p in s} for k, s in sa.items()})
    assert rows(intervals.remove_space(normal, K, 60, 7)) == islands({k: {p - 7 if p >= 67 else p for p in s if not 60 <= p < 67} for k, s in sa.items()})
    changes = spark.createDataFrame([(k, 40, 50, 50) for k in range(6)], "k long, first long, last long, tail long")
    toggled = {k: sa.get(k, set()) - set(range(40, 51)) if 50 in sa.get(k, ()) else sa.get(k, set()) | set(range(40, 51)) for k in range(6)}
    assert rows(intervals.toggle(normal, changes, K)) == islands(toggled)


def test_bits_are_half_open(spark):
    iv, points = frame(spark, [(0, 8, 16)]), spark.createDataFrame([(0, p) for p in (7, 8, 15, 16)], "k long, pos long")
    assert {r["pos"] for r in intervals.members(points, iv, K, half_open=True).collect()} == {8, 15}


def test_insert_keeps_both_halves(spark):
    assert rows(intervals.insert_space(frame(spark, [(0, 0, 9)]), K, F.lit(4), F.lit(2))) == {(0, 0, 3), (0, 6, 11)}


def test_small_ones(spark):
    got = spark.range(1).select(
        intervals.cell_index(F.lit(2), F.lit(3), 16), intervals.cell_index(F.lit(2), F.lit(0), 16), intervals.index_cell(F.lit(34), 16),
        intervals.shift_left(F.lit(10), F.lit(20), F.lit(15)), intervals.shift_left(F.lit(1), F.lit(5), F.lit(6)),
        intervals.changed_range(F.lit(4), F.lit(9), F.lit(2), F.lit(5)), intervals.normalised(F.lit(9), F.lit(2)),
        intervals.summary(F.lit(0), F.lit(0)), intervals.summary(F.lit(1), F.lit(5)), intervals.summary(F.lit(3), F.lit(5)),
    ).first()
    assert [tuple(v) if hasattr(v, "asDict") else v for v in got] == [34, -2, (2, 3), (0, 5), None, (2, 9), (2, 9), "empty", "5 bytes", "3 segs"]
    assert intervals.union(frame(spark, []), K).count() == 0
    d = spark.createDataFrame([(1, "a", "b")], "k long, first_name string, last_name string")
    v = spark.createDataFrame([(1, "a", 5), (1, "b", 9)], "k long, name string, value long")
    assert rows(intervals.expression_intervals(d, v, K)) == {(1, 5, 9)}


def model(x, log):
    for op, o, n, p in log:
        if op == "del":
            x = x[:o] + x[o + n :]
        else:
            head = x[:o] + bytes(max(0, o - len(x)))
            x = head + p + x[o + (len(p) if op == "ovr" else 0) :]
    return x


def test_logs(spark):
    r = random.Random(11)
    base = {k: r.randbytes(r.randrange(0, 30)) for k in range(25)}
    logs = {k: [(r.choice(["ins", "ovr", "del"]), r.randrange(0, 36), r.randrange(0, 9), r.randbytes(r.randrange(0, 6))) for _ in range(r.randrange(0, 14))] for k in base}
    b = spark.createDataFrame([(k, bytearray(x), len(x)) for k, x in base.items()], "data_id long, content binary, length long")
    m = spark.createDataFrame([(k, s, *e[:3], bytearray(e[3])) for k, log in logs.items() for s, e in enumerate(log, 1)], "data_id long, seq long, op string, offset long, length long, payload binary")
    expected = {k: model(base[k], logs[k]) for k in base}
    assert {r["data_id"]: bytes(r["content"]) for r in edits.fold_log(b, m).collect()} == expected
    pieces = edits.piece_table(b, m)
    got = {r["data_id"]: bytes(r["content"]) for r in edits.materialise(b, m, pieces).collect()}
    assert got == {k: x for k, x in expected.items() if logs[k] and x}
    spans = {r["data_id"]: (r["start"], r["length"]) for r in edits.span(pieces).collect()}
    assert spans == {k: (0, len(x)) for k, x in got.items()}
    early = {r["data_id"]: bytes(r["content"]) for r in edits.fold_log(b, edits.as_of(m, 3)).collect()}
    assert early == {k: model(base[k], logs[k][:3]) for k in base}


def segs(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in pairs])


def test_edit_vectors(spark):
    x, p = F.col("x"), F.lit(b"\xaa\xbb\xcc")
    df = spark.createDataFrame([(bytearray(b"\x01\x02"),)], "x binary")
    got = df.select(edits.overwrite(x, 1, p), edits.delete(x, 0, 2), edits.insert(x, 4, p), edits.insert(x, 1, p)).first()
    assert [bytes(v) for v in got] == [b"\x01\xaa\xbb\xcc", b"", b"\x01\x02\0\0\xaa\xbb\xcc", b"\x01\xaa\xbb\xcc\x02"]
    ten = spark.createDataFrame([(bytearray(range(10)),)], "x binary")
    got = ten.select(edits.delete_segments(x, segs((0, 1), (4, 5))), edits.replace_segments(x, segs((2, 4)), p), edits.replace_segments(x, segs((0, 1), (4, 5)), p)).first()
    assert [bytes(v) for v in got] == [bytes([2, 3, 6, 7, 8, 9]), bytes([0, 1, 0xAA, 0xBB, 0xCC, 5, 6, 7, 8, 9]), bytes([0xAA, 0xBB, 0xCC, 2, 3, 6, 7, 8, 9])]
    assert tuple(ten.select(edits.replaced_selection(segs((0, 1), (4, 5)), p)).first()[0]) == (0, 2)


def test_chunks(spark):
    df = spark.createDataFrame([(1, bytearray(range(10))), (2, bytearray()), (3, None)], "data_id long, content binary")
    got = [(r["data_id"], r["chunk_no"], r["chunk_start"], bytes(r["bytes"])) for r in edits.chunked(df, 4).orderBy("chunk_no").collect()]
    assert got == [(1, 0, 0, bytes(range(4))), (1, 1, 4, bytes(range(4, 8))), (1, 2, 8, bytes([8, 9]))]


def test_command_and_block(spark):
    from octavo.functions import codec

    x = F.col("x")
    df = spark.createDataFrame([(bytearray(b"abc"),)], "x binary")
    got = df.select(edits.command_edit(x, 1, F.lit("0x7a")), edits.command_edit(x, 3, F.lit("-1")), edits.command_edit(x, 0, F.lit("999")), edits.insert_block(x, 1, 8, 3)).first()
    assert [bytes(v) for v in got[:3]] == [b"azc", b"abc\xff", b"abc"] and bytes(got[3])[:2] == b"a\x00" and bytes(got[3])[8:] == b"\xffbc"
    items = F.array(F.lit(1), F.lit(2), F.lit(3))
    got = df.select(codec.list_at(items, F.lit(2)), codec.list_at(items, F.lit(3)), codec.list_resized(items, 2, F.lit(0)), codec.list_resized(items, 5, F.lit(0)), codec.list_assigned(items, F.lit(1), F.lit(9)), codec.narrow(F.lit(2**31 + 5), 32)).first()
    assert got[:] == (3, None, [1, 2], [1, 2, 3, 0, 0], [1, 9, 3], 5 - 2**31)
