"""Templates, grids, references, sources, streams."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from octavo.functions import codec, formats
from octavo.operators import graph, grid, templates
from octavo.sources import binary
from octavo.streaming import live


def test_template(spark):
    layout = [
        templates.Field("u16", "int", 0, 2, codec.UNSIGNED, codec.LITTLE), templates.Field("flag", "bit", 24), templates.Field("k", "bits", 16, 5),
        templates.Field("s", "string", 4, 3), templates.Field("l", "list", 0, 8, item=2), templates.Field("m", "magic", 0, magic=b"\x01\x02"), templates.Field("r", "region", 3, 4),
    ]
    df = binary.from_bytes(spark, b"\x01\x02\xf8\x01abcd", b"\x01")
    full, short = templates.records(df.orderBy("data_id"), "content", layout).collect()
    assert full[:] == (513, True, 31, "abc", [258, 63489, 24930, 25444], True, (3, 6))
    assert short[:] == (None, None, None, None, [], False, (3, 6))
    again = templates.layout_from(templates.layout_table(spark, layout[:4]))
    assert [(f.name, f.type, f.offset, f.length) for f in again] == sorted([(f.name, f.type, f.offset, f.length) for f in layout[:4]], key=lambda f: (f[2], f[0]))
    with pytest.raises(ValueError):
        templates.column(F.col("x"), templates.Field("a", "float", 0))
    templates.register_type("first", lambda x, f: F.substring(F.hex(x), 1, 2))
    assert templates.records(df, "content", [templates.Field("a", "first", 0)]).first()[0] == "01"


def test_pages_are_saved_together(spark):
    good = spark.createDataFrame([(1, True, True), (2, False, False)], "page int, modified boolean, valid boolean")
    assert [r["page"] for r in templates.save_modified(good).collect()] == [1]
    bad = spark.createDataFrame([(1, True, True), (2, True, False)], "page int, modified boolean, valid boolean")
    with pytest.raises(Exception, match="not valid"):
        templates.save_modified(bad).collect()
    labels = spark.range(6).select(templates.choice_label(F.col("id").cast("int"), codec.SIGN_LABELS)).collect()
    assert [r[0] for r in labels] == [*codec.SIGN_LABELS, None]


def test_grid(spark):
    df = binary.from_bytes(spark, bytes(range(40)), b"").where("length > 0")
    x = F.col("content")
    assert df.select(grid.row_count(F.col("length")), grid.cell(x, 2, 8), grid.cell(x, 2, 9), grid.cell(x, 0, 1)).first()[:] == (3, 39, None, 0)
    lines = grid.hex_dump(df, "content", 16).orderBy("addr").collect()
    assert [(r["addr"], r["addr_hex"], r["hex_bytes"][:4]) for r in lines] == [(0, "00000000", "0001"), (16, "00000010", "1011"), (32, "00000020", "2021")]
    assert [r["row_no"] for r in grid.rows_of(df, "content", 16, 1, 1).collect()] == [1]
    text = grid.page(df, "content").where("row_no = 2").first()["line_text"]
    assert text.startswith("0000:0020  20 21 22") and text.endswith(" !\"#$%&'")
    assert [grid.heading(c) for c in (0, 1, 17)] == ["addr", "0", "10"]
    assert [r["start"] for r in grid.column_offsets(spark, 9).orderBy("col").collect()] == [0, 3, 6, 9, 13, 16, 19, 22, 27]
    parts = spark.createDataFrame([(1, 10, 5), (1, 20, 9)], "g int, width int, height int")
    assert grid.group_size(parts, ["g"]).first()[:] == (1, 30, 9)


def test_page_is_made_without_a_function_per_byte(spark, capsys):
    r = random.Random(4)
    xs = [bytes(range(256)), b"", b"  ", b" ." * 20, bytes(33), *(r.randbytes(n) for n in (1, 15, 16, 17, 1000)), ("é\n .~\x7f" * 9).encode(), None]
    df = spark.createDataFrame([(k, x if x is None else bytearray(x)) for k, x in enumerate(xs)], "k long, x binary")
    got = grid.page(df, "x", "k")
    page = " " + formats.code_page_437()[1:]
    want = []
    for k, x in enumerate(xs):
        for row in range(-(-len(x or b"") // 16)):
            line, at = x[16 * row : 16 * row + 16], f"{16 * row:08x}"
            text = "".join(chr(b) if 32 <= b <= 126 else "." for b in line)
            want.append((k, row, "  ".join((f"{at[:4]}:{at[4:]}", line.hex(" "), text, "".join(page[b] for b in line)))))
    assert sorted(map(tuple, got.collect())) == want
    got.explain()
    assert "lambda" not in capsys.readouterr().out
    far = spark.range(1).select(*[formats.address_with_colon(F.lit(v)) for v in (0, 8 * 0x12ABC + 3, 8 * 0x123456789)]).first()
    assert far[:] == ("0000:0000", "0001:2abc.3", "1234:56789")


def test_references(spark):
    edges = spark.createDataFrame([("a", "b", "ref"), ("b", "c", "ref"), ("x", "y", "ref"), ("y", "x", "ref"), ("d", "c", "part")], "src string, dst string, role string")
    got = {r["node"]: (r["final"], r["hops"]) for r in graph.dereferenced(edges).collect()}
    assert got == {"a": ("c", 2), "b": ("c", 1), "x": (None, None), "y": (None, None)}
    changed = spark.createDataFrame([("c",)], "node string")
    assert {(r["node"], r["depth"]) for r in graph.dependents(edges, changed).collect()} == {("b", 1), ("a", 2), ("d", 1)}
    assert {r["node"]: r["sinks"] for r in graph.fan_out(edges).collect()} == {"b": 1, "c": 2, "x": 1, "y": 1}
    assert {r["dst"] for r in graph.owned(edges).collect()} == {"b", "x", "y"}
    assert {r["dst"] for r in graph.sources(edges, "a").collect()} == {"b"}
    nodes = spark.createDataFrame([("a", "int", 1), ("b", "string", 2), ("c", "int", 3)], "node string, type string, value long")
    types = spark.createDataFrame([("any", None), ("int", "any"), ("string", "any")], "type string, base string")
    assert {r["node"] for r in graph.of_type(nodes, types, "int").collect()} == {"a", "c"}
    assert [r["node"] for r in graph.candidates(nodes, types, "any", "c").collect()] == ["c", "a", "b"]
    assert {r["node"]: r["value"] for r in graph.evaluated(nodes, edges).collect()} == {"a": 3, "b": 3, "c": 3}
    slots = spark.createDataFrame([("s", "any")], "slot string, expected string")
    value = lambda t: spark.createDataFrame([("s", "a", t)], "slot string, node string, type string")
    assert graph.assign(slots, value("int"), types).first()["fits"] is True
    with pytest.raises(Exception, match="wrong type"):
        graph.assign(spark.createDataFrame([("s", "int")], "slot string, expected string"), value("string"), types).collect()
    assert graph.find_or_add(changed, spark.createDataFrame([("c",), ("q",)], "node string"), ["node"]).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w") as z:
        z.writestr("one.txt", b"first")
        z.writestr("two.txt", b"")
    found = binary.files(spark, str(tmp_path / "in"))
    assert sorted(r["length"] for r in found.select("length").collect())[0] == 3
    entries = {r["data_id"].split("!")[1]: bytes(r["content"]) for r in binary.zip_entries(found).collect()}
    assert entries == {"one.txt": b"first", "two.txt": b""}
    binary.save(binary.files(spark, str(tmp_path / "in"), "*.bin"), str(tmp_path / "out"))
    assert bytes(spark.read.parquet(str(tmp_path / "out")).first()["content"]) == b"abc"
    demo = binary.demo()
    assert demo[32:48] == bytes.fromhex("0123456789abcdef" * 2) and demo[64:320] == bytes(range(256)) and demo[912:916].hex() == "243f6a88" and len(demo) == 1152
    frame = binary.framed_random(64, 1)
    assert (frame[0], frame[-1], len(frame)) == (0, 255, 64) and frame == binary.framed_random(64, 1) and binary.framed_random(0, 1) == b""
    assert binary.grey_image([(30, 60, 90, 255), (0, 0, 0, 0)], 7) == bytes([255 - 60, 7])
    assert binary.empty(spark).first()["length"] == 0
    assert {r["data_id"] for r in binary.ordered(binary.generated(spark)).collect()} == {"framed_random", "nibbles", "bytes", "counter", "pi", "demo"}


def test_file_set(spark):
    files = binary.FileSet(spark)
    files.activate("first_file", binary.from_bytes(spark, b"1"))
    files.activate("second_file", binary.from_bytes(spark, b"2"))
    files.guards.append(lambda name: name != "first_file")
    assert not files.close_all() and files.open_names == ["first_file", "second_file"]
    assert files.close("second_file") and files.active == "first_file" and not spark.catalog.tableExists("second_file")
    files.guards.clear()
    assert files.close_all() and files.active is None


def test_live_pieces(spark, tmp_path):
    schema = "data_id long, seq long, op string, offset long, length long"
    batches = [[(1, 2, "ins", 1, 2), (2, 1, "ins", 0, 4)], [(1, 1, "ins", 0, 3)], [(1, 3, "del", 0, 2), (2, 2, "ovr", 2, 5)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "mods" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "mods" / "*"))
    q = live.live_pieces(stream).writeStream.format("memory").queryName("pieces_now").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("SELECT * FROM pieces_now ORDER BY seq").collect():
        last[r["data_id"]] = (r["seq"], json.loads(r["pieces"]), r["length"])
    assert last[1] == (3, [[2, 1, 1], [1, 1, 2]], 3)
    assert last[2] == (2, [[1, 0, 2], [2, 0, 5]], 7)


def test_live_content_and_changes(spark, tmp_path):
    base = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"xyz"))], "data_id long, content binary")
    schema = "data_id long, seq long, op string, offset long, length long, payload binary"
    got = {}
    run = live.live_content(base, str(tmp_path / "log"), lambda df, epoch: got.update({r["data_id"]: bytes(r["content"]) for r in df.collect()}))
    run(spark.createDataFrame([(1, 1, "ins", 1, 0, bytearray(b"--"))], schema), 0)
    run(spark.createDataFrame([(1, 2, "del", 0, 1, None), (2, 1, "ovr", 0, 0, bytearray(b"Q"))], schema), 1)
    run(spark.createDataFrame([(1, 2, "del", 0, 1, None), (2, 1, "ovr", 0, 0, bytearray(b"Q"))], schema), 1)
    assert got == {1: b"--bc", 2: b"Qyz"}
    rows = [(1, "2024-01-01 00:00:00", 5, 9), (1, "2024-01-01 00:00:02", 3, 6), (1, "2024-01-01 00:01:00", 7, 7)]
    spark.createDataFrame(rows, "user_id long, ts string, first long, last long").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("user_id long, ts timestamp, first long, last long").parquet(str(tmp_path / "ev"))
    q = live.live_changes(stream).writeStream.format("memory").queryName("changes_now").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["first"], r["last"], r["changes"]) for r in spark.sql("SELECT * FROM changes_now").collect()) == [(3, 9, 2), (7, 7, 1)]


def test_long_chains_and_layered_closures(spark):
    from octavo.operators import graph

    chain = [(f"n{k}", f"n{k + 1}", "ref") for k in range(300)] + [("x", "y", "ref"), ("y", "x", "ref"), ("z", "x", "ref")]
    got = {r["node"]: (r["final"], r["hops"]) for r in graph.dereferenced(spark.createDataFrame(chain, "src string, dst string, role string")).collect()}
    assert got["n0"] == ("n300", 300) and got["n299"] == ("n300", 1) and got["x"] == got["z"] == (None, None)
    # 2 ** 20 paths through 20 layers, and a circle back
    layers = [(f"{k}{a}", f"{k + 1}{b}", "ref") for k in range(20) for a in "ab" for b in "ab"] + [("20a", "0a", "ref")]
    edges = spark.createDataFrame(layers, "src string, dst string, role string")
    up = graph.closure(edges, spark.createDataFrame([("0a",)], "node string"), up=False)
    assert {(r["node"], r["depth"]) for r in up.collect()} == {(f"{k}{a}", k) for k in range(1, 21) for a in "ab"}
