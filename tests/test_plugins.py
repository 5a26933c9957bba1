"""The chunk source and the function registry."""

from octavo.functions import registry
from octavo.sources import chunks


def test_chunk_source(spark, tmp_path):
    content = bytes(range(256)) * 40
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.bin").write_bytes(content)
    (tmp_path / "in" / "sub" / "b.bin").write_bytes(b"xyz")
    (tmp_path / "in" / "empty").write_bytes(b"")
    chunks.register(spark)
    df = spark.read.format("octavo_chunks").option("chunk", 1000).option("split", 3500).load(str(tmp_path / "in"))
    rows = sorted(df.collect(), key=lambda r: (r["data_id"], r["chunk_no"]))
    assert b"".join(bytes(r["bytes"]) for r in rows if r["data_id"].endswith("a.bin")) == content
    assert [(r["chunk_no"], r["chunk_start"]) for r in rows if r["data_id"].endswith("a.bin")] == [(k, 1000 * k) for k in range(11)]
    assert [bytes(r["bytes"]) for r in rows if r["data_id"].endswith("b.bin")] == [b"xyz"]


def test_registry(spark):
    twice = registry.Signature("twice", (("a", "BIGINT"),), "BIGINT", "a * 2")
    assert "twice" in registry.register(spark, twice)
    got = spark.sql("""SELECT hex_text(byte_slice(X'00010203', 1, 2)), hex_text(byte_insert(X'0001', 1, X'FF')), hex_text(byte_delete(X'000102', 0, 2)),
      hex_text(byte_overwrite(X'000102', 1, X'AA')), bit_at(X'0180', 15), bit_at(X'0180', 1), uint_be(X'FFFFFFFFFFFFFFFF'), safe_div(7, 0), safe_div(-7, 2), twice(4)""").first()
    assert [*got[:6], int(got[6]), *got[7:]] == ["0102", "00ff01", "02", "00aa02", True, False, 2**64 - 1, 0, -3, 8]
    assert "byte_slice" in registry.usable_on("BINARY") and registry.usable_on("BIGINT") == ["safe_div"]
