"""Hand vectors and round trips of views, integers and formats."""

import random

import pytest
from pyspark.sql import functions as F

from octavo.functions import arithmetic, codec, formats, views

X = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    global X  # noqa: PLW0603  a column needs a session
    X = F.col("x")


def one(spark, content, *columns):
    return spark.createDataFrame([(bytearray(content),)], "x binary").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def from_bits(u, bits, sign):
    if sign == codec.UNSIGNED or not u >> bits - 1:
        return u
    return {codec.ONES: u - (1 << bits) + 1, codec.TWOS: u - (1 << bits), codec.MAGNITUDE: (1 << bits - 1) - u}[sign]


@pytest.mark.parametrize(
    "hexes,sign,order,expected",
    [
        ("FF80", codec.TWOS, codec.BIG, -128),
        ("FF7F", codec.TWOS, codec.BIG, -129),
        ("FF00", codec.TWOS, codec.BIG, -256),
        ("FFFF", codec.TWOS, codec.BIG, -1),
        ("00FF", codec.TWOS, codec.BIG, 255),
        ("FF", codec.ONES, codec.BIG, 0),
        ("FE", codec.ONES, codec.BIG, -1),
        ("80", codec.ONES, codec.BIG, -127),
        ("7F", codec.ONES, codec.BIG, 127),
        ("80", codec.MAGNITUDE, codec.BIG, 0),
        ("81", codec.MAGNITUDE, codec.BIG, -1),
        ("FF", codec.MAGNITUDE, codec.BIG, -127),
        ("FFFFFFFFFFFFFFFF", codec.UNSIGNED, codec.BIG, 18446744073709551615),
        ("", codec.UNSIGNED, codec.BIG, 0),
        ("0100", codec.UNSIGNED, codec.LITTLE, 1),
    ],
)
def test_decode_vectors(spark, hexes, sign, order, expected):
    x = bytes.fromhex(hexes)
    assert int(one(spark, x, codec.decode_int(X, len(x), sign, order))[0]) == expected


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 8, 9, 15, 16, 24])
def test_decode_against_python(spark, width):
    r = random.Random(width)
    rows = [r.randbytes(width) for _ in range(40)] + [b"\x00" * width, b"\xff" * width, b"\x80" + b"\x00" * (width - 1), b"\x7f" + b"\xff" * (width - 1)]
    cols = [(s, o) for s in range(4) for o in range(2)]
    df = spark.createDataFrame([(bytearray(x),) for x in rows], "x binary")
    got = df.select("x", *[codec.decode_int(X, width, s, o).cast("string").alias(f"c{s}{o}") for s, o in cols]).collect()
    for row in got:
        for s, o in cols:
            u = int.from_bytes(row["x"], "big" if o == codec.BIG else "little")
            assert int(row[f"c{s}{o}"]) == from_bits(u, 8 * width, s)


@pytest.mark.parametrize("width", [1, 2, 4, 8, 16])
def test_encode_is_the_inverse(spark, width):
    r, half = random.Random(width), 1 << 8 * width - 1
    values = [0, 1, -1, half - 1, 1 - half] + [r.randrange(1 - half, half) for _ in range(30)]
    df = spark.createDataFrame([(str(v),) for v in values], "v string")
    v = F.col("v") if width > 8 else F.col("v").cast("decimal(38,0)")
    for sign in (codec.ONES, codec.TWOS, codec.MAGNITUDE):
        for order in (codec.BIG, codec.LITTLE):
            x = codec.encode_int(v, width, sign, order)
            got = df.select("v", F.octet_length(x), codec.decode_int(x, width, sign, order).cast("string")).collect()
            assert all(int(a) == int(c) and b == width for a, b, c in got)


def test_encode_too_big(spark):
    df = spark.createDataFrame([(256,), (-1,), (255,)], "v long")
    got = df.select(codec.encode_int(F.col("v"), 1, codec.UNSIGNED, checked=False)).collect()
    assert [r[0] for r in got] == [None, None, bytearray(b"\xff")]
    with pytest.raises(Exception, match="too big"):
        df.select(codec.encode_int(F.col("v"), 1, codec.UNSIGNED)).collect()


def test_least_width(spark):
    values = {0: 1, 127: 1, 128: 2, -128: 1, -129: 2, 32767: 2, 32768: 3, 2**63 - 1: 8, -(2**63): 8}
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert {r[0]: r[1] for r in df.select("v", codec.least_width(F.col("v"))).collect()} == values


def test_bits_against_python(spark):
    x = random.Random(3).randbytes(13)
    number, total = int.from_bytes(x, "big"), 8 * 13
    spots = [(p, k) for k in (1, 3, 4, 8, 11, 16, 31, 32) for p in range(0, total, 5)]
    got = one(spark, x, *[views.read_bits(X, p, k) for p, k in spots])
    for (p, k), v in zip(spots, got):
        assert v == ((number >> total - p - k) & ((1 << k) - 1) if p + k <= total else None)
    assert one(spark, b"\x12\xf4", views.read_bits(X, 0, 16), views.nibble(X, 2), views.read_bit_array(X, 4, 3, 1))[:] == (0x12F4, 15, [2, 15, 4])
    assert one(spark, b"\x01", views.get_bit(X, 0), views.get_bit(X, 7))[:] == (True, False)


def test_bit_units_are_taken_apart_in_slices():
    import tracemalloc

    import pyarrow as pa

    r = random.Random(9)
    xs = [r.randbytes(r.choice((0, 1, 40, 3000))) for _ in range(2000)] + [None, r.randbytes(5000)]
    units = [None if k % 97 == 5 else 8 * len(x or b"") // 11 + k % 3 - 1 for k, x in enumerate(xs)]
    batch = (pa.array(xs, pa.binary()), pa.array(units, pa.int64()), *(pa.array([v] * len(xs), pa.int64()) for v in (-1, 14)))
    got, peak = [], 0
    for part in views.in_slices([batch], 4000):
        assert len(part[0]) == 1 or len(views.flat_bytes(part[0])[0]) <= 4000
        tracemalloc.start()
        made = views._bit_units(*part, 11)
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        got += made.to_pylist()
    # all units of the batch are over 8 MB
    assert peak < 200_000
    for x, n, v in zip(xs, units, got, strict=True):
        if x is None or n is None:
            assert v is None
            continue
        number, total = int.from_bytes(x, "big"), 8 * len(x)
        assert v == [(number >> total - p - 11) & 2047 if p + 11 <= total else None for p in range(3, 3 + 11 * max(n, 0), 11)]


def test_sums_of_bytes_without_a_function_per_byte(spark, tmp_path, capsys):
    from octavo.plans.queries import QUERIES

    r = random.Random(12)
    texts = ["a", "", "~\x7f \n", "é☺\0" * 700, None, *("".join(map(chr, r.choices(range(1, 2000), k=n))) for n in (1, 5, 3000))]
    xs = [None if t is None else t.encode() for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    every = {n: QUERIES[n](spark, str(tmp_path)) for n in ("grey_levels", "grey_nibbles", "nibble_stream")}
    got = {n: {row["doc_id"]: row[1:] for row in df.collect()} for n, df in every.items()}
    for k, x in enumerate(xs):
        levels = None if x is None else [255 - b for b in x]
        total = lambda f: None if levels is None else sum(map(f, levels))
        assert got["grey_levels"][k] == (total(int), total(lambda v: v // 3 * 2), total(lambda v: v // 2 + 128))
        assert got["grey_nibbles"][k] == (total(lambda v: v // 16 * 17), total(lambda v: v % 16 * 17))
        assert got["nibble_stream"][k][:2] == (total(lambda v: (255 - v) // 16 + (255 - v) % 16), x if x is None else 2 * len(x))
    # the functions of columns and of numbers say the same
    both = spark.range(256).select("id", formats.tint(formats.grey(F.col("id"))).alias("t"), formats.grey_pair(F.col("id").cast("int")).alias("p")).collect()
    assert all(tuple(b["t"]) == formats.tint_of(formats.grey(b["id"])) and tuple(b["p"]) == formats.grey_pair_of(b["id"]) for b in both)
    for df in every.values():
        df.explain()
    assert "lambda" not in capsys.readouterr().out


def test_byte_values_are_not_made_from_strings(spark, capsys):
    xs = [b"", b"\0\xff", bytes(range(256)) * 9, None, b"a"]
    df = spark.createDataFrame([(k, x if x is None else bytearray(x)) for k, x in enumerate(xs)], "k long, x binary")
    got = df.select("k", formats.byte_values(X).alias("v"), formats.code_page_text(X).alias("t"))
    page = " " + formats.code_page_437()[1:]
    assert [(r["v"], r["t"]) for r in got.orderBy("k").collect()] == [(None, None) if x is None else (list(x), "".join(page[b] for b in x)) for x in xs]
    got.explain()
    assert "split(" not in (plan := capsys.readouterr().out) and "lambda" not in plan


def test_set_bit(spark):
    got = one(spark, b"\x00\xff", views.set_bit(X, 9, False), views.set_bit(X, 3, True), views.set_bit(X, 99, True))
    assert [bytes(v) for v in got] == [b"\x00\xfd", b"\x08\xff", b"\x00\xff"]


def test_views(spark):
    x = bytes(range(20))
    got = one(spark, x, views.byte_slice(X, 5, 4), views.byte_slice(X, 105, 4, 100), views.byte_slice(X, -2, 4), views.read_range(X, 18, 4), views.read_range(X, 16, 4), views.tail(X, 17), views.slid(X, 2, 3, 5))
    assert [v if v is None else bytes(v) for v in got] == [x[5:9], x[5:9], x[:2], None, x[16:], x[17:], x[7:10]]
    with pytest.raises(Exception, match="outside"):
        one(spark, x, views.checked_slice(X, 18, 4))
    segs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((1, 2), (5, 5), (19, 30))])
    assert bytes(one(spark, x, views.gather(X, segs))[0]) == bytes([1, 2, 5, 19])
    assert one(spark, b"ab", views.describe(F.lit(3), views.byte_length(X), F.lit("f")))[0] == "[3-4] source: f"


def test_empty_content(spark):
    got = one(spark, b"", codec.reverse_bytes(X), formats.byte_values(X), codec.list_items(X), codec.list_count(X), formats.samples(X), views.read_bits(X, 0, 4), views.gather(X, F.array().cast("array<struct<first:int,last:int>>")))
    assert [bytes(got[0]), *got[1:6], bytes(got[6])] == [b"", [], [], 0, [], None, b""]


def test_lists(spark):
    x = bytes([0, 0, 0, 1, 0, 0, 1, 0, 9])
    got = one(spark, x, codec.list_items(X), codec.list_count(X), codec.list_set(X, 1, F.lit(7)), codec.list_set(X, 2, F.lit(7)), codec.magic_matches(X, b"\0\0\0\1"))
    assert got[0] == [1, 256] and got[1] == 2 and bytes(got[2]) == x[:4] + bytes([0, 0, 0, 7, 9]) and bytes(got[3]) == x and got[4] is True


def test_lists_without_a_function_per_item(spark, capsys):
    r = random.Random(21)
    xs = [r.randbytes(n) for n in (0, 1, 7, 8, 40, 333)] + [bytes(48), b"\xff" * 48, b"\x80" + bytes(47), bytes(7) + b"\x80", None]
    df = spark.createDataFrame([(k, x if x is None else bytearray(x)) for k, x in enumerate(xs)], "k long, x binary").repartition(2)
    kinds = [(w, s, o) for w in (1, 2, 3, 4, 7, 8) for s in (codec.UNSIGNED, codec.ONES, codec.TWOS, codec.MAGNITUDE) for o in (codec.BIG, codec.LITTLE) if (w, s) != (8, codec.UNSIGNED)]
    for (w, s, o), c in {k: codec.list_items(X, *k) for k in kinds}.items():
        for k, got in df.select("k", c).collect():
            x = xs[k] or b""
            assert got == [from_bits(int.from_bytes(x[i : i + w], "big" if o == codec.BIG else "little"), 8 * w, s) for i in range(0, len(x) // w * w, w)]
    df.select(codec.list_items(X)).explain()
    assert "lambda" not in capsys.readouterr().out
    eight = one(spark, b"\xff" * 9, codec.list_items(X, 8))[0]
    assert [int(v) for v in eight] == [2**64 - 1]


def test_every_byte_value(spark):
    got = one(spark, bytes(range(256)), formats.byte_values(X), *[F.transform(formats.byte_values(X), _each(f)) for f in (_hex, _bin, _oct, formats.grey, formats.signed, _page, _escape, _print)])
    values, hexes, bins, octs, greys, signs, page, escapes, prints = got
    assert values == list(range(256))
    assert hexes == [f"{b:02x}" for b in values] and bins == [f"{b:08b}" for b in values] and octs == [f"{b:03o}" for b in values]
    assert greys == [~b & 255 for b in values] and signs == [b - 256 if b > 127 else b for b in values]
    assert "".join(page) == formats.code_page_437() and page[1] == "☺" and page[127] == "⌂" and page[255] == "\xa0"
    assert escapes[10] == "\\n" and escapes[0] == "\\0" and escapes[65] == "41"
    assert prints[65] == " A" and prints[31] == "1f" and prints[126] == " ~" and prints[127] == "7f"


def _each(f):
    return lambda b: f(b)


def _hex(b):
    return formats.radix(b, 16)


def _bin(b):
    return formats.radix(b, 2)


def _oct(b):
    return formats.radix(b, 8)


def _page(b):
    return formats.code_page_char(b)


def _escape(b):
    return formats.escaped(b)


def _print(b):
    return formats.printable(b)


def test_addresses(spark):
    n = F.lit(0x12345678 * 8 + 3).cast("long")
    got = spark.range(1).select(formats.address_with_colon(n), formats.cursor(n), formats.address(F.lit(255)), formats.address(F.lit(10**11), 10), formats.cursor(F.lit(16))).first()
    assert got[:] == ("1234:5678.3", "12345678.3", "        ff", "100000000000", "2")


def test_colours(spark):
    got = spark.range(1).select(formats.tint(F.lit(100)), formats.grey_pair(F.lit(0xA5)), formats.bar(F.lit(-5)), formats.bar(F.lit(7)), formats.channel(F.lit(2), F.lit(5), 3)).first()
    assert [tuple(v) if hasattr(v, "asDict") else v for v in got] == [(66, 66, 178), (0x55, 0xAA), (123, 5), (128, 7), 1]


def test_arithmetic(spark):
    df = spark.createDataFrame([(7, 0), (-7, 2), (7, 2), (2**62, 4)], "a long, b long")
    got = df.select(arithmetic.divide(F.col("a"), F.col("b")), arithmetic.multiply(F.col("a"), F.col("b"))).collect()
    assert [(r[0], int(r[1])) for r in got] == [(0, 0), (-3, -14), (3, 14), (2**60, 2**64)]
    assert [arithmetic.bits_for(n) for n in (0, 1, 2, 3, 16, 17, 256)] == [0, 0, 1, 2, 4, 5, 8]
    x = F.col("x")
    halves = spark.createDataFrame([(2.5,), (-2.5,)], "x double").select(*[arithmetic.rounded(x, m) for m in ("before", "after", "nearest")]).collect()
    assert [r[:] for r in halves] == [(2, 3, 3), (-3, -2, -2)]
    steps = spark.range(12).select(arithmetic.size_at(arithmetic.step_size(F.col("id"), 1))).collect()
    assert [r[0] for r in steps][-2:] == [256, 256]
    assert arithmetic.pi_fraction(240).hex().startswith("243f6a8885a308d313198a2e03707344")


def test_texts_and_numbers(spark):
    df = spark.createDataFrame([("12",), ("-0x10",), ("017",), ("200",), ("x",), ("#7F",)], "t string")
    assert [r[0] for r in df.select(codec.byte_text(F.col("t"))).collect()] == [12, -16, 15, None, None, 127]
    assert [r[0] and int(r[0]) for r in df.select(codec.parse_int(F.col("t"))).collect()] == [12, None, 17, 200, None, None]
    got = one(spark, b"ok \xff \xc3\xa9", codec.decode_text(X))
    assert got[0] == "ok � é"
    assert one(spark, b"", codec.region(F.lit(5), F.lit(3)), codec.region(F.lit(5), F.lit(0)))[:] == ((5, 7), None)
