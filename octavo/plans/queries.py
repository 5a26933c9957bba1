"""Queries over the reference operators, each over whole tables, with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arithmetic, codec, formats, views
from ..operators import edits, graph, grid, intervals, templates
from ..sources import binary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of session and folder, and its SQL."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``x``, the text's bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", views.utf8(F.col("text")).alias("x"))


X = F.col
#: DuckDB: the documents' bytes as a blob, as hex, and as a list of numbers.
_DOCS = "SELECT doc_id, encode(text) x FROM documents"
_HEX = "SELECT doc_id, lower(hex(encode(text))) h FROM documents"
_BYTES = "SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT) b FROM documents"


# --- views ---


@query(f"""
SELECT doc_id, CAST(r * 16 AS BIGINT) addr, printf('%08x', r * 16) addr_hex, substr(h, r * 32 + 1, 32) hex_bytes
FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 31) // 32)) r FROM ({_HEX}))""")
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.hex_dump(documents(spark, sf_dir), "x", 16, "doc_id")


@query("""
SELECT 'documents' source, doc_id id, octet_length(encode(text))::BIGINT bytes, 8 * octet_length(encode(text))::BIGINT bits FROM documents
UNION ALL SELECT 'pages', page_id, octet_length(encode(html))::BIGINT, 8 * octet_length(encode(html))::BIGINT FROM pages""")
def byte_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, text: str) -> DataFrame:
        x = views.utf8(X(text))
        return table(spark, sf_dir, name).select(F.lit(name).alias("source"), X(key).alias("id"), views.byte_length(x).alias("bytes"), views.bit_length(x).alias("bits"))

    return of("documents", "doc_id", "text").unionByName(of("pages", "page_id", "html"))


@query(f"SELECT doc_id, lower(hex(x[11:42])) bytes FROM ({_DOCS})")
def slice_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", formats.hex_text(views.byte_slice(X("x"), 10, 32)).alias("bytes"))


@query(f"SELECT doc_id, lower(hex(x[16:25])) bytes FROM ({_DOCS})")
def slice_of_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = documents(spark, sf_dir).select("doc_id", views.byte_slice(X("x"), 10, 32).alias("y"))
    return outer.select("doc_id", formats.hex_text(views.byte_slice(X("y"), 15, 10, 10)).alias("bytes"))


@query(f"SELECT doc_id, (doc_id + 100)::BIGINT start, lower(hex(x[8:23])) at_shifted, lower(hex(x[13:28])) slid FROM ({_DOCS})")
def shifted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = views.shifted(views.shifted(X("doc_id"), 60), 40)
    d = documents(spark, sf_dir).withColumn("start", start)
    at = views.byte_slice(X("x"), X("start") + 7, 16, X("start"))
    return d.select("doc_id", "start", formats.hex_text(at).alias("at_shifted"), formats.hex_text(views.slid(X("x"), 7, 16, 5)).alias("slid"))


_SEGMENTS = [(0, 3), (8, 11), (20, 20)]


def _segments(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for a, b in pairs])


@query(f"SELECT doc_id, lower(hex(x[1:4])) || lower(hex(x[9:12])) || lower(hex(x[21:21])) bytes FROM ({_DOCS})")
def gather_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", formats.hex_text(views.gather(X("x"), _segments(_SEGMENTS))).alias("bytes"))


@query(f"SELECT doc_id, CASE WHEN octet_length(x) >= 250 THEN lower(hex(x[201:250])) END bytes, lower(hex(x[octet_length(x) // 2 + 1:octet_length(x)])) rest FROM ({_DOCS})")
def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.call_function("div", views.byte_length(X("x")), F.lit(2).cast("long"))
    return documents(spark, sf_dir).select("doc_id", formats.hex_text(views.read_range(X("x"), 200, 50)).alias("bytes"), formats.hex_text(views.tail(X("x"), half)).alias("rest"))


@query(f"SELECT b::INT byte, count(*) n FROM (SELECT unnest(b) b FROM ({_BYTES})) GROUP BY 1")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(formats.byte_values(X("x"))).alias("byte")).groupBy("byte").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, list_sum(list_transform(regexp_extract_all(h, '.'), lambda c: ('0x' || c)::INT))::BIGINT total, length(h)::BIGINT nibbles, ('0x' || substr(h, 4, 1))::BIGINT fourth FROM ({_HEX})")
def nibble_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = views.byte_sums(X("x"), lambda b: b // 16 + b % 16)[0]
    return documents(spark, sf_dir).select("doc_id", total.alias("total"), (views.byte_length(X("x")) * 2).alias("nibbles"), views.nibble(X("x"), 3).alias("fourth"))


@query(f"""
WITH u AS (SELECT doc_id, h || '000000' h, unnest(range(0, greatest((4 * length(h) - 3) // 11, 0))) i FROM ({_HEX})),
v AS (SELECT doc_id, i, (('0x' || substr(h, ((3 + 11 * i) // 8) * 2 + 1, 6))::BIGINT >> (13 - (3 + 11 * i) % 8)::INT) & 2047 v FROM u)
SELECT doc_id, count(*) units, sum(v)::BIGINT total, sum(v * (i % 7))::BIGINT weighted FROM v GROUP BY 1""")
def read_bits_3_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.greatest(F.call_function("div", views.bit_length(X("x")) - 3, F.lit(11).cast("long")), F.lit(0).cast("long"))
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(views.read_bit_array(X("x"), 11, units, 0, 3)).alias("i", "v"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum("v").alias("total"), F.sum(X("v") * (X("i") % 7)).alias("weighted"))


# --- formats ---


@query("SELECT p_partkey, " + ", ".join(f"lpad(lower(to_base(p_size % 256, {b})), {formats.digits_of(b)}, '0') base{b}" for b in (2, 8, 10, 16)) + " FROM part")
def format_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.pmod(X("p_size"), F.lit(256))
    return table(spark, sf_dir, "part").select("p_partkey", *[formats.radix(b, base).alias(f"base{base}") for base in (2, 8, 10, 16)])


_SHOWN = "SELECT doc_id, md5(array_to_string(list_transform(b, lambda v: {}), '')) shown, len(b)::BIGINT bytes FROM (" + _BYTES + ")"
_HEX_OF_V = "lpad(lower(to_base(v, 16)), 2, '0')"


def _shown(spark: SparkSession, sf_dir: str, each: Callable[[Column], Column]) -> DataFrame:
    text = F.array_join(F.transform(formats.byte_values(X("x")), each), "")
    return documents(spark, sf_dir).select("doc_id", F.md5(text).alias("shown"), views.byte_length(X("x")).alias("bytes"))


@query(_SHOWN.format(f"CASE WHEN v BETWEEN 32 AND 126 THEN ' ' || chr(v) ELSE {_HEX_OF_V} END"))
def format_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, lambda b: formats.printable(b))


@query(_SHOWN.format("CASE v " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in formats.ESCAPES.items()) + f" ELSE {_HEX_OF_V} END"))
def format_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir, lambda b: formats.escaped(b))


@query(f"SELECT doc_id, md5(array_to_string(list_transform(b, lambda v: chr(v & 127)), '')) masked, md5(array_to_string(list_transform(b, lambda v: chr(v)), '')) shown FROM ({_BYTES})")
def ascii_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(formats.latin_text(X("x"), True)).alias("masked"), F.md5(formats.latin_text(X("x"))).alias("shown"))


_PAGE = formats.code_page_437().replace("\0", " ").replace("'", "''")


@query(_SHOWN.format(f"substr('{_PAGE}', v + 1, 1)"))
def cp437_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(formats.code_page_text(X("x"))).alias("shown"), views.byte_length(X("x")).alias("bytes"))


@query(f"""SELECT doc_id, list_sum(list_transform(b, lambda v: 255 - v))::BIGINT grey,
list_sum(list_transform(b, lambda v: (255 - v) // 3 * 2))::BIGINT red, list_sum(list_transform(b, lambda v: (255 - v) // 2 + 128))::BIGINT blue FROM ({_BYTES})""")
def grey_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = views.byte_sums(X("x"), formats.grey, lambda b: formats.tint_of(formats.grey(b))[0], lambda b: formats.tint_of(formats.grey(b))[2])
    return documents(spark, sf_dir).select("doc_id", sums.alias("s")).select("doc_id", *[X("s")[k].alias(name) for k, name in enumerate(("grey", "red", "blue"))])


@query(f"SELECT doc_id, list_sum(list_transform(b, lambda v: (15 - v // 16) * 17))::BIGINT outer_sum, list_sum(list_transform(b, lambda v: (15 - v % 16) * 17))::BIGINT inner_sum FROM ({_BYTES})")
def grey_nibbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = views.byte_sums(X("x"), lambda b: formats.grey_pair_of(b)[0], lambda b: formats.grey_pair_of(b)[1])
    return documents(spark, sf_dir).select("doc_id", sums.alias("s")).select("doc_id", X("s")[0].alias("outer_sum"), X("s")[1].alias("inner_sum"))


@query(f"""WITH s AS (SELECT doc_id, unnest(b) v, generate_subscripts(b, 1) i FROM ({_BYTES})),
w AS (SELECT doc_id, i // 2 - 1 sample_no, CASE WHEN v > 127 THEN v - 256 ELSE v END s FROM s WHERE i % 2 = 0)
SELECT doc_id, count(*) samples, sum(s)::BIGINT total, sum(abs(s))::BIGINT bars, min(CASE WHEN s > 0 THEN 128 ELSE 128 + s END)::INT lowest FROM w GROUP BY 1""")
def wave_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.explode(formats.samples(X("x"), 16)).alias("s")).withColumn("bar", formats.bar(X("s")))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("s").alias("total"), F.sum("bar.length").alias("bars"), F.min("bar.at").alias("lowest"))


@query(f"""SELECT doc_id, (((i - 1) // 16 + (i - 1) % 16) % 3)::INT channel, count(*) n, sum(v)::BIGINT total
FROM (SELECT doc_id, unnest(b) v, generate_subscripts(b, 1) i FROM ({_BYTES})) GROUP BY ALL""")
def rgb_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(formats.byte_values(X("x"))).alias("pos", "v"))
    line = F.call_function("div", X("pos").cast("long"), F.lit(16).cast("long"))
    channel = formats.channel(line, X("pos") % 16, 3)
    return d.groupBy("doc_id", channel.alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("""SELECT l_orderkey, l_linenumber, substr(a, 1, 4) || ':' || substr(a, 5) || CASE WHEN n % 8 <> 0 THEN '.' || (n % 8) ELSE '' END colon,
lower(to_base(n // 8, 16)) || CASE WHEN n % 8 <> 0 THEN '.' || (n % 8) ELSE '' END cursor_text,
CASE WHEN length(d) >= 10 THEN d ELSE lpad(d, 10, ' ') END decimal_address
FROM (SELECT l_orderkey, l_linenumber, n, printf('%08x', n // 8) a, n::VARCHAR d FROM (SELECT *, l_orderkey * 97 + l_linenumber n FROM lineitem))""")
def address_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X("l_orderkey") * 97 + X("l_linenumber")
    cols = {"colon": formats.address_with_colon(n), "cursor_text": formats.cursor(n), "decimal_address": formats.address(n, 10)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in cols.items()])


# --- integers ---

_SIGNS = {"unsigned": codec.UNSIGNED, "ones": codec.ONES, "twos": codec.TWOS, "magnitude": codec.MAGNITUDE}
_ORDERS = {"big": codec.BIG, "little": codec.LITTLE}
_WIDTHS = (1, 2, 4, 8)


def _sample(sign: str, width: int) -> str:
    """A number of the width, in SQL that both engines read."""
    half = 1 << 8 * width - 1
    if sign == "unsigned":
        return f"(l_orderkey * 1000003 % {min(2 * half, 1 << 62)})"
    wide = "((l_partkey - l_suppkey) * 1000003 * (l_linenumber * 2 - 7))"
    return f"({wide} % {half})" if width < 8 else f"({wide} * 65537)"


def _encode_sql(sign: str, order: str, width: int) -> str:
    full, half = 1 << 8 * width, 1 << 8 * width - 1
    v = f"{_sample(sign, width)}::HUGEINT"
    under = {"unsigned": v, "ones": f"{v} + {full - 1}", "twos": f"{v} + {full}", "magnitude": f"{half} - {v}"}[sign]
    h = f"lpad(lower(hex((CASE WHEN {v} < 0 THEN {under} ELSE {v} END)::UBIGINT)), {2 * width}, '0')"
    return h if order == "big" else f"array_to_string(list_reverse(regexp_extract_all({h}, '..')), '')"


def _decode_sql(sign: str, order: str, width: int) -> str:
    full, half = 1 << 8 * width, 1 << 8 * width - 1
    h = f"substr(md5(l_orderkey || '-' || l_linenumber), 1, {2 * width})"
    h = h if order == "big" else f"array_to_string(list_reverse(regexp_extract_all({h}, '..')), '')"
    u = f"('0x' || {h})::UBIGINT::HUGEINT"
    under = {"unsigned": u, "ones": f"{u} - {full - 1}", "twos": f"{u} - {full}", "magnitude": f"{half} - {u}"}[sign]
    kind = "DECIMAL(20,0)::VARCHAR" if sign == "unsigned" and width == 8 else "BIGINT"
    return f"(CASE WHEN {u} >= {half} THEN {under} ELSE {u} END)::{kind}"


def _register_integers(sign: str, order: str) -> None:
    def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = [formats.hex_text(codec.encode_int(F.expr(_sample(sign, w)), w, _SIGNS[sign], _ORDERS[order])).alias(f"w{w}") for w in _WIDTHS]
        return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)

    def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = F.unhex(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")))
        number = lambda w: codec.decode_int(views.read_range(X("x"), 0, w), w, _SIGNS[sign], _ORDERS[order])
        cols = [(number(w).cast("string") if sign == "unsigned" and w == 8 else number(w)).alias(f"w{w}") for w in _WIDTHS]
        return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", *cols)

    def sql(of: Callable[[str, str, int], str]) -> str:
        return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{of(sign, order, w)} w{w}" for w in _WIDTHS) + " FROM lineitem"

    query(sql(_encode_sql), f"encode_int_{sign}_{order}")(encode)
    query(sql(_decode_sql), f"decode_int_{sign}_{order}")(decode)


for _s in _SIGNS:
    for _o in _ORDERS:
        _register_integers(_s, _o)


@query("""SELECT l_orderkey, l_linenumber, ((hi - CASE WHEN hi >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END) * 18446744073709551616 + lo)::VARCHAR AS value, m again, upper(m) was
FROM (SELECT *, ('0x' || substr(r, 1, 16))::UBIGINT::HUGEINT hi, ('0x' || substr(r, 17, 16))::UBIGINT::HUGEINT lo FROM (
SELECT l_orderkey, l_linenumber, m, array_to_string(list_reverse(regexp_extract_all(m, '..')), '') r FROM (SELECT l_orderkey, l_linenumber, md5(l_orderkey || '-' || l_linenumber) m FROM lineitem)))""")
def wide_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-byte integers there and back."""
    x = F.unhex(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    d = d.withColumn("value", codec.decode_int(X("x"), 16, codec.TWOS, codec.LITTLE))
    return d.select("l_orderkey", "l_linenumber", "value", formats.hex_text(codec.encode_int(X("value"), 16, codec.TWOS, codec.LITTLE)).alias("again"), F.hex("x").alias("was"))


@query("SELECT event_id, " + ", ".join(f"((event_id >> {k}) & 1) = 1 bit{k}" for k in range(16)) + " FROM events")
def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = codec.encode_int(F.pmod("event_id", F.lit(65536)), 2, codec.UNSIGNED, codec.LITTLE)
    return table(spark, sf_dir, "events").select("event_id", *[views.get_bit(x, k).alias(f"bit{k}") for k in range(16)])


@query("""SELECT event_id, printf('%04x', (CASE WHEN event_id % 2 = 0 THEN v | (1 << k) ELSE v & ~(1 << k) END)) x
FROM (SELECT event_id, (event_id % 65536)::INT v, (event_id % 16)::INT k FROM events)""")
def set_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = codec.encode_int(F.pmod("event_id", F.lit(65536)), 2, codec.UNSIGNED, codec.LITTLE)
    got = views.set_bit(x, F.pmod("event_id", F.lit(16)), X("event_id") % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", formats.hex_text(codec.reverse_bytes(got, 2)).alias("x"))


@query("SELECT o_orderkey, printf('%08x', o_orderkey & 4294967295) packed, o_orderkey::BIGINT unpacked FROM orders")
def int32_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = codec.int32_pack(X("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.hex_text(p).alias("packed"), codec.int32_unpack(p).alias("unpacked"))


@query(f"""SELECT doc_id, (length(h) // 8)::BIGINT items, coalesce(list_sum(l), 0)::BIGINT total, l[1]::BIGINT first_item
FROM (SELECT doc_id, h, list_transform(regexp_extract_all(h, '.{{8}}'), lambda v: ('0x' || v)::BIGINT) l FROM ({_HEX}))""")
def list_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", codec.list_count(X("x"), 4).alias("items"), codec.list_items(X("x"), 4).alias("l"))
    return d.select("doc_id", "items", F.aggregate("l", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.try_element_at("l", F.lit(1)).alias("first_item"))


@query("SELECT page_id, starts_with(html, '<!DOCTYPE html>') is_page, substr(html, 16, 5) = '<html' has_root FROM pages")
def magic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.utf8(X("html"))
    return table(spark, sf_dir, "pages").select("page_id", codec.magic_matches(x, b"<!DOCTYPE html>").alias("is_page"), codec.magic_matches(x, b"<html", 15).alias("has_root"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey::HUGEINT * l_suppkey * 1)::BIGINT product FROM lineitem")
def int_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arithmetic.multiply(X("l_partkey"), X("l_suppkey")).cast("long").alias("product"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN d = 0 THEN 0 ELSE (n // d) END::BIGINT quotient
FROM (SELECT l_orderkey, l_linenumber, l_partkey - 1000 n, l_suppkey % 7 - 3 d FROM lineitem)""")
def int_div_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arithmetic.divide(X("l_partkey") - 1000, X("l_suppkey") % 7 - 3).alias("quotient"))


@query("""SELECT event_id, n // 8 byte_no, (n % 8)::INT bit_no, greatest(n - 4000, 0) below, floor(value)::BIGINT before, ceil(value)::BIGINT after,
floor(value + 0.5)::BIGINT nearest, [6, 7, 8, 11, 12, 14, 18, 24, 48, 64, 127, 256][least(event_id % 12 + 1, 11)::INT + 1]::INT bigger
FROM (SELECT event_id, value, event_id * 3 n FROM events)""")
def cursor_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X("event_id") * 3
    cols = {"byte_no": arithmetic.byte_of(n), "bit_no": arithmetic.bit_of(n), "below": arithmetic.cursor_subtract(n, F.lit(4000).cast("long"))}
    cols |= {m: arithmetic.rounded(X("value"), m) for m in ("before", "after", "nearest")}
    cols["bigger"] = arithmetic.size_at(arithmetic.step_size(X("event_id") % 12, 1))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in cols.items()])


# --- intervals ---

_IV = "SELECT user_id, event_id seq, (event_id * 37) % 500 AS first, (event_id * 37) % 500 + event_id % 9 AS last, event_id % 2 AS parity, ts FROM events"


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (X("event_id") * 37) % 500
    return table(spark, sf_dir, "events").select("user_id", X("event_id").alias("seq"), first.alias("first"), (first + X("event_id") % 9).alias("last"), (X("event_id") % 2).alias("parity"), "ts")


def _union_sql(source: str, touch: str = "+ 1") -> str:
    return f"""(WITH p AS (SELECT *, max(last) OVER (PARTITION BY user_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM ({source})),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR first > pm {touch} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) g FROM p)
SELECT user_id, min(first) AS first, max(last) AS last FROM g GROUP BY user_id, g)"""


_ADD, _REMOVE = _union_sql(f"SELECT * FROM ({_IV}) WHERE parity = 0"), _union_sql(f"SELECT * FROM ({_IV}) WHERE parity = 1")
#: The difference by positions: what DuckDB can say without the sweep.
_LEFT = f"""(SELECT user_id, unnest(range(first, last + 1)) p FROM {_ADD} EXCEPT SELECT user_id, unnest(range(first, last + 1)) p FROM {_REMOVE})"""


def _islands_sql(positions: str) -> str:
    return f"SELECT user_id, min(p) AS first, max(p) AS last FROM (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) g FROM {positions}) GROUP BY user_id, g"


@query(f"SELECT * FROM {_union_sql(_IV)}")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(_intervals(spark, sf_dir), ["user_id"])


_BITS = "SELECT user_id, (event_id * 37) % 500 * 8 + event_id % 8 AS first, (event_id * 37) % 500 * 8 + event_id % 8 + 1 + event_id % 13 AS last FROM events"


@query(f"SELECT user_id, first AS bit_from, last AS bit_to FROM {_union_sql(_BITS, '')}")
def bit_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (X("event_id") * 37) % 500 * 8 + X("event_id") % 8
    bits = table(spark, sf_dir, "events").select("user_id", first.alias("first"), (first + 1 + X("event_id") % 13).alias("last"))
    return intervals.union(bits, ["user_id"], half_open=True).select("user_id", X("first").alias("bit_from"), X("last").alias("bit_to"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    iv = _intervals(spark, sf_dir)
    return iv.where("parity = 0"), iv.where("parity = 1")


@query(_islands_sql(_LEFT))
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    add, remove = _sides(spark, sf_dir)
    return intervals.difference(add, remove, ["user_id"])


@query(_islands_sql(f"(SELECT user_id, unnest(range(first, last + 1)) p FROM {_ADD} INTERSECT SELECT user_id, unnest(range(first, last + 1)) p FROM {_REMOVE})"))
def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    add, remove = _sides(spark, sf_dir)
    return intervals.intersection(add, remove, ["user_id"])


@query(_islands_sql(f"(SELECT user_id, p FROM (SELECT user_id, p, row_number() OVER (PARTITION BY user_id ORDER BY p) k FROM (SELECT user_id, unnest(range(first, last + 1)) p FROM {_union_sql(_IV)})) WHERE k BETWEEN 6 AND 25)"))
def interval_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.slice_positions(interval_union(spark, sf_dir), ["user_id"], 5, 20)


@query(f"""SELECT user_id, min(first) lowest, max(last) highest, sum(last - first + 1)::BIGINT positions, count(*) segments,
CASE WHEN count(*) = 1 THEN sum(last - first + 1)::BIGINT || ' bytes' ELSE count(*) || ' segs' END summary FROM {_union_sql(_IV)} GROUP BY 1""")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = intervals.stats(interval_union(spark, sf_dir), ["user_id"])
    return got.withColumn("summary", intervals.summary(X("segments"), X("positions")))


@query(f"""SELECT e.event_id, e.user_id, (e.event_id * 53) % 520 pos FROM events e
WHERE EXISTS (SELECT 1 FROM {_union_sql(_IV)} i WHERE i.user_id = e.user_id AND (e.event_id * 53) % 520 BETWEEN i.first AND i.last)""")
def interval_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_id", "user_id", ((X("event_id") * 53) % 520).alias("pos"))
    return intervals.members(points, interval_union(spark, sf_dir), ["user_id"])


@query(f"SELECT user_id, unnest(range(first, last + 1)) pos FROM {_union_sql(_IV)}")
def interval_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.enumerate_positions(interval_union(spark, sf_dir), ["user_id"])


_TOGGLED = f"SELECT user_id, arg_max(first, seq) AS first, arg_max(last, seq) AS last FROM ({_IV}) WHERE parity = 1 GROUP BY 1"


@query(_islands_sql(f"""(WITH c AS ({_TOGGLED}), a AS (SELECT user_id, unnest(range(first, last + 1)) p FROM {_ADD}),
o AS (SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM a WHERE a.user_id = c.user_id AND a.p = c.last))
SELECT * FROM (SELECT user_id, p FROM a UNION SELECT user_id, unnest(range(first, last + 1)) p FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = c.user_id))
EXCEPT SELECT user_id, unnest(range(first, last + 1)) p FROM o)"""))
def interval_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    add, changes = _sides(spark, sf_dir)
    last = intervals.last_change(changes, ["user_id"]).withColumn("tail", X("last"))
    return intervals.toggle(intervals.union(add, ["user_id"]), last, ["user_id"])


@query(_islands_sql(f"(SELECT user_id, CASE WHEN p >= 250 THEN p + 12 ELSE p END p FROM (SELECT user_id, unnest(range(first, last + 1)) p FROM {_union_sql(_IV)}))"))
def interval_insert_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.insert_space(interval_union(spark, sf_dir), ["user_id"], F.lit(250).cast("long"), F.lit(12).cast("long"))


@query(_islands_sql(f"(SELECT user_id, CASE WHEN p >= 262 THEN p - 12 ELSE p END p FROM (SELECT user_id, unnest(range(first, last + 1)) p FROM {_union_sql(_IV)}) WHERE p NOT BETWEEN 250 AND 261)"))
def interval_remove_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.remove_space(interval_union(spark, sf_dir), ["user_id"], 250, 12)


@query("SELECT event_id, CASE WHEN c = 0 THEN -2 ELSE r * 16 + c - 1 END::BIGINT idx, n // 16 back_row, n % 16 + 1 back_col FROM (SELECT event_id, event_id // 17 r, event_id % 17 c, event_id n FROM events)")
def selection_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.call_function("div", X("event_id"), F.lit(17).cast("long"))
    back = intervals.index_cell(X("event_id"), 16)
    return table(spark, sf_dir, "events").select("event_id", intervals.cell_index(row, X("event_id") % 17, 16).alias("idx"), back["row"].alias("back_row"), back["col"].alias("back_col"))


@query(f"SELECT user_id, strftime(ts, '%Y-%m-%d %H') gesture, min(first) AS first, max(last) AS last, count(*) changes FROM ({_IV}) GROUP BY ALL")
def change_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesced_changes(_intervals(spark, sf_dir).withColumn("gesture", F.date_format("ts", "yyyy-MM-dd HH")), ["user_id", "gesture"])


# --- edits ---

_PAYLOAD = "encode(lang || doc_id)"


def _edited(spark: SparkSession, sf_dir: str, edit: Callable[[Column, Column], Column]) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", views.utf8(X("text")).alias("x"), views.utf8(F.concat(X("lang"), X("doc_id").cast("string"))).alias("p"))
    d = d.select("doc_id", edit(X("x"), X("p")).alias("y"))
    return d.select("doc_id", views.byte_length(X("y")).alias("bytes"), F.md5("y").alias("digest"))


def _edited_sql(h: str) -> str:
    """``h`` gives the edited hex of ``a`` (hex of the text, zeros added up to offset 3 where it is shorter), ``p`` (hex of the payload)."""
    return f"SELECT doc_id, (length(y) // 2)::BIGINT bytes, md5(unhex(y)) digest FROM (SELECT doc_id, {h} y FROM (SELECT doc_id, hex(encode(text)) a, hex({_PAYLOAD}) p FROM documents))"


@query(_edited_sql("substr(a, 1, 6) || p || substr(a, 7)"))
def edit_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, lambda x, p: edits.insert(x, 3, p))


@query(_edited_sql("substr(a, 1, 6) || substr(a, 7 + 2 * (doc_id % 50))"))
def edit_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", edits.delete(X("x"), 3, X("doc_id") % 50).alias("y"))
    return d.select("doc_id", views.byte_length(X("y")).alias("bytes"), F.md5("y").alias("digest"))


@query(_edited_sql("substr(a, 1, 6) || p || substr(a, 7 + length(p))"))
def edit_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, lambda x, p: edits.overwrite(x, 3, p))


@query(_edited_sql("p || substr(a, 9, 8) || substr(a, 25, 16) || substr(a, 43)"))
def edit_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, lambda x, p: edits.replace_segments(x, _segments(_SEGMENTS), p))


@query(_edited_sql("substr(a, 9, 8) || substr(a, 25, 16) || substr(a, 43)"))
def edit_delete_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, lambda x, p: edits.delete_segments(x, _segments(_SEGMENTS)))


_LOG = """SELECT event_id % (SELECT count(*) FROM documents) doc_id, event_id seq, CASE event_type WHEN 'click' THEN 'ins' WHEN 'view' THEN 'ovr' ELSE 'del' END op,
event_id * 31 % 40 o, event_id % 7 n, substr(hex(encode(props)), 1, 2 * (event_id % 7)::INT) p FROM events WHERE event_type IN ('click', 'view', 'error')"""


def mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of edits of the documents."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"))  # one row
    op = F.when(X("event_type") == "click", "ins").when(X("event_type") == "view", "ovr").when(X("event_type") == "error", "del")
    length = X("event_id") % 7
    e = table(spark, sf_dir, "events").withColumn("op", op).where("op is not null").crossJoin(F.broadcast(n))
    payload = views.byte_slice(views.utf8(X("props")), 0, length)
    return e.select((X("event_id") % X("docs")).alias("data_id"), X("event_id").alias("seq"), "op", ((X("event_id") * 31) % 40).alias("offset"), length.alias("length"), payload.alias("payload"))


def _fold_sql(where: str = "true") -> str:
    return f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) k FROM ({_LOG}) WHERE {where}),
s(doc_id, k, a) AS (SELECT doc_id, 0::BIGINT, hex(encode(text)) FROM documents
UNION ALL SELECT s.doc_id, m.k, CASE op WHEN 'del' THEN substr(a, 1, 2 * o) || substr(a, 2 * (o + n) + 1)
  WHEN 'ins' THEN rpad(substr(a, 1, 2 * o), (2 * o)::INT, '0') || p || substr(a, 2 * o + 1)
  ELSE rpad(substr(a, 1, 2 * o), (2 * o)::INT, '0') || p || substr(a, 2 * o + length(p) + 1) END
  FROM s JOIN m ON m.doc_id = s.doc_id AND m.k = s.k + 1)
SELECT doc_id, (length(y) // 2)::BIGINT bytes, md5(unhex(y)) digest FROM (SELECT doc_id, arg_max(a, k) y FROM s GROUP BY 1)"""


def _folded(d: DataFrame) -> DataFrame:
    return d.select("doc_id", views.byte_length(X("x")).alias("bytes"), F.md5("x").alias("digest"))


@query(_fold_sql())
def edit_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(edits.fold_log(documents(spark, sf_dir), mods(spark, sf_dir), "doc_id", "x"))


@query(_fold_sql("seq <= 5000"))
def as_of_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(edits.fold_log(documents(spark, sf_dir), edits.as_of(mods(spark, sf_dir), 5000), "doc_id", "x"))


@query(_fold_sql())
def edit_log_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold by way of the piece table."""
    d, log = documents(spark, sf_dir), mods(spark, sf_dir)
    pieces = edits.piece_table(d.withColumn("length", views.byte_length(X("x"))), log, "doc_id")
    merged = edits.materialise(d, log, pieces, "doc_id", "x").select(X("data_id").alias("doc_id"), X("x").alias("y"))
    edited = log.select(X("data_id").alias("doc_id"), F.lit(True).alias("edited")).distinct()
    empty = F.when(X("edited"), F.lit(b"").cast("binary")).otherwise(X("x"))
    whole = d.join(edited, "doc_id", "left").join(merged, "doc_id", "left").select("doc_id", F.coalesce("y", empty).alias("x"))
    return _folded(whole)


@query("""SELECT doc_id, (length(y) // 2)::BIGINT bytes, md5(unhex(y)) digest FROM (SELECT doc_id,
CASE WHEN doc_id % 4 = 3 THEN a ELSE substr(a, 1, 2 * o) || ['4a', 'ff', '0f'][doc_id % 4 + 1] || substr(a, 2 * o + 3) END y
FROM (SELECT doc_id, doc_id % 3 o, hex(encode(text)) a FROM documents))""")
def edit_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("0x4A", "-1", "017", "300"))), (X("doc_id") % 4 + 1).cast("int"))
    return _folded(documents(spark, sf_dir).select("doc_id", edits.command_edit(X("x"), X("doc_id") % 3, text).alias("x")))


# --- typed values, references, layouts ---


@query("""SELECT l_orderkey, l_linenumber, ((v + 2147483648) % 4294967296 - 2147483648)::BIGINT low32
FROM (SELECT l_orderkey, l_linenumber, l_partkey::HUGEINT * l_suppkey * l_orderkey v FROM lineitem)""")
def narrow_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = arithmetic.multiply(X("l_partkey") * X("l_suppkey"), X("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codec.narrow(v, 32).alias("low32"))


@query(f"SELECT doc_id, CASE WHEN length(h) // 8 > doc_id % 40 THEN ('0x' || nullif(substr(h, (doc_id % 40)::INT * 8 + 1, 8), ''))::BIGINT ELSE -1 END item FROM ({_HEX})")
def list_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.coalesce(codec.list_at(codec.list_items(X("x"), 4), X("doc_id") % 40), F.lit(-1).cast("long")).alias("item"))


@query("SELECT o_orderkey, 'o_custkey=' || o_custkey || '(->c' || o_custkey || ')' described, 8::INT bytes FROM orders")
def value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = formats.value_text(F.lit("o_custkey"), X("o_custkey").cast("string"), F.concat(F.lit("c"), X("o_custkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("described"), F.octet_length(codec.encode_int(X("o_custkey"), 8)).alias("bytes"))


@query(f"""SELECT doc_id, CASE WHEN octet_length(x) >= 2 THEN ('0x' || hex(x[2:2]) || hex(x[1:1]))::BIGINT END u16,
CASE WHEN octet_length(x) >= 3 THEN ('0x' || hex(x[3:3]))::BIGINT END u8, CASE WHEN octet_length(x) >= 4 THEN ('0x' || hex(x[4:4]))::INT & 1 = 1 END flag,
CASE WHEN octet_length(x) >= 12 THEN hex(x[5:12]) END str8 FROM ({_DOCS})""")
def template_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = [
        templates.Field("u16", "int", 0, 2, codec.UNSIGNED, codec.LITTLE),
        templates.Field("u8", "int", 2, 1),
        templates.Field("flag", "bit", 24),
        templates.Field("str8", "bytes", 4, 8),
    ]
    return templates.records(documents(spark, sf_dir), "x", layout, "doc_id").withColumn("str8", F.hex("str8"))


def _values_sql(labels: tuple[str, ...]) -> str:
    return ", ".join("({}, '{}')".format(k, x.replace("'", "''")) for k, x in enumerate(labels))


@query(f"""SELECT s.label sign_label, o.label order_label, count(*) n FROM lineitem
JOIN (VALUES {_values_sql(codec.SIGN_LABELS)}) s(idx, label) ON s.idx = l_linenumber % 5 JOIN (VALUES {_values_sql(codec.ORDER_LABELS)}) o(idx, label) ON o.idx = l_orderkey % 2 GROUP BY ALL""")
def choice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = templates.dimension(spark, codec.SIGN_LABELS).select(X("idx").alias("s"), X("label").alias("sign_label"))
    d = table(spark, sf_dir, "lineitem").select((X("l_linenumber") % 5).alias("s"), templates.choice_label((X("l_orderkey") % 2).cast("int"), codec.ORDER_LABELS).alias("order_label"))
    return d.join(F.broadcast(signs), "s").groupBy("sign_label", "order_label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT col, coalesce(sum(g) OVER (ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM (SELECT col, 3 + CASE WHEN (col + 1) % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN (col + 1) % 8 = 0 THEN 1 ELSE 0 END g FROM range(32) t(col))""")
def layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.column_offsets(spark, 32)


@query("""SELECT event_id, least(n // 24, 40) repeats, n - least(n // 24, 40) * 24 AS left_over, ((n // 10) % 999 // 20 * 16 + least((n % 200) // 12, 15)) * 8 hit_bit,
(event_id // 4 % 16 * 12)::BIGINT x, event_id // 64 * 20 y FROM (SELECT event_id, event_id * 7 n FROM events)""")
def grid_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X("event_id") * 7
    r = grid.repeats(n, 24, 40)
    tenth = F.call_function("div", n, F.lit(10).cast("long"))
    hit, at = grid.hit(n % 200, tenth % 999, 12, 20, 8), grid.place(X("event_id"), 12, 20, 4)
    cols = {"repeats": r["repeats"], "left_over": r["left"], "hit_bit": hit, "x": at["x"].cast("long"), "y": at["y"]}
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in cols.items()])


@query("""WITH o AS (SELECT col, coalesce(sum(g) OVER (ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT s
FROM (SELECT col, 3 + CASE WHEN (col + 1) % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN (col + 1) % 8 = 0 THEN 1 ELSE 0 END g FROM range(32) t(col)))
SELECT e.event_id, e.event_id % 120 x, o.col FROM events e ASOF JOIN o ON e.event_id % 120 >= o.s""")
def columns_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_id", (X("event_id") % 120).alias("x"))
    return grid.columns_under(points, grid.column_offsets(spark, 32))


_EDGES = "SELECT 'n' || n_nationkey src, 'r' || n_regionkey dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"
_NODES = "SELECT 'r' || r_regionkey node, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, a: str, key: str, b: str, to: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), key).alias("src"), F.concat(F.lit(b), to).alias("dst"), F.lit("ref").alias("role"))

    parts = (("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    first, *rest = [of(*p) for p in parts]
    for r in rest:
        first = first.unionByName(r)
    return first


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, a: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), key).alias("node"), F.lit(name).alias("type"))

    first, *rest = [of(*p) for p in (("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"))]
    for r in rest:
        first = first.unionByName(r)
    return first


@query(f"SELECT dst node, count(*) sinks FROM ({_EDGES}) GROUP BY 1")
def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_out(references(spark, sf_dir))


@query(f"SELECT a.src node, coalesce(b.dst, a.dst) final, CASE WHEN b.dst IS NULL THEN 1 ELSE 2 END::INT hops FROM ({_EDGES}) a LEFT JOIN ({_EDGES}) b ON a.dst = b.src")
def deref_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dereferenced(references(spark, sf_dir))


@query(f"""SELECT a.dst origin, a.src node, 1::INT AS depth FROM ({_EDGES}) a WHERE a.dst LIKE 'r%'
UNION ALL SELECT a.dst, b.src, 2::INT FROM ({_EDGES}) a JOIN ({_EDGES}) b ON b.dst = a.src WHERE a.dst LIKE 'r%'""")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.dependents(references(spark, sf_dir), changed)


@query(f"""SELECT base, count(*) n FROM ({_NODES}) JOIN (VALUES ('region', 'region'), ('region', 'place'), ('region', 'any'), ('nation', 'nation'), ('nation', 'place'), ('nation', 'any'),
('customer', 'customer'), ('customer', 'party'), ('customer', 'any'), ('supplier', 'supplier'), ('supplier', 'party'), ('supplier', 'any')) t(type, base) USING (type) GROUP BY 1""")
def registry_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("any", None), ("place", "any"), ("party", "any"), ("region", "place"), ("nation", "place"), ("customer", "party"), ("supplier", "party")]
    types = graph.type_closure(spark.createDataFrame(rows, "type string, base string"))
    return nodes(spark, sf_dir).join(types, "type").groupBy("base").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey src, p_type || '/' || p_size dst FROM part WHERE p_type || '/' || p_size IN (SELECT p_type || '/' || p_size FROM part GROUP BY 1 HAVING count(*) = 1)""")
def owned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts that one part alone refers to."""
    edges = table(spark, sf_dir, "part").select(X("p_partkey").alias("src"), F.concat_ws("/", "p_type", "p_size").alias("dst"), F.lit("ref").alias("role"))
    return graph.owned(edges).select("src", "dst")


@query("""SELECT 's' || s_suppkey node, 'r' || n_regionkey final, 2 hops FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def supplier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of references of suppliers, to their ends."""
    return graph.dereferenced(references(spark, sf_dir)).where("node LIKE 's%'")


@query("""SELECT user_id, max_by(event_id % 50, event_id) anchor, max_by(event_id * 7 % 50, event_id) AS lead, least(max_by(event_id % 50, event_id), max_by(event_id * 7 % 50, event_id)) first,
greatest(max_by(event_id % 50, event_id), max_by(event_id * 7 % 50, event_id)) AS last FROM events GROUP BY 1""")
def anchor_and_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", X("event_id").alias("seq"), (X("event_id") % 50).alias("anchor"), (X("event_id") * 7 % 50).alias("lead"))
    return intervals.anchor_and_lead(e, ["user_id"])


@query("""SELECT event_id, CASE WHEN ok THEN a END first, CASE WHEN ok THEN a + n - 1 END AS last, sign(event_id * 13 % 97 - event_id * 7 % 89)::INT compared
FROM (SELECT *, a >= 0 AND n > 0 ok FROM (SELECT event_id, event_id % 40 - 3 a, event_id % 5 n FROM events))""")
def address_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses edited as text, and cursors compared."""
    got = intervals.address_interval((X("event_id") % 40 - 3).cast("string"), (X("event_id") % 5).cast("string"))
    compared = arithmetic.cursor_compare(X("event_id") * 13 % 97, X("event_id") * 7 % 89)
    return table(spark, sf_dir, "events").select("event_id", got["first"].alias("first"), got["last"].alias("last"), compared.alias("compared"))


@query("""SELECT p_brand, min(p_partkey) first_key, max(p_partkey) last_key, count(DISTINCT p_partkey) size FROM part WHERE p_partkey >= 10 AND p_partkey < 900 GROUP BY 1""")
def sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = graph.sorted_set(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_partkey", 10, 900)
    return graph.set_ends(parts, ["p_brand"], "p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'file' WHEN p_partkey % 3 = 1 THEN 'bytes' ELSE 'object' END AS type,
array_to_string(list_concat([p_size, 1, 2][1:p_size % 4], [9], [p_size, 1, 2][p_size % 4 + 1:3]), ',') inserted,
array_to_string(CASE WHEN p_size % 4 < 3 THEN list_concat([p_size, 1, 2][1:p_size % 4], [p_size, 1, 2][p_size % 4 + 2:3]) ELSE [p_size, 1, 2] END, ',') removed FROM part""")
def wrapped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects wrapped by kind, and edits of lists."""
    kind = F.when(X("p_partkey") % 3 == 0, "open file").when(X("p_partkey") % 3 == 1, "data").otherwise("other").alias("kind")
    parts = graph.wrapped(table(spark, sf_dir, "part").select("p_partkey", "p_size", kind), {"open file": "file", "data": "bytes"})
    items, at = F.array(X("p_size"), F.lit(1), F.lit(2)), X("p_size") % 4
    shown = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return parts.select("p_partkey", "type", shown(graph.list_edit(items, at, "insert", F.lit(9))).alias("inserted"), shown(graph.list_edit(items, at, "remove")).alias("removed"))


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.as_closed(bit_interval_union(spark, sf_dir), ["user_id"])


_BIT_UNION = f"(SELECT user_id, bit_from, bit_to FROM ({ORACLES['bit_interval_union']}))"


@query(f"""SELECT user_id, sum(bit_to - bit_from)::BIGINT bits, min(bit_from) lowest, max(bit_to) highest, count(*) segments FROM {_BIT_UNION} GROUP BY 1""")
def bit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = intervals.as_half_open(_bits(spark, sf_dir), ["user_id"])
    return bits.groupBy("user_id").agg(F.sum(X("bit_to") - X("bit_from")).alias("bits"), F.min("bit_from").alias("lowest"), F.max("bit_to").alias("highest"), F.count(F.lit(1)).alias("segments"))


@query(f"""SELECT user_id, min(p) bit_from, max(p) + 1 bit_to FROM (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) g FROM (
SELECT user_id, p FROM (SELECT user_id, p, row_number() OVER (PARTITION BY user_id ORDER BY p) k FROM (SELECT user_id, unnest(range(bit_from, bit_to)) p FROM {_BIT_UNION})) WHERE k BETWEEN 12 AND 61)) GROUP BY user_id, g""")
def bit_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.as_half_open(intervals.slice_positions(_bits(spark, sf_dir), ["user_id"], 11, 50), ["user_id"])


@query(f"""SELECT user_id, count(*) bits, sum(p)::BIGINT total, min(p) lowest FROM (SELECT user_id, unnest(range(bit_from, bit_to)) p FROM {_BIT_UNION}) GROUP BY 1""")
def bit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = intervals.enumerate_positions(_bits(spark, sf_dir), ["user_id"])
    return every.groupBy("user_id").agg(F.count(F.lit(1)).alias("bits"), F.sum("pos").alias("total"), F.min("pos").alias("lowest"))


@query(f"""SELECT user_id, bit_from + CASE WHEN bit_from >= 1000 THEN 100 ELSE 0 END bit_from, bit_to + CASE WHEN bit_to > 1000 THEN 100 ELSE 0 END bit_to FROM (
SELECT user_id, bit_from, least(bit_to, CASE WHEN bit_from < 1000 THEN 1000 ELSE bit_to END) bit_to FROM {_BIT_UNION} UNION ALL SELECT user_id, 1000, bit_to FROM {_BIT_UNION} WHERE bit_from < 1000 AND bit_to > 1000)""")
def bit_insert_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = intervals.insert_space(_bits(spark, sf_dir), ["user_id"], F.lit(1000).cast("long"), F.lit(100).cast("long"))
    return intervals.as_half_open(made, ["user_id"])


@query(f"""SELECT user_id, min(p) bit_from, max(p) + 1 bit_to FROM (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) g FROM (
SELECT user_id, CASE WHEN p >= 1100 THEN p - 100 ELSE p END p FROM (SELECT user_id, unnest(range(bit_from, bit_to)) p FROM {_BIT_UNION}) WHERE p < 1000 OR p >= 1100)) GROUP BY user_id, g""")
def bit_remove_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.as_half_open(intervals.remove_space(_bits(spark, sf_dir), ["user_id"], 1000, 100), ["user_id"])


@query("""SELECT event_id, CASE WHEN event_id % 37 >= 5 THEN greatest(event_id % 30 - 5, 0) END bit_from, CASE WHEN event_id % 37 >= 5 THEN event_id % 37 - 5 END bit_to,
try_cast(event_type || event_id AS DECIMAL(38, 0))::VARCHAR parsed, try_cast(event_id * 3 || '' AS DECIMAL(38, 0))::VARCHAR number FROM events""")
def shifted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit intervals moved down, and integers parsed from text."""
    got = intervals.shift_left(X("event_id") % 30, X("event_id") % 37, F.lit(5))
    parsed = [codec.parse_int(c).cast("string").alias(n) for c, n in ((F.concat("event_type", X("event_id").cast("string")), "parsed"), ((X("event_id") * 3).cast("string"), "number"))]
    return table(spark, sf_dir, "events").select("event_id", got["bit_from"].alias("bit_from"), got["bit_to"].alias("bit_to"), *parsed)


@query("""SELECT user_id, CASE event_type WHEN 'click' THEN 'edited' WHEN 'view' THEN 'selection made' WHEN 'error' THEN 'closed' WHEN 'signup' THEN 'added' ELSE 'saved' END event, count(*) n FROM events GROUP BY ALL""")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.live import tagged

    names = {"click": "edited", "view": "selection made", "error": "closed", "signup": "added", "purchase": "saved"}
    return tagged(table(spark, sf_dir, "events"), names).groupBy("user_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query()
def default_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.page(documents(spark, sf_dir), "x", "doc_id")


@query()
def generated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.generated(spark).select("data_id", "length", F.md5("content").alias("digest"))
