"""Named functions for SQL: temporary SQL functions whose bodies Catalyst inlines, and their signatures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Signature:
    name: str
    params: tuple[tuple[str, str], ...]
    returns: str
    body: str

    def ddl(self) -> str:
        params = ", ".join(f"{n} {t}" for n, t in self.params)
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({params}) RETURNS {self.returns} RETURN {self.body}"


FUNCTIONS = {
    s.name: s
    for s in (
        Signature("byte_slice", (("x", "BINARY"), ("start", "BIGINT"), ("n", "BIGINT")), "BINARY", "substring(x, CAST(greatest(start, 0) + 1 AS INT), CAST(greatest(n + least(start, 0), 0) AS INT))"),
        Signature("byte_insert", (("x", "BINARY"), ("at", "INT"), ("d", "BINARY")), "BINARY", "substring(CASE WHEN octet_length(x) < at THEN rpad(x, at, X'00') ELSE x END, 1, at) || d || substring(x, at + 1)"),
        Signature("byte_delete", (("x", "BINARY"), ("at", "INT"), ("n", "INT")), "BINARY", "substring(x, 1, at) || substring(x, at + n + 1)"),
        Signature("byte_overwrite", (("x", "BINARY"), ("at", "INT"), ("d", "BINARY")), "BINARY", "substring(CASE WHEN octet_length(x) < at THEN rpad(x, at, X'00') ELSE x END, 1, at) || d || substring(x, at + octet_length(d) + 1)"),
        Signature("hex_text", (("x", "BINARY"),), "STRING", "lower(hex(x))"),
        Signature("bit_at", (("x", "BINARY"), ("n", "BIGINT")), "BOOLEAN", "getbit(CAST(conv(hex(substring(x, CAST(n DIV 8 AS INT) + 1, 1)), 16, 10) AS BIGINT), CAST(pmod(n, 8) AS INT)) = 1"),
        Signature("uint_be", (("x", "BINARY"),), "DECIMAL(20,0)", "CAST(conv(hex(x), 16, 10) AS DECIMAL(20,0))"),
        Signature("safe_div", (("a", "BIGINT"), ("b", "BIGINT")), "BIGINT", "CASE WHEN b = 0 THEN 0 ELSE a DIV nullif(b, 0) END"),
    )
}


def register(spark: SparkSession, *extra: Signature) -> list[str]:
    """Make the functions, and others given, known to the session's SQL."""
    every = {**FUNCTIONS, **{s.name: s for s in extra}}
    for s in every.values():
        spark.sql(s.ddl())
    return sorted(every)


def usable_on(kind: str) -> list[str]:
    """Functions whose first argument is of a type."""
    return sorted(s.name for s in FUNCTIONS.values() if s.params and s.params[0][1] == kind)


@dataclass(frozen=True)
class Constructor:
    """A function that makes a typed value from values: its signature comes from the parameters' types."""

    makes: str
    params: tuple[tuple[str, str], ...]

    def signature(self) -> Signature:
        fields = ", ".join(f"'{n}', {n}" for n, _ in self.params)
        kinds = ", ".join(f"{n}: {t}" for n, t in self.params)
        return Signature(f"new_{self.makes}", self.params, f"STRUCT<{kinds}>", f"named_struct({fields})")


#: The methods that a node of a type offers: name -> SQL of its arguments, the node itself as ``self``.
METHODS = {
    "list": {"element_at": "get(self, at)", "set_element": "transform(self, (v, k) -> if(k = at, item, v))", "size": "size(self)"},
    "bytes": {"slice": "byte_slice(self, start, n)", "insert": "byte_insert(self, at, d)", "delete": "byte_delete(self, at, n)", "length": "octet_length(self)"},
    "integer": {"divide": "safe_div(self, by)", "negate": "-self"},
}


def methods_of(kind: str, bases: tuple[str, ...] = ()) -> list[str]:
    """Names of a type's methods, its bases' included."""
    return sorted({m for k in (kind, *bases) for m in METHODS.get(k, {})})
