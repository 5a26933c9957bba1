"""Quality rules: per-document statistics, and lines that too many documents of a host share.

Lines are normalised (words joined by single spaces, A-Z in lower case) and hashed.  A line's count on a
host is its number of distinct documents there; rows of one host with the same whole text are one document,
so exact copies do not make a text's lines look like boilerplate.  Lines above the host's limit are removed;
a document left with too little is rejected.

Each distinct line of a document travels once, as hashes; counting is pre-aggregated in two levels (host,
line and text, then host and line), so neither a common line nor a large host meets in one task.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows get the same
verdict; a null host is a host of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .key_sets import matched
from .shared import keep, rows_per_batch, split_words, take_memory

#: Base rules: fewest words, window, and the share (per cent) of words in repeated windows.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: A line is common on a host from this many distinct documents and this share of the host's documents on.
LINE_DOCS, LINE_SHARE = 20, 0.07
#: A document is depleted when fewer words, or a smaller share of its words, are left.
LEFT_WORDS, LEFT_SHARE = 20, 0.4
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
_MULTIPLIERS = np.random.default_rng(8).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FACTS = "doc_id long, host string, key long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, line_words array<long>"


def repeat_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += codes[k : k + n] * _MULTIPLIERS[k]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    maybe = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])].tolist()
    found = Counter(tuple(words[i : i + window]) for i in maybe)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in maybe:
        if found[tuple(words[i : i + window])] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def line_hash(words: list[str]) -> int:
    return int.from_bytes(md5(" ".join(words).encode("utf-8", "surrogatepass").lower()).digest()[:8], "big")


def text_facts(text: str | None) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each distinct normalised line by its hash."""
    if not text:
        return 0, 0, 0, 0, 0, {}
    words, seen, dup, lines = [], set(), 0, {}
    for line in text.split("\n"):
        if ws := split_words(line):
            dup += line in seen
            seen.add(line)
            words += ws
            h = line_hash(ws)
            lines[h] = lines.get(h, 0) + len(ws)
    chars = len(text) - sum(map(text.count, BLANK))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines


def _signed(h: int) -> int:
    return h if h < 1 << 63 else h - (1 << 64)


def _key(id_col: str, text_col: str, host_col: str) -> Column:
    """Under this key a row and its verdict meet: rows that agree in it have the same verdict."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(host_col).cast("string"))


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("lines")
        for b in batches:
            got = [text_facts(x.as_py()) for x in b["text"]]
            lines = [list(x[5]) for x in got]
            longs = pa.list_(pa.int64())
            cols = {c: b[c] for c in ("doc_id", "host", "key", "text_key")}
            cols |= {n: pa.array([x[k] for x in got], pa.int64()) for k, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
            cols |= {"line": pa.array([[_signed(h) for h in hs] for hs in lines], longs)}
            yield pa.RecordBatch.from_pydict(cols | {"line_words": pa.array([list(x[5].values()) for x in got], longs)})

    rows_per_batch(docs.sparkSession)
    doc_id, text, host = F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(host_col).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), host.alias("host"), _key(id_col, text_col, host_col).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    return rows.mapInArrow(read, FACTS)


def _lines(read: DataFrame) -> DataFrame:
    return read.select("key", "host", "text_key", F.explode(F.arrays_zip("line", "line_words")).alias("x")).select("key", "host", "text_key", "x.*")


def line_counts(read: DataFrame) -> DataFrame:
    """Of ``facts``: per ``host`` and ``line`` (its hash) the distinct documents that have it, ``docs``, and the host's, ``host_docs``."""
    once = _lines(read).groupBy("host", "line", "text_key").agg(F.lit(1).alias("one"))
    counted = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    docs_of = read.groupBy("host", "text_key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return counted.alias("c").join(docs_of.alias("d"), F.col("c.host").eqNullSafe(F.col("d.host"))).select("c.host", "line", "docs", "host_docs")


def _counted(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    """The facts, and ``key``, ``line``, ``line_words`` of the common lines of each row."""
    read = keep(facts(docs, id_col, text_col, host_col), "facts")
    above = (F.col("docs") >= LINE_DOCS) & (F.col("docs") >= F.lit(LINE_SHARE) * F.col("host_docs"))
    common = keep(line_counts(read).where(above).select(F.col("host").alias("at"), F.col("line").alias("common")), "common")
    hit = _lines(read).join(common, F.col("host").eqNullSafe(F.col("at")) & (F.col("line") == F.col("common")))
    # a repeated row has the same lines under the same key, as often as it is repeated
    return read, hit.groupBy("key", "line").agg(F.first("line_words").alias("w"))


def _verdicts(read: DataFrame, hit: DataFrame) -> DataFrame:
    removed = hit.groupBy("key").agg(F.sum("w").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < LEFT_WORDS) | (left < F.lit(LEFT_SHARE) * F.col("n_words")))
    return (
        read.drop("line", "line_words", "text_key")
        .join(removed, "key", "left")
        .withColumn("removed_words", F.coalesce("removed", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "key")
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document its statistics, ``removed_words`` (in common lines), ``base_failed``, ``kept`` and the key of its row."""
    return _verdicts(*_counted(docs, id_col, text_col, host_col))


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose (signed) hashes are given; blank lines and all others stay as they are."""
    return "\n".join(x for x in text.split("\n") if not ((ws := split_words(x)) and _signed(line_hash(ws)) in gone))


def _cleaned(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with their ``octavo_lines`` taken out of their texts."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            texts = [without_lines(t, set(gone)) for t, gone in zip(b.column(at).to_pylist(), b["octavo_lines"].to_pylist(), strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, rows.schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns: texts without their host's common lines, and ``size_col``, if there, set to the code points left."""
    read, hit = _counted(docs, id_col, text_col, host_col)
    hit = keep(hit, "hit")
    verdicts = keep(_verdicts(read, hit).select("key", "kept", "removed_words"), "verdicts")
    told = verdicts.where(~F.col("kept") | (F.col("removed_words") > 0)).groupBy("key").agg(F.bool_and("kept").alias("octavo_kept"))
    told = keep(told, "told")
    lines = hit.join(told.where("octavo_kept"), "key", "left_semi").groupBy("key").agg(F.collect_list("line").alias("octavo_lines"))
    # rows that are kept as they are stay where they are
    same, rest = matched(docs, _key(id_col, text_col, host_col), keep(told.join(lines, "key", "left"), "told_lines"))
    bare = F.col("octavo_lines").isNull()
    rows_per_batch(docs.sparkSession)
    some = keep(rest.where(F.coalesce("octavo_kept", F.lit(True))).select(*docs.columns, "octavo_lines"), "maybe_common")
    done = _cleaned(some.where(~bare), text_col)
    if size_col in docs.columns:
        done = done.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    out = some.where(bare).select(*docs.columns).unionByName(done.select(*docs.columns))
    return out if same is None else same.unionByName(out)


#: The same in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, source host, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^ \t\n\x0B\x0C\r]+') ws, t FROM d),
l0 AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) line FROM d),
l1 AS (SELECT doc_id, host, line, regexp_extract_all(line, '[^ \t\n\x0B\x0C\r]+') ws FROM l0),
l AS (SELECT * FROM l1 WHERE len(ws) > 0),
dup AS (SELECT doc_id, sum(c - 1) n FROM (SELECT doc_id, line, count(*) c FROM l GROUP BY ALL) GROUP BY 1),
n AS (SELECT doc_id, host, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') line, sum(len(ws)) words FROM l GROUP BY ALL),
f AS (SELECT n.host, line, count(DISTINCT t) docs FROM n JOIN d USING (doc_id) GROUP BY ALL HAVING count(DISTINCT t) >= 20),
hd AS (SELECT host, count(DISTINCT t) n FROM d GROUP BY 1),
g AS (SELECT f.host, f.line FROM f JOIN hd ON f.host IS NOT DISTINCT FROM hd.host WHERE docs >= 0.07::DOUBLE * n),
rem AS (SELECT doc_id, sum(words) n FROM n JOIN g ON n.host IS NOT DISTINCT FROM g.host AND n.line = g.line GROUP BY 1),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) i, ws FROM w WHERE len(ws) >= 9),
q AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') g FROM p),
q2 AS (SELECT doc_id, i FROM q QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rw AS (SELECT doc_id, count(DISTINCT j) n FROM (SELECT doc_id, unnest(range(i, i + 8)) j FROM q2) GROUP BY 1),
a AS (SELECT w.doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(dup.n, 0)::BIGINT n_dup_lines,
  coalesce(rw.n, 0)::BIGINT n_repeat_words, coalesce(rem.n, 0)::BIGINT removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN rem USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.4::DOUBLE * n_words)) kept,
  removed_words
FROM b
"""
