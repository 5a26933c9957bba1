"""The pipeline stage by stage, each against a brute-force version on its own input, and the registered queries of these operators."""

import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_documents import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from octavo.llm import queries, quality_rules, secret_scan

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def by_sql(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(sql).df()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda f: sorted(map(str, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None)))
    assert key(a) == key(b)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "secret scans", "packing"]
    steps = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        steps.append(docs.toPandas())
    raw, good, clean, distinct, redacted, pieces = steps
    assert set(good["doc_id"]) == set(by_sql(quality_rules.SQL, raw).query("kept")["doc_id"])
    lex = "trash pathetic idiot worthless disgusting stupid clown scum loser moron".split()
    hits = lambda f: f["text"].str.lower().map(lambda t: len(set(re.findall(r"[^\W\d_]+", t)) & set(lex)))
    assert 0 < len(good) - len(clean) < 0.2 * len(good) and (hits(clean) >= 3).sum() <= 0.2 * (hits(good) >= 3).sum()
    want = brute_components(list(clean[["doc_id", "text", "source"]].itertuples(index=False, name=None)))
    assert sorted(distinct["doc_id"]) == sorted(i for i, (_, c) in want.items() if c == i)
    assert sorted(redacted["doc_id"]) == sorted(distinct["doc_id"])
    before = distinct.set_index("doc_id")["text"]
    for i, t, n in zip(redacted["doc_id"], redacted["text"], redacted["n_chars"]):
        assert n == len(t) and not secret_scan.base_spans(t)
        assert t == before[i] or secret_scan.REDACTED in t
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORDS))
    total = 0
    for i, t in zip(redacted["doc_id"], redacted["text"]):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, queries.END_ID], "<u4")
        own = pieces[pieces["doc_id"] == i].sort_values("start")
        assert own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
        total += len(ids)
    at = sorted(pieces["sequence_id"] * queries.WINDOW + pieces["offset"])
    assert at[0] == 0 and pieces["length"].sum() == total and len(set(at)) == len(at)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA).toPandas(), by_sql(queries.ORACLES[name], spark.read.parquet(f"{DATA}/documents.parquet").toPandas()))


def test_registered(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline", "hex_dump"} <= set(found)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)
