"""What bounds the memory of Python workers: one Python step a task, and column blocks read where they lie."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_documents import frame

from octavo.llm import jaccard_join, quality_rules


def chained_steps(df):
    """The most Python steps that one task of the plan runs, each of which has a worker of its own."""
    above, most = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        if m := re.match(r"([\s:+-]*)(?:\*\(\d+\) )?([A-Za-z]\w+)", line):
            above = [(depth, n) for depth, n in above if depth < len(m[1])]
            n = above[-1][1] if above else 0
            n = 0 if "Exchange" in m[2] else n + bool(re.search("InArrow|InPandas|EvalPython", m[2]))
            above.append((len(m[1]), n))
            most = max(most, n)
    return most


def test_one_python_step_a_task_in_keep_good(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LINE_DOCS", 5)
    r = random.Random(6)
    own = lambda: " ".join(f"u{r.random()}" for _ in range(25))
    rows = [(k, f"Subscribe to our letter now\n{own()}", "h") for k in range(30)] + [(k, own(), "h") for k in range(30, 40)] + [(40, "too short", "h"), (41, None, "h")]
    left = quality_rules.keep_good(frame(spark, rows))
    assert chained_steps(left) == 1
    want = {(k, t.split("\n")[-1]) for k, t, _ in rows[:40]}
    assert {(x["doc_id"], x["text"]) for x in left.collect()} == want


@pytest.mark.parametrize("again", [0, 2])
def test_one_python_step_a_task_in_keep_one(spark, again):
    rows = [(1, "x y z", "s"), (3, "x y z", "s"), (None, "x y z", "s"), (2, "other words here", "s"), (4, None, "s"), *[(1, "x y z", "s")] * again]
    left = jaccard_join.keep_one(frame(spark, rows))
    assert chained_steps(left) == 1
    assert sorted((x["doc_id"], x["text"]) for x in left.collect() if x["text"]) == [(1, "x y z"), (2, "other words here")] and left.count() == 3


@pytest.mark.parametrize(("exact", "most"), [(False, 42), (True, 52)])
def test_column_counts_need_few_copies(exact, most):
    r, rows, seen, n = np.random.default_rng(3), [], Counter(), 200_000
    for g in range(4):
        h = np.unique(r.integers(0, 1 << 22, n)).astype("<u8" if exact else "<u4")
        places, counts = r.integers(0, 500, len(h)).astype(np.uint16), r.integers(1, 4, len(h)).astype("<u4")
        rows.append((0, g, h.tobytes(), places.tobytes(), counts.tobytes() if exact else None, None))
        for x, c in zip(h.tolist(), counts.tolist() if exact else [1] * len(h)):
            seen[x] += c
    rows.append((0, 0, None, b"meta", None, b"own"))
    table = pa.table(jaccard_join._table(rows, jaccard_join._GATHERED))
    tracemalloc.start()
    got = jaccard_join._column_counts(exact)(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = sum(len(x[2]) for x in rows if x[2]) // (8 if exact else 4)
    assert peak < most * total  # bytes an n-gram
    assert [x["meta"] for x in got if x["meta"]] == [b"meta"] and [x["own"] for x in got if x["meta"]] == [b"own"]
    for g, (_, _, h, p, _, _) in enumerate(rows[:4]):
        found = next(x for x in got if x["gather"] == g and x["places"])
        h, p = np.frombuffer(h, "<u8" if exact else "<u4"), np.frombuffer(p, np.uint16)
        shared = [(x, k) for x, k in zip(h.tolist(), p.tolist()) if seen[x] > 1]
        if exact:
            assert np.frombuffer(found["hashes"], "<u8").tolist() == [x for x, _ in shared] and np.frombuffer(found["places"], np.uint16).tolist() == [k for _, k in shared]
            assert np.frombuffer(found["counts"], "<u4").tolist() == [seen[x] for x, _ in shared]
        else:
            want = Counter(k for _, k in shared)
            assert dict(zip(np.frombuffer(found["places"], np.uint16).tolist(), np.frombuffer(found["counts"], "<u4").tolist(), strict=True)) == want
