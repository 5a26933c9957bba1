"""Toxicity by a classifier chain: categories are predicted in turn, each model also given the earlier ones' probabilities.

The models are logistic regressions over how often marked words occur and a few dense features of the
text.  Marked words are those whose presence depends most on a category (chi-square) in a sample of
labelled documents; the sample is bounded by ``SAMPLE_DOCS``; those found almost only with a category are
also counted together, as a word may be too rare for a weight of its own.  In training, a later model gets the earlier
categories' probabilities out of fold, so that it learns from errors of the size it will meet.

Defined cases: a null or empty text has no words and gets what the models say of that; documents without
labels are scored alike; repeated rows are scored alike; labels for missing documents and null labels are
left out; rows of one text are one example, with the label that most of them have, the larger one if as many have each; with no usable label, or one class only, a category's probability is its share in the sample
(0 without any); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_cutoff, keep, rows_per_batch, take_memory, texts

#: Most labelled documents used to fit (those of the least hashes of the id), words marked per category, least documents of a word.
SAMPLE_DOCS, MARKED, WORD_DOCS = 8000, 128, 5
FOLDS, ROUNDS, RIDGE, THRESHOLD = 5, 300, 1e-4, 0.5
#: A marked word is telling for a category when so large a share of its documents have it, and so many times the usual share.
TELLING, LIFT = 0.8, 3
_LETTERS = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile("[A-Z]{2,}")
DENSE = 6


@dataclass
class Marked:
    """Word -> place of its feature, and per category the places of its telling words."""

    words: dict[str, int]
    telling: list[set[int]]

    def width(self) -> int:
        return len(self.words) + len(self.telling) + DENSE


def features(text: str | None, marked: Marked) -> np.ndarray:
    """Marked words by presence, distinct telling words of each category by min(n, 3) / 3, then the dense features."""
    out = np.zeros(marked.width(), np.float32)
    if not text:
        return out
    words = _LETTERS.findall(text.lower())
    distinct = set(words)
    found = {i for i in map(marked.words.get, distinct) if i is not None}
    out[list(found)] = 1
    for k, telling in enumerate(marked.telling):
        out[len(marked.words) + k] = min(len(found & telling), 3) / 3
    n = len(words)
    out[-DENSE:] = (
        np.log1p(n) / 10,
        min(3 * len(_CAPITALS.findall(text)) / len(text), 1),
        sum(map(text.count, "#*$%&|<>")) / len(text),
        sum(map(len, words)) / max(n, 1) / 10,
        len(distinct) / max(n, 1),
        n < 20,
    )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the last weight is the constant."""
    w = np.zeros(x.shape[1] + 1)
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        w[-1] = 30 * (2 * share - 1)
        return w
    full = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    step = 4 / max(np.linalg.norm(full, axis=1).max() ** 2, 1e-9)
    step = max(step, 4 / (np.linalg.eigvalsh((full.T @ full).astype(float))[-1] / len(x) + 1e-9))
    look, before = w.copy(), w
    for k in range(ROUNDS):
        grad = full.T @ (_sigmoid(full @ look.astype(x.dtype)) - y).astype(x.dtype) / len(x) + RIDGE * np.append(look[:-1], 0)
        w = look - step * grad
        look, before = w + k / (k + 3) * (w - before), w
    return w


def predict(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the categories, each model fed those before it."""
    for w in models:
        x = np.hstack([x, _sigmoid(x @ w[:-1] + w[-1])[:, None]])
    return x[:, x.shape[1] - len(models) :]


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One model per column of ``y``; what a later one sees of an earlier one in training is out of fold."""
    models = []
    for c in range(y.shape[1]):
        models.append(fit(x, y[:, c]))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            held = fold == f
            w = fit(x[~held], y[~held, c])
            out[held] = _sigmoid(x[held] @ w[:-1] + w[-1])
        x = np.hstack([x, out[:, None].astype(x.dtype)])
    return models


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[Marked, list[np.ndarray]]:
    """The marked words and the models."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("int") for c in categories]).na.drop()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    # SAMPLE_DOCS of them at any size: the bound makes the broadcast safe
    cutoff = hash_cutoff(known.select(F.xxhash64("doc_id").alias("h")), SAMPLE_DOCS)
    known = known.where(F.xxhash64("doc_id") <= F.lit(cutoff if cutoff is not None else 0).cast("long"))
    rows_per_batch(docs.sparkSession)
    # copies of a text count once, else their words would mark whatever label the text happens to have
    found = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")
    votes = [F.when(2 * F.sum(c) >= F.count(F.lit(1)), 1).otherwise(0).alias(c) for c in categories]
    sample = keep(found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), *votes), "labelled")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(_LETTERS.findall((t.as_py() or "").lower()))) for t in b["text"]]
            yield pa.RecordBatch.from_pydict({"words": pa.array(found, pa.list_(pa.string()))} | {c: b[c] for c in categories})

    kinds = ", ".join(f"`{c}` int" for c in categories)
    seen = sample.mapInArrow(words, f"words array<string>, {kinds}").select(F.explode("words").alias("word"), *categories)
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).where(F.col("n") >= WORD_DOCS)
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    counts = keep(counts, "words")
    marked = Marked({}, [])
    telling: list[set[str]] = []
    for c in categories:
        rows, pos = max(total["n"], 1), total[c] or 0
        a, n_word = F.col(c).cast("double"), F.col("n").cast("double")
        # chi-square of a two by two table: presence against category
        gap = a * (rows - n_word - pos + a) - (n_word - a) * (pos - a)
        chi = gap * gap / (n_word * (rows - n_word) + 1e-9)
        top = counts.orderBy(chi.desc(), "word").limit(MARKED).collect()
        telling.append({r["word"] for r in top if r[c] >= max(TELLING, LIFT * pos / rows) * r["n"]})
        for r in top:
            marked.words.setdefault(r["word"], len(marked.words))
    marked.telling += [{marked.words[w] for w in ws} for ws in telling]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), marked).tobytes() for t in b["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "x": pa.array(x, pa.binary())} | {c: b[c] for c in categories})

    got = sample.mapInArrow(vectors, f"doc_id long, x binary, {kinds}").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), marked.width())
    fold = (got["doc_id"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FOLDS
    return marked, fit_chain(x, got[categories].to_numpy(float), fold)


def score(docs: DataFrame, marked: Marked, models: list[np.ndarray], categories: list[str], id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, ``p_<category>`` of each, and ``more`` columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("chain")
        for b in batches:
            x = np.array([features(t.as_py(), marked) for t in b["text"]], np.float32).reshape(b.num_rows, -1)
            p = predict(x, models) if b.num_rows else np.zeros((0, len(models)))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"]} | {f"p_{c}": pa.array(p[:, k], pa.float64()) for k, c in enumerate(categories)} | {c: b[c] for c in more})

    rows = texts(docs, id_col, text_col, *more)
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    rows_per_batch(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id long" + "".join(f", p_{c} double" for c in categories) + extra)


def toxic_documents(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the chain's probabilities and ``toxic``: the last category's is ``THRESHOLD`` or more."""
    names = list(categories)
    marked, models = train(docs, labels, names, id_col, text_col)
    got = score(docs, marked, models, names, id_col, text_col)
    return got.withColumn("toxic", F.col(f"p_{names[-1]}") >= THRESHOLD)


def keep_clean(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns: one pass, nothing is joined."""
    names = list(categories)
    marked, models = train(docs, labels, names, id_col, text_col)
    columns = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("chain")
        at = columns.names.index(text_col)
        for b in batches:
            x = np.array([features(t.as_py(), marked) for t in b.column(at)], np.float32).reshape(b.num_rows, -1)
            if b.num_rows:
                yield b.filter(pa.array(predict(x, models)[:, -1] < THRESHOLD))

    return docs.mapInArrow(run, columns)
