"""Quality rules, toxicity, Jaccard join, secrets and licences against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from octavo.llm import components, jaccard_join, license_scan, quality_rules, secret_scan, toxicity

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, node long, key string"


def frame(spark, rows):
    """(id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), 1, "k") for i, t, s in rows], SCHEMA)


def words(r, n, of=400):
    return [f"w{r.randrange(of)}" for _ in range(n)]


# --- quality ---


def test_text_facts():
    text = "a b c\n\na  b c\na b c\n#x $\x1cy"
    n, chars, signs, dup, rep, lines = quality_rules.text_facts(text)
    found = re.findall("[^\x20\x09-\x0d]+", text)
    assert (n, chars, signs, dup, rep) == (len(found), sum(map(len, found)), 2, 1, 0)
    assert sorted(lines.values()) == [2, 6]
    assert quality_rules.text_facts(None) == quality_rules.text_facts("") == (0, 0, 0, 0, 0, {})


def test_repeat_words():
    def brute(ws, w=8):
        c = Counter(tuple(ws[i : i + w]) for i in range(len(ws) - w + 1))
        return len({j for i in range(len(ws) - w + 1) if c[tuple(ws[i : i + w])] > 1 for j in range(i, i + w)})

    r = random.Random(1)
    for n in (0, 7, 8, 9, 40, 300):
        for of in (1, 2, 3, 50):
            ws = words(r, n, of)
            ws += ws[: n // 2]
            assert quality_rules.repeat_words(ws) == brute(ws)


def test_common_lines(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LINE_DOCS", 5)
    r = random.Random(3)
    unique = lambda n: " ".join(f"u{r.random()}" for _ in range(n))
    rows = []
    for k in range(30):  # a line that many documents of one host share, over two own lines or too little
        rows.append((k, "\n".join([unique(20), unique(20), "Subscribe  to OUR letter now"]), "h"))
    for k in range(30, 36):
        rows.append((k, "\n".join([unique(12), unique(6), "subscribe to our letter now"]), "h"))
    copy = "\n".join(unique(15) for _ in range(6))
    rows += [(k, copy, "h") for k in range(40, 60)]  # copies of one text are no boilerplate
    rows += [(60, None, "h"), (61, "", None), (62, "few words", None)]
    got = {x["doc_id"]: x for x in quality_rules.quality(frame(spark, rows)).collect()}
    assert all(got[k]["kept"] and got[k]["removed_words"] == 5 for k in range(30))
    assert all(not got[k]["kept"] and not got[k]["base_failed"] for k in range(30, 36))
    assert all(got[k]["kept"] and got[k]["removed_words"] == 0 for k in range(40, 60))
    assert all(got[k]["base_failed"] and not got[k]["kept"] for k in (60, 61, 62))
    docs = frame(spark, rows)
    left = quality_rules.keep_good(docs.unionByName(docs.where("doc_id = 0")))
    assert left.columns == docs.columns and sorted(x["doc_id"] for x in left.collect()) == [0, *range(30), *range(40, 60)]
    assert quality_rules.quality(docs.limit(0)).count() == 0


def test_every_line_counts_its_documents(spark):
    r = random.Random(11)
    shared = [f"shared line number {k} of this host" for k in range(10)]
    rows = [(k, "\n".join([*shared, f"own {r.random()}"]), "h") for k in range(200)]
    rows += [(k, rows[0][1], "h") for k in range(200, 250)]  # exact copies of a whole text count once
    rows += [(k, shared[0], "one") for k in range(300, 330)] + [(k, f"{shared[0]}\n{k}", None) for k in range(400, 425)]
    read = quality_rules.facts(frame(spark, rows))
    got = {(x["host"], x["line"]): (x["docs"], x["host_docs"]) for x in quality_rules.line_counts(read).collect()}
    line = lambda t: quality_rules._signed(quality_rules.line_hash(t.split()))
    assert all(got["h", line(t)] == (200, 200) for t in shared)
    assert got["one", line(shared[0])] == (1, 1) and got[None, line(shared[0])] == (25, 25)
    assert sorted(got.values()) == sorted([(200, 200)] * 10 + [(1, 200)] * 200 + [(1, 1)] + [(25, 25)] + [(1, 25)] * 25)
    kept = {x["doc_id"]: x["kept"] for x in quality_rules.quality(frame(spark, rows)).collect()}
    assert not any(kept[k] for k in range(250))


def test_common_lines_leave_the_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LINE_DOCS", 5)
    r = random.Random(4)
    own = [" ".join(f"u{r.random()}" for _ in range(25)) for _ in range(40)]
    rows = [(k, f"Subscribe  to OUR letter now\n\n{own[k]}\nsubscribe to our letter NOW", "h") for k in range(30)]
    rows += [(k, f"{own[k]}\nSubscribe to our letter now", "g" if k < 33 else None) for k in range(30, 36)]  # too few documents there
    rows += [(36, own[36], "h"), rows[0]]
    left = {(x["doc_id"], x["text"], x["n_chars"]) for x in quality_rules.keep_good(frame(spark, rows)).collect()}
    want = {(k, f"\n{own[k]}", len(own[k]) + 1) for k in range(30)} | {(k, t, len(t)) for k, t, _ in rows[30:37]}
    assert left == want


# --- toxicity ---


@pytest.fixture(scope="module")
def labelled(spark):
    r, rows, labels = random.Random(8), [], []
    for k in range(900):
        bad = k % 5 == 0
        ws = words(r, 60, 3000)
        if bad:
            ws[5:5] = r.sample(["vile", "rotten", "filth", "scoundrel"], 3)
        rows.append((k, " ".join(ws) + " end.", "s"))
        if k < 600:
            labels.append((k, 1 - (k % 7 == 0), int(bad), "x"))
    rows += [(1000, None, "s"), (1001, "", "s")]
    return frame(spark, rows), spark.createDataFrame([*labels, (1, None, None, "x"), (5000, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")


def test_toxic_documents_are_caught(labelled):
    docs, labels = labelled
    got = {x["doc_id"]: x for x in toxicity.toxic_documents(docs, labels).collect()}
    held_out = range(600, 900)
    assert all(got[k]["toxic"] == (k % 5 == 0) for k in held_out)
    assert not got[1000]["toxic"] and not got[1001]["toxic"]
    left = toxicity.keep_clean(docs, labels)
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} == {k for k, x in got.items() if not x["toxic"]}


def brute_toxicity(docs, labels, categories=("quality", "toxic")):
    """The whole query in plain Python: votes of copies, marked and telling words by chi-square, features, chain; doc_id -> probabilities."""
    labels = {i: y for i, *y in labels if None not in y[:2]}
    votes = {}
    for i, t, _ in docs:
        if i in labels:
            votes.setdefault(t, []).append((i, labels[i]))
    sample = [(min(i for i, _ in v), t, [int(2 * sum(y[c] for _, y in v) >= len(v)) for c in range(2)]) for t, v in votes.items()]
    found = [set(re.findall(r"[^\W\d_]+", (t or "").lower())) for _, t, _ in sample]
    rows, marked, telling = len(sample), [], []
    n = Counter(w for f in found for w in f)
    for c in range(2):
        pos = sum(y[c] for *_, y in sample)
        a = Counter(w for f, (*_, y) in zip(found, sample) if y[c] for w in f)
        chi = {w: (a[w] * (rows - n[w] - pos + a[w]) - (n[w] - a[w]) * (pos - a[w])) ** 2 / (n[w] * (rows - n[w]) + 1e-9) for w in n if n[w] >= toxicity.WORD_DOCS}
        top = sorted(chi, key=lambda w: (-chi[w], w))[: toxicity.MARKED]
        marked += [w for w in top if w not in marked]
        telling.append([w for w in top if a[w] >= max(toxicity.TELLING, toxicity.LIFT * pos / rows) * n[w]])

    def vector(t):
        if not t:
            return [0.0] * (len(marked) + 2 + toxicity.DENSE)
        ws = re.findall(r"[^\W\d_]+", t.lower())
        out = [float(w in ws) for w in marked] + [min(len(set(ws) & set(x)), 3) / 3 for x in telling]
        signs = sum(c in "#*$%&|<>" for c in t)
        return out + [np.log1p(len(ws)) / 10, min(3 * len(re.findall("[A-Z]{2,}", t)) / len(t), 1), signs / len(t), sum(map(len, ws)) / max(len(ws), 1) / 10, len(set(ws)) / max(len(ws), 1), float(len(ws) < 20)]

    sample.sort(key=lambda x: x[0])
    x, y = np.array([vector(t) for _, t, _ in sample], np.float32), np.array([v for *_, v in sample], float)
    fold = np.array([((i * 0x9E3779B97F4A7C15) % 2**64 >> 40) % toxicity.FOLDS for i, *_ in sample])
    seen, every = x, np.array([vector(t) for _, t, _ in docs], np.float32)
    for c in range(2):
        sig = lambda v, w: 1 / (1 + np.exp(-(v @ w[:-1] + w[-1])))
        w, out = toxicity.fit(seen, y[:, c]), np.zeros(len(x), np.float32)
        for f in range(toxicity.FOLDS):
            out[fold == f] = sig(seen[fold == f], toxicity.fit(seen[fold != f], y[fold != f, c]))
        every, seen = np.hstack([every, sig(every, w)[:, None]]), np.hstack([seen, out[:, None]])
    return {i: every[k, -2:] for k, (i, *_) in enumerate(docs)}


def test_toxicity_against_brute_force(spark, labelled):
    docs, labels = labelled
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    # copies whose labels disagree: two to one against, and one to one
    rows += [(2000, rows[5][1], "s"), (2001, rows[5][1], "s"), (2002, rows[10][1], "s")]
    extra = [(2000, 0, 0), (2001, 0, 0), (2002, 1, 0)]
    known = [tuple(r)[:3] for r in labels.collect()] + extra
    want = brute_toxicity(rows, known)
    got = toxicity.toxic_documents(frame(spark, rows).repartition(3), spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert np.allclose([x["p_quality"], x["p_toxic"]], want[x["doc_id"]], atol=1e-4) and x["toxic"] == (x["p_toxic"] >= 0.5)


def test_without_labels(labelled):
    docs, labels = labelled
    got = toxicity.toxic_documents(docs, labels.limit(0))
    assert got.where("toxic").count() == 0 and got.count() == docs.count()
    assert toxicity.toxic_documents(docs.limit(0), labels).count() == 0


def test_chain_is_fed_out_of_fold():
    r = np.random.default_rng(0)
    x = r.standard_normal((600, 3)).astype(np.float32)
    a = (x[:, 0] > 0).astype(float)
    y = np.stack([a, ((x[:, 1] > 0) & (a > 0)).astype(float)], axis=1)
    models = toxicity.fit_chain(x, y, np.arange(600) % toxicity.FOLDS)
    assert [len(w) for w in models] == [4, 5]
    p = toxicity.predict(x, models)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.9
    flat = toxicity.fit(x, np.ones(600))
    assert (toxicity.predict(x, [flat]) > 0.99).all()


# --- near duplicates ---


def brute_components(rows, percent=75):
    sets, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[i] = frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def near():
    r, rows = random.Random(12), []
    shared = words(r, 70, 10**6)

    def edited(ws, share):
        return [f"e{r.random()}" if r.random() < share else w for w in ws]

    for g in range(12):
        ws = words(r, r.randrange(6, 200), 10**6)
        rows += [" ".join(edited(ws, r.choice([0, 0.002, 0.01, 0.02, 0.04, 0.08]))) for _ in range(r.choice([1, 2, 3, 12, 40]))]
    rows += [" ".join(words(r, 60, 10**6) + shared) for _ in range(40)]  # a passage that many share
    rows += [" ".join(shared[k : k + 20]) for k in range(0, 40, 2)]  # short ones made of it
    rows += ["a b", "A  b", "a b c", "", None, " \n", "one two three four five", "ONE two three\tfour five", "É é é é é", "é é é é é"]
    r.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


def test_jaccard_components(spark, near):
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(frame(spark, near)).collect()}
    assert got == brute_components(near)


def test_jaccard_long_columns(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SEGMENT", 4)
    monkeypatch.setattr(jaccard_join, "NEAREST_ROUNDS", 1)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(frame(spark, near)).collect()}
    assert got == brute_components(near)


def test_jaccard_small_gathers(spark, near, monkeypatch):
    """Gathers of a few sets, so that n-grams repeat within and between them; the same with a gather of all."""
    monkeypatch.setattr(jaccard_join, "GATHER", 300)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(frame(spark, near).repartition(2)).collect()}
    assert got == brute_components(near)


def test_a_repeated_ngram_is_sent_once():
    """A line that every document has comes to its block once per gather, not once per document."""
    g = jaccard_join._Gather(4, False)
    common = jaccard_join.ngram_set("a line that very many documents have")
    for k in range(500):
        g.add(k, np.unique(np.concatenate([common, jaccard_join.ngram_set(f"own {k}")])), k)
    rows = g.rows(7).to_pylist()
    assert sum(len(x["hashes"]) // 4 for x in rows if x["hashes"]) == 500 + len(common)


def test_keep_one(spark):
    rows = [(3, "x y z", "s"), (1, "x y z", "s"), (2, "other words here", "s"), (4, None, "s"), (5, "", "s"), (None, "x y z", "s")]
    docs = frame(spark, rows)
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns and sorted(x["doc_id"] or -1 for x in left.collect()) == [1, 2, 4, 5]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_ids(spark):
    rows = [(2, "t u v", "s"), (5, "t u v", "s"), (5, "quite other words", "s"), (2, "t u v", "z"), (2, "t u v", "s"), (None, "lonely text", "s"), (None, "lonely text", "s"), (7, None, "s"), (7, None, "s")]
    left = jaccard_join.keep_one(frame(spark, rows)).collect()
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in left) == [(0, "lonely text"), (2, "t u v"), (5, "quite other words"), (7, ""), (7, "")]


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 240)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {x: find(x) for x in list(up) if find(x) != x}


# --- secrets ---


def test_base_spans():
    key, hexes = "AKIA" + "A1" * 9, "0123456789abcdef" * 2
    text = f"é PASSWORD = 'abc123' token:x {key} ſecret=abcdefg api-key=zzzzzzz apikey: short6 {hexes} {hexes[:20]} secret  = \"a.b/c=\" aKKIA"
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert secret_scan.base_spans(text) == sorted(want) and len(want) == 5


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(1)
    for n in range(1, 6):
        scores, moves = r.standard_normal((n, 3)), r.standard_normal((3, 3))
        path = lambda t: moves[0, t[0]] + sum(moves[a, b] for a, b in zip(t, t[1:])) + sum(scores[k, x] for k, x in enumerate(t)) + moves[t[-1], 0]
        assert tuple(secret_scan.viterbi(scores, moves)) == max(itertools.product(range(3), repeat=n), key=path)


def test_decoding_is_viterbi_over_the_whole_text():
    """Leaving out stretches that can't gain changes nothing."""
    r, rng = random.Random(6), np.random.default_rng(6)
    for _ in range(20):
        field = secret_scan.Field((rng.standard_normal((secret_scan.BUCKETS, 3)) * 0.7).astype(np.float32), secret_scan._legal() + rng.standard_normal((3, 3)), frozenset(["w1"]))
        batch = [" ".join(r.choice(["w1", "x9y", "=", '"', "Ab-c", "é.", "key:"]) for _ in range(r.randrange(0, 60))) for _ in range(8)]
        want = []
        for text in batch:
            scores, starts = field.scores([text])
            tags = secret_scan.viterbi(scores[starts[0] : starts[0] + len(secret_scan.tokens(text))], field.moves) if text else []
            want.append([(k, next((j for j in range(k + 1, len(tags)) if tags[j] != 2), len(tags)) - 1) for k, t in enumerate(tags) if t == 1])
        assert field.tagged(batch) == want
        assert [len(secret_scan.token_spans(t)) for t in batch] == [len(secret_scan.tokens(t)) for t in batch]


@pytest.fixture(scope="module")
def secrets(spark):
    r = random.Random(5)
    code = lambda n, of="0123456789abcdef": "".join(r.choice(of) for _ in range(n))
    prose = lambda n: " ".join(words(r, n))
    rows = [(k, f"{prose(40)} token = \"{code(40)}\" and call 555-{r.randrange(1000, 9999)} or {r.randrange(10**15, 10**16)} now {prose(30)}.", "s") for k in range(400)]
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    # forms that neither the patterns nor the taught phrases have
    unseen = [f"pwd = \"{code(10, letters + '23456789')}\"", f"Authorization: Bearer {code(30, letters)}", "pwd: Correct-Horse-Battery-Staple", f"ghp_{code(36, letters + '0123456789')}", f"credentials = '{code(9, letters)}+{code(8)}=='"]
    rows += [(1000 + 10 * k + j, f"{prose(20)} {x} {prose(20)}", "s") for k in range(10) for j, x in enumerate(unseen)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "nothing 12345678 here", "s"), (903, f"{prose(12)} on 2024-05-11 at 10:22:33", "s")]
    return rows, frame(spark, rows)


def test_field_adds_what_patterns_miss(secrets):
    rows, docs = secrets
    learn = docs.where("doc_id < 400")
    got = {x["doc_id"]: x for x in secret_scan.secret_spans(docs, learn_from=learn).collect()}
    assert all(got[k]["n_assign"] == 1 and got[k]["n_hex"] == 1 for k in range(400)) and sum(got[k]["n_crf"] > 0 for k in range(400)) <= 8
    held = [i for i in got if i >= 1000]
    assert sum(got[i]["n_crf"] > 0 for i in held) >= 0.9 * len(held)
    assert got[902]["spans"] == got[903]["spans"] == got[900]["spans"] == got[901]["spans"] == "" and got[900]["base_sha256"] == got[901]["base_sha256"]
    clean = {x["doc_id"]: x for x in secret_scan.redact(docs, learn_from=learn).collect()}
    assert clean[900]["text"] is None and clean[902]["text"] == "nothing 12345678 here"
    assert all("[REDACTED]" in clean[k]["text"] and clean[k]["n_chars"] == len(clean[k]["text"]) and not secret_scan.base_spans(clean[k]["text"]) for k in range(400))
    assert secret_scan.redact(docs).columns == docs.columns
    assert secret_scan.secret_spans(docs.limit(0)).count() == 0


def test_whole_query_against_brute_force(secrets):
    """Spans and digests of every row, from the patterns as they are written and a field trained on the same windows in one process."""
    from hashlib import sha256

    rows, docs = secrets
    field = secret_scan.train(docs)
    for x in secret_scan.secret_spans(docs).collect():
        text = next(t for i, t, _ in rows if i == x["doc_id"]) or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base = sorted(base + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert x["base_sha256"] == sha256(shown.encode()).hexdigest()
        at = [(m.end() - len(m[0].lstrip()), m.end()) for m in re.finditer(r"\s?(?:\w+|[^\w\s])", text)]
        more = [(at[i][0], 3, at[j][1]) for i, j in field.tagged([text])[0]] if text else []
        more = [(a, k, b) for a, k, b in more if any(c.isalnum() for c in text[a:b]) and all(b <= s or e <= a for s, _, e in base)]
        assert x["spans"] == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more))


def test_long_texts_without_blanks_are_scanned_in_time():
    import time

    field = secret_scan.Field(np.zeros((secret_scan.BUCKETS, 3), np.float32), secret_scan._legal() - np.eye(3)[1] * 5, frozenset())
    began = time.perf_counter()
    for text in ("a" * 10**6, "-" * 10**6, "ab-" * 330_000, "password" * 120_000):
        secret_scan.batch_spans([text], field)
    assert time.perf_counter() - began < 20


def test_training_raises_the_tags_it_was_given():
    r = np.random.default_rng(2)
    sample = []
    for _ in range(200):
        n = int(r.integers(1, 5))
        tags = np.array([1, *r.integers(0, 2, n - 1) * 2], np.uint8) if r.random() < 0.5 else np.zeros(n, np.uint8)
        for k in range(1, n):
            tags[k] = 2 if tags[k] and tags[k - 1] else 0
        x = np.tile(np.arange(secret_scan.FEATURES) * 7, (n, 1)) + tags[:, None]
        sample.append((x, tags, 1.0))
    weights, moves = secret_scan.train_field(sample)
    assert all(secret_scan.viterbi(weights[x].sum(axis=1).astype(float), moves) == y.tolist() for x, y, _ in sample)
    assert secret_scan.train_field([(sample[0][0], np.zeros(len(sample[0][1]), np.uint8), 1.0)]) is None


# --- licences ---


def test_license_scan(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", f"hello\n{mit}\nbye"), (2, "a/b/x.txt", "plain text"), (3, "a/b/c/y.py", "released UNDER the mit license"),
        (4, "a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (5, "a/b/c/d/z", "text"),
        (6, "top.txt", "text"), (7, None, "text"), (8, "a/q", None), (9, "e/f", ""), (10, "e/g", "the license of this and that and the other and many more words that are no notice at all"),
        (2, "a/b/x.txt", "plain text"),
    ]
    files = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, path string, text string, license string")
    got = {x["doc_id"]: (x["license"], x["basis"], x["from_dir"]) for x in license_scan.license_scan(files).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "directory", "a"), 3: ("MIT", "own", None), 4: ("GPL-3.0", "own", None), 5: ("GPL-3.0", "directory", "a/b/c"),
        6: (None, "none", None), 7: (None, "none", None), 8: ("MIT", "directory", "a"), 9: (None, "none", None), 10: (None, "none", None),
    }
    assert license_scan.license_scan(files).count() == len(rows)
    assert license_scan.license_scan(files.limit(0)).count() == 0
    root = spark.createDataFrame([(1, "LICENSE", mit), (2, "x/y/z", "t")], "doc_id long, path string, text string")
    assert {x["doc_id"]: x["from_dir"] for x in license_scan.license_scan(root).collect()} == {1: None, 2: ""}


def test_prefilter_loses_nothing():
    """No unit without a heavy term reaches the limit: checked over the templates' own terms."""
    r = random.Random(3)
    having = {w: r.randrange(0, 900) for _, t in license_scan.TEMPLATES for w in license_scan._terms(t)}
    weights = license_scan.Weights(license_scan.TEMPLATES, 1000, having, license_scan.LIMIT)
    for (_, text), (_, of) in zip(license_scan.TEMPLATES, weights.rows):
        c = Counter(w for w in license_scan._terms(text) if w not in weights.heavy)
        norm = np.sqrt(sum((n * weights.idf[w]) ** 2 for w, n in c.items()))
        assert not c or sum(n * weights.idf[w] * of[w] for w, n in c.items()) / norm < license_scan.LIMIT


def test_wrapped_headers_and_licence_texts(spark):
    """Notices as files hold them: wrapped, in comments, with names of holders; and whole licence texts."""
    import textwrap

    t = license_scan
    comment = lambda x, mark, width=60: "\n".join(f"{mark} {line}".rstrip() for p in x.split("\n") for line in (textwrap.wrap(p, width) or [""]))
    holder = "Copyright (c) 2021, Some Body.\nAll rights reserved."
    bsd2, bsd3 = (f"{t._BSD_INTRO}\n{x}\n{t._BSD_END}" for x in (t._BSD_TWO, f"{t._BSD_TWO}\n{t._BSD_THIRD}"))
    spaced = lambda x: x.replace("\n", "\n\n")
    cases = [
        ("src/a.c", "/*\n" + comment(f"{holder}\n\n{t._gnu(t._GPL, '3', True)}\n\n{t._GNU_END.format(t._GPL, t._GPL)}", " *") + "\n */\nint x;", "GPL-3.0"),
        ("src/b.py", comment(f"{t._gnu(t._LGPL, '2.1', True)}\n\n{t._GNU_END.format(t._LGPL, t._LGPL)}", "#", 70) + "\nimport this\n", "LGPL-2.1"),
        ("src/c.js", comment(f"{t._MIT_GRANT}\n\n{t._MIT_REST}", "//", 72) + "\nvar a;", "MIT"),
        ("src/d.go", comment(f"{holder}\n{bsd3}", "//", 50) + "\npackage d", "BSD-3-Clause"),
        ("src/e.java", "/**\n" + comment(f"{t._APACHE}\n\n{t._APACHE_END}", " *", 76) + "\n */", "Apache-2.0"),
        ("src/f.h", comment(holder, "//") + "\nvoid f();", "Proprietary"),
        ("src/g.rs", comment("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "//", 66), "MPL-2.0"),
        ("m/LICENSE", f"MIT License\n\n{holder}\n\n{textwrap.fill(t._MIT_GRANT, 78)}\n\n{t._MIT_REST}", "MIT"),
        ("b/LICENSE.txt", f"{holder}\n\n{spaced(bsd3)}", "BSD-3-Clause"),
        ("c/LICENSE", f"{holder}\n\n{spaced(bsd2)}", "BSD-2-Clause"),
        ("i/COPYING", f"ISC License\n\nCopyright 2020 A\n\n{t._ISC}\n\n{t._ISC_END}", "ISC"),
        ("g/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n\n" + "Preamble words of some length. " * 50, "GPL-2.0"),
        ("h/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE\n", "Apache-2.0"),
        ("n/x.txt", "The licence of a driver and the rights of others are reserved for a chapter of their own, as is the public.", None),
    ]
    r = random.Random(2)
    rows = [(k, path, text) for k, (path, text, _) in enumerate(cases)] + [(100 + k, f"p/{k}", f"the of and to in a is for this that with {' '.join(words(r, 30))}") for k in range(60)]
    got = {x["doc_id"]: x["license"] for x in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).where("basis <> 'directory'").collect()}
    assert [got[k] for k in range(len(cases))] == [name for *_, name in cases]
    assert all(got[k] is None for k in got if k >= 100)
