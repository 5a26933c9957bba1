"""Packing, token counts, token files and pieces against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from octavo.llm import direct_codes, packing, piece_tokens, token_counts, token_files
from octavo.llm.word_tokens import word_tokens

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, part string, ids string"
ODD = ["", None, "it's 'RE ÀÉ×÷ don't<|endoftext|> a_b 3.5\t\n x", "ß ŉ İ ſt", "日本 é́", "Ω ς ΣΑΣ", "a\x0bb\x1cc\x85d", "  ", "word " * 3000, "x" * 5000, "a\x00b 🙂", "a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|> <|endoftext"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    words = ["the", "Tion", "ere,", "éreau.", "ñ", "42", "(x)", "naïve"]
    made = [" ".join(r.choice(words) for _ in range(r.randrange(0, 900))) for _ in range(60)]
    # repeated rows, a null id, and columns whose names the operators use themselves
    rows = [(k, t, "p", "i") for k, t in enumerate(ODD + made)] + [(5, made[0], "p", "i"), (5, made[0], "p", "i"), (None, "lost id", "p", "i")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def expected(docs):
    library = Tokenizer.from_file(WORDS)
    return [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]


def test_words_are_the_librarys(expected, docs):
    tokens = word_tokens(WORDS)
    assert tokens.simple
    for r, (_, ids) in zip(docs.collect(), expected):
        assert np.frombuffer(tokens.encode(r["text"]), "<u4").tolist() == ids


def test_packing(docs, expected):
    pieces = packing.pack(docs, WORDS, 64, 1)
    got = pieces.collect()
    at = {}
    for p in got:
        assert 0 <= p["offset"] and p["offset"] + p["length"] <= 64 and p["length"] > 0 and len(p["ids"]) == 4 * p["length"]
        at[p["sequence_id"] * 64 + p["offset"]] = p
    whole, place, docs_of = [], 0, []
    while place in at:
        p = at.pop(place)
        if p["start"] == 0:
            docs_of.append((p["doc_id"], []))
        assert docs_of[-1][0] == p["doc_id"] and len(docs_of[-1][1]) == p["start"]
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        docs_of[-1][1].extend(ids)
        whole += ids
        place += p["length"]
    assert not at
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(docs_of, key=key) == sorted([(d, [*ids, 1]) for d, ids in expected], key=key)
    seqs = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert [s["length"] for s in seqs[:-1]] == [64] * (len(seqs) - 1)
    assert np.frombuffer(b"".join(bytes(s["ids"]) for s in seqs), "<u4").tolist() == whole
    assert seqs[0]["boundaries"][0]["offset"] == 0
    crc = {r["ids_crc32"] for r in packing.piece_digests(pieces).collect()}
    assert crc == {zlib.crc32(bytes(p["ids"])) for p in got}


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_length_histogram(spark, docs, expected):
    lengths = [len(ids) for _, ids in expected]
    limits = spark.createDataFrame([(7,), (10**6,)], "n_tokens long")
    got = {r["n_tokens"]: r for r in token_counts.length_histogram(token_counts.encoded_lengths(docs, WORDS), limits).collect()}
    assert set(got) == set(lengths) | {7, 10**6}
    for limit, r in got.items():
        assert r["n_docs"] == lengths.count(limit) and r["docs_longer"] == sum(n > limit for n in lengths)
        assert r["truncated_total"] == sum(min(n, limit) for n in lengths) and r["tokens_up_to"] == sum(n for n in lengths if n <= limit)
        assert (r["docs_up_to"], r["total_docs"], r["total_tokens"]) == (sum(n <= limit for n in lengths), len(lengths), sum(lengths))
    assert token_counts.length_histogram(token_counts.encoded_lengths(docs.limit(0), WORDS)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_direct_codes(seed):
    r = np.random.default_rng(seed)
    n = [0, 1, 511, 512, 3000, 20_000][seed]
    ids = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 33, n, dtype=np.uint64)).astype(np.uint32)
    file = direct_codes.TokenFile(direct_codes.to_bytes([7, None], [n // 3, n - n // 3], ids))
    assert len(file) == n and file.all().tolist() == ids.tolist()
    places = r.integers(0, n, 500) if n else np.zeros(0, int)
    assert file.get(places).tolist() == ids[places].tolist()
    assert file.document(0).tolist() == ids[: n // 3].tolist() and file.document(1).tolist() == ids[n // 3 :].tolist()
    for a, b in zip(*np.sort(r.integers(0, n + 1, (2, 200)), axis=0)):
        assert file.range(int(a), int(b)).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        file.get([n])


def test_token_files(spark, docs, expected):
    manifest = token_files.write_tokens(docs, WORDS)
    got = token_files.read_tokens(manifest).collect()
    order = sorted(range(len(got)), key=lambda k: got[k]["start"])
    start = 0
    for k in order:
        assert got[k]["start"] == start
        start += got[k]["n_tokens"]
    ids = [got[k]["doc_id"] for k in order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    crc = lambda x: zlib.crc32(np.array([*x, 1], "<u4").tobytes())
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([(g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got], key=key) == sorted([(d, len(x) + 1, crc(x)) for d, x in expected], key=key)
    total = manifest.agg(F.sum("n_tokens"), F.sum("n_docs")).first()
    assert total[:] == (sum(len(x) + 1 for _, x in expected), len(expected))
    empty = token_files.write_tokens(docs.limit(0), WORDS)
    assert empty.count() == 0 and token_files.read_tokens(empty).count() == 0


def test_added_tokens_have_their_ids():
    for text, ids in (("a <|endoftext|> b", [320, 49407, 321]), ("a<|ENDOFTEXT|>b", Tokenizer.from_file(WORDS).encode("a<|ENDOFTEXT|>b", add_special_tokens=False).ids)):
        assert np.frombuffer(word_tokens(WORDS).encode(text), "<u4").tolist() == ids


def test_small_files(docs, expected, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 500)
    got = token_files.read_tokens(token_files.write_tokens(docs, WORDS)).agg(F.sum("n_tokens"), F.count("*")).first()
    assert got[0] == sum(len(x) + 1 for _, x in expected)


def test_pieces_are_the_librarys(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_tokens.encode_pieces(docs, PIECES).collect()
    by = {}
    for r in docs.collect():
        ids = sp.encode(r["text"] or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        by.setdefault(r["doc_id"], set()).add((len(ids), sha, sp.decode(ids)))
    for g in got:
        assert (g["n_tokens"], g["ids_sha256"], g["decoded"]) in by[g["doc_id"]]
        assert g["decoded_sha256"] == hashlib.sha256(g["decoded"].encode()).hexdigest() and len(g["ids"]) == 4 * g["n_tokens"]
    assert len(got) == docs.count()


def test_merges_of_random_texts():
    sp, mine, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_tokens.piece_tokens(PIECES), random.Random(4)
    parts = ["th", "he", "ing", "  ", "er", "//", "----", "==", " ", "a", "0", "\n", "▁", "é", "日", "🙂", "​", "x" * 9, "abab"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 60))) for _ in range(800)]
    for text, (ids, shown) in zip(texts, mine.encode_batch(texts)):
        want = sp.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want and shown == ",".join(map(str, want))
        assert mine.decode_batch([ids]) == [sp.decode(want)]
    some = [[r.randrange(3, 32000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randrange(0, 12))] for _ in range(300)]
    assert mine.decode_batch([np.array(x, "<u4").tobytes() for x in some]) == [sp.decode(x) for x in some]


@pytest.mark.parametrize("of", ["abcdefghijklmnopqrstuvwxyz", "the=-/ ", "a", "日本é0\n", "enrst"])
def test_long_words_are_the_librarys(of, monkeypatch):
    sp, mine, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_tokens.PieceTokens(PIECES), random.Random(9)
    for n in (127, 128, 129, 130, 3000, 20_000):
        text = "".join(r.choice(of) for _ in range(n))
        assert np.frombuffer(mine.encode_batch([text])[0][0], "<u4").tolist() == sp.encode(text)
    # both ways of merging agree on every word
    words = ["".join(r.choice(of) for _ in range(r.randrange(1, 60))).replace(" ", piece_tokens.SPACE) for _ in range(200)]
    assert [mine.merge_long(w).tolist() for w in words] == [x.tolist() for x in mine.merge(words)]


def test_a_megabyte_without_spaces():
    import time

    sp, mine, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_tokens.PieceTokens(PIECES), random.Random(9)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(10**6))
    began = time.perf_counter()
    got = mine.encode_batch([text])[0][0]
    assert time.perf_counter() - began < 60 and np.frombuffer(got, "<u4").tolist() == sp.encode(text)


def test_memory_can_run_full(monkeypatch):
    monkeypatch.setattr(piece_tokens, "MEMORY_WORDS", 3)
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_tokens.PieceTokens(PIECES)
    for text in ("one two three four five six", "one seven eight two", "nine ten"):
        assert np.frombuffer(mine.encode_batch([text])[0][0], "<u4").tolist() == sp.encode(text)


def test_rounds_look_up_only_pairs_that_changed(monkeypatch):
    sp, mine, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_tokens.PieceTokens(PIECES), random.Random(7)
    words = ["".join(r.choice(["th", "er", "ion", "an", "st", "x"]) for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    looked, rank = [], mine._rank
    monkeypatch.setattr(mine, "_rank", lambda a, b: looked.append(len(a)) or rank(a, b))
    got = mine.merge([piece_tokens.SPACE + w for w in words])
    assert [x.tolist() for x in got] == [sp.encode(w) for w in words]
    symbols, merges = sum(len(w) + 1 for w in words), sum(len(w) + 1 - len(x) for w, x in zip(words, got))
    assert sum(looked) <= symbols + 2 * merges


def test_pairs_are_found_in_their_table():
    mine = piece_tokens.PieceTokens(PIECES)
    a, b = (mine.keys >> 32).astype(np.int32), (mine.keys & 0xFFFFFFFF).astype(np.int32)
    assert mine._rank(a, b).tolist() == mine.ranks.tolist()
    r, odd = np.random.default_rng(3), np.array([-1, -11, 0, 1 << 20], np.int32)
    a, b = np.concatenate([r.choice(a, 50_000), odd, odd]), np.concatenate([r.choice(b, 50_000), odd[::-1], odd])
    assert mine._rank(a, b).tolist() == [mine.rank_of.get((x << 32) + y if min(x, y) >= 0 else None, piece_tokens.NONE) for x, y in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize("bound", ["MEMORY_WORDS", "MEMORY_BYTES"])
def test_words_in_use_outlast_a_full_memory(bound, monkeypatch):
    monkeypatch.setattr(piece_tokens, bound, 60 if bound == "MEMORY_WORDS" else 60 * 13, raising=False)
    mine, merged = piece_tokens.PieceTokens(PIECES), []
    symbols_of = mine._symbols_of
    monkeypatch.setattr(mine, "_symbols_of", lambda text: merged.append(text) or symbols_of(text))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for k in range(40):
        text = " ".join(["again", *(f"w{k}x{j}" for j in range(20))])
        assert np.frombuffer(mine.encode_batch([text])[0][0], "<u4").tolist() == sp.encode(text)
        assert len(mine.memory) <= 61
    assert "".join(merged).count("again") == 1
