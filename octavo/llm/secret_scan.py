"""Secret scans: fixed patterns, and a linear-chain conditional random field over all tokens of a text.

Tokens are runs of word characters, or single other characters.  The field tags every token of the whole text
as outside a secret, its begin, or inside it, from the token's shape, the words and signs around it and
features of the text, decoded by Viterbi.  Decoding is exact and near linear: a stretch of tokens that a path could
only lose by tagging (by a bound on scores and transitions, from prefix sums) is outside in the best path, and Viterbi
over what lies between, with outside neighbours, is Viterbi over the text.

The field is trained here on windows of tokens from a sample of documents, bounded by ``SAMPLE_DOCS`` and
``WINDOWS``: windows about the values of the fixed patterns' matches, windows without any, and windows into which a
phrase made by rule is put (``taught``: a random secret of some alphabet, with or without words that announce it, or
something that only looks like one), as a corpus may hold secrets of one form only.  The features never see the
patterns themselves, so the field also tags keys that none of them covers.  Pattern spans always stay; a decoded span
that holds a letter or digit is added where it touches none.

Defined cases: a null or empty text has no spans; repeated rows are scanned alike; without any match in
the sample nothing is added; an empty table gives no rows; other columns are not read (``redact`` keeps them).
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_cutoff, keep, rows_per_batch, take_memory, texts

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Words that announce a secret: to the field they are one and the same neighbour.
CUES = frozenset("password passwd passphrase passcode pwd pass secret token apikey api_key key auth bearer credential credentials private_key access_key secret_key client_secret auth_token access_token".split())

#: Documents read to train, windows and their tokens, words taken as known and least documents of one, hashed features, training steps.
SAMPLE_DOCS, WINDOWS, WINDOW, KNOWN_WORDS, KNOWN_DOCS, BUCKETS, STEPS = 20_000, 1200, 20, 20_000, 3, 1 << 14, 60
#: Tokens remembered by one Python worker, and the longest of them.
MEMORY_TOKENS, MEMORY_CHARS = 300_000, 48
OUT, BEGIN, IN = range(3)
_TOKENS = re.compile(r"\s?(?:\w+|[^\w\s])")
_CHANGES = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]+")
_HEXLIKE = re.compile(r"[0-9a-f]+|[0-9A-F]+")
REDACTED = "[REDACTED]"


def _matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's place in ``KINDS``, end, start of the secret itself) of the patterns' matches that are long enough."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is what a match of one or more, kept when long enough, is
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in ``KINDS``, end) of the patterns' matches that are long enough."""
    return [m[:3] for m in _matches(text)]


def tokens(text: str) -> list[str]:
    """The text's tokens, each with the blank before it, if there is one."""
    return _TOKENS.findall(text)


def token_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the tokens without their blanks."""
    return [(m.end() - len(m[0].lstrip()), m.end()) for m in _TOKENS.finditer(text)]


def _bucket(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS


def file_features(text: str) -> list[int]:
    n = len(text)
    signs = sum(map(text.count, "#*$%&|<>")) * 20 // max(n, 1)
    return [_bucket(f"file-signs={min(signs, 4)}"), _bucket(f"file-size={min(n.bit_length(), 16)}")]


#: Where the neighbours stand that a token's score looks at.
NEAR = (-1, -2, -3, 1)
#: Features of a token: its own, each neighbour's, the file's.
OWN, CONTEXT, FILE = 10, 3, 2
FEATURES = OWN + CONTEXT * len(NEAR) + FILE
EDGE = "\n"


def shape(token: str, known: frozenset[str]) -> tuple:
    """All that features see of a token, in coarse steps, so that many tokens have the same shape; ``EDGE`` stands beyond the text's ends."""
    word = token.lstrip()
    n, blank = len(word), len(word) < len(token)
    if not n:
        return ("edge", "edge", 0, 0, 0, 0, 0, 0, 0, False, blank)
    if not (word.isalnum() or "_" in word):
        return (word, word, 0, 0, 0, n, 1, 1, 0, False, blank)
    low = word[:MEMORY_CHARS].lower()
    if word.isalpha() and (word.islower() or word[1:].islower()):
        upper = int(not word[0].islower())
        digits, lower, runs = 0, n - upper, 1 + upper * (n > 1)
    else:
        found = _CHANGES.findall(word)
        digits = sum(len(r) for r in found if r[0].isdigit())
        upper = sum(len(r) for r in found if r[0].isupper())
        lower = sum(len(r) for r in found if r[0].islower())
        runs = min(len(found), 9)
    status = "cue" if low in CUES else "known" if low in known else "short" if n < 4 else "other"
    hard = 0 if status == "known" else min(max(map(len, _CONSONANTS.findall(low)), default=0), 7)
    kinds = (digits > 0) + 2 * (lower > 0) + 4 * (upper > 0) + 8 * (digits + lower + upper < n)
    hexlike = digits > 0 and bool(_HEXLIKE.fullmatch(word))
    return (low if status == "known" else status, status, kinds, min(n // 2, 16), 10 * digits // n, 10 * len(set(word)) // n, runs, min(n, 4), hard, hexlike, blank)


def shape_features(seen: tuple) -> tuple[list[str], list[str]]:
    """What a token of this shape says of itself, and what it says to its neighbours."""
    says, status, kinds, size, digits, distinct, runs, _, hard, hexlike, blank = seen
    own = [
        f"kinds={kinds}",
        f"size={size}",
        f"kinds,size={kinds},{min(size // 2, 8)}",
        f"digits={digits},{min(size // 2, 4)}",
        f"hexlike={hexlike},{min(size // 2, 6)}",
        f"distinct={distinct},{min(size // 4, 4)}",
        f"runs={runs},{min(size // 2, 6)}",
        f"status={status}",
        f"hard={hard},{kinds & 1}",
        f"blank={blank},{kinds}",
    ]
    return own, [f"says={says}", f"is={status}", f"blank={blank},{kinds if status == 'other' else status}"]


def shape_buckets(seen: tuple) -> tuple[list[int], list[list[int]]]:
    """Buckets of the own features, and of what the token adds to the neighbour that has it at each place of ``NEAR``."""
    own, said = shape_features(seen)
    return [_bucket(x) for x in own], [[_bucket(f"{at}:{x}") for x in said] for at in NEAR]


class Field:
    """Emission weights by bucket, transitions, known words; and the scores of the tokens met so far."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, known: frozenset[str]):
        self.weights, self.moves, self.known = weights, moves, known
        self.clear()

    def __reduce__(self):
        return _field, (zlib.crc32(self.weights.tobytes() + self.moves.tobytes()), self.weights, self.moves, self.known)

    def clear(self) -> None:
        # of each token its shape's row; per row the shape's own scores, then those it gives to each neighbour
        self.place: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((1024, 1 + len(NEAR), 3), np.float32)
        self._row(EDGE)

    def _row(self, token: str) -> int:
        seen = shape(token, self.known)
        at = self.rows.get(seen)
        if at is None:
            self.rows[seen] = at = len(self.rows)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            own, said = shape_buckets(seen)
            self.table[at, 0] = self.weights[own].sum(axis=0)
            self.table[at, 1:] = self.weights[said].sum(axis=1)
        return at

    def places(self, found: list[str]) -> list[int]:
        try:
            return list(map(self.place.__getitem__, found))
        except KeyError:
            pass
        place = self.place
        for t in set(found).difference(place):
            if len(t) <= MEMORY_CHARS:
                place[t] = self._row(t)
        return [place[t] if t in place else self._row(t) for t in found]

    def scores(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the three tags of all tokens of the texts, one after the other with edges between; and where each text begins."""
        if len(self.place) > MEMORY_TOKENS:
            self.clear()
        edges = [0] * len(NEAR)
        ids, starts, sizes = list(edges), [], []
        for text in batch:
            starts.append(len(ids))
            ids += self.places(tokens(text))
            sizes.append(len(ids) - starts[-1])
            ids += edges
        at = np.array(ids, np.int64)
        got = self.table[at, 0].astype(np.float64)
        for k, step in enumerate(NEAR):
            # what the neighbour ``step`` away gives
            if step < 0:
                got[-step:] += self.table[at[:step], 1 + k]
            else:
                got[:-step] += self.table[at[step:], 1 + k]
        if batch:
            whole = self.weights[[file_features(t) for t in batch]].sum(axis=1)
            got[len(edges) :] += np.repeat(whole, np.array(sizes) + len(edges), axis=0)
        got[at == 0] = (0, -1e4, -1e4)
        return got, np.array(starts, np.int64)

    def tagged(self, batch: list[str]) -> list[list[tuple[int, int]]]:
        """Per text the (first, last) tokens of the decoded secrets."""
        out: list[list[tuple[int, int]]] = [[] for _ in batch]
        scores, starts = self.scores(batch)
        m = self.moves
        gain = scores[:, 1:].max(axis=1) - scores[:, OUT] + (m[1:, 1:].max() - m[OUT, OUT])
        enter = max(m[OUT, BEGIN] - m[OUT, OUT], -1e3) - (m[1:, 1:].max() - m[OUT, OUT]) + max(m[BEGIN, OUT], m[IN, OUT]) - m[OUT, OUT]
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        # the most that a stretch through a token can gain
        most = (sums[1:] - np.minimum.accumulate(sums[:-1])) + (np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]) - gain
        maybe = np.flatnonzero(most + enter > -1e-6)
        if not len(maybe):
            return out
        for part in np.split(maybe, np.flatnonzero(np.diff(maybe) > 1) + 1):
            first = None
            tags = viterbi(scores[part], m)
            for k, tag in enumerate([*tags, OUT]):
                if first is not None and tag != IN:
                    text = int(np.searchsorted(starts, part[0] + first, "right")) - 1
                    out[text].append((int(part[0] + first - starts[text]), int(part[0] + k - 1 - starts[text])))
                    first = None
                if tag == BEGIN:
                    first = k
        return out


_met: dict[int, Field] = {}


def _field(key: int, weights: np.ndarray, moves: np.ndarray, known: frozenset[str]) -> Field:
    """One per Python worker and model, so that tokens met by an earlier task are still known."""
    take_memory("field", _met.clear)
    if key not in _met:
        _met.clear()
        _met[key] = Field(weights, moves, known)
    return _met[key]


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of a run between outside neighbours."""
    m = moves.tolist()
    rows = scores.tolist()
    best, back = [m[OUT][t] + rows[0][t] for t in range(3)], []
    for s in rows[1:]:
        came, now = [], []
        for t in range(3):
            a, b, c = best[0] + m[0][t], best[1] + m[1][t], best[2] + m[2][t]
            k = 0 if a >= b and a >= c else 1 if b >= c else 2
            came.append(k)
            now.append((a, b, c)[k] + s[t])
        back.append(came)
        best = now
    last = [best[t] + m[t][OUT] for t in range(3)]
    tag = last.index(max(last))
    tags = [tag]
    for came in reversed(back):
        tags.append(tag := came[tag])
    return tags[::-1]


def labels(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags of the text's tokens: those that overlap the values of the patterns' matches; a full stop at a value's end isn't part of it."""
    return _tags(spans, [(start, end - (text[end - 1] == ".")) for _, _, end, start in _matches(text)])


def _tags(spans: list[tuple[int, int]], values: list[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(len(spans), np.uint8)
    first, last = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    for start, end in values:
        hit = np.flatnonzero((last > start) & (first < end))
        if len(hit) and not tags[hit].any():
            tags[hit] = IN
            tags[hit[0]] = BEGIN
    return tags


_LETTERS, _HEX = string.ascii_letters, string.digits + "abcdef"
#: Alphabets of taught secrets, signs that join their parts, words and signs that announce them.
ALPHABETS = (_HEX, _HEX.upper(), _LETTERS + string.digits, _LETTERS, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits)
JOINS, ASSIGNS = ("", "", "", "-", "_", ".", "/", "+", "!", "@", "$", "%"), (" = ", "=", ": ", ":", " is ", " => ", " ")
ANNOUNCE = sorted(CUES - {"pwd", "bearer", "passphrase", "credentials"})


def taught(r: random.Random, words: list[str]) -> tuple[str, int, int]:
    """A phrase, and from where to where it is a secret (0, 0: nowhere).  Forms kept out, to measure by: the cues left out of ``ANNOUNCE``, and prefixed keys."""
    some = lambda of, n: "".join(r.choice(of) for _ in range(n))
    kind = r.random()
    if kind < 0.45:
        join, of, n = r.choice(JOINS), r.choice(ALPHABETS), r.randrange(2, 5)
        value = join.join(some(of, r.randrange(3, 9)) for _ in range(n)) if join else some(of, r.randrange(8, 48))
        if r.random() < 0.2:
            value = "-".join(w.capitalize() if r.random() < 0.5 else w for w in r.choices(words, k=n + 1))
        value += r.choice(("", "", "", "=", "=="))
        quote = r.choice(("", "", '"', "'"))
        before = r.choice(ANNOUNCE).replace("_", r.choice("_ ")) + r.choice(ASSIGNS) + quote
        if r.random() < 0.3:
            before = before.upper() if r.random() < 0.3 else before.capitalize()
        return before + value + quote, len(before), len(before) + len(value)
    if kind < 0.6:
        value = some(r.choice(ALPHABETS[:4] + ALPHABETS[2:3] * 3), r.randrange(24, 64))
        return value, 0, len(value)
    number = lambda n: some(string.digits, n)
    word = lambda: r.choice(words)
    plain = r.choice((
        f"20{number(2)}-{number(2)}-{number(2)} {number(2)}:{number(2)}", f"+{number(2)} {number(3)} {number(7)}", number(r.randrange(3, 17)), f"{word()}.{word()}@{word()}.com",
        f"https://{word()}.org/{word()}/{word()}?id={number(4)}", f"{r.choice(ANNOUNCE)}: {word()} {word()}", f"the {r.choice(ANNOUNCE)} is {word()}", f"{word()} = {word()}", f"{word()}-{word()}-{word()}",
        f"{word()}_{word()} = {number(3)}", f"{number(3)}.{number(3)}.{number(2)}.{number(1)}", f"{word().upper()} {word().capitalize()}{word().capitalize()}()", f"v{number(1)}.{number(2)}", f"${number(3)}.{number(2)}",
    ))
    return plain, 0, 0


def window_rows(text: str, known: frozenset[str]) -> list[tuple[int, bytes, bytes, int]]:
    """Training windows of a text: about each labelled value (sort 0), one without labels (1) and a taught one (2); (sort, buckets, tags, tokens it stands for)."""
    spans = token_spans(text)
    n = len(spans)
    if not n:
        return []
    tags, found, whole = labels(text, spans), tokens(text), file_features(text)

    def rows(found: list[str], tags: np.ndarray, at: int) -> tuple[bytes, bytes, int]:
        end = min(at + WINDOW, len(found))
        near = {k: shape_buckets(shape(found[k] if 0 <= k < len(found) else EDGE, known)) for k in range(at - 3, end + 1)}
        x = [[*near[k][0], *[f for j, step in enumerate(NEAR) for f in near[k + step][1][j]], *whole] for k in range(at, end)]
        own = tags[at:end].copy()
        if own[0] == IN:
            own[0] = BEGIN
        return np.array(x, np.int16).tobytes(), own.tobytes(), end - at

    out, covered = [], 0
    for b in np.flatnonzero(tags == BEGIN).tolist():
        if b >= covered:
            at = max(covered, b - WINDOW // 3)
            out.append((0, *rows(found, tags, at)))
            covered = at + WINDOW
    r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    at = r.randrange(n)
    if not tags[at : at + WINDOW].any():
        x, y, _ = rows(found, tags, at)
        out.append((1, x, y, n - int((tags != OUT).sum())))
        phrase, start, end = taught(r, [w for w in map(str.strip, found) if w.isalpha()] or ["word"])
        put = spans[r.randrange(at, min(at + WINDOW, n))][0]
        before = text[max(0, put - 200) : put] + r.choice(("", " ", "\n"))
        made = before + phrase + r.choice(" .,\n") + " " + text[put : put + 200]
        spans = token_spans(made)
        tags = _tags(spans, [(len(before) + start, len(before) + end)] if end else [])
        place = sum(1 for a, _ in spans if a < len(before))
        out.append((2, *rows(tokens(made), tags, max(0, min(place, len(spans) - 1) - r.randrange(2, WINDOW // 2)))))
    return out


def _legal() -> np.ndarray:
    """No inside after outside."""
    moves = np.zeros((3, 3))
    moves[OUT, IN] = -1e4
    return moves


def train_field(sample: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Emission weights and transitions of greatest penalised likelihood, by gradient steps of adaptive moments; windows as (buckets, tags, weight)."""
    if not any((y != OUT).any() for _, y, _ in sample):
        return None
    longest = max(len(y) for _, y, _ in sample)
    n, width = len(sample), sample[0][0].shape[1]
    x = np.zeros((n, longest, width), np.int64)
    y, live = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for k, (a, b, _) in enumerate(sample):
        x[k, : len(b)], y[k, : len(b)], live[k, : len(b)] = a, b, True
    weight = np.array([c for _, _, c in sample], np.float64)
    total = weight.sum()
    length = live.sum(axis=1)
    # only the buckets that occur
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(n, longest, width)
    w, moves, legal = np.zeros((len(used), 3)), np.zeros((3, 3)), _legal()
    mean_w, mean_m, sum_w, sum_m = (np.zeros_like(v) for v in (w, moves, w, moves))
    at_tag = np.zeros((n, longest, 3))
    gold_m = np.zeros((3, 3))
    np.add.at(gold_m, (OUT, y[:, 0]), weight)
    for t in range(longest):
        at_tag[np.arange(n), t, y[:, t]] = np.where(live[:, t], weight, 0)
        if t:
            on = live[:, t]
            np.add.at(gold_m, (y[on, t - 1], y[on, t]), weight[on])
    np.add.at(gold_m, (y[np.arange(n), length - 1], OUT), weight)
    moves[OUT, BEGIN] = np.log(max(gold_m[OUT, BEGIN], 1) / total)
    flat = x.ravel()

    def counts(p: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(flat, weights=np.repeat(p[:, :, k].ravel(), width), minlength=len(used)) for k in range(3)], axis=1)

    gold_w = counts(at_tag)

    def lse(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis=axis, keepdims=True)
        return (np.log(np.exp(v - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, STEPS + 1):
        m = moves + legal
        emit = np.zeros((n, longest, 3))
        for k in range(width):
            emit += w[x[:, :, k]]
        fwd = np.zeros((longest, n, 3))
        fwd[0] = m[OUT] + emit[:, 0]
        for t in range(1, longest):
            nxt = lse(fwd[t - 1][:, :, None] + m, 1) + emit[:, t]
            fwd[t] = np.where(live[:, t, None], nxt, fwd[t - 1])
        bwd = np.zeros((longest, n, 3))
        bwd[longest - 1] = m[:, OUT]
        for t in range(longest - 2, -1, -1):
            inside = lse(m + (emit[:, t + 1] + bwd[t + 1])[:, None, :], 2)
            bwd[t] = np.where(live[:, t + 1, None], inside, m[:, OUT])
        z = lse(fwd[longest - 1] + m[:, OUT], 1)
        p = np.where(live[:, :, None], np.exp(fwd + bwd - z[:, None]).transpose(1, 0, 2) * weight[:, None, None], 0)
        want_m = np.zeros((3, 3))
        want_m[OUT] += p[:, 0].sum(axis=0)
        for t in range(1, longest):
            on = live[:, t]
            both = fwd[t - 1][on][:, :, None] + m + (emit[on, t] + bwd[t][on])[:, None, :] - z[on, None, None]
            want_m += (np.exp(both) * weight[on, None, None]).sum(axis=0)
        ends = np.exp(fwd[longest - 1] + m[:, OUT] - z[:, None]) * weight[:, None]
        want_m[:, OUT] += ends.sum(axis=0)
        grad_w, grad_m = (gold_w - counts(p)) / total - RIDGE * w, (gold_m - want_m) / total - RIDGE * moves
        rate = RATE * (1 - step / (STEPS + 1))
        for v, g, mean, power in ((w, grad_w, mean_w, sum_w), (moves, grad_m, mean_m, sum_m)):
            mean += 0.1 * (g - mean)
            power += 0.02 * (g * g - power)
            v += rate * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.98**step)) + 1e-9)
    weights = np.zeros((BUCKETS, 3), np.float32)
    weights[used] = w
    return weights, moves + legal


#: Penalty of large weights, first step size, weight of a window without secrets.
RIDGE, RATE, BARE = 1e-6, 0.3, 10.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field, from at most ``SAMPLE_DOCS`` distinct texts and ``WINDOWS`` windows of each sort, those of the least hashes."""
    rows_per_batch(docs.sparkSession)
    hashed = texts(docs, id_col, text_col).where("text <> ''").select(F.xxhash64("text").alias("h"), "text")
    cutoff = hash_cutoff(hashed.select("h"), SAMPLE_DOCS)
    if cutoff is None:
        return None
    sample = keep(hashed.where(F.col("h") <= cutoff).dropDuplicates(["h"]), "sample")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0)))).alias("word")
    often = sample.select(words).where(f"length(word) <= {MEMORY_CHARS}").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= KNOWN_DOCS)
    known = frozenset(r["word"] for r in often.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).collect())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, k, *r) for h, t in zip(b["h"].to_pylist(), b["text"].to_pylist(), strict=True) for k, r in enumerate(window_rows(t, known))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "k", "sort", "x", "y", "n"])

    windows = keep(sample.mapInArrow(read, "h long, k int, sort int, x binary, y binary, n long"), "windows")
    got = [w for sort in range(3) for w in windows.where(F.col("sort") == sort).orderBy("h", "k").limit(WINDOWS).collect()]
    if not any(r["sort"] == 0 for r in got):
        return None
    model = train_field([(np.frombuffer(r["x"], np.int16).reshape(-1, FEATURES), np.frombuffer(r["y"], np.uint8), BARE if r["sort"] == 1 else 1.0) for r in got])
    return model and Field(*model, known)


def batch_spans(batch: list[str | None], field: Field | None) -> list[list[tuple[int, int, int]]]:
    """Per text the base spans and those the field adds, by start and kind."""
    out = [base_spans(t) if t else [] for t in batch]
    if field is None:
        return out
    live = [k for k, t in enumerate(batch) if t]
    for k, found in zip(live, field.tagged([batch[k] for k in live]), strict=True):
        if not found:
            continue
        at, base, text = token_spans(batch[k]), out[k], batch[k]
        spans = [(at[i][0], 3, at[j][1]) for i, j in found]
        fresh = [(a, c, b) for a, c, b in spans if any(map(str.isalnum, text[a:b])) and not any(s < b and a < e for s, _, e in base)]
        out[k] = sorted(base + fresh)
    return out


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """Per document the numbers of each base kind, the digest of the base spans, all spans, and how many the field added.

    The field learns from ``learn_from``, else from ``docs``.
    """
    field = train(docs if learn_from is None else learn_from, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = batch_spans(b["text"].to_pylist(), field)
            base = [[s for s in f if s[1] < 3] for f in found]
            cols = {"doc_id": b["doc_id"]}
            cols |= {f"n_{kind}": pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k, kind in enumerate(KINDS)}
            cols |= {"base_sha256": pa.array([sha256(show(f).encode()).hexdigest() for f in base], pa.string()), "spans": pa.array([show(f) for f in found], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    rows_per_batch(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    got = texts(docs, id_col, text_col).mapInArrow(scan, schema)
    return got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", learn_from: DataFrame | None = None) -> DataFrame:
    """``docs`` with every span replaced, and ``size_col``, if there, set to the new text's code points; one pass, nothing is joined."""
    field = train(docs if learn_from is None else learn_from, id_col, text_col)
    columns = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.names.index(text_col)
        for b in batches:
            whole = b.column(at).to_pylist()
            cleaned = [redacted(t, spans) if t else t for t, spans in zip(whole, batch_spans(whole, field), strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(cleaned, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns.names)

    rows_per_batch(docs.sparkSession)
    got = docs.mapInArrow(run, columns)
    if size_col in columns.names:
        size = F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(columns[size_col].dataType)
        got = got.withColumn(size_col, size)
    return got
