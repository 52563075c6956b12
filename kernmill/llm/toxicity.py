"""Toxicity by noisy-channel deobfuscation.

A token that may be no plain word (leetspeak, also without any letter; letters set
apart; letters repeated, even once, unless the word is common as it stands) is
a lattice of characters: each sign stands for the letters it may replace, a run
for one or two of its letters, a separator for nothing.  Viterbi decoding finds
the likeliest readings under a trigram character language model whose counts come
from all documents; among the best few a word of the classifier's vocabulary is
preferred.  Characters set apart by white space are one run of any length; a gap in
it stands for nothing or for the end of a word, and all words of the vocabulary in
the run are found.  The restored words are scored by a logistic regression over the
presence of words, trained on labelled documents.

The classifier is fitted on at most TRAIN labelled documents (the smallest of a
seeded hash of the id) that are not held out, copies counting once.  Its vocabulary
are all words whose likelihood ratio passes a test at level ALPHA for as many words
as there are.  The ridge is the one of RIDGES with the least log-loss over FOLDS
folds of those documents.  Labels, language, source and id are never inputs.

Defined results: a null or empty text gets the score of no words; a document
without a label is scored like any other; repeated rows each get their row; with
no labelled documents every score is the prior, 0.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, texts, with_text

TRAIN = 20000
#: Chance that any word that says nothing enters the vocabulary.
ALPHA = 0.05
RIDGES, FOLDS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0), 4
THRESHOLD = 0.3
#: Tokens that a worker keeps, if of at most so many characters; longer ones are restored anew.
CACHE, CACHED_TOKEN = 600_000, 64
#: Shorter words are taken out of a run only where the language model parts it so.
ANYWHERE = 4
BEST = 6
# What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = "._-*~'"
_PARTED = {ord(c): None for c in SEPARATORS if c not in LEET}
EDGES = ".,;:!?\"'()[]{}<>|%*&#$-_/\\=+~`"
#: Two or more single characters, perhaps with punctuation, between white space.
_MARKS = r"[.,;:?\"'()\[\]{}<>]"
_UNIT = rf"(?=\S){_MARKS}*+(?:[^\s.,;:?\"'()\[\]{{}}<>]{_MARKS}*+)?+(?!\S)"
SPACED = re.compile(rf"(?<!\S){_UNIT}(?:\s++{_UNIT})++")
WORD = re.compile(r"[a-zß-öø-ÿ]+")
#: A run of what a lattice can hold.
PIECE = re.compile(rf"[a-zß-öø-ÿ{re.escape(''.join(LEET) + SEPARATORS)}]+")
DOUBLED = re.compile(r"(.)\1")
#: Character classes of the language model: 0 is all that is no letter.
SIZE = 60
_CLASS = np.zeros(256, np.int32)
for _c in range(26):
    _CLASS[97 + _c] = _CLASS[65 + _c] = 1 + _c
for _c in range(0xDF, 0x100):
    if _c != 0xF7:
        _CLASS[_c] = 27 + _c - 0xDF
        if 0xE0 <= _c < 0xFF:
            _CLASS[_c - 32] = _CLASS[_c]


# -------------------------------------------------------------- language model
def trigrams(group: list[str]) -> np.ndarray:
    """Counts of the trigrams of classes, runs of class 0 taken as one."""
    c = _CLASS[np.frombuffer("\n".join(["", *group, ""]).encode("latin-1", "replace"), np.uint8)]
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    return np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3) if c.size > 2 else np.zeros(SIZE**3, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for b in chunks(batches):
        total += trigrams(texts(b.column(1)))
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], ["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b), over the trigrams of all documents; SIZE ** 3 rows at
    most come to the driver."""
    rows = with_text(docs).mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SIZE**3)
    n[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    n = n.reshape(SIZE, SIZE, SIZE)
    pair = n.sum(axis=0) + 1  # backs off to P(c | b), smoothed by one
    low = pair / pair.sum(axis=1, keepdims=True)
    return np.log((n + 4 * low) / (n.sum(axis=2, keepdims=True) + 4)).astype(np.float32)


# ---------------------------------------------------------------------- lattice
def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Segments of alternatives (letters, log-probability of the channel);
    empty if the token is no candidate."""
    out: list[list[tuple[str, float]]] = []
    token = token.translate(_PARTED)  # so that letters repeat across separators, too
    k, n = 0, len(token)
    while k < n:
        c = token[k]
        run = 1
        while k + run < n and token[k + run] == c:
            run += 1
        k += run
        if WORD.match(c):
            out.append([(c, 0.0)] if run == 1 else [(c * 2, 0.0 if run == 2 else -0.7), (c, -2.5 if run == 2 else -0.7)])
        elif c in LEET:
            letters = LEET[c]
            own = [(x * min(run, 2), -1.0 - math.log(len(letters))) for x in letters]
            if run > 1:
                own += [(x, -1.7 - math.log(len(letters))) for x in letters]
            out.append(own + [("", -4.0)] * (c in SEPARATORS))
        else:
            return []
    return out


def _spelt(path: tuple | None) -> str:
    """The letters of a path of links."""
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts)).strip("\0")


def decode(segments: list[list[tuple[str, float]]], logp: np.ndarray, best: int = BEST) -> list[tuple[float, str]]:
    """The likeliest readings, best first: Viterbi with a list of paths for each
    state, a state being the last two classes. Paths are links, so time and
    memory are in proportion to the lattice."""
    states: dict[tuple[int, int], list] = {(0, 0): [(0.0, None)]}
    for alternatives in [*segments, None]:
        after: dict[tuple[int, int], list] = {}
        for (a, b), paths in states.items():
            for letters, channel in alternatives or [("\0", 0.0)]:
                x, y, gain = a, b, channel
                for c in letters:
                    z = int(_CLASS[ord(c)]) if c != "\0" else 0
                    gain += float(logp[x, y, z])
                    x, y = y, z
                after.setdefault((x, y), []).extend((p + gain, (path, letters) if letters else path) for p, path in paths)
        states = {k: sorted(v, key=lambda e: -e[0])[:best] for k, v in after.items()}
    found = sorted(chain.from_iterable(states.values()), key=lambda e: -e[0])[:best]
    return sorted(((p, _spelt(path)) for p, path in found), reverse=True)


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """Segments of a run of single characters, as of lattice(); a space among the
    letters is the end of a word. Signs that are no letters part words."""
    chars = "".join(run.split())
    out: list[list[tuple[str, float]]] = []
    k, n = 0, len(chars)
    while k < n:
        c = chars[k]
        run_ = 1
        while k + run_ < n and chars[k + run_] == c:
            run_ += 1
        k += run_
        if WORD.match(c):
            out.append([(c, 0.0)] if run_ == 1 else [(c * 2, 0.0 if run_ == 2 else -0.7), (f"{c} {c}", 0.0 if run_ == 2 else -0.7), (c, -2.5 if run_ == 2 else -0.7)])
        elif c in LEET:
            own = [(x * m, -1.0 - math.log(len(LEET[c]))) for x in LEET[c] for m in range(1, min(run_, 2) + 1)]
            own += [(f"{x} {x}", -1.0 - math.log(len(LEET[c]))) for x in LEET[c]] if run_ > 1 else []
            out.append(own + [("", -4.0)] * (c in SEPARATORS) + [(" ", -1.0)] * (c in EDGES))
        else:
            out.append([(" ", 0.0), ("", -1.0)] if c in SEPARATORS else [(" ", 0.0)])
    return out


def read_run(segments: list[list[tuple[str, float]]], logp: np.ndarray, best: int = BEST) -> list[list[str]]:
    """The words of the likeliest readings of a run, best first: as decode(), with
    a word's end or nothing in each gap, and paths as links, so that time and
    memory are in proportion to the run."""
    gap = [("", 0.0), (" ", 0.0)]
    states: dict[tuple[int, int], list] = {(0, 0): [(0.0, None)]}
    for k in range(2 * len(segments)):
        alternatives = [("\0", 0.0)] if k == 2 * len(segments) - 1 else gap if k % 2 else segments[k // 2]
        after: dict[tuple[int, int], list] = {}
        for (a, b), paths in states.items():
            for letters, channel in alternatives:
                x, y, gain = a, b, channel
                for c in letters:
                    z = int(_CLASS[ord(c)]) if c not in "\0 " else 0
                    if y or z or c == "\0":  # runs of class 0 are one, as in the counts
                        gain += float(logp[x, y, z])
                        x, y = y, z
                after.setdefault((x, y), []).extend((p + gain, (path, letters)) for p, path in paths)
        states = {s: sorted(v, key=lambda e: -e[0])[:best] for s, v in after.items()}
    return [_spelt(path).split() for _, path in sorted(chain.from_iterable(states.values()), key=lambda e: -e[0])[:best]]


def trie(words: Iterable[str]) -> dict:
    """Nested by letter; the word itself under the empty key."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def spotted(segments: list[list[tuple[str, float]]], root: dict) -> list[tuple[int, int, str]]:
    """(first segment, last segment, word): all words of a trie that some reading
    of a run holds with gaps at both ends and no word's end within."""

    def walk(node: dict | None, letters: str) -> dict | None:
        for c in letters:
            node = node.get(c) if node else None
        return node

    out: dict[tuple[int, int, str], None] = {}
    live: dict[tuple[int, int], dict] = {}
    for k, alternatives in enumerate(segments):
        after: dict[tuple[int, int], dict] = {}
        for letters, _ in alternatives:
            head, *tails = letters.split(" ")
            steps = [(start, walk(node, head), not tails) for (start, _), node in live.items()]
            steps += [(k, walk(root, x), x is tails[-1] if tails else True) for x in (head, *tails) if x]
            for start, node, on in steps:
                if node:
                    if "" in node:
                        out[start, k, node[""]] = None
                    if on:
                        after[start, id(node)] = node
        live = after
    return list(out)


def readable(segments: list[list[tuple[str, float]]], root: dict) -> bool:
    """Whether some reading of a lattice is a word of a trie."""
    live = [root]
    for alternatives in segments:
        after: dict[int, dict] = {}
        for node in live:
            for letters, _ in alternatives:
                to = node
                for c in letters:
                    to = to.get(c) if to else None
                if to:
                    after[id(to)] = to
        if not after:
            return False
        live = list(after.values())
    return any("" in node for node in live)


def plain(token: str) -> bool:
    """Whether a lower-case token without its edges is an undisguised word: letters, none three times in a row."""
    return WORD.fullmatch(token) is not None and not re.search(r"(.)\1\1", token)


@dataclass
class Model:
    """Language model, and the classifier: weights by word, and the bias."""

    logp: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -100.0
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    tree: dict = field(default_factory=dict, repr=False)
    #: Words with a doubled letter that are common as they stand, so that they are no disguise.
    common: frozenset[str] = frozenset()
    ridge: float = 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "tree": {}}

    def known_tree(self) -> dict:
        """The trie of the vocabulary."""
        if not self.tree and self.weights:
            self.tree = trie(self.weights)
        return self.tree

    def restore_run(self, run: str) -> tuple[str, ...]:
        """The words of single characters set apart: with a vocabulary all its
        words of ANYWHERE letters and more, or that are the whole run, but for
        those within longer ones, and shorter ones of a likely reading; without
        one the words of the likeliest reading."""
        segments = spaced_lattice(run)
        if not self.weights:
            return tuple(dict.fromkeys(w for w in read_run(segments, self.logp, 1)[0] if len(w) > 1))
        found = spotted(segments, self.known_tree())
        if not found:
            return ()
        known = dict.fromkeys(w for s, e, w in found if len(w) >= ANYWHERE or (s, e) == (0, len(segments) - 1))
        if any(w not in known for _, _, w in found):
            readings = ([w for w in r if len(w) > 1 and w in self.weights] for r in read_run(segments, self.logp))
            known.update(dict.fromkeys(next(filter(None, readings), [])))
        widest: list[tuple[int, int, str]] = []
        reach = -1
        for s, e, w in sorted(found, key=lambda m: (m[0], -m[1])):
            if e > reach or (widest and (s, e) == widest[-1][:2]):
                widest.append((s, e, w))
                reach = max(reach, e)
        return tuple(w for w in known if any(w == x for _, _, x in widest))

    def likeliest(self, form: str) -> tuple[str, ...]:
        """Of a form that may be no disguise the likeliest reading in the vocabulary, if there is one among the best; without a vocabulary the likeliest of all."""
        segments = lattice(form)
        if not segments or self.weights and not readable(segments, self.known_tree()):
            return ()
        readings = (s for _, s in decode(segments, self.logp) if s in self.weights or not self.weights)
        return tuple(islice(readings, 1))

    def restore(self, token: str) -> tuple[str, ...]:
        """The words of a lower-case token."""
        core = token.strip(EDGES)
        if plain(core):
            form = token.rstrip(EDGES)
            found = [core]
            if DOUBLED.search(core) and core not in self.weights and core not in self.common:
                found += self.likeliest(core)
            if form[0] in LEET and self.weights:
                found += self.likeliest(form)
            return tuple(dict.fromkeys(found))
        if not any(WORD.match(c) for c in token):
            forms = dict.fromkeys(f for f in (core, token.strip(".,;:?\"'")) if len(f) > 1)
            return tuple(dict.fromkeys(w for f in forms for w in self.likeliest(f) if len(w) > 1))
        words = WORD.findall(core)
        found = dict.fromkeys(w for w in words if len(w) > 1)
        for form in dict.fromkeys((core, token.strip(".,;:?\"'"))):
            for piece in PIECE.findall(form):
                if len(piece) > 2 and not plain(piece):
                    found.update(dict.fromkeys(self.likeliest(piece)))
        return tuple(found)

    def words(self, group: list[str], known: bool) -> list[set[str]]:
        """The restored words of texts; known: only those of the vocabulary."""
        if len(self.cache) > CACHE:
            self.cache = dict(islice(self.cache.items(), CACHE // 2))
        cache, weights, out = self.cache, self.weights, []
        for text in group:
            text = text.lower()
            tokens = set(text.split())
            runs = {" ".join(r.split()) for r in SPACED.findall(text)} if weights or not known else set()
            long = {t for t in tokens if len(t) > CACHED_TOKEN}
            tokens -= long
            for t in tokens.difference(cache):
                own = self.restore(t)
                cache[t] = tuple(w for w in own if w in weights) if known else own
            kept = {r for r in runs if len(r) <= CACHED_TOKEN}
            for r in kept.difference(cache):
                cache[r] = self.restore_run(r)
            own = set(chain.from_iterable(map(cache.__getitem__, chain(tokens, kept))))
            for w in chain(chain.from_iterable(map(self.restore, long)), chain.from_iterable(map(self.restore_run, runs - kept))):
                if not known or w in weights:
                    own.add(w)
            out.append(own)
        return out

    def scores(self, group: list[str]) -> list[float]:
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, self.bias + math.fsum(map(self.weights.__getitem__, sorted(own))))))) for own in self.words(group, known=True)]


# --------------------------------------------------------------------- training
def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string")), F.lit(4)) == 2, F.lit(False))


class Incidence:
    """Which words (columns) are in which documents (rows), as index pairs."""

    def __init__(self, rows: list[list[int]], size: int):
        self.rows, self.size = len(rows), size
        self.at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter(chain.from_iterable(rows), np.int64, len(self.at))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.col], minlength=self.rows)

    def sums(self, p: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=p[self.at], minlength=self.size)


def logistic(rows: list[list[int]], y: np.ndarray, size: int, ridge: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias over present words, by Newton steps whose systems are
    solved by conjugate gradients; the bias is not shrunk."""
    x, w, b = Incidence(rows, size), np.zeros(size), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def loss(w: np.ndarray, b: float) -> float:
        z = x.times(w) + b
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + ridge / 2 * (w @ w))

    now = loss(w, b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -500, 500)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.append(x.sums(p - y) + ridge * w, (p - y).sum())
        if np.abs(g).max() < 1e-8 * max(1, len(y)):
            break
        scale = 1 / np.append(x.sums(v) + ridge, v.sum())  # the diagonal, as preconditioner
        step, rest = np.zeros(size + 1), -g
        z = scale * rest
        d, gain = z.copy(), rest @ z
        for _ in range(200):
            t = v * (x.times(d[:-1]) + d[-1])
            hd = np.append(x.sums(t) + ridge * d[:-1], t.sum())
            a = gain / (d @ hd)
            step, rest = step + a * d, rest - a * hd
            z = scale * rest
            gain, before = rest @ z, gain
            if gain <= 1e-16 * (g @ (scale * g)):
                break
            d = z + gain / before * d
        size_ = 1.0
        while size_ > 1e-6 and (after := loss(w + size_ * step[:-1], b + size_ * step[-1])) > now:
            size_ /= 2
        if size_ <= 1e-6:
            break
        w, b, now = w + size_ * step[:-1], b + size_ * step[-1], after
    return w, float(b)


def best_ridge(rows: list[list[int]], y: np.ndarray, size: int, fold: np.ndarray) -> tuple[float, dict[float, float]]:
    """The ridge with the least log-loss over the folds, the larger of equals; and the losses."""
    loss = {}
    for ridge in RIDGES:
        total = 0.0
        for k in np.unique(fold):
            there = np.flatnonzero(fold != k)
            if 0 < y[there].sum() < len(there):
                w, b = logistic([rows[i] for i in there], y[there], size, ridge)
                z = np.array([w[rows[i]].sum() + b for i in np.flatnonzero(fold == k)])
                total += float(np.logaddexp(0, np.where(y[fold == k] > 0, -z, z)).sum())
        loss[ridge] = total / len(y)
    return min(RIDGES, key=lambda r: (loss[r], -r)), loss


def train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    model = Model(language_model(docs))
    chosen = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.md5(F.concat(F.lit("train:"), F.col("doc_id"))), "doc_id").limit(TRAIN)
    known = spark.sparkContext.broadcast(model)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, most=1 << 20):
            group = texts(b.column(1))
            own = known.value.words(group, known=False)
            key = [int.from_bytes(hashlib.md5(" ".join(t.lower().split()).encode()).digest()[:8], "big", signed=True) for t in group]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(key), pa.array([sorted(w) for w in own], pa.list_(pa.string()))], ["toxic", "key", "words"])

    labelled = with_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # TRAIN rows of two numbers
    each = labelled.mapInArrow(words, "toxic int, key long, words array<string>")
    own = cut(each.groupBy("key").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words")))  # copies count once
    total = own.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    if not t or t == n:
        model.bias = 100.0 if n and t == n else -100.0
        return model
    found = own.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("d")).where("d > 1")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    a, d = F.col("a").cast("double"), F.col("d").cast("double")
    ratio = 2 * (part(a, d * t / n) + part(d - a, d * (n - t) / n) + part(t - a, (n - d) * t / n) + part(n - d - t + a, (n - d) * (n - t) / n))
    tested = found.count()
    least = 2 * math.log(max(tested, 1) / ALPHA)  # exp(-g / 2) bounds the chance of a ratio of g
    rows = found.withColumn("g", ratio).where(F.col("g") >= least).orderBy(F.desc("g"), "word").collect()  # words of TRAIN documents
    index = {r["word"]: k for k, r in enumerate(rows)}
    if not index:
        model.bias = math.log(t / (n - t))
        return model
    vocabulary = spark.sparkContext.broadcast(index)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted(vocabulary.value[w] for w in x if w in vocabulary.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "key", "at"])

    data = own.select("toxic", "key", "words").mapInArrow(present, "toxic int, key long, at array<int>").toArrow()  # of the bounded sample
    order = sorted(zip(data.column("key").to_pylist(), data.column("at").to_pylist(), data.column("toxic").to_pylist(), strict=True))
    at, y = [x for _, x, _ in order], np.array([v for _, _, v in order], float)
    model.ridge, _ = best_ridge(at, y, len(index), np.array([k % FOLDS for k, _, _ in order]))
    w, model.bias = logistic(at, y, len(index), model.ridge)
    model.weights = {word: float(w[k]) for word, k in index.items()}
    root = model.known_tree()
    doubled = found.select("word").where(F.col("word").rlike(DOUBLED.pattern)).toLocalIterator()  # of at most TRAIN documents, each word in two or more
    model.common = frozenset(r["word"] for r in doubled if plain(r["word"]) and r["word"] not in index and readable(lattice(r["word"]), root))
    return model


# -------------------------------------------------------------------- operators
def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(shared.value.scores(texts(b.column(1))), pa.float64())], ["doc_id", "held_out", "score"])

    out = with_text(docs, held_out().alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of the documents that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text=at, most=1 << 20):
            good = pa.array([s < THRESHOLD for s in shared.value.scores(texts(b.column(at)))], pa.bool_())
            yield b.filter(good)

    return docs.mapInArrow(keep, docs.schema)
