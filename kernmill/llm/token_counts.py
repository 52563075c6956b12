"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, FREQUENT at
most, so that it can be broadcast.  A pass over all documents finds them: each task
counts its own pre-tokens in a summary of SUMMARY entries and reports its FREQUENT
most frequent, if they occur twice at least.  The table changes no count, only how
many are found in it.  Tier two is a cache in
each worker for the pre-tokens that miss; those of a chunk of documents that are in
neither are encoded in one batch.  No pre-token of a document is shuffled, only the
tasks' summaries are added up, and a document's count is the sum over its
pre-tokens.

The pre-token pattern runs in Python over stretches whose characters are ASCII or
Latin-1 letters, for which its classes are spelled out and don't depend on a
Unicode version.  Other stretches are split by the library's own pre-tokenizer and
looked up in the same tiers.  Stretches end where white space follows something
else, which no pre-token spans.  Special tokens' strings are taken out before, as
the library does by default.

Defined results: a null or empty text has no tokens; repeated rows each get
their own row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, quiet_tokenizers, texts, with_text

#: Entries of tier one, and of a task's report; and of its summary.
FREQUENT, SUMMARY = 65536, 4 * 65536
#: A worker forgets its cache of misses when it holds so many; longer pre-tokens are never kept.
CACHE, LONG = 400_000, 64
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACE = " \t\n\v\f\r"
#: Characters whose class may depend on a Unicode version, or that are white space to one library only.
DOUBTFUL = re.compile("[^\t-\r -\x7eÀ-ÿ]")
#: The published pattern of the byte-level pre-tokenizer, its classes cut down to the other characters.
PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space after what is white space to no library.
CUT = re.compile(rf"(?<=[^\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff])(?=[{_SPACE}])")


def load(path: str):
    quiet_tokenizers()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials(path: str) -> list[str]:
    """The strings that the library takes out of a text before all else."""
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def special_pattern(path: str) -> re.Pattern | None:
    """Any of those strings, the longest first; only plain ones are known here."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
        raise ValueError("special tokens that take in what stands beside them")
    return re.compile("|".join(sorted((re.escape(x["content"]) for x in added), key=lambda p: (-len(p), p)))) if added else None


class Splitter:
    """Pre-tokens of texts, as the library's tokenizer of a file sees them."""

    def __init__(self, path: str):
        self.tokenizer, self.special = load(path), special_pattern(path)

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special tokens stand between them."""
        if not self.special or not self.special.search(text):
            return self._plain(text), 0
        parts = self.special.split(text)
        return list(chain.from_iterable(map(self._plain, parts))), len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if not DOUBTFUL.search(text):
            return PRE_TOKEN.findall(text)
        out: list[str] = []
        for doubtful, run in groupby(CUT.split(text), key=lambda x: DOUBTFUL.search(x) is not None):
            own = "".join(run)
            out += [own[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(own)] if doubtful else PRE_TOKEN.findall(own)
        return out


class Summary:
    """Counts of the more frequent of a stream of words, in bounded memory: when
    there are too many words, all counts fall by that of the `most`-th, and words
    without any left are forgotten. What is lost is under a `most`-th of the stream."""

    def __init__(self, most: int):
        self.most, self.seen, self.counts = most, 0, Counter()

    def add(self, words: list[str]) -> None:
        self.seen += len(words)
        self.counts.update(words)
        if len(self.counts) > 2 * self.most:
            least = int(np.partition(np.fromiter(self.counts.values(), np.int64), -self.most)[-self.most])
            self.counts = Counter({w: n - least for w, n in self.counts.items() if n > least})


def frequent_pre_tokens(docs: DataFrame, path: str, most: int = FREQUENT) -> DataFrame:
    """token and n: pre-tokens among the `most` most frequent of some task, and how often tasks report them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, summary = Splitter(path), Summary(SUMMARY)
        for b in chunks(batches, most=1 << 20):
            for text in texts(b.column(1)):
                summary.add([w for w in splitter.split(text)[0] if len(w) <= LONG])
        own = {w: n for w, n in summary.counts.most_common(most) if n > 1}
        yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["token", "n"])

    return with_text(docs).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


#: Steps of a doubling in which counts are told apart.
STEPS = 32


def frequent_table(docs: DataFrame, path: str, most: int = FREQUENT) -> dict[str, int]:
    """Pre-token -> number of tokens, for the most frequent of all documents, `most`
    at most: those at and above the least count, in steps of STEPS to a doubling,
    that no more reach. So no more than these come to the driver."""
    step = F.floor(F.log2("n") * STEPS)
    found = cut(frequent_pre_tokens(docs, path, most)).withColumn("step", step)
    room, least = most, None
    for r in sorted(found.groupBy("step").count().collect(), reverse=True):  # under 64 * STEPS rows
        if r["count"] > room:
            break
        room, least = room - r["count"], r["step"]
    words = [] if least is None else sorted(r["token"] for r in found.where(F.col("step") >= least).select("token").collect())
    return dict(zip(words, lengths_of(load(path), words), strict=True))


def lengths_of(tokenizer, words: list[str]) -> list[int]:
    return list(map(len, tokenizer.encode_batch_fast(words, add_special_tokens=False)))


class Lengths:
    """Counts tokens of texts by the two tiers; one for each worker process and tokenizer."""

    _own: dict[str, Lengths] = {}

    def __init__(self, path: str, frequent: dict[str, int]):
        self.splitter = Splitter(path)
        self.frequent, self.known = frequent, dict(frequent)  # tier one, and both tiers

    @classmethod
    def of(cls, path: str, frequent: dict[str, int]) -> Lengths:
        if path not in cls._own or cls._own[path].frequent is not frequent:
            cls._own[path] = cls(path, frequent)
        return cls._own[path]

    def counts(self, group: list[str]) -> list[int]:
        split = [self.splitter.split(t) for t in group]
        if len(self.known) > len(self.frequent) + CACHE:
            self.known = dict(self.frequent)
        known = self.known
        missing = list(set().union(*(words for words, _ in split)).difference(known)) if split else []
        known.update(zip(missing, lengths_of(self.splitter.tokenizer, missing), strict=True))
        out = [sum(map(known.__getitem__, words)) + special for words, special in split]
        for w in missing:
            if len(w) > LONG:
                del known[w]
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths.of(path, table.value)
        for b in chunks(batches, most=1 << 20):
            group = texts(b.column(1))
            n = lengths.counts(group)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in group], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return with_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
