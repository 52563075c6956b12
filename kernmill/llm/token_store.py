"""A store of token ids: Parquet list columns, read back selectively.

write() deals the documents by ranges of doc_id, encodes each with the
tokenizers library, appends an end id and writes the files in ascending doc_id
order: dictionary-encoded lists of ids, row groups and pages of a set size, page
indexes (the writer's default).  With them stand doc_id, the file's number, the
document's place in the file and its length, so that offsets over the whole
store are read from three small columns and not from the ids.

The ids of a text are those of its pieces between ASCII white space, which this
tokenizer drops and no merge, normalisation or pre-token crosses; strings of special
tokens are taken out before, as the library does by default.  Each worker caches
pieces and the pre-tokens that they consist of; those of a chunk of documents that
are not in the cache are encoded by the library, Latin ones as one text that is told
apart by the vocabulary's mark for the end of a word.

Defined results: a null or empty text has the end id alone; equal doc_ids stand
in the order of their texts; a null doc_id comes first; an empty table gives an
empty store.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, texts, with_text
from .token_counts import DOUBTFUL as NOT_LATIN
from .token_counts import load, special_pattern, specials

#: A worker keeps so many pieces and pre-tokens; beyond that it forgets the later half. Longer ones are never kept.
CACHE, LONG = 700_000, 64
#: The published pre-token pattern over lower-case ASCII and Latin-1 letters.
PRE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: White space to every library.
SPACES = re.compile("[ \t\n\v\f\r]+")
STORED = "doc_id long, part int, place long, n_tokens long, ids array<int>"
ROW_GROUP, PAGE, DICTIONARY = 32 << 20, 1 << 20, 1 << 20


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers; one for each worker."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer, plain = load(path), special_pattern(path)
        self.special = re.compile(f"({plain.pattern})") if plain else None
        self.cache: dict[str, bytes] = {"": b""}  # what stands before and after white space
        vocabulary = self.tokenizer.get_vocab()
        self.reserved = {s: self._ids([self.tokenizer.token_to_id(s)]) for s in specials(path)}
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def encode(self, group: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache = dict(islice(self.cache.items(), CACHE // 2))
        out, latin, other, parted = [b""] * len(group), [], [], []
        for k, text in enumerate(group):
            if self.special and self.special.search(text):
                parted.append(k)
            elif NOT_LATIN.search(text):
                other.append((k, text))
            else:
                latin.append((k, text.lower()))
        for some, learn in ((latin, self._learn), (other, self._learn_whole)):
            if some:
                for (k, _), ids in zip(some, self._joined([text for _, text in some], learn), strict=True):
                    out[k] = ids
        for k in parted:  # special tokens stand as themselves between the other stretches
            parts = self.special.split(group[k])
            parts[::2] = self.encode(parts[::2])
            out[k] = b"".join(self.reserved[p] if m % 2 else p for m, p in enumerate(parts))
        return out

    def _joined(self, group: list[str], learn: Callable[[list[str]], list[str]]) -> list[bytes]:
        """Texts are split and their pieces numbered outside of Python; each different one is looked up once."""
        pieces = pa.compute.ascii_split_whitespace(pa.array(group, pa.large_string()))
        own = pieces.values.dictionary_encode()
        names = own.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, names))
        missing = [k for k, ids in enumerate(found) if ids is None]
        long = learn([names[k] for k in missing])
        for k in missing:
            found[k] = self.cache[names[k]]
        for p in long:
            self.cache.pop(p, None)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, row = np.frombuffer(b"".join(found), "<u4"), own.indices.to_numpy()
        n = size[row]
        ends = np.concatenate(([0], np.cumsum(n)))
        data = flat[np.repeat((np.cumsum(size) - size)[row] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (ends[pieces.offsets.to_numpy()] * 4).tolist()
        return [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def _learn_whole(self, unknown: list[str]) -> list[str]:
        """Pieces as the library has them. Returns what is too long to keep."""
        if unknown:
            self.cache.update(zip(unknown, (self._ids(e.ids) for e in self.tokenizer.encode_batch_fast(unknown, add_special_tokens=False)), strict=True))
        return [p for p in unknown if len(p) > LONG]

    def _learn(self, pieces: list[str]) -> list[str]:
        """A piece of letters alone is one pre-token; others are put together from theirs. Returns what is too long to keep."""
        cache = self.cache
        split = [(p, PRE_TOKEN.findall(p)) for p in pieces if not p.isalpha()]
        words = {p for p in pieces if p.isalpha()}
        words.update(w for _, own in split for w in own if w not in cache)
        words = list(words)
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some):
                raise ValueError("a pre-token without an end")
            data, edges = ids.tobytes(), [0, *ends.tolist()]
            cache.update(zip(some, map(data.__getitem__, map(slice, edges, edges[1:])), strict=True))
        for p, own in split:
            cache[p] = b"".join(map(cache.__getitem__, own))
        longest = max(map(len, pieces), default=0)  # no pre-token is longer than its piece
        return [p for p in chain(pieces, words) if len(p) > LONG] if longest > LONG else []

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None) -> None:
    """Writes the store to `path`. files: the number of ranges; none: as many as shuffle partitions."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = Encoder.of(tokenizer), 0
        for b in chunks(batches, most=1 << 20):
            stored = [x + end for x in encoder.encode(texts(b.column(1)))]
            n = np.array([len(x) // 4 for x in stored], np.int64)
            ids = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(stored))])
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(places), pa.array(n), pa.ListArray.from_arrays(offsets, ids)], ["doc_id", "part", "place", "n_tokens", "ids"])

    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_text(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    out = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, STORED)
    (
        out.write.option("compression", "zstd")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.dictionary.page.size", DICTIONARY)
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with `start`, the ids of all documents before. Only
    a file's lengths are summed: one row for each file goes to the window."""
    stored = spark.read.schema(STORED).parquet(path)
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return stored.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("place"))


#: Ids digested at a time, or those of one document.
SLICE_IDS = 1 << 20


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = np.cumsum(batch.column(2).to_numpy()) // SLICE_IDS
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for b in (batch.slice(x, y - x) for x, y in zip(edges, edges[1:], strict=False) if y > x):
            ids = b.column(3)
            offsets = ids.offsets.to_numpy().astype(np.int64)
            data = memoryview(ids.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            cuts = ((offsets - offsets[0]) * 4).tolist()
            crc = [zlib.crc32(data[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read() returns."""
    return stored.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
