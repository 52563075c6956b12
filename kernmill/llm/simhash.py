"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two that differ in at most four
bits differ in at most four bytes, so the guaranteed minimum of shared positional
bytes is 8 - 4 = 4.  Lists of single bytes would each hold a 256th of all
documents; the index is therefore kept by triples of positions, over a system of
20 triples of which any four positions hold at least one.  A pair that reaches
the minimum thus meets in some list; there its shared positional bytes are
tallied, pairs below four are let go, and the rest are verified by the number of
differing bits.

Lists hold distinct fingerprints, so exact copies cost one entry.  Within a list
only a spanning star of each linked set is kept: short lists are compared by
offsets, all at once; a long one is flooded, each reached fingerprint being
compared with those not yet reached, which is linear for a tight group; one of
strangers is split by a fourth position, which a pair that reaches the minimum
shares, too, and the very longest are dealt over tasks so.  Links meet in connected components by alternating large-star and small-star steps,
each written to the shared folder, where the one before it is deleted.

Defined results: a null or empty text has fingerprint zero, linked like any
other; documents with a null doc_id are fingerprinted and linked, and a
component of these alone has a null id; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, forget, texts, with_text, written

BITS = 4
SHINGLE = 4
#: Lists of up to so many fingerprints are compared by offsets; longer ones than LONG are split.
SHORT, LONG = 48, 1024


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(len(words) - size + 1)]


def fingerprints(group: list[str]) -> np.ndarray:
    """uint64 for each text: bit i is set if it is in over half the hashes."""
    hashes = [shingle_hashes(t) for t in group]
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(group), np.uint64)
    some = np.flatnonzero(n)
    if not some.size:
        return out
    flat = np.array([x for h in hashes for x in h], np.uint64)
    ends = np.cumsum(n[some])
    tally = np.zeros((some.size, 64), np.int64)
    step = 1 << 18  # hashes unpacked at a time
    for begin in range(0, flat.size, step):
        part = flat[begin : begin + step]
        own = np.searchsorted(ends, np.arange(begin, begin + part.size), side="right")
        first, starts = np.unique(own, return_index=True)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        tally[first] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    bits = tally * 2 > n[some, None]
    out[some] = np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, most=1 << 20):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts(b.column(1))).view(np.int64))], ["doc_id", "fp"])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    return with_text(docs).mapInArrow(_fingerprint, "doc_id long, fp long")


# ----------------------------------------------------------------------- index
def triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions, of which any four positions hold one: with
    the positions in three parts, those inside a part and those with two in a
    part and one in the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for p in parts for t in combinations(p, 3)]
    for k, p in enumerate(parts):
        out += [tuple(sorted((*two, one))) for two in combinations(p, 2) for one in parts[(k + 1) % 3]]
    return sorted(out)


TRIPLES = triples()
POSTED = "fp long, key long"


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        for k, (x, y, z) in enumerate(TRIPLES):
            u = fp.view(np.uint64)
            byte = [(u >> np.uint64(8 * p)) & np.uint64(255) for p in (x, y, z)]
            key = (np.uint64(k) << np.uint64(24)) | (byte[0] << np.uint64(16)) | (byte[1] << np.uint64(8)) | byte[2]
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(key.astype(np.int64))], ["fp", "key"])


def linked(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which pairs share at least 8 - bits positional bytes and, of those, differ in at most so many bits."""
    apart = a ^ b
    shared = (apart.reshape(-1, 1).view(np.uint8) == 0).sum(axis=1)
    reached = np.flatnonzero(shared >= 8 - bits)
    out = np.zeros(apart.size, bool)
    out[reached] = np.bitwise_count(apart[reached]) <= bits
    return out


class Forest:
    """Union-find over fingerprints; stars() gives (fingerprint, smallest of its set)."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up)]


def flood(list_: np.ndarray, forest: Forest, bits: int = BITS) -> None:
    """Joins all that are linked in one list of distinct fingerprints."""
    left = list_
    while left.size > 1:
        seed, left = left[0], left[1:]
        front = [seed]
        while front and left.size:
            x = front.pop()
            near = linked(left, np.full(1, x), bits)
            if near.any():
                reached = left[near]
                left = left[~near]
                for y in reached.tolist():
                    forest.join(int(seed), y)
                front += list(reached)


def split(list_: np.ndarray, positions: list[int], forest: Forest, bits: int = BITS) -> None:
    """As flood(), for a long list of a triple: tight groups are taken out by floods
    from every LONG-th, and the rest meets again by each further position, of which
    what is linked shares one at least."""
    left = list_
    for seed in list_[::LONG]:
        near = linked(left, np.full(1, seed), bits)
        if near.sum() * 64 < left.size:
            continue  # a stranger stays, and so do its links
        front, left = list(left[near]), left[~near]
        for y in front:
            forest.join(int(seed), int(y))
        while front and left.size:
            near = linked(left, np.full(1, front.pop()), bits)
            if near.any():
                reached, left = left[near], left[~near]
                for y in reached.tolist():
                    forest.join(int(seed), y)
                front += list(reached)
    for p in positions:
        byte = (left >> np.uint64(8 * p)) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        for part in np.split(left[order], np.flatnonzero(np.diff(byte[order])) + 1):
            flood(part, forest, bits)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the links of each list as stars."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last list, which may go on in the next batch

    def work(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch | None:
        forest = Forest()
        edges = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate(([0], edges))
        sizes = np.diff(np.append(starts, key.size))
        for k in np.flatnonzero(sizes > SHORT).tolist():
            own = fp[starts[k] : starts[k] + sizes[k]].view(np.uint64)
            if len(own) > LONG and key[starts[k]] < FOURTH:
                triple = TRIPLES[int(key[starts[k]]) >> 24]
                split(own, [q for q in range(8) if q not in triple], forest)
            else:
                flood(own, forest)
        short = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
        f, q = fp[short].view(np.uint64), key[short]
        for k in range(1, SHORT):
            same = np.flatnonzero(q[k:] == q[:-k]) if k < q.size else ()
            if not len(same):
                break
            hit = same[linked(f[same], f[same + k])]
            for a, b in zip(f[hit].tolist(), f[hit + k].tolist(), strict=True):
                forest.join(a, b)
        if stars := forest.stars():
            pairs = np.array(stars, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])
        return None

    def flush() -> pa.RecordBatch | None:
        out = work(np.concatenate([f for f, _ in held]), np.concatenate([k for _, k in held])) if held else None
        held.clear()
        return out

    for b in batches:
        fp, key = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not key.size:
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1][1][-1] != key[0]):
            held.append((fp[:last], key[:last])) if last else None
            if out := flush():
                yield out
        held.append((fp[last:], key[last:]))
    if out := flush():
        yield out


#: Lists of about so many fingerprints are dealt by a fourth position over tasks, found by a sample of a SEEN-th.
LIST, SEEN = 1 << 16, 64
#: Keys of such lists that are broadcast; more are joined by a shuffle.
MOST_HOT = 1 << 20
#: Keys from here on are of four positions.
FOURTH = 1 << 40


def dealt(posted: DataFrame, sample: DataFrame) -> DataFrame:
    """posted (fp, key) with the lists that are long, by the posted fingerprints of a
    sample, dealt by a fourth position: what is linked shares one of those left. The
    sample decides where lists are compared and never which links are found."""
    hot = cut(sample.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") * SEEN >= LIST).select("key", F.lit(True).alias("_hot")))
    hot = F.broadcast(hot) if hot.count() <= MOST_HOT else hot.hint("merge")
    free = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in t]) for t in TRIPLES])
    left = F.element_at(free, F.shiftright("key", 24).cast("int") + 1)
    byte = lambda p: F.call_function("shiftright", F.col("fp"), p * 8).bitwiseAND(F.lit(255))
    four = F.transform(left, lambda p: F.lit(FOURTH).bitwiseOR(F.shiftleft("key", 11)).bitwiseOR((p * 256).cast("long")).bitwiseOR(byte(p)))
    both = posted.join(hot, "key", "left")
    return both.select("fp", F.explode(F.when(F.col("_hot"), four).otherwise(F.array("key"))).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep their components whole. fps: a column fp of distinct values."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = fps.select("fp").mapInArrow(_post, POSTED)
    sample = fps.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(SEEN)) == 0).mapInArrow(_post, POSTED)
    return dealt(posted, sample).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long").distinct()


# ------------------------------------------------------------------ components
#: A key's rows are spread over so many tasks where they meet the one row of its minimum.
SALTS = 16


def _spread(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with `one`, which has a row for each key: the rows of a hot
    key are split by a hash of another column, and its one row goes to each part."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = one.withColumn("_s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(copies.hint("merge"), [key, "_s"]).drop("_s")  # copies grow with the input: never broadcast


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not its component's smallest, and that smallest.
    edges: (a, b) in any order.  Minima are pre-aggregated and joined back by
    salted keys, so a hub's neighbours are spread over tasks."""
    now, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = _spread(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        before, (now, path) = path, written(small, "links")
        forget(edges.sparkSession, before)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return now
        seen = state


#: A fingerprint of more than a HOT-th of all documents is hot; there are fewer than HOT.
HOT = 1024


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    that chains of links reach."""
    own = cut(fingerprinted(docs))
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    stars = components(links(first))
    labelled = first.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = _spread(labelled, least, "root", "fp").select("fp", "component_id")
    # the documents of a hot fingerprint are spread, its one row goes to each part
    total = own.count()
    hot = [r["fp"] for r in first.where(F.col("n") * HOT > total).select("fp").collect()]
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    there = by_fp.select("fp", "component_id", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_s"))
    here = own.withColumn("_s", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    return here.join(there, ["fp", "_s"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, one row of each group: that with the
    smallest doc_id. Rows that share a doc_id are one document, of which one
    stays; rows with a null doc_id take no part and stay."""
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id")
    return docs.where("doc_id is not null").join(kept.distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
