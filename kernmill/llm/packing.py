"""Best-fit packing under conflicts.

Documents are cut into pieces of the bins' capacity; full pieces fill bins of
their own, and the rest are packed best-fit decreasing.  The open bins of a block
stand ordered by residual capacity.  Each carries a bitmap of the sources and a
bitmap of the duplicate clusters in it.  A piece looks up the first bin that it
fits and goes on through its successors until it finds a compatible one, which is
then the tightest; it opens a bin only if there is none.

A bin is compatible if the piece's duplicate cluster is not in it, and no source
is in it that conflicts with the piece's.  Pairs of sources that conflict are a
parameter (a source may conflict with itself).

Blocks bound a task: the caller gives their number, or a column that deals the
documents, and each is packed by itself.  Repeated rows are counted first and told
apart by a copy's number, so that they too are dealt over all blocks.  Texts are not
moved: only lengths, clusters and sources are.

Defined results: a null or empty text is one piece of length zero, which goes to
the tightest compatible bin; ties go by doc_id; repeated rows are copies of each
other and never share a bin; a null source conflicts with none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 16384
#: Documents of a block, about: what one task packs at a time.
BLOCK_DOCS = 2048
#: Sources that may not share a bin.
CONFLICTS = (("src1", "src2"), ("src3", "src4"), ("src0", "src5"))
PACKED = "doc_id long, piece int, start long, length long, bin long, place int"


def duplicate_cluster(text: str = "text") -> Column:
    """Texts that are equal but for case and white space share a cluster."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")))


def best_fit(items: list[tuple[int, int, int, int]], capacity: int) -> list[int]:
    """The bin of each item (length, cluster bit, source bit, conflict mask; 0:
    none); items come longest first."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    clusters: list[int] = []
    sources: list[int] = []
    out = []
    for length, cluster, source, against in items:
        k = bisect_left(order, (length, -1))
        while k < len(order):
            b = order[k][1]
            if not (clusters[b] & cluster or sources[b] & against):
                break
            k += 1
        if k < len(order):
            residual, b = order.pop(k)
        else:
            residual, b = capacity, len(clusters)
            clusters.append(0)
            sources.append(0)
        clusters[b] |= cluster
        sources[b] |= source
        insort(order, (residual - length, b))
        out.append(b)
    return out


def pack_block(doc_ids: list, lengths: list[int], cluster: list, source: list, capacity: int, conflicts: Iterable[tuple[str, str]]) -> list[tuple]:
    """(doc_id, piece, start, length, bin, place) of a block's documents."""
    bits = {s: 1 << k for k, s in enumerate(sorted({s for pair in conflicts for s in pair}))}
    against = dict.fromkeys(bits, 0)
    for a, b in conflicts:
        against[a] |= bits[b]
        against[b] |= bits[a]
    many = [c for c, n in Counter(cluster).items() if n > 1]  # only these can meet
    cluster_bit = {c: 1 << k for k, c in enumerate(many)}
    pieces, bins = [], 0
    rows: list[tuple] = []
    for i, n in enumerate(lengths):
        full = n // capacity
        for p in range(full):
            rows.append((doc_ids[i], p, p * capacity, capacity, bins, 0))
            bins += 1
        if n % capacity or not n:
            pieces.append((n - full * capacity, i, full))
    pieces.sort(key=lambda x: (-x[0], doc_ids[x[1]] is not None, doc_ids[x[1]] or 0, cluster[x[1]], source[x[1]] or ""))
    found = best_fit([(n, cluster_bit.get(cluster[i], 0), bits.get(source[i], 0), against.get(source[i], 0)) for n, i, _ in pieces], capacity)
    place: Counter = Counter()
    for (n, i, p), b in zip(pieces, found, strict=True):
        rows.append((doc_ids[i], p, p * capacity, n, bins + b, place[b]))
        place[b] += 1
    return rows


#: Copies of a row that one array holds.
COPIES = 1 << 16


def dealt(items: DataFrame, blocks: int) -> DataFrame:
    """items with block. Repeated rows are counted, map-side first, and each copy is dealt by its number."""
    each = items.groupBy("doc_id", "length", "cluster", "source").agg(F.count("*").alias("_n"))
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))).alias("_g"))
    each = each.select("*", F.explode(F.sequence(F.col("_g") * COPIES, F.least(F.col("_n"), (F.col("_g") + 1) * COPIES) - 1)).alias("_copy"))
    return each.select("doc_id", "length", "cluster", "source", F.pmod(F.xxhash64("doc_id", "cluster", "_copy", F.lit("block")), F.lit(blocks)).alias("block"))


def pack(items: DataFrame, blocks: int | None = None, capacity: int = CAPACITY, conflicts: Iterable[tuple[str, str]] = CONFLICTS) -> DataFrame:
    """items: doc_id, length, cluster, source and, unless a number of blocks is
    given, block (long). Returns a row for each piece; a bin's number holds its
    block's in the upper bits."""
    conflicts = tuple(conflicts)
    if blocks is not None:
        items = dealt(items, blocks)

    def block(key: tuple, part: pa.Table) -> pa.Table:
        columns = [part.column(c).to_pylist() for c in ("doc_id", "length", "cluster", "source")]
        rows = pack_block(*columns, capacity, conflicts)
        base = key[0].as_py() << 32
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        cols[4] = [base + b for b in cols[4]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "bin", "place"])

    return items.select("block", "doc_id", "length", "cluster", "source").groupBy("block").applyInArrow(block, PACKED)


def blocks_of(items: DataFrame, block_docs: int = BLOCK_DOCS) -> int:
    """So many blocks that each holds about block_docs documents."""
    return max(1, -(-items.count() // block_docs))


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, length (UTF-8 bytes) and cluster of documents, and the columns in more."""
    length = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", length.alias("length"), duplicate_cluster().alias("cluster"), *more)
