"""Operators over whole tables: mixing, packing, near duplicates, neighbours, url rules, the pipeline."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from kernmill.llm import ann, mixing, packing, pii, simhash, toxicity, url_filter
from kernmill.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import EDGE, SF


def sql(query, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df)
    return c.sql(query).df()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].astype(object).where(x[columns].notna(), "-").astype(str) for x in (a, b))
    assert sorted(map(tuple, a.values.tolist())) == sorted(map(tuple, b.values.tolist()))


# ----------------------------------------------------------------------- mixing
def earliest_deadline_first(quotas):
    """One cycle, slot by slot."""
    total, served, out = sum(quotas), [0] * len(quotas), []
    for t in range(total):
        ready = [(-(-(served[i] + 1) * total // q), i) for i, q in enumerate(quotas) if served[i] < q and served[i] * total // q <= t]
        i = min(ready)[1]
        out.append(i)
        served[i] += 1
    return out


def test_mix_equals_sql(spark, edge, none):
    for docs in (edge, none, spark.read.parquet(f"{SF}/documents.parquet")):
        got = mixing.mixed(docs.select("doc_id", "source")).select("doc_id", "source", "stream", "block", "place", "slot").toPandas()
        want = sql(mixing.oracle(), documents=docs.select("doc_id", "source").toPandas().astype({"doc_id": "Int64"}))
        same(got.astype({"doc_id": "Int64"}), want)


def test_mix_stays_within_a_block(spark):
    quotas, other = {"a": 5, "b": 2}, 3
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("z").alias("source"))
    out = mixing.mixed(docs, quotas, other, block=4).toPandas()
    by_slot = out.drop_duplicates("slot").sort_values("slot")
    assert by_slot.slot.tolist() == list(range(750)) and out.groupby("slot").size().eq(4).all()
    share = np.array([3, 5, 2]) / 10
    seen = np.zeros(3)
    for t, s in enumerate(by_slot.stream.tolist()[:500], 1):  # until the first stream runs out
        seen[s] += 1
        assert np.abs(seen - share * t).max() < 1
    assert by_slot.stream.tolist()[:10] == earliest_deadline_first([3, 5, 2])


def test_mix_spreads_rows_without_an_id(spark):
    docs = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.col("id").cast("string").alias("text"))
    out = mixing.mixed(docs, {"a": 5}).toPandas()
    assert out.text.nunique() == 9000 and not out.duplicated(["slot", "place"]).any()
    plan = mixing.mixed(docs, {"a": 5})
    assert plan.exceptAll(mixing.mixed(docs.repartition(7), {"a": 5})).count() == 0


def test_mix_keeps_columns_and_repeats(clashing):
    out = mixing.mixed(clashing)
    assert out.count() == len(EDGE) and "_row" in out.columns and out.select("slot", "place").distinct().count() == len(EDGE)


# ---------------------------------------------------------------------- packing
def naive_best_fit(items, capacity):
    bins, out = [], []
    for length, cluster, source, against in items:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= length and not (b[1] & cluster or b[2] & against)]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([capacity, 0, 0])
        bins[k][0] -= length
        bins[k][1] |= cluster
        bins[k][2] |= source
        out.append(k)
    return out


def test_best_fit_equals_a_full_search():
    rnd = random.Random(5)
    for _ in range(200):
        items = sorted(((rnd.randint(0, 60), 1 << rnd.randint(0, 6) if rnd.random() < 0.5 else 0, 1 << (s := rnd.randint(0, 2)), 1 << ((s + 1) % 3) if rnd.random() < 0.5 else 0) for _ in range(40)), key=lambda x: -x[0])
        assert packing.best_fit(items, 100) == naive_best_fit(items, 100)


def test_packing_keeps_its_rules(spark, edge, none, clashing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = packing.measured(docs)
    out = packing.pack(items, blocks=packing.blocks_of(items, 300)).join(items.select("doc_id", "source", "cluster"), "doc_id").toPandas()
    length = items.toPandas().set_index("doc_id").length
    assert (out.groupby("doc_id").length.sum() == length.reindex(out.doc_id.unique()).sort_index()).all()
    against = {frozenset(p) for p in packing.CONFLICTS}
    for _, b in out.groupby("bin"):
        assert b.length.sum() <= packing.CAPACITY
        assert b.cluster.is_unique
        assert not any(frozenset(p) in against for p in combinations(set(b.source), 2))
    assert packing.pack(packing.measured(none), blocks=packing.blocks_of(packing.measured(none))).count() == 0
    for odd in (edge, clashing):
        rows = packing.pack(packing.measured(odd), blocks=1).toPandas()
        assert len(rows) == len(EDGE) - 1 + -(-200_000 * 6 // 5 // packing.CAPACITY)
        assert rows[rows.doc_id == 1].bin.nunique() == 2  # copies keep apart


def test_packed_blocks_equal_a_full_search(spark):
    """The bins of whole blocks, against a plain best fit over each block's rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = packing.dealt(packing.measured(docs), 3).toPandas()
    out = packing.pack(packing.measured(docs), blocks=3).toPandas().set_index(["doc_id", "piece"])
    names = sorted({s for pair in packing.CONFLICTS for s in pair})
    bit = {s: 1 << k for k, s in enumerate(names)}
    against = {s: sum(bit[b if a == s else a] for a, b in packing.CONFLICTS if s in (a, b)) for s in names}
    for block, part in items.groupby("block"):
        shared = {c: 1 << k for k, c in enumerate(part.cluster[part.cluster.duplicated()].unique())}
        rows = [(n % packing.CAPACITY, i, n // packing.CAPACITY, c, s) for i, n, c, s in zip(part.doc_id, part.length, part.cluster, part.source, strict=True) if n % packing.CAPACITY or not n]
        rows.sort(key=lambda r: (-r[0], r[1]))
        want = naive_best_fit([(n, shared.get(c, 0), bit.get(s, 0), against.get(s, 0)) for n, _, _, c, s in rows], packing.CAPACITY)
        full = int((part.length // packing.CAPACITY).sum())
        got = [out.loc[(i, p)].bin - (block << 32) - full for _, i, p, _, _ in rows]
        assert got == want


def test_packing_deals_many_copies(spark):
    """A third of all rows are one row."""
    rows = spark.range(60_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("x").alias("source"), F.lit("some text").alias("text"))
    items = packing.measured(rows.withColumn("text", F.concat("text", F.col("doc_id").cast("string"))))
    blocks = packing.blocks_of(items)
    sizes = packing.dealt(items, blocks).groupBy("block").count().toPandas()["count"]
    assert sizes.sum() == 60_000 and sizes.max() < 1.2 * packing.BLOCK_DOCS
    out = packing.pack(items, blocks=blocks).toPandas()
    assert len(out) == 60_000 and not out[out.doc_id == 7].bin.duplicated().any()


def test_packing_of_one_hot_cluster():
    rows = packing.pack_block(list(range(500)), [10] * 500, [7] * 400 + list(range(1000, 1100)), ["s"] * 500, 100, ())
    bins = defaultdict(list)
    for doc, _, _, n, b, _ in rows:
        bins[b].append((doc, n))
    assert len(bins) == 400 and all(sum(d < 400 for d, _ in x) <= 1 for x in bins.values())


# -------------------------------------------------------------- near duplicates
def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(ids, fps, bits=4):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(ids)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            up[root(a)] = root(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return [low.get(root(k)) for k in range(len(ids))]


def test_triples_cover():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_fingerprints_equal_the_definition():
    texts = [t or "" for _, t, *_ in EDGE] + ["A b\tC\x0bd e", "one", "two words", "\x1c \x85 x"]
    assert simhash.fingerprints(texts).tolist() == [slow_fingerprint(t) for t in texts]


def test_links_lose_none(spark, monkeypatch):
    """Chains, tight groups and strangers; short and long lists."""
    rng = np.random.default_rng(2)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        x = int(rng.integers(0, 2**63))
        for _ in range(40):
            fps.add(x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False).tolist():
                x ^= 1 << b
    centre = int(rng.integers(0, 2**63))
    fps |= {centre ^ sum(1 << b for b in c) for c in combinations(range(20), 2)}
    fps = sorted(fps)
    want = slow_components(fps, fps)
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    for short, long, list_ in ((48, 1024, 1 << 16), (3, 1024, 1 << 16), (3, 5, 1 << 16), (48, 1024, 2)):
        monkeypatch.setattr(simhash, "LIST", list_)
        monkeypatch.setattr(simhash, "SEEN", 1 if list_ == 2 else 64)  # all lists of two and more, in the last case
        monkeypatch.setattr(simhash, "SHORT", short)
        monkeypatch.setattr(simhash, "LONG", long)
        stars = {r["a"]: r["b"] for r in simhash.components(simhash.links(df)).collect()}
        groups = defaultdict(set)
        for f in fps:
            s = int(np.array([f], np.uint64).view(np.int64)[0])
            groups[stars.get(s, s)].add(f)
        expected = defaultdict(set)
        for f, w in zip(fps, want, strict=True):
            expected[w].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_lists_lose_no_link(monkeypatch):
    """Lists of one triple, of strangers, chains and a tight group, against all pairs."""
    monkeypatch.setattr(simhash, "LONG", 32)
    rng = np.random.default_rng(8)
    for _ in range(5):
        fps = {int(x) & ~0xFFFFFF for x in rng.integers(0, 2**63, 300)}
        for x in list(fps)[:60]:
            for b in rng.choice(range(24, 64), 3, replace=False).tolist():
                fps.add(x := x ^ (1 << b))
        centre = int(rng.integers(0, 2**63)) & ~0xFFFFFF
        fps |= {centre ^ (1 << a) ^ (1 << b) for a, b in combinations(range(24, 40), 2)}
        fps = sorted(fps)
        forest = simhash.Forest()
        simhash.split(rng.permutation(np.array(fps, np.uint64)), [3, 4, 5, 6, 7], forest)
        want = slow_components(fps, fps)
        assert [forest.root(f) for f in fps] == want


def test_strangers_in_one_list_take_less_than_all_pairs():
    import time

    rng = np.random.default_rng(9)
    strangers = np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64) & ~np.uint64(0xFFFFFF))
    began = time.perf_counter()
    simhash.split(strangers, [3, 4, 5, 6, 7], simhash.Forest())
    assert time.perf_counter() - began < 60


def test_components_of_a_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1400)]
    got = {r["a"]: r["b"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 1000 for k in range(1001, 1400)}


def test_near_duplicates(spark, edge, none, clashing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(edge.where("doc_id is null"))
    got = simhash.near_duplicates(docs).toPandas()
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    want = Counter((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, slow_components([r["doc_id"] for r in rows], fps), strict=True))
    clean = lambda x: None if pd.isna(x) else int(x)
    assert Counter((clean(a), b, clean(c)) for a, b, c in got[["doc_id", "fingerprint", "component_id"]].values.tolist()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicated(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 6, 7, 8, 9]  # 2 is a copy of 1; 4 and 5 have no words, like 3


# ------------------------------------------------------------------- neighbours
def exact_neighbours(ids, x, k, every):
    out = []
    for i in sorted(i for i in ids if i % every == 0):
        s = x @ x[ids.index(i)]
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
        out += [(i, r, j, -v) for r, (v, j) in enumerate(order, 1)]
    return out


def test_neighbours_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = e.toPandas()
    want = exact_neighbours(t.vec_id.tolist(), np.stack(t.embedding).astype(float), 20, 20)
    got = ann.search(e).toPandas()
    assert len(got) == len(want)
    found = set(zip(got.query_id, got.vec_id, strict=True))
    assert sum((q, v) in found for q, _, v, _ in want) / len(want) >= 0.9


def test_neighbours_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), i) for i in range(100)] + [(i, [1.0, 0.0, 0.0, 0.0], 0) for i in range(100, 220)] + [(20, None, 1), (320, [0.0] * 4, 1), (340, [1.0, None, 0.0, 0.0], 1), (360, [1.0, float("nan"), 0.0, 0.0], 1), (380, [1.0, 2.0], 1), (None, [1.0] * 4, 1), (400, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key long").repartition(3)
    good = [(i, v) for i, v, _ in rows[:220]]
    want = exact_neighbours([i for i, _ in good], np.array([v for _, v in good]), 20, 20)
    got = sorted(tuple(r) for r in ann.search(df, target=1.0).select("query_id", "rank", "vec_id", "score").collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert ann.search(df.limit(0)).count() == 0
    few = ann.search(df.where("vec_id in (40, 41, 42)")).toPandas()
    assert few["rank"].tolist() == [1, 2]
    alone = ann.search(df.where("vec_id = 40"))
    assert alone.count() == 0


def test_ties_of_distinct_vectors_go_to_the_smaller_id(spark):
    """Hundreds of different vectors with one inner product, in several leaves."""
    rng = np.random.default_rng(6)
    ids = rng.permutation(np.arange(2, 1001)).tolist()
    rows = [(i, [1.0, *(rng.integers(-8, 9, 3) / 4).tolist()]) for i in ids] + [(1, [0.5, 0.0, 0.0, 0.25]), (0, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = exact_neighbours([i for i, _ in rows], np.array([v for _, v in rows]), 20, 1000)
    got = sorted(tuple(r) for r in ann.search(df, every=1000, target=1.0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want and [g[2] for g in got[:20]] == list(range(2, 22))


def test_neighbours_recall_with_pruning(spark):
    """Clustered vectors in many leaves, of which a query visits a few."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 20_000)] + 0.3 * rng.normal(size=(20_000, 24))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    tree = ann.fitted(ann.entries(ann.valid_vectors(df, "vec_id", "embedding"), 20, 200), "<f4", 20, ann.TARGET)
    assert tree.leaves >= 30 and tree.visits < tree.leaves / 2
    got = ann.search(df, every=200).toPandas()
    wide = x.astype(float)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = wide @ wide[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & set(own.vec_id.tolist()))
        assert own.sort_values("rank").score.is_monotonic_decreasing and len(own) == 20
    assert got.query_id.nunique() == 100 and hits / 2000 >= 0.9


def test_parts_hold_neighbouring_leaves():
    assert ann.parts_of({0: 3, 1: 4, 2: 5, 3: 25, 4: 1, 5: 10}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 1), 3: (2, 3), 4: (5, 1), 5: (6, 1)}


def test_tree_visits_grow_with_the_target():
    x = np.random.default_rng(0).normal(size=(2000, 16))
    tree = ann.Tree(x, 64)
    visits = []
    for target in (0.5, 0.9, 1.0):
        tree.calibrate(x, 10, target)
        visits.append(tree.visits)
    assert visits == sorted(visits) and visits[0] < visits[-1] <= tree.leaves
    assert sorted(tree.walk(x[0], tree.leaves)) == list(range(tree.leaves))


# -------------------------------------------------------------------- url rules
URLS = [None, "", "x", "://", "http://", "HTTP://EXAMPLE.COM/en/x", "https://www.example.com/en/", "https://sub.www.example.com/en/a", "http://a.net/es/", "http://net/fr/x", "http://xnet/fr/", "http://spam-a.net/es", "http://a.com?x/en/", "ftp://h.org/incoming/", "http://casino-a.org/responsible-gaming/", "http://b.org/cgi-bin/a.exe?x", "http://a.org/x\ny/ads/banner", "http://é.É.org/Ä", "http://a.com/" + "y" * 50_000, "http://a.net://b.com/en/"]


def test_url_rules_equal_sql(spark):
    own = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    for pages in (own, own.limit(0), spark.read.parquet(f"{SF}/pages.parquet")):
        got = url_filter.judged(pages).toPandas()
        same(got, sql(url_filter.oracle(), pages=pages.select("page_id", "url").toPandas().astype({"url": "string"})))


def test_rules_with_capitals_and_of_a_file(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("! comment\n\n||bad-*^\n@@||bad-but-fine.*^\n")
    patterns = url_filter.read_list(spark, str(path))
    assert patterns == [("block", "||bad-*^"), ("allow", "||bad-but-fine.*^")]
    hosts = [("block", "x.com", "/En/")]
    index = url_filter.Index(url_filter.rules(hosts, patterns), {"x": 5, "com": 1000})
    verdicts = [index.judge(u)[3] for u in ("http://x.com/En/a", "http://x.com/en/a", "http://bad-a.org", "http://bad-but-fine.org", "http://worse.org")]
    assert verdicts == ["block", "allow", "block", "allow", "allow"]
    pages = spark.createDataFrame([(None, "http://x.com/En/"), (1, None)], "page_id long, url string")
    got = url_filter.judged(pages, url_filter.rules(hosts, patterns)).select("page_id", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "allow"), (None, "block")]


def test_candidates_come_by_the_rarest_token():
    rules = url_filter.rules()
    index = url_filter.Index(rules, {"com": 100, "example": 10, "en": 50, "www": 5, "net": 90, "es": 3, "fr": 4})
    assert {r.name for r, _ in index.by_token["example"]} == {"example.com/en/"}
    assert {r.name for r, _ in index.by_token["www"]} == {"www.example.com/en/"}
    every = url_filter.Index(rules, {})
    every.always = [x for v in every.by_token.values() for x in v] + every.always
    every.by_token.clear()
    for u in URLS:
        assert index.judge(u) == every.judge(u)


# ---------------------------------------------------------------------- queries
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, name):
    out = QUERIES[name](spark, SF).toPandas()
    assert len(out)
    if name in ORACLE_SQL:
        tables = {t: pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages")}
        same(out, sql(ORACLE_SQL[name], **tables))


def test_pipeline(spark, tmp_path):
    """Each stage against what it says, on its own input."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(p.STAGES) - 1:
            assert sorted(after.columns) == sorted(p.COLUMNS)
        before_ids, ids = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, after))
        if name == "near_duplicates":
            rows = docs.select("doc_id", "text").collect()
            want = slow_components([r["doc_id"] for r in rows], [slow_fingerprint(r["text"]) for r in rows])
            assert ids == set(want)
        elif name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == {r["doc_id"] for r in docs.collect() if model.scores([r["text"] or ""])[0] < toxicity.THRESHOLD}
        elif name == "pii":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: pii.redact(t) for i, t in texts.items()}
        elif name == "mixing":
            order = sql(mixing.oracle(), documents=docs.select("doc_id", "source").toPandas()).sort_values(["slot", "place"]).doc_id.tolist()
            files = sorted(after.select(F.input_file_name().alias("f")).distinct().toPandas().f)
            assert [i for f in files for i in pd.read_parquet(f.removeprefix("file://")).doc_id] == order
        elif name == "packing":
            assert ids == before_ids
            place = sql(mixing.oracle(), documents=docs.select("doc_id", "source").toPandas()).set_index("doc_id").slot
            got = after.toPandas()
            assert (got.bin // 2**32 == got.doc_id.map(place) // (p.WINDOW_DOCS // mixing.BLOCK)).all()
            assert got.groupby("bin").length.sum().max() <= packing.CAPACITY
        else:
            assert ids == before_ids
        docs = after


@pytest.mark.parametrize("which", ["edge", "none", "clashing"])
def test_pipeline_of_odd_documents(spark, tmp_path, request, which):
    """Nulls, empty and long texts, repeats, an empty table, further columns."""
    import corpus_pipeline as p

    docs = request.getfixturevalue(which)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0 if which == "none" else 50).write.parquet(str(tmp_path / "labels.parquet"))
    out = p.run(spark, str(tmp_path)).toPandas()
    if which == "none":
        assert out.empty
        return
    # 2 is a copy of 1, and 4 and 5 have no words, like 3
    assert set(out.doc_id.dropna()) == {1, 3, 6, 7, 8, 9}
    assert out.doc_id.isna().sum() == 2 and out[out.doc_id == 6].length.sum() == 240_000
    assert not out.duplicated(["doc_id", "piece"]).where(out.doc_id.notna(), False).any()
