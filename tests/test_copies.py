"""Tables of many copies, and inputs that are to be computed once: what an operator reads
and how often, besides its results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernmill.functions.kernels import Gaussian, Laplace
from kernmill.operators import cells, exact, gauss, knn, sweep, tree


@pytest.fixture(scope="module")
def copies(spark):
    """400 points on 40 places, ids not in order."""
    x = np.repeat(np.random.default_rng(5).normal(size=(40, 2)).round(3), 10, axis=0)
    x = x[np.random.default_rng(6).permutation(400)]
    w = np.arange(400) % 7 + 1.0
    return x, w, spark.createDataFrame([(i, v.tolist(), u) for i, (v, u) in enumerate(zip(x, w.tolist(), strict=True))], "id long, x array<double>, w double").cache()


def asked(p):
    return p.select(F.col("id").alias("qid"), F.col("x").alias("q"))


@pytest.fixture
def read(monkeypatch):
    """Copies are looked for in small tables; what comes to sweeps of a module is noted as (points, queries)."""
    monkeypatch.setattr(sweep, "COPY_PAIRS", 0, raising=False)
    seen = []

    def noted(points, queries, *more):
        seen.append((points.count(), queries.count()))
        return sweep.sweep(points, queries, *more)

    for module in (exact, knn):
        monkeypatch.setattr(module, "sweep", noted)
    return seen


def counted(df, passed):
    def run(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)


def by_qid(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("qid").collect()]


def test_counts_in_a_radius_write_no_pairs(spark, copies):
    """F1"""
    x, _, p = copies
    there = exact.together(p, ["x"]).select(F.lit(1).alias("cell"), "id", "x", "_n")
    some, back = sweep.once(asked(p))
    want = (((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.25).sum(axis=1)
    out = back(cells.range_count(there, some.select(F.lit(1).alias("cell"), "qid", "q"), 0.5))
    assert by_qid(out, "qid", "n") == list(enumerate(want.tolist()))


def test_neighbours_of_a_far_sample_are_searched_once(spark):
    """F2"""
    points = spark.createDataFrame([(i, 8 + i // 25) for i in range(200)], "id long, leaf long")
    rows = [(8 + i // 25, (i + 25) % 200) for i in range(0, 200, 2)]
    passed = spark.sparkContext.accumulator(0)
    out = tree.far_sample(points, counted(spark.createDataFrame(rows, "leaf long, id long"), passed), 10).collect()
    assert passed.value == len(rows) and len(out) == 80
    assert not {tuple(r) for r in out} & set(rows) and all(r["id"] // 25 != r["leaf"] - 8 for r in out)


def test_lists_of_a_quality_are_made_once(spark, copies):
    """F4"""
    p = copies[2]
    lists = knn.knn(p, asked(p), 3).cache()
    passed = [spark.sparkContext.accumulator(0) for _ in range(2)]
    row = knn.quality(*[counted(lists, a) for a in passed]).first()
    assert (row["hit_rate"], row["missed"]) == (1.0, 0) and [a.value for a in passed] == [1200, 1200]


def test_neighbours_by_tiles(monkeypatch):
    """the best of many tiles, the nearest points last, with ties."""
    import pyarrow as pa

    monkeypatch.setattr(knn, "TILE_POINTS", 7, raising=False)
    monkeypatch.setattr(knn, "TILE", 35, raising=False)
    for d in (1, 6):
        x = np.sort(np.random.default_rng(d).integers(0, 9, (60, d)), axis=0)[::-1].astype(float)
        q = x[::-1][:23].copy()
        batches = [pa.record_batch({"id": pa.array(range(s, s + 20)), "x": pa.array(x[s : s + 20].tolist())}) for s in (0, 20, 40)]
        out = next(knn.nearest(5)(np.arange(23), q, None, iter(batches))).to_pylist()
        d2 = ((q[:, None] - x[None]) ** 2).sum(axis=2)
        want = [(i, d2[i, j], j) for i in range(23) for j in np.lexsort((np.arange(60), d2[i]))[:5]]
        assert [(r["qid"], r["dist2"], r["id"]) for r in out] == want


def test_neighbours_among_copies(copies, read):
    """of the copies of a point no more than k are read, of those of a query one."""
    x, _, p = copies
    out = [tuple(r) for r in knn.knn(p, asked(p), 4).orderBy("qid", "rank").collect()]
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = [(i, r + 1, d2[i, j], j) for i in range(400) for r, j in enumerate(np.lexsort((np.arange(400), d2[i]))[:4])]
    assert out == want and read == [(160, 40)]


@pytest.mark.parametrize("kernel", [Gaussian(0.4, half=True), Laplace(d=2)])
def test_sums_over_copies(copies, read, kernel):
    """copies of points and of queries are read once; weights and numbers add up."""
    x, w, p = copies
    k = kernel.block(sweep.sqdist(x, x))
    got = by_qid(exact.kde(p, asked(p), kernel), "qid", "density")
    assert [q for q, _ in got] == list(range(400)) and np.allclose([v for _, v in got], k.mean(axis=1))
    assert read == [(40, 40)]
    got = by_qid(exact.kernel_sums(p, asked(p), kernel, weights=["w"], radius=1.0), "sum", "n")
    near = sweep.sqdist(x, x) <= 1
    assert np.allclose([s for s, _ in got], (k * near) @ w) and [n for _, n in got] == near.sum(axis=1).tolist()
    odd = (p.withColumn("g", F.col("id") % 3), asked(p).where("qid % 2 = 0"))
    got = exact.kernel_sums(*odd, kernel, group="g").where("g = 1").orderBy("qid").collect()
    assert np.allclose([r["sum"] for r in got], k[::2, 1::3].sum(axis=1)) and {r["n"] for r in got} == {133}


def test_a_tree_of_copies(copies, read):
    """places are decomposed and met once, charges of copies add up, every copy gets its potential."""
    x, w, p = copies
    tree_ = gauss.Treecode.fit(p, Gaussian(0.5), 2, 30, 0.2, 200)
    assert tree_.placed.count() == 40
    weights, want = p.select("id", "w"), Gaussian(0.5).block(sweep.sqdist(x, x)) @ w
    for out, ids in ((tree_.potentials(asked(p), weights), np.arange(400)), (tree_.mutual_potentials(weights), np.arange(400)), (tree_.potentials(asked(p).where("qid % 2 = 1"), weights), np.arange(1, 400, 2))):
        got = by_qid(out, "qid", "potential")
        assert [q for q, _ in got] == ids.tolist() and np.allclose([v for _, v in got], want[ids], atol=1e-3 * w.sum())


def test_column_kernels_meet_blocks(spark, monkeypatch):
    """F8: distances come in blocks, not a row a pair, broadcast or dealt; a kernel's nulls don't count."""

    class Odd(Gaussian):
        def column(self, s):
            return F.when(s < 1.5, F.coalesce(F.exp(-s), F.lit(7.0)))

    x = np.random.default_rng(8).normal(size=(301, 3))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = np.where(d2 < 1.5, np.exp(-d2), 0).sum(axis=1) / (d2 < 1.5).sum(axis=1)
    for most in (sweep.BROADCAST_BYTES, 0):
        monkeypatch.setattr(sweep, "BROADCAST_BYTES", most)
        out = exact.kde_columns(p, asked(p), Odd())
        assert "NestedLoop" not in out._jdf.queryExecution().toString()
        assert np.allclose([d for _, d in by_qid(out, "qid", "density")], want)


@pytest.mark.parametrize("n", [5, 3000])
def test_sums_by_tiles(n):
    """blocks of distances that a core's cache holds, each pair in one, for few queries and for many."""
    import pyarrow as pa

    seen = []

    class Noted(Laplace):
        def block(self, s):
            seen.append(s.shape)
            return super().block(s)

    rng = np.random.default_rng(12)
    x, q, w = rng.normal(size=(700, 2)), rng.normal(size=(n, 2)), rng.random(700)
    batches = [pa.record_batch({"id": pa.array(range(s, s + 350)), "x": pa.array(x[s : s + 350].tolist()), "w": pa.array(w[s : s + 350])}) for s in (0, 350)]
    for radius in (None, 1.0):
        seen.clear()
        out = list(exact.summing(None, Noted(d=2), ["w"], radius=radius)[2](np.arange(n), q, None, iter(batches)))[0]
        d2 = sweep.sqdist(q, x)
        near = d2 <= (np.inf if radius is None else radius)
        assert np.allclose(out.column(2).to_numpy(), np.where(d2 < 1e-15, 0, np.log(np.sqrt(d2)) / (2 * np.pi) * near) @ w)
        assert out.column(3).to_pylist() == near.sum(axis=1).tolist()
        assert max(a * b for a, b in seen) <= 1 << 16 and sum(a * b for a, b in seen) == n * 700 and len(seen) <= 2 + n * 700 // 10000


def test_a_gauss_transform_of_copies(copies, monkeypatch):
    """copies of points and of queries go through the transform once, weights add up."""
    x, w, p = copies
    monkeypatch.setattr(sweep, "COPY_PAIRS", 0)
    seen = []
    monkeypatch.setattr(sweep, "spread", lambda rows, against=0: seen.append(rows.count()) or rows)
    d2 = sweep.sqdist(x, x)
    for cut_off in (gauss.ONE, gauss.BY_CLUSTER, gauss.BY_POINT):
        g = gauss.gauss_transform(p.withColumn("v", 2 - F.col("w")), asked(p).where("qid % 2 = 1"), 0.5, 1e-3, 6, ("w", "v"), cut_off=cut_off)
        for s, v in enumerate((w, 2 - w)):
            got = by_qid(g.where(f"wset = {s}"), "qid", "g")
            assert [i for i, _ in got] == list(range(1, 400, 2)) and np.abs([a for _, a in got] - (np.exp(-d2 / 0.25) @ v)[1::2]).max() <= 1e-3 * np.abs(v).sum()
    assert set(seen) == {40}


def test_copies_are_linked_once(spark):
    """queries are joined by vectors once, whatever is then asked of the first ones and handed back; zeros of both signs and nan are copies."""
    values = [0.0, -0.0, float("nan"), 1.0, 1.0, float("nan"), 2.0, 0.0]
    passed = spark.sparkContext.accumulator(0)
    some, back = sweep.once(counted(spark.createDataFrame([(i, [v, 5.0]) for i, v in enumerate(values)], "qid long, q array<double>"), passed))
    assert sorted(r["qid"] for r in some.collect()) == [0, 2, 3, 6]
    before = passed.value
    found = some.select("qid", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("s"), F.col("qid").alias("of"))
    got = sorted(tuple(r) for r in back(found).collect())
    assert got == [(i, s, of) for i, of in enumerate([0, 0, 2, 3, 3, 2, 6, 0]) for s in "ab"]
    assert some.count() == 4 and passed.value == before


def test_a_tree_is_made_by_many_tasks(copies, read):
    """leaves are decomposed side by side, weights of copies added up once."""
    x, w, p = copies
    tree_ = gauss.Treecode.fit(p, Gaussian(0.5), 2, 30, 0.2, 200)
    assert len(tree_.nodes.inputFiles()) > 1
    passed = p.sparkSession.sparkContext.accumulator(0)
    got = by_qid(tree_.potentials(asked(p), counted(p.select("id", "w"), passed)), "potential")
    assert passed.value == 400 and np.allclose([v for v, in got], Gaussian(0.5).block(sweep.sqdist(x, x)) @ w, atol=1e-3 * w.sum())


@pytest.mark.parametrize("d", [2, 3])
def test_gaussian_sums_on_a_lattice_are_products(monkeypatch, d):
    """where many vectors share a half the kernel of the halves is evaluated, not that of all pairs; else that of the pairs."""
    import pyarrow as pa

    seen, block = [], Gaussian.block
    monkeypatch.setattr(Gaussian, "block", lambda self, s: seen.append(s.size) or block(self, s))
    rng = np.random.default_rng(11)
    axes = [rng.normal(size=n) for n in (7, 30, 2)[:d]]
    lattice, free = (lambda n: np.stack([rng.choice(a, n) for a in axes], axis=1)), rng.normal(size=(900, d))
    for x, q, few in ((lattice(900), lattice(800), True), (free, lattice(800), False), (lattice(900), free, False), (free, free[::-1].copy(), False)):
        w, many = rng.normal(size=(900, 2)), rng.integers(1, 9, 900)
        batches = [pa.record_batch({"id": pa.array(range(s, s + 450)), "x": pa.array(x[s : s + 450].tolist()), "w": pa.array(w[s : s + 450, 0]), "v": pa.array(w[s : s + 450, 1]), "n": pa.array(many[s : s + 450])}) for s in (0, 450)]
        seen.clear()
        out = list(exact.summing(None, Gaussian(0.6), ["w", "v"], number="n")[2](np.arange(len(q)), q, None, iter(batches)))
        assert (sum(seen) < len(q) * 90) == few
        want = np.exp(-((q[:, None] - x[None]) ** 2).sum(axis=2) / 0.36) @ w
        assert all(np.allclose(b.column(2).to_numpy(), want[:, k], rtol=1e-12, atol=1e-12) and set(b.column(3).to_pylist()) == {many.sum()} for k, b in enumerate(out))

    class Odd(Gaussian):
        def block(self, s):
            return np.sqrt(s)

    x = lattice(300)
    own = [pa.record_batch({"id": pa.array(range(300)), "x": pa.array(x.tolist())})]
    got = list(exact.summing(None, Odd())[2](np.arange(300), x, None, iter(own)))[0]
    assert Gaussian(2.0, half=True).factors and not Odd().factors
    assert np.allclose(got.column(2).to_numpy(), np.sqrt(sweep.sqdist(x, x)).sum(axis=1))


def test_few_copies_are_handed_back_without_a_shuffle(spark):
    """as those of many; zeros of both signs and nan are copies."""
    values = [0.0, -0.0, float("nan"), 1.0, 1.0, float("nan"), 2.0, 0.0]
    some, back = sweep.once(spark.createDataFrame([(i, [v, 5.0]) for i, v in enumerate(values)], "qid long, q array<double>"), 4)
    assert sorted(r["qid"] for r in some.collect()) == [0, 2, 3, 6]
    out = back(some.select("qid", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("s"), F.col("qid").alias("of")))
    assert sorted(tuple(r) for r in out.collect()) == [(i, s, of) for i, of in enumerate([0, 0, 2, 3, 3, 2, 6, 0]) for s in "ab"]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ifgt_bound_by_cluster", "treecode"])
def test_errors_of_copies_are_measured_once(spark, tmp_path, monkeypatch, name):
    """parts of one place are scaled, summed and compared once."""
    from kernmill import queries

    rng = np.random.default_rng(13)
    raw = np.stack([rng.integers(1, 9, 60), rng.integers(900, 930, 60)], axis=1)[rng.integers(0, 60, 600)]
    spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(raw)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(sweep, "COPY_PAIRS", 0)
    seen, sums = [], exact.kernel_sums
    monkeypatch.setattr(exact, "kernel_sums", lambda points, asked, *a, **b: seen.append((points.count(), asked.count())) or sums(points, asked, *a, **b))
    got = by_qid(queries.QUERIES[name](spark, str(tmp_path)), "qid", "exact", "within")
    x = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    want = Gaussian(queries.IFGT_H if name.startswith("ifgt") else 0.5).block(sweep.sqdist(x, x)).sum(axis=1)
    assert [q for q, _, _ in got] == list(range(600)) and np.allclose([v for _, v, _ in got], want, atol=1e-6) and all(ok for _, _, ok in got)
    assert seen == [(len(np.unique(raw, axis=0)),) * 2]
