import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, density, gaussian

SF = "/root/testdata/sf0.001"


def matrices(x, k):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.round(x / np.where(size == 0, 1, size), 12)
    size = np.linalg.norm(u, axis=1, keepdims=True)
    u = u / np.where(size == 0, 1, size)
    d = 1 - np.round(u @ u.T, 12)
    same = (u[:, None] == u[None]).all(2)
    d[same] = 0
    np.fill_diagonal(d, np.inf)
    core = np.round(np.sort(d, 1)[:, min(k, len(x) - 1) - 1], 12) if len(x) > 1 else np.zeros(1)
    core = np.maximum(core, 0)
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    return core, reach


def brute(ids, x, least, k):
    """All edges in ascending order, level by level; clusters as sets; selection from the top."""
    core, reach = matrices(x, k)
    n = len(x)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    members = {i: {i} for i in range(n)}
    open_ = {}
    clusters = []  # rows, parent, stability sum, birth
    i, j = np.triu_indices(n, 1)
    w = reach[i, j]
    order = np.argsort(w, kind="stable")
    w, i, j = w[order], i[order], j[order]
    home, at = {}, 0
    while at < len(w):
        end = at
        old = {}
        while end < len(w) and w[end] == w[at]:
            a, b = root(i[end]), root(j[end])
            if a != b:
                parts = old.pop(a, {a}) | old.pop(b, {b})
                up[b] = a
                old[a] = parts
            end += 1
        lam = 1 / max(w[at], 1e-9)
        for top, parts in old.items():
            big = [p for p in parts if p in open_]
            rows = set().union(*(members[p] for p in parts))
            loose = set().union(set(), *(members[p] for p in parts if p not in open_))
            if len(big) == 1:
                c = open_.pop(big[0])
                clusters[c]["sum"] += len(loose) * lam
                open_[top] = c
            elif big or len(rows) >= least:
                c = len(clusters)
                clusters.append({"sum": len(rows) * lam, "parent": None, "kids": [open_[p] for p in big]})
                for p in big:
                    o = open_.pop(p)
                    clusters[o] |= {"parent": c, "stability": clusters[o]["sum"] - len(members[p]) * lam}
                open_[top] = c
            if top in open_:
                for p in loose:
                    home[p] = open_[top]
            for p in parts:
                members.pop(p)
            members[top] = rows
        at = end

    def best(c):
        under = sum(best(x)[0] for x in clusters[c]["kids"])
        own = clusters[c]["stability"]
        clusters[c]["stays"] = own >= under
        return max(own, under), None

    for c, x in enumerate(clusters):
        if x["parent"] is not None and clusters[x["parent"]]["parent"] is None:
            best(c)
    out, names = [], {}
    for p in range(n):
        c, chosen = home.get(p), None
        while c is not None and clusters[c]["parent"] is not None:
            chosen = c if clusters[c]["stays"] else chosen
            c = clusters[c]["parent"]
        out.append(chosen)
        if chosen is not None:
            names[chosen] = min(names.get(chosen, ids[p]), ids[p])
    return core, {ids[p]: (names.get(c), None if c is None else round(clusters[c]["stability"], 5)) for p, c in enumerate(out)}


def mixture(seed, n, d, centres):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centres, d))
    return c[rnd.integers(0, centres, n)] + rnd.normal(size=(n, d)) * rnd.uniform(0.1, 0.6, (n, 1))


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "id long, embedding array<double>, p long")


@pytest.mark.parametrize("seed,piece", [(1, density.PIECE), (2, 40)])
def test_clusters_against_brute_force(spark, seed, piece):
    x = mixture(seed, 260, 5, 4)
    x[17] = 0
    ids = np.random.default_rng(9).permutation(1000)[: len(x)]
    core, want = brute(ids.tolist(), x, 8, 4)
    got = density.density_clusters(frame(spark, ids, x), "id", least=8, k=4, piece=piece).collect()
    assert {r.id: (r.cluster, r.stability and round(r.stability, 5)) for r in got} == want
    assert len({c for c, _ in want.values()}) > 2
    cores = {r.id: r.core for r in density.core_distances(frame(spark, ids, x), "id", 4).collect()}
    assert np.allclose([cores[i] for i in ids.tolist()], core, atol=1e-9)


def test_copies_make_a_cluster_and_rows_without_vectors_go(spark):
    x = np.vstack([np.tile([1.0, 0, 0], (30, 1)), np.tile([0, 1.0, 0], (25, 1)), np.eye(3)[2:], -np.eye(3)[:1]])
    df = frame(spark, range(len(x)), x).unionByName(spark.createDataFrame([(99, None, 1)], "id long, embedding array<double>, p long"))
    got = {r.id: r.cluster for r in density.density_clusters(df, "id", least=10, k=3).collect()}
    assert {got[i] for i in range(30)} == {0} and {got[i] for i in range(30, 55)} == {30} and got[55] is None and 99 not in got
    assert density.core_distances(df, "id", 3).where("core = 0").count() == 55
    assert density.tree_weight(df, "id", 3).first().n == 56


def test_empty_and_one_row(spark):
    one = frame(spark, [4], np.ones((1, 3)))
    assert [tuple(r) for r in density.density_clusters(one, "id").collect()] == [(4, None, None)]
    assert density.density_clusters(one.where("false"), "id").count() == 0
    assert density.core_distances(one, "id").first().core == 0.0
    with pytest.raises(ValueError):
        density.density_clusters(one, "id", least=1)


def test_blocks_bounded_and_skips_exact(spark):
    """However equal the rows, a block has at most ROWS of them; skipping loses nothing."""
    x = np.vstack([np.tile([1.0, 0, 0, 0], (9000, 1)), mixture(3, 700, 4, 6)])
    index = blocks.build(frame(spark, range(len(x)), x), "id")
    sizes = [r[0] for r in index.table.selectExpr("size(p)").collect()]
    assert max(sizes) <= blocks.ROWS and sum(sizes) == len(x)
    assert sorted(r.p for r in blocks.points(index).collect()) == list(range(len(x)))
    kernel = blocks.Nearest(3, same=True)
    found = blocks.scan(index, index, kernel, kernel.schema()).join(blocks.points(index), "p").where("id >= 9000").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -np.inf)
    top = np.sort(c, 1)[:, ::-1][:, :3]
    assert all(np.allclose([f.cosine for f in r.found], top[r.id]) for r in found) and len(found) == 700


def test_right_blocks_are_copied_to_groups_not_to_blocks(spark, monkeypatch):
    """A table of 96 blocks is copied to 2 groups a core (or as many as HELD allows), and results stay those of all pairs."""
    monkeypatch.setattr(blocks, "ROWS", 64)
    x = np.random.default_rng(8).normal(size=(6100, 6))
    index = blocks.build(frame(spark, list(range(len(x))), x), "id")
    assert index.count >= 96 and index.groups.select("g").distinct().count() <= 2 * spark.sparkContext.defaultParallelism
    seen = spark.sparkContext.accumulator(0)

    class Counted(blocks.Nearest):
        def least(self, block):
            if not getattr(block, "told", False):
                seen.add(1)
                block.told = True
            return super().least(block)

    kernel = Counted(3, same=True)
    got = {r.p: [f.q for f in r.found] for r in blocks.scan(index, index, kernel, kernel.schema()).collect()}
    assert index.count <= seen.value <= index.count * 2 * spark.sparkContext.defaultParallelism < index.count**2 / 4
    ids = {r.p: r.id for r in blocks.points(index).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 12)
    np.fill_diagonal(c, -1)
    best = np.argsort(-c, axis=1, kind="stable")[:, :3]
    assert {ids[p]: q for p, q in got.items()} == {i: best[i].tolist() for i in range(len(x))}
    assert blocks.HELD >= blocks.BYTES
    n, total, squares = blocks.scan(index, index, gaussian.Angles(), gaussian.Angles.SCHEMA, once=True).groupBy().sum("n", "total", "squares").first()
    a = np.arccos(np.clip(c[~np.eye(len(x), dtype=bool)], -1, 1))
    assert n == a.size and total == pytest.approx(a.sum()) and squares == pytest.approx((a * a).sum())


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    every = sc.statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_disk_grows_with_rows_not_with_groups(spark, monkeypatch):
    """96 blocks and 16 groups: what is shuffled is a few times the table, not a copy for each group."""
    monkeypatch.setattr(blocks, "ROWS", 64)
    x = np.random.default_rng(5).normal(size=(6100, 32))
    df, before = frame(spark, range(len(x)), x), shuffled(spark)
    got = {r.id: r.core for r in density.core_distances(df, "id", 4).collect()}
    assert 0 < shuffled(spark) - before < 6 * x.nbytes
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    want = 1 - np.sort(c, 1)[:, -4]
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)


def test_points_of_one_hash(spark, monkeypatch):
    """Vectors whose hashes meet stay points of their own."""
    x = mixture(4, 200, 4, 3)
    x[100:140] = x[:40]
    df = frame(spark, range(len(x)), x)
    run = lambda: (sorted(map(tuple, density.core_distances(df, "id", 3).collect())), sorted(map(tuple, density.density_clusters(df, "id", 6, 3).collect())))
    want = run()
    monkeypatch.setattr(density, "told", lambda u: F.pmod(F.xxhash64(u), F.lit(50)))
    assert run() == want and len(want[0]) == 200


def test_near_rows_by_single_floats_are_those_of_all_pairs(spark):
    """Distances below the precision of single floats, many ties and crowds beyond the bound on candidates."""
    rnd = np.random.default_rng(6)
    x = np.vstack([rnd.normal(size=(300, 8)), np.tile(rnd.normal(size=(1, 8)), (200, 1)) + rnd.normal(size=(200, 8)) * 1e-6, rnd.integers(0, 2, (400, 8))])
    x[0] = 0
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    c = np.round(u @ u.T, 12)
    np.fill_diagonal(c, -np.inf)
    kernel = blocks.Nearest(4, same=True)
    index = blocks.build(frame(spark, range(len(x)), x), "id")
    ids = {r.p: r.id for r in blocks.points(index).collect()}
    for r in blocks.scan(index, index, kernel, kernel.schema()).collect():
        assert np.allclose([f.cosine for f in r.found], np.sort(c[ids[r.p]])[::-1][:4], atol=2e-12) and len({f.q for f in r.found} - {ids[r.p]}) == 4


def test_rounds_scan_rows_whose_edges_are_used_up(spark, monkeypatch):
    """The tree is that of all pairs though rows keep two edges, with ties and copies; what is shuffled stays a few tables a round."""
    monkeypatch.setattr(blocks, "ROWS", 64)
    monkeypatch.setattr(density, "NEAR", 2)
    x = np.vstack([mixture(7, 5800, 128, 5), np.random.default_rng(2).integers(0, 2, (300, 128))])
    x[100:120] = x[:20]
    asked, real = [], density._outside
    monkeypatch.setattr(density, "_outside", lambda index, rows, all_: asked.append(rows.agg(F.sum("need")).first()[0]) or real(index, rows, all_))
    before = shuffled(spark)
    got = density.tree_weight(frame(spark, range(len(x)), x), "id", 3).first()
    assert asked[0] == len(x) - 20 and all(n < len(x) - 20 for n in asked[1:])
    assert shuffled(spark) - before < 40 * x.nbytes
    u = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 12)
    d = 1 - np.round(u @ u.T, 12)
    np.fill_diagonal(d, np.inf)
    core = np.maximum(np.sort(d, 1)[:, 2], 0)
    key, seen, total = np.full(len(x), np.inf), np.zeros(len(x), bool), 0.0
    key[0] = 0
    for _ in range(len(x)):
        i = int(np.where(seen, np.inf, key).argmin())
        seen[i], total = True, total + key[i]
        key = np.minimum(key, np.maximum(np.maximum(d[i], core[i]), core))
    assert got.n == len(x) - 1 and got.total == pytest.approx(total, abs=1e-7)
