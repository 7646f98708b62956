"""N-gram join and embedding near-duplicates against brute force."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import Row

from quillstone.llm import covertree, ngram_join, util
from quillstone.llm.components import components
from quillstone.llm.queries import QUERIES

MORE = "/root/testdata/sf0.01"


def linked(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_copies(seed, groups):
    rng = random.Random(seed)
    texts = []
    for size, words, changes in groups:
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, changes)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


def brute(texts):
    shingle = ngram_join.Shingler()
    sets = [set(shingle(t).tolist()) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter((i, j) for h in holders.values() for k, i in enumerate(h) for j in h[:k])
    return [(i, j) for (i, j), n in common.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]


def test_an_id_with_several_texts(spark):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(20):
        a, b = words(60), words(60)
        rows += [(i, " ".join(a)), (i, " ".join(b)), (100 + i, " ".join([*a, "tail"])), (200 + i, " ".join([*b, "tail"]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.join(df.repartition(3)).collect()
    assert len(out) == 80 and all(r.n_links == 1 and r.component_id == r.doc_id % 100 for r in out)
    # one of each pair stays, and it has the least id
    assert sorted(r.doc_id for r in ngram_join.deduplicate(df).collect()) == sorted([*range(20)] * 2)


def test_a_text_without_a_copy_is_never_dropped(spark):
    text = "one two three four five six seven eight nine ten " * 2
    alone = "quite another text that has no copy anywhere in here at all"
    rows = [(2, text, "x"), (5, text + "tail", "y"), (5, alone, "z"), (7, alone, "a"), (7, alone, "a"), (None, text, "n"), (9, "", ""), (9, None, None), (9, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    kept = ngram_join.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted(map(str, kept.collect()))
    assert got == sorted(str(Row(doc_id=i, text=t, digest=d)) for i, t, d in [rows[0], rows[2], *rows[6:]])


def test_connected_by_surviving_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (6, ngram_join.HASHES)).astype(np.uint16)
    values = base[rng.integers(0, 6, 90)].copy()
    change = rng.random(values.shape) < 0.08
    values[change] = rng.integers(0, 1 << 16, int(change.sum()))
    i, j = np.triu_indices(90, 1)
    side = rng.integers(0, 2, 90)
    for block in (None, side):
        pick = np.ones(len(i), bool) if block is None else side[i] != side[j]
        want = linked(90, zip(*map(np.ndarray.tolist, ngram_join.prune(values, i[pick], j[pick]))))
        assert ngram_join.connected(values, block).tolist() == want


def test_bands_miss_no_more_than_the_tolerance():
    assert (1 - ngram_join.THRESHOLD**ngram_join.ROWS) ** ngram_join.BANDS <= ngram_join.TOLERANCE
    rng = np.random.default_rng(5)
    for _ in range(3000):  # 20 bands miss one such pair in 2,800
        common, a, b = np.split(rng.integers(0, 1 << 63, 100, dtype=np.uint64), [80, 90])
        x, y = (ngram_join.signature(np.concatenate([common, s])).reshape(-1, ngram_join.ROWS) for s in (a, b))
        assert len(x) == ngram_join.BANDS and (x == y).all(1).any()


@pytest.mark.parametrize("block", [1000, 7])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SIGNATURES", block)
    monkeypatch.setattr(ngram_join, "FINE_BLOCK", min(block, 16))
    texts = near_copies(1, [(40, 120, 4), (25, 60, 3), (3, 300, 2), (2, 30, 1), *[(1, 50, 0)] * 30]) + ["", "a b", "a b", None, "a b c d e"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_links long")
    pairs = brute(texts)
    links = Counter(x for p in pairs for x in p)
    roots = linked(len(texts), pairs)
    rows = ngram_join.join(df.repartition(3)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_links == links[r.doc_id], r
        assert r.component_id == roots[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert sorted(r.doc_id for r in ngram_join.deduplicate(df).collect()) == sorted(set(roots))


def test_query_on_the_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_ngram_join"](spark, MORE).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{MORE}/documents.parquet").collect())
    pairs = brute([t for _, t in docs])
    assert len(pairs) > 100
    links = Counter(x for p in pairs for x in p)
    roots = linked(len(docs), pairs)
    assert [rows[i].n_links for i, _ in docs] == [links[k] for k in range(len(docs))]
    assert [rows[i].component_id for i, _ in docs] == [docs[r][0] for r in roots]


def test_join_awkward_rows(spark, awkward):
    rows = ngram_join.join(awkward).collect()
    got = sorted((str(r.doc_id), r.n_links, str(r.component_id), r.kept) for r in rows)
    assert got == sorted([("1", 2, "1", True)] * 2 + [("8", 2, "1", False)] + [(str(i), 0, str(i), True) for i in (2, 3, 4, 5, 6, None, 9)])
    assert ngram_join.join(awkward.limit(0)).count() == 0
    kept = ngram_join.deduplicate(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id = 1").count() == 1


def test_pruning_keeps_pairs_at_the_threshold():
    need = dict(ngram_join.least_matches())
    assert need[16] <= 8 and 70 <= need[128] <= 95
    # the chance that a pair at the threshold is dropped at any step is tiny
    drop = sum(sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(k)) for n, k in need.items())
    assert drop < 1e-3
    # nor is a likely pair lost in the bands
    assert (1 - 0.8**ngram_join.ROWS) ** ngram_join.BANDS < 1e-3


def test_bayesian_bound_is_the_beta_tail():
    rng = np.random.default_rng(0)
    for n, m in ((16, 10), (64, 50), (128, 100)):
        tail = sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert abs(tail - (rng.beta(1 + m, 1 + n - m, 200_000) >= 0.8).mean()) < 0.01


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, high, rng.integers(1, 120)).astype(np.uint64)) for high in (300, 900, 9000) for _ in range(20)]
    a, b = np.arange(32), np.arange(32, 60)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in b] for i in a]
    assert ngram_join.intersections(sets, a, b).tolist() == want
    own = [[len(np.intersect1d(sets[i], sets[j])) * (i != j) for j in a] for i in a]
    assert ngram_join.intersections(sets, a, a).tolist() == own


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = linked(300, edges)
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in got if want[x] == x and x in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_tables_that_nothing_reads_are_removed(spark, documents):
    import os

    where = util.scratch_dir(spark)
    before = set(os.listdir(where))
    out = ngram_join.join(documents)
    left = {n.split("-")[0] for n in set(os.listdir(where)) - before}
    assert left == {"sketches", "info"} and out.count() == documents.count()


# -- embeddings


def vectors(seed, n=300, dims=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[n // 3 : n // 2] = x[: n // 2 - n // 3] + rng.normal(size=(n // 2 - n // 3, dims)) * 0.15
    return x


@pytest.mark.parametrize("dims", [3, 8, 32])
def test_dual_traversal_is_exact(dims):
    x = vectors(dims, 400, dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reach = math.sqrt(0.1) + covertree.SLACK
    gram = x @ x.T
    t = covertree.CoverTree(x)
    assert set(zip(*map(np.ndarray.tolist, covertree.dual(t, t, reach, 0.95)))) == set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(gram >= 0.95, 1)))))
    a, b = covertree.CoverTree(x[:150]), covertree.CoverTree(x[150:])
    assert set(zip(*map(np.ndarray.tolist, covertree.dual(a, b, reach, 0.95)))) == set(zip(*map(np.ndarray.tolist, np.nonzero(gram[:150, 150:] >= 0.95))))


@pytest.mark.parametrize("dims", [3, 16])
def test_tiles_lose_and_repeat_no_pair(monkeypatch, dims):
    for name, value in (("SIDE", 7), ("SMALL", 9), ("PAIRS", 50), ("CENTRES", 5)):
        monkeypatch.setattr(covertree, name, value)
    x = covertree.unit(vectors(dims, 300, dims))
    x[200:260] = covertree.unit(x[200] + np.random.default_rng(1).normal(size=(60, dims)) * 0.05)  # a group of near copies
    reach, gram, rng = math.sqrt(0.1) + covertree.SLACK, x @ x.T >= 0.95, np.random.default_rng(2)
    ids, copies = rng.permutation(300) + 1000, rng.integers(1, 4, 300)
    for split in (None, 220):
        if split is None:
            a = b = covertree.CoverTree(x)
            found, want = list(covertree.traversal(a, b, reach, 0.95)), np.triu(gram, 1)
        else:
            a, b = covertree.CoverTree(x[:split]), covertree.CoverTree(x[split:])
            found = [(i, j + split) for i, j in covertree.traversal(a, b, reach, 0.95)]
            want = np.where((np.arange(300)[:, None] < split) & (np.arange(300) >= split), gram, False)
        got = sorted((min(p), max(p)) for i, j in found for p in zip(i.tolist(), j.tolist()))
        assert got == sorted(zip(*map(np.ndarray.tolist, np.nonzero(want))))
        links, root = covertree.links_of(ids, copies, found)
        assert links.tolist() == ((want | want.T) @ copies).tolist()
        ranks = np.argsort(ids)
        least = linked(300, zip(*map(np.ndarray.tolist, np.nonzero(want[ranks][:, ranks]))))
        assert [root[ranks[k]] for k in range(300)] == [ids[ranks[least[k]]] for k in range(300)]


@pytest.mark.parametrize("kind", ["near copies", "many small nodes", "visitors"])
def test_memory_does_not_grow_with_links_or_nodes(kind):
    rng = np.random.default_rng(6)
    if kind == "near copies":  # 8 million links
        x = rng.normal(size=16) + rng.normal(size=(4000, 16)) * 0.01
    else:  # twos at cosine 0.7: 4,000 nodes that no bound keeps apart
        x = np.repeat(rng.normal(size=(4000, 64)), 2, axis=0) + rng.normal(size=(8000, 64)) * 0.65
    x = covertree.unit(x)
    half = covertree.CoverTree(x[1::2])
    a, b = (covertree.CoverTree(x),) * 2 if kind != "visitors" else (covertree.CoverTree(x[::2]), half)
    tracemalloc.start()
    links, _ = covertree.links_of(np.arange(len(x)), np.ones(len(x), int), covertree.traversal(a, b, math.sqrt(0.1) + covertree.SLACK, 0.95))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6  # the vectors are 4 MB of doubles
    if kind == "near copies":
        assert (links == 3999).all()


def test_tree_invariants():
    x = vectors(2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = covertree.CoverTree(x)
    todo = [t.root]
    while todo:
        node = todo.pop()
        assert np.sqrt(np.maximum(0, 2 - 2 * x[node.members] @ x[node.centre])).max() <= node.radius + 1e-7
        kids = t.children(node)
        if kids:
            assert sorted(np.concatenate([k.members for k in kids])) == sorted(node.members)
            assert all(k.radius <= node.radius / 2 + 1e-9 for k in kids)
            todo += kids


@pytest.mark.parametrize("least", [256, 20])
def test_near_duplicates_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(covertree, "LEAST", least)
    monkeypatch.setattr(covertree, "VISITORS", 64)
    x = vectors(9, 260, 6)
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, n_links int")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    gram = y @ y.T
    np.fill_diagonal(gram, -1)
    pairs = list(zip(*np.nonzero(gram >= 0.95)))
    roots = linked(len(x), pairs)
    rows = covertree.near_duplicates(df.repartition(3)).collect()
    assert len(rows) == len(x)
    for r in rows:
        assert (r.n_links, r.component_id, r.kept) == ((gram[r.vec_id] >= 0.95).sum(), roots[r.vec_id], roots[r.vec_id] == r.vec_id)


def test_query_on_the_embeddings(spark):
    table = spark.read.parquet(f"{MORE}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").orderBy("vec_id").collect()
    some = [r for r in rows if r.embedding and None not in r.embedding and any(r.embedding) and np.isfinite(r.embedding).all()]
    x = np.array([r.embedding for r in some], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    gram = x @ x.T
    np.fill_diagonal(gram, -1)
    ids = [r.vec_id for r in some]

    def want(cosine):
        root = linked(len(ids), zip(*map(np.ndarray.tolist, np.nonzero(gram >= cosine))))
        return {r.vec_id: (0, r.vec_id, True) for r in rows} | {i: (int((gram[k] >= cosine).sum()), ids[root[k]], root[k] == k) for k, i in enumerate(ids)}

    seen = lambda df: {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}
    assert seen(QUERIES["op2_covertree"](spark, MORE)) == want(0.95)
    few = float(np.quantile(gram, 0.999))  # the small table has few near copies, or none
    assert seen(covertree.near_duplicates(table, cosine=few)) == want(few)


def test_vectors_of_every_kind_are_compared(spark):
    # mostly zero vectors; several lengths, common and rare ones; numbers whose squares overflow or vanish
    rows = [(i, [0.0, 0.0, 0.0]) for i in range(30_000)] + [(40_000, [1.0, 2.0, 3.0]), (40_001, [2.0, 4.0, 6.0]), (40_002, [1.0, 2.0]), (40_003, [1.0, 2.0]), (40_004, [-0.0, 1.0]), (40_005, [0.0, 1.0])]
    rows += [(50_000, [1e-200, 0.0]), (50_001, [1e-200, 0.0]), (50_002, [1e200, 0.0]), (50_003, [1.0, 0.0]), (50_004, [5e-324, 0.0])]
    rows += [(60_000 + 10 * n + k, [1.0] * n + [float(k > 1)] * n) for n in range(5, 25) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(df).where("vec_id >= 40000").collect()}
    assert [got[i] for i in range(40_000, 40_006)] == [(1, 40_000)] * 2 + [(1, 40_002)] * 2 + [(1, 40_004)] * 2
    assert [got[i] for i in range(50_000, 50_005)] == [(4, 50_000)] * 5
    assert all(got[60_000 + 10 * n + k] == (1, 60_000 + 10 * n + k // 2 * 2) for n in range(5, 25) for k in range(4))
    single = df.where("vec_id = 50003").selectExpr("vec_id", "cast(embedding as array<float>) embedding")
    assert covertree.near_duplicates(single.union(single)).collect() == [(50_003, 1, 50_003, True)] * 2


def test_many_blocks_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAST", 10)
    monkeypatch.setattr(covertree, "MOST", 400)  # more blocks than BLOCKS
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(500, 5)), np.tile(rng.normal(size=5), (300, 1))])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    y = covertree.unit(x)
    gram = y @ y.T
    np.fill_diagonal(gram, -1)
    got = {r.vec_id: r.n_links for r in covertree.near_duplicates(df.repartition(3)).collect()}
    assert got == dict(enumerate((gram >= 0.95).sum(1).tolist()))


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, math.nan]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [2.0, 0.1]), (6, [1.0, None]), (None, [1.0, 0.01]), (8, [1.0, 2.0, 3.0]), (9, []), (10, [math.inf, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in covertree.near_duplicates(df).collect())
    assert got == sorted([("4", 3, "4"), ("4", 3, "4"), ("5", 3, "4"), ("None", 3, "4")] + [(str(i), 0, str(i)) for i in (1, 2, 3, 6, 8, 9, 10)])
    assert covertree.near_duplicates(df.where("vec_id < 4")).count() == 3
    assert covertree.near_duplicates(df.limit(0)).count() == 0
