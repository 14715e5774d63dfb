"""Order MinHash, the multi-index, components, and the pipeline, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from verdictlake.llm import embed_dedup, graph, minhash


def classes_of(n, pairs):
    f = graph.Forest(n)
    for i, j in pairs:
        f.join(i, j)
    return [f.root(i) for i in range(n)]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (60, 59)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 100 for k in range(100, 140))
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_alignment(a, b):
    """Longest common subsequence of k-mers, in full."""
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1] / max(1, len(a) + len(b) - best[-1, -1])


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 30, 80, 150]))]
        texts.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                at = rng.randrange(len(copy))
                kind = rng.random()
                if kind < 0.5:
                    copy[at] = rng.choice(words)
                elif kind < 0.75:
                    copy.insert(at, rng.choice(words))
                elif len(copy) > 1:
                    del copy[at]
            texts.append(copy)
    halves = texts[2]
    texts.append(halves[len(halves) // 2 :] + halves[: len(halves) // 2])
    return [" ".join(t) for t in texts] + ["Same, words here now ok!", "same words HERE now ok", "!!!", "???", "!!!", ""]


def truth(texts):
    words, ends = minhash.word_hashes(pa.array(texts))
    h, ends = minhash.kmers(words, ends)
    docs = np.split(h, ends[:-1])
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if (len(docs[i]) and len(docs[j]) and brute_alignment(docs[i].tolist(), docs[j].tolist()) >= 0.8) or (not len(docs[i]) and texts[i] == texts[j])]
    return classes_of(len(texts), pairs)


@pytest.mark.parametrize("block", [2048, 3])
def test_classes_against_full_alignment(spark, monkeypatch, block):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)  # small blocks: groups are split and must meet again
    rows = {r["doc_id"]: r for r in minhash.report(docs).collect()}
    expected = truth(texts)
    got = [rows[i]["class_id"] for i in range(len(texts))]
    assert got == expected
    assert all(rows[i]["kept"] == (rows[i]["class_id"] == i) for i in rows)


def test_drifting_copies_in_a_split_group_are_one_class(spark, monkeypatch):
    rng = random.Random(3)
    words, texts = [f"a{i}" for i in range(150)], []
    for k in range(240):  # each copy changes one word: neighbours are at 0.93, the fourth after is below 0.8
        texts.append(" ".join(words))
        words[(k * 37) % 150] = f"b{k}"
    order = list(range(240))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(minhash, "BLOCK_KMERS", 120 * 146)  # two blocks
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 1000)
    assert {r["class_id"] for r in minhash.report(docs).collect()} == {0}


@pytest.mark.parametrize(("kmers", "rows"), [(5_000, 1024), (2_000_000, 1024)])
def test_classes_do_not_depend_on_the_size_of_blocks(spark, monkeypatch, kmers, rows):
    rng = random.Random(21)
    base = [f"a{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        near = list(base)
        for _ in range(2):
            near[rng.randrange(120)] = f"z{rng.randrange(10_000)}"
        texts.append(near)
    for _ in range(20):  # a chain of two steps from some of them: only its first member is near the rest
        one = list(texts[rng.randrange(60)])
        for at in rng.sample(range(120), 2):
            one[at] = f"y{rng.randrange(10_000)}"
        two = list(one)
        two[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        texts += [one, two]
    texts = [" ".join(t) for t in texts]
    monkeypatch.setattr(minhash, "BLOCK_KMERS", kmers)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in minhash.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == truth(texts)


def test_of_a_repeated_id_the_least_text_stays(spark):
    rows = [(1, "b b c d e f g", "x", 2), (1, "a b c d e f g", "y", 1), (1, None, "z", 3), (2, "a b c d e f g", "w", 4), (3, "other words are here now", "v", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, __n int")
    assert sorted((r["doc_id"], r["class_id"]) for r in minhash.deduplicate(docs.drop("__n")).collect()) == [(1, "z"), (3, "v")]


def test_alignment_equals_brute_force_near_the_threshold():
    rng = random.Random(8)
    for _ in range(60):
        a = rng.sample(range(1000), 60)
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            b.insert(rng.randrange(len(b)), b.pop(rng.randrange(len(b)))) if rng.random() < 0.4 else b.__setitem__(rng.randrange(len(b)), rng.randint(2000, 9000))
        b = list(dict.fromkeys(b))
        full = brute_alignment(a, b)
        got = minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert (got >= 0.8) == (full >= 0.8)
        if full >= 0.8:
            assert got == pytest.approx(full)


def test_signatures_keep_order():
    texts = pa.array(["a b c d e f g h i j k l", "g h i j k l a b c d e f"])
    words, ends = minhash.word_hashes(texts)
    h, ends = minhash.kmers(words, ends)
    assert len(h) == 16 and minhash.signatures(h, ends).shape == (2, minhash.HASHES)
    one, ends1 = minhash.kmers(*minhash.word_hashes(texts.slice(0, 1)))
    assert (minhash.signatures(one, ends1)[0] == minhash.signatures(h, ends)[0]).all()


def test_near_copies_of_odd_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b, c d e f!"), (None, "a b c d e f"), (7, None), (8, ""), (9, "long " * 30_000)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in minhash.report(docs).collect())
    assert got == [(0, 0, True), (2, 2, True), (5, 2, False), (5, 2, False), (7, 7, True), (8, 7, False), (9, 9, True)]
    assert minhash.report(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 9").union(docs.where("doc_id = 9"))
    assert minhash.deduplicate(twice).count() == 1


# -- embeddings ----------------------------------------------------------------------------------


def vectors(seed=0, n=600, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, d))
    x = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.1, 0.3], n)[:, None]
    x[50:60] = x[40]
    return x.astype(np.float32), rng.integers(0, 3, n)


@pytest.mark.parametrize("block", [2048, 7])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", block)
    x, labels = vectors()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist(), int(y), "z") for i, (v, y) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int, weight string").repartition(3)
    rows = {r["vec_id"]: r for r in embed_dedup.report(df).collect()}
    assert len(rows) == len(x)
    got = np.array([rows[i]["n_links"] for i in range(len(x))])
    assert (got <= linked.sum(1)).all() and got.sum() >= 0.98 * linked.sum()
    comp = classes_of(len(x), zip(*np.nonzero(np.triu(linked)), strict=True))
    assert np.mean([rows[i]["component_id"] == comp[i] for i in range(len(x))]) > 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (10, [1e-30, 0.0], 0), (11, [], 0), (12, [None, 1.0], 0), (1, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0, r["kept"]) for r in embed_dedup.report(df).collect())
    lone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11, 12)]
    assert got == sorted([(0, 0, 0, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False), *lone])
    assert embed_dedup.report(df.limit(0)).count() == 0


def test_unusable_rows_of_a_usable_id_are_kept(spark):
    rows = [(1, [1.0, 0.0], 0), (1, None, 0), (1, [0.0, 0.0], 0), (1, [1.0, 0.0], None), (2, [1.0, 0.0], 0)]
    got = embed_dedup.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1)] * 3 + [(1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_ids_may_repeat_and_rows_stay_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(embed_dedup, "HOT_COPIES", hot)
    a, b, c = [1.0, 0.0], [0.999, 0.01], [0.0, 1.0]
    rows = [(1, a, 0, "p"), (1, c, 0, "q"), (1, None, 0, "r"), (None, a, 0, "s"), (2, b, 0, "t"), (3, c, 0, "u"), (3, c, 0, "v"), *[(7, a, 1, "w")] * 5, (8, b, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id string").repartition(3)
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0, r["kept"]) for r in embed_dedup.report(df).collect())
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (1, 0, 1, True), (0, 0, 0, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), *[(7, 5, 7, True)] * 5, (8, 5, 7, False)])
    kept = embed_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["component_id"] for r in kept.collect()) == ["p", "q", "r", "s", "w", "w", "w", "w", "w"]
    assert embed_dedup.deduplicate(df.limit(0)).count() == 0


def test_cells_before_a_cell_are_counted():
    rng = np.random.default_rng(5)
    left, right = rng.random(9), rng.random(7)
    grid = left[:, None] + right[None, :]
    assert all(embed_dedup._nearer(left, right, i, j) == (grid < grid[i, j]).sum() for i in range(9) for j in range(7))


def test_traversal_yields_cells_in_order():
    rng = np.random.default_rng(3)
    left, right = rng.random(6), rng.random(5)
    got = embed_dedup.traverse(left, right, 30)
    costs = [left[i] + right[j] for i, j in got]
    assert len(set(got)) == 30 and costs == sorted(costs)


# -- the pipeline --------------------------------------------------------------------------------


def test_pipeline_over_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, names = docs, docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf)
        if k < 3:
            assert out.columns == names and out.dtypes == docs.dtypes
            assert 0 < out.count() <= seen.count()
        seen = out
    texts = {r["doc_id"] for r in seen.select("doc_id").distinct().collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == texts
    total = whole.groupBy("doc_id").sum("length").join(whole.select("doc_id", "doc_tokens").distinct(), "doc_id")
    assert total.where("`sum(length)` <> doc_tokens").count() == 0
