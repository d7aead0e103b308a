import gc
import os
import random
import re
import threading
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from leafgrid.llm import ann, common, ngram_join

WS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WS.findall((t or "").translate(UP))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is None or docs[j][0] is None:
                continue
            k = len(sets[i] & sets[j])
            if docs[i][0] == docs[j][0] or k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(sets[i]), low[find(i)] if d is not None else None) for i, (d, _) in enumerate(docs))


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (None, "one two")]
    n = 10
    for size in (6, 12, 40, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 2, 3, max(1, size // 60), max(1, size // 30)):
                w = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], [word()], [word(), word()]])
                docs.append((n, " ".join(w)))
                n += 1
    for _ in range(60):  # a common passage in otherwise different texts, most of some of them
        own = [word() for _ in range(rng.choice([5, 9, 14, 200]))]
        docs.append((n, " ".join([*own[: len(own) // 2], *passage, *own[len(own) // 2 :]])))
        n += 1
    hub = [word() for _ in range(120)]  # a large group of near copies, mostly near the hub only
    for _ in range(150):
        w = list(hub)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        docs.append((n, " ".join(w)))
        n += 1
    docs += [docs[-1], docs[20]]  # repeated rows
    rng.shuffle(docs)
    return docs


def table(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, node string")


@pytest.mark.parametrize("part", [4096, 20])
def test_components_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(ngram_join, "PART", part)  # 20: hot lists fall into parts
    docs = corpus()
    got = Counter(tuple(r) for r in ngram_join.similarity_classes(table(spark, docs)).collect())
    assert got == brute(docs)


def test_similarity_of_empty_tables(spark):
    assert ngram_join.similarity_classes(table(spark, [])).collect() == []
    assert {tuple(r) for r in ngram_join.similarity_classes(table(spark, [(1, None), (2, "")])).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def exact(rows, queries, k=10):
    out = []
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i) for r, (_, i) in enumerate(near)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, shard string, dim int")


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    monkeypatch.setattr(ann, "BLOCK", 10)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24)) * 2
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=24)]) for i in range(900)]
    df = vectors(spark, rows)
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    want = exact(rows, [r for r in rows if r[0] % 20 == 0])
    mine = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(mine & {(q, i) for q, _, i in want}) >= 0.95 * len(want)
    v = dict(rows)
    for r in got:
        assert r["score"] == pytest.approx(np.linalg.norm(np.array(v[r["query_id"]]) - np.array(v[r["vec_id"]])), abs=1e-9)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert all([x[0] for x in sorted(b)] == list(range(1, 11)) and [x[1:] for x in sorted(b)] == sorted(x[1:] for x in b) for b in by.values())


def test_nearest_odd_vectors_and_ties(spark):
    good = [(i, [1.0, float(i % 3)]) for i in range(1, 12)]  # equal vectors: ties by id
    odd = [(100, None), (101, []), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (None, [1.0, 1.0]), (106, [1.0, 2.0, 3.0]), (1, [1.0, 1.0])]
    df = vectors(spark, good + odd)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df).collect()]
    assert sorted(got) == sorted(exact(good + [odd[7]], good + [odd[7]]))
    assert ann.nearest(vectors(spark, []), vectors(spark, [])).collect() == []


@pytest.mark.parametrize("scale", [1.0, 1e25, 1e-25, 1e200, 1e-200])
def test_nearest_of_large_and_small_vectors(spark, monkeypatch, scale):
    monkeypatch.setattr(ann, "SHARD", 30)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) * scale for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id < 12")).collect()}
    want = exact([(i, list(v)) for i, v in enumerate(base)], [(i, list(v)) for i, v in enumerate(base[:12])])
    assert {k: v[0] for k, v in got.items()} == {(q, r): i for q, r, i in want}
    assert all(got[q, r][1] == pytest.approx(np.linalg.norm(base[q] - base[i]) * scale, rel=1e-9) for q, r, i in want)


def test_far_queries_and_outliers_do_not_spoil_a_shard(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)] + [(900, [1e6, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id in (3, 77, 900)")).collect()}
    want = set(exact(rows, [r for r in rows if r[0] in (3, 77, 900)]))
    assert len(got & want) >= 27 and {g[0] for g in got} == {3, 77, 900} and len(got) == 30


def test_nearest_looks_at_the_whole_shard_if_the_walk_finds_too_few(spark, monkeypatch):
    rows = [(i, [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    row = ann._index(pa.table({"id": [r[0] for r in rows], "v": [r[1] for r in rows], "dim": pa.array([2] * 40, pa.int32()), "shard": pa.array([0] * 40, pa.int32())})).to_pylist()[0]
    row["edges"] = np.full((41, ann.DEGREE), 40, np.int32).tobytes()  # a graph without edges
    got = ann._Shard(row).search(np.array([5]), np.array([[5.0, 1.0]]), 4)
    assert got.column("vec_id").to_pylist() == [4, 6, 3, 7] and df.count() == 40


def test_rows_of_an_id_with_different_texts_keep_their_links(spark):
    """Either text of an id may come first where pairs are verified."""
    rng = random.Random(3)
    words = [[f"{a}{rng.randrange(10**6)}" for _ in range(60)] for a in "abcd"]
    docs = [(5, " ".join(words[0])), (5, " ".join(words[1])), (9, " ".join(words[0][:-1] + ["x"])), (10, " ".join(words[1][:-1] + ["y"])), (11, " ".join(words[2]))]
    for order in (docs, docs[::-1]):
        got = [(r["doc_id"], r["component_id"]) for r in ngram_join.similarity_classes(table(spark, order)).collect()]
        assert sorted(got) == [(5, 5), (5, 5), (9, 5), (10, 5), (11, 11)]


@pytest.mark.parametrize("part", [4096, 20])
def test_slices_of_posts_lose_no_link(spark, monkeypatch, part):
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", 1)
    docs = corpus()
    got = Counter(tuple(r) for r in ngram_join.similarity_classes(table(spark, docs)).collect())
    assert got == brute(docs)


def test_join_holds_few_of_its_tables_and_shuffles_at_a_time(spark, monkeypatch, tmp_path):
    """The most that is on disk at once, against the texts' size."""
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", 1000, raising=False)
    rng = random.Random(6)
    words = [f"{rng.randrange(10**9):x}" for _ in range(20000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(6000)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[:1000]]  # near copies
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    roots = [str(x.getPath()) for x in manager.localDirs()] + [common.shared_dir(spark).removeprefix("file:")]

    def used():
        total = 0
        for root in roots:
            for at, _, names in os.walk(root):
                for name in names:
                    try:
                        total += os.lstat(f"{at}/{name}").st_size
                    except OSError:  # it has just gone
                        pass
        return total

    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffles of earlier tests
    time.sleep(2)
    floor, peak, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            peak[0] = max(peak[0], used() - floor)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(docs).collect()}
    finally:
        over.set()
        watcher.join()
    assert got == {i: i if i < 6000 else i - 6000 for i in range(7000)}
    size = sum(map(len, texts))
    print("disk, x texts", peak[0] / size)
    assert peak[0] < 0.8 * size
