import hashlib
import re
from collections import Counter, defaultdict
from math import floor

import pytest
from leafgrid.llm import common, line_dedup, mixing, ngram_join, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mix(docs, hashes, weights=(5, 2, 1), percent=150, most=2):
    size = lambda t: len(WORD.findall(t or ""))
    total = defaultdict(int)
    for _, t, s in docs:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # share, cap, share what is over
        rest = sum(total.values()) * percent / 100 - sum(most * total[s] for s in full)
        free = [s for s in order if s not in full]
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] >= most * total[s]]
        if not over:
            break
        full |= set(over)
        for s in over:
            target[s] = most * total[s]
        if len(full) == len(order):
            break
    out, at = [], defaultdict(int)
    key = lambda d: f"no id {hashes[d[1] or '']}" if d[0] is None else str(d[0])
    for i, t, s in sorted(docs, key=lambda d: (hashlib.md5(key(d).encode()).hexdigest(), d[0] or 0, size(d[1]), hashes[d[1] or ""])):
        n, goal = size(t), floor(target[s] + 1e-9)
        epochs = goal // total[s] if total[s] else 0
        out.append((i, n, total[s], round(target[s], 6), epochs * n + max(0, min(n, goal - epochs * total[s] - at[s]))))
        at[s] += n
    return Counter(out)


DOCS = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", "Z", "é", None][i % 5]) for i in range(200)] + [(500, "big " * 5000, "hot"), (501, None, "none"), (None, "x y z", "a"), (7, "seven words of a very same id", "b"), (502, "one", "tiny"), (502, "one", "tiny")]
DOCS += [(None, f"no id {i}", "a") for i in range(30)] + [(None, "no id 3", "a")] + [(600, "w " * 100, "three")] * 3 + [(601, "v " * 200, "three")]


def hashes(spark, docs):
    """Spark's own hash of each text, which orders equal ids."""
    texts = spark.createDataFrame([(t,) for t in {d[1] or "" for d in docs}], "t string")
    return {r["t"]: r["h"] for r in texts.select("t", mixing.F.xxhash64("t").alias("h")).collect()}



def table(spark, docs=DOCS):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, size int, s string")


def test_mix_matches_brute_force(spark):
    got = mixing.mix(table(spark)).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == brute_mix(DOCS, hashes(spark, DOCS))
    for s in {d[2] for d in DOCS}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == floor(own[0]["target"] + 1e-9) and all(r["taken"] <= 2 * r["size"] for r in own)


def test_applied_mix_takes_what_the_plan_says(spark):
    df = table(spark)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert words == Counter({k: v for k, v in want.items() if v}) and words[600, "three"] > 0
    again = Counter(tuple(r) for r in mixing.apply_mix(df.repartition(7)).collect())
    assert again == Counter(tuple(r) for r in out.collect())
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.apply_mix(df.limit(0)).collect() == []


def test_filled_table_is_even_and_moves_little():
    names = [f"s{i}" for i in range(13)]
    full = sharding.fill(names, 1009)
    share = Counter(full)
    assert set(share) == set(range(13)) and max(share.values()) - min(share.values()) <= 1
    shuffled = sharding.fill(names[::-1], 1009)
    assert [names[::-1][i] for i in shuffled] == [names[i] for i in full]
    less = sharding.fill(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(full, less, strict=True) if a != 12)
    assert moved < 0.1 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 1000)


def test_fill_follows_the_permutations():
    """Against the definition: at its turn, a shard takes the first free slot of its whole permutation."""
    names, m = ["x", "y", "z"], 31
    perms = {n: [(sharding._number(n, "offset") + j * (sharding._number(n, "skip") % (m - 1) + 1)) % m for j in range(m)] for n in names}
    assert all(sorted(p) == list(range(m)) for p in perms.values())
    table, turn = {}, 0
    while len(table) < m:
        n = names[turn % 3]
        table[next(s for s in perms[n] if s not in table)] = n
        turn += 1
    assert [names[i] for i in sharding.fill(names, m)] == [table[s] for s in range(m)]


def test_place_and_write(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("", 4, "z"), ("ü" * 9000, 5, "z")], "key string, n int, shard string")
    got = sharding.place(df, "key").collect()
    assert len(got) == 5 and len({r["shard"] for r in got if r["key"] == "a"}) == 1
    assert len({r["slot"] for r in got if not r["key"]}) == 1 and all(r["shard"].startswith("shard-") for r in got)
    for r in got:
        assert r["slot"] == int(hashlib.md5((r["key"] or "").encode()).hexdigest()[:15], 16) % sharding.SLOTS
    sharding.write_shards(df, "key", str(tmp_path / "out"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5]
    assert sharding.place(df.limit(0), "key").collect() == []


def test_sharding_plan_has_no_shuffle_and_no_python(spark):
    plan = sharding.place(spark.range(10), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "mixing", "sentencepiece"]
    seen = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (at, common.materialize(stage(spark, at, "/root/testdata/sf0.001"), name))
        at = seen[name][1]
    for name, (_, out) in list(seen.items())[:-1]:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    before, after = seen["quality_rules"]
    kept = {r["doc_id"] for r in quality.quality(before, texts_once=True).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = seen["line_dedup"]
    want = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["ngram_join"]
    firsts = {r["component_id"] for r in ngram_join.similarity_classes(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == firsts
    before, after = seen["mixing"]
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
    words = Counter()
    for r in after.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter({k: v for k, v in plan.items() if v})
    before, after = seen["sentencepiece"]
    assert after.count() == before.count() and after.where("not exact").count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    body = [" ".join(f"w{(i * 31 + k * 7) % 997}" for k in range(60)) for i in range(40)]
    rows = [(i, body[i], "a" if i % 3 else None, 5, f"x{i}") for i in range(40)]
    rows += [(3, body[3], None, 5, "x3"), (50, None, "a", None, None), (51, "", "b", 0, "e"), (None, body[39] + " no id", "b", 1, "n"), (None, None, None, None, None)]
    rows += [(60, "q" * 200_000 + " " + " ".join(f"long{k}" for k in range(3000)), "c", 9, "l"), (61, body[5], "a", 7, "copy")]
    shape = "doc_id long, text string, source string, n_chars int, __t string"
    for name, given in (("odd", rows), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame(given, shape).write.parquet(str(at / "documents.parquet"))
        docs = common.table(spark, str(at), "documents")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.materialize(stage(spark, docs, str(at)), stage_name)
            assert out.dtypes == docs.dtypes, stage_name
            assert out.count() <= 3 * docs.count()
            docs = out
        got = corpus_pipeline.run(spark, str(at)).collect()
        if not given:
            assert got == []
            continue
        ids = {r["doc_id"] for r in got}
        assert {50, 51, 61} & ids == set() and {None, 60, 5} <= ids and all(r["exact"] and r["n_tokens"] for r in got)


def test_registered_queries_have_a_check():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert len(names) == 10 and "pipeline" in entry.queries()
    assert {q for q in names if q not in entry.oracle_sql()} == {"op6_sentencepiece", "op8_pii", "op10_toxicity"}
