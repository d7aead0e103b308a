import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from leafgrid.llm import kernels, line_dedup, quality

WS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "\n".join(f"Line number {i % 700} of a very long text" for i in range(3000))
DOCS = [
    (1, "A shared line here\nown line number one\n", "a"),
    (2, "  a SHARED line here\t\nÉtude Étude Étude\nétude étude étude", "a"),
    (3, "a shared line here\r\na shared line here\nshort", "b"),
    (4, None, "a"),
    (5, "", None),
    (6, "\n\n \n", "b"),
    (7, LONG, "b"),
    (8, LONG + "\nwith an end", "a"),
    (8, LONG + "\nwith an end", "a"),
    (9, "a shared line here\nunique words of nine", None),
    (None, "a shared line here\nunique words of nine", "a"),
]


def table(spark, docs=DOCS):
    # the extra columns bear names that the operators use inside
    rows = [(*d, "x", 1) for d in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, th string, line int")


def brute_lines(docs):
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    for i, t, *_ in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held[key(x)].add(i)
    out = []
    for i, t, *_ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r[0], r[1], r[2], hashlib.sha256((r[3] or "").encode()).hexdigest()) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect())


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_line_dedup_matches_brute_force(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert result(line_dedup.dedup_lines(table(spark))) == brute_lines(DOCS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_line_that_fills_many_partitions_keeps_one_owner(spark):
    docs = [(i, "one line that all documents hold\nand the one of %d alone" % i, "a") for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(line_dedup.dedup_lines(table(spark, docs))) == brute_lines(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_stream_settles_runs_over_batches_and_partitions():
    import pyarrow as pa

    rows = [(1, 1, d, 0, p) for d in (3, 3, 5) for p in (0, 1)] + [(2, 1, 4, 0, 0), (2, 1, 9, 0, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part]) for i in range(5)], names=["h1", "h2", "doc", "th", "pos"]) for part in (rows[:1], rows[1:5], rows[5:])]
    got = [tuple(x.values()) for b in line_dedup._stream(iter(batches)) for x in b.to_pylist()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 5, 0, 0), (0, 1, 1, 5, 0, 1), (0, 2, 1, 9, 0, 2)]
    assert {g[3] for g in got if g[0] == 1} == {3} and len([g for g in got if g[0] == 1]) == 4
    assert [g[:4] for g in got if g[0] == 2] == [(2, 2, 1, 4)]


def test_bitmaps_are_compressed_and_say_what_stays(spark):
    maps = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(table(spark)).collect()}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bytes(maps[3]["bitmap"])), np.uint8))
    assert bits[:3].tolist() == [0, 0, 1] and maps[3]["n_dropped"] == 2
    assert len(maps[8]["bitmap"]) < 100  # of 3001 lines


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(table(spark, [])).collect() == []


def brute_quality(docs, texts_once=False, **limits):
    p = {"min_words": 10, "repeat": 20, "line_words": 3, "docs": 10, "left": 30} | limits
    held = defaultdict(set)
    norm = lambda x: " ".join(WS.findall(x.translate(UP)))
    for i, t, h in docs:
        for x in {norm(x) for x in (t or "").split("\n")}:
            held[h, x].add((t or "") if texts_once or i is None else i)
    out = []
    for i, t, h in docs:
        t = t or ""
        w = WS.findall(t)
        lines = [x for x in t.split("\n") if WS.findall(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        many = Counter(grams)
        repeat = {p_ for k, g in enumerate(grams) if many[g] > 1 for p_ in range(k, k + 5)}
        hot = lambda x: len(x.split()) >= p["line_words"] and len(held[h, x]) > p["docs"]
        gone = sum(len(WS.findall(x)) for x in lines if hot(norm(x)))
        failed = len(w) < p["min_words"] or 100 * len(repeat) > p["repeat"] * len(w)
        left = len(w) - gone
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), failed, not failed and left >= p["min_words"] and 100 * left >= p["left"] * len(w), gone))
    return Counter(out)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]


def quality_docs():
    body = [" ".join(f"w{(i * 37 + k * k) % 501}" for k in range(40)) for i in range(60)]
    hot = "This very line is on every page of the host"
    docs = [(i, f"{body[i]}\n{hot}\n# * {i} %", "h1") for i in range(60)]
    docs += [(100 + i, f"{hot}\nonly word {i}", "h1") for i in range(5)]
    docs += [(200 + i, body[0], "h2") for i in range(40)]  # copies of one good text
    docs += [(300, "word " * 30, "h1"), (301, "ééé ﬁn " * 3, None), (302, None, None), (303, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z", "h2")]
    return docs + list(DOCS)


@pytest.mark.parametrize("once,limit", [(False, 1000), (True, 1000), (False, 0)])
def test_quality_matches_brute_force(spark, once, limit):
    docs = quality_docs()
    got = Counter(tuple(r) for r in quality.quality(table(spark, docs), texts_once=once, broadcast_lines=limit).select(*COLUMNS).collect())
    assert got == brute_quality(docs, once)


def test_lines_are_counted_by_documents_or_by_texts(spark):
    df = table(spark, quality_docs())
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(df).collect()}
    assert not any(kept[200 + i] for i in range(40)) and kept[5] and not any(kept[100 + i] for i in range(5))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(df, texts_once=True).collect()}
    assert all(kept[200 + i] for i in range(40)) and kept[5] and not any(kept[100 + i] for i in range(5))


def test_repeated_rows_of_a_document_count_once(spark):
    docs = [(1, "a line of one document\n" + " ".join(f"w{k}" for k in range(30)), "h")] * 30 + [(None, "a line without an id\n" + " ".join(f"v{k}" for k in range(30)), "h")] * 30
    got = quality.quality(table(spark, docs)).collect()
    assert len(got) == 60 and all(r["kept"] and not r["removed_words"] for r in got)
    assert quality.apply_quality(table(spark, docs)).count() == 60


def test_apply_quality_takes_hot_lines_out_and_keeps_columns(spark):
    df = table(spark, quality_docs())
    out = quality.apply_quality(df, texts_once=True)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "This very line" not in texts[5] and "# * 5 %" in texts[5] and 100 not in texts and texts[200]


def test_a_line_in_a_few_percent_of_a_large_host_is_removed(spark):
    lines = {"this line is in one of a hundred": 100, "this line is in one of twenty": 20, "this line has ten documents only": 200}
    docs = []
    for i in range(2000):
        own = [f"w{i}x{k}" for k in range(4 if i < 40 else 40)]
        docs.append((i, "\n".join([" ".join(own), *(x for x, every in lines.items() if i % every == 0)]), "large"))
    got = {r["doc_id"]: r for r in quality.quality(table(spark, docs)).collect()}
    assert all(got[i]["removed_words"] == (8 * (i % 100 == 0) + 7 * (i % 20 == 0)) for i in got)
    assert not got[0]["kept"] and not got[20]["kept"] and got[1020]["kept"]
    texts = {r["doc_id"]: r["text"] for r in quality.apply_quality(table(spark, docs)).collect()}
    assert "one of" not in "".join(texts.values()) and "ten documents only" in texts[200]


def test_quality_of_an_empty_table(spark):
    assert quality.quality(table(spark, [])).collect() == [] and quality.apply_quality(table(spark, [])).collect() == []


def test_word_kernel_handles_odd_texts():
    import pyarrow as pa

    texts = ["", None, " ", "a", "x" * 5000, "Été été", "a\x0bb\x0cc", "é" * 300 + " z"]
    data, at = kernels.buffers(pa.array(texts))
    starts, ends, first = kernels.words(data, at)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [WS.findall(t or "") for t in texts]
    sliced = pa.array(texts).slice(3, 4)
    assert [len(s) for s in kernels.shingle_sets(sliced)] == [1, 1, 1, 1]
