"""Queries that are to take all of their input, against brute force on tables with what a cut would lose."""

import pytest

from leafgrid.plans import fixtures as fx
from leafgrid.plans import queries as page_queries
from leafgrid.plans import text_queries  # noqa: F401


@pytest.fixture
def tables(spark, tmp_path):
    def write(**given):
        for name, (rows, shape) in given.items():
            spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_character_errors_are_those_of_whole_texts(spark, tables):
    texts = {1: "short text of a few words", 2: " ".join(f"word{i:03d}" for i in range(90)), 3: " ".join(f"é{i}" for i in range(80))}
    d = tables(benchmark=(list(texts.items()), "item_id long, text string"))
    want = {}
    for i, text in texts.items():
        got = [w[:-1] if n % 11 == 0 else w + "x" if n % 17 == 0 else w for n, w in enumerate(text.split())]
        truth, read = (t.replace("é", "?") for t in (text, " ".join(got)))
        want[i] = (edits(truth, read), len(truth))
    assert {r["item_id"]: (r["edits"], r["size"]) for r in page_queries.QUERIES["cer"](spark, d).collect()} == want


def test_one_edit_matches_have_no_upper_length(spark, tables):
    d = tables(documents=([(1, "misinterpretatiom ok"), (2, "housez housex internationalizatio"), (3, "abc thousandfol")], "doc_id long, text string"),
               benchmark=([(1, "misinterpretation internationalization"), (2, "house thousandfold abd")], "item_id long, text string"))
    codes, known = ["misinterpretatiom", "internationalizatio", "housez", "housex", "thousandfol"], ["misinterpretation", "internationalization", "house", "thousandfold"]
    near = {c.upper(): [k.upper() for k in known if edits(c, k) == 1] for c in codes}
    want = {c: k[0] for c, k in near.items() if len(k) == 1}
    assert len(want) == 5 and {r["code"]: r["fixed"] for r in page_queries.QUERIES["edit1_matches"](spark, d).collect()} == want


def test_figures_go_only_if_a_larger_one_covers_four_fifths(spark):
    d = "/root/testdata/sf0.001"
    pages = {}
    for r in fx.figures(spark, d).select("doc_id", "seg", "x0", "y0", "x1", "y1").collect():
        pages.setdefault(r["doc_id"], []).append(r)

    def area(r):
        return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])

    def over(a, b):
        return max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))

    def kept(num):
        return {(a["doc_id"], a["seg"]) for page in pages.values() for a in page if not any(area(b) > area(a) and over(a, b) * 5 > area(a) * num for b in page)}

    got = {(r["doc_id"], r["seg"]) for r in page_queries.QUERIES["nms_boxes"](spark, d).collect()}
    assert kept(1) < kept(4) == got, (len(kept(1)), len(got))
    print("figures", len(kept(1)), len(got))


def test_evidence_is_the_same_whether_phrases_are_broadcast_or_joined(spark):
    from leafgrid.operators import lexicon as X

    words = "a b c a b d e a b c".split()
    tokens = spark.createDataFrame([(1, i // 6, i, w) for i, w in enumerate(words)], "doc_id long, line_no long, word_no long, token string")
    phrases = spark.createDataFrame([("a b", False), ("a b c", True), ("d e", False), ("a b", True)], "phrase string, domain boolean")
    lines = {n: [w for i, w in enumerate(words) if i // 6 == n] for n in (0, 1)}
    want = {}
    for n, line in lines.items():
        for i in range(len(line)):
            found = [(k, p in ("a b", "a b c")) for k in (2, 3) for at in range(i - k + 1, i + 1) if at >= 0 and (p := " ".join(line[at : at + k])) in ("a b", "a b c", "d e") and at + k <= len(line)]
            want[n, n * 6 + i] = (max([f[0] for f in found], default=0), any(f[1] for f in found))
    for most in (100, 0):
        got = {(r["line_no"], r["word_no"]): (r["size"], r["domain"]) for r in X.evidence(tokens, phrases, ["doc_id", "line_no"], most=most).collect()}
        assert got == want
