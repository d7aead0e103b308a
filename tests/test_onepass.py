"""Whole pages in one pass against the operators in their order."""

import numpy as np
import pyarrow as pa
import pytest

from leafgrid.operators import onepass
from leafgrid.plans import assembly
from leafgrid.plans import fixtures as fx
from leafgrid.plans import queries as page_queries

ODD = [
    "|", "¦", "®x", ".", ",", ":", "'", "`", "¡", "7", "12", "12,", "3)", "a1", "Ⅷ", "²", "_", "__", "~_~", "_ab_", "~.", "¯|", "ấm", "Đường", "İ", "ſ", "K", "日本語", "ß", "a\r", "12.\r", "\r", "x ", "7\u0085",
    "nhà-cửa", "word", "another", "é", "😀", " ", "\ttab", "()", "“q”", "a_b", "x٣",
]
NAMES = ["doc_id", "block", "place", "text", "align", "size", "level", "bold"]


def rows(df):
    assert df.columns == NAMES
    return sorted(map(repr, map(tuple, df.collect())))


def tables(spark, at):
    return fx.words(spark, at).drop("bold"), fx.cells(spark, at), fx.figures(spark, at)


def odd_documents(spark, at):
    """Texts of odd words and lines, of none, and of nothing; odd ids."""
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "\n", "\n\n  \n", "word", " word", "word \n", "|", ". . .\nabc", " \n  a  b \n\n c\n"]
    for lines in (1, 2, 9, 30):
        for most in (1, 4, 40):
            for _ in range(3):
                texts.append("\n".join((" " * int(rng.integers(1, 3))).join(rng.choice(ODD, rng.integers(0, most + 1))) for _ in range(lines)))
    texts.append(" ".join(rng.choice(ODD, 3000)))
    ids = [*range(len(texts) - 4), -5, -1_000_003, 1 << 40, None]
    spark.createDataFrame([(i, t) for i, t in zip(ids, reversed(texts), strict=True)], "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")


def test_page_assembly_shuffles_no_word_and_runs_nothing_ahead(spark):
    spark.sparkContext.setJobGroup("assembly", "no job before the rows are asked for")
    try:
        df = page_queries.QUERIES["page_assembly"](spark, "/root/testdata/sf0.001")
        # reading the files' footers for the schema is a job
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("assembly")) <= 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "MapInArrow" in plan


def test_odd_documents_are_assembled_as_by_the_operators(spark, tmp_path):
    odd_documents(spark, str(tmp_path))
    docs = fx.read(spark, str(tmp_path), "documents")
    want = rows(assembly.assemble(*tables(spark, str(tmp_path))))
    assert len(want) > 300 and rows(page_queries.QUERIES["page_assembly"](spark, str(tmp_path))) == want
    # pages are cut to chunks, the smallest of one page
    assert rows(onepass.assemble(docs, fx.pages, chunk=1)) == want == rows(onepass.assemble(docs.coalesce(1), fx.pages, chunk=700))


def test_a_sample_of_documents_is_assembled_as_by_the_operators(spark):
    at = "/root/testdata/sf0.001"
    want = rows(assembly.assemble(*[t.where("doc_id % 4 = 1") for t in tables(spark, at)]))
    assert want and rows(page_queries.QUERIES["page_assembly"](spark, at).where("doc_id % 4 = 1")) == want


@pytest.mark.parametrize("seed", range(6))
def test_any_boxes_are_assembled_as_by_the_operators(spark, seed):
    """Words out of order, of differing heights and sizes, areas over several lines, photos, pages without areas or measured weight.

    Odd seeds have coarse numbers, so that many fall on a rule's limit.
    """
    rng = np.random.default_rng(seed)
    words, pages, step = [], 24, 10 if seed % 2 else 1

    def some(low, high):
        return int(rng.integers(low, high)) // step * step

    for page in range(pages):
        for line in rng.choice(40, rng.integers(1, 12), replace=False):
            x, top = some(0, 300), int(line) * 30 + (some(-40, 40) if page % 6 else 0)
            tall = some(20, 60)
            for no in range(rng.integers(1, 14)):
                wide = some(step, 120)
                high = tall if page % 3 else some(step, 90)
                ratio = int(rng.choice([0, 100, 100, 100, 100, 124, 126, 129, 131, 161] if seed % 2 else [0, *range(90, 140)])) if page % 4 else 0
                word = str(rng.choice(ODD if rng.random() < 0.5 else ["word", "another", "nhà-cửa", "it", "an"]))
                conf = int(rng.choice([0, 2, 3, 15, 35, 39, 40, 55, 60, 75, 85, 90, 95, 100]) if rng.random() < 0.5 else rng.integers(70, 101))
                words.append((page, int(line), no, word, conf, ratio, tall if page % 2 else some(10, 60), x, top, x + wide, top + high))
                x = x + wide + int(rng.choice([2, 6, 10, 40, 160])) // min(step, 2) if page % 5 else some(0, 900)
    words.sort(key=lambda r: r[:3])

    def boxes(n, most):
        x, y, w, h = (rng.integers(low, high, n) // step * step for low, high in ((0, 900), (-20, 1200), (-5, most), (0, most)))
        return np.sort(rng.integers(2, pages, n)), x, y, x + w, y + h

    cells, figures = boxes(40, 150), boxes(60, 300)
    photos = rng.integers(0, 3, 60) == 0
    assert len(compared(spark, words, cells, figures, photos, pages)) > 100


def test_headings_are_those_of_the_operators(spark):
    """Large blocks of one to five lines and of 60 to 200 characters, and bold ones in the middle, above and below the limits of a heading."""
    words, page = [], 0
    for size in (20, 24, 25, 40):
        for lines in (1, 3, 4):
            for each in (2, 6, 7, 19, 20, 21):
                for ratio in (100, 140):
                    for line in range(20):
                        words += [(page, line, no, "another", 95, 100, 20, 100 + 80 * no, 30 * line, 170 + 80 * no, 30 * line + 20) for no in range(12)]
                    for line in range(lines):
                        at = 580 - 4 * size * each // 2
                        words += [(page, 100 + line, no, "another", 95, ratio, size, at + 4 * size * no, 5000 + 3 * size * line // 2, at + 4 * size * no + size * 7 // 2, 5000 + 3 * size * line // 2 + size) for no in range(each)]
                    page += 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    levels = [r[6] for r in compared(spark, words, none, none, np.zeros(0, bool), page)]
    assert {None, 0, 1} == set(levels) and min(map(levels.count, (0, 1))) >= 6


def compared(spark, words, cells, figures, photos, pages):
    """The blocks, once both forms agree on them."""
    box = "x0 long, y0 long, x1 long, y1 long"
    frames = [
        spark.createDataFrame(words, f"doc_id long, line_no int, word_no int, word string, conf long, ratio long, x_size int, {box}"),
        spark.createDataFrame([tuple(map(int, r)) for r in zip(*cells, strict=True)], f"doc_id long, {box}"),
        spark.createDataFrame([(*map(int, r), bool(p)) for *r, p in zip(*figures, photos, strict=True)], f"doc_id long, {box}, photo boolean"),
    ]
    want = rows(assembly.assemble(*frames))
    coded = pa.array([r[3] for r in words]).dictionary_encode()
    page, line, no, _, *rest = (np.array(v) for v in zip(*words, strict=True))
    given = onepass.Pages(onepass.Words(page, line, no, np.asarray(coded.indices), *rest), coded.dictionary, onepass.Areas(*cells), onepass.Areas(*figures), photos)
    found = onepass.blocks(given, pages)
    mine = list(zip(*[v.tolist() if isinstance(v, np.ndarray) else v.to_pylist() for v in found.values()], strict=True))
    assert sorted(map(repr, mine)) == want
    return mine
