import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from leafgrid.llm import chat, toxicity
from leafgrid.llm import sentencepiece_codec as spc

# --- chat ---------------------------------------------------------------------

CHAT = [
    (1, 0, "user", "Hi"), (1, 1, "assistant", "Hello </turn>\n<turn>### user: x"), (1, 2, "assistant", None),
    (2, 1, "assistant", r"\### Assistant: </turn> ok \s \\h"), (2, 0, "system", "back\\slash \\ and # ## ###"),
    (3, None, None, ": ### :"), (3, 0, "a: b</turn>", "<turn"), (3, 0, "a: b</turn>", "<turn"), (3, 0, "a", "tie"),
    (None, 0, "user", ""), (4, 0, "assistant", "é🙂\n" * 20000), (4, 1, "user", "</turn" * 3000 + "\\" * 3001),
]


def chats(spark, rows=CHAT):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, made string, n int")


def test_chats_read_back_and_mask_the_assistant(spark):
    got = {r["conv_id"]: r for r in chat.format_chats(chats(spark)).withColumn("loss", chat.learned(chat.F.col("formatted"), chat.F.col("loss_spans"))).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(CHAT, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
    assert got[1]["formatted"].count("</turn>") == 3 and got[2]["formatted"].count("###") == 2


def test_plain_turns_are_not_escaped_and_no_rows_give_none(spark):
    r = chat.format_chats(chats(spark, [(1, 0, "user", "plain \\ text # 1 < 2")])).first()
    assert r["formatted"] == "<turn>### user: plain \\ text # 1 < 2</turn>"
    assert chat.format_chats(chats(spark, [])).collect() == []


def test_parser_refuses_what_the_grammar_does_not_allow(spark):
    bad = ["<turn>### user: a", "<turn>### user a</turn>", "x<turn>### user: a</turn>", "<turn>### u: a</turn><turn>### u: b</turn>", "<turn>### u: a ### b</turn>"]
    rows = spark.createDataFrame([(b,) for b in bad], "t string").select(chat.parse(chat.F.col("t")).alias("p")).collect()
    assert all(r["p"] is None or None in r["p"] for r in rows)


# --- tokens -------------------------------------------------------------------

ODD = ["", " ", "  a  b\n c\n", "a▁b c", "\n\n", "日本語 テキスト 🙂", "a" * 3000 + " b", "<s> </s> <unk> <0x0A>", "tab\tx\r\n y", None, " lead", "trail ", "x\x00y", "é é", "　wide", "word " * 4000, "▁▁ x"]


def texts():
    import duckdb

    rows = duckdb.execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    return ODD + [r[0] for r in rows]


def test_tokens_equal_those_of_the_reference_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spc.REGISTERED)
    codec = spc.Codec(spc.model_bytes(spc.REGISTERED))
    assert codec.cut and codec.newline
    all_texts = texts()
    for part in (all_texts[:20], all_texts[20:120], all_texts[20:], all_texts[:20]):  # the memory serves later ones
        ids, ptr = codec.encode(pa.array(part, pa.string()))
        back = codec.decode_texts(ids, ptr)
        for i, t in enumerate(part):
            mine = ids[ptr[i] : ptr[i + 1]].tolist()
            assert mine == sp.encode(t or ""), repr(t)[:80]
            assert back[i] == sp.decode(mine)
            assert back[i] == (t or "") or "▁" in t


def test_whole_text_encoding_gives_the_same(monkeypatch):
    codec = spc.Codec(spc.model_bytes(spc.REGISTERED))
    want = codec.encode(pa.array(ODD, pa.string()))
    codec.cut = False
    got = codec.encode(pa.array(ODD, pa.string()))
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])


def _piece(text, score, kind=1):
    body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + np.float32(score).tobytes() + (b"\x18" + bytes([kind]) if kind != 1 else b"")
    return b"\x0a" + bytes([len(body)]) + body


def _unigram():
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -2, 1), ("▁a", -1.5, 1), ("ab", -2.5, 1), ("b", -3, 1), ("a", -3.2, 1), ("▁ab", -2.2, 1), ("c", -4, 1)] + [(f"<0x{i:02X}>", -20, 6) for i in range(256)]
    trainer = b"\x18\x01\x98\x02\x01"  # unigram, byte fallback
    return b"".join(_piece(*p) for p in pieces) + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a\x04\x18\x01\x20\x00"


def test_a_unigram_model_is_read_and_matches(spark):
    import sentencepiece

    data = _unigram()
    model = spc.read_model(data)
    assert model.unigram and model.byte_fallback and model.pieces[4] == "▁a" and model.scores[4] == -1.5 and not model.remove_extra_spaces
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = spc.Codec(data)
    rng = random.Random(3)
    sample = ["".join(rng.choice("aabbc zé\n") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    ids, ptr = codec.encode(pa.array(sample))
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == [sp.encode(s) for s in sample]
    # through the operator, whole texts, nulls and repeated rows
    rows = [*enumerate(sample), (500, None), (501, ""), (502, "ab é cab\n" * 5000), (None, "a b"), (3, sample[3])]
    out = spc.encode(spark.createDataFrame(rows, "doc_id long, text string"), data)
    texts = {i: t or "" for i, t in rows}
    got = out.collect()
    assert len(got) == len(rows) and all(r["ids"] == sp.encode(texts[r["doc_id"]]) and r["exact"] for r in got)
    back = spc.decode(out, data).collect()
    assert len(back) == len(rows) and all(r["text"] == texts[r["doc_id"]] for r in back)


def test_encode_and_decode_tables(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x y", 1), (2, ODD[2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = spc.encode(df, spc.model_bytes(spc.REGISTERED))
    got = out.collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if not r["exact"]} == {3, 16}
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    back = {r["doc_id"]: r["text"] for r in spc.decode(out, spc.model_bytes(spc.REGISTERED)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD) if i not in (3, 16))
    assert spc.encode(df.limit(0), spc.model_bytes(spc.REGISTERED)).collect() == []


# --- toxicity -----------------------------------------------------------------


def toxic_rows(n=1500, seed=2):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    bad = ["vile", "Nasty", "awful", "gross", "mean"]
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if y:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(y), "x"))
    return rows, labels


def test_held_out_accuracy_of_the_chain(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, y double")
    told = spark.createDataFrame(labels[:1000] + [(5, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    chain = toxicity.fit(docs, told, sample=900)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    held = labels[1000:]
    right = sum(got[i]["toxic"] == bool(y) for i, y, _ in held)
    assert right >= 0.98 * len(held) and np.mean([got[i]["toxic"] for i, y, _ in held if y]) >= 0.95
    low = np.mean([got[i]["p_severe"] for i, y, _ in held if y and len(set(re.findall("vile|Nasty|awful|gross|mean", rows[i][1]))) <= 1])
    high = np.mean([got[i]["p_severe"] for i, y, _ in held if y and len(set(re.findall("vile|Nasty|awful|gross|mean", rows[i][1]))) >= 4])
    assert high > low + 0.3 and chain.categories[-1] == "toxic" and all(chain.links[3, :3] > 0)
    again = toxicity.fit(docs, told, sample=900)
    assert np.array_equal(again.words, chain.words)


def test_toxicity_of_odd_rows_and_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "vile " * 50000), (None, "x"), (3, "vile " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == 5 and not any(r["toxic"] for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).collect() == []


def test_the_verdict_hangs_on_the_links(spark):
    """Forms of known stems that training never saw: whole words say nothing of them, the earlier categories do."""
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]
    stems = ["hatef", "vilen", "awfulm", "grossn"]
    rows, labels = [], []
    for i in range(900):
        y = i % 4 == 0
        # one in two toxic documents has forms of its own, as have all held-out ones
        own = i % 8 == 0 or i >= 600
        bad = [rng.choice(stems) + (f"x{i}" if own else rng.choice(["ess", "ul"])) for _ in range(5 * y)]
        words = [rng.choice(plain) for _ in range(40)] + bad
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))

    def caught(c):
        return {r["doc_id"] for r in toxicity.score(docs.where("doc_id >= 600"), c).where("toxic").collect()}

    want = {i for i, y in labels[600:] if y}
    with_links = caught(chain)
    assert len(with_links & want) >= 0.95 * len(want) and len(with_links - want) <= 2
    chain.links = np.zeros_like(chain.links)
    assert len(caught(chain) & want) <= 0.2 * len(want)


def test_out_of_fold_probabilities_know_nothing_of_their_fold():
    """With labels dealt at random, features and markers chosen on all rows would seem to tell the held-out rows' labels."""
    rng = np.random.default_rng(3)
    n, d = 500, 400
    x = (rng.random((n, d)) < 0.1).astype(np.float32)
    y, folds = (rng.random(n) < 0.3).astype(np.int64), np.arange(n) % toxicity.FOLDS
    words = np.arange(2, d + 2, dtype=np.uint64)
    chain = toxicity.learn(x, y, folds, words)
    # no threshold finds the positives among out-of-fold probabilities of noise: the best F1 is that of calling most positive
    assert chain.threshold < y.mean() + 0.1


def plain_choice(sets, y, folds):
    """Features that tell most, by plain counts, without each fold and over all rows."""
    out = {}
    for f in range(toxicity.FOLDS + 1):
        rows = [(set(s.tolist()), v) for s, v, g in zip(sets, y, folds, strict=True) if g != f]
        rate = sum(v for _, v in rows) / len(rows)
        gain = {}
        for w in set().union(*(s for s, _ in rows)):
            n = sum(w in s for s, _ in rows)
            if n >= 4:
                gain[w] = (sum(v for s, v in rows if w in s) - rate * n) ** 2 / (n * rate * (1 - rate))
        for odd in (0, 1):
            out[f, odd] = {w for w, g in gain.items() if g >= toxicity.GAIN and w % 2 == odd}
    return out


def test_telling_words_match_a_plain_count(spark):
    rows, labels = toxic_rows(300, 4)
    sets = list(toxicity.word_sets(pa.array([r[1] for r in rows])))
    y, folds = [x[1] for x in labels], [i % toxicity.FOLDS for i in range(300)]
    df = spark.createDataFrame([(v, f, bytearray(s.tobytes())) for v, f, s in zip(y, folds, sets, strict=True)], "y int, fold int, words binary")
    want = plain_choice(sets, y, folds)
    found, allowed = toxicity.telling_words(df)
    assert found.tolist() == sorted(set().union(*want.values())) and toxicity.stems(found).any() and not toxicity.stems(found).all()
    for f in range(toxicity.FOLDS + 1):
        assert set(found[allowed[f]].tolist()) == want[f, 0] | want[f, 1]


def test_cut_takes_the_best_f1():
    p, y = np.array([0.9, 0.8, 0.4, 0.3, 0.2, 0.05]), np.array([1, 1, 1, 0, 0, 0])
    assert toxicity.cut(p, y) == pytest.approx(0.35)
    assert toxicity.cut(p, 0 * y) == 0.5 and toxicity.cut(p, 0 * y + 1) == 0.1


def test_training_counts_features_on_the_cluster(spark, monkeypatch):
    counted = []
    plain = toxicity.telling_words
    monkeypatch.setattr(toxicity, "telling_words", lambda rows, *a: counted.append(rows.count()) or plain(rows, *a))
    docs = spark.createDataFrame([(i, f"plain text {i}" + " vile nasty" * (i % 2)) for i in [*range(60), 7, 7]], "doc_id long, text string")
    told = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    toxicity.fit(docs, told)
    assert counted == [60]  # repeated rows once
