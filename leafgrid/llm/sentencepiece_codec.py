"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read without the SentencePiece library: its protobuf gives the
pieces with scores and types, the kind of model, and the normaliser.  From them
a tokenizers model is built: a unigram model takes the scores as they are, a BPE
model takes its merges in the order of the scores of what they make; the space
marker, the dummy prefix and byte fallback are rebuilt as the file asks.

Encoding uses that no piece has a space marker after another character: then no
token crosses the beginning of a run of spaces, and a text's tokens are those of
its units (spaces and what follows them up to the next space) in turn.  Each
batch encodes its distinct units only, by the library's threads, and a bounded
memory of units serves the batches after it.  Texts that hold the marker itself
are encoded whole, as are all texts if the pieces don't allow the cut.  Decoding
joins the bytes of the pieces; every text is decoded and compared.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers

from leafgrid.llm import common, kernels

#: The session's setting that names the model file, and the file of the registered queries where it is unset.
MODEL_CONF, REGISTERED = "spark.leafgrid.sentencepiece.model", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units that a worker remembers.
MEMORY = 1 << 18


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        value |= (x & 127) << shift
        i, shift = i + 1, shift + 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_model(data: bytes) -> Model:
    """The parts of a model file that encoding and decoding need."""
    m = Model()
    for tag, value in _fields(data):
        if tag == 1:
            piece = dict(_fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            m.types.append(piece.get(3, NORMAL))
        elif tag == 2:
            spec = dict(_fields(value))
            m.unigram, m.byte_fallback = spec.get(3, 1) == 1, bool(spec.get(35, 0))
            if spec.get(3, 1) not in (1, 2):
                raise ValueError("only unigram and BPE models are supported")
        elif tag == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.remove_extra_spaces, m.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if USER in m.types:
        raise ValueError("user-defined pieces are not supported")
    return m


def build(m: Model) -> Tokenizer:
    ids = {p: i for i, p in enumerate(m.pieces)}
    unk = m.types.index(UNKNOWN)
    if m.unigram:
        # pieces that no text may match are kept out of the lattice by their scores
        scores = [s if t in (NORMAL, BYTE) else -1e9 for s, t in zip(m.scores, m.types, strict=True)]
        model = models.Unigram(list(zip(m.pieces, scores, strict=True)), unk_id=unk, byte_fallback=m.byte_fallback)
    else:
        usable = {p for p, t in zip(m.pieces, m.types, strict=True) if t == NORMAL}
        made = []
        for p in usable:
            i = ids[p]
            made += [(-m.scores[i], i, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        made.sort(key=lambda x: x[:4])
        model = models.BPE(vocab=ids, merges=[x[4:] for x in made], unk_token=m.pieces[unk], fuse_unk=True, byte_fallback=m.byte_fallback)
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    return tok


class Codec:
    """Encodes and decodes batches of texts with one model."""

    def __init__(self, data: bytes):
        self.model = m = read_model(data)
        normal = [p for p, t in zip(m.pieces, m.types, strict=True) if t == NORMAL]
        self.cut = m.escape_spaces and m.dummy_prefix and not m.charsmap and not m.remove_extra_spaces and not any(MARK in p.lstrip(MARK) for p in normal)
        self.newline = not any("\n" in p for p in normal)
        self.unit = build(m)
        self.unit.normalizer = normalizers.Replace(" ", MARK)
        texts = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else (" ⁇ " if t == UNKNOWN else p.replace(MARK, " ")).encode() for p, t in zip(m.pieces, m.types, strict=True)]
        self.width = np.array([len(t) for t in texts], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.memory = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32))

    @cached_property
    def whole(self) -> Tokenizer:
        """For texts that can't be cut; few workers ever need it."""
        return build(self.model)

    @staticmethod
    def _flat(tok: Tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        ptr = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
        return np.fromiter((x for y in ids for x in y), dtype=np.int32, count=int(ptr[-1])), ptr

    @staticmethod
    def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """values[begin[i]:begin[i] + size[i]] for all i, joined."""
        ends = np.cumsum(size)
        return values[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - begin, size)]

    def _units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and bounds of the texts, unit by unit; data has the dummy prefix."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        space, line = data == 32, (data == 10) & self.newline
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[:n] = line
        fresh[:n] |= space
        fresh[1:n] &= ~(space[1:] & space[:-1])
        fresh[1:n] |= line[:-1]
        fresh[at] = True
        starts = np.flatnonzero(fresh[:n])
        ends = np.append(starts[1:], n)
        h, index, back = np.unique(kernels.hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        known, ptr, ids = self.memory
        where = np.searchsorted(known, h)
        hit = np.zeros(len(h), dtype=bool)
        inside = where < len(known)
        hit[inside] = known[where[inside]] == h[inside]
        raw = data.tobytes()
        new = index[~hit]
        more, bounds = self._flat(self.unit, [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        begin = np.zeros(len(h), dtype=np.int64)
        size = np.zeros(len(h), dtype=np.int64)
        begin[hit], size[hit] = ptr[where[hit]], np.diff(ptr)[where[hit]]
        begin[~hit], size[~hit] = bounds[:-1] + len(ids), np.diff(bounds)
        pool = np.concatenate([ids, more])
        tokens = self._gather(pool, begin[back], size[back])
        total = np.concatenate([[0], np.cumsum(size[back])])
        out = tokens, total[np.searchsorted(starts, at)]
        if len(known) < MEMORY and len(new):
            keys = np.concatenate([known, h[~hit]])
            order = np.argsort(keys)
            b = np.concatenate([ptr[:-1], bounds[:-1] + len(ids)])[order]
            s = np.concatenate([np.diff(ptr), np.diff(bounds)])[order]
            self.memory = keys[order], np.concatenate([[0], np.cumsum(s)]), self._gather(pool, b, s)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, joined, and each text's bounds (n + 1); null texts are empty."""
        column = column.cast(pa.large_string()).fill_null("")
        if not self.cut:
            return self._flat(self.whole, column.to_pylist())
        marked = pc.match_substring(column, MARK).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pc.or_(pa.array(marked), pc.equal(column, "")), pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        ids, ptr = self._units(*kernels.buffers(plain))
        if not marked.any():
            return ids, ptr
        odd, bounds = self._flat(self.whole, column.filter(pa.array(marked)).to_pylist())
        begin, size = ptr[:-1].copy(), np.diff(ptr)
        begin[marked], size[marked] = bounds[:-1] + len(ids), np.diff(bounds)
        return self._gather(np.concatenate([ids, odd]), begin, size), np.concatenate([[0], np.cumsum(size)])

    def decode(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, joined, and each text's bounds; the dummy prefix is taken off."""
        size = self.width[ids]
        data = self._gather(self.bytes, self.at[ids], size)
        bounds = np.concatenate([[0], np.cumsum(size)])[ptr]
        if not self.model.dummy_prefix or not len(data):
            return data, bounds
        first = bounds[:-1][bounds[1:] > bounds[:-1]]
        first = first[data[first] == 32]
        keep = np.ones(len(data), dtype=bool)
        keep[first] = False
        return data[keep], bounds - np.searchsorted(first, bounds, side="left")

    def decode_texts(self, ids: np.ndarray, ptr: np.ndarray) -> list[str]:
        data, at = self.decode(ids, ptr)
        raw = data.tobytes()
        return [raw[a:b].decode(errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """One codec a worker and model."""
    key = hash(data)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, exact) per row; ids are the model's, exact tells whether decoding them gives the text back.

    Decoding is not exact for texts that hold the space marker itself, or if the
    model normalises.  Null and empty texts have no tokens and are exact.  Long
    texts are encoded whole.  Null ids, ties and repeated rows are carried
    through; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            for p in kernels.pieces(b, "text", 4 << 20):
                ids, ptr = c.encode(p.column("text"))
                data, at = kernels.buffers(p.column("text"))
                back, bounds = c.decode(ids, ptr)
                same = np.diff(bounds) == np.diff(at)
                if same.all():
                    wrong = np.searchsorted(at, np.flatnonzero(back != data), side="right") - 1
                    same[wrong] = False
                else:
                    same &= np.array([np.array_equal(back[bounds[i] : bounds[i + 1]], data[at[i] : at[i + 1]]) for i in range(len(same))])
                yield pa.RecordBatch.from_pydict({"id": p.column("id"), "n_tokens": pa.array(np.diff(ptr)), "ids": pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(ids)), "exact": pa.array(same)})

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, n_tokens long, ids array<int>, exact boolean")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids", "exact")


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) per row of token ids, the bytes of their pieces without the dummy prefix.

    A null or empty list is an empty text.  Bytes that are no UTF-8 (byte pieces
    in an order that ``encode`` never gives) become U+FFFD.  Null ids of rows,
    ties, long lists and repeated rows are carried through; an empty table gives
    no rows; other columns are not read.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            lists = b.column("ids").to_pylist()
            ptr = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists], dtype=np.int64)]).astype(np.int64)
            ids = np.fromiter((x for y in lists for x in y or ()), dtype=np.int64, count=int(ptr[-1]))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "text": pa.array(c.decode_texts(ids, ptr), pa.string())})

    base = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def model_bytes(path: str) -> bytes:
    """The driver reads the file; executors get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def session_model(spark: SparkSession) -> bytes:
    return model_bytes(spark.conf.get(MODEL_CONF, None) or REGISTERED)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, session_model(spark)).select("doc_id", "n_tokens", "ids", "exact")
