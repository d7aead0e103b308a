"""N-gram Jaccard join: grouped prefix join over word shingles.

A set's shingles are ordered from rare to frequent (a count sketch over all
documents gives the order, ties by hash; any total order is right, a
good one is fast).  Two sets can only reach the threshold if they share a
shingle within their prefixes, at places that leave room for the overlap.
Documents with identical prefixes and size form one group and enter the
inverted lists once; group pairs are filtered by size and place, then expanded
to their members and verified on the whole sets.

Only components are asked for, so no list is expanded into all its pairs:

1. every list links its members to one of them (a star), every group its
   members to their first; these pairs are verified and give components;
2. in lists that still hold more than one component, all pairs between
   different components that pass the filters are verified as well.  A pair
   within a component can't change the result, every other candidate has now
   been checked: no link that matters is lost.

Lists that the sketch knows to be hot are split by a salt; the stars of the
parts meet in a second, small star.

The posts are the largest shuffle by far and most are alone in their lists:
they go in slices of the shingles' range, one after the other, and only lists
with more members stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.llm import common, kernels

#: Counters of the sketch and bits of a bitmap: a power of two with so many for each row, between these limits (128 MB).
SKETCH_ROW, SKETCH_LEAST, SKETCH_MOST = 8, 1 << 21, 1 << 24
BITS_ROW, BITS_LEAST, BITS_MOST = 32, 1 << 25, 1 << 30
#: Expected members of one part of a hot list.
PART = 4096
#: The most slices of the posts; there is one for so many documents, rounded up to a power of two.
SLICES, SLICE_ROWS = 4, 10_000


def _power(n: int, least: int, most: int) -> int:
    """The power of two from n up, between two others."""
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _order(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
    o = np.lexsort((s, f))
    return s[o], f[o]


def _prints(s: np.ndarray, n: int) -> tuple[int, int]:
    """128 bits of a hash array, as two signed longs."""
    x = xxhash.xxh3_128_intdigest(s.tobytes(), seed=n)
    a, b = x >> 64, x & (2**64 - 1)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _required(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes m and n that link."""
    return -(-(m + n) * percent // (100 + percent))


def _fits(m, p, n, q, percent: int) -> np.ndarray:
    """Whether sets of sizes m and n that share the shingle at places p and q of their orders can link, if it is their first common one."""
    return (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (np.minimum(m - p, n - q) >= _required(m, n, percent))


def _pairs(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of lists (rows sorted by list and size): the pairs of different components that fit; lists of two parts pair across them only."""
    c = {x: t.column(x).to_numpy() for x in ("token", "part", "other", "node", "label", "n", "p", "side")}
    new = np.ones(len(c["token"]), dtype=bool)
    new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["part"][1:] != c["part"][:-1]) | (c["other"][1:] != c["other"][:-1])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(new)))
    left, right = [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        ok = (c["label"][i] != c["label"][j]) & _fits(c["n"][i], c["p"][i], c["n"][j], c["p"][j], percent)
        ok &= (c["part"][i] == c["other"][i]) | (c["side"][i] != c["side"][j])
        left.append(c["node"][i[ok]])
        right.append(c["node"][j[ok]])

    small = size <= 64
    end = np.repeat(starts + size, size)
    i = np.flatnonzero(np.repeat(small, size))
    step = 1
    while len(i):
        i = i[i + step < end[i]]
        take(i, i + step)
        step += 1
    for a, k in zip(starts[~small], size[~small], strict=True):
        # rows of a list are sorted by size: no row links with one beyond its limit
        upto = a + np.searchsorted(c["n"][a : a + k], c["n"][a : a + k].astype(np.int64) * 100 // percent, side="right")
        for x in range(a, a + k - 1):
            j = np.arange(x + 1, upto[x - a])
            take(np.full(len(j), x), j)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return both[0], both[1]


def _stream_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """_pairs over a sorted partition, a few lists at a time."""

    def out(t: pa.Table) -> pa.RecordBatch:
        a, b = _pairs(t, percent)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = [b.column(x).to_numpy() for x in ("token", "part", "other")]
        differ = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]) | (c[2] != c[2][-1]))
        cut = int(differ[-1]) + 1 if len(differ) else 0  # where the batch's last list begins
        last = kept[-1] if kept else None
        if last is not None and any(last.column(x)[-1].as_py() != b.column(x)[0].as_py() for x in ("token", "part", "other")):
            yield out(pa.Table.from_batches(kept))
            kept = []
        if cut:
            yield out(pa.Table.from_batches([*kept, b.slice(0, cut)]))
            kept = []
        kept.append(b.slice(cut))
    if kept:
        yield out(pa.Table.from_batches(kept))


def _bits(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = kernels.mix(ids.view(np.uint64)) % np.uint64(size)
    return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap over hashed ids.  It only spares work: what it lets through wrongly, a join or a check drops."""
    size = _power(ids.count() * BITS_ROW, BITS_LEAST, BITS_MOST)

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros(size // 8, dtype=np.uint8)
        for b in batches:
            byte, bit = _bits(b.column("id").to_numpy(), size)
            np.bitwise_or.at(seen, byte, bit)
        return seen

    return common.merged(ids.select("id"), mark, size // 8, "uint8", "or")


def _among(b: pa.RecordBatch, seen: np.ndarray) -> pa.RecordBatch:
    byte, bit = _bits(b.column("id").to_numpy(), len(seen) * 8)
    return b.filter(pa.array((seen[byte] & bit) > 0))


def _strings(texts: list[bytes]) -> pa.Array:
    """A column of texts whose bytes are taken as they are."""
    return pa.array(texts, pa.binary()).view(pa.string())


def _unpacked(b: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with a packed column's texts, each ended by the row that brings ``most`` bytes."""
    begin, texts, size = 0, [], 0
    for i, x in enumerate(b.column(column)):
        texts.append(zlib.decompress(x.as_py()))
        size += len(texts[-1])
        if size >= most or i + 1 == b.num_rows:
            yield b.slice(begin, len(texts)), _strings(texts)
            begin, texts, size = i + 1, [], 0
    kernels.release()


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link, from the whole text of one document of each class.

    Texts are shorter than their shingle hashes, so texts travel, packed, and
    the sets are made where a pair meets.  A text's own set tells its node, so
    it needs no join to get there.
    """
    if pairs.isEmpty():
        return pairs.select("a", "b")
    chain = common.Chain(docs.sparkSession)
    wanted = chain(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(classes.select("node", "id"), "node"), "wanted")
    seen = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("id").union(wanted.select("node"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in kernels.pieces(_among(b, seen.value), "text"):
                # two texts under one id: the other one is of another node
                nodes = pa.array([_prints(s, len(s))[1] for s in kernels.shingle_sets(p.column("text"), k)], pa.int64())
                p = _among(pa.RecordBatch.from_arrays([nodes, p.column("text")], names=["id", "text"]), seen.value)
                data, at = kernels.buffers(p.column("text"))
                yield pa.RecordBatch.from_arrays([p.column("id"), pa.array([zlib.compress(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "text"])

    # one text of each node, dealt once for both ends of the pairs
    texts = chain(docs.mapInArrow(pack, "node long, text binary"), "texts").dropDuplicates(["node"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b, texts in (p for whole in batches for p in _unpacked(whole, "x")):
            ok = np.zeros(b.num_rows, dtype=bool)
            nodes = b.column("b").to_pylist()
            for i, s in enumerate(kernels.shingle_sets(texts, k)):
                if nodes[i] != last:  # rows of a node mostly follow each other
                    last, own = nodes[i], next(kernels.shingle_sets(_strings([zlib.decompress(b.column("y")[i].as_py())]), k))
                n = len(np.intersect1d(s, own, assume_unique=True))
                ok[i] = 100 * n >= percent * (len(s) + len(own) - n)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return chain(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct(), "links")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set
    holds its distinct ``words``-word shingles, or its whole sequence if it has
    fewer words.  Documents whose Jaccard similarity is at least ``percent``
    hundredths link; component_id is the smallest id reachable by links.

    Null and empty texts have empty sets and link with nothing, so they are
    their own component.  Repeated rows get equal results.  A null id can be
    neither smallest nor reached: its component is null.  Ids must be integers.
    An empty table gives no rows; other columns are not read.

    Rows of one id with different texts are documents that share its place: each
    has its own set and links, and lends its id to its component.

    Sets are compared as 64-bit shingle hashes, equal sets found by 128 bits.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = base.where("id is not null")
    many = known.count()
    cells = _power(many * SKETCH_ROW, SKETCH_LEAST, SKETCH_MOST)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(cells, dtype=np.int64)
        for b in batches:
            for p in kernels.pieces(b, "text"):
                sets = list(kernels.shingle_sets(p.column("text"), words))
                if sets:
                    total += np.bincount((np.concatenate(sets) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        return total

    counts = common.merged(known.select("text"), count, cells, "int64")
    mean = int(counts.sum()) // cells
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in kernels.pieces(b, "text"):
                rows = []
                for s in kernels.shingle_sets(piece.column("text"), words):
                    n = len(s)
                    if not n:
                        rows.append((0, 0, 0, 0, None, None))
                        continue
                    high, node = _prints(s, n)
                    o, f = _order(s, shared.value)
                    o, f = (x[: n - -(-n * percent // 100) + 1] for x in (o, f))
                    parts = np.clip((f.astype(np.int64) - mean) // PART + 1, 1, 1 << 20).astype(np.int32)
                    rows.append((n, high, node, _prints(o, n)[1], o.tobytes(), parts.tobytes() if parts.max() > 1 else None))
                names = ["n", "high", "node", "grp", "prefix", "parts"]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_pydict({"id": piece.column("id")} | {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))})

    chain = common.Chain(docs.sparkSession)
    signed = chain(known.mapInArrow(sign, "id long, n int, high long, node long, grp long, prefix binary, parts binary"), "signed")
    sets = common.materialize(signed.select("id", "n", "node", "high"), "sets")
    # classes of equal sets, groups of equal prefix and size; every document's group
    classes = common.materialize(signed.where("n > 0").groupBy("node", "high", "grp", "n").agg(F.min("id").alias("id")), "classes")
    groups = common.materialize(classes.groupBy("grp", "n").agg(F.min(F.struct("node", "id")).alias("first"), F.count(F.lit(1)).alias("members")).select("grp", "n", "first.node", "first.id", "members"), "groups")
    shown = docs.sparkSession.sparkContext.broadcast(_bitmap(groups))
    # one row for each group posts its prefix: the bitmap spares most others the way, the join settles the rest
    heads = groups.select("id", "n", "grp", F.col("node").alias("head"))
    some = signed.where("n > 0").select("id", "n", "grp", "prefix", "parts").mapInArrow(lambda it: (_among(b, shown.value) for b in it), "id long, n int, grp long, prefix binary, parts binary")
    posting = chain(some.dropDuplicates(["id", "n", "grp"]).join(heads, ["id", "n", "grp"]).select("id", "head", "n", "prefix", "parts"), "posting")
    slices = _power(many // SLICE_ROWS, 1, SLICES)

    def post(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                piece = b.slice(i, 512)
                prefix = [np.frombuffer(x.as_py(), np.uint64) for x in piece.column("prefix")]
                size = np.array([len(x) for x in prefix], dtype=np.int64)
                head, ids = (np.repeat(piece.column(c).to_numpy(), size) for c in ("head", "id"))
                n = np.repeat(piece.column("n").to_numpy(), size)
                p = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
                parts = np.concatenate([np.ones(k, np.int32) if x is None else np.frombuffer(x, np.int32) for k, x in zip(size, piece.column("parts").to_pylist(), strict=True)])
                part = np.where(parts > 1, 1 + (kernels.mix(head.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32), 0).astype(np.int32)
                token = np.concatenate(prefix)
                here = (token >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32) == number
                yield pa.RecordBatch.from_pydict({"token": _i64(token[here])} | {c: pa.array(x[here]) for c, x in (("part", part), ("id", ids), ("head", head), ("n", n), ("p", p))})

    # lists with two members or more, each with its member of the smallest id, as a rule the text that others were made
    # from; parts of hot lists count from 1 and may have one
    over = Window.partitionBy("token", "part")

    def starred(number: int) -> DataFrame:
        posts = posting.mapInArrow(lambda it: post(it, number), "token long, part int, id long, head long, n int, p int")
        both = posts.withColumns({"c": F.min(F.struct("id", "head", "n", "p")).over(over), "k": F.count(F.lit(1)).over(over)})
        return both.where("k > 1 or part > 0").select("token", "part", "id", "head", "n", "p", "c")

    lists = chain.joined((starred(i) for i in range(slices)), "lists")
    # the first members of a hot list's parts meet at the first of them
    split = lists.where("part > 0 and head = c.head").select("token", "c")
    tops = split.groupBy("token").agg(F.min("c").alias("t"))
    stars = lists.select(F.struct("id", "head", "n", "p").alias("m"), "c").union(split.join(tops, "token").select(F.col("c").alias("m"), F.col("t").alias("c")))
    fits = f"100 * least(m.n, c.n) >= {percent} * greatest(m.n, c.n) and least(m.n - m.p, c.n - c.p) * {100 + percent} >= {percent} * (m.n + c.n)"
    stars = stars.where("m.head <> c.head").where(fits).select(F.least("m.head", "c.head").alias("a"), F.greatest("m.head", "c.head").alias("b"))
    # members of a group: their prefixes agree, so the star's centre is the group's first
    several = groups.where("members > 1").select("grp", "n", F.col("node").alias("head"))
    within = classes.join(several, ["grp", "n"]).where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    first = common.materialize(stars.union(within).distinct(), "stars")
    links = _verified(first, known, classes, words, percent)
    labels = common.components(links)

    # lists that still hold several components, group by group expanded to their members
    members = common.materialize(classes.join(labels, "node", "left").select("grp", "n", "node", F.coalesce("label", "node").alias("label")), "members")
    own = members.join(several.select("grp", "n"), ["grp", "n"]).selectExpr("grp as token", "0 as part", "node", "label", "n", "0 as p")
    expand = members.join(heads.select("grp", "n", "head"), ["grp", "n"]).select("head", "node", "label")
    rows = chain(lists.select("token", "part", "head", "n", "p").join(expand, "head").select("token", "part", "node", "label", "n", "p").union(own), "rows")
    told = common.materialize(rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("part").alias("top"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit("list"), "node")).alias("s2"), F.count(F.lit(1)).alias("k"), F.min(F.struct("node", "p")).alias("f")).where("lo <> hi"), "told")
    # near copies share many shingles, whose lists have the same members: of such lists the first in the order stands for
    # all, as a pair's first common shingle is the one whose place tells most
    alike = told.where("top = 0").groupBy("s1", "s2", "k").agg(F.min(F.struct("f.p", "token")).alias("best")).select("best.token", F.lit(0).alias("top"))
    mixed = alike.union(told.where("top > 0").select("token", "top"))
    # every part meets itself and every other part of its list once
    met = rows.join(mixed, "token").selectExpr("token", "node", "label", "n", "p", "part as side", "explode(sequence(if(top > 0, 1, 0), top)) as x").selectExpr("token", "least(side, x) as part", "greatest(side, x) as other", "node", "label", "n", "p", "side")
    key = ["token", "part", "other"]
    more = met.repartition(*key).sortWithinPartitions(*key, "n").mapInArrow(lambda it: _stream_pairs(it, percent), "a long, b long")
    second = common.materialize(more.distinct().join(first, ["a", "b"], "left_anti"), "second")
    chain.drop()
    extra = _verified(second, known, classes, words, percent)
    # components that a second link joins, as nodes of a smaller graph
    ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
    joined = extra.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = common.components(joined).select(F.col("node").alias("of"), F.col("label").alias("top"))

    classed = classes.join(labels, "node", "left").select("node", "high", "id", F.coalesce("label", "node").alias("own")).join(merged, F.col("own") == F.col("of"), "left").select("node", "high", "id", F.coalesce("top", "own").alias("label"))
    least = classed.groupBy("label").agg(F.min("id").alias("component_id"))
    named = classed.join(least, "label").select("node", "high", "component_id")
    out = sets.join(named, ["node", "high"], "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    lost = base.where("id is null").mapInArrow(_sizes(words), "n_shingles long")
    return out.union(lost.select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long")))


def _sizes(k: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in kernels.pieces(b, "text"):
                yield pa.RecordBatch.from_pydict({"n_shingles": pa.array([len(s) for s in kernels.shingle_sets(p.column("text"), k)], pa.int64())})

    return sizes


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
