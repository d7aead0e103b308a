"""Lexicon tables and the joins against them.

A lexicon is a few small tables made from phrases (arrays of canonical
syllables): ``forms`` (form, count, skeleton), ``phrases`` (phrase, domain) and
the affix tables.  Spark broadcasts them where their size allows it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import text as T
from leafgrid.tables import materialize

MAX_COUNT, MIN_RATIO, LONGEST = 60, 3, 7
#: Bits of a sketch (4 MB).
BITS = 1 << 25


def forms(phrases: DataFrame) -> DataFrame:
    """(form, count, skeleton) of the alphabetic words of ``phrase``, every occurrence counted, over distinct phrases."""
    words = phrases.select("phrase").distinct().select(F.explode(F.split("phrase", " ")).alias("form"))
    return words.where(T.alphabetic(F.col("form"))).groupBy("form").agg(F.count(F.lit(1)).alias("count")).withColumn("skeleton", T.skeleton(F.col("form")))


def skeletons(forms: DataFrame) -> DataFrame:
    """(skeleton, forms): the forms that share a skeleton, in order."""
    return forms.groupBy("skeleton").agg(F.array_sort(F.collect_set("form")).alias("forms"))


def affixes(forms: DataFrame) -> DataFrame:
    """(cut, kind, skeleton): skeletons without their last one or two letters (two letters stay) and, from three letters, without the first."""
    base = forms.select("skeleton").distinct()
    size = F.char_length("skeleton")
    cuts = F.array(*[F.when(size - k >= 2, F.struct(F.left("skeleton", size - k).alias("cut"), F.lit("prefix").alias("kind"))) for k in (1, 2)], F.when(size >= 3, F.struct(F.substring("skeleton", 2, 2**31 - 1).alias("cut"), F.lit("suffix").alias("kind"))))
    return base.select("skeleton", F.explode(cuts).alias("c")).where("c is not null").select("c.cut", "c.kind", "skeleton")


def variants(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """(token, variant) of distinct tokens: the forms of the same skeleton and, for unknown tokens, of skeletons that continue it."""
    own = tokens.select("token").distinct().withColumn("skeleton", T.skeleton(F.col("token")))
    same = own.join(forms.select("skeleton", F.col("form").alias("variant")), "skeleton").select("token", "variant")
    unknown = own.join(forms.select(F.col("form").alias("token")), "token", "left_anti").where(F.char_length("skeleton") >= 2)
    longer = unknown.withColumnRenamed("skeleton", "cut").join(affixes(forms), "cut").join(forms.select("skeleton", F.col("form").alias("variant")), "skeleton")
    return same.union(longer.select("token", "variant")).where("token <> variant").distinct()


def evidence(tokens: DataFrame, phrases: DataFrame, line: list[str], order: str = "word_no", most: int = 1 << 18) -> DataFrame:
    """Adds ``size`` (of the longest two- or three-word phrase around the token, 0 for none) and ``domain`` (any of them is a domain phrase).

    Up to ``most`` phrases are broadcast, more of them are joined.
    """
    w = Window.partitionBy(*line).orderBy(order)
    t = F.col("token")

    def window(first: int, last: int) -> Column:
        words = [F.lead(t, k).over(w) if k > 0 else F.lag(t, -k).over(w) if k else t for k in range(first, last + 1)]
        # unlike concat_ws, concat is null for a window over the line's edge
        return F.concat(*[x for i, word in enumerate(words) for x in ([F.lit(" ")] if i else []) + [word]])

    spans = [window(a, b) for a, b in ((-1, 0), (0, 1), (-2, 0), (-1, 1), (0, 2))]
    known = phrases.groupBy("phrase").agg(F.bool_or("domain").alias("domain")).withColumn("words", F.size(F.split("phrase", " ")))
    if known.count() <= most:
        # a small dictionary is looked up five times in passing: tokens are not shuffled again
        told = tokens.withColumns({f"__w{i}": s for i, s in enumerate(spans)})
        for i in range(len(spans)):
            one = F.broadcast(known.select(F.col("phrase").alias(f"__p{i}"), F.col("words").alias(f"__n{i}"), F.col("domain").alias(f"__d{i}")))
            told = told.join(one, F.col(f"__w{i}") == F.col(f"__p{i}"), "left")
        size = F.greatest(F.lit(0), *[F.coalesce(f"__n{i}", F.lit(0)) for i in range(len(spans))])
        domain = reduce(Column.__or__, [F.coalesce(f"__d{i}", F.lit(False)) for i in range(len(spans))])
        return told.select(*tokens.columns, size.cast("long").alias("size"), domain.alias("domain"))
    told = tokens.withColumn("windows", F.array(*spans))
    key = [*line, order]
    each = told.select(*key, F.explode("windows").alias("phrase")).where("phrase is not null")
    best = each.join(known, "phrase").groupBy(*key).agg(F.max("words").alias("size"), F.max("domain").alias("domain"))
    return tokens.join(best, key, "left").withColumns({"size": F.coalesce("size", F.lit(0)).cast("long"), "domain": F.coalesce("domain", F.lit(False))})


def suspicious(tokens: DataFrame, forms: DataFrame, protected: DataFrame, line: list[str], order: str = "word_no") -> DataFrame:
    """Tokens with ``size`` 0 that may be misread: alphabetic, seven letters at most, not protected.

    Words capitalised inside a sentence are exempt if they are common forms
    (count over 2): names, as a rule.
    """
    w = Window.partitionBy(*line).orderBy(order)
    before = F.lag("word").over(w)
    opens = before.isNull() | before.rlike(r"[.:;!?]$")
    head = F.left("core", F.lit(1))
    capital = (head == F.upper(head)) & (head != F.lower(head)) & ~((F.col("core") == F.upper("core")) & (F.col("core") != F.lower("core")))
    told = tokens.withColumns({"opens": opens, "capital": capital})
    told = told.where(T.alphabetic(F.col("token")) & (F.char_length("token") <= LONGEST) & (F.col("size") == 0))
    told = told.join(protected.select("token"), "token", "left_anti").join(forms.select(F.col("form").alias("token"), "count"), "token", "left")
    return told.where(~(F.col("capital") & ~F.col("opens") & (F.coalesce("count", F.lit(0)) > 2))).drop("opens", "capital", "count")


def plausible(candidates: DataFrame, forms: DataFrame) -> DataFrame:
    """(token, variant) pairs in which the token is rare (60 at most) and the variant at least three times as common."""
    known = forms.select("form", "count")
    told = candidates.join(known.toDF("token", "n"), "token", "left").join(known.toDF("variant", "m"), "variant", "left")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return told.where((n <= MAX_COUNT) & (m >= MIN_RATIO * F.greatest(n, F.lit(1)))).select("token", "variant")


def unique_best(candidates: DataFrame, key: list[str], score: list[Column], value: str) -> DataFrame:
    """(key, value) of the one best candidate; nothing where the best scores tie."""
    w = Window.partitionBy(*key).orderBy(*[s.desc() for s in score])
    ranked = candidates.withColumns({"r": F.rank().over(w)})
    return ranked.where("r = 1").groupBy(*key).agg(F.count(F.lit(1)).alias("ties"), F.first(value).alias(value)).where("ties = 1").drop("ties")


def one_edit_off(codes: DataFrame, known: DataFrame) -> DataFrame:
    """(code, fixed): codes of four characters or more that are not known and one edit from exactly one known one.

    Edits are found by equality: two strings are one edit apart only if deleting
    a character from one gives the other or the two share a deletion.
    """
    a = codes.select("code").distinct().where(F.char_length("code") >= 4).join(known.select("code"), "code", "left_anti")
    b = known.select(F.col("code").alias("fixed")).distinct().where(F.char_length("fixed") >= 4)

    def cut(c: str) -> Column:
        return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.left(c, i - 1), F.substr(F.col(c), i + 1)))))

    near = a.select("code", F.explode(cut("code")).alias("k")).join(b.select("fixed", F.explode(cut("fixed")).alias("k")), "k").select("code", "fixed").distinct()
    near = near.where(T.edit_within_one(F.col("code"), F.col("fixed")))
    return near.groupBy("code").agg(F.count(F.lit(1)).alias("__hits"), F.min("fixed").alias("fixed")).where("__hits = 1").drop("__hits")


def surnames(tokens: DataFrame, names: DataFrame, line: list[str], order: str = "word_no") -> DataFrame:
    """Adds ``fixed`` to plain ASCII capitalised tokens before a capitalised one whose skeleton fits exactly one name."""
    one = names.select("name").distinct().withColumn("skeleton", T.skeleton(F.col("name"))).groupBy("skeleton").agg(F.count(F.lit(1)).alias("__hits"), F.min("name").alias("name")).where("__hits = 1").drop("__hits")
    w = Window.partitionBy(*line).orderBy(order)
    told = tokens.withColumn("next", F.lead("core").over(w)).where(F.col("core").rlike("^[A-Z][A-Za-z]*$") & F.col("next").rlike(r"^\p{Lu}"))
    told = told.withColumn("skeleton", T.skeleton(F.col("core"))).join(one, "skeleton").where(F.col("name") != F.lower("core"))
    return told.withColumn("fixed", T.match_case(F.col("core"), F.col("name"))).drop("next", "skeleton", "name")


def _sketch(values: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """A bitmap of fixed size of a column of strings, as a table of one row, and the test of a string against it: never false for one that is there."""
    hashed = F.xxhash64(values.columns[0])
    bits = values.select(F.explode(F.array(hashed.bitwiseAND(BITS - 1), F.shiftright(hashed, 32).bitwiseAND(BITS - 1))).alias("bit"))
    each = bits.groupBy(F.shiftright("bit", 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("word")).toArrow()
    told = np.zeros(BITS // 64, np.int64)
    told[each["i"].to_numpy()] = each["word"].to_numpy()

    def bit(at: Column) -> Column:
        word = F.get(F.col("__bits"), F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    table = values.sparkSession.createDataFrame(pa.table({"__bits": pa.array([told], pa.list_(pa.int64()))}))
    return table, lambda c: bit(F.xxhash64(c).bitwiseAND(BITS - 1)) & bit(F.shiftright(F.xxhash64(c), 32).bitwiseAND(BITS - 1))


def one_substitution(runs: DataFrame, forms: DataFrame, places: DataFrame, key: list[str], known: bool = False) -> DataFrame:
    """(key, at, variant) of windows (``words``, an array; no word holds a space) that are no place but become one by exactly one change to a form of the same skeleton.

    A change leaves the window's skeleton as it is, so windows meet places by
    its hash (96 bits) alone and carry only the words that are not their own
    skeleton.  What has no such word, nor one with such a form, has no variants
    and stays behind; a bitmap of their skeletons tells, and what it lets pass
    wrongly finds no place.  ``known``: each word of the windows is a form or
    its own skeleton, each word of the places is a form, so none is checked.
    """
    forms = materialize(forms.select("form", "skeleton"), "forms")

    def bare(texts: DataFrame, *more: str) -> DataFrame:
        # ASCII has no marks, and most windows are ASCII
        return texts.select(*more, "text", F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(T.skeleton(F.col("text"))).alias("plain"))

    windows = bare(runs.select(*key, F.array_join("words", " ").alias("text")), *key)
    whole = bare(places.select(F.col("place").alias("text")))
    words, plain = F.split("text", " ", -1), F.split("plain", " ", -1)
    live = forms.where("form <> skeleton").select("skeleton")
    if not known:
        strange = windows.where("text <> plain").select(F.explode(F.arrays_zip(words.alias("w"), plain.alias("s"))).alias("x")).where("x.w <> x.s")
        live = live.union(strange.select("x.s"))
    sketch, open_ = _sketch(live)

    def met(rows: DataFrame, *more: str) -> DataFrame:
        # a semi-join hands on none of the bitmap
        kept = rows.join(F.broadcast(sketch), (F.col("text") != F.col("plain")) | F.exists(plain, open_), "left_semi")
        marks = F.when(F.col("text") == F.col("plain"), "").otherwise(F.array_join(F.zip_with(words, plain, lambda w, s: F.when(w == s, "").otherwise(w)), " "))
        return kept.select(*more, F.xxhash64("plain").alias("__k"), F.hash("plain").alias("__l"), marks.alias("__marks"))

    there = met(whole).repartition("__k", "__l").groupBy("__k", "__l").agg(F.collect_set("__marks").alias("__there"))
    both = met(windows, *key).join(there, ["__k", "__l"]).where(~F.array_contains("__there", F.col("__marks")))
    # a mark that is not there is a word that is its own skeleton; no marks at all are one empty string
    each = both.select(*key, F.split("__marks", " ", -1).alias("a"), F.explode("__there").alias("b")).withColumn("b", F.split("b", " ", -1))
    size = F.greatest(F.size("a"), F.size("b"))

    def word(c: str, i: Column) -> Column:
        return F.coalesce(F.get(F.col(c), i), F.lit(""))

    apart = each.withColumn("apart", F.filter(F.sequence(F.lit(0), size - 1), lambda i: word("a", i) != word("b", i))).where("size(apart) = 1").withColumn("at", F.col("apart")[0])
    to = word("b", F.col("at"))
    hits = apart.select(*key, "at", F.when(to == "", T.skeleton(word("a", F.col("at")))).otherwise(to).alias("variant"))
    if not known:
        hits = hits.join(forms.select(F.col("form").alias("variant")), "variant", "left_semi")
    one = hits.groupBy(*key).agg(F.min(F.struct("at", "variant")).alias("__one"), F.max(F.struct("at", "variant")).alias("__last")).where("__one = __last")
    return one.select(*key, "__one.at", "__one.variant")


def confusions(tokens: DataFrame, forms: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, fixed): cores that are no form and become exactly one by replacing one confusable shape once.

    pairs: (wrong, right).  Cores with a digit after the first character are left alone.
    """
    open_ = tokens.where("core <> ''").where(~F.substring("core", 2, 2**31 - 1).rlike(r"\p{Nd}"))
    open_ = open_.join(forms.select(F.col("form").alias("low")), F.lower("core") == F.col("low"), "left_anti")
    # a handful of shapes: the pairs go to every task
    tried = open_.select(*key, "core").join(F.broadcast(pairs), F.contains("core", "wrong"))
    at = F.expr("locate(wrong, core)")
    made = tried.withColumn("fixed", F.concat(F.substr("core", F.lit(1), at - 1), "right", F.substr("core", at + F.char_length("wrong"))))
    made = made.where(T.alphabetic(F.col("fixed"))).withColumn("low", F.lower("fixed")).join(forms.select(F.col("form").alias("low")), "low", "left_semi")
    return made.select(*key, "fixed").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("__hits"), F.min("fixed").alias("fixed")).where("__hits = 1").drop("__hits")


def glued(tokens: DataFrame, forms: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """(key, at): unknown tokens of three letters or more with exactly one split into the two words of a known phrase."""
    known = forms.select(F.col("skeleton")).distinct()
    open_ = tokens.where(T.alphabetic(F.col("token")) & (F.char_length("token") >= 3)).withColumn("skeleton", T.skeleton(F.col("token"))).join(known, "skeleton", "left_anti")
    each = open_.select(*key, "token", F.explode(F.sequence(F.lit(1), F.char_length("token") - 1)).alias("at"))
    halves = each.withColumns({"a": T.skeleton(F.left("token", F.col("at"))), "b": T.skeleton(F.substr(F.col("token"), F.col("at") + 1))})
    bigrams = phrases.where(F.size(F.split("phrase", " ")) == 2).select(T.skeleton(F.split("phrase", " ")[0]).alias("a"), T.skeleton(F.split("phrase", " ")[1]).alias("b")).distinct()
    hits = halves.join(bigrams, ["a", "b"], "left_semi").select(*key, "at")
    return hits.groupBy(*key).agg(F.count(F.lit(1)).alias("__hits"), F.min("at").alias("at")).where("__hits = 1").drop("__hits")
