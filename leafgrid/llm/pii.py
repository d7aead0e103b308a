"""PII: entities give way to keyed surrogates of the same kind.

A surrogate comes from a keyed permutation of what the entity is made of: digits
among digits, vowels among the vowels of the same script, a given name among the
given names of its gender and script.  Separators, length, case, country code,
checksum and file-like prefixes stay, of an invented name the ending too, which
shows its gender.  A permutation maps equal entities alike everywhere
(coreference) and different ones apart (distinctness); the check then looks over
the whole corpus for surrogates that two entities share or that are another
entity's real value, and moves those on to their next surrogate.

Names are keyed part by part, without title or place, so a surname has one
surrogate in ``Mr. John Smith``, ``Dr. Smith`` and ``Smith``; parts found behind
a title are looked for in their whole document.

Whoever has the key can undo the permutations, so it comes from the session
(``KEY_CONF``) or the caller, and there is none by default.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import common, kernels

#: The session's setting that holds the key.
KEY_CONF = "spark.leafgrid.pii.key"
#: The key of the registered query where the session has none: for synthetic tables only.
TEST_KEY = b"synthetic tables only"
#: Surrogates of its own form that an entity tries before it gets a longer one.
TRIES = 3
#: Entities a task gives surrogates to.
TASK_ROWS = 4096
#: Entities with another than their first surrogate that are broadcast; more of them are joined.
BROADCAST_ROWS = 50_000

GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Laura", "Julia", "Sophie", "Emma", "Clara", "Elena", "Alice", "Marie", "Lucia", "Nina", "Sarah", "Carmen", "Paula", "Ingrid"],
    ("latin", "m"): ["John", "Peter", "Thomas", "Paul", "Martin", "David", "Carlos", "Pierre", "Hans", "Luis", "Marco", "Jean", "Robert", "James", "Stefan", "Miguel"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Татьяна", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"],
}
_PLACE = {name.lower(): kind for kind, names in GIVEN.items() for name in names}
#: Characters that stand in for each other.
_CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"]
_CLASS = {c: cls for cls in _CLASSES for c in cls}

_FEMALE = r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme\.?|Señora|Sra\.?|Doña|госпожа"
_MALE = r"Mr\.?|Herr|Monsieur|Señor|Sr\.?|Don|господин"
_NEUTRAL = r"Dr\.?|Prof\.?"
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*[^\W\d_]"
_WORD = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*")
_POSSESSIVE = re.compile(r"(?:['’][sS]?|-)+$")
_HEX = r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)"
_AWS = r"(?:AKIA|ASIA)[A-Z0-9]{16}"
#: Kinds in the order in which they claim text, each with what a text that holds one can't be without (RE2).  No pattern
#: has an upper length, and each begins at the border of its run of characters, so endless runs are read once.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<email_value>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}+)(?![A-Za-z0-9])", "@"),
    ("aws_key", rf"(?<![A-Za-z0-9]){_AWS}(?![A-Za-z0-9])", "AKIA|ASIA"),
    ("secret", r"(?i:(?<![a-z])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)\s?[=:]\s?[\"']?)(?P<secret_value>[A-Za-z0-9+/_.~-]*[A-Za-z0-9+/_~-])", "[=:]"),
    ("hex_secret", rf"(?<![A-Za-z0-9]){_HEX}(?![A-Za-z0-9])", "[0-9a-f]{32}|[0-9A-F]{32}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    ("card", r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    ("ssn", r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", "[0-9]{3}-[0-9]{2}-"),
    ("phone", r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}[ .-][0-9]{3,4}(?![\w-])|(?<![\w.])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w-])|(?<![\w.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])", r"\([0-9]{2}|\+[0-9]|[0-9]{3}[ .-][0-9]{3}[ .-]"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?!\w|\.[0-9])", r"[0-9]\.[0-9]"),
    ("name", rf"(?<!\w)(?P<title>{_FEMALE}|{_MALE}|{_NEUTRAL}) (?P<full>{_NAME}(?: {_NAME}){{0,2}})", f"(?:{_FEMALE}|{_MALE}|{_NEUTRAL}) [A-ZÀ-ÖØ-ÞА-ЯЁ]"),
]
FIND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in PATTERNS))
#: A cheap test that every text with an entity passes.
HINT = "|".join(hint for _, _, hint in PATTERNS)
_WHOLE = [("aws_key", re.compile(_AWS)), ("hex_secret", re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}"))]


def _draw(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256)[:16], "big")


def permute(key: bytes, tag: str, digits: list[int], radix: list[int]) -> list[int]:
    """A keyed permutation of the mixed-radix numbers of one shape: an unbalanced Feistel network over the two halves."""
    n = len(digits)
    if n < 2:
        return [(d + _draw(key, tag, radix)) % r for d, r in zip(digits, radix, strict=True)]
    half = n // 2
    out = list(digits)
    for turn in range(8):
        a, b = (slice(0, half), slice(half, n)) if turn % 2 else (slice(half, n), slice(0, half))
        add = _draw(key, tag, turn, radix, out[a])
        for i in range(b.start, b.stop):
            out[i] = (out[i] + add % radix[i]) % radix[i]
            add //= radix[i]
            if add < 1 << 24:
                add = _draw(key, tag, turn, i, radix, out[a])
    return out


def _characters(key: bytes, tag: str, text: str, hexa: bool = False) -> str:
    """Permutes letters and digits within their classes; case, separators and other characters stay."""
    at, value, radix, sets = [], [], [], []
    for i, c in enumerate(text):
        low = c.lower()
        cls = "0123456789" if c.isascii() and c.isdigit() else "abcdef" if hexa and low in "abcdef" else _CLASS.get(low)
        if cls and len(low) == 1:
            at.append(i)
            value.append(cls.index(low))
            radix.append(len(cls))
            sets.append(cls)
    shape = "".join("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c for c in text)
    new = permute(key, f"{tag}:{shape if not hexa else len(text)}", value, radix)
    out = list(text)
    for i, v, cls in zip(at, new, sets, strict=True):
        out[i] = cls[v].upper() if out[i].isupper() and len(cls[v].upper()) == 1 else cls[v]
    return "".join(out)


def _digits(key: bytes, tag: str, text: str, keep: int) -> str:
    """Permutes the digits after the first ``keep``."""
    at = [i for i, c in enumerate(text) if c.isdigit()][keep:]
    new = permute(key, f"{tag}:{[c for i, c in enumerate(text) if i not in set(at)]}", [int(text[i]) for i in at], [10] * len(at))
    out = list(text)
    for i, v in zip(at, new, strict=True):
        out[i] = str(v)
    return "".join(out)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", number))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _person(key: bytes, tag: str, name: str) -> str:
    """A lower-case part of a name: a listed given name turns along its list in the key's order, another keeps its ending."""
    if name in _PLACE:
        names = sorted(GIVEN[_PLACE[name]], key=lambda n: _draw(key, "given", n))
        turn = 1 + _draw(key, tag, *_PLACE[name]) % (len(names) - 1)
        return names[([n.lower() for n in names].index(name) + turn) % len(names)].lower()
    keep = 0 if len(name) < 4 else 2 if "а" <= name[-1] <= "я" else 1
    return _characters(key, f"{tag}:{name[len(name) - keep:]}", name[: len(name) - keep]) + name[len(name) - keep :]


def _letters(key: bytes, tag: str, entity: str, n: int) -> str:
    """n keyed characters of the kind that the entity has: digits, hex digits or letters."""
    alphabet = "0123456789" if not re.search(r"[^\W\d_]", entity) and re.search("[0-9]", entity) else "абвгдежзиклмнопрст" if re.search("[а-яё]", entity.lower()) else "abcdef0123456789" if re.fullmatch("[0-9a-f]+", entity) else "abcdefghijklmnopqrstuvwxyz"
    digest = hmac.digest(key, f"{tag}\x1f{entity}".encode(), hashlib.sha512)
    digest *= -(-n // len(digest))
    return "".join(alphabet[c % len(alphabet)] for c in digest[:n])


def _form(kind: str, entity: str, tag: str, key: bytes) -> str:
    """The entity's image under one keyed permutation of its form; the entity itself if there is nothing to permute."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels, _, top = domain.rpartition(".")
        return f"{_characters(key, tag, local)}@{_characters(key, tag + 'd', labels)}.{top}"
    if kind == "aws_key":
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return entity[:4] + "".join(alphabet[v] for v in permute(key, tag, [alphabet.index(c) for c in entity[4:]], [36] * 16))
    if kind == "hex_secret":
        alphabet = "0123456789ABCDEF" if entity == entity.upper() else "0123456789abcdef"
        return "".join(alphabet[v] for v in permute(key, tag, [alphabet.index(c) for c in entity], [16] * len(entity)))
    if kind == "card":
        # walks on until the checksum is as right as before; the walk is a cycle through the entity, so it ends
        new, ok = _digits(key, tag, entity, 1), luhn(entity)
        while luhn(new) != ok:
            new = _digits(key, tag, new, 1)
        return new
    if kind == "phone":
        return _digits(key, tag, entity, len(re.match(r"\+?([0-9]*)", entity)[1]) + 1 if entity[0] == "+" else 1)
    if kind == "ip":
        packed = list(ipaddress.IPv4Address(entity).packed)
        return str(ipaddress.IPv4Address(bytes([packed[0], *permute(key, f"{tag}:{packed[0]}", packed[1:], [256] * 3)])))
    if kind == "iban":
        return entity[:2] + _characters(key, tag, entity[2:])
    if kind == "name":
        return _person(key, tag, entity)
    return _characters(key, tag, entity)


@lru_cache(maxsize=1 << 16)
def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """The entity's surrogate, never the entity; equal arguments give equal ones.

    Attempts below TRIES keep the entity's form.  An entity with nothing to
    permute gets as many keyed characters.  Later attempts are for forms whose
    every value is taken: the form, lengthened by 16 keyed characters.
    """
    for turn in range(8):
        new = _form(kind, entity, f"{kind}:{attempt}:{turn}", key)
        if new != entity:
            break
    else:
        new = _letters(key, f"{kind}:{attempt}", entity, len(entity))
    if attempt >= TRIES:
        more = _letters(key, f"{kind}:{attempt}:more", entity, 16)
        local, at, domain = new.partition("@")
        new = f"{local}.{more}@{domain}" if kind == "email" and at else new + more
    return new


def _folded(part: str) -> str:
    return part.lower() if len(part.lower()) == len(part) else part


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of the entities in a text, left to right, not overlapping.

    Names and addresses are entities in lower case.  A part of a name found
    behind a title is an entity wherever the text has it as a capitalised word.
    """
    out, names = [], set()
    for m in FIND.finditer(text):
        if m["secret_value"]:
            value = m["secret_value"]
            out.append((m.start("secret_value"), m.end("secret_value"), next((k for k, p in _WHOLE if p.fullmatch(value)), "secret"), value))
        elif m["full"]:
            for part in _WORD.finditer(text, m.start("full"), m.end("full")):
                name = _POSSESSIVE.sub("", part[0])
                names.add(_folded(name))
                out.append((part.start(), part.start() + len(name), "name", _folded(name)))
        elif m["email_value"]:
            out.append((m.start("email_value"), m.end("email_value"), "email", m["email_value"].lower()))
        else:
            out.append((m.start(), m.end(), m.lastgroup, m[0]))
    if not names:
        return out
    # bare mentions, outside of what is claimed already
    free, at = [], 0
    for a, b, _, _ in [*out, (len(text), len(text), "", "")]:
        for w in _WORD.finditer(text, at, a):
            name = _POSSESSIVE.sub("", w[0])
            if _folded(name) in names:
                free.append((w.start(), w.start() + len(name), "name", _folded(name)))
        at = b
    return sorted(out + free)


def _cased(new: str, old: str) -> str:
    """The case of ``old``: all capitals, capitals at the heads of its words, or letter by letter."""
    if len(new) == len(old):
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, old, strict=True))
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def replace(text: str, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str, int]:
    """The text with surrogates, and their number."""
    out, at, n = [], 0, 0
    for a, b, kind, entity in find(text):
        new = surrogate(kind, entity, attempts.get((kind, entity), 0), key)
        out += [text[at:a], _cased(new, text[a:b]) if kind in ("name", "email") else new]
        at, n = b, n + 1
    return "".join([*out, text[at:]]), n


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, entity) of a corpus."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hinted = b.column(0).filter(pc.match_substring_regex(b.column(0).fill_null(""), HINT))
            found = list({(k, e) for t in hinted for _, _, k, e in find(t.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["kind", "entity"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(scan, "kind string, entity string").distinct()


def collisions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of the entities that need another than their first surrogate.

    A round gives the entities that moved their next surrogates and looks, by
    grouping and joining, for shared ones (of those that share one, all but the
    one with the fewest attempts, then the smallest, move on) and for those that
    are a real entity of the corpus.  It ends when no entity moves.  From
    attempt TRIES on surrogates are longer by 16 keyed characters, so no form
    can be full and a few rounds more always do; as a bound against a broken
    key, a round that still moves entities after 2 * TRIES raises an error.
    Listed given names only permute among themselves and never move.
    """
    shape = "kind string, entity string, attempt int, new string"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in (("kind", pa.string()), ("entity", pa.string()), ("attempt", pa.int32()))} | {"new": pa.array([surrogate(r["kind"], r["entity"], r["attempt"], key) for r in rows], pa.string())})

    def named(rows: DataFrame, n: int) -> DataFrame:
        # few bytes, much work: tasks by number of entities
        return rows.repartition(max(1, -(-n // TASK_ROWS)), "kind", "entity").mapInArrow(assign, shape)

    real = common.materialize(found, "entities")
    now = common.materialize(named(real.withColumn("attempt", F.lit(0)), real.count()), "surrogates")
    given = F.array(*[F.lit(n) for n in sorted(_PLACE)])
    for attempt in range(2 * TRIES + 1):
        own = now.withColumn("free", ~((F.col("kind") == "name") & F.array_contains(given, F.col("entity"))))
        first = F.min(F.struct("free", "attempt", "entity"))
        shared = own.groupBy("kind", "new").agg(first["entity"].alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        own = own.where("free")
        late = own.join(shared, ["kind", "new"]).where("entity <> owner").select("kind", "entity")
        taken = own.join(real.select("kind", F.col("entity").alias("new")), ["kind", "new"], "left_semi").select("kind", "entity")
        moving = common.materialize(late.union(taken).distinct(), "moving")
        n = moving.count()
        if not n:
            return now.where("attempt > 0").select("kind", "entity", "attempt")
        if attempt == 2 * TRIES:
            raise RuntimeError(f"{n} entities still share surrogates")
        stay = now.join(moving, ["kind", "entity"], "left_anti")
        next_ = now.join(moving, ["kind", "entity"], "left_semi").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        now = common.materialize(stay.select("kind", "entity", "attempt", "new").union(named(next_, n)), "surrogates")


def session_key(spark: SparkSession) -> bytes | None:
    value = spark.conf.get(KEY_CONF, None)
    return value.encode() if value else None


def pseudonymize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, text, n_entities) per row, the text with surrogates in place of entities.

    Null texts stay null with no entities, texts without entities stay as they
    are.  Whole texts are searched, whatever their length.  Repeated rows get
    equal results, null ids are carried through, an empty table gives no rows,
    other columns are not read.

    The key is ``key`` or the session's ``spark.leafgrid.pii.key``; without
    either there is an error.
    """
    key = key or session_key(docs.sparkSession)
    if not key:
        raise ValueError(f"surrogates need a key: set {KEY_CONF}")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(base.dtypes)["id"]
    moved = common.materialize(collisions(entities(base), key), "moved")

    def write(batches: Iterator[pa.RecordBatch], attempts: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in kernels.pieces(b, "text"):
                column = p.column("text")
                texts, counts = column.to_pylist(), [0] * p.num_rows
                for i in pc.indices_nonzero(pc.match_substring_regex(column.fill_null(""), HINT)).to_pylist():
                    own = attempts
                    if "moves" in p.schema.names:
                        own = {(m["kind"], m["entity"]): m["attempt"] for m in p.column("moves")[i].as_py() or ()}
                    texts[i], counts[i] = replace(texts[i], own, key)
                yield pa.RecordBatch.from_pydict({"id": p.column("id"), "text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64())})

    shape = f"id {kind}, text string, n_entities long"
    if moved.count() <= broadcast_rows:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): r["attempt"] for r in moved.collect()})
        out = base.mapInArrow(lambda it: write(it, shared.value), shape)
    else:

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(t, k, e) for t, text in zip(b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True) for k, e in {(k, e) for _, _, k, e in find(text or "")}]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["th", "kind", "entity"])

        hashed = base.withColumn("th", F.xxhash64("text"))
        held = hashed.select("th", "text").mapInArrow(own, "th long, kind string, entity string").distinct().join(moved, ["kind", "entity"])
        per = held.groupBy("th").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("moves"))
        out = hashed.join(per, "th", "left").select("id", "text", "moves").mapInArrow(lambda it: write(it, {}), shape)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(common.table(spark, sf_dir, "documents").select("doc_id", "text"), key=session_key(spark) or TEST_KEY)
