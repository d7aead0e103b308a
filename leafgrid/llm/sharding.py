"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, from an
offset and a skip that hash its name.  Shards take turns; each claims the first
slot of its permutation that is still free, until the table is full.  So shards
hold equally many slots (one more or less), and when a shard joins or leaves few
slots change hands besides those it gains or gives up.  A row's key hashes to a
slot; the table has a fixed size and is broadcast, so placement is one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import common

#: Slots, a prime well above 100 times the shards.
SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index into ``shards`` of each slot's owner.

    A shard's permutation hangs on its name, and turns go by name, so the order
    in which shards are listed does not matter.
    """
    if len(set(shards)) != len(shards) or not shards or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: _number(shards[i], "offset") % slots for i in turns}
    skip = {i: _number(shards[i], "skip") % (slots - 1) + 1 for i in turns}
    table, left = [-1] * slots, slots
    while True:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text form, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key_col: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """The rows with their slot and the name of their shard (columns of these names are replaced).

    Equal keys share a shard, whatever else their rows hold, null keys are an
    empty string.  Nothing is shuffled, so a hot key costs no more than others
    here.  An empty table gives no rows.
    """
    owners = ",".join(map(str, fill(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("at", "owner"))
    table = table.select(F.col("at").cast("long"), F.element_at(names, F.col("owner").cast("int") + 1).alias("name"))
    # `slots` rows, whatever the input
    out = df.select(common.packed(df), slot(F.col(key_col), slots).alias("own")).join(F.broadcast(table), F.col("own") == F.col("at"))
    return out.select(*common.unpacked(df, **{slot_col: F.col("own"), shard_col: F.col("name")}))


def write_shards(df: DataFrame, key_col: str, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Writes a folder per shard; tasks write what they hold, so no shard has to fit one task.

    All rows are written, repeated ones as often as they come, null keys with
    the empty one; a shard without rows, or any of an empty table, has no folder.
    A column named ``shard`` or ``slot`` gives way, as in ``place``.
    """
    place(df, key_col, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(docs, "doc_id").select("doc_id", "slot", "shard", "n_bytes")


def op7_sql() -> str:
    owners = ",".join(map(str, fill(SHARDS)))
    return f"""
SELECT doc_id, slot, 'shard-' || lpad(string_split('{owners}', ',')[slot + 1], 3, '0') AS shard, n_bytes
FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {SLOTS} AS slot,
             coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents)
"""
