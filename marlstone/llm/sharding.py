"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands), bytes are summed per slot, and a
versioned slot-to-shard map says where each slot lies. Rebalancing and growing edit that map: a new
version is appended, and only the records of moved slots move. `shard` goes on from the latest version under `path`.

Native: DataFrame functions only. What comes to the driver is one row per slot, a number fixed by
`n_slots` whatever the input. No record is moved through a window over a whole shard or slot: positions are the
base of a part of a slot (`PARTS` of them) within its shard plus the row's rank within that part.

A record's slot depends on its id, the CRC and the size of its text, so that an id (or no id) with a third of all rows
is spread as long as its texts differ; rows that agree in all three lie in one slot, dealt over its parts.

Defined results: a null text counts no bytes; a null id is hashed like any value; repeated rows each keep
their own position; an empty table gives an empty result and an even map; other columns are passed by.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import owned, shared_dir, table, utf8, written

N_SLOTS = 4096
N_SHARDS = 24
ROW_BYTES = 8
PARTS = 16


@dataclass(frozen=True)
class SlotMap:
    """shards[s] is the shard of slot s; each edit raises the version."""

    n_shards: int
    shards: tuple[int, ...]
    version: int = 0
    moved: tuple[int, ...] = field(default=())

    @staticmethod
    def even(n_slots: int, n_shards: int) -> "SlotMap":
        """Version 0: the same number of slots for each shard, give or take one."""
        if n_slots < n_shards or n_shards < 1:
            raise ValueError("there must be a shard at least, and a slot for each shard")
        return SlotMap(n_shards, tuple(s % n_shards for s in range(n_slots)))

    def edited(self, moves: dict[int, int], n_shards: int | None = None) -> "SlotMap":
        shards = list(self.shards)
        for slot, shard in moves.items():
            shards[slot] = shard
        moved = tuple(sorted(s for s, x in moves.items() if x != self.shards[s]))
        return SlotMap(n_shards or self.n_shards, tuple(shards), self.version + 1, moved)

    def grown(self) -> "SlotMap":
        """One more shard, which takes slots from the fullest shards; no slot moves between old shards."""
        held = {k: [] for k in range(self.n_shards)}
        for slot, shard in enumerate(self.shards):
            held[shard].append(slot)
        moves = {}
        for _ in range(len(self.shards) // (self.n_shards + 1)):
            fullest = max(held, key=lambda k: (len(held[k]), -k))
            moves[held[fullest].pop()] = self.n_shards
        return self.edited(moves, self.n_shards + 1)

    def rebalanced(self, slot_bytes: dict[int, int], rounds: int = 10_000) -> "SlotMap":
        """Slots move from shards above the mean to those below until neither a move nor a swap narrows
        the gap between the fullest and the emptiest shard. Work and memory depend on n_slots alone."""
        size = [slot_bytes.get(s, 0) for s in range(len(self.shards))]
        held = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(self.shards):
            held[shard].append(slot)
        load = [sum(size[s] for s in own) for own in held]
        mean, spare = sum(load) / self.n_shards, []
        for k, own in enumerate(held):
            own.sort(key=lambda s: (size[s], s))
            while load[k] > mean and own:
                load[k] -= size[own[-1]]
                spare.append(own.pop())
        for slot in sorted(spare, key=lambda s: (-size[s], s)):
            k = min(range(self.n_shards), key=lambda k: (load[k], k))
            held[k].append(slot)
            load[k] += size[slot]
        for _ in range(rounds):
            high, low = max(range(self.n_shards), key=load.__getitem__), min(range(self.n_shards), key=load.__getitem__)
            gap = load[high] - load[low]
            best = None
            below = sorted(((size[s], s) for s in held[low]), reverse=True)
            above = sorted((size[s], s) for s in held[high])
            below.append((0, -1))
            below.sort()
            i = 0
            for a, slot in above:  # the pair whose difference is nearest to half the gap
                while i + 1 < len(below) and a - below[i + 1][0] >= gap / 2:
                    i += 1
                for b, other in below[i : i + 2]:
                    if 0 < a - b < gap and (best is None or abs(a - b - gap / 2) < best[0]):
                        best = (abs(a - b - gap / 2), a - b, slot, other)
            if best is None:
                break
            _, shift, slot, other = best
            held[high].remove(slot)
            held[low].append(slot)
            if other >= 0:
                held[low].remove(other)
                held[high].append(other)
            load[high] -= shift
            load[low] += shift
        return self.edited({s: k for k, own in enumerate(held) for s in own if self.shards[s] != k})

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row for each slot: version, slot, shard."""
        rows = json.dumps([{"vslot": s, "shard": k} for s, k in enumerate(self.shards)])
        return (
            spark.range(1)
            .select(F.explode(F.from_json(F.lit(rows), "array<struct<vslot:int,shard:int>>")).alias("x"))
            .select(F.lit(self.version).alias("version"), "x.vslot", "x.shard")
        )


def store(spark: SparkSession, versions: list[SlotMap], path: str | None = None) -> str:
    """Append the versions to the map's table; returns its path. Without a path the map has a table of its own in the shared folder,
    which goes at the end of the process."""
    path = path or owned(spark, f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    for m in versions:
        m.frame(spark).coalesce(1).write.mode("append").parquet(path)
    return path


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version int, vslot int, shard int").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A version of the stored map, by default the latest; none where nothing is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = stored(spark, path)
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    own = {r.vslot: r.shard for r in rows.filter(F.col("version") == version).collect()}  # n_slots rows
    return SlotMap(max(own.values()) + 1, tuple(own[s] for s in range(len(own))), version) if own else None


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size, text_crc32 and virtual slot of each record."""
    raw = utf8(F.col(text_col))
    rows = docs.select(F.col(id_col), (F.octet_length(raw).cast("long") + F.lit(ROW_BYTES)).alias("size"), F.crc32(raw).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64(id_col, "text_crc32", "size"), F.lit(n_slots)).cast("int"))


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Each record's shard and its position there, sizes near equal between shards. The map under `path`, if there is one,
    is the one that is edited; the edited version is stored there.

    Columns: id, size, text_crc32, vslot, shard, slot (the position, gapless from 0), map_version."""
    spark = docs.sparkSession
    # the part is drawn once and written, so that every later reading sees the same
    rows = slotted(docs, id_col, text_col, n_slots).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    rows = written(rows, "shard-rows")
    per_part = rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    sums = {r.vslot: r.bytes for r in per_part.groupBy("vslot").agg(F.sum("bytes").alias("bytes")).collect()}  # n_slots rows at most
    found = load(spark, path) if path else None
    first = found or SlotMap.even(n_slots, n_shards)
    if (len(first.shards), first.n_shards) != (n_slots, n_shards):
        raise ValueError("the stored map has other numbers of slots or shards")
    last = first.rebalanced(sums)
    path = store(spark, [last] if found else [first, last], path)
    now = stored(spark, path).filter(F.col("version") == last.version)
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        now.join(F.broadcast(per_part), "vslot")  # n_slots * PARTS rows at most
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("vslot", "part", "shard", "base", F.col("version").alias("map_version"))
    )
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy(id_col, "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(placed), ["vslot", "part"])
        .select(id_col, "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "map_version")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents into 24 shards under the law `bytes`."""
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "map_version",
    )
