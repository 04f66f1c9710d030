"""Fixed virtual slots: records hash into thousands of slots, slots map to shards.

A record's slot never changes. Bytes are summed for each slot, and a versioned map deals the slots
to shards, largest first to the shard that has least (law ``bytes``: shards get nearly equal
bytes). Rebalancing writes a new version that moves only the slots it must, after a change of the slots' loads
or of the number of shards (``rebalance``), or for one more shard (``grow_map``); records of other slots stay where they are. The map has one row for each slot, so its size is fixed by ``slots``,
whatever the corpus; it is the only thing that is broadcast. Only DataFrame functions are used.

Defined results: a null text has no bytes; a row without an id is placed by its text; repeated
rows are placed together and numbered one after another; an empty table gives an empty result and
a map whose shards are all empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.llm.common import materialize, shared_dir, table

#: Virtual slots; fixed for the life of a corpus.
SLOTS = 4096
#: Bytes that a record costs besides its text.
OVERHEAD = 16


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row; texts go no further than here."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), text, slots).alias("virtual_slot"),
    )


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows: one row for each slot, also for empty ones."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def build_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """version, virtual_slot, shard, bytes, rows: largest slot first, to the shard with least.

    Equal sizes are ordered by slot, equal shards by number, so the map is a function of the loads.
    """
    slot = F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "rows")
    given = loads.agg(F.array_sort(F.collect_list(slot)).alias("given"))

    def deal(state: Column, s: Column) -> Column:
        to = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        load = F.transform(state["load"], lambda x, i: F.when(i == to, x - s["less"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    empty = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))
    dealt = given.select("given", F.aggregate("given", empty, deal)["to"].alias("to"))
    return mapped(dealt, version)


def grow_map(old: DataFrame, shards: int, version: int) -> DataFrame:
    """The next version for one more shard (number ``shards``): slots move only into the new shard.

    Slots are offered smallest last from whichever shard they are in; one moves when its shard stays
    at or above the new mean and the new shard stays at or below it.
    """
    mean = F.sum("bytes").over(Window.partitionBy()) / (shards + 1)
    slot = F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard", "rows")
    given = old.withColumn("mean", mean).groupBy().agg(F.array_sort(F.collect_list(slot)).alias("given"), F.max("mean").alias("mean"), *[F.sum(F.when(F.col("shard") == i, F.col("bytes")).otherwise(0)).alias(f"_{i}") for i in range(shards)])
    loads = F.array(*[F.coalesce(f"_{i}", F.lit(0)) for i in range(shards)], F.lit(0).cast("long"))
    given = given.select("given", "mean", loads.cast("array<bigint>").alias("loads"))

    def offer(state: Column, s: Column) -> Column:
        size = -s["less"]
        fits = (F.get(state["load"], s["shard"]) - size >= F.col("mean")) & (F.get(state["load"], F.lit(shards)) + size <= F.col("mean"))
        to = F.when(fits, F.lit(shards)).otherwise(s["shard"])
        load = F.transform(state["load"], lambda x, i: F.when(fits & (i == s["shard"]), x - size).when(fits & (i == shards), x + size).otherwise(x))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    start = F.struct(F.col("loads").alias("load"), F.array().cast("array<int>").alias("to"))
    dealt = given.select("given", F.aggregate("given", start, offer)["to"].alias("to"))
    return mapped(dealt, version)


def rebalance(old: DataFrame, loads: DataFrame, shards: int, version: int, slack: float = 0.01) -> DataFrame:
    """The next version after the slots' loads, or the number of shards, have changed: moves only what must move.

    Largest first, a slot stays where its shard holds at most ``1 + slack`` of the mean with it, or holds no
    other yet. The rest, and slots of shards that are no more, go to the shard with least, again largest first.
    """
    slot = F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard", "rows")
    now = loads.join(old.select("virtual_slot", "shard"), "virtual_slot", "left").withColumn("shard", F.coalesce("shard", F.lit(-1)))
    given = now.agg(F.array_sort(F.collect_list(slot)).alias("given"), (F.sum("bytes") * (1 + slack) / shards).alias("most"))
    loads_of = F.array_repeat(F.lit(0).cast("long"), shards)

    def put(load: Column, to: Column, s: Column) -> Column:
        return F.transform(load, lambda x, i: F.when(i == to, x - s["less"]).otherwise(x))

    def keep(state: Column, s: Column) -> Column:
        held = F.when(s["shard"].between(0, shards - 1), F.get(state["load"], s["shard"]))
        to = F.when((held == 0) | (held - s["less"] <= F.col("most")), s["shard"]).otherwise(-1)
        return F.struct(put(state["load"], to, s).alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    def deal(state: Column, s: Column) -> Column:
        least = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        to = F.when(s["to"] >= 0, s["to"]).otherwise(least)
        load = F.when(s["to"] >= 0, state["load"]).otherwise(put(state["load"], least, s["given"]))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    start = lambda load: F.struct(load.alias("load"), F.array().cast("array<int>").alias("to"))
    kept = given.select("given", F.aggregate("given", start(loads_of), keep).alias("kept"))
    dealt = kept.select("given", F.aggregate(F.arrays_zip("given", F.col("kept.to").alias("to")), start(F.col("kept.load")), deal)["to"].alias("to"))
    return mapped(dealt, version)


def mapped(dealt: DataFrame, version: int) -> DataFrame:
    """The rows of a map from its slots (``given``) and their shards (``to``)."""
    rows = dealt.select(F.inline(F.arrays_zip("given", "to")))
    return rows.select(F.lit(version).alias("version"), F.col("given.virtual_slot").alias("virtual_slot"), F.col("to").alias("shard"), (-F.col("given.less")).alias("bytes"), F.col("given.rows").alias("rows"))


class SlotMap:
    """Versions of a slot-to-shard map, one folder for each, below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, version: int) -> DataFrame:
        return materialize(rows.coalesce(1), f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard and slot, the row's place in its shard (gapless from 0).

    Places are counted inside each virtual slot, in order of doc_id, and moved by the rows of the
    shard's earlier slots, which the map has: no shard's rows ever meet in one task.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("start") + F.col("place")).cast("long"))


def query(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """op2: every document's shard under the law ``bytes``."""
    rows = records(table(spark, sf_dir, "documents"))
    at = shared_dir(spark)
    rows = materialize(rows, f"{at}/records")
    SlotMap(spark, f"{at}/map").write(build_map(slot_loads(rows), shards), 1)
    placed = place(rows, SlotMap(spark, f"{at}/map").read(1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
