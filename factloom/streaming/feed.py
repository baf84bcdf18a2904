"""A feed of the newest records as a stateful stream, and clients that read it at their own pace.

Records are dealt into shards by their number, and each shard's state is a ring of its newest
``most`` records: no state holds them all, and the newest of all are among the rings'. Each
batch writes the rings that have changed, as one commit of a lake. A client's cursor is the
number of the last record that it was given, not a place in the ring: what has left the ring
before a client asks is missed, and what comes later is still delivered.

Records without a number are left out. Of records with one number the greater rows count as
newer. Records may come late or twice: a ring holds each once, and clients aren't given what
lies before their cursor.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.delta import Lake, Spec
from ..shared import kept

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tables of a lake: the rings, and the clients' cursors.
RINGS, CURSORS = Spec(("shard",), "shard int, at long, record string", 1), Spec(("client",), "client string, at long", 1)


class Ring(StatefulProcessor):
    """Keeps a shard's newest records and gives them whenever they change."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "at long, record string")

    def handleInputRows(self, key, rows, timerValues):
        held = {(int(at), record) for at, record in self.ring.get()}
        for frame in rows:
            held = set(heapq.nlargest(self.most, held | set(zip(frame["at"].tolist(), frame["record"].tolist()))))
        held = sorted(held)
        self.ring.put(held)
        yield pd.DataFrame([(key[0], at, record) for at, record in held], columns=["shard", "at", "record"])

    def close(self) -> None:
        pass


def rings(stream: DataFrame, order: str, most: int = 500, shards: int = 8) -> DataFrame:
    """A stream of the rings that have changed: (shard, at, record as JSON)."""
    rows = stream.where(F.col(order).isNotNull()).select(F.pmod(F.xxhash64(order), F.lit(shards)).cast("int").alias("shard"), F.col(order).cast("long").alias("at"), F.to_json(F.struct(*stream.columns)).alias("record"))
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=Ring(most), outputStructType="shard int, at long, record string", outputMode="Update", timeMode="None")


def run(stream: DataFrame, lake: Lake, order: str, checkpoint: str, most: int = 500, shards: int = 8) -> None:
    """Takes what is there into the rings (table ``rings`` of the lake), batch by batch."""

    def write(batch: DataFrame, number: int) -> None:
        if not lake.seen(checkpoint, number):
            with lake.commit((checkpoint, number)) as change:
                change.replace("rings", batch)

    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # a query keeps what it was started with
    try:
        running = rings(stream, order, most, shards).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(name, before)
    running.awaitTermination()


def newest(lake: Lake, most: int = 500) -> DataFrame:
    """(at, record) of the newest records, over all shards."""
    return lake.read("rings").select("at", "record").orderBy(F.desc("at"), F.desc("record")).limit(most)


def poll(lake: Lake, clients: DataFrame, most: int = 500) -> DataFrame:
    """(client, at, record) that the clients (client) haven't been given yet; their cursors move behind it.

    A new client is given the whole ring.
    """
    version = lake.manifest()["version"]
    held = clients.select("client").distinct().join(lake.read("cursors", version).withColumnRenamed("at", "cursor"), "client", "left")
    ring = lake.read("rings", version).select("at", "record").orderBy(F.desc("at"), F.desc("record")).limit(most)
    fresh = kept(held.join(F.broadcast(ring), F.col("cursor").isNull() | (F.col("at") > F.col("cursor"))).select("client", "at", "record"), "polled")  # ``most`` rows
    with lake.commit() as change:
        change.upsert("cursors", fresh.groupBy("client").agg(F.max("at").alias("at")))
    return fresh
