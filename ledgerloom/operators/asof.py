"""Attributes as known at the time of an event.

``names_as_known`` joins events to entity versions by DuckDB's ASOF LEFT JOIN, run inside the executors on hash buckets
of the entity.  A version is available from the later of its own date and the day it was recorded, so nothing is used
before it was known.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import hot_keys, spread

#: Events that one bucket holds on average; an entity with more is spread over several buckets.
BUCKET_ROWS = 50_000

_SQL = """
SELECT e._event, v.name
FROM events e ASOF LEFT JOIN versions v ON e._entity = v._entity AND e._at < v._until
WHERE v.name IS NOT NULL
"""


def availability(names: DataFrame) -> DataFrame:
    """One version per company and end day: (company_number, ends, name).

    A name ends on the later of ``condate`` and ``recorded_on`` (``condate`` if the latter is NULL).  Rows without a
    condate, company or name play no part.  Of several names of a company ending on the same day the oldest (largest k)
    was in force before it, the others never became visible; equal k is settled by the smallest name.
    """
    ends = F.greatest("condate", F.coalesce("recorded_on", "condate"))
    known = names.where("condate IS NOT NULL AND company_number IS NOT NULL AND name IS NOT NULL").select("company_number", ends.alias("ends"), "k", "name")
    return known.groupBy("company_number", "ends").agg(F.min(F.struct((-F.coalesce("k", F.lit(0))).alias("k"), F.col("name"))).alias("_v")).select("company_number", "ends", F.col("_v.name").alias("name"))


def asof_join(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Each event with the version of its entity that ends first after it: (event, name); events without one are left out.

    ``events`` has (event, entity, at), ``versions`` (entity, until, name).  Both sides are hashed by entity into
    buckets of about ``BUCKET_ROWS`` events; an entity with more than a thousandth of all events is dealt over several
    buckets, each with a copy of its versions.  Empty inputs give an empty result.
    """
    events = events.persist(StorageLevel.MEMORY_AND_DISK)
    hot = hot_keys(events, "entity", least=BUCKET_ROWS).select("entity", "_parts")
    size = events.count()
    buckets = max(1, -(-size // BUCKET_ROWS))
    e = events.join(F.broadcast(hot), "entity", "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(spread(F.col("event"), F.coalesce("_parts", F.lit(1)))))
    v = versions.join(F.broadcast(hot), "entity", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    bucket = F.pmod(F.xxhash64("entity", "_part"), F.lit(buckets)).alias("_bucket")
    e = e.select(bucket, F.col("event").alias("_event"), F.col("entity").alias("_entity"), F.col("at").alias("_at"))
    v = v.select(bucket, F.col("entity").alias("_entity"), F.col("until").alias("_until"), "name")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import duckdb

        if not left.num_rows or not right.num_rows:
            return pa.table({"event": pa.array([], pa.string()), "name": pa.array([], pa.string())})
        with duckdb.connect(config={"threads": 1, "memory_limit": "256MB"}) as c:
            c.register("events", left)
            c.register("versions", right)
            return c.sql(_SQL).to_arrow_table().select(["_event", "name"]).rename_columns(["event", "name"])

    return e.groupBy("_bucket").cogroup(v.groupBy("_bucket")).applyInArrow(run, "event string, name string")


def names_as_known(spend: DataFrame, resolved: DataFrame, names: DataFrame, companies: DataFrame) -> DataFrame:
    """The previous name that was in force and known on each resolved line's payment day: (spend_id, name).

    Lines without a payment date, lines before the company's incorporation, and lines under today's name are left out; a
    company without an incorporation date, or not in the register, restrains nothing.  Repeated links and names count
    once; a line linked to two companies gives a row for each name.
    """
    versions = availability(names)
    born = companies.groupBy("company_number").agg(F.min("incorporation_date").alias("_born"))
    renamed = versions.groupBy("company_number").agg(F.max("ends").alias("_last")).join(born, "company_number", "left")
    links = resolved.select("spend_id", "company_number").where("spend_id IS NOT NULL").join(renamed, "company_number").distinct()
    lines = spend.select("spend_id", "payment_date").where("payment_date IS NOT NULL").join(links, "spend_id")
    events = lines.where("payment_date < _last AND (_born IS NULL OR payment_date >= _born)").select(F.col("spend_id").alias("event"), F.col("company_number").alias("entity"), F.col("payment_date").alias("at")).distinct()
    found = asof_join(events, versions.select(F.col("company_number").alias("entity"), F.col("ends").alias("until"), "name"))
    return found.select(F.col("event").alias("spend_id"), "name").distinct()
