"""Golden records: one record for each cluster of records of the same client.

Two orders rank the records of a cluster. RECENT: latest time first (null last), then
higher trust, then smaller id. TRUSTED: fresh before stale, then higher trust, then
RECENT. Each field takes the first value that isn't null over the unbounded frame of a
sorted window: the segment by RECENT, the e-mail by TRUSTED, the name by its code points
and the rank by TRUSTED, the balance by agreement with the chosen segment and the rank by
RECENT. City and nation come from one record, that with most of both, then RECENT. All
windows share one shuffle and differ in their sort only.

*Large clusters.* A cluster of more than one in ``SHARE`` of all records is large; there
are fewer than ``SHARE``, so the list of them may be broadcast. Their repeated rows become
one row with a count, the rows are dealt to as many parts as the cluster holds shares,
windows choose within parts, and the parts' winners meet with the keys that they won by.
What a part can't know, the cluster's latest time and its chosen segment, is aggregated
before. So a task meets some thousandth of the records, whatever the clusters' sizes.

Defined results: strings that are empty or hold only white space (0x20, 0x09-0x0D) count
as null, balances that aren't finite as well. Sources that aren't listed (null too) are
trusted least. A record is stale if its time is null or more than ``stale_hours`` before
the cluster's latest, to the microsecond. Records without a master are their own; those
without either id form the cluster of the null id. Records that agree in time, trust and
id are ordered by their fields (name, e-mail, city, nation, segment, balance, nulls first),
so reruns agree; repeated rows count one by one. An empty table gives an empty result. Long
texts are whole values like others. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: A cluster that holds more than one in so many of the records is dealt to parts.
SHARE = 1000
#: Sources by falling trust.
TRUST = ("crm", "web", "store", "partner")
_FIELDS = ("name", "email", "city", "nation_id", "segment", "balance")
_WON = ("name", "email", "segment", "balance", "address")


def micros(column: str, kind: str) -> Column:
    """Microseconds since 1970, of a time with or without a zone; no zone or its changes of clock play a part."""
    if kind == "timestamp":
        return F.unix_micros(column)
    gap = f"(`{column}` - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    hours = F.expr(f"extract(DAY FROM {gap})").cast("long") * 24 + F.expr(f"extract(HOUR FROM {gap})")
    seconds = F.expr(f"extract(SECOND FROM {gap}) * 1000000").cast("long")
    return (hours * 60 + F.expr(f"extract(MINUTE FROM {gap})")) * 60_000_000 + seconds


def _filled(text: str) -> Column:
    """A string that holds more than white space, else null."""
    return F.when(F.translate(F.col(text), " \t\n\x0b\f\r", "") != "", F.col(text))


def _records(clients: DataFrame, trust: Sequence[str]) -> DataFrame:
    rank = F.coalesce(*(F.when(F.col("source") == s, k) for k, s in enumerate(trust)), F.lit(len(trust)))
    kind = clients.schema["updated_at"].dataType.simpleString()
    balance = F.col("balance").cast("double")
    return clients.select(
        F.coalesce("master_id", "client_id").alias("cluster_id"), "client_id", rank.alias("trust"), micros("updated_at", kind).alias("at"),
        *(_filled(c).alias(c) for c in ("name", "email", "city", "segment")), "nation_id",
        F.when(F.abs(balance) < float("inf"), balance).alias("balance"),
    )


def _recent() -> list[Column]:
    return [F.col("at").desc_nulls_last(), F.col("trust").asc(), F.col("client_id").asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in _FIELDS)]


def _recent_key() -> Column:
    """A value that sorts as RECENT does, for winners of several parts."""
    return F.struct(F.col("at").isNull(), -F.col("at"), "trust", F.col("client_id").isNull(), "client_id", *_FIELDS)


def _chosen(rows: DataFrame, by: Sequence[str], stale: int, keyed: bool) -> DataFrame:
    """A row for each group of the columns ``by``: its counts, and the winner of each field as (key, value, client_id).

    rows has latest and pick, a cluster's latest time and chosen segment where they are known beforehand, else null.
    Keys are left out unless asked for, as they make rows much wider.
    """
    part = W.partitionBy(*by)
    whole = lambda *order: part.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = lambda value, key, *order: F.first(F.when(value.isNotNull(), F.struct(key.alias("key"), value.alias("value"), "client_id")), True).over(whole(*order))

    recent = _recent()
    out = rows.withColumn("recent_key", _recent_key() if keyed else F.lit(0)).withColumns({
        "recent": F.row_number().over(part.orderBy(*recent)),
        "latest": F.coalesce("latest", F.max("at").over(whole(*recent))),
        "segment_won": first(F.col("segment"), F.col("recent_key"), *recent),
    })
    old = F.col("at").isNull() | (F.col("latest") - F.col("at") > stale)
    out = out.withColumns({
        "stale": old, "agrees": F.coalesce(F.col("segment") == F.coalesce("pick", "segment_won.value"), F.lit(False)),
        "parts_known": F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int"),
    }).withColumn("trusted_key", F.struct("stale", "trust", "recent_key") if keyed else F.lit(0))
    trusted = [F.col("stale"), F.col("trust"), F.col("recent")]
    out = out.withColumns({"trusted": F.row_number().over(part.orderBy(*trusted)), "email_won": first(F.col("email"), F.col("trusted_key"), *trusted)})
    size = F.length("name")
    out = out.withColumns({
        "name_won": first(F.col("name"), F.struct(-size, "trusted_key"), size.desc(), F.col("trusted")),
        "balance_won": first(F.col("balance"), F.struct(~F.col("agrees"), "recent_key"), F.col("agrees").desc(), F.col("recent")),
        "address_won": first(F.struct("city", "nation_id"), F.struct(-F.col("parts_known"), "recent_key"), F.col("parts_known").desc(), F.col("recent")),
        "n_records": F.sum("copies").over(part), "n_stale": F.sum(F.when(F.col("stale"), F.col("copies")).otherwise(0)).over(part),
    })
    return out.where("recent = 1").select("cluster_id", "n_records", "n_stale", *(f"{c}_won" for c in _WON))


def golden_records(clients: DataFrame, trust: Sequence[str] = TRUST, stale_hours: int = 60 * 24) -> DataFrame:
    """(cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance, and the id that each came from)."""
    spark = clients.sparkSession
    scratch = Scratch(spark)
    stale = stale_hours * 3_600_000_000
    records = _records(clients, trust)
    total = clients.count()
    heavy = scratch.table(records.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") * SHARE > total).select("cluster_id", F.ceil(F.col("n") * SHARE / total).alias("parts")))
    same = lambda a, b: a["cluster_id"].eqNullSafe(b["cluster_id"])

    light = records.join(F.broadcast(heavy), same(records, heavy), "left_anti")
    light = light.withColumns({"copies": F.lit(1).cast("long"), "latest": F.lit(None).cast("long"), "pick": F.lit(None).cast("string")})

    large = records.join(F.broadcast(heavy), same(records, heavy)).drop(heavy["cluster_id"])
    large = scratch.table(large.groupBy(*records.columns, "parts").agg(F.count("*").alias("copies")))
    facts = large.groupBy("cluster_id").agg(F.max("at").alias("latest"), F.min(F.when(F.col("segment").isNotNull(), F.struct(_recent_key().alias("key"), F.col("segment").alias("value")))).alias("won"))
    facts = scratch.table(facts.select("cluster_id", "latest", F.col("won.value").alias("pick")))
    large = large.join(F.broadcast(facts), same(large, facts)).drop(facts["cluster_id"])
    large = large.withColumn("part", F.pmod(F.xxhash64(*records.columns), F.col("parts")))
    parts = _chosen(large, ("cluster_id", "part"), stale, True)
    whole = parts.groupBy("cluster_id").agg(F.sum("n_records").alias("n_records"), F.sum("n_stale").alias("n_stale"), *(F.min(f"{c}_won").alias(f"{c}_won") for c in _WON))
    return _opened(_chosen(light, ("cluster_id",), stale, False)).unionByName(_opened(whole))


def _opened(won: DataFrame) -> DataFrame:
    known = F.col("address_won.value.city").isNotNull() | F.col("address_won.value.nation_id").isNotNull()
    return won.select(
        "cluster_id", "n_records", "n_stale", *(F.col(f"{c}_won.value").alias(c) for c in ("name", "email", "segment")),
        F.col("address_won.value.city").alias("city"), F.col("address_won.value.nation_id").alias("nation_id"), F.col("balance_won.value").alias("balance"),
        *(F.col(f"{c}_won.client_id").alias(f"{c}_from") for c in ("name", "email", "segment", "balance")), F.when(known, F.col("address_won.client_id")).alias("address_from"),
    )
