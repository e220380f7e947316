"""Apply jobs: merge detection, verification and geocoding results into the rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.functions.text import address_key, format_address, verify_flag
from belfry.operators import filters

ADDRESS = ["line1", "line2", "city", "state", "postal_code"]


def apply_detect(roster: DataFrame, results: DataFrame) -> DataFrame:
    """Roster with provider fields replaced where a result exists; nulls become empty text.

    ``results``: slug, bulletin_provider, provider_id.  Adds ``updated``.
    """
    new = results.select("slug", F.col("bulletin_provider").alias("new_provider"),
                         F.col("provider_id").alias("new_id"), F.lit(True).alias("hit"))
    def pick(fresh: str, old: str):
        return F.coalesce(F.when(F.col("hit"), F.coalesce(fresh, F.lit(""))).otherwise(F.col(old)), F.lit(""))
    return (roster.join(new, "slug", "left")
            .withColumn("bulletin_provider", pick("new_provider", "bulletin_provider"))
            .withColumn("provider_id", pick("new_id", "provider_id"))
            .withColumn("updated", F.coalesce("hit", F.lit(False))).drop("new_provider", "new_id", "hit"))


# --- verification ------------------------------------------------------------------------------

def _verdicts(results: DataFrame) -> DataFrame:
    """(slug, doc, v): the last verdict per church and everything that corrected it.

    ``results``: idx (document order), slug (parish), value (verification struct).
    A later verdict overrides the flags; corrected text from an earlier one stays unless
    replaced, so name and address corrections are ranked separately.
    """
    rows = results.select(F.col("idx").alias("doc"), F.posexplode("value.existing_churches").alias("pos", "v")).where(
        F.coalesce("v.church_slug", F.lit("")) != "")
    order = F.struct("doc", "pos")
    named = (F.col("v.name_status") == "incorrect") & (F.coalesce("v.corrected_name", F.lit("")) != "")
    placed = (F.col("v.address_status") == "incorrect") & F.col("v.corrected_address").isNotNull()
    return rows.withColumn("order", order).withColumn("named", named).withColumn("placed", placed)


def apply_verify(roster: DataFrame, results: DataFrame) -> DataFrame:
    """Roster with verdicts applied and new churches appended.

    ``roster``: church columns plus idx.  Adds ``corrected`` and ``added`` flags.  A new
    church can only be matched by verdicts of later documents.
    """
    new = results.select(F.col("idx").alias("doc"), F.col("slug").alias("parish_id"),
                         F.posexplode("value.new_churches").alias("pos", "n"))
    new = new.where((F.coalesce("n.slug", F.lit("")) != "") & (F.coalesce("n.name", F.lit("")) != ""))
    first = new.groupBy(F.col("n.slug").alias("slug")).agg(
        F.min_by(F.struct("doc", "pos", "parish_id", "n"), F.struct("doc", "pos")).alias("f"))
    fresh = first.join(roster.select("slug"), "slug", "left_anti").select(
        F.col("f.parish_id").alias("parish_id"), "slug", F.col("f.n.name").alias("name"),
        *[F.coalesce(F.col(f"f.n.address.{a}"), F.lit("")).alias(a) for a in ADDRESS],
        *[F.lit("").alias(c) for c in ("name_verified", "address_verified", "latitude", "longitude")],
        F.col("f.doc").alias("since"), F.struct(F.col("f.doc"), F.col("f.pos")).alias("new_at"))
    old = roster.withColumn("since", F.lit(-1).cast("bigint")).withColumn(
        "new_at", F.lit(None).cast(fresh.schema["new_at"].dataType))
    everyone = old.unionByName(fresh, allowMissingColumns=True)
    verdicts = _verdicts(results).withColumn("slug", F.col("v.church_slug"))
    born = everyone.groupBy("slug").agg(F.max("since").alias("since"), F.max("idx").alias("last_idx"))
    v = verdicts.join(born, "slug").where(F.col("doc") > F.col("since"))
    folded = v.groupBy("slug").agg(
        F.max_by("v", "order").alias("last"),
        F.max_by("named", "order").alias("last_named"), F.max_by("placed", "order").alias("last_placed"),
        F.max_by("v.corrected_name", F.when(F.col("named"), F.col("order"))).alias("new_name"),
        F.max_by("v.corrected_address", F.when(F.col("placed"), F.col("order"))).alias("new_address"),
        F.max(F.col("named") | F.col("placed")).alias("corrected"), F.max("last_idx").alias("last_idx"))
    # where a roster repeats a slug, its last row is the one that is corrected
    folded = folded.withColumn("target_idx", F.coalesce("last_idx", F.lit(-1))).drop("last_idx")
    out = everyone.withColumn("target_idx", F.coalesce("idx", F.lit(-1))).join(folded, ["slug", "target_idx"], "left")
    hit = F.col("last").isNotNull()
    flags = {
        "name_verified": F.when(F.col("last_named"), "true").otherwise(verify_flag(F.col("last.name_status"))),
        "address_verified": F.when(F.col("last_placed"), "true").otherwise(verify_flag(F.col("last.address_status"))),
    }
    moved = F.col("new_address").isNotNull()
    return out.select(
        "parish_id", "slug", F.coalesce("new_name", "name").alias("name"),
        *[F.when(moved, F.coalesce(F.col(f"new_address.{a}"), F.lit(""))).otherwise(F.col(a)).alias(a) for a in ADDRESS],
        *[F.when(hit, expr).otherwise(F.coalesce(c, F.lit(""))).alias(c) for c, expr in flags.items()],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("latitude", "longitude")],
        "idx", "new_at", F.coalesce("corrected", F.lit(False)).alias("corrected"),
        F.col("new_at").isNotNull().alias("added"))


def verify_counters(applied: DataFrame) -> DataFrame:
    return applied.agg(F.count_if("corrected").alias("corrections_applied"),
                       F.count_if("added").alias("new_churches_added"))


# --- geocoding ---------------------------------------------------------------------------------

def geocode_pending(church: DataFrame, limit: int | None = None) -> DataFrame:
    """Churches with a street line whose address key no located church has; repeats are kept."""
    key = address_key(*[F.col(c) for c in ("address_line1", "address_line2", "city", "state", "postal_code")])
    keyed = church.withColumn("address_key", key)
    located = keyed.where(filters.has_coords()).select("address_key").distinct()
    pending = (keyed.where(F.coalesce("address_line1", F.lit("")) != "")
               .join(located, "address_key", "left_anti")
               .select("id", "address_line1", "address_line2", "city", "state", "postal_code", "address_key"))
    return pending.orderBy("id").limit(limit) if limit is not None else pending


def geocode(pending: DataFrame, lookup: DataFrame) -> DataFrame:
    """Pending rows with latitude, longitude from a user-supplied (address, latitude, longitude) table."""
    address = format_address(*[F.col(c) for c in ("address_line1", "address_line2", "city", "state", "postal_code")])
    return pending.withColumn("address", address).join(lookup, "address", "left")


def geocode_counters(located: DataFrame) -> DataFrame:
    return located.agg(F.count(F.lit(1)).alias("checked"), F.count_if(filters.has_coords()).alias("updated"),
                       F.count_if(~filters.has_coords()).alias("failed"))


def apply_geocode(roster: DataFrame, results: DataFrame) -> DataFrame:
    """Coordinates for every roster row sharing an address key; the last usable result counts.

    ``roster`` has the file's line1.. columns; adds ``updated``.
    """
    usable = results.where(F.coalesce(filters.coords_in_range(), F.lit(False)))
    key = address_key(*[F.col(c) for c in ADDRESS])
    last = usable.groupBy(key.alias("address_key")).agg(
        F.max_by(F.struct("latitude", "longitude"), "idx").alias("g"))
    joined = roster.withColumn("address_key", key).join(last, "address_key", "left")
    return (joined.withColumn("updated", F.col("g").isNotNull())
            .withColumn("latitude", F.coalesce("g.latitude", "latitude"))
            .withColumn("longitude", F.coalesce("g.longitude", "longitude")).drop("g", "address_key"))


__all__ = ["apply_detect", "apply_geocode", "apply_verify", "geocode",
           "geocode_counters", "geocode_pending", "verify_counters"]
