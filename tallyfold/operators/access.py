"""Row-level access: which tenant may see which source, and views filtered by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accessible(tenants: DataFrame, sources: DataFrame, grants: DataFrame) -> DataFrame:
    """C9. (tenant_id, source_id) where the source is public, owned or granted: a union
    of three equi-joins instead of a cross join with OR."""
    ids = tenants.select("tenant_id").distinct()
    public = sources.filter("visibility = 'public'").select("source_id")
    everyone = ids.withColumn("one", F.lit(1)).join(public.withColumn("one", F.lit(1)), "one").select("tenant_id", "source_id")
    own = sources.select(F.col("owner_tenant_id").alias("tenant_id"), "source_id").join(ids, "tenant_id")
    granted = grants.select("tenant_id", "source_id").join(ids, "tenant_id").join(sources.select("source_id"), "source_id").select("tenant_id", "source_id")
    return everyone.unionByName(own).unionByName(granted).distinct()


def tenant_view(rows: DataFrame, access: DataFrame, tenant: Column | int, unset_public: bool = True) -> DataFrame:
    """C10. Rows of one tenant's sources; rows without a source count as public only if
    told so."""
    mine = access.filter(F.col("tenant_id") == tenant).select("source_id")
    out = rows.join(mine, "source_id", "left_semi")
    return out.unionByName(rows.filter("source_id is null")) if unset_public else out


def isolate(rows: DataFrame, tenant: Column | int) -> DataFrame:
    """C11. Public, own and untagged legacy rows."""
    return rows.filter((F.col("visibility") == "public") | F.col("owner_tenant_id").eqNullSafe(tenant) | (F.col("visibility").isNull() & F.col("owner_tenant_id").isNull()))


def tier_counts(tenants: DataFrame) -> DataFrame:
    """D31."""
    return tenants.groupBy("tier").agg(F.count("*").alias("n"))
