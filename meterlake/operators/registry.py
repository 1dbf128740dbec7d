"""Registry of sources: reconcile, missing, deactivate, collisions (JOIN-11..13, AGG-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(discovered: DataFrame, registry: DataFrame) -> DataFrame:
    """(project_id, path, old_path, action) of each discovered (project_id, path).

    discovered may have `old_path_valid` (the registered path still holds this project).
    Actions: new, same, reactivate (known but inactive), moved, conflict_old_path (moved, but
    the old path is still valid), conflict_path (the path belongs to another project).
    """
    known = registry.select("project_id", F.col("path").alias("old_path"), "active")
    owner = registry.select(F.col("project_id").alias("owner"), "path")
    joined = discovered.join(known, "project_id", "left").join(owner, "path", "left")
    valid = F.col("old_path_valid") if "old_path_valid" in discovered.columns else F.lit(False)
    action = (
        F.when(F.col("owner") != F.col("project_id"), "conflict_path")
        .when(F.col("old_path").isNull(), "new")
        .when((F.col("old_path") != F.col("path")) & valid, "conflict_old_path")
        .when(~F.col("active"), "reactivate")
        .when(F.col("old_path") != F.col("path"), "moved")
        .otherwise("same")
    )
    return joined.select("project_id", "path", "old_path", action.alias("action"))


def missing(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Active sources whose path isn't in the listing."""
    return registry.filter("active").join(listing.select("path"), "path", "left_anti")


def deactivate(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """The registry with the given projects inactive, and `deactivated` for those that were active."""
    hit = registry.join(ids.select("project_id").distinct().withColumn("hit__", F.lit(True)), "project_id", "left")
    turned = F.col("active") & F.col("hit__").isNotNull()
    return hit.withColumns({"deactivated": turned, "active": F.col("active") & F.col("hit__").isNull()}).drop("hit__")


def collisions(registry: DataFrame) -> DataFrame:
    """(project_id, n): projects with more than one active source."""
    return registry.filter("active").groupBy("project_id").agg(F.count("*").alias("n")).filter("n > 1")
