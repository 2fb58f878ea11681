"""The small relational surface: lookups, counts, upserts, cascades and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(table: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows with one of a request's ids; the list is pushed into the scan."""
    return table.where(F.col(key).isin(ids))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version for each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def link(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Links of both, each once."""
    return old.unionByName(new).dropDuplicates(keys)


def orphans(links: DataFrame, key: str, owners: DataFrame) -> DataFrame:
    """Links whose owner is gone."""
    return links.join(owners.select(key), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the keys in gone."""
    return {name: t.join(gone.select(key), key, "left_anti") if key in t.columns else t for name, t in tables.items()}


def contains_ci(table: DataFrame, column: str, text: str, limit: int = 50, order: str = "entity_id") -> DataFrame:
    """Rows whose column holds text in any case, the first by order."""
    return table.where(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(order).limit(limit)


def next_sort_order(categories: DataFrame, parent: str, order: str) -> DataFrame:
    return categories.groupBy(parent).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_order"))


def reorder(categories: DataFrame, ids: list, key: str, order: str) -> DataFrame:
    """Categories named in ids take their place in it as order; the rest stay."""
    place = F.array_position(F.array(*(F.lit(i) for i in ids)), F.col(key)) - 1
    return categories.withColumn(order, F.when(place >= 0, place).otherwise(F.col(order)).cast("long"))


def category_depth(categories: DataFrame) -> DataFrame:
    """(id, depth) of a two-level tree (id, parent_id with 0 for roots); a missing parent or a deeper level is depth 0 (invalid)."""
    parents = categories.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grand"))
    joined = categories.join(parents, "parent_id", "left")
    return joined.select("id", F.when(F.col("parent_id") == 0, 1).when(F.col("grand") == 0, 2).otherwise(0).alias("depth"))


def status_counts(documents: DataFrame, key: str, status: str) -> DataFrame:
    """Documents of each key in all and by status."""
    return documents.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == s).alias(name) for s, name in (("PENDING", "pending"), ("PROCESSING", "processing"), ("FAILED", "failed"), ("INDEXED", "indexed")))
    )


def delete_knowledge_base(tables: dict[str, DataFrame], kb: int) -> dict[str, DataFrame]:
    """Every table without a knowledge base's rows: those of its own kb_id, and links of its entities (entity_chunk)."""
    gone = tables["entities"].where(F.col("kb_id") == kb).select("entity_id") if "entities" in tables else None
    out = {}
    for name, t in tables.items():
        if "kb_id" in t.columns:
            out[name] = t.where(~F.col("kb_id").eqNullSafe(F.lit(kb)))
        elif gone is not None and "entity_id" in t.columns:
            out[name] = t.join(gone, "entity_id", "left_anti")
        else:
            out[name] = t
    return out


def listed(table: DataFrame, *order: str) -> DataFrame:
    """Rows in a listing's order: column names, `-` before those that descend; ties need a last key that is unique."""
    return table.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order))


def deletable(categories: DataFrame, bases: DataFrame) -> DataFrame:
    """Categories (id, parent_id) that may go: without children and without knowledge bases (category_id)."""
    used = categories.select(F.col("parent_id").alias("id")).unionByName(bases.select(F.col("category_id").alias("id"))).distinct()
    return categories.join(used, "id", "left_anti")


def save_evaluation(result: DataFrame, folder: str, name: str) -> None:
    """An evaluation's rows as JSON under folder/name; the folder appears whole or not at all, by the writer's commit."""
    result.write.mode("overwrite").json(f"{folder}/{name}")
