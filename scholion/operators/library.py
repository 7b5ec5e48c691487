"""Entity-attribute-value tables and trees of collections, as a reference manager keeps them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pivot_values(values: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row a key with the named attributes as columns; of repeated ones the smallest. One aggregate, no join."""
    picked = [F.min(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    return values.where(F.col(name).isin(*names)).groupBy(key).agg(*picked)


def attribute_map(values: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One row a key with all attributes as a map, names in order."""
    pairs = values.groupBy(key, name).agg(F.min(value).alias("__v")).groupBy(key)
    return pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("__v"))))).alias("attributes"))


def tree_paths(spark: SparkSession, nodes: DataFrame, node: str, parent: str, name: str, separator: str = "/") -> DataFrame:
    """``node, root, depth, path`` of a forest given by parent links, by a recursive query; cycles are never entered."""
    nodes.select(F.col(node).alias("n"), F.col(parent).alias("p"), F.col(name).cast("string").alias("t")).createOrReplaceTempView("__tree")
    return spark.sql(f"""
        WITH RECURSIVE walk(n, root, depth, path) AS (
            SELECT n, n, 0, t FROM __tree WHERE p IS NULL
            UNION ALL
            SELECT c.n, w.root, w.depth + 1, concat(w.path, '{separator}', c.t) FROM walk w JOIN __tree c ON c.p = w.n
        )
        SELECT n AS {node}, root, depth, path FROM walk
    """)


def descendants(spark: SparkSession, nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """``ancestor, {node}`` of every node with itself and all below it."""
    nodes.select(F.col(node).alias("n"), F.col(parent).alias("p")).createOrReplaceTempView("__tree2")
    return spark.sql(f"""
        WITH RECURSIVE below(a, n) AS (
            SELECT n, n FROM __tree2
            UNION ALL
            SELECT b.a, c.n FROM below b JOIN __tree2 c ON c.p = b.n
        )
        SELECT a AS ancestor, n AS {node} FROM below
    """)


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with those rows whose keys it does not have."""
    new = rows.dropDuplicates(list(keys))
    return table.unionByName(new.join(table.select(*keys), list(keys), "left_anti").select(table.columns))


def delete_rows(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti").select(table.columns)


def unique_leaf(paths: DataFrame, ref: Column, node: str) -> DataFrame:
    """A reference resolved by id, else by full path, else by a name that only one node has."""
    leaf = F.element_at(F.split("path", "/"), -1)
    hit = F.when(F.col(node).cast("string") == ref, 0).when(F.col("path") == ref, 1).when(leaf == ref, 2)
    ranked = paths.withColumn("__h", hit).where("__h is not null")
    per = ranked.groupBy("__h").agg(F.min(node).alias(node), F.count("*").alias("__n")).where("__h < 2 or __n = 1")
    return per.agg(F.min_by(node, "__h").alias(node))
