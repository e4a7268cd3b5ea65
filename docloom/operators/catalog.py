"""List, filter, join and tree operators of the catalogue: pages of results, optional predicates, counts, adjacency trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column free. A ``deleted`` column must not be true."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name).isin(value) if isinstance(value, list | tuple | set) else F.col(name) == value)
    return df.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in df.columns else df


def like_any(df: DataFrame, keyword: str | None, *columns: str, ignore_case: bool = False) -> DataFrame:
    """Rows in which any of the columns holds the keyword; none given keeps all."""
    if not keyword:
        return df
    test = F.lit(False)
    for c in columns:
        test = test | (F.contains(F.lower(c), F.lit(keyword.lower())) if ignore_case else F.contains(F.col(c), F.lit(keyword)))
    return df.filter(test)


def page(df: DataFrame, order: list[Column], current: int = 1, size: int = 10) -> DataFrame:
    """One page in the given order (make it total with an id): Spark keeps the first current * size rows a task, nothing more."""
    return df.orderBy(*order).offset(max(0, (current - 1) * size)).limit(size)


def page_totals(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).cast("long").alias("pages"))


def counts_per(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Parents with their number of children, 0 for none; children are counted before the join."""
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__n")


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of largest ``order`` of each key, whole, by one aggregation without a sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("__row")).select(key, "__row.*")


def accessible(owner: Column, user: Column, is_admin: Column, public: bool = True) -> Column:
    """Admins, owners, and where public anonymous users."""
    return is_admin | (owner == user) | (user.isNull() if public else F.lit(False))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str) -> DataFrame:
    """Parents with their children as an ordered array of structs; empty for none."""
    rest = [c for c in children.columns if c not in (key, order)]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("children"))
    return parents.join(lists, key, "left").withColumn("children", F.coalesce("children", F.array()))


def tree(nodes: DataFrame, root: str = "") -> DataFrame:
    """nodes: (code, parent, sort). Depth and path of every node below a root (parent null or ``root``); orphans are left out."""
    spark = nodes.sparkSession
    nodes.select("code", F.coalesce("parent", F.lit(root)).alias("parent"), "sort").createOrReplaceTempView("__tree_nodes")
    return spark.sql(
        """WITH RECURSIVE t(code, depth, path) AS (
              SELECT code, 0, code FROM __tree_nodes WHERE parent = :root
              UNION ALL SELECT n.code, t.depth + 1, concat(t.path, '/', n.code) FROM t JOIN __tree_nodes n ON n.parent = t.code)
            SELECT code, depth, path FROM t""",
        args={"root": root},
    )


def set_enabled(df: DataFrame, ids: list, enabled: bool, key: str = "id") -> DataFrame:
    """The table with ``enabled`` changed for the ids that are not deleted."""
    return df.withColumn("enabled", F.when(F.col(key).isin(ids) & ~F.coalesce("deleted", F.lit(False)), F.lit(enabled)).otherwise(F.col("enabled")))
