"""Relational reports of the demonstration shop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(orders: DataFrame, users: DataFrame) -> DataFrame:
    o = orders.agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("revenue"))
    return o.join(users.agg(F.count(F.lit(1)).alias("users")))  # two one-row aggregates


def order_totals(items: DataFrame, products: DataFrame) -> DataFrame:
    lines = items.join(products, "product_id")
    return lines.groupBy("order_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("total"), F.count(F.lit(1)).alias("lines"))


def order_lines(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    return orders.join(items, "order_id").join(products, "product_id")


def rejected_items(items: DataFrame, products: DataFrame) -> DataFrame:
    return items.join(products.select("product_id"), "product_id", "left_anti")
