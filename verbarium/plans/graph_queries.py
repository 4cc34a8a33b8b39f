"""Registered queries over graphs: validation against a profile, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- a graph of customers, suppliers and orders; some of it breaks the profile -----------------------------------------------------------

PROFILE = profiles.Profile(
    rules=(
        profiles.Rule("Person", "name", 1, 1, "text"),
        profiles.Rule("Person", "segment", 1, 1, values=("BUILDING", "MACHINERY", "AUTOMOBILE")),
        profiles.Rule("Organization", "balance", 1, 1, "number", pattern="[0-9]+[.][0-9]{2}"),
        profiles.Rule("Supplier", "name", 1, 1),
        profiles.Rule("Order", "customer", 1, 1, "entity", targets=("Organization",)),
        profiles.Rule("Order", "date", 1, 1, "date"),
        profiles.Rule("Order", "note", 0, 1),
        profiles.Rule("Order", "total", 1, 1, "number"),
    ),
    parents={"Supplier": ("Organization",)},
    closed=frozenset({"Supplier"}),
    least={"Place": 2, "Order": 1},
)


def shop_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entity and property tables. Customers with a debt are persons only; every 97th order refers to nobody, every 50th has a total in words, every 40th no date; notes are
    one for each order, a second for every 30th."""
    c, s, o = _t(spark, d, "customer"), _t(spark, d, "supplier"), _t(spark, d, "orders")
    ident = lambda p, k: F.concat(F.lit(f"#{p}"), F.col(k).cast("string"))
    none, text = F.lit(None).cast("string"), lambda x: F.col(x).cast("string")
    money = lambda x: F.col(x).cast("decimal(14,2)").cast("string")
    both, person = F.array(F.lit("Person"), F.lit("Organization")), F.array(F.lit("Person"))
    entity = c.select(ident("c", "c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, person).otherwise(both).alias("types"))
    entity = entity.unionByName(s.select(ident("s", "s_suppkey").alias("id"), F.array(F.lit("Supplier")).alias("types"))).unionByName(o.select(ident("o", "o_orderkey").alias("id"), F.array(F.lit("Order")).alias("types")))

    def props(table: DataFrame, key, made: list[tuple]) -> DataFrame:
        one = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("ord"), v.alias("value"), r.alias("ref"), w.alias("has")) for k, n, v, r, w in made])
        return table.select(key.alias("id"), F.explode(one).alias("p")).where("p.has").select("id", "p.key", "p.ord", "p.value", "p.ref")

    true, every = F.lit(True), lambda n: F.col("o_orderkey") % n == 0
    prop = props(c, ident("c", "c_custkey"), [("name", 0, text("c_name"), none, true), ("segment", 0, text("c_mktsegment"), none, true), ("balance", 0, money("c_acctbal"), none, true)])
    prop = prop.unionByName(props(s, ident("s", "s_suppkey"), [("name", 0, text("s_name"), none, true), ("balance", 0, money("s_acctbal"), none, true), ("nation", 0, none, ident("n", "s_nationkey"), true)]))
    customer = F.when(every(97), "#c-1").otherwise(ident("c", "o_custkey"))
    return entity, prop.unionByName(props(o, ident("o", "o_orderkey"), [
        ("customer", 0, none, customer, true), ("date", 0, F.date_format("o_orderdate", "yyyy-MM-dd"), none, ~every(40)), ("total", 0, F.when(every(50), "much").otherwise(money("o_totalprice")), none, true),
        ("note", 0, text("o_orderstatus"), none, true), ("note", 1, text("o_orderpriority"), none, every(30)),
    ]))


@query("profile_violations", """
WITH c AS (SELECT '#c' || c_custkey AS id, c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS odd, c_acctbal < 0 AS debt FROM customer),
o AS (SELECT '#o' || o_orderkey AS id, o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN '#c-1' ELSE '#c' || o_custkey END AS customer FROM orders),
v AS (
  SELECT id, 'Person' AS class, 'segment' AS property, 'value' AS problem, 1 AS found, 'BUILDING|MACHINERY|AUTOMOBILE' AS expected FROM c WHERE odd
  UNION ALL SELECT '#s' || s_suppkey, 'Organization', 'balance', 'pattern', 1, '[0-9]+[.][0-9]{2}' FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT '#s' || s_suppkey, 'Supplier', 'nation', 'unknown property', 1, 'a property of the profile' FROM supplier
  UNION ALL SELECT o.id, 'Order', 'customer', 'target', 1, 'Organization' FROM o JOIN c ON o.customer = c.id WHERE debt
  UNION ALL SELECT o.id, 'Order', 'customer', 'dangling', 1, 'an entity of the graph' FROM o WHERE customer NOT IN (SELECT id FROM c)
  UNION ALL SELECT id, 'Order', 'date', 'missing', 0, 'at least 1' FROM o WHERE k % 40 = 0
  UNION ALL SELECT id, 'Order', 'total', 'kind', 1, 'number' FROM o WHERE k % 50 = 0
  UNION ALL SELECT id, 'Order', 'note', 'too many', 2, 'at most 1' FROM o WHERE k % 30 = 0
  UNION ALL SELECT NULL, 'Place', NULL, 'too few entities', 0, 'at least 2')
SELECT id, class, property, problem, found::BIGINT AS found, expected, CASE WHEN id IS NULL THEN class ELSE id || ' (' || class || '): ' || property END || ': ' || problem || ', ' || found || ' found, expected ' || expected AS message FROM v""")
def profile_violations(spark, d):
    return profiles.validate(*shop_graph(spark, d), PROFILE).withColumn("message", profiles.message())
