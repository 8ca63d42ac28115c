"""The driver's tables read as the engine's inputs, in DataFrames and in SQL.

``places`` is a table of businesses over ``customer``, ``results`` one of run results over ``orders``; their columns are
integer arithmetic on keys, so both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("Sri Balaji Pooja Store", "Iron Gym", "City Bakery Pvt Ltd", "Apex Dental Clinic", "Royal Hotel", "Metro Pharmacy", "Green Salon", "Divine Footwear")
CATEGORIES = ("pooja_store", "gym", "bakery", "dental_clinic", "hotel", "pharmacy", "beauty_salon", "shoe_store")


class Tables:
    """Tables of a folder by name, and the carriers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *tables: str) -> DataFrame:
        """A statement over the named tables, which it sees as arguments and not as views of the session."""
        return self.spark.sql(text, **{x: getattr(self, x) for x in tables})

    @property
    def places(self) -> DataFrame:
        k = F.col("c_custkey")
        pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 8 + 1).cast("int"))
        return self.customer.select(
            k.alias("id"),
            F.concat(pick(NAMES), F.lit(" "), (k % 50).cast("string")).alias("name"),
            pick(CATEGORIES).alias("category"),
            (F.lit(77.5) + (k * 37 % 1000) / 1000.0).alias("lon"),
            (F.lit(12.8) + (k * 91 % 1000) / 1000.0).alias("lat"),
            F.when(k % 3 != 0, F.concat(F.lit("+91"), (F.lit(6_000_000_000) + k % 40 * 7919 + k % 7 * 500_000_000).cast("string"))).alias("phone"),
            F.when(k % 4 != 0, F.concat(F.lit("site"), (k % 37).cast("string"), F.lit(".in"))).alias("domain"),
            F.when(k % 11 == 0, "permanently_closed").when(k % 7 != 0, "operational").alias("status"),
            F.element_at(F.array(F.lit("overture"), F.lit("osm"), F.lit("import")), (k % 3 + 1).cast("int")).alias("source"),
            (k % 100 / 100.0).alias("confidence"),
        )

    @property
    def results(self) -> DataFrame:
        k, s = F.col("o_orderkey"), F.col("o_orderstatus")
        return self.orders.select(
            (k % 10).alias("run_id"),
            F.col("o_custkey").alias("business_id"),
            k.alias("rank"),
            F.when(s == "F", "accepted").when(s == "O", "review").otherwise("rejected").alias("decision"),
            (k * 37 % 100 / 100.0).alias("relevance_p"),
            (k % 5 == 0).alias("is_new"),
            F.col("o_orderdate").alias("created_at"),
        )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PLACES = f"""places AS (SELECT c_custkey AS id, ({_list(NAMES)})[(c_custkey % 8 + 1)::INT] || ' ' || (c_custkey % 50) AS name,
  ({_list(CATEGORIES)})[(c_custkey % 8 + 1)::INT] AS category,
  77.5::DOUBLE + (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS lon, 12.8::DOUBLE + (c_custkey * 91 % 1000) / 1000.0::DOUBLE AS lat,
  CASE WHEN c_custkey % 3 <> 0 THEN '+91' || (6000000000 + c_custkey % 40 * 7919 + c_custkey % 7 * 500000000) END AS phone,
  CASE WHEN c_custkey % 4 <> 0 THEN 'site' || (c_custkey % 37) || '.in' END AS domain,
  CASE WHEN c_custkey % 11 = 0 THEN 'permanently_closed' WHEN c_custkey % 7 <> 0 THEN 'operational' END AS status,
  (['overture', 'osm', 'import'])[(c_custkey % 3 + 1)::INT] AS source, c_custkey % 100 / 100.0::DOUBLE AS confidence FROM customer)"""
RESULTS = """results AS (SELECT o_orderkey % 10 AS run_id, o_custkey AS business_id, o_orderkey AS rank,
  CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'review' ELSE 'rejected' END AS decision,
  o_orderkey * 37 % 100 / 100.0::DOUBLE AS relevance_p, o_orderkey % 5 = 0 AS is_new, o_orderdate AS created_at FROM orders)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL; CTEs named in it are put in front."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            text = sql.strip()
            found = [x for k, x in (("places", PLACES), ("results", RESULTS)) if k in text]
            if found:
                start = "WITH RECURSIVE " if text.startswith("WITH RECURSIVE ") else "WITH "
                text = f"{start}{', '.join(found)}" + (", " + text[len(start) :] if text.startswith("WITH ") else f" {text}")
            ORACLE_SQL[f.__name__] = text
        return f

    return register
