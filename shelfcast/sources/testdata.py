"""The retail roles played by the order tables: nations are stores, parts are items,
order lines are sales.

Prices and promotions that the order tables lack are derived from them, holidays are the
short fixed list below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the item type whose prices are left to the defaults
UNPRICED = "MEDIUM"
# --- fixed values: holidays (date, type, locale, locale_name, description, transferred) ---
HOLIDAYS = [
    ("1996-01-01", "Holiday", "National", "World", "New year", False),
    ("1997-05-01", "Holiday", "National", "World", "Labour day", False),
    ("1998-08-10", "Holiday", "National", "World", "Independence", True),
    ("1998-08-12", "Transfer", "National", "World", "Moved independence", False),
    ("1999-12-25", "Holiday", "National", "World", "Christmas", False),
    ("1999-12-25", "Additional", "National", "World", "Christmas +0", False),
    ("2000-04-16", "Event", "National", "World", "Terremoto Manabi", False),
    ("2000-04-17", "Event", "National", "World", "TERREMOTO Manabi +1", False),
    ("2000-06-25", "Holiday", "Regional", "ASIA", "Provincial day", False),
    ("2000-06-25", "Holiday", "Regional", "ASIA", "Provincial day copy", False),
    ("2001-03-02", "Holiday", "Regional", "AMERICA", "Carnival", False),
    ("2001-07-24", "Holiday", "Local", "NATION_7", "City day", False),
    ("2001-10-09", "Holiday", "Local", "NATION_3", "City day", False),
    ("2001-10-12", "Holiday", "Regional", "EUROPE", "Harvest day", False),
    ("2001-10-25", "Holiday", "Local", "NATION_11", "City day", False),
    ("2001-11-02", "Holiday", "National", "World", "All souls", False),
]
COAST = ["AMERICA", "ASIA"]


def fixed_rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A short fixed list as a local relation, whose size the planner knows."""

    def literal(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


class OrderTables:
    """Retail views over one folder of order tables; every property is a lazy plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def stores(self) -> DataFrame:
        key = F.col("n_nationkey")
        kind = F.element_at(F.array(*[F.lit(t) for t in "ABCDE"]), (key % 5 + 1).cast("int"))
        joined = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            key.alias("store_nbr"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            kind.alias("type"),
            (key % 12).alias("cluster"),
        )

    @property
    def items(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("item_nbr"),
            F.col("p_type").alias("family"),
            F.col("p_size").alias("class"),
            (F.col("p_size") % 4 == 0).cast("int").alias("perishable"),
            F.col("p_name").alias("name"),
        )

    def lines(self, *columns: str) -> DataFrame:
        suppliers = self.read("supplier").select("s_suppkey", "s_nationkey")
        lines = self.read("lineitem").select("l_suppkey", "l_shipdate", *columns)
        return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.to_date("l_shipdate").alias("date"), F.col("s_nationkey").alias("store_nbr"), *columns
        )

    @property
    def raw_sales(self) -> DataFrame:
        """Every order line as a sale; some are returns, some of them keyed ten times over."""
        factor = F.when(F.col("l_linenumber") == 7, 10).otherwise(1)
        returned = (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.085)
        promo = F.when(F.col("l_discount") < 0.005, None).when(F.col("l_discount") > 0.065, 1).otherwise(0)
        lines = self.lines("l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linenumber")
        return lines.select(
            "date",
            "store_nbr",
            F.col("l_partkey").alias("item_nbr"),
            F.when(returned, -F.col("l_quantity") * factor).otherwise(F.col("l_quantity")).alias("unit_sales"),
            promo.cast("int").alias("onpromotion"),
        )

    @property
    def transactions(self) -> DataFrame:
        """Distinct orders per store and day."""
        counted = self.lines("l_orderkey").groupBy("date", "store_nbr").agg(
            F.count_distinct("l_orderkey").cast("int").alias("n_invoices")
        )
        return counted.withColumn("transactions", F.col("n_invoices"))

    @property
    def oil(self) -> DataFrame:
        """A daily price with gaps, from order values."""
        day = F.to_date("o_orderdate")
        gap = (F.dayofmonth("date") % 7).isin(5, 6)
        daily = self.read("orders").groupBy(day.alias("date")).agg((F.avg("o_totalprice") / 5000).alias("_p"))
        return daily.select("date", F.when(~gap, F.col("_p")).alias("dcoilwtico"))

    @property
    def prices(self) -> DataFrame:
        """Prices by item type: a share of the dearest retail price, rates that go with the number
        of items.  One type is written in lower case, as names in price lists may be."""
        n = F.count(F.lit(1))
        by_type = self.read("part").filter(F.col("p_type") != UNPRICED).groupBy("p_type").agg(
            (F.max("p_retailprice") / (F.length("p_type") * 50)).alias("unit_price"),
            (F.lit(0.6) + n % 7 * F.lit(0.03)).alias("cost_ratio"),
            (F.lit(0.01) + n % 5 * F.lit(0.005)).alias("return_rate"),
        )
        family = F.when(F.col("p_type") == "LARGE", F.lower("p_type")).otherwise(F.col("p_type"))
        return by_type.select(family.alias("family"), "unit_price", "cost_ratio", "return_rate")

    @property
    def holidays(self) -> DataFrame:
        columns = "date, type, locale, locale_name, description, transferred"
        rows = fixed_rows(self.spark, HOLIDAYS, columns)
        return rows.withColumn("date", F.to_date("date"))

    @property
    def access(self) -> DataFrame:
        """One manager per store and one per region."""
        stores = self.stores
        own = stores.select(F.concat(F.lit("manager"), F.col("store_nbr")).alias("username"), "store_nbr")
        regional = stores.select(F.concat(F.lit("region_"), F.lower("state")).alias("username"), "store_nbr")
        return own.unionByName(regional)

    @property
    def conversations(self) -> DataFrame:
        return self.read("conversations")
