"""Registration of queries, and the tables that many of them begin with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import with_sector
from ..sources.cells import cells_from_arrays, cells_from_facts, parts_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, and the matrices made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def catalog(self) -> DataFrame:
        """Leg 0: suppliers by region. Leg 1: parts by size modulo 5."""
        nation = self.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        rows = self.supplier.join(nation, "s_nationkey").select(F.lit(0).alias("leg"), F.col("s_suppkey").alias("idx"), F.col("n_regionkey").alias("q"))
        return rows.union(self.part.select(F.lit(1), "p_partkey", F.col("p_size") % 5))

    def side(self, leg: int) -> DataFrame:
        return self.catalog().where(F.col("leg") == leg).select("idx", F.col("q").alias("sector"))

    def quantity(self) -> DataFrame:
        """Suppliers by parts: quantities, whole numbers."""
        return cells_from_facts(self.lineitem, {"i": "l_suppkey", "j": "l_partkey"}, "l_quantity", parts=parts_of(self.lineitem))

    def sectored(self) -> DataFrame:
        """The same with the sectors of rows and columns."""
        rows = with_sector(self.quantity(), self.catalog(), {"i": 0}, [False], name="row_sector")
        return with_sector(rows, self.catalog(), {"j": 1}, [False], name="col_sector")

    def blocks(self) -> DataFrame:
        """Allowed cells, with their sector."""
        own = self.sectored().where("row_sector = col_sector")
        return own.select("i", "j", F.col("row_sector").alias("sector"), "v")

    def flags(self, flag: str) -> DataFrame:
        """Quantities by supplier and part of one return flag."""
        facts = self.lineitem.where(F.col("l_returnflag") == flag)
        # As many parts for all flags, so that sums of two need no further shuffle.
        return cells_from_facts(facts, {"i": "l_suppkey", "j": "l_partkey"}, "l_quantity", parts=parts_of(self.lineitem))

    def regional(self) -> DataFrame:
        """Regions by part sizes: quantities."""
        supplier = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
        part = self.part.select(F.col("p_partkey").alias("l_partkey"), "p_size")
        facts = self.lineitem.join(supplier, "l_suppkey").join(part, "l_partkey")
        return cells_from_facts(facts, {"i": "n_regionkey", "j": "p_size"}, "l_quantity")

    def vectors(self) -> DataFrame:
        """Embeddings as cells, with the label as sector."""
        cells = cells_from_arrays(self.embeddings, "vec_id", "embedding", keep=["label"])
        return cells.withColumnRenamed("label", "sector")

    def customer_weights(self) -> DataFrame:
        """Weights: a customer's quantity, by nation, each counted for region + 1."""
        # An order's lines are summed first, mostly before the shuffle.
        orders = self.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("v"))
        own = orders.join(self.orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey").agg(F.sum("v").alias("v"))
        customers = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return own.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").alias("sector"), F.col("c_custkey").alias("pos"), (F.col("n_regionkey") + 1).alias("dim"), "v"
        )

    def quantity_hist(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_quantity").cast("int").alias("key")).agg(F.count("*").alias("n"))

    def size_hist(self) -> DataFrame:
        return self.part.groupBy(F.col("p_size").alias("key")).agg(F.count("*").alias("n"))

    def grid(self) -> tuple[DataFrame, tuple[int, int]]:
        """Parts on a grid of 40 columns, labelled by size, and the grid's size."""
        grid = self.part.select((F.col("p_partkey") % 40).cast("int").alias("x"), F.floor(F.col("p_partkey") / 40).cast("int").alias("y"), F.col("p_size").cast("string").alias("label"))
        return grid, (40, (grid.agg(F.max("y")).head()[0] or 0) + 1)

    def bonds(self) -> DataFrame:
        """Orders as bonds of suppliers."""
        return self.lineitem.select(F.col("l_suppkey").alias("tensor"), F.col("l_linenumber").alias("slot"), F.col("l_orderkey").alias("bond"))


#: The same tables in SQL, for the head of a WITH.
CTES = {
    "catalog": "catalog AS (SELECT 0 AS leg, s_suppkey AS idx, n_regionkey AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 1, p_partkey, p_size % 5 FROM part)",
    "quantity": "quantity AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "sectored": "sectored AS (SELECT i, j, v, r.q AS row_sector, c.q AS col_sector FROM quantity JOIN catalog r ON r.leg = 0 AND r.idx = i JOIN catalog c ON c.leg = 1 AND c.idx = j)",
    "blocks": "blocks AS (SELECT i, j, row_sector AS sector, v FROM sectored WHERE row_sector = col_sector)",
    "flag_a": "flag_a AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)",
    "flag_r": "flag_r AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)",
    "regional": "regional AS (SELECT CAST(n_regionkey AS BIGINT) AS i, CAST(p_size AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)",
    "vectors": "vectors AS (SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS j, label AS sector, CAST(embedding[k] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) WHERE embedding[k] <> 0)",
    "weights": "weights AS (SELECT c_nationkey AS sector, c_custkey AS pos, n_regionkey + 1 AS dim, v FROM (SELECT o_custkey, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "quantity_hist": "quantity_hist AS (SELECT CAST(l_quantity AS INTEGER) AS key, count(*) AS n FROM lineitem GROUP BY 1)",
    "size_hist": "size_hist AS (SELECT p_size AS key, count(*) AS n FROM part GROUP BY 1)",
    "grid": "grid AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS x, CAST(p_partkey // 40 AS INTEGER) AS y, CAST(p_size AS VARCHAR) AS label, CAST(max(p_partkey // 40) OVER () + 1 AS INTEGER) AS ly FROM part)",
    "bonds": "bonds AS (SELECT l_suppkey AS tensor, l_linenumber AS slot, l_orderkey AS bond FROM lineitem)",
    "moves": "moves AS (SELECT i, j, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS j FROM events) WHERE i IS NOT NULL GROUP BY 1, 2)",
}
NEEDS = {"sectored": ["catalog", "quantity"], "blocks": ["catalog", "quantity", "sectored"]}


def query(name: str, sql: str | None = None, tables: str = ""):
    """Register ``f(t: Tables)``; ``tables`` names the heads that its SQL begins with."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            heads = [c for own in tables.split() for c in [*NEEDS.get(own, []), own]]
            text = sql.strip()
            recursive = "RECURSIVE " if "RECURSIVE" in text else ""
            text = text.replace("RECURSIVE ", "", 1)
            if heads:
                head = f"WITH {recursive}" + ", ".join(CTES[c] for c in dict.fromkeys(heads))
                text = f"{head}, {text[5:]}" if text.startswith("WITH ") else f"{head} {text}"
            elif recursive:
                text = text.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLE_SQL[name] = text
        return f

    return keep
