"""The jobs' input tables, derived by Spark from the benchmark tables in a folder.

Fixed parameters: replication factor 5, providers as seen since 2000-11-14, ``as_of`` 2024-02-01
UTC, seed 7, run 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 5
AS_OF = "2024-02-01 00:00:00"
SINCE = "2000-11-14 00:00:00"
SEED, RUN = 7, 0

# Ids derived from row keys are no content ids, so the id check takes this pattern.
ANY_ID = "^[0-9A-Za-z-]+$"


# The columns the jobs use of each table.
TABLES = {
    "nation": "n_nationkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, user_id bigint, event_type string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


class Fixtures:
    """One DataFrame per table; each reads only the columns and tables it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            reader = self.spark.read.schema(TABLES[name])
            self._read[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def _node_of(self, key: str):
        return F.col(key) % self.table("supplier").select(F.count("*")).scalar()

    def catalog(self) -> DataFrame:
        key = F.col("p_partkey")
        stored = F.expr("(p_partkey div 10) % 4 = 0")
        day = F.expr("TIMESTAMP '2024-01-01 00:00:00' + (p_partkey % 30) * INTERVAL '1' DAY")
        return (
            self.table("part")
            .filter(key % 10 != 0)
            .select(
                self._node_of("p_partkey").cast("string").alias("node_id"),
                key.cast("string").alias("id"),
                F.col("p_name").alias("name"),
                (F.col("p_size").cast("bigint") * 20_000_000).alias("size"),
                F.when(stored, "local").otherwise("remote").alias("status"),
                day.alias("modified"),
                (key % 8).cast("int").alias("replications"),
            )
        )

    def manifest(self) -> DataFrame:
        key = F.col("p_partkey")
        renamed = F.when(key % 7 == 0, F.concat("p_name", F.lit(".v2")))
        return (
            self.table("part")
            .filter(key % 10 != 1)
            .select(
                key.cast("string").alias("id"),
                renamed.otherwise(F.col("p_name")).alias("name"),
                self._node_of("p_partkey").cast("string").alias("node_id"),
            )
        )

    def providers(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(
                F.col("l_partkey").cast("string").alias("id"),
                F.col("l_suppkey").cast("string").alias("peer_id"),
                F.col("l_shipdate").cast("timestamp").alias("seen_at"),
                (F.col("l_orderkey") % 997 != 0).alias("ok"),
            )
        )

    def objects(self) -> DataFrame:
        size = F.col("p_size").cast("bigint") * 20_000_000
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("id"),
            F.when(F.col("p_partkey") % 13 != 0, size).alias("size"),
        )

    def nodes(self) -> DataFrame:
        key = F.col("s_suppkey")
        unit = F.when(key % 2 == 0, " GB").otherwise(" GiB")
        return self.table("supplier").select(
            key.cast("string").alias("node_id"),
            F.concat(F.lit("node"), key, F.lit("@example.org")).alias("email"),
            F.concat((key % 9 + 1).cast("string"), unit).alias("limit"),
            F.lit(5_000_000_000).cast("bigint").alias("disk_total"),
            (key % 6 * 1_000_000_000).cast("bigint").alias("disk_free"),
            (key % 3 == 0).alias("initialised"),
        )

    def changes(self) -> DataFrame:
        kind = F.col("event_type")
        down = kind.isin("purchase", "error") | ((kind == "click") & (F.col("event_id") % 2 == 0))
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.col("user_id").cast("string").alias("id"),
            F.when(down, "remove").otherwise("add").alias("op"),
            F.concat_ws("-", "event_type", "event_id").alias("name"),
        )

    def snapshot(self) -> DataFrame:
        return self.table("documents").select(
            F.sha2("text", 256).alias("id"),
            F.concat(F.lit("doc-"), "doc_id").alias("name"),
            F.concat("source", F.lit(".ks")).alias("path"),
            F.col("doc_id").alias("line_no"),
        )

    def blocks(self) -> DataFrame:
        broken = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text"))
        return self.table("documents").select(
            F.concat(F.lit("doc-"), "doc_id").alias("cid"),
            F.col("text").alias("content"),
            F.sha2(broken, 256).alias("digest"),
            F.col("n_chars").alias("size"),
            "source",
            "lang",
        )

    def pins(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return (
            self.table("orders")
            .filter(status != "P")
            .select(
                F.col("o_orderkey").cast("string").alias("cid"),
                F.when(status == "F", "direct").otherwise("recursive").alias("pin_type"),
            )
        )

    def links(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(
                F.col("l_orderkey").cast("string").alias("parent"),
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("child"),
            )
            .distinct()
        )

    def on_two_nodes(self, blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("node_id", F.explode(F.array(F.lit("n0"), F.lit("n1"))))

    def node_pins(self) -> DataFrame:
        """Open orders are pinned on one node, finished ones on the other, all else on both."""
        status = F.col("o_orderstatus")
        where = F.when(status == "O", F.array(F.lit("n0"))).when(status == "F", F.array(F.lit("n1")))
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("cid"),
            F.when(status.isin("O", "F"), "recursive").otherwise("direct").alias("pin_type"),
            F.explode(where.otherwise(F.array(F.lit("n0"), F.lit("n1")))).alias("node_id"),
        )

    def part_links(self) -> DataFrame:
        id_ = F.col("p_partkey").cast("string")
        return self.table("part").select(id_.alias("parent"), F.concat(id_, F.lit("-0")).alias("child"))

    def _copy_of(self):
        return ((F.col("p_partkey") + 1) % self.table("supplier").select(F.count("*")).scalar()).cast("string")

    def copied_blocks(self) -> DataFrame:
        id_ = F.col("p_partkey").cast("string")
        nodes = F.array(self._node_of("p_partkey").cast("string"), self._copy_of())
        found = self.table("part").select(F.explode(nodes).alias("node_id"), id_.alias("id"))
        return found.select("node_id", F.explode(F.array("id", F.concat("id", F.lit("-0")))).alias("cid"))

    def copied_pins(self) -> DataFrame:
        """Of every third part the copy is pinned too."""
        third = self.table("part").filter(F.col("p_partkey") % 3 == 0)
        return third.select(self._copy_of().alias("node_id"), F.col("p_partkey").cast("string").alias("cid"))

    def tree_links(self) -> DataFrame:
        """A graph four levels deep: nation, customer, order, line."""
        customers = self.table("customer").select(
            F.concat(F.lit("n"), "c_nationkey").alias("parent"),
            F.concat(F.lit("c"), "c_custkey").alias("child"),
        )
        orders = self.table("orders").select(
            F.concat(F.lit("c"), "o_custkey").alias("parent"),
            F.col("o_orderkey").cast("string").alias("child"),
        )
        return customers.unionByName(orders).unionByName(self.links())

    def tree_pins(self) -> DataFrame:
        """Nations pinned in one of the two ways, and a third of the customers."""
        nations = self.table("nation").select(
            F.concat(F.lit("n"), "n_nationkey").alias("cid"),
            F.when(F.col("n_nationkey") % 3 == 0, "recursive").otherwise("direct").alias("pin_type"),
        )
        customers = (
            self.table("customer")
            .filter(F.col("c_custkey") % 3 == 0)
            .select(F.concat(F.lit("c"), "c_custkey").alias("cid"), F.lit("recursive").alias("pin_type"))
        )
        return nations.unionByName(customers)

    def shelf_links(self) -> DataFrame:
        """Each document under a root for its source and one for its language."""
        blocks = self.table("documents")
        child = F.concat(F.lit("doc-"), "doc_id").alias("child")
        by_source = blocks.select(F.concat(F.lit("src-"), "source").alias("parent"), child)
        by_lang = blocks.select(F.concat(F.lit("lang-"), "lang").alias("parent"), child)
        return by_source.unionByName(by_lang)

    def shelf_pins(self) -> DataFrame:
        """Every root is pinned; some sources and two languages with all below them."""
        roots = self.shelf_links().select(F.col("parent").alias("cid")).distinct()
        deep = F.col("cid").startswith("src-src1") | F.col("cid").isin("lang-fr", "lang-es")
        return roots.withColumn("pin_type", F.when(deep, "recursive").otherwise("direct"))

    def manifests(self) -> DataFrame:
        """A replication factor per manifest; the brand of a part names its manifest."""
        return (
            self.table("part")
            .select(F.col("p_brand").alias("manifest"))
            .distinct()
            .withColumn("threshold", (F.ascii(F.substring("manifest", -1, 1)) % 4 + 3).cast("int"))
        )

    def manifest_of(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("manifest")
        )
