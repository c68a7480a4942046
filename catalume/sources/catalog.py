"""The catalog's tables, bound to a data directory.

The star-schema tables are read as a catalog: customers are packages, orders their resources, nations the
organizations, regions the groups, part brands the tags, events the processing jobs. Every view is a
DataFrame that is only planned when it is used, so a query scans the columns that it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Catalog:
    """Views over the Parquet tables of one directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def organization(self) -> DataFrame:
        state = F.when(F.col("n_nationkey") == 24, "deleted").otherwise("active")
        return self.raw("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lower("n_name").alias("name"), F.col("n_name").alias("title"), state.alias("state"))

    @cached_property
    def grp(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").cast("string").alias("id"), F.lower("r_name").alias("name"), F.col("r_name").alias("title"), F.lit("active").alias("state"))

    @cached_property
    def package_core(self) -> DataFrame:
        """Packages without their dates and notes: one scan."""
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.cast("string").alias("id"),
            F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")).alias("name"),
            F.concat_ws(" ", "c_mktsegment", "c_name").alias("title"),
            F.col("c_mktsegment").alias("license_id"),
            F.col("c_nationkey").cast("string").alias("owner_org"),
            (F.col("c_acctbal") < 0).alias("private"),
            (key % 7).cast("string").alias("creator_user_id"),
            F.when(key % 50 == 0, "deleted").otherwise("active").alias("state"),
        )

    @cached_property
    def package(self) -> DataFrame:
        dates = self.raw("orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("updated"))
        return self.package_core.join(dates, "id", "left")

    @cached_property
    def note(self) -> DataFrame:
        """(at, notes): the texts that packages have as notes, each once."""
        return self.raw("documents").select(F.col("doc_id").alias("at"), F.col("text").alias("notes"))

    def with_note_key(self, packages: DataFrame) -> DataFrame:
        """Packages with the key of their notes (``at``)."""
        return packages.withColumn("at", F.col("id").cast("long") % self.raw("documents").count())

    @cached_property
    def package_notes(self) -> DataFrame:
        """Packages with their notes. Many share a text: what is told of notes alone is told of ``note`` and joined by its key."""
        return self.with_note_key(self.package).join(self.note, "at", "left").drop("at")

    @cached_property
    def resource(self) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        fmt = F.when(first == "1", "csv").when(first == "2", "CSV").when(first == "3", "json").when(first == "4", "")
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("o_custkey").cast("string").alias("package_id"),
            F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"),
            F.col("o_orderpriority").alias("description"),
            fmt.alias("format"),
            F.when(status == "P", "deleted").otherwise("active").alias("state"),
            F.floor("o_totalprice").cast("long").alias("size"),
            F.col("o_orderdate").alias("updated"),
            F.when(status == "F", "ok").when(status == "O", "error").alias("health_status"),
            F.when(status != "P", F.col("o_orderdate")).alias("health_checked_at"),
        )

    @cached_property
    def resource_positions(self) -> DataFrame:
        along = Window.partitionBy("package_id").orderBy("updated", F.col("id").cast("long"))
        return self.resource.withColumn("position", F.row_number().over(along) - 1)

    @cached_property
    def tag(self) -> DataFrame:
        """(tag), distinct; some have no package."""
        own, spare = self.raw("part").select(F.col("p_brand").alias("tag")), self.raw("region").select(F.concat(F.lit("Brand#1-"), F.lower("r_name")).alias("tag"))
        return own.unionByName(spare).distinct()

    @cached_property
    def package_tag(self) -> DataFrame:
        """(package_id, tag), distinct."""
        items, parts = self.raw("lineitem").select("l_orderkey", "l_partkey"), self.raw("part").select("p_partkey", "p_brand")
        owners = self.raw("orders").select("o_orderkey", "o_custkey")
        linked = items.join(parts, items.l_partkey == parts.p_partkey).join(owners, items.l_orderkey == owners.o_orderkey)
        return linked.select(F.col("o_custkey").cast("string").alias("package_id"), F.col("p_brand").alias("tag")).distinct()

    @cached_property
    def package_group(self) -> DataFrame:
        """(package_id, group_id), distinct."""
        items, suppliers = self.raw("lineitem").select("l_orderkey", "l_suppkey"), self.raw("supplier").select("s_suppkey", "s_nationkey")
        nations, owners = self.raw("nation").select("n_nationkey", "n_regionkey"), self.raw("orders").select("o_orderkey", "o_custkey")
        linked = items.join(suppliers, items.l_suppkey == suppliers.s_suppkey).join(nations, suppliers.s_nationkey == nations.n_nationkey).join(owners, items.l_orderkey == owners.o_orderkey)
        return linked.select(F.col("o_custkey").cast("string").alias("package_id"), F.col("n_regionkey").cast("string").alias("group_id")).distinct()

    @cached_property
    def membership(self) -> DataFrame:
        role = F.max(F.col("s_suppkey") % 3)
        grouped = self.raw("supplier").groupBy((F.col("s_suppkey") % 7).cast("string").alias("user_id"), F.col("s_nationkey").cast("string").alias("organization_id")).agg(role.alias("r"))
        return grouped.select("user_id", "organization_id", F.when(F.col("r") == 0, "member").when(F.col("r") == 1, "editor").otherwise("admin").alias("role"))

    @cached_property
    def user(self) -> DataFrame:
        key = F.col("id").cast("int")
        users = self.raw("supplier").select((F.col("s_suppkey") % 7).cast("string").alias("id")).distinct()
        return users.select(
            "id",
            F.concat(F.lit("user-"), "id").alias("name"),
            F.concat(F.lit("user-"), F.col("id"), F.lit("@example.org")).alias("email"),
            F.when(key == 0, "sysadmin").otherwise("user").alias("role"),
            F.when(key == 6, "deleted").otherwise("active").alias("state"),
        )

    @cached_property
    def pipeline(self) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind == "click", "queued").when(kind == "view", "processing").when(kind == "signup", "pending").when(kind == "purchase", "complete").otherwise("error")
        return self.raw("events").select(
            F.col("event_id").cast("string").alias("resource_id"),
            status.alias("status"),
            F.col("ts").alias("updated"),
            F.col("props").alias("metadata"),
            F.when(kind == "error", F.concat(F.lit("failed at "), F.col("value").cast("string"))).alias("error"),
        )

    @cached_property
    def step(self) -> DataFrame:
        """Steps of the jobs: one to three a job, the later ones begun earlier."""
        n = F.col("event_id") % 3
        steps = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.struct(i.alias("i"), F.element_at(F.array(F.lit("fetch"), F.lit("extract"), F.lit("index")), i + 1).alias("name")))
        exploded = self.raw("events").select(F.col("event_id").cast("string").alias("resource_id"), "ts", F.col("event_type"), F.explode(steps).alias("s"))
        begun = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), 10 - F.col("s.i"))
        return exploded.select("resource_id", F.col("s.name").alias("step_name"), F.when(F.col("event_type") == "error", "error").otherwise("complete").alias("status"), F.lit(None).cast("string").alias("error"), begun.alias("started_at"), begun.alias("completed_at"))

    @cached_property
    def content_lines(self) -> DataFrame:
        """The documents as content of other packages, a chunk a line."""
        owner = (F.col("doc_id") * 7 % 150 + 1).cast("string")
        lines = self.raw("documents").select(F.col("doc_id").cast("string").alias("resource_id"), owner.alias("package_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "extracted_text"))
        return lines.withColumn("content_type", F.lit("text")).withColumn("chunk_size", F.octet_length("extracted_text"))

    @cached_property
    def content(self) -> DataFrame:
        """One chunk a document."""
        return self.raw("documents").select(
            F.col("doc_id").cast("string").alias("resource_id"),
            F.col("source").alias("package_id"),
            F.col("text").alias("extracted_text"),
            F.lit("text").alias("content_type"),
            F.lit(0).alias("chunk_index"),
            F.octet_length("text").alias("chunk_size"),
        )
