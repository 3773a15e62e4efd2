"""Source relations derived from the star-schema and event sample tables.

Two worlds share one layout: ``EventsWorld`` is dense (30 days of 2024, every user active
almost daily), ``OrdersWorld`` is sparse (1995 to 2001, long gaps), which is what the
lifecycle and revenue reports need.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.numbers import MONEY

FORMER_SEGMENT = "MACHINERY"

# Declared, so that reading a table never starts with a job over file footers.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def money(column: str) -> Column:
    return F.col(column).cast(MONEY)


class World(dict):
    """Relations by name; each is built when first asked for."""

    run_date: date

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = getattr(self, name)()
        return self[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def home(self) -> DataFrame:
        """Customer with country code: one nation plays the home market."""
        nation = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        customer = self.table("customer").select(
            "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
        )
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
            F.col("c_custkey").alias("user_id"),
            F.when(F.col("c_nationkey") == 1, "TW").otherwise(F.col("n_name")).alias("country_code"),
            "n_name",
            "n_regionkey",
            "c_acctbal",
            "c_mktsegment",
        )

    def first_days(self) -> DataFrame:
        raise NotImplementedError

    def users_data(self) -> DataFrame:
        """Customers in credit have a user row; the rest are unknown to the user table."""
        first = self.first_days()
        return (
            self.home.where(F.col("c_acctbal") >= 0)
            .join(first, "user_id", "left")
            .select(
                F.col("user_id").alias("userid"),
                F.when(F.col("n_regionkey") == 1, "US").otherwise(F.col("n_name")).alias("country"),
                F.when(F.col("n_regionkey") == 0, "en")
                .when(F.col("n_regionkey") == 2, "es")
                .when(F.col("n_regionkey") == 3, "me")
                .when(F.col("n_regionkey") == 4, "de")
                .alias("locale"),
                F.col("first_dt").alias("datecreated"),
                F.when(F.col("c_mktsegment") == FORMER_SEGMENT, 1).otherwise(0).alias("terminated"),
            )
        )

    def store_product(self) -> DataFrame:
        """Parts by type; one type stays unnamed."""
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.nullif(F.col("p_type"), F.lit("STANDARD")).alias("name"),
        )

    def agent_guidelines(self) -> DataFrame:
        labels = self.table("labels").select("doc_id", "quality")
        lang = F.col("lang")
        return (
            self.table("documents")
            .join(labels, "doc_id", "left")
            .select(
                F.col("doc_id").alias("id"),
                F.when(lang == "en", "metric_logic")
                .when(lang == "de", "formatting")
                .when(lang == "es", "investigation")
                .otherwise("context")
                .alias("category"),
                F.col("text").alias("rule_text"),
                (F.col("quality") == 1).alias("is_active"),
                F.when(F.col("source") != "src0", F.col("source")).alias("source"),
            )
        )

    def agent_feedback(self) -> DataFrame:
        """User turns as reviewer feedback on the run their conversation stands for."""
        run, turn = F.col("conv_id"), F.col("turn")
        positive = turn % 4 == 0
        step = (run + turn) % 5
        state = (
            F.when(positive, "recorded")
            .when(step < 3, "incorporated")
            .when(step == 3, "rejected")
            .otherwise("pending")
        )
        return (
            self.table("conversations")
            .where(F.col("role") == "user")
            .select(
                (run * 100 + turn).alias("id"),
                run.alias("run_id"),
                "turn",
                F.when(~positive, F.col("text")).alias("raw_text"),
                F.when(positive, "positive").otherwise("correction").alias("feedback_type"),
                state.alias("state"),
                F.concat(F.lit("U"), (run % 7).cast("string")).alias("user_id"),
                F.concat(run.cast("string"), F.lit("."), turn.cast("string")).alias("message_ts"),
                F.when(state == "incorporated", run + turn).alias("derived_guideline_id"),
                F.date_add(F.lit(date(2024, 1, 1)), (run % 30).cast("int"))
                .cast("timestamp_ntz")
                .alias("created_at"),
            )
        )


class EventsWorld(World):
    run_date = date(2024, 1, 31)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "ts",
            F.to_date("ts").alias("dt"),
            "user_id",
            "event_type",
            money("value").alias("value"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    def of_type(self, *types: str) -> DataFrame:
        return self.events.where(F.col("event_type").isin(*types))

    def first_days(self) -> DataFrame:
        return self.events.groupBy("user_id").agg(F.min("dt").alias("first_dt"))

    def daily_user_activities(self) -> DataFrame:
        kind = F.col("event_type")

        def spent(name: str) -> Column:
            return F.sum(F.when(kind == name, F.col("value"))).cast(MONEY)

        def seen(name: str) -> Column:
            return F.count(F.when(kind == name, 1))

        daily = self.events.groupBy("user_id", "dt").agg(
            spent("purchase").alias("can"),
            spent("signup").alias("sub"),
            seen("click").alias("clicks"),
            seen("view").alias("views"),
        )
        return _activity(daily, self.first_days(), self.home)

    def dailyactives(self) -> DataFrame:
        kind, value = F.col("event_type"), F.col("value")
        return self.events.groupBy(F.col("dt").alias("day"), F.col("user_id").alias("userid")).agg(
            F.sum(F.when(kind == "click", value)).cast(MONEY).alias("bars_spent"),
            F.sum(F.when(kind == "purchase", value)).cast(MONEY).alias("revenue"),
        )

    def store_transaction(self) -> DataFrame:
        k = F.col("k")
        return self.of_type("purchase").select(
            F.col("ts").alias("datecreated"),
            F.col("user_id").alias("userid"),
            k.cast("bigint").alias("productid"),
            F.col("value").alias("amountdollars"),
            k.cast("bigint").alias("amountbars"),
            F.when(k % 3 == 0, "AUTHORIZED").when(k % 3 == 1, "COMPLETED").otherwise("DECLINED").alias("status"),
        )

    def crown_level_log(self) -> DataFrame:
        return self.of_type("error").select(
            F.col("ts").alias("datecreated"),
            F.col("user_id").alias("userid"),
            F.floor(F.col("k") / 7).cast("int").alias("crown_level"),
        )

    def can_purchase(self) -> DataFrame:
        return self.of_type("purchase").select(
            F.col("ts").alias("purchased_at"),
            "user_id",
            F.col("k").cast("bigint").alias("ch_id"),
            F.col("value").alias("usd_price"),
        )

    def streaming(self) -> DataFrame:
        return self.of_type("view", "click").select(
            F.col("ts").alias("start_time"),
            "user_id",
            (F.col("event_type") == "view").alias("is_video"),
            (F.col("value") * 60).cast(MONEY).alias("duration"),
        )

    def admob_revenue(self) -> DataFrame:
        return self.of_type("error").groupBy("dt").agg(
            F.sum("value").cast(MONEY).alias("gross_revenue")
        )


class OrdersWorld(World):
    run_date = date(1995, 6, 1)

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(
            "o_orderkey",
            "o_orderstatus",
            "o_orderpriority",
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("dt"),
            F.col("o_orderdate").alias("ts"),
            money("o_totalprice").alias("price"),
        )

    def first_days(self) -> DataFrame:
        return self.orders.groupBy("user_id").agg(F.min("dt").alias("first_dt"))

    def daily_user_activities(self) -> DataFrame:
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        daily = self.orders.groupBy("user_id", "dt").agg(
            F.sum(F.when(urgent, F.col("price"))).cast(MONEY).alias("can"),
            F.sum(F.when(~urgent, F.col("price"))).cast(MONEY).alias("sub"),
            F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("clicks"),
            F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("views"),
        )
        return _activity(daily, self.first_days(), self.home)

    def dailyactives(self) -> DataFrame:
        status, price = F.col("o_orderstatus"), F.col("price")
        return self.orders.groupBy(F.col("dt").alias("day"), F.col("user_id").alias("userid")).agg(
            F.sum(F.when(status == "F", price)).cast(MONEY).alias("bars_spent"),
            F.sum(F.when(status == "O", price)).cast(MONEY).alias("revenue"),
        )

    def store_transaction(self) -> DataFrame:
        status = F.col("o_orderstatus")
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_quantity", money("l_extendedprice").alias("dollars")
        )
        return self.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.col("ts").alias("datecreated"),
            F.col("user_id").alias("userid"),
            F.col("l_partkey").alias("productid"),
            F.col("dollars").alias("amountdollars"),
            F.col("l_quantity").cast("bigint").alias("amountbars"),
            F.when(status == "F", "COMPLETED").when(status == "O", "AUTHORIZED").otherwise("PENDING").alias("status"),
        )

    def crown_level_log(self) -> DataFrame:
        return self.orders.select(
            F.col("ts").alias("datecreated"),
            F.col("user_id").alias("userid"),
            (F.col("o_orderkey") % 15).cast("int").alias("crown_level"),
        )


def _activity(daily: DataFrame, first_days: DataFrame, home: DataFrame) -> DataFrame:
    """User-day activity with nullable purchase and interaction structs."""

    def present(cond: Column, name: str, value: str) -> Column:
        return F.when(cond, F.struct(F.col(value).alias(name)))

    return (
        daily.join(first_days, "user_id")
        .join(home.select("user_id", "country_code"), "user_id", "left")
        .select(
            "dt",
            "user_id",
            "country_code",
            F.datediff("dt", "first_dt").alias("day_index"),
            present(F.col("can").isNotNull(), "revenue", "can").alias("can_purchasing_dim"),
            present(F.col("sub").isNotNull(), "revenue", "sub").alias("sub_purchasing_dim"),
            present(F.col("clicks") > 0, "n", "clicks").alias("matching_dim"),
            present(F.col("views") > 0, "n", "views").alias("audience_dim"),
        )
    )
