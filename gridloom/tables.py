"""Typed access to the source tables and the panel views built from them.

``Tables`` gives the raw tables (column-pruned by Catalyst) and the derived views every
operator family is exercised on.  Each view has a SQL twin in ``gridloom.sqltext``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.functions.num import cents
from gridloom.operators.joins import enrich
from gridloom.operators.windows import cross_deviation
from gridloom.session import materialise

NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

MIN_CROSS = 10  # entities needed on a date before a cross-section statistic means anything


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        raise AttributeError(name)

    # ---------------------------------------------------------------- price panel
    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with the supplier's nation; the dimension is broadcast only when small."""
        li = self.lineitem.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag",
            F.to_date("l_shipdate").alias("date"),
            cents("l_extendedprice").alias("cents"),
            F.round("l_quantity").cast("long").alias("qty"),
        )
        sup = self.supplier.select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("entity"))
        return enrich(li, sup, ["l_suppkey"], "inner", spread="l_orderkey")

    def _panel(self, date) -> DataFrame:
        return (
            self.lines.groupBy("entity", date.alias("date"))
            .agg(F.sum("cents").alias("c"), F.sum("qty").alias("q"), F.count("*").alias("n"))
            .select(
                "entity", "date",
                (F.col("c").cast("double") / 100.0 / F.col("q").cast("double")).alias("price"),
                F.col("q").cast("double").alias("volume"), "n")
        )

    @cached_property
    def panel(self) -> DataFrame:
        """(entity, date): volume-weighted price, volume and number of trades."""
        return self._panel(F.col("date"))

    @cached_property
    def panel_m(self) -> DataFrame:
        return self._panel(F.to_date(F.date_trunc("month", "date")))

    @staticmethod
    def _returns(p: DataFrame) -> DataFrame:
        w = Window.partitionBy("entity").orderBy("date")
        lp = F.log("price")
        gap = F.datediff("date", F.lag("date").over(w)).cast("long")
        rr = lp - F.lag(lp).over(w)
        return (
            p.withColumn("logp", lp).withColumn("gap", gap).withColumn("ret_row", rr)
            .withColumn("ret", F.when(F.col("gap") == 1, F.col("ret_row")))
        )

    @staticmethod
    def _dev(p: DataFrame, min_cross: int) -> DataFrame:
        # entity-day rows, written once: the cross-section and its mean read them, the raw lines are read once
        return cross_deviation(materialise(p, "panel"), "logp", "dev", min_cross)

    @cached_property
    def pr(self) -> DataFrame:
        """Panel with log price, row return and the return that skips calendar gaps."""
        return self._returns(self.panel)

    @cached_property
    def dev(self) -> DataFrame:
        return self._dev(self.pr, MIN_CROSS)

    @cached_property
    def prm(self) -> DataFrame:
        """Monthly panel; ``ret`` is the return from the row before."""
        return self._returns(self.panel_m).withColumn("ret", F.col("ret_row"))

    @cached_property
    def devm(self) -> DataFrame:
        return self._dev(self.prm, 5)

    # ---------------------------------------------------------------- sides of a price
    @cached_property
    def sides(self) -> DataFrame:
        """Per (entity, date): average price and quantity of the A, N and R lines."""

        def one(flag, what):
            return F.sum(F.when(F.col("l_returnflag") == flag, F.col(what)))

        g = self.lines.groupBy("entity", "date").agg(
            *[one(f, w).alias(f"{f.lower()}_{w}") for f in "ANR" for w in ("cents", "qty")])
        out = ["entity", "date"]
        for f, name in (("a", "sell"), ("n", "buy"), ("r", "book")):
            out.append((F.col(f"{f}_cents").cast("double") / 100.0
                        / F.col(f"{f}_qty").cast("double")).alias(f"{name}_price"))
            out.append(F.coalesce(F.col(f"{f}_qty"), F.lit(0)).cast("double").alias(f"{name}_qty"))
        return g.select(*out)

    @cached_property
    def fundamentals(self) -> DataFrame:
        """(entity, date): price, quantities by side, number of lines and suppliers, concentration over suppliers."""
        by = self.lines.groupBy("entity", "date", "l_suppkey").agg(
            F.sum("cents").alias("c"), F.sum("qty").alias("q"), F.count("*").alias("n"),
            *[F.sum(F.when(F.col("l_returnflag") == f, F.col("qty"))).alias(f"q_{f}") for f in "ANR"])
        g = by.groupBy("entity", "date").agg(
            F.sum("c").alias("c"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.count("*").alias("suppliers"), F.max("q").alias("top"),
            F.sum(F.col("q") * F.col("q")).alias("qq"), *[F.sum(f"q_{f}").alias(f"q_{f}") for f in "ANR"])
        c = lambda x: F.col(x).cast("double")
        return g.select(
            "entity", "date", (c("c") / 100.0 / c("q")).alias("price"), c("q").alias("volume"), (c("c") / 100.0).alias("value"), c("n").alias("n"),
            c("suppliers").alias("suppliers"), (c("qq") / (c("q") * c("q"))).alias("supplier_hhi"), (c("top") / c("q")).alias("top_share"),
            c("q_A").alias("sell_qty"), c("q_N").alias("buy_qty"), F.coalesce(c("q_R"), F.lit(0.0)).alias("returned"))

    # ---------------------------------------------------------------- dimensions
    @cached_property
    def dim(self) -> DataFrame:
        """One row per entity: name, region, customers, mean balance and fixed attributes."""
        c = self.customer.groupBy(F.col("c_nationkey").alias("entity")).agg(
            F.count("*").alias("population"),
            F.sum(cents("c_acctbal")).alias("bal"),
            F.sum(F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)).alias("premium"))
        k = F.col("n_nationkey")
        n = self.nation.join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey"), "left"
        ).select(
            k.alias("entity"), F.col("n_name").alias("name"), F.col("r_name").alias("region"),
            F.when(k % 3 == 0, "optional").otherwise("open").alias("kind"),
            F.when(k % 2 == 0, "green").otherwise("yellow").alias("tier"),
            F.date_add(F.lit("1994-06-01").cast("date"), (k * 13).cast("int")).alias("created"))
        return n.join(c, "entity", "left").select(
            "entity", "name", "region", "kind", "tier", "created",
            F.coalesce("population", F.lit(0)).alias("population"),
            (F.col("bal").cast("double") / 100.0 / F.col("population")).alias("mean_balance"),
            (F.col("premium").cast("double") / F.col("population")).alias("premium_share"))

    @cached_property
    def calendar(self) -> DataFrame:
        """One row per order date with event flags."""
        return (
            self.orders.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.count("*").alias("n_orders"),
                 F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("n_urgent"))
            .select(
                "date", "n_orders", "n_urgent",
                (F.col("date") == F.last_day("date")).cast("int").alias("ev_month_end"),
                (F.col("n_urgent") * 2 >= F.col("n_orders")).cast("int").alias("ev_urgent"))
        )

    # ---------------------------------------------------------------- order book
    @cached_property
    def book(self) -> DataFrame:
        """Resting offers: entity, side, name, amount, price, time."""
        q = self.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.sum(F.round("l_quantity").cast("long")).alias("amount"))
        o = (
            self.orders.where(F.col("o_orderstatus").isin("F", "O"))
            .select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("cents"),
                    F.to_date("o_orderdate").alias("time"))
            .join(q, "o_orderkey")
        )
        c = self.customer.select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"),
            F.col("c_mktsegment").alias("name"))
        return enrich(o, c, ["o_custkey"], "inner", spread="o_orderkey").select(
            F.col("o_orderkey").alias("offer_id"), "entity",
            F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"),
            "name", "amount",
            (F.col("cents").cast("double") / 100.0 / F.col("amount").cast("double")).alias("price"),
            (F.col("cents").cast("double") / 100.0).alias("value"), "time")

    # ---------------------------------------------------------------- event counts
    @cached_property
    def counts(self) -> DataFrame:
        """(entity, date, category) event counts."""
        return self.events.groupBy(
            F.col("user_id").alias("entity"), F.to_date("ts").alias("date"),
            F.col("event_type").alias("category"),
        ).agg(F.count("*").alias("n"), F.sum(cents("value")).alias("value_cents"))

    @cached_property
    def hourly(self) -> DataFrame:
        """(category, hour start): mean value and count."""
        return self.events.groupBy(
            F.col("event_type").alias("category"),
            F.date_trunc("hour", F.col("ts")).alias("hour_ts"),
        ).agg(F.count("*").alias("n"), F.sum(cents("value")).alias("c")).select(
            "category", "hour_ts", "n",
            (F.col("c").cast("double") / 100.0 / F.col("n")).alias("value"))
