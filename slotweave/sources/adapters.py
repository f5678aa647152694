"""The test tables, viewed as update streams.

| update | table | mapping |
|---|---|---|
| transaction | orders | slot: days since 1995-01-01; index: by key within the slot; failed: status F |
| instruction | lineitem | program: supplier modulo 4; outer index: position within the order |
| block | orders' days | parent: the day before it that has orders |
| account write | customer | key, owner: nation, lamports: balance in cents |
| slot events | events | slot: hour since 2024-01-01; kind: event type |

Slots and counts fit in a BIGINT here, so the views use that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.operators.ordered import with_previous

EPOCH = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_of(day) -> F.Column:
    return F.datediff(day, F.lit(EPOCH)).cast("bigint")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, tx_index, signature, fee_payer, failed, lamports, account_keys of every order."""
    o = table(spark, sf_dir, "orders").select(
        slot_of(F.col("o_orderdate")).alias("slot"),
        F.col("o_orderkey").alias("signature"),
        F.col("o_custkey").alias("fee_payer"),
        (F.col("o_orderstatus") == "F").alias("failed"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("lamports"),
    )
    return o.withColumn("tx_index", (F.row_number().over(Window.partitionBy("slot").orderBy("signature")) - 1).cast("bigint"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without tx_index: no window where nobody reads it."""
    return transactions(spark, sf_dir).drop("tx_index")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order: signature, program, part, supplier, quantity in hundredths, order of calls."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("signature"),
        (F.col("l_suppkey") % 4).alias("program"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        "l_linenumber",
        F.round(F.col("l_quantity") * 100).cast("bigint").alias("amount"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
        "l_shipdate",
    )


#: (l_orderkey, l_linenumber) is not unique, so the order of calls needs more.
CALL_ORDER = ("l_linenumber", "part", "supplier", "l_shipdate", "price", "amount")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their transaction's slot, failed and fee_payer, and ``outer``: the call's index."""
    i = lines(spark, sf_dir)
    call = Window.partitionBy("signature").orderBy(*CALL_ORDER)
    i = i.withColumn("outer", (F.row_number().over(call) - 1).cast("bigint"))
    return i.join(headers(spark, sf_dir).select("signature", "slot", "failed", "fee_payer"), "signature")


def with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with ``account_keys``: payer, parts (p), suppliers (s), as texts."""
    keys = lines(spark, sf_dir).select("signature", F.explode(F.array(F.concat(F.lit("p"), "part"), F.concat(F.lit("s"), "supplier"))).alias("k"))
    keys = keys.groupBy("signature").agg(F.sort_array(F.collect_set("k")).alias("keys"))
    t = headers(spark, sf_dir).join(keys, "signature", "left")
    payer = F.array(F.concat(F.lit("c"), "fee_payer"))
    return t.withColumn("account_keys", F.concat(payer, F.coalesce("keys", F.array().cast("array<string>")))).drop("keys")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signature, calls: an order's lines in the order of calls, as structs (part, supplier, program, amount)."""
    order = F.struct("l_linenumber", "part", "supplier", "l_shipdate", "price", "amount", "program")
    i = lines(spark, sf_dir).groupBy("signature").agg(F.sort_array(F.collect_list(order)).alias("c"))
    return i.select("signature", F.transform("c", lambda x: F.struct(x["part"].alias("part"), x["supplier"].alias("supplier"), x["program"].alias("program"), x["amount"].alias("amount"))).alias("calls"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as a source delivers them: three lists of keys and calls by index into them.

    Every third line of an order is an outer call; the two behind it are its inner ones, the
    second below the first (orders with an even key don't know the heights). Orders whose
    key ends in 07 have no message, in 08 an inner call of no outer one, in 09 an account
    that isn't listed.
    """
    t = headers(spark, sf_dir).join(calls(spark, sf_dir), "signature")
    n, last = F.size("calls"), F.col("signature") % 100
    key = lambda letter, c: F.encode(F.concat(F.lit(letter), c.cast("string")), "UTF-8")

    def call(x, k, height=None):
        first = F.when(last == 9, 999).otherwise(0) if height is None else F.lit(0)
        out = [(2 * n + 1 + x["program"]).cast("int").alias("program_id_index"), F.array(first, k + 1, n + 1 + k).alias("accounts"), F.encode(x["amount"].cast("string"), "UTF-8").alias("data")]
        return F.struct(*out, *([height.cast("int").alias("stack_height")] if height is not None else []))

    height = lambda h: F.when(F.col("signature") % 2 == 1, F.lit(h))
    outer = F.transform(F.sequence(F.lit(0), ((n - 1) / 3).cast("int")), lambda o: call(F.get("calls", o * 3), o * 3))
    below = lambda o: F.filter(F.array(*[F.when(o * 3 + h - 1 < n, call(F.get("calls", o * 3 + h - 1), o * 3 + h - 1, height(h))) for h in (2, 3)]), lambda x: x.isNotNull())
    inner = F.transform(F.sequence(F.lit(0), ((n - 1) / 3).cast("int")), lambda o: F.struct(F.when(last == 8, 99).otherwise(o).alias("index"), below(o).alias("instructions")))
    return t.select(
        "slot", "signature", "failed",
        F.concat(F.array(key("c", F.col("fee_payer"))), F.transform("calls", lambda x: key("p", x["part"]))).alias("static_keys"),
        F.transform("calls", lambda x: key("s", x["supplier"])).alias("loaded_writable"),
        F.array(*[F.lit(f"g{i}".encode()) for i in range(4)]).alias("loaded_readonly"),
        F.when(last != 7, outer).alias("instructions"),
        inner.alias("inner_instructions"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pubkey"),
        F.col("c_nationkey").cast("bigint").alias("owner"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("lamports"),
        F.encode("c_name", "UTF-8").alias("data"),
        (F.col("c_custkey") % 100).alias("slot"),
        F.col("c_custkey").alias("write_version"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("txn_signature"),
    )


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bank per day with orders: slot, parent, expected, parsed, confirmed, discarded (reason or null)."""
    per = headers(spark, sf_dir).groupBy("slot").agg(
        F.count(F.lit(1)).alias("expected"),
        # a tenth of the slots from 2000 on miss a transaction, one in 50 is not confirmed
        (F.count(F.lit(1)) - F.max(F.when((F.col("slot") > 1500) & (F.col("slot") % 10 == 7), 1).otherwise(0))).alias("parsed"),
    )
    per = with_previous(per, "slot", name="parent").withColumn("parent", F.coalesce("parent", F.col("slot") - 1))
    why = F.when(F.col("slot") % 23 == 5, "Forked").when(F.col("slot") % 31 == 11, "Dead").when(F.col("slot") % 37 == 3, "Incomplete")
    return per.select("slot", "parent", "expected", "parsed", (F.col("slot") % 50 != 49).alias("confirmed"), why.alias("discarded"))


def slot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot (hour), event_id (ingest order), user_id, kind, value in hundredths."""
    return table(spark, sf_dir, "events").select(
        F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600).cast("bigint").alias("slot"),
        "event_id",
        "user_id",
        F.col("event_type").alias("kind"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        "props",
    )
