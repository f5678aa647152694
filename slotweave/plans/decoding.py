"""Queries that decode bytes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.decode.builtin import PROGRAMS
from slotweave.decode.ir import Num, Struct
from slotweave.decode.program import Kind, Match, Program
from slotweave.functions.encoding import canonical_base64, le_bytes, sint, uint
from slotweave.plans.transactions import query
from slotweave.sinks.slots import confluent
from slotweave.sources import adapters


_le = le_bytes


@query("SELECT signature, outer_ix, 'TransferChecked' AS kind, amount, CAST(program AS BIGINT) AS decimals, 'parsed' AS outcome FROM ix WHERE NOT failed")
def token_transfer_decode(spark, sf_dir):
    """Token instructions written as bytes and decoded again by the program's own dispatch, compiled to Columns."""
    i = adapters.instructions(spark, sf_dir).where("not failed")
    data = F.concat(F.lit(b"\x0c"), _le(F.col("amount"), 8), _le(F.col("program"), 1))
    keys = F.array(*[F.unhex(F.sha2(F.concat(F.lit(x), F.col(c).cast("string")).cast("binary"), 256)) for x, c in (("p", "part"), ("s", "supplier"), ("p", "part"), ("c", "fee_payer"))])
    token, d = PROGRAMS["token"], i.select("signature", F.col("outer").alias("outer_ix"), data.alias("data"), keys.alias("keys"))
    kind = token.instruction_choice(F.col("data"), F.size("keys"))["kind"]
    d = d.select("signature", "outer_ix", kind.alias("kind"), token.instruction_fields("TransferChecked", F.col("data"), F.col("keys")).alias("v"))
    outcome = F.when(F.col("v").isNotNull(), "parsed").otherwise("error")
    return d.select("signature", "outer_ix", "kind", F.col("v.args.amount").cast("bigint").alias("amount"), F.col("v.args.decimals").cast("bigint").alias("decimals"), outcome.alias("outcome"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'error' WHEN event_id % 3 = 1 THEN 'parsed' ELSE 'error' END AS outcome, CASE WHEN event_id % 3 = 1 THEN 'Burn' WHEN event_id % 3 = 2 THEN 'Transfer' END AS kind FROM events")
def decode_errors(spark, sf_dir):
    """Unknown tags and cut data are outcomes, never failures."""
    e = adapters.table(spark, sf_dir, "events")
    case = F.col("event_id") % 3
    data = F.when(case == 0, F.lit(b"\x63")).when(case == 1, F.concat(F.lit(b"\x08"), _le(F.col("event_id"), 8))).otherwise(F.lit(b"\x03\x01"))
    o = PROGRAMS["token"].instruction_outcome(data, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return e.select("event_id", o.alias("o")).select("event_id", "o.outcome", "o.kind")


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS u32, CAST(o_orderkey * 4294967296 AS VARCHAR) AS u64, -(o_custkey + 1) AS i64 FROM orders")
def integer_readers(spark, sf_dir):
    """Integers from bytes, JVM-side: unsigned 64-bit values are decimals."""
    o = adapters.table(spark, sf_dir, "orders")
    # two's complement of -(n + 1) has all bits of n flipped
    data = F.concat(_le(F.col("o_custkey"), 4), F.lit(bytes(4)), _le(F.col("o_orderkey"), 4), _le(F.bitwise_not(F.col("o_custkey")), 8))
    o = o.select("o_orderkey", data.alias("data"))
    return o.select("o_orderkey", uint("data", 0, 4).alias("u32"), uint("data", 4, 8).cast("string").alias("u64"), sint("data", 12, 8).alias("i64"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(octet_length(encode(coalesce(text, ''))) AS INTEGER) END AS n FROM documents")
def canonical_base64_check(spark, sf_dir):
    """Decoded only if the text is the canonical encoding: odd rows have a stray blank."""
    d = adapters.table(spark, sf_dir, "documents")
    coded = F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    coded = F.when(F.col("doc_id") % 2 == 0, coded).otherwise(F.concat(coded, F.lit(" ")))
    return d.select("doc_id", F.octet_length(canonical_base64(coded)).alias("n"))


SHOP = Program("shop", "Shop", events=(Kind("sold", Struct((("user", Num("u64")), ("hour", Num("u32")))), (Match(0, b"\x07"),), skip=1),))


@query("SELECT event_id, 1 + CAST(event_id % 2 = 0 AS INTEGER) AS n, user_id AS first_user FROM events WHERE event_type = 'purchase'")
def event_extraction(spark, sf_dir):
    """Events of log lines and of wrapped calls, merged one to one: both ways report each, even rows' logs one more."""
    e = adapters.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    data = lambda n: F.concat(F.lit(b"\x07"), _le(F.col("user_id") + n, 8), F.lit(bytes(4)))
    line = lambda n: F.concat(F.lit("Program data: "), F.base64(data(n)))
    foreign = F.array(F.lit("Program Other invoke [2]"), line(5), F.lit("Program Other success"))
    own = F.when(F.col("event_id") % 2 == 0, F.array(line(0), line(1))).otherwise(F.array(line(0)))
    lines = F.concat(F.array(F.lit("Program Shop invoke [1]")), own, foreign, F.array(F.lit("Program data: !!"), F.lit("Program Shop success"), line(9)))
    found = SHOP.events_column(lines, F.array(F.concat(F.lit(SHOP.envelope[0]), data(0))))
    e = e.select("event_id", found.alias("f"))
    return e.select("event_id", F.size("f").alias("n"), F.get_json_object(F.col("f")[0]["payload"], "$.user").cast("bigint").alias("first_user"))


@query("SELECT event_id, '000000002A00' || hex(encode(event_type)) AS wire FROM events")
def registry_wire_format(spark, sf_dir):
    """Payloads behind the schema registry's header."""
    e = adapters.table(spark, sf_dir, "events")
    return e.select("event_id", F.hex(confluent(F.encode("event_type", "UTF-8"), 42)).alias("wire"))
