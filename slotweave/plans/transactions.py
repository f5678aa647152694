"""Queries over transactions, instructions and accounts, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotweave.functions.encoding import discriminator_col
from slotweave.operators import dispatch, flatten, slots
from slotweave.operators.ordered import last_wins
from slotweave.operators.prefilter import DataSize, DataSlice, Filters, Lamports, Memcmp, Prefilter, TransactionPart
from slotweave.sources import adapters, replay
from slotweave.storage import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = WITH + sql if not sql.lstrip().startswith("WITH") else sql
        return f

    return add


#: The adapters' views in SQL.
WITH = """
WITH tx AS (
  SELECT datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS slot, o_orderkey AS signature, o_custkey AS fee_payer,
         o_orderstatus = 'F' AS failed, CAST(round(o_totalprice * 100) AS BIGINT) AS lamports
  FROM orders),
ln AS (
  SELECT l_orderkey AS signature, l_suppkey % 4 AS program, l_partkey AS part, l_suppkey AS supplier, l_linenumber,
         CAST(round(l_quantity * 100) AS BIGINT) AS amount, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate
  FROM lineitem),
ix AS (
  SELECT ln.*, row_number() OVER (PARTITION BY ln.signature ORDER BY l_linenumber, part, supplier, l_shipdate, price, amount) - 1 AS outer_ix,
         tx.slot, tx.failed, tx.fee_payer
  FROM ln JOIN tx ON ln.signature = tx.signature),
ks AS (SELECT signature, list_distinct(flatten(list(['p' || part, 's' || supplier]))) AS keys FROM ln GROUP BY signature),
tk AS (SELECT tx.*, list_concat(['c' || fee_payer], coalesce(ks.keys, [])) AS account_keys FROM tx LEFT JOIN ks ON tx.signature = ks.signature)
"""


# --- 2.8 commits --------------------------------------------------------------------------------


@query("""
SELECT tx.slot, count(DISTINCT tx.signature) AS transaction_count,
       count(DISTINCT CASE WHEN tx.failed THEN tx.signature END) AS status_failed,
       count(DISTINCT CASE WHEN NOT tx.failed THEN tx.signature END) AS status_succeeded,
       count(CASE WHEN NOT tx.failed AND ln.program IN (0, 1) THEN 1 END) AS decoded,
       count(CASE WHEN NOT tx.failed AND ln.program = 2 THEN 1 END) AS filtered,
       count(CASE WHEN NOT tx.failed AND ln.program = 3 THEN 1 END) AS fallback,
       CAST(sum(CASE WHEN NOT tx.failed AND ln.program IN (0, 1) THEN ln.amount ELSE 0 END) AS BIGINT) AS amount
FROM tx LEFT JOIN ln ON tx.signature = ln.signature GROUP BY tx.slot
""")
def slot_commit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-slot commit counters: failed transactions count but give no instructions.

    Transactions and instructions are counted apart and meet per slot, so no transaction is
    counted once per instruction.
    """
    tx = adapters.headers(spark, sf_dir).select("slot", "signature", "failed")
    ln = adapters.lines(spark, sf_dir).join(tx, "signature")
    p = F.col("program")
    ln = ln.select("slot", "failed", "amount", F.when(p < 2, "parsed").when(p == 2, "filtered").otherwise("error").alias("outcome"), (p == 3).alias("fallback"))
    amount = F.coalesce(F.sum(F.when(~F.col("failed") & (F.col("outcome") == "parsed"), F.col("amount"))), F.lit(0))
    parsed = slots.commits(ln, failed="failed", amount=amount).drop("errors")
    per = tx.groupBy("slot").agg(F.count(F.lit(1)).alias("transaction_count"), F.count_if("failed").alias("status_failed"), F.count_if(~F.col("failed")).alias("status_succeeded"))
    return per.join(parsed, "slot", "left").fillna(0, ["decoded", "filtered", "fallback", "amount"])


@query("""
SELECT c_custkey % 100 AS slot, count(CASE WHEN c_nationkey < 20 THEN 1 END) AS decoded_count,
       count(CASE WHEN c_nationkey >= 20 THEN 1 END) AS fallback_count, count(*) AS processed_count,
       max(c_custkey) AS last_write_version
FROM customer GROUP BY 1
""")
def account_commit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("owner") < 20
    a = adapters.accounts(spark, sf_dir).select("slot", "write_version", F.when(known, "parsed").otherwise("error").alias("outcome"), (~known).alias("fallback"))
    c = slots.commits(a, processed_count=F.count(F.lit(1)), last_write_version=F.max("write_version"))
    return c.select("slot", F.col("decoded").alias("decoded_count"), F.col("fallback").alias("fallback_count"), "processed_count", "last_write_version")


# --- 2.3 prefilters ------------------------------------------------------------------------------


def _received(spark: SparkSession, sf_dir: str, part: TransactionPart) -> DataFrame:
    return adapters.with_keys(spark, sf_dir).where(part.column()).select("slot", "signature", F.size("account_keys").alias("n_keys"))


_SELECT = "SELECT slot, signature, CAST(len(account_keys) AS INTEGER) AS n_keys FROM tk WHERE "
SOME = frozenset(f"s{i}" for i in (1, 5, 7))


@query(_SELECT + "list_has_any(account_keys, ['s1', 's5', 's7'])")
def prefilter_include(spark, sf_dir):
    return _received(spark, sf_dir, TransactionPart(include=SOME, failed=None))


@query(_SELECT + "list_has_all(account_keys, ['s1', 's5'])")
def prefilter_required(spark, sf_dir):
    return _received(spark, sf_dir, TransactionPart(required=frozenset({"s1", "s5"}), failed=None))


@query(_SELECT + "NOT list_has_any(account_keys, ['s1', 's5', 's7'])")
def prefilter_exclude(spark, sf_dir):
    return _received(spark, sf_dir, TransactionPart(exclude=SOME, failed=None))


@query(_SELECT + "list_has_any(account_keys, ['s1', 's5', 's7']) AND list_has_all(account_keys, ['s2']) AND NOT list_has_any(account_keys, ['s3', 'c7']) AND NOT failed")
def prefilter_combined(spark, sf_dir):
    return _received(spark, sf_dir, TransactionPart(include=SOME, required=frozenset({"s2"}), exclude=frozenset({"s3", "c7"})))


@query("SELECT slot, signature FROM tx WHERE NOT failed")
def prefilter_failed_default(spark, sf_dir):
    return adapters.headers(spark, sf_dir).where(TransactionPart().column()).select("slot", "signature")


@query(_SELECT + "list_has_any(account_keys, ['s1', 's2', 's3']) AND NOT list_has_any(account_keys, ['p10'])")
def prefilter_merge_union(spark, sf_dir):
    """Include unites, exclude intersects, differing failure choices widen to any."""
    a = TransactionPart(include=frozenset({"s1", "s2"}), exclude=frozenset({"p10", "p11"}), failed=False)
    b = TransactionPart(include=frozenset({"s3"}), exclude=frozenset({"p10", "p12"}), failed=True)
    return _received(spark, sf_dir, a.merge(b))


@query("SELECT slot, signature FROM tx WHERE signature = 7")
def prefilter_signature(spark, sf_dir):
    return adapters.headers(spark, sf_dir).where(TransactionPart(signature=7, failed=None).column()).select("slot", "signature")


@query("""
, b AS (SELECT signature, 'c' || (supplier * 3) AS owner, min(amount) AS pre, max(amount) AS post FROM ln GROUP BY 1, 2),
o AS (SELECT signature, list(owner) AS owners, list(owner) FILTER (pre <> post) AS changed FROM b GROUP BY signature)
SELECT tk.slot, tk.signature, list_has_any(list_concat(account_keys, coalesce(owners, [])), ['c15', 'c30']) AS by_all,
       list_has_any(list_concat(account_keys, coalesce(changed, [])), ['c15', 'c30']) AS by_changed
FROM tk LEFT JOIN o ON tk.signature = o.signature
WHERE list_has_any(list_concat(account_keys, coalesce(owners, [])), ['c15', 'c30'])
""")
def prefilter_token_accounts(spark, sf_dir):
    """Token-balance owners count as keys: all, or only those whose balance changed."""
    owner = F.concat(F.lit("c"), F.col("supplier") * 3).alias("owner")
    b = adapters.lines(spark, sf_dir).groupBy("signature", owner).agg(F.min("amount").alias("pre"), F.max("amount").alias("post"))
    b = b.groupBy("signature").agg(F.collect_list(F.struct("owner", "pre", "post")).alias("token_balances"))
    t = adapters.with_keys(spark, sf_dir).join(b, "signature", "left")
    t = t.withColumn("token_balances", F.coalesce("token_balances", F.array().cast("array<struct<owner:string,pre:bigint,post:bigint>>")))
    keys = frozenset({"c15", "c30"})
    wide, changed = (TransactionPart(include=keys, token_accounts=m, failed=None).column() for m in ("all", "balance_changed"))
    return t.where(wide).select("slot", "signature", wide.alias("by_all"), changed.alias("by_changed"))


@query("""
SELECT slot, signature, CASE WHEN a AND b THEN 'cheap,failed' WHEN a THEN 'cheap' ELSE 'failed' END AS filters
FROM (SELECT slot, signature, list_has_any(account_keys, ['s1']) AND NOT failed AS a, failed AND list_has_any(account_keys, ['s1', 's2']) AS b FROM tk) WHERE a OR b
""")
def shared_scan_routing(spark, sf_dir):
    """Two parsers' filters over one scan: each row says which of them it is for."""
    f = Filters({"cheap": Prefilter(transaction=TransactionPart(include=frozenset({"s1"}))), "failed": Prefilter(transaction=TransactionPart(include=frozenset({"s1", "s2"}), failed=True))})
    return f.routed(adapters.with_keys(spark, sf_dir), "transaction").select("slot", "signature", F.array_join("filters", ",").alias("filters"))


@query("SELECT c_custkey AS pubkey, c_nationkey::BIGINT AS owner FROM customer WHERE substr(c_name, 10, 7) = '0000000' AND c_nationkey IN (1, 2, 3)")
def account_memcmp(spark, sf_dir):
    p = Prefilter.builder().account_owners({1, 2, 3}).account_filters([Memcmp(9, b"0000000")]).build()
    return p.account.apply(adapters.accounts(spark, sf_dir)).select("pubkey", "owner")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE octet_length(encode(text)) = 500 OR octet_length(encode(text)) = 600")
def account_datasize(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    found = d.where(DataSize(500).column() | DataSize(600).column())
    return found.select("doc_id", F.octet_length("data").cast("bigint").alias("n"))


@query("SELECT c_custkey AS pubkey, CAST(round(c_acctbal * 100) AS BIGINT) AS lamports FROM customer WHERE round(c_acctbal * 100) > 500000 AND round(c_acctbal * 100) < 600000 AND c_mktsegment <> 'BUILDING'")
def account_lamports(spark, sf_dir):
    p = Prefilter.builder().accounts_include_all().account_filters([Lamports("gt", 500000), Lamports("lt", 600000)]).account_nonempty_txn_signature(True).build()
    return p.account.apply(adapters.accounts(spark, sf_dir)).select("pubkey", "lamports")


@query("SELECT c_custkey AS pubkey, substr(c_name, 1, 4) || substr(c_name, 10, 6) AS window_text FROM customer")
def data_slice_projection(spark, sf_dir):
    cut = DataSlice.column([DataSlice(0, 4), DataSlice(9, 6)])
    return adapters.accounts(spark, sf_dir).select("pubkey", F.decode(cut, "UTF-8").alias("window_text"))


@query("SELECT c_custkey AS pubkey, n_name AS owner_name, r_name AS parser FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def owner_routing(spark, sf_dir):
    """Snapshot rows find their parsers by owner: a lookup table of one row per owner."""
    n = adapters.table(spark, sf_dir, "nation")
    r = adapters.table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    owners = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("bigint").alias("owner"), F.col("n_name").alias("owner_name"), F.col("r_name").alias("parser"))
    return dispatch.routed(adapters.accounts(spark, sf_dir), owners, "owner").select("pubkey", "owner_name", "parser")


# --- 2.4 flatten -----------------------------------------------------------------------------------


#: Calls of the adapters' nested transactions: place in the order, path and flat path.
_CALLS = """
, k AS (SELECT ix.*, CAST(outer_ix AS BIGINT) AS k FROM ix),
cl AS (SELECT *, k // 3 AS o, k % 3 AS j FROM k),
pt AS (SELECT *, CAST(o + 1 AS VARCHAR) || CASE WHEN j = 0 THEN '' WHEN j = 1 THEN '.1' WHEN signature % 2 = 1 THEN '.1.1' ELSE '.2' END AS path,
              CAST(o + 1 AS VARCHAR) || CASE WHEN j = 0 THEN '' ELSE '.' || CAST(j AS VARCHAR) END AS flat FROM cl)
"""


@query(
    _CALLS
    + """
SELECT slot, signature, path, 'g' || program AS program, CASE WHEN signature % 100 = 9 AND j = 0 THEN '' ELSE 'c' || fee_payer || ',' END || 'p' || part || ',s' || supplier AS accounts,
       CAST(amount AS VARCHAR) AS data, CAST(slot AS VARCHAR) || ':' || signature || ':' || flat AS key, CASE WHEN signature % 100 = 9 AND j = 0 THEN 'bad_account_index' END AS error
FROM pt WHERE signature % 100 NOT IN (7, 8)
UNION ALL
SELECT slot, signature, NULL, NULL, NULL, NULL, NULL, CASE signature % 100 WHEN 7 THEN 'missing_message' ELSE 'bad_inner_index' END
FROM tx WHERE signature % 100 IN (7, 8) AND signature IN (SELECT signature FROM ln)
"""
)
def flatten_instructions(spark, sf_dir):
    """Nested transactions to calls: keys resolved over three lists, inner calls below their outer one, faults as rows."""
    i = flatten.instructions(adapters.nested(spark, sf_dir))
    text = lambda c: F.decode(c, "UTF-8")
    key = F.when(F.col("flat_path").isNotNull(), dispatch.instruction_key())
    return i.select(
        "slot", "signature", flatten.path_text(F.col("path")).alias("path"), text(F.col("program")).alias("program"),
        F.array_join(F.transform("accounts", text), ",").alias("accounts"), text(F.col("data")).alias("data"), key.alias("key"), "error",
    )


@query(_CALLS + "SELECT slot, signature, flat, CAST(k AS INTEGER) AS place, j > 0 AS is_child, j > 0 AS is_descendant FROM pt WHERE signature % 100 NOT IN (7, 8) AND NOT (j = 2 AND signature % 2 = 1)"
       " UNION ALL SELECT slot, signature, flat, CAST(k AS INTEGER), FALSE, TRUE FROM pt WHERE signature % 100 NOT IN (7, 8) AND j = 2 AND signature % 2 = 1")  # fmt: skip
def flat_index(spark, sf_dir):
    """All calls in order of their paths: flat indices, places, and how each hangs below its outer call."""
    i = flatten.instructions(adapters.nested(spark, sf_dir)).where("path is not null")
    place = F.row_number().over(Window.partitionBy("signature").orderBy("path")) - 1
    outer = F.slice("path", 1, 1)
    return i.select("slot", "signature", F.col("ix_index").alias("flat"), place.alias("place"), flatten.is_parent(outer, F.col("path")).alias("is_child"), flatten.is_ancestor(outer, F.col("path")).alias("is_descendant"))


@query("""
, n AS (SELECT signature, count(*) AS n FROM ln GROUP BY signature),
c AS (SELECT signature, unnest(range(0, n)) AS k FROM n)
SELECT signature, CAST(k AS INTEGER) AS call, CAST(5 * k AS INTEGER) AS outer_start, CAST(5 * k + 5 AS INTEGER) AS outer_end, CAST(5 * k + 1 AS INTEGER) AS inner_start, CAST(5 * k + 4 AS INTEGER) AS inner_end, 2 AS own_lines FROM c
""")
def log_slices(spark, sf_dir):
    """Log lines to calls: each outer call writes two lines of its own around the three of its inner one."""
    t = adapters.calls(spark, sf_dir)
    say = lambda x, what: F.concat(F.lit("Program g"), x["program"], F.lit(f" {what}"))
    lines = F.flatten(F.transform("calls", lambda x: F.array(say(x, "invoke [1]"), F.lit("Program inner invoke [2]"), F.lit("Program log: inner invoke [1]"), F.lit("Program inner success"), say(x, "success"))))
    tree = F.flatten(F.transform("calls", lambda _, k: F.array(F.array(k), F.array(k, F.lit(0)))))
    programs = F.flatten(F.transform("calls", lambda x: F.array(F.concat(F.lit("g"), x["program"]), F.lit("inner"))))
    t = t.select("signature", lines.alias("lines"), programs.alias("programs"), tree.alias("tree"))
    t = t.select("signature", "lines", flatten.log_slices(F.col("lines"), F.col("programs"), F.col("tree")).alias("s"))
    own = lambda x: flatten.direct_lines(F.slice("lines", x["log_start"] + 1, x["log_end"] - x["log_start"]))
    # cut per transaction: exploded calls don't each carry all of its lines
    each = F.transform(F.filter("s", lambda _, i: i % 2 == 0), lambda x, k: F.struct(k.alias("call"), x.alias("x"), F.get("s", 2 * k + 1).alias("y"), F.size(own(x)).alias("own_lines")))
    return t.select("signature", F.inline(each)).select(
        "signature", "call", F.col("x.log_start").alias("outer_start"), F.col("x.log_end").alias("outer_end"),
        F.col("y.log_start").alias("inner_start"), F.col("y.log_end").alias("inner_end"), "own_lines",
    )


_HEIGHTS = "list_transform(list(role ORDER BY turn), lambda r: CASE r WHEN 'system' THEN NULL WHEN 'user' THEN 2 ELSE 3 END)"


@query(f"""
WITH RECURSIVE h AS (SELECT conv_id, {_HEIGHTS} AS hs FROM conversations GROUP BY conv_id),
f AS (
  SELECT conv_id, hs, 1 AS i, [4, 0] AS p, [[4, 0]] AS acc FROM h WHERE len(hs) > 0
  UNION ALL
  SELECT conv_id, hs, i + 1, q, list_append(acc, q) FROM (
    SELECT *, CASE WHEN hs[i + 1] IS NULL OR hs[i] IS NULL OR hs[i + 1] = hs[i] THEN list_append(p[1:len(p) - 1], p[len(p)] + 1)
                   WHEN hs[i + 1] > hs[i] THEN list_append(p, 0)
                   ELSE list_append(p[1:least(hs[i + 1], len(p)) - 1], p[least(hs[i + 1], len(p))] + 1) END AS q
    FROM f WHERE i < len(hs)))
SELECT conv_id, CAST(i AS INTEGER) AS n, array_to_string(list_transform(acc, lambda x: array_to_string(list_transform(x, lambda y: y + 1), '.')), ' ') AS paths
FROM f WHERE i = len(hs)
""")
def path_from_stack_heights(spark, sf_dir):
    """Tree paths from stack heights; a conversation's turns stand for calls: system unknown, user 2, assistant 3."""
    c = adapters.table(spark, sf_dir, "conversations")
    height = F.when(F.col("role") == "user", 2).when(F.col("role") != "system", 3)
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", height.alias("h")))).alias("t"))
    p = flatten.paths(F.transform("t", lambda x: x["h"]), F.lit(4))
    return c.select("conv_id", F.size("t").alias("n"), F.array_join(F.transform(p, flatten.path_text), " ").alias("paths"))


@query("""
, c AS (SELECT signature, slot, outer_ix, row_number() OVER (PARTITION BY signature ORDER BY outer_ix) AS k FROM ix)
SELECT slot, signature, CAST((k - 1) // 3 + 1 AS VARCHAR) || CASE WHEN (k - 1) % 3 > 0 THEN '.' || ((k - 1) % 3) ELSE '' END AS flat FROM c
""")
def flat_index(spark, sf_dir):
    """Flat indices: every third call is an outer one, the two after it are below it."""
    i = adapters.instructions(spark, sf_dir)
    k = F.col("outer").cast("int")
    path = F.when(k % 3 == 0, F.array((k / 3).cast("int"))).otherwise(F.array((k / 3).cast("int"), k % 3 - 1))
    return i.select("slot", "signature", flatten.path_text(path).alias("flat"))


@query("""
, c AS (SELECT conv_id, turn, role, sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER w AS opened FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, opened ORDER BY turn) AS k, sum(CASE role WHEN 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, opened ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM c)
SELECT conv_id, CAST(count(DISTINCT opened) AS INTEGER) AS outer_calls, CAST(count(*) AS INTEGER) AS lines_in_calls
FROM d WHERE opened > 0 AND coalesce(closed, 0) = 0 GROUP BY conv_id
""")
def split_outer_logs(spark, sf_dir):
    """Logs cut by outer call. Users open one, assistants close it; system turns imitate a call in a log line."""
    logs = _logs(spark, sf_dir)
    cut = flatten.split_outer(F.col("lines"))
    out = logs.select("conv_id", F.size(cut).alias("outer_calls"), F.size(F.flatten(cut)).alias("lines_in_calls"))
    return out.where("outer_calls > 0")


def _logs(spark, sf_dir) -> DataFrame:
    c = adapters.table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("Program P"), F.col("turn"), F.lit(" invoke [1]"))).when(F.col("role") == "assistant", "Program P success").otherwise("Program log: invoke [1]")
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("t"))
    return c.select("conv_id", F.transform("t", lambda t: t["x"]).alias("lines"))


@query("""
, c AS (SELECT conv_id, turn, role, sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER w AS up, coalesce(sum(CASE role WHEN 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS down
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CAST(count(CASE WHEN up - down = 1 THEN 1 END) AS INTEGER) AS direct_lines, CAST(max(up - down) AS INTEGER) AS deepest FROM c
WHERE conv_id IN (SELECT conv_id FROM c GROUP BY conv_id HAVING min(up - down) >= 0) GROUP BY conv_id
""")
def direct_logs(spark, sf_dir):
    """Lines of the outermost call itself, in logs whose closes never outnumber their opens."""
    logs = _logs(spark, sf_dir).withColumns({"d": flatten.depths(F.col("lines")), "k": flatten.line_kinds(F.col("lines"))})
    step = lambda a, x: F.struct((a["d"] + F.when(x == "invoke", 1).when(x == "close", -1).otherwise(0)).alias("d"), F.least(a["low"], a["d"] + F.when(x == "invoke", 1).when(x == "close", -1).otherwise(0)).alias("low"))
    low = F.aggregate("k", F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), step, lambda a: a["low"])
    return logs.where(low >= 0).select("conv_id", F.size(flatten.direct_lines(F.col("lines"))).alias("direct_lines"), F.array_max("d").alias("deepest"))


@query("""
SELECT conv_id, CAST(count(CASE role WHEN 'user' THEN 1 END) AS INTEGER) AS invokes, CAST(count(CASE role WHEN 'assistant' THEN 1 END) AS INTEGER) AS closes,
       CAST(count(CASE role WHEN 'system' THEN 1 END) AS INTEGER) AS others
FROM conversations GROUP BY conv_id
""")
def log_line_kinds(spark, sf_dir):
    logs = _logs(spark, sf_dir).withColumn("k", flatten.line_kinds(F.col("lines")))
    n = lambda kind: F.size(F.filter("k", lambda x: x == kind))
    return logs.select("conv_id", n("invoke").alias("invokes"), n("close").alias("closes"), n("other").alias("others"))


# --- 2.6, 2.7 dispatch --------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 'economy' WHEN p_type LIKE 'PRO%' THEN 'promo' WHEN length(p_type) = 20 THEN 'sized' END AS kind FROM part")
def discriminator_dispatch(spark, sf_dir):
    """The first discriminator that matches decides: two constants, then a size."""
    from slotweave.decode.ir import Struct
    from slotweave.decode.program import Kind, Match, Program

    p = Program("parts", "", accounts=(Kind("economy", Struct(()), (Match(0, b"ECO"),)), Kind("promo", Struct(()), (Match(0, b"PRO"),)), Kind("sized", Struct(()), (Match(size=20),))))
    kind = p.account_kind(F.encode("p_type", "UTF-8"))
    return adapters.table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("""
, n AS (SELECT signature, CAST(count(*) AS INTEGER) AS n FROM ln GROUP BY signature)
SELECT signature, n, CASE WHEN n >= 6 THEN 'six' WHEN n >= 3 THEN 'three' ELSE 'error' END AS kind FROM n
""")
def collision_by_account_count(spark, sf_dir):
    """One discriminator, two kinds: the one that wants more accounts goes first."""
    from slotweave.decode.ir import Struct
    from slotweave.decode.program import AccountSpec, Kind, Match, Program

    kind = lambda name, n: Kind(name, Struct(()), (Match(0, b"\x07"),), tuple(AccountSpec(f"a{i}") for i in range(n)))
    p = Program("p", "", instructions=(kind("three", 3), kind("six", 6)))
    n = adapters.lines(spark, sf_dir).groupBy("signature").agg(F.count(F.lit(1)).cast("int").alias("n"))
    c = p.instruction_choice(F.lit(b"\x07"), F.col("n"))
    return n.select("signature", "n", F.when(c["error"].isNull(), c["kind"]).otherwise("error").alias("kind"))


@query("""
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'parsed' WHEN 'signup' THEN 'parsed' WHEN 'error' THEN 'error' WHEN 'click' THEN 'error' ELSE 'filtered' END AS outcome,
       CASE event_type WHEN 'purchase' THEN 'orders' WHEN 'signup' THEN 'users' WHEN 'error' THEN 'dead' END AS topic,
       event_type = 'error' AS fallback
FROM events
""")
def fallback_routing(spark, sf_dir):
    """First parser that parses wins; errors go to a fallback topic if one is there."""
    e = _dispatched_events(spark, sf_dir)
    return e.select("event_id", "outcome", "topic", "fallback")


def _dispatched_events(spark, sf_dir) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").withColumn("program", F.when(F.col("event_type").isin("purchase", "error"), "shop").when(F.col("event_type").isin("signup", "click"), "site"))
    is_ = lambda t: F.col("event_type") == t
    payload = F.to_json(F.struct("user_id", "event_type"))
    shop = F.when(is_("purchase"), dispatch.outcome("parsed", "purchase", payload)).otherwise(dispatch.outcome("error", error="no discriminator matches"))
    site = F.when(is_("signup"), dispatch.outcome("parsed", "signup", payload)).otherwise(dispatch.outcome("error", error="no discriminator matches"))
    shop_none = F.when(is_("view"), dispatch.outcome("parsed", "view")).otherwise(dispatch.outcome("filtered"))
    r = dispatch.Registry()
    r.register(dispatch.Parser("views", "shop", shop_none, "views"))
    r.register(dispatch.Parser("shop", "shop", shop, "orders", "dead"))
    r.register(dispatch.Parser("site", "site", site, "users"))
    return r.dispatch(e)


@query("""
SELECT event_type AS update, count(*) AS received, count(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END) AS parsed,
       count(CASE WHEN event_type = 'view' THEN 1 END) AS filtered, count(CASE WHEN event_type IN ('error', 'click') THEN 1 END) AS errors,
       count(CASE WHEN event_type = 'error' THEN 1 END) AS fallbacks
FROM events GROUP BY 1
""")
def outcome_metrics(spark, sf_dir):
    return dispatch.metrics(_dispatched_events(spark, sf_dir), F.col("event_type"))


@query("""
SELECT CASE WHEN program < 2 THEN 'decoded' ELSE 'raw' END AS topic, CAST(slot AS VARCHAR) || ':' || signature || ':' || (outer_ix + 1) AS key,
       'slot=' || slot || ';signature=' || signature || ';ix_index=' || (outer_ix + 1) || ';fee_payer=' || fee_payer || CASE WHEN program >= 2 THEN ';parse_error=unknown program' ELSE '' END AS headers,
       program < 2 AS is_decoded
FROM ix WHERE NOT failed
""")
def record_keys_headers(spark, sf_dir):
    i = adapters.instructions(spark, sf_dir).where("not failed").withColumn("ix_index", flatten.path_text(F.array(F.col("outer").cast("int"))))
    ok = F.col("program") < 2
    d = i.withColumns({"outcome": F.when(ok, "parsed").otherwise("error"), "payload": F.lit("{}"), "kind": F.lit("line"), "error": F.when(~ok, "unknown program"), "topic": F.when(ok, "decoded").otherwise("raw")})
    r = dispatch.records(d, dispatch.instruction_key(), dispatch.headers("slot", "signature", "ix_index", "fee_payer"), F.lit("{}"))
    flat = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"])), ";")
    return r.select("topic", "key", flat.alias("headers"), "is_decoded")


@query(_CALLS + """
SELECT signature, flat, '{"slot":"' || slot || '","signature":"' || hex(encode(CAST(signature AS VARCHAR))) || '","ix_index":"' || flat || '","program":"' || hex(encode('g' || program)) ||
       '","accounts":["' || hex(encode('c' || fee_payer)) || '","' || hex(encode('p' || part)) || '","' || hex(encode('s' || supplier)) || '"],"data":"' || to_base64(encode(CAST(amount AS VARCHAR))) || '"}' AS payload
FROM pt WHERE program = 3 AND NOT failed AND signature % 100 NOT IN (7, 8, 9)
""")
def json_fallback_payload(spark, sf_dir):
    """Undecoded instructions as JSON; null fields (no parse error here) are left out."""
    i = flatten.instructions(adapters.nested(spark, sf_dir)).where("not failed and signature % 100 < 7 or signature % 100 > 9").where("not failed")
    i = i.where(F.col("program") == F.lit(b"g3")).withColumn("signature_id", F.col("signature"))
    i = i.withColumn("signature", F.encode(F.col("signature").cast("string"), "UTF-8"))
    return i.select(F.col("signature_id").alias("signature"), F.col("ix_index").alias("flat"), dispatch.raw_instruction().alias("payload"))


@query("SELECT c_custkey AS pubkey, '{\"slot\":\"' || (c_custkey % 100) || '\",\"pubkey\":\"' || hex(encode(CAST(c_custkey AS VARCHAR))) || '\",\"owner\":\"' || hex(encode(CAST(c_nationkey AS VARCHAR))) || '\",\"lamports\":\"' || CAST(round(c_acctbal * 100) AS BIGINT) || '\",\"write_version\":\"' || c_custkey || '\",\"data\":\"' || to_base64(encode(c_name)) || '\",\"parse_error\":\"unknown owner\"}' AS payload, (c_custkey % 100) || ':' || c_custkey || ':' || c_custkey AS key FROM customer WHERE c_nationkey >= 20")
def account_fallback_records(spark, sf_dir):
    """Accounts that no parser takes: the record's key and its JSON."""
    a = adapters.accounts(spark, sf_dir).where("owner >= 20").withColumn("id", F.col("pubkey"))
    a = a.withColumns({"key": dispatch.account_key(), "error": F.lit("unknown owner"), **{c: F.encode(F.col(c).cast("string"), "UTF-8") for c in ("pubkey", "owner")}})
    return a.select(F.col("id").alias("pubkey"), dispatch.raw_account().alias("payload"), "key")


@query("SELECT p_partkey, substr(sha256('global:' || p_name), 1, 16) AS discriminator FROM part")
def name_discriminators(spark, sf_dir):
    return adapters.table(spark, sf_dir, "part").select("p_partkey", discriminator_col("global", "p_name").alias("discriminator"))


# --- 2.9 order ------------------------------------------------------------------------------------------


@query("""
SELECT l_suppkey AS pubkey, l_orderkey AS last_write, CAST(round(l_quantity * 100) AS BIGINT) AS amount FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1
""")
def duplicate_last_wins(spark, sf_dir):
    """The last write of each key, by an aggregate that combines before it shuffles."""
    w = adapters.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pubkey"),
        F.col("l_orderkey").alias("last_write"),
        F.round(F.col("l_quantity") * 100).cast("bigint").alias("amount"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("ingest"),
    )
    return last_wins(w, ["pubkey"], "ingest").select("pubkey", "last_write", "amount")


@query("""
SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY tx.signature) - 1 AS tx_index, tx.signature FROM tx WHERE slot BETWEEN 100 AND 1000
""")
def epoch_range_scan(spark, sf_dir):
    """A half-open range of slots of a capture: the range prunes its folders and is a predicate on the scan."""
    path = f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    replay.capture(adapters.headers(spark, sf_dir).select("slot", "signature"), path)
    o = replay.read_range(spark, path, 100, 1001)
    return o.select("slot", (F.row_number().over(Window.partitionBy("slot").orderBy("signature")) - 1).cast("bigint").alias("tx_index"), "signature")


@query("""
, a AS (SELECT slot, count(*) AS n, CAST(sum(lamports) AS BIGINT) AS lamports FROM tx GROUP BY slot)
SELECT slot, n, lamports, CASE WHEN slot % 7 = 3 AND n > 5 THEN 'overshoot' WHEN slot % 7 = 5 THEN 'short' ELSE 'complete' END AS state FROM a
""")
def entry_counts(spark, sf_dir):
    """Entries against the block's metadata: complete, short or beyond it."""
    tx = adapters.headers(spark, sf_dir)
    per = tx.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("lamports").alias("lamports"))
    over, short = (F.col("slot") % 7 == 3) & (F.col("n") > 5), F.col("slot") % 7 == 5
    meta = per.select("slot", F.lit(0).alias("bank_id"), F.when(over, F.col("n") - 1).when(short, F.col("n") + 1).otherwise(F.col("n")).alias("entries_count"), F.col("n").alias("executed_transaction_count"), "n", "lamports")
    entries = tx.select("slot", F.lit(0).alias("bank_id"), F.col("signature").alias("index"), F.lit(1).alias("executed_transaction_count"))
    twice = entries.unionByName(entries.where("index % 5 = 0"))  # repeats count once
    got = slots.entry_completeness(twice, meta.drop("n", "lamports"))
    return per.join(got.select("slot", "state"), "slot")
