"""Queries over generated program data: accounts and instructions as bytes, decoded again, with their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.decode import columns, idl, proto
from slotweave.decode.builtin import PROGRAMS
from slotweave.decode.ir import Bool, Bytes, Enum, Items, Num, Option, Prefixed, Struct, ZeroOption
from slotweave.decode.program import AccountSpec, Kind, Match, Program
from slotweave.functions.encoding import base58, camel, checked_add, le_bytes, pascal, saturating_add, saturating_sub, snake, unbase58
from slotweave.operators import dispatch
from slotweave.operators.prefilter import DataSize, TokenAccountState
from slotweave.plans.transactions import query
from slotweave.sources import adapters


def _key(c: str | Column, letter: str) -> Column:
    """A 32-byte key of a row: the hash of its letter and number. ``_KEY`` is its SQL twin, in hex."""
    return F.unhex(F.sha2(F.concat(F.lit(letter), (F.col(c) if isinstance(c, str) else c).cast("string")).cast("binary"), 256))


def _hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def _zeros(n: int) -> Column:
    return F.lit(bytes(n))


def _payload(o: str, path: str, kind: str = "string") -> Column:
    return F.get_json_object(f"{o}.payload", path).cast(kind)


def _token_account(state: Column) -> Column:
    """165 bytes: mint, owner, amount, no delegate, state, not native, nothing delegated, no close authority."""
    return F.concat(_key("c_nationkey", "m"), _key("c_custkey", "o"), le_bytes(F.round(F.abs("c_acctbal") * 100).cast("bigint"), 8), _zeros(36), le_bytes(state, 1), _zeros(12), _zeros(8), _zeros(36))


def _state() -> Column:
    return F.col("c_custkey") % 4  # 3: no such state


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN 'filtered' WHEN c_custkey % 4 = 3 THEN 'error' ELSE 'parsed' END AS outcome,
       CASE WHEN c_custkey % 10 <> 9 THEN 'TokenAccount' END AS kind,
       CASE WHEN c_custkey % 10 <> 9 AND c_custkey % 4 <> 3 THEN CAST(round(abs(c_acctbal) * 100) AS BIGINT) END AS amount,
       CASE WHEN c_custkey % 10 <> 9 AND c_custkey % 4 <> 3 THEN CASE c_custkey % 4 WHEN 0 THEN 'Uninitialized' WHEN 1 THEN 'Initialized' ELSE 'Frozen' END END AS state,
       CASE WHEN c_custkey % 10 <> 9 AND c_custkey % 4 <> 3 THEN sha256('o' || c_custkey) END AS owner,
       CASE WHEN c_custkey % 10 <> 9 AND c_custkey % 4 <> 3 THEN sha256('m' || c_nationkey) END AS mint
FROM customer
""")
def token_accounts(spark, sf_dir) -> DataFrame:
    """Token accounts: those of another length are none, an unknown state can't be read."""
    c = adapters.table(spark, sf_dir, "customer")
    data = F.when(F.col("c_custkey") % 10 == 9, _token_account(_state()).substr(F.lit(1), F.lit(100))).otherwise(_token_account(_state()))
    d = c.select(F.col("c_custkey").alias("id"), PROGRAMS["token"].account_outcome(data).alias("o"))
    key = lambda name: _hex(unbase58(_payload("o", f"$.{name}")))
    return d.select("id", "o.outcome", "o.kind", _payload("o", "$.amount", "bigint").alias("amount"), _payload("o", "$.state").alias("state"), key("owner").alias("owner"), key("mint").alias("mint"))


@query("""
SELECT c_custkey AS id, sha256('o' || c_custkey) AS owner, CAST(CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS VARCHAR) AS amount, CASE c_custkey % 4 WHEN 0 THEN 'Uninitialized' WHEN 1 THEN 'Initialized' ELSE 'Frozen' END AS state
FROM customer WHERE c_custkey % 4 <> 3
""")
def token_account_columns(spark, sf_dir) -> DataFrame:
    """The same layout compiled to Columns: nothing leaves the JVM."""
    c = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _token_account(_state()).alias("data"))
    c = columns.held(c.select("id", PROGRAMS["token"].account_fields("TokenAccount", F.col("data")).alias("v")), "v")
    return c.select("id", _hex(F.col("v.owner")).alias("owner"), F.col("v.amount").cast("string").alias("amount"), "v.state")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 10 <> 9")
def token_account_state(spark, sf_dir) -> DataFrame:
    """The filter for initialised token accounts: the right length and a state that isn't zero."""
    data = F.when(F.col("c_custkey") % 10 == 9, F.concat(_token_account(_state()), F.lit(b"\x01"))).otherwise(_token_account(_state()))
    c = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), data.alias("data"))
    return c.where(TokenAccountState().column() & ~DataSize(0).column()).select("id")


#: Tag, name and SQL of the arguments of token instructions with an amount or none.
_AMOUNTS = ((3, "Transfer"), (4, "Approve"), (7, "MintTo"), (8, "Burn"), (23, "AmountToUiAmount"))
_BARE = ((1, "InitializeAccount"), (5, "Revoke"), (9, "CloseAccount"), (10, "FreezeAccount"), (11, "ThawAccount"), (17, "SyncNative"), (21, "GetAccountDataSize"), (22, "InitializeImmutableOwner"), (38, "WithdrawExcessLamports"))
_CHECKED = ((12, "TransferChecked"), (13, "ApproveChecked"), (14, "MintToChecked"), (15, "BurnChecked"))
_ALL = [*[(t, n, 1) for t, n in _AMOUNTS], *[(t, n, 0) for t, n in _BARE], *[(t, n, 2) for t, n in _CHECKED]]


def _cases(values, column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


def _picked(values, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("l_orderkey") % len(_ALL)).cast("int"))


@query(f"""
SELECT l_orderkey AS order_key, l_linenumber AS line, {_cases([n for _, n, _ in _ALL], f"l_orderkey % {len(_ALL)}")} AS kind,
       CASE WHEN {_cases([a for _, _, a in _ALL], f"l_orderkey % {len(_ALL)}")} > 0 THEN CAST(l_partkey AS BIGINT) END AS amount,
       CASE WHEN {_cases([a for _, _, a in _ALL], f"l_orderkey % {len(_ALL)}")} = 2 THEN CAST(l_linenumber AS BIGINT) END AS decimals, l_partkey AS part, l_suppkey AS supplier
FROM lineitem
""")
def token_instructions(spark, sf_dir) -> DataFrame:
    """Eighteen kinds of token instructions, told apart by their tag."""
    i = adapters.table(spark, sf_dir, "lineitem")
    args = _picked([a for _, _, a in _ALL], "int")
    data = F.concat(le_bytes(_picked([t for t, _, _ in _ALL], "bigint"), 1), F.when(args > 0, le_bytes(F.col("l_partkey"), 8)).otherwise(_zeros(0)), F.when(args == 2, le_bytes(F.col("l_linenumber"), 1)).otherwise(_zeros(0)))
    keys = F.array(*[F.lit(x) for x in "abcde"])
    d = i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", PROGRAMS["token"].instruction_outcome(data, keys).alias("o"))
    d = columns.held(d, "o", lambda o: o["outcome"] == "parsed")
    return d.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), "o.kind", _payload("o", "$.args.amount", "bigint").alias("amount"), _payload("o", "$.args.decimals", "bigint").alias("decimals"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN 'error' ELSE 'parsed' END AS outcome, CASE WHEN o_orderkey % 5 <> 4 THEN 'MintTo,null,Burn' END AS inner_kinds, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_custkey AS BIGINT) END AS minted,
       CASE WHEN o_orderkey % 5 <> 4 THEN 'g' END AS left_over
FROM orders
""")
def token_batch(spark, sf_dir) -> DataFrame:
    """Batches of token instructions: an inner one that can't be read keeps its place; a cut batch is an error."""
    part = lambda n, body: F.concat(F.lit(bytes([n])), le_bytes(F.octet_length(body), 1), body)
    mint, unknown, burn = F.concat(F.lit(b"\x07"), le_bytes(F.col("o_custkey"), 8)), F.lit(b"\x63"), F.concat(F.lit(b"\x08"), le_bytes(F.col("o_orderkey"), 8))
    data = F.concat(F.lit(b"\xff"), part(3, mint), part(0, unknown), part(3, burn))
    data = F.when(F.col("o_orderkey") % 5 == 4, data.substr(F.lit(1), F.octet_length(data) - 1)).otherwise(data)
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), PROGRAMS["token"].instruction_outcome(data, F.array(*[F.lit(x) for x in "abcdefg"])).alias("o"))
    kinds = F.array_join(F.transform(F.from_json(F.get_json_object("o.payload", "$.instructions"), "array<struct<kind:string>>"), lambda x: x["kind"]), ",", "null")
    return o.select("id", "o.outcome", kinds.alias("inner_kinds"), _payload("o", "$.instructions[0].args.amount", "bigint").alias("minted"), _payload("o", "$.remaining_accounts[0]").alias("left_over"))


@query("""
SELECT s_suppkey AS id, 'ExtendedMint' AS kind, CAST(s_suppkey AS BIGINT) AS supply, 'MintCloseAuthority,TransferFeeConfig,null' AS extensions, sha256('a' || s_suppkey) AS close_authority, CAST(s_nationkey AS BIGINT) AS basis_points, 'ff' AS unknown
FROM supplier
""")
def extended_accounts(spark, sf_dir) -> DataFrame:
    """Mints with a list of extensions behind them: typed ones, and one of an unknown type as bytes."""
    mint = F.concat(_zeros(36), le_bytes(F.col("s_suppkey"), 8), F.lit(b"\x06\x01"), _zeros(36), _zeros(83), F.lit(b"\x01"))
    fee = F.concat(_zeros(16), le_bytes(F.col("s_nationkey"), 2))
    config = F.concat(F.lit(b"\x01\x00\x6c\x00"), _key("s_suppkey", "t"), _key("s_suppkey", "w"), _zeros(8), fee, fee)
    data = F.concat(mint, F.lit(b"\x03\x00\x20\x00"), _key("s_suppkey", "a"), config, F.lit(b"\x63\x00\x01\x00\xff"))
    d = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), PROGRAMS["token_extensions"].account_outcome(data).alias("o"))
    names = F.array_join(F.transform(F.from_json(F.get_json_object("o.payload", "$.extensions"), "array<struct<name:string>>"), lambda x: x["name"]), ",", "null")
    authority = _hex(unbase58(_payload("o", "$.extensions[0].value.close_authority")))
    return d.select("id", "o.kind", _payload("o", "$.supply", "bigint").alias("supply"), names.alias("extensions"), authority.alias("close_authority"), _payload("o", "$.extensions[1].value.newer_transfer_fee.transfer_fee_basis_points", "bigint").alias("basis_points"), _payload("o", "$.extensions[2].data").alias("unknown"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'TransferFee.SetTransferFee' WHEN 1 THEN 'CpiGuard.Enable' WHEN 2 THEN 'MetadataPointer.Update' WHEN 3 THEN 'TokenGroup.UpdateGroupMaxSize' ELSE 'Reallocate' END AS kind,
       CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN sha256('x' || p_partkey) WHEN 3 THEN CAST(p_partkey AS VARCHAR) WHEN 4 THEN '[3,' || p_size || ']' END AS argument
FROM part
""")
def extension_instructions(spark, sf_dir) -> DataFrame:
    """Envelopes of the extensions: fees, switches, pointers, the group interface, a list of types."""
    import hashlib

    group = hashlib.sha256(b"spl_token_group_interface:update_group_max_size").digest()[:8]
    k = F.col("p_partkey") % 5
    data = (
        F.when(k == 0, F.concat(F.lit(b"\x1a\x05"), le_bytes(F.col("p_size"), 2), _zeros(8)))
        .when(k == 1, F.lit(b"\x22\x00"))
        .when(k == 2, F.concat(F.lit(b"\x27\x01"), _key("p_partkey", "x")))
        .when(k == 3, F.concat(F.lit(group), le_bytes(F.col("p_partkey"), 8)))
        .otherwise(F.concat(F.lit(b"\x1d\x03\x00"), le_bytes(F.col("p_size"), 2)))
    )
    o = PROGRAMS["token_extensions"].instruction_outcome(data, F.array(*[F.lit(x) for x in "abcde"]))
    d = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("k"), o.alias("o"))
    of = lambda path: F.get_json_object("o.payload", f"$.args.{path}")
    pointer = _hex(unbase58(of("metadata_address")))
    argument = F.when(F.col("k") == 0, of("transfer_fee_basis_points")).when(F.col("k") == 2, pointer).when(F.col("k") == 3, of("max_size")).when(F.col("k") == 4, of("extension_types"))
    return d.select("id", "o.kind", argument.alias("argument"))


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'filtered' ELSE 'parsed' END AS outcome, CASE o_orderkey % 4 WHEN 1 THEN 'Buffer' WHEN 2 THEN 'Program' WHEN 3 THEN 'ProgramData' END AS kind,
       CASE o_orderkey % 4 WHEN 3 THEN CAST(o_custkey AS BIGINT) END AS deployed, CASE o_orderkey % 4 WHEN 2 THEN sha256('d' || o_orderkey) WHEN 3 THEN sha256('u' || o_orderkey) END AS key
FROM orders
""")
def loader_accounts(spark, sf_dir) -> DataFrame:
    """The loader's accounts by their 32-bit tag; an uninitialised one is none of interest."""
    k = F.col("o_orderkey") % 4
    data = (
        F.when(k == 0, _zeros(8))
        .when(k == 1, F.concat(F.lit(b"\1\0\0\0\0"), F.lit(b"code")))
        .when(k == 2, F.concat(F.lit(b"\2\0\0\0"), _key("o_orderkey", "d")))
        .otherwise(F.concat(F.lit(b"\3\0\0\0"), le_bytes(F.col("o_custkey"), 8), F.lit(b"\1"), _key("o_orderkey", "u"), F.lit(b"code")))
    )
    d = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), PROGRAMS["loader"].account_outcome(data).alias("o"))
    key = _hex(unbase58(F.coalesce(_payload("o", "$.program_data"), _payload("o", "$.upgrade_authority"))))
    return d.select("id", "o.outcome", "o.kind", _payload("o", "$.slot", "bigint").alias("deployed"), key.alias("key"))


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Upgrade' WHEN 1 THEN 'ExtendProgram' ELSE 'SetAuthority' END AS kind, CASE o_orderkey % 3 WHEN 1 THEN CAST(o_custkey AS BIGINT) END AS additional, CASE o_orderkey % 3 WHEN 2 THEN o_orderkey % 2 = 0 END AS has_new_authority
FROM orders
""")
def loader_instructions(spark, sf_dir) -> DataFrame:
    """The loader's instructions; optional accounts that are left out are null."""
    k = F.col("o_orderkey") % 3
    data = F.when(k == 0, F.lit(b"\3\0\0\0")).when(k == 1, F.concat(F.lit(b"\6\0\0\0"), le_bytes(F.col("o_custkey"), 4))).otherwise(F.lit(b"\4\0\0\0"))
    many, two = F.array(*[F.lit(x) for x in "abcdefg"]), F.array(F.lit("a"), F.lit("b"))
    keys = F.when(k != 2, many).when(F.col("o_orderkey") % 2 == 0, F.slice(many, 1, 3)).otherwise(two)
    d = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("k"), PROGRAMS["loader"].instruction_outcome(data, keys).alias("o"))
    return d.select("id", "o.kind", _payload("o", "$.args.additional_bytes", "bigint").alias("additional"), F.when(F.col("k") == 2, _payload("o", "$.accounts.new_authority").isNotNull()).alias("has_new_authority"))


@query("""
SELECT n_nationkey AS id, 'ValidatorList' AS kind, CAST(n_nationkey + 10 AS BIGINT) AS most, CAST(2 AS BIGINT) AS n, CAST(n_nationkey * 1000 AS BIGINT) AS first_stake, sha256('v' || n_nationkey) AS second_vote FROM nation
""")
def stake_pool_accounts(spark, sf_dir) -> DataFrame:
    """A stake pool's list of validators: a count, then as many entries of fixed size."""
    entry = lambda stake, letter: F.concat(le_bytes(stake, 8), _zeros(33), _key("n_nationkey", letter))
    data = F.concat(F.lit(b"\2"), le_bytes(F.col("n_nationkey") + 10, 4), F.lit(b"\2\0\0\0"), entry(F.col("n_nationkey") * 1000, "u"), entry(F.lit(0), "v"))
    d = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), PROGRAMS["stake_pool"].account_outcome(data).alias("o"))
    n = F.json_array_length(F.get_json_object("o.payload", "$.validators")).cast("bigint")
    return d.select("id", "o.kind", _payload("o", "$.max_validators", "bigint").alias("most"), n.alias("n"), _payload("o", "$.validators[0].active_stake_lamports", "bigint").alias("first_stake"), _hex(unbase58(_payload("o", "$.validators[1].vote_account_address"))).alias("second_vote"))


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'DepositSol' WHEN 1 THEN 'SetFee' ELSE 'WithdrawStakeWithSlippage' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'Epoch' ELSE '7' END AS argument
FROM orders
""")
def stake_pool_instructions(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey") % 3
    n = le_bytes(F.col("o_custkey"), 8)
    data = F.when(k == 0, F.concat(F.lit(b"\x0e"), n)).when(k == 1, F.concat(F.lit(b"\x0c\x02"), n, n)).otherwise(F.concat(F.lit(b"\x18"), n, F.lit(b"\7" + bytes(7))))
    keys = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: i.cast("string"))
    d = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("k"), PROGRAMS["stake_pool"].instruction_outcome(data, keys).alias("o"))
    of = lambda path: F.get_json_object("o.payload", f"$.args.{path}")
    return d.select("id", "o.kind", F.when(F.col("k") == 0, of("amount")).when(F.col("k") == 1, of("fee.kind")).otherwise(of("minimum_lamports_out")).alias("argument"))


# --- interface files ----------------------------------------------------------------------------------


def _number(n: str) -> dict:
    return {"kind": "numberTypeNode", "format": n, "endian": "le"}


#: A node tree: two kinds of accounts told apart by a 16-bit number, and by a size.
TREE = {
    "kind": "rootNode", "standard": "codama", "program": {
        "name": "bank", "publicKey": "Bank111", "definedTypes": [], "instructions": [],
        "accounts": [
            {"name": "vault", "data": {"kind": "structTypeNode", "fields": [{"name": "tag", "type": _number("u16")}, {"name": "sum", "type": _number("u64")}, {"name": "by", "type": {"kind": "optionTypeNode", "item": _number("u32"), "prefix": _number("u8")}}]},
             "discriminators": [{"kind": "constantDiscriminatorNode", "offset": 0, "constant": {"kind": "constantValueNode", "type": _number("u16"), "value": {"kind": "numberValueNode", "number": 513}}}]},
            {"name": "note", "data": {"kind": "structTypeNode", "fields": [{"name": "n", "type": _number("u8")}]}, "discriminators": [{"kind": "sizeDiscriminatorNode", "size": 1}]},
        ],
    },
}

#: An interface file of the other family: names' hashes tell kinds apart, C lays the account out.
LEGACY = {
    "version": "0.1.0", "name": "old_market",
    "instructions": [{"name": "placeOrder", "accounts": [{"name": "owner", "isMut": False, "isSigner": True}], "args": [{"name": "side", "type": {"defined": "Side"}}, {"name": "prices", "type": {"vec": "u32"}}, {"name": "memo", "type": {"option": "string"}}]}],
    "types": [{"name": "Side", "type": {"kind": "enum", "variants": [{"name": "Bid"}, {"name": "Ask"}]}}],
}


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 3 THEN 'error' ELSE 'parsed' END AS outcome, CASE p_partkey % 4 WHEN 2 THEN 'note' WHEN 3 THEN NULL ELSE 'vault' END AS kind,
       CASE WHEN p_partkey % 4 < 2 THEN CAST(p_partkey AS BIGINT) WHEN p_partkey % 4 = 2 THEN CAST(p_size AS BIGINT) END AS value, CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS BIGINT) END AS "by"
FROM part
""")
def node_tree_accounts(spark, sf_dir) -> DataFrame:
    """Accounts of a node tree: by a number, by their size, or by none."""
    program = idl.load(json.dumps(TREE))
    k = F.col("p_partkey") % 4
    head = F.concat(F.lit(b"\1\2"), le_bytes(F.col("p_partkey"), 8))
    data = F.when(k == 0, F.concat(head, F.lit(b"\0"))).when(k == 1, F.concat(head, F.lit(b"\1"), le_bytes(F.col("p_size"), 4))).when(k == 2, le_bytes(F.col("p_size"), 1)).otherwise(F.lit(b"zzz"))
    d = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), program.account_outcome(data).alias("o"))
    return d.select("id", "o.outcome", "o.kind", F.coalesce(_payload("o", "$.sum", "bigint"), _payload("o", "$.n", "bigint")).alias("value"), _payload("o", "$.by", "bigint").alias("by"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN 'error' ELSE 'parsed' END AS outcome, 'placeOrder' AS kind, CASE WHEN o_orderkey % 7 <> 6 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'bid' ELSE 'ask' END END AS side,
       CASE WHEN o_orderkey % 7 <> 6 THEN '[' || o_custkey || ',7]' END AS prices, CASE WHEN o_orderkey % 7 <> 6 AND o_orderkey % 3 = 0 THEN o_orderstatus END AS memo, sha256('k' || o_orderkey) IS NOT NULL AND o_orderkey % 7 <> 6 AS has_owner
FROM orders
""")
def legacy_interface(spark, sf_dir) -> DataFrame:
    """Instructions of an old interface file: hashed names, an enum, a list behind its length, an optional text."""
    import hashlib

    program = idl.load(LEGACY)
    tag = hashlib.sha256(b"global:place_order").digest()[:8]
    memo = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(b"\1\1\0\0\0"), F.encode("o_orderstatus", "UTF-8"))).otherwise(F.lit(b"\0"))
    data = F.concat(F.lit(tag), le_bytes(F.col("o_orderkey") % 2, 1), F.lit(b"\2\0\0\0"), le_bytes(F.col("o_custkey"), 4), F.lit(b"\7\0\0\0"), memo)
    data = F.when(F.col("o_orderkey") % 7 == 6, data.substr(F.lit(1), F.lit(12))).otherwise(data)
    d = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), program.instruction_outcome(data, F.array(_key("o_orderkey", "k"))).alias("o"))
    of = lambda path: F.get_json_object("o.payload", f"$.args.{path}")
    return d.select("id", "o.outcome", "o.kind", of("side").alias("side"), of("prices").alias("prices"), of("memo").alias("memo"), F.get_json_object("o.payload", "$.accounts.owner").isNotNull().alias("has_owner"))


#: Readers of every shape in one layout; C's padding stands before ``b``.
SHAPES = Program(
    "shapes", "",
    accounts=(Kind("shapes", Struct((("flag", Bool()), ("word", Prefixed(Num("u8"), Bytes(True))), ("pair", Items(Num("u16", True), 2)), ("maybe", Option(Num("u32"), Num("u8"), True)), ("zero", ZeroOption(Num("u16"))),
        ("what", Enum((("Empty", None), ("Sized", Struct((("n", Num("shortU16")),)))))))), ()),),
)


@query("""
SELECT event_id AS id, event_id % 2 = 0 AS flag, event_type AS word, '[' || (event_id % 500) || ',9]' AS pair, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS BIGINT) END AS maybe, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 5 AS BIGINT) END AS zero,
       CASE WHEN event_id % 4 = 0 THEN 'Sized' ELSE 'Empty' END AS what, CASE WHEN event_id % 4 = 0 THEN CAST(128 + event_id % 100 AS BIGINT) END AS n
FROM events
""")
def layout_readers(spark, sf_dir) -> DataFrame:
    """Booleans, prefixed text, big-endian arrays, padded and zero options, enums with fields, compact integers."""
    e = F.col("event_id")
    word = F.encode("event_type", "UTF-8")
    big = lambda n: F.reverse(F.array(n))[0]
    be16 = lambda n: F.unhex(F.lpad(F.hex(big(n)), 4, "0"))
    maybe = F.when(e % 3 == 0, F.concat(F.lit(b"\1"), le_bytes(F.col("user_id"), 4))).otherwise(F.lit(bytes(5)))
    # a compact integer from 128 on: seven bits and a mark, then the rest
    what = F.when(e % 4 == 0, F.concat(F.lit(b"\1"), le_bytes(128 + (e % 100), 1), F.lit(b"\1"))).otherwise(F.lit(b"\0"))
    data = F.concat(le_bytes((e % 2 == 0).cast("int"), 1), le_bytes(F.octet_length(word), 1), word, be16(e % 500), F.lit(b"\0\x09"), maybe, le_bytes(e % 5, 2), what)
    d = adapters.table(spark, sf_dir, "events").select(e.alias("id"), SHAPES.account_outcome(data).alias("o"))
    return d.select("id", _payload("o", "$.flag", "boolean").alias("flag"), _payload("o", "$.word").alias("word"), _payload("o", "$.pair").alias("pair"), _payload("o", "$.maybe", "bigint").alias("maybe"), _payload("o", "$.zero", "bigint").alias("zero"), _payload("o", "$.what.kind").alias("what"), _payload("o", "$.what.Sized.n", "bigint").alias("n"))


def _resolver(data: bytes, keys: list[str]) -> str | None:
    return "large" if len(data) > 9 else None


#: A resolver, an account with a fixed address and what lies beyond the declared ones.
FILLED = Program(
    "filled", "Me",
    instructions=(
        Kind("small", Struct((("n", Num("u64")),)), (Match(0, b"\7"),), (AccountSpec("user"), AccountSpec("system", address="Sys")), skip=1),
        Kind("large", Struct((("n", Num("u64")), ("m", Num("u8")))), (Match(0, b"\x08"),), (AccountSpec("user"),), skip=1, rest="others"),
    ),
    resolver=_resolver,
)


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN 'error' ELSE 'parsed' END AS outcome, CASE WHEN o_orderkey % 4 = 2 THEN 'large' ELSE 'small' END AS kind,
       CASE o_orderkey % 4 WHEN 0 THEN 'Sys' WHEN 1 THEN 'given' END AS system, CASE o_orderkey % 4 WHEN 2 THEN '["given"]' WHEN 3 THEN NULL ELSE '[]' END AS others
FROM orders
""")
def resolved_and_filled(spark, sf_dir) -> DataFrame:
    """A resolver picks the kind; a fixed address is filled in, unless the list looks shifted."""
    k = F.col("o_orderkey") % 4
    body = F.concat(F.lit(b"\7"), le_bytes(F.col("o_custkey"), 8))
    data = F.when(k == 2, F.concat(body, F.lit(b"\1"))).otherwise(body)
    keys = F.when(k == 0, F.array(F.lit("user"))).when(k == 3, F.array(F.lit("Sys"))).otherwise(F.array(F.lit("user"), F.lit("given")))
    d = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), FILLED.instruction_outcome(data, keys).alias("o"))
    rest = F.coalesce(F.get_json_object("o.payload", "$.accounts.others"), F.get_json_object("o.payload", "$.accounts.remaining_accounts"))
    return d.select("id", "o.outcome", "o.kind", _payload("o", "$.accounts.system").alias("system"), rest.alias("others"))


# --- names, keys, arithmetic, messages -----------------------------------------------------------------


@query("SELECT c_custkey AS id, sha256('o' || c_custkey) AS key, TRUE AS same FROM customer")
def base58_round_trip(spark, sf_dir) -> DataFrame:
    """Keys to base58 and back; the text has its usual length and alphabet."""
    c = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _key("c_custkey", "o").alias("k")).withColumn("t", base58("k"))
    shape = F.col("t").rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$")
    return c.select("id", _hex(unbase58("t")).alias("key"), shape.alias("same"))


@query("""
SELECT o_orderkey AS id, CAST(least(18446744073709551615::HUGEINT, 18446744073709551000::HUGEINT + o_custkey) AS VARCHAR) AS added, CAST(greatest(0, o_custkey - 700) AS VARCHAR) AS taken,
       CASE WHEN o_custkey <= 615 THEN CAST(18446744073709551000::HUGEINT + o_custkey AS VARCHAR) END AS checked
FROM orders
""")
def u64_arithmetic(spark, sf_dir) -> DataFrame:
    """Sums of unsigned 64-bit values that stop at their ends, or are null beyond them."""
    from decimal import Decimal

    near, n = F.lit(Decimal(2**64 - 616)), F.col("o_custkey")
    o = adapters.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), saturating_add(near, n).cast("string").alias("added"), saturating_sub(n, F.lit(700)).cast("string").alias("taken"), checked_add(near, n).cast("string").alias("checked"))


@query("SELECT * FROM (VALUES ('mintToChecked', 'mint_to_checked', 'MintToChecked', 'mintToChecked'), ('UserAccount', 'user_account', 'UserAccount', 'userAccount'), ('place_order', 'place_order', 'PlaceOrder', 'placeOrder')) t(name, snake, pascal, camel)")
def name_cases(spark, sf_dir) -> DataFrame:
    names = ("mintToChecked", "UserAccount", "place_order")
    return spark.createDataFrame([(n, snake(n), pascal(n), camel(n)) for n in names], "name string, snake string, pascal string, camel string")


@query("""
SELECT c_custkey AS id, lower(CASE WHEN c_custkey = 0 THEN '' ELSE '08' END || (CASE WHEN c_custkey = 0 THEN '' WHEN c_custkey < 128 THEN printf('%02x', c_custkey) WHEN c_custkey < 16384 THEN printf('%02x%02x', c_custkey % 128 + 128, c_custkey // 128) ELSE printf('%02x%02x%02x', c_custkey % 128 + 128, (c_custkey // 128) % 128 + 128, c_custkey // 16384) END)
       || '1222' || '0a20' || sha256('o' || c_custkey)) AS message
FROM customer
""")
def protobuf_messages(spark, sf_dir) -> DataFrame:
    """Decoded values as protocol-buffer messages: a number, then a key in a message of its own."""
    from slotweave.decode.ir import Key

    layout = Struct((("id", Num("u64")), ("owner", Key())))
    data = F.concat(le_bytes(F.col("c_custkey"), 8), _key("c_custkey", "o"))
    c = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), data.alias("data"))
    return c.select("id", _hex(proto.message_column(layout, F.col("data"))).alias("message"))


@query("SELECT p.name AS program, p.messages FROM (VALUES ('token', TRUE), ('token_extensions', TRUE), ('loader', TRUE), ('stake_pool', TRUE)) p(name, messages)")
def schema_texts(spark, sf_dir) -> DataFrame:
    """The schema text of each program: every kind's message is there, and each type it names is defined once."""
    import re

    def whole(p) -> bool:
        text = proto.schema_text(p)
        names = re.findall(r"^(?:message|enum) (\w+)", text, re.M)
        used = set(re.findall(r"^\s+(?:optional |repeated )?([A-Z]\w*) \w+ = ", text, re.M))
        return len(names) == len(set(names)) and used <= set(names)

    return spark.createDataFrame([(n, whole(p)) for n, p in PROGRAMS.items()], "program string, messages boolean")


@query("SELECT * FROM (VALUES ('loader', 'Program', '02000000', CAST(0 AS BIGINT)), ('stake_pool', 'DepositSol', '0e', CAST(0 AS BIGINT)), ('token', 'TransferChecked', '0c', CAST(0 AS BIGINT)), ('token_extensions', 'CpiGuard.Disable', '2201', CAST(0 AS BIGINT))) t(program, kind, bytes, place)")
def discriminator_constants(spark, sf_dir) -> DataFrame:
    """Discriminators as constants, to be used as prefilters."""
    wanted = {"loader": "Program", "stake_pool": "DepositSol", "token": "TransferChecked", "token_extensions": "CpiGuard.Disable"}
    rows = [(p, k, PROGRAMS[p].constants()[k][0].hex(), PROGRAMS[p].constants()[k][1]) for p, k in wanted.items()]
    return spark.createDataFrame(rows, "program string, kind string, bytes string, place bigint")


@query("""
SELECT event_type AS kind, count(*) AS received, count(*) FILTER (event_type = 'purchase') AS delivered, count(*) FILTER (event_type = 'purchase' AND event_id % 10 = 0) AS failed_once
FROM events GROUP BY 1
""")
def handler_results(spark, sf_dir) -> DataFrame:
    """Several handlers of parsed rows: each sees every row, and one's error doesn't keep it from the others."""
    e = adapters.table(spark, sf_dir, "events")
    out = F.when(F.col("event_type") == "purchase", dispatch.outcome("parsed", "purchase")).otherwise(dispatch.outcome("filtered"))
    d = dispatch.Registry("event_type").register(dispatch.Parser("p", "purchase", out, "topic")).dispatch(e)
    h = dispatch.handled(d, {"store": F.lit(None).cast("string"), "notify": F.when(F.col("event_id") % 10 == 0, "unreachable")})
    return h.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("outcome") == "parsed").alias("delivered"), F.count_if(F.size("handler_errors") > 0).alias("failed_once"))
