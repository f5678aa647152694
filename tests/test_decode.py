"""Byte readers, interface files, built-in programs, events."""

import base64
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from slotweave.decode import idl
from slotweave.decode.builtin import LOADER, PROGRAMS, STAKE_POOL, TOKEN, TOKEN_EXTENSIONS
from slotweave.decode.ir import Bool, Bytes, DecodeError, Enum, Hidden, Items, Key, Link, Map, Num, Option, Prefixed, Sized, Struct, Tuple, ZeroOption
from slotweave.decode.program import AccountSpec, Kind, Match, Program, log_payloads, merged_events
from slotweave.functions import encoding as enc

U8, U32 = Num("u8"), Num("u32")


@pytest.mark.parametrize(
    "node,data,want",
    [
        (Num("u16"), b"\1\2", 513), (Num("u16", True), b"\1\2", 258), (Num("i8"), b"\xff", -1), (Num("u64"), b"\xff" * 8, 2**64 - 1), (Num("u128"), b"\xff" * 16, str(2**128 - 1)),
        (Num("i128"), b"\xff" * 16, "-1"), (Num("f64"), struct.pack("<d", 1.5), 1.5), (Num("shortU16"), b"\x80\x01", 128), (Bool(), b"\1", True), (Prefixed(U32, Bytes(True)), b"\2\0\0\0hi", "hi"),
        (Prefixed(U8, Bytes()), b"\2hi", "6869"), (Sized(3, Bytes(True)), b"abc", "616263"), (Key(), bytes(32), "1" * 32), (Option(U8), b"\0", None), (Option(U8), b"\1\7", 7),
        (Option(U8, U32, True), b"\0\0\0\0\0", None), (Option(U8, None), b"", None), (ZeroOption(Num("u16")), b"\0\0", None), (Items(U8, 2), b"\1\2", [1, 2]), (Items(U8, U8), b"\2\5\6", [5, 6]),
        (Items(U8, None), b"\1\2\3", [1, 2, 3]), (Map(U8, U8, U8), b"\1\5\6", [{"key": 5, "value": 6}]), (Tuple([U8, U8]), b"\1\2", {"item_0": 1, "item_1": 2}),
        (Enum((("a", None), ("b", None))), b"\1", "b"), (Enum((("a", None), ("b", Struct((("x", U8),))))), b"\1\7", {"kind": "b", "b": {"x": 7}}), (Hidden(U8, b"zz"), b"zz\4", 4),
    ],
)
def test_readers(node, data, want):
    value, end = node.read(data, 0, {})
    assert (value, end) == (want, len(data))
    if data:
        for cut in range(len(data)):  # nothing cut short is read as whole, but for what takes the rest
            try:
                node.read(data[:cut], 0, {})
            except DecodeError:
                continue
            assert isinstance(node, Items | Option)


@pytest.mark.parametrize(
    "node,data",
    [(Bool(), b"\2"), (Option(U8), b"\2\1"), (Enum((("a", None),)), b"\1"), (Num("shortU16"), b"\x80\x00"), (Num("shortU16"), b"\xff\xff\x7f"), (Prefixed(U8, Bytes(True)), b"\1\xff"), (Items(U8, U32), b"\xff\xff\xff\xff"), (Hidden(U8, b"zz"), b"zx\4"), (Link("x"), b"")],
)
def test_malformed(node, data):
    with pytest.raises(DecodeError):
        node.read(data, 0, {})


def test_numbers_round_trip():
    rng = random.Random(3)
    for f in ("u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64"):
        for big in (False, True):
            n = Num(f, big)
            low = -(1 << (8 * n.width - 1)) if f[0] == "i" else 0
            for _ in range(20):
                v = rng.randrange(low, low + (1 << (8 * n.width)))
                assert n.read(n.pack(v), 0, {})[0] == v


def test_recursive_types_are_refused():
    with pytest.raises(DecodeError):
        Link("a").spark({"a": Struct((("x", Link("a")),))})


def test_base58_and_names():
    rng = random.Random(1)
    for n in (0, 1, 5, 32, 64):
        data = bytes(2) + rng.randbytes(n)
        assert enc.b58decode(enc.b58encode(data)) == data
    assert enc.snake("mintToChecked") == "mint_to_checked" and enc.pascal("mint_to_checked") == "MintToChecked" and enc.camel("MintToChecked") == "mintToChecked"
    assert enc.discriminator("global", "initialize").hex() == "afaf6d1f0d989bed"
    assert enc.zigzag_varint(-1) == b"\1" and enc.zigzag_varint(150) == b"\xac\x02"


def test_columns(spark):
    df = spark.createDataFrame([(bytes([1, 2, 3, 4, 255, 255, 255, 255, 255, 255, 255, 255]),)], "d binary")
    r = df.select(enc.uint("d", 0, 2), enc.uint("d", 0, 2, True), enc.uint("d", 4, 8), enc.sint("d", 4, 8), enc.sint("d", 4, 1), enc.uint("d", 9, 8), enc.base58(F.col("d"))).first()
    assert [str(x) for x in r][:6] == ["513", "258", str(2**64 - 1), "-1", "-1", "None"]
    assert r[6] == enc.b58encode(bytes([1, 2, 3, 4] + [255] * 8))


NODES = {
    "kind": "rootNode", "standard": "codama", "program": {
        "name": "shop", "publicKey": "Shop111",
        "accounts": [{"name": "till", "data": {"kind": "structTypeNode", "fields": [
            {"name": "tag", "type": {"kind": "numberTypeNode", "format": "u16", "endian": "le"}}, {"name": "sum", "type": {"kind": "numberTypeNode", "format": "u64", "endian": "le"}}]},
            "discriminators": [{"kind": "constantDiscriminatorNode", "offset": 0, "constant": {"kind": "constantValueNode", "type": {"kind": "numberTypeNode", "format": "u16", "endian": "le"}, "value": {"kind": "numberValueNode", "number": 513}}}]}],
        "instructions": [
            {"name": n, "accounts": [{"name": f"a{i}"} for i in range(k)], "arguments": [{"name": "tag", "defaultValueStrategy": "omitted", "type": {"kind": "numberTypeNode", "format": "u8", "endian": "le"}, "defaultValue": {"kind": "numberValueNode", "number": 7}}],
             "discriminators": [{"kind": "fieldDiscriminatorNode", "name": "tag", "offset": 0}]} for n, k in (("small", 1), ("large", 3))],
        "definedTypes": [],
    },
}


def test_node_tree():
    p = idl.load(json.dumps(NODES))
    assert p.account(b"\1\2" + (9).to_bytes(8, "little")) == ("parsed", "till", {"tag": 513, "sum": 9}, None)
    assert p.account(b"\1\2\0")[0] == "error" and p.account(b"zz")[3] == "no discriminator matches"
    assert p.instruction(b"\7", ["x"])[1] == "small" and p.instruction(b"\7", list("xyzw"))[1] == "large"
    assert p.instruction(b"\7", list("xyzw"))[2]["accounts"]["remaining_accounts"] == ["w"]
    assert p.instruction(b"\7", [])[0] == "error"
    assert p.constants()["till"] == (b"\1\2", 0)
    assert p.schema("till").simpleString() == "struct<tag:int,sum:decimal(20,0)>"


def test_ambiguity_is_an_error():
    same = (Match(0, b"\1"),)
    p = Program("p", "", instructions=(Kind("a", Struct(()), same, (AccountSpec("x"),)), Kind("b", Struct(()), same, (AccountSpec("y"),))))
    assert p.instruction(b"\1", ["k"])[3].startswith("ambiguous")


def test_fixed_addresses():
    def program(*accounts):
        return Program("p", "Me", instructions=(Kind("a", Struct(()), (Match(0, b"\1"),), accounts),))

    x, sys, opt, rent = AccountSpec("x"), AccountSpec("sys", address="S"), AccountSpec("opt", True), AccountSpec("rent", address="R")
    p = program(x, sys)
    assert p.instruction(b"\1", ["k"])[2]["accounts"] == {"x": "k", "sys": "S", "remaining_accounts": []}
    # S stands where x should: x was left out, so nothing may be filled in
    assert p.instruction(b"\1", ["S"]) == ("error", "a", None, "the accounts are shifted")
    assert p.instruction(b"\1", ["k", "T"])[2]["accounts"]["sys"] == "T"  # in a full list, addresses are as they come
    assert p.instruction(b"\1", [])[3].startswith("too few")
    q = program(sys, x, rent)
    assert q.instruction(b"\1", ["S", "k"])[2]["accounts"]["rent"] == "R"
    assert q.instruction(b"\1", ["T", "k"])[3] == "the accounts are shifted"  # the one that is there differs
    assert q.instruction(b"\1", ["S", "R"])[3] == "the accounts are shifted"
    assert program(x, opt, rent).instruction(b"\1", ["k"])[3] == "the accounts are shifted"  # an optional one before is missing
    got = program(x, opt, rent).instruction(b"\1", ["k", "Me"])[2]["accounts"]
    assert got == {"x": "k", "opt": None, "rent": "R", "remaining_accounts": []}  # the program itself: not given


ANCHOR = {
    "address": "Dex1", "metadata": {"name": "my_dex", "spec": "0.1.0"},
    "instructions": [{"name": "swap", "discriminator": [1] * 8, "accounts": [{"name": "user"}], "args": [{"name": "amount_in", "type": "u64"}, {"name": "p", "type": {"defined": {"name": "Pair", "generics": [{"kind": "type", "type": "u8"}, {"kind": "const", "value": " +2 x"}]}}}]}],
    "accounts": [{"name": "Pool", "discriminator": [2] * 8}], "events": [{"name": "Swapped", "discriminator": [3] * 8}],
    "types": [
        {"name": "Pool", "type": {"kind": "struct", "fields": [{"name": "owner", "type": "pubkey"}, {"name": "fee", "type": {"option": "u16"}}]}},
        {"name": "Swapped", "type": {"kind": "struct", "fields": [{"name": "side", "type": {"defined": {"name": "Side"}}}]}},
        {"name": "Side", "type": {"kind": "enum", "variants": [{"name": "Buy"}, {"name": "Sell"}]}},
        {"name": "Pair", "generics": [{"kind": "type", "name": "T"}, {"kind": "const", "name": "N", "type": "usize"}], "type": {"kind": "struct", "fields": [{"name": "left", "type": {"generic": "T"}}, {"name": "rest", "type": {"array": ["u16", {"generic": "N"}]}}]}},
    ],
}


def test_anchor():
    p = idl.load(ANCHOR)
    data = b"\1" * 8 + (5).to_bytes(8, "little") + b"\7\1\0\2\0"
    assert p.instruction(data, ["u"]) == ("parsed", "swap", {"accounts": {"user": "u", "remaining_accounts": []}, "args": {"amountIn": 5, "p": {"left": 7, "rest": [1, 2]}}}, None)
    assert p.account(b"\2" * 8 + bytes(32) + b"\0")[2] == {"owner": "1" * 32, "fee": None}
    assert p.event(b"\3" * 8 + b"\1") == ("swapped", {"side": "sell"})
    assert p.instruction(p.envelope[0] + b"\3" * 8 + b"\1", []) == ("filtered", None, None, None)
    with pytest.raises(idl.IdlError, match="begins with"):
        idl.load({**ANCHOR, "events": ANCHOR["events"] * 2})
    with pytest.raises(idl.IdlError, match="no such type"):
        idl.load({**ANCHOR, "types": [{"name": "X", "type": {"kind": "struct", "fields": [{"name": "f", "type": "u7"}]}}]})


def test_events_merge_one_to_one():
    p = idl.load(ANCHOR)
    p.address = "P"
    event, wrapped = b"\3" * 8 + b"\1", p.envelope[0] + b"\3" * 8 + b"\1"
    line = "Program data: " + base64.b64encode(event).decode()
    logs = ["Program P invoke [1]", line, "Program Q invoke [2]", line, "Program Q success", "Program data: !!", line, "Program P success", line]
    assert len(log_payloads(logs, "P")) == 2 and len(log_payloads(logs, "Q")) == 1
    assert len(merged_events(p, [wrapped], logs)) == 2  # one of both ways, one of the log alone
    assert len(merged_events(p, [wrapped] * 3, logs)) == 3
    assert len(merged_events(p, [], logs)) == 2


def test_event_tag_collision():
    with pytest.raises(ValueError, match="collides"):
        idl.load({**ANCHOR, "instructions": [{"name": "x", "discriminator": list(bytes.fromhex("e445a52e51cb9a1d")), "accounts": [], "args": []}]})


def test_token_program():
    keys = list("abcdef")
    assert TOKEN.instruction(b"\3" + (9).to_bytes(8, "little"), keys)[2] == {"accounts": {"source": "a", "destination": "b", "owner": "c", "multisig_signers": ["d", "e", "f"]}, "args": {"amount": 9}}
    assert TOKEN.instruction(b"\3\1", keys)[0] == "error" and TOKEN.instruction(b"\x63", keys)[0] == "error" and TOKEN.instruction(b"", keys)[0] == "error"
    assert TOKEN.account(bytes(82))[1] == "Mint" and TOKEN.account(bytes(83))[0] == "filtered"
    inner = b"\7" + (1).to_bytes(8, "little")
    batch = TOKEN.instruction(b"\xff" + bytes([3, len(inner)]) + inner + bytes([0, 1]) + b"\x63", keys)[2]
    assert [i and i["kind"] for i in batch["instructions"]] == ["MintTo", None] and batch["remaining_accounts"] == ["d", "e", "f"]
    assert TOKEN.instruction(b"\xff\x09\x01\x03", keys)[0] == "error"


def test_extensions():
    base = bytearray(TOKEN_EXTENSIONS.BASE) + b"\1"
    tlv = b"\x03\0\x20\0" + b"\1" * 32 + b"\x63\0\1\0z" + bytes(8)
    state, kind, value, _ = TOKEN_EXTENSIONS.account(bytes(base) + tlv)
    assert (state, kind) == ("parsed", "ExtendedMint") and [e["name"] for e in value["extensions"]] == ["MintCloseAuthority", None]
    assert TOKEN_EXTENSIONS.account(bytes(base) + b"\3\0\xff\0")[0] == "error"
    fee = b"\x1a\1" + (5).to_bytes(8, "little") + b"\2" + (1).to_bytes(8, "little")
    assert TOKEN_EXTENSIONS.instruction(fee, list("abcd"))[1] == "TransferFee.TransferCheckedWithFee"
    assert TOKEN_EXTENSIONS.instruction(b"\x22\0", list("ab"))[1] == "CpiGuard.Enable"


def test_extension_arguments():
    import hashlib

    keys = list("abcde")
    args = lambda data: TOKEN_EXTENSIONS.instruction(data, keys)[2]["args"]
    tag = lambda name: hashlib.sha256(name.encode()).digest()[:8]
    text = lambda x: len(x).to_bytes(4, "little") + x
    assert args(b"\x21\0" + bytes(32) + b"\xfe\xff") == {"rate_authority": None, "rate": -2} and args(b"\x1c\1\2") == {"state": "Frozen"}
    assert args(b"\x24\1" + b"\1" * 32) == {"program_id": enc.b58encode(b"\1" * 32)} and args(b"\x22\0") == {}
    assert args(tag("spl_token_metadata_interface:updating_field") + b"\3" + text(b"k") + text(b"v")) == {"field": {"kind": "Key", "Key": "k"}, "value": "v"}
    assert args(tag("spl_token_metadata_interface:emitter") + b"\1" + (5).to_bytes(8, "little") + b"\0") == {"start": 5, "end": None}
    assert args(b"\x1b\x05" + (9).to_bytes(8, "little") + b"\6") == {"amount": 9, "decimals": 6}
    assert args(b"\x25\1\xff" + b"\2" * 36) == {"proof_instruction_offset": -1, "new_decryptable_available_balance": "02" * 36}
    assert TOKEN_EXTENSIONS.instruction(b"\x1b\x05\1", keys)[0] == "error"


def test_other_programs():
    assert LOADER.account(bytes(8))[0] == "filtered" and LOADER.account(b"\2\0\0\0" + bytes(32))[1] == "Program"
    assert LOADER.instruction(b"\4\0\0\0", ["a", "b"])[2]["accounts"] == {"account": "a", "current_authority": "b", "new_authority": None, "remaining_accounts": []}
    assert STAKE_POOL.account(b"\0")[0] == "error" and STAKE_POOL.account(b"\2" + bytes(8))[2] == {"max_validators": 0, "validators": []}
    assert STAKE_POOL.instruction(b"\x0e" + (7).to_bytes(8, "little"), [str(i) for i in range(10)])[2]["args"] == {"amount": 7}


def test_random_bytes_never_raise():
    rng = random.Random(5)
    for p in PROGRAMS.values():
        for k in p.instructions:
            for _ in range(5):
                p.instruction(k.match[0].value + rng.randbytes(rng.randrange(80)), [str(i) for i in range(rng.randrange(20))])
        for _ in range(200):
            p.account(rng.randbytes(rng.choice([0, 1, 36, 82, 165, 166, 170, 300, 355])))


def test_outcomes_as_columns(spark):
    data = [(b"\3" + (2**64 - 1).to_bytes(8, "little"), [b"\1" * 32] * 3), (b"\3", [b"\1" * 32] * 3), (None, None)]
    df = spark.createDataFrame(data, "data binary, keys array<binary>")
    out = df.select(TOKEN.instruction_outcome(F.col("data"), F.col("keys")).alias("o")).select("o.*")
    assert [r.outcome for r in out.collect()] == ["parsed", "error", "error"]
    typed = TOKEN.typed(out, "Transfer").where("outcome = 'parsed'").select("value.args.amount", "value.accounts.owner").first()
    assert int(typed[0]) == 2**64 - 1 and typed[1] == enc.b58encode(b"\1" * 32)
    kinds = df.where("data is not null").select(TOKEN.instruction_kind(F.col("data"))).collect()
    assert [r[0] for r in kinds] == ["Transfer", "Transfer"]


def test_compiled_layouts_equal_the_readers(spark):
    """Every kind with a fixed layout, over whole, cut and random bytes: Columns and Python readers agree."""
    from slotweave.decode.columns import NotFixed

    rng, done = random.Random(11), 0
    plain = lambda v: {k: plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else enc.b58encode(bytes(v)) if isinstance(v, bytes | bytearray) else int(v) if type(v).__name__ == "Decimal" else v
    some = {TOKEN: ("Transfer", "InitializeMint", "SetAuthority", "Revoke"), LOADER: ("Upgrade", "SetAuthority", "ExtendProgram"), STAKE_POOL: ("SetPreferredValidator",)}
    for program, names in some.items():
        rows = []
        for k in program.instructions:
            if k.name in names:
                size = k.layout.size(program.types) or 40
                for n in sorted({0, 1, size, size + 3}):
                    for _ in range(4):
                        body = bytes(rng.choice([0, 1, 2, rng.randrange(256)]) for _ in range(n))
                        keys = [bytes([rng.randrange(256)]) * 32 for _ in range(rng.choice([0, k.required, k.required + 2, 12]))]
                        rows.append((len(rows), k.match[0].value + body, keys))
        df = spark.createDataFrame(rows, "i int, d binary, keys array<binary>")
        got = {(n, r.i): r.v for n in names for r in df.select("i", program.instruction_fields(n, F.col("d"), F.col("keys")).alias("v")).collect()}
        for i, d, keys in rows:
            state, kind, value, _ = program.instruction(d, [enc.b58encode(x) for x in keys])
            found = {n: plain(got[n, i]) for n in names if got[n, i] is not None}
            if state == "parsed":
                args = value["args"]
                assert found == {kind: {"accounts": value["accounts"]} | ({"args": args} if args else {})}, (program.name, kind, d.hex())
                done += 1
            else:
                assert not found, (program.name, kind, d.hex())
    assert done > 40
    with pytest.raises(NotFixed):
        TOKEN.instruction_fields("InitializeMultisig", F.col("d"), F.col("keys"))
    accounts = [(0, bytes(82)), (1, bytes(45) + b"\1" + bytes(36)), (2, rng.randbytes(165)), (3, b"\1\0\0\0" + bytes(range(161))), (4, bytes(81)), (5, b"\1" + bytes(354))]
    df = spark.createDataFrame(accounts, "i int, d binary")
    for name in ("Mint", "TokenAccount", "Multisig"):
        for r in df.select("i", TOKEN.account_fields(name, F.col("d")).alias("v")).collect():
            state, kind, value, _ = TOKEN.account(accounts[r.i][1])
            assert plain(r.v) == (value if (state, kind) == ("parsed", name) else None)


def test_choice_by_accounts_in_columns(spark):
    p = idl.load(json.dumps(NODES))
    same = (Match(0, b"\1"),)
    q = Program("q", "", instructions=(Kind("a", Struct(()), same, (AccountSpec("x"),)), Kind("b", Struct(()), same, (AccountSpec("y"),))))
    df = spark.createDataFrame([(b"\7", 0), (b"\7", 1), (b"\7", 4), (b"\1", 1), (b"zz", 1)], "d binary, n int")
    got = [tuple(r) for r in df.select(p.instruction_choice(F.col("d"), F.col("n")).alias("c")).select("c.*").collect()]
    assert got == [("small", "too few accounts"), ("small", None), ("large", None), (None, "no discriminator matches"), (None, "no discriminator matches")]
    assert df.select(q.instruction_choice(F.col("d"), F.col("n"))["error"]).collect()[3][0] == "ambiguous instruction: a, b"


def test_checked_and_saturating(spark):
    from decimal import Decimal

    top = Decimal(2**64 - 1)
    df = spark.createDataFrame([(top, Decimal(1)), (Decimal(3), Decimal(5))], "a decimal(20,0), b decimal(20,0)")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(enc.saturating_add(a, b), enc.saturating_sub(a, b), enc.checked_add(a, b)).collect()]
    assert got == [(top, top - 1, None), (8, 0, 8)]
    n = spark.createDataFrame([(0,), (258,), (2**31,)], "n bigint")
    assert [bytes(r[0]) for r in n.select(enc.le_bytes(F.col("n"), 8)).collect()] == [x.to_bytes(8, "little") for x in (0, 258, 2**31)]


def test_c_layout():
    def program(**more):
        fields = [{"name": "a", "type": "u8"}, {"name": "b", "type": "u64"}, {"name": "k", "type": "pubkey"}, {"name": "c", "type": "u16"}]
        t = {"name": "Pool", "serialization": "bytemuck", "repr": {"kind": "c"}, "type": {"kind": "struct", "fields": fields}} | more
        return idl.load({**ANCHOR, "instructions": [], "events": [], "types": [t]})

    body = b"\5" + bytes(7) + (9).to_bytes(8, "little") + bytes(32) + b"\7\0" + bytes(6)
    want = {"a": 5, "b": 9, "k": "1" * 32, "c": 7}
    assert program().account(b"\2" * 8 + body)[2] == want
    assert program().account(b"\2" * 8 + body[:-1])[0] == "error"
    packed = body[:1] + body[8:-6]
    assert program(repr={"kind": "c", "packed": True}).account(b"\2" * 8 + packed)[2] == want
    with pytest.raises(idl.IdlError, match="no known places"):
        program(repr={"kind": "rust"})
    with pytest.raises(idl.IdlError, match="no fixed size"):
        program(type={"kind": "struct", "fields": [{"name": "v", "type": {"vec": "u8"}}]})


def test_resolver():
    p = idl.load(json.dumps(NODES))
    p.resolver = lambda data, keys: "large" if data == b"zz" else None
    assert p.instruction(b"\7", ["x"])[1] == "small" and p.instruction(b"zz", list("abc"))[1] == "large"


def test_held_rows_are_made_once(spark):
    """A filter on an outcome or on compiled fields isn't pushed below what makes them, which would make them twice."""
    from slotweave.decode import columns

    token = PROGRAMS["token"]
    df = spark.createDataFrame([(b"\x03" + (7).to_bytes(8, "little"), ["a", "b", "c"]), (b"\x63", ["a"]), (None, None), (b"\x05", ["a", None])], "d binary, k array<string>")
    every = df.select("d", token.instruction_outcome(F.col("d"), F.col("k")).alias("o"))
    assert [(r.o.outcome, r.o.kind, r.o.error) for r in every.collect()] == [("parsed", "Transfer", None), ("error", None, "no discriminator matches"), ("error", None, "no data"), ("parsed", "Revoke", None)]
    out = columns.held(every, "o", lambda o: o["outcome"] == "parsed")
    assert out.columns == every.columns and [r.o.kind for r in out.collect()] == ["Transfer", "Revoke"]
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_token_account_columns_hash_once(spark, tmp_path):
    """The filter on the fields repeats nothing of what made the bytes."""
    from slotweave.plans.programs import token_account_columns

    spark.createDataFrame([(1, 2, 1.5), (3, 4, 2.5)], "c_custkey bigint, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    out = token_account_columns(spark, str(tmp_path))
    assert [(r.id, r.amount, r.state) for r in out.collect()] == [(1, "150", "Initialized")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 2
