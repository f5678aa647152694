"""Protocol-buffer schemas of decoded programs, and their encoding.

Every account, argument list and event is a message; kinds are put together in one
``oneof`` per update kind. Keys and bytes are ``bytes``, small integers are widened, 128-bit
integers are 16 little-endian bytes.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from slotweave.decode import ir
from slotweave.decode.program import Program
from slotweave.functions.encoding import b58decode, pascal, snake

_SCALARS = {"u8": "uint32", "u16": "uint32", "u32": "uint32", "u64": "uint64", "shortU16": "uint32", "i8": "int32", "i16": "int32", "i32": "int32", "i64": "int64", "u128": "bytes", "i128": "bytes", "f32": "float", "f64": "double"}


class _Writer:
    def __init__(self, program: Program):
        self.program, self.messages, self.done = program, [], set()

    def field(self, node: ir.Node, owner: str, name: str) -> tuple[str, str]:
        """(label, type) of a field, writing the messages that it needs."""
        if isinstance(node, ir.Option | ir.ZeroOption):
            label, kind = self.field(node.item, owner, name)
            return (label or "optional "), kind
        if isinstance(node, ir.Items):
            label, kind = self.field(node.item, owner, name)
            if label == "repeated ":  # a list of lists needs a message between
                inner = owner + pascal(name) + "Items"
                self.message(inner, [("items", label, kind)])
                kind = inner
            return "repeated ", kind
        if isinstance(node, ir.Sized | ir.Prefixed):
            if isinstance(node.item, ir.Bytes):
                return "", "string" if node.item.text and isinstance(node, ir.Prefixed) else "bytes"
            return self.field(node.item, owner, name)
        if isinstance(node, ir.Hidden | ir.Pad):
            return self.field(node.item, owner, name)
        if isinstance(node, ir.Num):
            return "", _SCALARS[node.format]
        if isinstance(node, ir.Bool):
            return "", "bool"
        if isinstance(node, ir.Bytes):
            return "", "string" if node.text else "bytes"
        if isinstance(node, ir.Key):
            return "", "PublicKey"
        if isinstance(node, ir.Link):
            kind = pascal(node.name)
            self.type(kind, self.program.types[node.name])
            return "", kind
        kind = owner + pascal(name)
        self.type(kind, node)
        return "", kind

    def message(self, name: str, fields: list[tuple[str, str, str]]) -> None:
        if name in self.done:
            return
        self.done.add(name)
        body = [f"  {label}{kind} {snake(n)} = {i};" for i, (n, label, kind) in enumerate(fields, 1)]
        self.messages.append(f"message {name} {{\n" + "\n".join(body) + ("\n}" if body else "}"))

    def type(self, name: str, node: ir.Node) -> None:
        if name in self.done:
            return
        if isinstance(node, ir.Struct):
            self.message(name, [(n, *self.field(x, name, n)) for n, x in node.fields])
        elif isinstance(node, ir.Enum) and node.scalar:
            self.done.add(name)
            values = [f"  {snake(name).upper()}_{snake(v).upper()} = {i};" for i, (v, _) in enumerate(node.variants)]
            self.messages.append(f"enum {name} {{\n" + "\n".join(values) + "\n}")
        elif isinstance(node, ir.Enum):
            self.done.add(name)
            each = []
            for i, (v, x) in enumerate(node.variants, 1):
                kind = name + pascal(v)
                self.type(kind, x or ir.Struct(()))
                each.append(f"    {kind} {snake(v)} = {i};")
            self.messages.append(f"message {name} {{\n  oneof kind {{\n" + "\n".join(each) + "\n  }\n}")
        elif isinstance(node, ir.Hidden | ir.Pad | ir.Sized | ir.Prefixed) and not isinstance(node.item, ir.Bytes):
            self.type(name, node.item)
        else:
            self.message(name, [("value", *self.field(node, name, "value"))])


def schema_text(program: Program) -> str:
    """The ``.proto`` text of all of a program's outputs."""
    w = _Writer(program)
    w.message("PublicKey", [("value", "", "bytes")])
    groups = []
    for what, kinds in (("Account", program.accounts), ("Instruction", program.instructions), ("Event", program.events)):
        each = []
        for i, k in enumerate(kinds, 1):
            kind = pascal(k.name) + ("" if what == "Account" else what)
            if what == "Instruction":
                w.message(kind + "Accounts", [*((a.name, "optional " if a.optional else "", "PublicKey") for a in k.accounts), (k.rest, "repeated ", "PublicKey")])
                w.type(kind + "Args", k.layout)
                w.message(kind, [("accounts", "", kind + "Accounts"), ("args", "", kind + "Args")])
            else:
                w.type(kind, k.layout)
            each.append(f"    {kind} {snake(k.name)} = {i};")
        if each:
            groups.append(f"message Program{what} {{\n  oneof kind {{\n" + "\n".join(each) + "\n  }\n}")
    return f'syntax = "proto3";\n\npackage {snake(program.name)};\n\n' + "\n\n".join([*w.messages, *groups]) + "\n"


def message_column(layout: ir.Struct, data, types: dict[str, ir.Node] | None = None):
    """A Column of the messages of binary values, by Arrow batches; null where a value can't be read."""
    known = types or {}

    def one(x) -> bytes | None:
        try:
            return None if x is None else encode(layout, layout.read(bytes(x), 0, known)[0], known)
        except ir.DecodeError:
            return None

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run(data)


# --- encoding --------------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        b, n = n & 0x7F, n >> 7
        out.append(b | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _tagged(number: int, wire: int, body: bytes) -> bytes:
    return _varint(number << 3 | wire) + (_varint(len(body)) + body if wire == 2 else body)


def encode(node: ir.Node, value, types: dict[str, ir.Node]) -> bytes:
    """A message's bytes from a decoded value; fields at their default are left out."""
    while isinstance(node, ir.Link | ir.Hidden | ir.Pad):
        node = types[node.name] if isinstance(node, ir.Link) else node.item
    if isinstance(node, ir.Struct):
        return b"".join(field(i, x, value[n], types) for i, (n, x) in enumerate(node.fields, 1))
    if isinstance(node, ir.Enum) and not node.scalar:
        i = next(k for k, (n, _) in enumerate(node.variants) if n == value["kind"])
        return _tagged(i + 1, 2, encode(node.variants[i][1] or ir.Struct(()), value.get(value["kind"], {}), types))
    return field(1, node, value, types)


def field(number: int, node: ir.Node, value, types: dict[str, ir.Node], shown: bool = False) -> bytes:
    """``shown``: written even at its default, as in lists and options."""
    if isinstance(node, ir.Link):
        return field(number, types[node.name], value, types, shown)
    if isinstance(node, ir.Hidden | ir.Pad):
        return field(number, node.item, value, types, shown)
    if isinstance(node, ir.Option | ir.ZeroOption):
        return b"" if value is None else field(number, node.item, value, types, True)
    if isinstance(node, ir.Items):
        if isinstance(node.item, ir.Num | ir.Bool) and getattr(node.item, "format", "u8") not in ("u128", "i128"):
            body = b"".join(_scalar(node.item, v)[1] for v in value)  # numbers are packed
            return _tagged(number, 2, body) if value else b""
        return b"".join(field(number, node.item, v, types, True) for v in value)
    if isinstance(node, ir.Sized | ir.Prefixed) and not isinstance(node.item, ir.Bytes):
        return field(number, node.item, value, types, shown)
    if isinstance(node, ir.Key):
        return _tagged(number, 2, _tagged(1, 2, b58decode(value)))
    if isinstance(node, ir.Sized | ir.Prefixed | ir.Bytes):
        text = isinstance(node, ir.Bytes) and node.text or isinstance(node, ir.Prefixed) and node.item.text
        body = value.encode() if text else bytes.fromhex(value)
        return _tagged(number, 2, body) if body or shown else b""
    if isinstance(node, ir.Num | ir.Bool):
        wire, body = _scalar(node, value)
        return _tagged(number, wire, body) if shown or any(body.lstrip(b"\0") if wire == 2 else body) else b""
    if isinstance(node, ir.Enum) and node.scalar:
        i = next(k for k, (n, _) in enumerate(node.variants) if n == value)
        return _tagged(number, 0, _varint(i)) if i or shown else b""
    return _tagged(number, 2, encode(node, value, types))


def _scalar(node: ir.Num | ir.Bool, value) -> tuple[int, bytes]:
    if isinstance(node, ir.Bool):
        return 0, _varint(int(value))
    if node.format in ("f32", "f64"):
        return (5, struct.pack("<f", value)) if node.format == "f32" else (1, struct.pack("<d", value))
    if node.format in ("u128", "i128"):
        return 2, int(value).to_bytes(16, "little", signed=node.format == "i128")
    return 0, _varint(int(value))
