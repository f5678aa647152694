"""Programs from interface description files: node trees (Codama) and Anchor's own format."""

from __future__ import annotations

import base64
import json
import re

from slotweave.decode import ir
from slotweave.decode.program import EVENT_TAG, AccountSpec, Kind, Match, Program
from slotweave.functions.encoding import b58decode, camel, discriminator, snake

MAX_DEPTH, MAX_NODES, MAX_FIXED = 128, 100_000, 10 * 1024 * 1024


class IdlError(ValueError):
    """``at``: the path in the file."""

    def __init__(self, at: str, why: str):
        super().__init__(f"{at}: {why}")
        self.at = at


def load(source: str | dict) -> Program:
    """A program from a parsed file or its JSON text, whichever format it is in."""
    doc = json.loads(source) if isinstance(source, str) else source
    if doc.get("kind") == "rootNode" or doc.get("standard") == "codama":
        return from_nodes(doc)
    return from_anchor(doc)


# --- node trees --------------------------------------------------------------------------------


class _Nodes:
    def __init__(self, at: str):
        self.at, self.count = at, 0

    def type(self, n: dict, at: str, depth: int = 0) -> ir.Node:
        self.count += 1
        if depth > MAX_DEPTH:
            raise IdlError(at, f"types are nested deeper than {MAX_DEPTH}")
        if self.count > MAX_NODES:
            raise IdlError(at, f"more than {MAX_NODES} nodes")
        kind = n.get("kind")
        go = lambda key: self.type(n[key], f"{at}.{key}", depth + 1)
        if kind == "numberTypeNode":
            return ir.Num(n["format"], n.get("endian") == "be")
        if kind == "booleanTypeNode":
            return ir.Bool(self.number(n.get("size"), at))
        if kind in ("bytesTypeNode", "stringTypeNode"):
            return ir.Bytes(kind == "stringTypeNode")
        if kind == "publicKeyTypeNode":
            return ir.Key()
        if kind == "fixedSizeTypeNode":
            if n["size"] > MAX_FIXED:
                raise IdlError(at, f"a fixed size above {MAX_FIXED}")
            return ir.Sized(n["size"], go("type"))
        if kind == "sizePrefixTypeNode":
            return ir.Prefixed(self.number(n["prefix"], at), go("type"))
        if kind == "optionTypeNode":
            return ir.Option(go("item"), self.number(n.get("prefix"), at), bool(n.get("fixed")))
        if kind == "remainderOptionTypeNode":
            return ir.Option(go("item"), None)
        if kind == "zeroableOptionTypeNode":
            return ir.ZeroOption(go("item"))
        if kind in ("arrayTypeNode", "setTypeNode"):
            return ir.Items(go("item"), self.counted(n["count"], at))
        if kind == "mapTypeNode":
            return ir.Map(go("key"), go("value"), self.counted(n["count"], at))
        if kind == "structTypeNode":
            return self.struct(n["fields"], at, depth)
        if kind == "tupleTypeNode":
            return ir.Tuple([self.type(x, f"{at}.items[{i}]", depth + 1) for i, x in enumerate(n["items"])])
        if kind == "enumTypeNode":
            return ir.Enum(tuple(self.variant(v, at, depth) for v in n["variants"]), self.number(n.get("size"), at))
        if kind == "definedTypeLinkNode":
            return ir.Link(n["name"])
        if kind in ("amountTypeNode", "dateTimeTypeNode", "solAmountTypeNode"):
            return go("number")
        if kind in ("hiddenPrefixTypeNode", "hiddenSuffixTypeNode"):
            key = "prefix" if kind == "hiddenPrefixTypeNode" else "suffix"
            constant = b"".join(self.constant(c, at) for c in n[key])
            return ir.Hidden(go("type"), constant, key == "suffix")
        raise IdlError(at, f"no such type: {kind}")

    def number(self, n: dict | None, at: str) -> ir.Num:
        if n is None:
            return ir.Num("u8")
        x = self.type(n, at)
        if not isinstance(x, ir.Num):
            raise IdlError(at, "a number is wanted")
        return x

    def counted(self, n: dict, at: str):
        if n["kind"] == "fixedCountNode":
            return n["value"]
        return self.number(n["prefix"], at) if n["kind"] == "prefixedCountNode" else None

    def struct(self, fields: list[dict], at: str, depth: int = 0) -> ir.Struct:
        return ir.Struct(tuple((f["name"], self.type(f["type"], f"{at}.{f['name']}", depth + 1)) for f in fields))

    def variant(self, v: dict, at: str, depth: int):
        if v["kind"] == "enumEmptyVariantTypeNode":
            return v["name"], None
        inner = v.get("struct") or v.get("tuple")
        return v["name"], self.type(inner, f"{at}.{v['name']}", depth + 1)

    def constant(self, c: dict, at: str) -> bytes:
        """Bytes of a constant: its type's encoding of its value."""
        return self.value(c["type"], c["value"], at) if c.get("kind") == "constantValueNode" else self.value(None, c, at)

    def value(self, type_: dict | None, v: dict, at: str) -> bytes:
        kind = v["kind"]
        if kind == "bytesValueNode":
            text, how = v["data"], v["encoding"]
            try:
                raw = {"base16": bytes.fromhex, "base58": b58decode, "base64": base64.b64decode, "utf8": str.encode}[how](text)
            except ValueError as e:
                raise IdlError(at, str(e)) from e
            return self._padded(type_, raw)
        if kind == "numberValueNode":
            try:
                return self.number(type_, at).pack(v["number"])
            except ir.DecodeError as e:
                raise IdlError(at, str(e)) from e
        if kind == "publicKeyValueNode":
            return b58decode(v["publicKey"])
        if kind == "booleanValueNode":
            return bytes([v["boolean"]])
        if kind == "stringValueNode":
            return self._padded(type_, v["string"].encode())
        raise IdlError(at, f"no such value: {kind}")

    def _padded(self, type_: dict | None, raw: bytes) -> bytes:
        if type_ and type_.get("kind") == "fixedSizeTypeNode":
            return raw[: type_["size"]].ljust(type_["size"], b"\0")
        if type_ and type_.get("kind") == "sizePrefixTypeNode":
            return self.number(type_["prefix"], "prefix").pack(len(raw)) + raw
        return raw

    def matches(self, item: dict, fields: list[dict], at: str) -> tuple[Match, ...]:
        out = []
        for d in item.get("discriminators") or []:
            where = f"{at}.discriminators"
            if d["kind"] == "sizeDiscriminatorNode":
                out.append(Match(size=d["size"]))
            elif d["kind"] == "constantDiscriminatorNode":
                out.append(Match(d["offset"], self.constant(d["constant"], where)))
            else:
                f = next((x for x in fields if x["name"] == d["name"]), None)
                if f is None or "defaultValue" not in f:
                    raise IdlError(where, f"field {d['name']} has no value to match")
                out.append(Match(d["offset"], self.value(f["type"], f["defaultValue"], where)))
        return tuple(out)


def from_nodes(doc: dict) -> Program:
    p = doc["program"]
    b = _Nodes("program")
    types = {t["name"]: b.type(t["type"], f"definedTypes.{t['name']}") for t in p.get("definedTypes") or []}
    # accounts and events may be linked to like types
    for x in (*(p.get("accounts") or []), *(p.get("events") or [])):
        types.setdefault(x["name"], b.type(x["data"], x["name"]))

    def data_kind(x: dict, at: str) -> Kind:
        node = x["data"]
        fields = _fields(node)
        match = b.matches(x, fields, at)
        layout = b.type(node, at)
        # constants that no field holds stand before the layout: those in front of everything are skipped
        skip = 0
        for m in match:
            if m.size is None and m.offset == skip and not _covers(fields, m.value) and not isinstance(layout, ir.Hidden):
                skip += len(m.value)
        if not isinstance(layout, (ir.Struct, ir.Hidden, ir.Link)):
            layout = ir.Struct((("value", layout),))
        return Kind(x["name"], layout, match, skip=skip)

    def instruction(x: dict) -> Kind:
        at = f"instructions.{x['name']}"
        args = x.get("arguments") or []
        match = b.matches(x, args, at)
        layout = b.struct(args, at)
        accounts = tuple(AccountSpec(a["name"], bool(a.get("isOptional")), _address(a)) for a in x.get("accounts") or [])
        rest = next((r["value"]["name"] for r in x.get("remainingAccounts") or [] if "name" in r.get("value", {})), "remaining_accounts")
        skip = 0
        for m in match:
            if m.size is None and m.offset == skip and not _covers(args, m.value):
                skip += len(m.value)
        return Kind(x["name"], layout, match, accounts, skip, rest)

    events = tuple(data_kind(e, f"events.{e['name']}") for e in p.get("events") or [])
    tag = EVENT_TAG, 8
    envelopes = {(e.match[0].value, e.match[1].offset) for e in events if len(e.match) >= 2 and e.match[0].offset == 0}
    if len(envelopes) > 1:
        raise IdlError("events", "event envelopes differ")
    if envelopes:
        tag = envelopes.pop()
        events = tuple(_unwrapped(e, tag[1]) for e in events)
    out = Program(p["name"], p.get("publicKey", ""), types, tuple(data_kind(a, f"accounts.{a['name']}") for a in p.get("accounts") or []), tuple(map(instruction, p.get("instructions") or [])), events, tag)
    out.check()
    return out


def _unwrapped(e: Kind, at: int) -> Kind:
    """The event's kind as of the payload's start."""
    match = tuple(Match(m.offset - at, m.value, m.size) for m in e.match[1:])
    return Kind(e.name, e.layout, match, skip=max(0, e.skip - at) if e.skip else 0)


def _fields(node: dict) -> list[dict]:
    while node.get("kind") in ("hiddenPrefixTypeNode", "hiddenSuffixTypeNode"):
        node = node["type"]
    return node.get("fields") or []


def _covers(fields: list[dict], value: bytes) -> bool:
    """Whether the first field is the discriminator itself, as the layout then reads it."""
    if not fields:
        return False
    f = fields[0]
    if f.get("defaultValueStrategy") == "omitted" or "defaultValue" in f:
        return True
    t = f["type"]
    width = t.get("size") if t["kind"] == "fixedSizeTypeNode" else int(t["format"][1:]) // 8 if t["kind"] == "numberTypeNode" and t["format"] != "shortU16" else None
    return width == len(value)


def _address(a: dict) -> str | None:
    d = a.get("defaultValue") or {}
    return d.get("publicKey") if d.get("kind") == "publicKeyValueNode" else None


# --- Anchor ----------------------------------------------------------------------------------------

# The format's names of scalar types.
_LEAVES = {
    "bool": ir.Bool(), "string": ir.Prefixed(ir.Num("u32"), ir.Bytes(True)), "bytes": ir.Prefixed(ir.Num("u32"), ir.Bytes()),
    "pubkey": ir.Key(), "publicKey": ir.Key(),
    **{x: ir.Num(x) for x in ("u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64", "u128", "i128", "f32", "f64")},
}


class _Anchor:
    """Types of one file; those with parameters are read anew for each set of arguments."""

    def __init__(self, doc: dict):
        self.generic = {t["name"]: t for t in doc.get("types") or [] if t.get("generics")}

    def type(self, t, at: str, env: dict | None = None, depth: int = 0) -> ir.Node:
        if depth > MAX_DEPTH:
            raise IdlError(at, f"types are nested deeper than {MAX_DEPTH}")
        env = env or {}
        go = lambda x, name: self.type(x, f"{at}.{name}", env, depth + 1)
        if isinstance(t, str):
            if t not in _LEAVES:
                raise IdlError(at, f"no such type: {t}")
            return _LEAVES[t]
        if "option" in t:
            return ir.Option(go(t["option"], "option"))
        if "coption" in t:
            return ir.Option(go(t["coption"], "coption"), ir.Num("u32"), True)
        if "vec" in t:
            return ir.Items(go(t["vec"], "vec"), ir.Num("u32"))
        if "array" in t:
            item, n = t["array"]
            if isinstance(n, dict):
                n = env.get(n["generic"])
            if not isinstance(n, int):
                raise IdlError(at, "the array's size is not known")
            return ir.Sized(n, ir.Bytes()) if item == "u8" else ir.Items(go(item, "array"), n)
        if "generic" in t:
            if not isinstance(env.get(t["generic"]), ir.Node):
                raise IdlError(at, f"no argument for {t['generic']}")
            return env[t["generic"]]
        if "defined" in t:
            d = t["defined"]
            name = d if isinstance(d, str) else d["name"]
            template = self.generic.get(name)
            if template is None:
                return ir.Link(camel(name))
            given = [self.constant(g, at) if g["kind"] == "const" or isinstance(g.get("type"), int) else go(g["type"], "generics") for g in d.get("generics") or []]
            inner = {g["name"]: v for g, v in zip(template["generics"], given, strict=True)}
            return self.defined(template["type"], at, inner, depth + 1)
        if "hashMap" in t or "bTreeMap" in t:
            k, v = t.get("hashMap") or t["bTreeMap"]
            return ir.Map(go(k, "key"), go(v, "value"), ir.Num("u32"))
        if "hashSet" in t or "bTreeSet" in t:
            return ir.Items(go(t.get("hashSet") or t["bTreeSet"], "item"), ir.Num("u32"))
        raise IdlError(at, f"no such type: {t}")

    def constant(self, g: dict, at: str) -> int:
        """A number, as a number or the digits that a text begins with (blanks and a plus aside)."""
        if isinstance(g.get("type"), int):
            return g["type"]
        m = re.match(r"\s*\+?(0[xX][0-9a-fA-F]+|[0-9]+)", str(g.get("value")))
        if not m:
            raise IdlError(at, f"no number: {g.get('value')}")
        return int(m[1], 0) if m[1][:2] in ("0x", "0X") else int(m[1])

    def fields(self, fields: list, at: str, env: dict | None = None, depth: int = 0) -> ir.Struct:
        if fields and not (isinstance(fields[0], dict) and "name" in fields[0]):
            return ir.Tuple([self.type(f, f"{at}[{i}]", env, depth + 1) for i, f in enumerate(fields)])
        return ir.Struct(tuple((camel(f["name"]), self.type(f["type"], f"{at}.{f['name']}", env, depth + 1)) for f in fields or []))

    def defined(self, t: dict, at: str, env: dict | None = None, depth: int = 0) -> ir.Node:
        if t["kind"] == "struct":
            return self.fields(t.get("fields") or [], at, env, depth)
        if t["kind"] == "enum":
            each = [(camel(v["name"]), self.fields(v["fields"], f"{at}.{v['name']}", env, depth) if v.get("fields") else None) for v in t["variants"]]
            return ir.Enum(tuple(each))
        if t["kind"] in ("type", "alias"):
            return self.type(t.get("alias") or t.get("value"), at, env, depth + 1)
        raise IdlError(at, f"no such kind: {t['kind']}")


def from_anchor(doc: dict) -> Program:
    """Of the current and the older layout; in the older, discriminators follow from the names."""
    new = "metadata" in doc and "spec" in doc["metadata"]
    b = _Anchor(doc)
    types = {camel(t["name"]): b.defined(t["type"], f"types.{t['name']}") for t in doc.get("types") or [] if t["name"] not in b.generic}
    for t in doc.get("types") or []:
        if t["name"] not in b.generic:
            types[camel(t["name"])] = _laid_out(t, types)

    def accounts(items: list, prefix: str = "") -> list[AccountSpec]:
        out = []
        for a in items or []:
            if "accounts" in a:
                out += accounts(a["accounts"], prefix)
            else:
                out.append(AccountSpec(camel(a["name"]), bool(a.get("optional") or a.get("isOptional")), a.get("address")))
        return out

    def kind(x: dict, namespace: str, layout: ir.Struct, given: str, specs=()) -> Kind:
        tag = bytes(x["discriminator"]) if x.get("discriminator") else discriminator(namespace, given)
        return Kind(camel(x["name"]), layout, (Match(0, tag),), tuple(specs), len(tag))

    def layout_of(x: dict, at: str) -> ir.Struct:
        if "type" in x:
            return b.defined(x["type"], at)
        if "fields" in x:
            return b.fields(x["fields"], at)
        return ir.Link(camel(x["name"]))

    for a in doc.get("accounts") or []:
        if "type" in a:
            types.setdefault(camel(a["name"]), b.defined(a["type"], f"accounts.{a['name']}"))
    found_accounts = tuple(kind(a, "account", layout_of(a, f"accounts.{a['name']}"), a["name"]) for a in doc.get("accounts") or [])
    instructions = tuple(kind(i, "global", b.fields(i.get("args") or [], f"instructions.{i['name']}"), snake(i["name"]), accounts(i.get("accounts"))) for i in doc["instructions"])
    events = tuple(kind(e, "event", layout_of(e, f"events.{e['name']}"), e["name"]) for e in doc.get("events") or [])
    for group in (found_accounts, instructions, events):
        _distinct(group)
    name = doc["metadata"]["name"] if new else doc["name"]
    address = doc.get("address") or (doc.get("metadata") or {}).get("address", "")
    out = Program(camel(name), address, types, found_accounts, instructions, events)
    out.check()
    return out


def _laid_out(t: dict, types: dict[str, ir.Node]) -> ir.Node:
    """Types that programs map straight from memory have C's padding; Rust's own order is not known."""
    node = types[camel(t["name"])]
    if not str(t.get("serialization", "")).startswith("bytemuck") or not isinstance(node, ir.Struct):
        return node
    how = t.get("repr") or {}
    if how.get("packed"):
        return node
    if how.get("kind") != "c":
        raise IdlError(f"types.{t['name']}", "a type in memory without C layout has no known places")
    try:
        return ir.c_layout(node, types)
    except ir.DecodeError as e:
        raise IdlError(f"types.{t['name']}", str(e)) from e


def _distinct(kinds: tuple[Kind, ...]) -> None:
    """One discriminator may not begin another's."""
    tags = sorted((k.match[0].value, k.name) for k in kinds)
    for (a, x), (b, y) in zip(tags, tags[1:], strict=False):
        if b.startswith(a):
            raise IdlError(y, f"its discriminator begins with that of {x}")
