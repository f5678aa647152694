"""Programs: how bytes are told apart, and which layout each kind has."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import accumulate, pairwise
from json.encoder import c_make_encoder, encode_basestring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.decode import columns
from slotweave.decode.ir import DecodeError, Node, Struct
from slotweave.functions.encoding import b58decode


@dataclass(frozen=True)
class Match:
    """Constant bytes at an offset, or a size of the whole data (``size``)."""

    offset: int = 0
    value: bytes = b""
    size: int | None = None

    def holds(self, data: bytes) -> bool:
        if self.size is not None:
            return len(data) == self.size
        return data[self.offset : self.offset + len(self.value)] == self.value

    def column(self, data: Column) -> Column:
        if self.size is not None:
            return F.octet_length(data) == self.size
        return F.coalesce(F.substring(data, self.offset + 1, len(self.value)) == F.lit(self.value), F.lit(False))


@dataclass(frozen=True)
class AccountSpec:
    """A named account of an instruction. ``address``: filled in if it is left out at the end."""

    name: str
    optional: bool = False
    address: str | None = None


@dataclass(frozen=True)
class Kind:
    """One account, instruction or event layout. All of ``match`` must hold."""

    name: str
    layout: Struct
    match: tuple[Match, ...] = ()
    accounts: tuple[AccountSpec, ...] = ()
    #: Bytes before the layout that discriminators alone describe.
    skip: int = 0
    #: Name under which the accounts beyond the declared ones are listed.
    rest: str = "remaining_accounts"

    @cached_property
    def fixed(self) -> dict[int, str]:
        """Fixed addresses of accounts that must be given, by their place."""
        return {i: a.address for i, a in enumerate(self.accounts) if a.address and not a.optional}

    @cached_property
    def names(self) -> list[str] | None:
        """The accounts' names if none is optional."""
        return None if any(a.optional for a in self.accounts) else [a.name for a in self.accounts]

    @cached_property
    def required(self) -> int:
        """Accounts up to the last that must be given."""
        n = 0
        for i, a in enumerate(self.accounts, 1):
            if not a.optional:
                n = i
        return n

    def column(self, data: Column) -> Column:
        out = F.lit(True)
        for m in self.match:
            out = out & m.column(data)
        return out


EVENT_TAG = bytes.fromhex("e445a52e51cb9a1d")


@dataclass(eq=False)
class Program:
    name: str
    address: str
    types: dict[str, Node] = field(default_factory=dict)
    accounts: tuple[Kind, ...] = ()
    instructions: tuple[Kind, ...] = ()
    events: tuple[Kind, ...] = ()
    #: Bytes that mark an instruction as a wrapped event, and where the event starts.
    envelope: tuple[bytes, int] = (EVENT_TAG, 8)
    #: Chooses the kind of an instruction itself: (data, keys) -> its name, or None to go by discriminators.
    resolver: Callable[[bytes, list[str]], str | None] | None = None
    _tags: tuple | None = field(default=None, init=False, repr=False)

    # --- one value -------------------------------------------------------------------------

    def _layout(self, kind: Kind, data: bytes) -> dict:
        value, _ = kind.layout.read(data, kind.skip, self.types)
        return value

    def account(self, data: bytes) -> tuple[str, str | None, dict | None, str | None]:
        """(outcome, kind, value, error): the first kind that matches decides, and its failure is final."""
        for k in self.accounts:
            if all(m.holds(data) for m in k.match):
                try:
                    return "parsed", k.name, self._layout(k, data), None
                except DecodeError as e:
                    return "error", k.name, None, str(e)
        return "error", None, None, "no discriminator matches"

    def instruction(self, data: bytes, keys: list[str]) -> tuple[str, str | None, dict | None, str | None]:
        """Of kinds with one discriminator, that with most accounts that the keys suffice for."""
        if data.startswith(self.envelope[0]) and self.events:
            return "filtered", None, None, None
        chosen = self.resolver(data, keys) if self.resolver else None
        found = [k for k in self.instructions if k.name == chosen] if chosen else self._matching(data)
        if not found:
            return "error", None, None, "no discriminator matches"
        same = [k for k in found if k.match == found[0].match] if len(found) > 1 else found
        enough = sorted((k for k in same if len(keys) >= k.required), key=lambda k: -k.required) if len(same) > 1 else same
        if len(same) > 1 and len(enough) > 1 and enough[0].required == enough[1].required:
            return "error", None, None, f"ambiguous instruction: {enough[0].name}, {enough[1].name}"
        k = enough[0] if enough else same[0]
        named, error = self._accounts(k, keys)
        if error:
            return "error", k.name, None, error
        try:
            return "parsed", k.name, {"accounts": named, "args": self._layout(k, data)}, None
        except DecodeError as e:
            return "error", k.name, None, str(e)

    def _matching(self, data: bytes) -> list[Kind]:
        """The instruction kinds whose discriminators all hold, in order; their first ones are looked up, not tried in turn."""
        if self._tags is None or self._tags[0] is not self.instructions:
            others: list[int] = []
            by_value: dict[tuple[int, int], dict[bytes, list[int]]] = {}
            for i, k in enumerate(self.instructions):
                if k.match and k.match[0].size is None:
                    at, value = k.match[0].offset, k.match[0].value
                    by_value.setdefault((at, at + len(value)), {}).setdefault(value, []).append(i)
                else:
                    others.append(i)
            self._tags = (self.instructions, others, [(a, b, values) for (a, b), values in by_value.items()])
        kinds, others, by_value = self._tags
        near = list(others)
        for a, b, values in by_value:
            near += values.get(data[a:b], ())
        if len(near) == 1 and len(kinds[near[0]].match) == 1 and not others:
            return [kinds[near[0]]]
        return [k for k in (kinds[i] for i in sorted(near)) if all(m.holds(data) for m in k.match)]

    def _accounts(self, k: Kind, keys: list[str]) -> tuple[dict, str | None]:
        """Accounts by name, and what lies beyond them; an optional one that is the program itself was left out.

        Accounts with a fixed address may be missing at the end, and are filled in then. Not
        if the list looks as if another was left out: an optional one before them is missing,
        one that is there has another address, or a missing one's address stands elsewhere.
        """
        n = len(keys)
        fixed = k.fixed
        if fixed and n <= max(fixed):
            skipped = any(a.optional and i >= n for i, a in enumerate(k.accounts) if i < max(fixed))
            moved = any(keys[i] != x if i < n else any(key == x and j not in fixed for j, key in enumerate(keys)) for i, x in fixed.items())
            if skipped or moved:
                return {}, "the accounts are shifted"
        if k.names is not None and n >= len(k.names):
            return {**dict(zip(k.names, keys, strict=False)), k.rest: keys[len(k.names) :]}, None
        named: dict[str, object] = {}
        for i, a in enumerate(k.accounts):
            if i < n:
                named[a.name] = None if a.optional and keys[i] == self.address else keys[i]
            elif a.optional or i in fixed:
                named[a.name] = fixed.get(i)
            else:
                return {}, f"too few accounts: {n}, {k.required} wanted"
        named[k.rest] = keys[len(k.accounts) :]
        return named, None

    def event(self, data: bytes) -> tuple[str, dict] | None:
        """(kind, value) of an event's bytes; None where none matches or it can't be read."""
        for k in self.events:
            if all(m.holds(data) for m in k.match):
                try:
                    return k.name, self._layout(k, data)
                except DecodeError:
                    return None
        return None

    def wrapped_event(self, data: bytes) -> tuple[str, dict] | None:
        tag, at = self.envelope
        return self.event(data[at:]) if data.startswith(tag) else None

    # --- columns ---------------------------------------------------------------------------

    def account_outcome(self, data: Column) -> Column:
        return _account_udf(self)(data)

    def instruction_outcome(self, data: Column, keys: Column) -> Column:
        """``keys``: array of binary or base58 text."""
        return _instruction_udf(self)(data, keys)

    def events_column(self, lines: Column, inner: Column) -> Column:
        """array<struct<kind, payload>> of an instruction's events: ``inner``, data of its calls to itself, and its log lines."""
        return _events_udf(self)(lines, inner)

    def account_fields(self, kind: str, data: Column) -> Column:
        """The typed struct of an account kind with a fixed layout, JVM-side; null where the data isn't one."""
        k = next(k for k in self.accounts if k.name == kind)
        value, ok = columns.fields(k.layout, data, k.skip, self.types)
        mine = k.column(data) if _apart(k.match, [x.match for x in self.accounts if x is not k]) else self.account_kind(data) == kind
        return F.when(mine & ok, value)

    def instruction_choice(self, data: Column, n_keys: Column) -> Column:
        """struct<kind, error>, JVM-side: by discriminators, and of kinds that share theirs that with most accounts that ``n_keys`` suffice for.

        Where a resolver chooses, or batches nest, ``instruction_outcome`` is the way.
        """
        pair = lambda kind, error: F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(error).cast("string").alias("error"))
        groups: dict[tuple[Match, ...], list[Kind]] = {}
        for k in self.instructions:
            groups.setdefault(k.match, []).append(k)
        out = F.when(F.lit(False), pair(None, None))
        if self.events:
            out = out.when(F.substring(data, 1, len(self.envelope[0])) == F.lit(self.envelope[0]), pair(None, None))
        for same in groups.values():
            best = F.when(F.lit(False), pair(None, None))
            for least in sorted({k.required for k in same}, reverse=True):
                these = [k for k in same if k.required == least]
                twice = f"ambiguous instruction: {these[0].name}, {these[1].name}" if len(these) > 1 else None
                best = best.when(n_keys >= least, pair(None if twice else these[0].name, twice))
            out = out.when(same[0].column(data), best.otherwise(pair(same[0].name, "too few accounts")))
        return out.otherwise(pair(None, "no discriminator matches"))

    def instruction_fields(self, kind: str, data: Column, keys: Column) -> Column:
        """struct<accounts, args> of an instruction kind with a fixed layout, JVM-side; null where the data or keys aren't one."""
        k, *others = [k for k in self.instructions if k.name == kind]
        if any((k.accounts, k.layout, k.skip, k.rest) != (o.accounts, o.layout, o.skip, o.rest) for o in others):
            raise columns.NotFixed(f"{kind} is the name of several layouts")
        if any(a.address for a in k.accounts):
            raise columns.NotFixed(f"{kind} has accounts that may be filled in")
        itself, n = F.lit(b58decode(self.address)), F.size(keys)
        given = [F.get(keys, F.lit(i)) for i in range(len(k.accounts))]
        named = [(F.nullif(x, itself) if a.optional else x).alias(a.name) for x, a in zip(given, k.accounts, strict=True)]
        rest = F.slice(keys, len(k.accounts) + 1, F.greatest(n - len(k.accounts), F.lit(0))).alias(k.rest)
        args, ok = columns.fields(k.layout, data, k.skip, self.types)
        tags = [x.match for x in self.instructions if x.name != kind] + [(Match(0, self.envelope[0]),)] * bool(self.events)
        if all(_apart(x.match, tags) for x in (k, *others)):
            # no other kind has these discriminators: they and the number of keys decide
            fits = reduce(lambda a, b: a | b, [x.column(data) for x in (k, *others)]) & (n >= k.required)
        else:
            choice = self.instruction_choice(data, n)
            fits = (choice["kind"] == kind) & choice["error"].isNull()
        accounts = F.struct(*named, rest).alias("accounts")
        return F.when(fits & ok, F.struct(accounts, args.alias("args")) if k.layout.fields else F.struct(accounts))

    def account_kind(self, data: Column) -> Column:
        """The kind's name alone, JVM-side: the first discriminator that matches."""
        return _case(self.accounts, data)

    def instruction_kind(self, data: Column) -> Column:
        return _case(self.instructions, data)

    def schema(self, kind: str) -> T.StructType:
        """The typed struct of a kind's payload, for ``from_json``."""
        for k in self.accounts:
            if k.name == kind:
                return k.layout.spark(self.types)
        for k in self.instructions:
            if k.name == kind:
                names = T.StructType([*[T.StructField(a.name, T.StringType()) for a in k.accounts], T.StructField(k.rest, T.ArrayType(T.StringType()))])
                return T.StructType([T.StructField("accounts", names), T.StructField("args", k.layout.spark(self.types))])
        for k in self.events:
            if k.name == kind:
                return k.layout.spark(self.types)
        raise KeyError(kind)

    def typed(self, df: DataFrame, kind: str, payload: str = "payload", name: str = "value") -> DataFrame:
        """Rows of one kind with their payload as typed columns."""
        return df.where(F.col("kind") == kind).withColumn(name, F.from_json(payload, self.schema(kind)))

    def constants(self) -> dict[str, tuple[bytes, int]]:
        """(bytes, offset) of each kind's discriminator, usable as a memcmp filter."""
        return {k.name: (m.value, m.offset) for k in (*self.accounts, *self.instructions, *self.events) for m in k.match[:1] if m.size is None}

    def check(self) -> None:
        """Raises if an event's bytes could be taken for an instruction's."""
        tag = self.envelope[0]
        for k in self.instructions:
            for m in k.match:
                if self.events and m.size is None and m.offset == 0 and m.value and (tag.startswith(m.value) or m.value.startswith(tag)):
                    raise ValueError(f"instruction {k.name} collides with the event tag")


def _apart(match: tuple[Match, ...], others: list[tuple[Match, ...]]) -> bool:
    """Whether no data can hold for ``match`` and for one of the others."""

    def differ(a: Match, b: Match) -> bool:
        if a.size is not None or b.size is not None:
            return a.size is not None and b.size is not None and a.size != b.size
        n = min(len(a.value), len(b.value))
        return a.offset == b.offset and a.value[:n] != b.value[:n]

    return all(any(differ(a, b) for a in match for b in other) for other in others)


OUTCOME = "outcome string, kind string, payload string, error string"


def _case(kinds: Iterable[Kind], data: Column) -> Column:
    out = None
    for k in kinds:
        c = k.column(data)
        out = F.when(c, k.name) if out is None else out.when(c, k.name)
    return out if out is not None else F.lit(None).cast("string")


def _account_udf(program: Program):
    @F.arrow_udf(OUTCOME)
    def run(data: pa.Array) -> pa.Array:
        return _outcomes(("filtered", None, None, None) if x is None else program.account(x) for x in data.to_pylist())

    return run


def _instruction_udf(program: Program):
    from slotweave.functions.encoding import b58encode

    @F.arrow_udf(OUTCOME)
    def run(data: pa.Array, keys: pa.Array) -> pa.Array:
        # each key of a batch is made text once
        values = keys.flatten().dictionary_encode()
        texts = [k if k is None or isinstance(k, str) else b58encode(k) for k in values.dictionary.to_pylist()]
        codes = values.indices.fill_null(len(texts)).to_numpy(zero_copy_only=False).tolist()
        texts.append(None)
        named = [texts[c] for c in codes]
        at = list(accumulate(keys.value_lengths().fill_null(0).to_pylist(), initial=0))
        each = zip(data.to_pylist(), pairwise(at), strict=True)
        return _outcomes(("error", None, None, "no data") if x is None else program.instruction(x, named[a:b]) for x, (a, b) in each)

    return run


EVENTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())]))


def _events_udf(program: Program):
    @F.pandas_udf(EVENTS)
    def run(lines: pd.Series, inner: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(lines, inner, strict=True):
            found = merged_events(program, [bytes(d) for d in ([] if y is None else y)], list([] if x is None else x))
            out.append([{"kind": k, "payload": json.dumps(v, ensure_ascii=False, separators=(",", ":"))} for k, v in found])
        return pd.Series(out)

    return run


_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False)
#: ``encode`` makes an encoder in C for each value; here one serves all, where there is one.
_c_encode = c_make_encoder and c_make_encoder(None, _ENCODER.default, encode_basestring, None, ":", ",", False, False, True)


def _json(value: dict) -> str:
    return "".join(_c_encode(value, 0)) if _c_encode else _ENCODER.encode(value)


def _outcomes(rows: Iterable[tuple[str, str | None, dict | None, str | None]]) -> pa.Array:
    out: list[list] = [[], [], [], []]
    for o, k, v, e in rows:
        # values become text at once: a batch of dicts would be work for the garbage collector
        for into, x in zip(out, (o, k, None if v is None else _json(v), e)):
            into.append(x)
    return pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in out], ["outcome", "kind", "payload", "error"])


def log_payloads(lines: list[str], program: str) -> list[bytes]:
    """Bytes of the data lines that ``program`` itself wrote: it is on top of the call stack then."""
    import base64
    import binascii
    import re

    from slotweave.operators.flatten import CLOSE, INVOKE

    invoke, close, out, stack = re.compile(INVOKE), re.compile(CLOSE), [], []
    for x in lines:
        if m := invoke.search(x):
            stack.append(m[1])
        elif close.search(x):
            if stack:
                stack.pop()
        elif x.startswith("Program data: ") and stack and stack[-1] == program:
            try:
                out.append(base64.b64decode(x[len("Program data: ") :], validate=True))
            except (ValueError, binascii.Error):
                pass
    return out


def merged_events(program: Program, inner: list[bytes], lines: list[str]) -> list[tuple[str, dict]]:
    """Events of an instruction: those of its wrapped calls, then those of its log that aren't among them already.

    Equal events are matched one to one, so a repeat that both ways report counts once each time.
    """
    found = [e for e in map(program.wrapped_event, inner) if e]
    same = Counter(json.dumps(e, sort_keys=True) for e in found)
    for data in log_payloads(lines, program.address):
        e = program.event(data)
        if e is None:
            continue
        key = json.dumps(e, sort_keys=True)
        if same[key]:
            same[key] -= 1
        else:
            found.append(e)
    return found
