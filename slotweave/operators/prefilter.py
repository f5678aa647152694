"""Declarative prefilters: a predicate algebra with validation, union-merge and compilation.

A :class:`Prefilter` has one optional part per update kind; a kind without a part is not
subscribed to. ``merge`` describes the union of what two prefilters receive, by rules that
differ per field (see each ``merge``). ``column`` compiles a part to a Column predicate, so
that Catalyst pushes it into the scan; ``apply`` does the same for a DataFrame, with a
semi-join in place of key lists longer than ``IN_LIST``.

Keys within one list are alternatives; lists of one part must all match.
"""

from __future__ import annotations

import base64
import binascii
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.encoding import b58decode

MAX_FILTERS, MAX_BYTES, MAX_BASE58, MAX_BASE64 = 4, 128, 175, 172
#: Longer key lists go through a semi-join; up to BROADCAST_KEYS keys (8 MB of 32-byte keys or so) it is a broadcast.
IN_LIST, BROADCAST_KEYS = 500, 200_000
U64 = 1 << 64


class PrefilterError(ValueError):
    """A prefilter that no source could act on."""


# --- account data filters -----------------------------------------------------------------


@dataclass(frozen=True)
class Memcmp:
    """Bytes at an offset of the data. ``encoding``: bytes, base58 or base64 (of a str)."""

    offset: int
    data: bytes | str
    encoding: str = "bytes"

    def decoded(self) -> bytes:
        if self.encoding == "bytes":
            return bytes(self.data)
        most = MAX_BASE58 if self.encoding == "base58" else MAX_BASE64
        if len(self.data) > most:
            raise PrefilterError(f"memcmp at {self.offset}: {len(self.data)} {self.encoding} characters, at most {most}")
        try:
            if self.encoding == "base58":
                return b58decode(self.data)
            out = base64.b64decode(self.data, validate=True)
            if base64.b64encode(out).decode() != self.data:
                raise ValueError("not canonical")
            return out
        except (ValueError, binascii.Error) as e:
            raise PrefilterError(f"memcmp at {self.offset}: bad {self.encoding}: {e}") from e

    def validate(self) -> None:
        n = len(self.decoded())
        if not n:
            raise PrefilterError(f"memcmp at {self.offset}: nothing to compare")
        if n > MAX_BYTES:
            raise PrefilterError(f"memcmp at {self.offset}: {n} bytes, at most {MAX_BYTES}")

    def column(self) -> Column:
        data = self.decoded()
        return F.substring(F.col("data"), self.offset + 1, len(data)) == F.lit(data)


@dataclass(frozen=True)
class DataSize:
    size: int

    def validate(self) -> None:
        pass

    def column(self) -> Column:
        return F.octet_length("data") == self.size


@dataclass(frozen=True)
class TokenAccountState:
    """Initialised token accounts only: 165 bytes, or more with byte 165 marking an account; state byte not 0."""

    initialized: bool = True

    def validate(self) -> None:
        if not self.initialized:
            raise PrefilterError("only initialised token accounts can be asked for")

    def column(self) -> Column:
        n = F.octet_length("data")
        shape = (n == 165) | ((n > 165) & (F.substring(F.col("data"), 166, 1) == F.lit(b"\x02")))
        return shape & (F.substring(F.col("data"), 109, 1) != F.lit(b"\x00"))


@dataclass(frozen=True)
class Lamports:
    op: str  # eq, ne, lt, gt
    value: int

    def validate(self) -> None:
        if self.op not in ("eq", "ne", "lt", "gt"):
            raise PrefilterError(f"no such comparison: {self.op}")

    def column(self) -> Column:
        x, v = F.col("lamports"), F.lit(self.value)
        return {"eq": x == v, "ne": x != v, "lt": x < v, "gt": x > v}[self.op]


DataFilter = Memcmp | DataSize | TokenAccountState | Lamports


def validate_filters(filters: Iterable[DataFilter]) -> list[DataFilter]:
    """Repeats dropped, then at most MAX_FILTERS, each valid, at most one DataSize."""
    out = list(dict.fromkeys(filters))
    if len(out) > MAX_FILTERS:
        raise PrefilterError(f"{len(out)} account filters, at most {MAX_FILTERS}")
    for f in out:
        f.validate()
    if sum(isinstance(f, DataSize) for f in out) > 1:
        raise PrefilterError("more than one data size")
    return out


@dataclass(frozen=True)
class DataSlice:
    """A window of account data, to be received in place of the whole."""

    offset: int
    length: int

    @staticmethod
    def validate_all(slices: Iterable[DataSlice]) -> list[DataSlice]:
        out, before = list(slices), None
        for s in out:
            if s.length == 0:
                raise PrefilterError(f"data slice at {s.offset} has no length")
            if s.offset + s.length >= U64:
                raise PrefilterError(f"data slice at {s.offset} ends beyond 64 bits")
            if before is not None:
                if s.offset < before.offset:
                    raise PrefilterError(f"data slice at {s.offset} follows one at {before.offset}")
                if s.offset < before.offset + before.length:
                    raise PrefilterError(f"data slice at {s.offset} overlaps the one before")
            before = s
        return out

    @staticmethod
    def column(slices: Iterable[DataSlice], data: str = "data") -> Column:
        """The windows one after another; what lies beyond the data is missing."""
        parts = [F.substring(F.col(data), s.offset + 1, s.length) for s in DataSlice.validate_all(slices)]
        return F.concat(*parts) if parts else F.col(data)


# --- parts ----------------------------------------------------------------------------------


def _in(c: Column, keys: frozenset) -> Column:
    return c.isin(sorted(keys))


def _list(keys: frozenset) -> Column:
    return F.array(*[F.lit(k) for k in sorted(keys)])


@dataclass(frozen=True)
class AccountPart:
    accounts: frozenset = frozenset()
    owners: frozenset = frozenset()
    filters: tuple[DataFilter, ...] = ()
    nonempty_txn_signature: bool | None = None
    #: Keys sent as a probabilistic filter elsewhere; here their exact set.
    members: frozenset = frozenset()

    def merge(self, other: AccountPart) -> AccountPart:
        """Key sets unite; filter lists that differ as multisets are dropped; signature choices that differ, too."""
        return AccountPart(
            self.accounts | other.accounts,
            self.owners | other.owners,
            self.filters if Counter(self.filters) == Counter(other.filters) else (),
            self.nonempty_txn_signature if self.nonempty_txn_signature == other.nonempty_txn_signature else None,
            self.members | other.members,
        )

    def _conditions(self) -> list[Column]:
        out = [f.column() for f in self.filters]
        if self.nonempty_txn_signature is not None:
            out.append(F.col("txn_signature").isNotNull() if self.nonempty_txn_signature else F.col("txn_signature").isNull())
        return out

    def column(self) -> Column:
        out = self._conditions()
        if self.accounts or self.members:
            out.append(_in(F.col("pubkey"), self.accounts | self.members))
        if self.owners:
            out.append(_in(F.col("owner"), self.owners))
        return reduce(lambda a, b: a & b, out, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        out = df.where(reduce(lambda a, b: a & b, self._conditions(), F.lit(True)))
        for name, keys in (("pubkey", self.accounts | self.members), ("owner", self.owners)):
            out = _members(out, name, keys)
        return out


def _members(df: DataFrame, name: str, keys: frozenset) -> DataFrame:
    if not keys:
        return df
    if len(keys) <= IN_LIST:
        return df.where(_in(F.col(name), keys))
    kind = df.schema[name].dataType
    table = df.sparkSession.createDataFrame([(k,) for k in sorted(keys)], f"{name} {kind.simpleString()}")
    return df.join(F.broadcast(table) if len(keys) <= BROADCAST_KEYS else table, name, "left_semi")


#: How far token-balance owners count as keys of a transaction, from narrow to wide.
BALANCE_CHANGED, ALL_OWNERS = "balance_changed", "all"


@dataclass(frozen=True)
class TransactionPart:
    include: frozenset = frozenset()
    required: frozenset = frozenset()
    exclude: frozenset = frozenset()
    vote: bool | None = None
    signature: str | None = None
    token_accounts: str | None = None
    failed: bool | None = False
    members: frozenset = frozenset()

    def merge(self, other: TransactionPart) -> TransactionPart:
        """Include, required and member keys unite (required narrows, as documented); excluded keys intersect.

        Differing vote, signature or failed choices widen to any. Of differing owner
        modes the wider stays, and nothing is excluded any more, as the wider mode would
        exclude more than either side asked.
        """
        exclude, owners = self.exclude & other.exclude, self.token_accounts
        if self.token_accounts != other.token_accounts:
            owners = ALL_OWNERS if ALL_OWNERS in (self.token_accounts, other.token_accounts) else BALANCE_CHANGED
            exclude = frozenset()
        return TransactionPart(
            self.include | other.include,
            self.required | other.required,
            exclude,
            self.vote if self.vote == other.vote else None,
            self.signature if self.signature == other.signature else None,
            owners,
            self.failed if self.failed == other.failed else None,
            self.members | other.members,
        )

    def keys(self) -> Column:
        """A transaction's keys, with token-balance owners as the mode has it. Null keys and owners are none."""
        none = F.filter("account_keys", lambda _: F.lit(False))
        known = lambda c: F.array_compact(F.coalesce(c, none))
        keys = known(F.col("account_keys"))
        if self.token_accounts == ALL_OWNERS:
            return F.array_union(keys, known(F.transform("token_balances", lambda b: b["owner"])))
        if self.token_accounts == BALANCE_CHANGED:
            changed = F.filter("token_balances", lambda b: ~b["pre"].eqNullSafe(b["post"]))
            return F.array_union(keys, known(F.transform(changed, lambda b: b["owner"])))
        return keys

    def column(self) -> Column:
        keys, out = self.keys(), []
        has = lambda wanted: F.coalesce(F.arrays_overlap(keys, _list(wanted)), F.lit(False))  # noqa: E731  (no keys at all: null)
        if self.include or self.members:
            out.append(has(self.include | self.members))
        if self.required:
            out.append(F.coalesce(F.size(F.array_except(_list(self.required), keys)) == 0, F.lit(False)))
        if self.exclude:
            out.append(~has(self.exclude))
        for name, want in (("is_vote", self.vote), ("signature", self.signature), ("failed", self.failed)):
            if want is not None:
                out.append(F.col(name) == F.lit(want))
        return reduce(lambda a, b: a & b, out, F.lit(True))


@dataclass(frozen=True)
class BlockMetaPart:
    def merge(self, other: BlockMetaPart) -> BlockMetaPart:
        return self


@dataclass(frozen=True)
class BlockFooterPart:
    include_certificates: bool = False

    def merge(self, other: BlockFooterPart) -> BlockFooterPart:
        return BlockFooterPart(self.include_certificates or other.include_certificates)

    def project(self, footers: DataFrame) -> DataFrame:
        """Certificates stay unread where nobody asks for them."""
        return footers if self.include_certificates else footers.drop("certificates")


@dataclass(frozen=True)
class BlockPart:
    """What a block's row holds: its ``transactions`` (of certain keys), ``accounts`` and ``entries``."""

    accounts_include: frozenset = frozenset()
    include_accounts: bool | None = None
    include_transactions: bool | None = None
    include_entries: bool | None = None
    members: frozenset = frozenset()

    def merge(self, other: BlockPart) -> BlockPart:
        either = lambda a, b: None if a is None and b is None else bool(a or b)
        return BlockPart(
            self.accounts_include | other.accounts_include,
            either(self.include_accounts, other.include_accounts),
            either(self.include_transactions, other.include_transactions),
            either(self.include_entries, other.include_entries),
            self.members | other.members,
        )

    def project(self, blocks: DataFrame) -> DataFrame:
        """Drops what isn't asked for, so that column pruning keeps it unread."""
        keys = self.accounts_include | self.members
        drop = [n for n, want in (("accounts", self.include_accounts), ("transactions", self.include_transactions), ("entries", self.include_entries)) if not want]
        out = blocks.drop(*drop)
        if keys and "transactions" in out.columns:
            wanted = _list(keys)
            out = out.withColumn("transactions", F.filter("transactions", lambda t: F.arrays_overlap(t["account_keys"], wanted)))
        return out


@dataclass(frozen=True)
class SlotPart:
    filter_by_commitment: bool = True
    interslot_updates: bool | None = None

    def merge(self, other: SlotPart) -> SlotPart:
        a, b = self.interslot_updates, other.interslot_updates
        inter = None if a is None and b is None else bool(a or b)
        return SlotPart(self.filter_by_commitment and other.filter_by_commitment, inter)

    def column(self, commitment: str) -> Column:
        if self.filter_by_commitment:
            return F.col("status") == commitment
        levels = F.col("status").isin("processed", "confirmed", "finalized")
        return F.lit(True) if self.interslot_updates else levels


PARTS = ("account", "transaction", "block_meta", "block_footer", "block", "slot")


@dataclass(frozen=True)
class Prefilter:
    account: AccountPart | None = None
    transaction: TransactionPart | None = None
    block_meta: BlockMetaPart | None = None
    block_footer: BlockFooterPart | None = None
    block: BlockPart | None = None
    slot: SlotPart | None = None

    def merge(self, other: Prefilter) -> Prefilter:
        both = lambda a, b: a.merge(b) if a and b else a or b
        return Prefilter(**{k: both(getattr(self, k), getattr(other, k)) for k in PARTS})

    @staticmethod
    def union(prefilters: Iterable[Prefilter]) -> Prefilter:
        return reduce(Prefilter.merge, prefilters, Prefilter()) if (prefilters := list(prefilters)) else Prefilter()

    @staticmethod
    def builder() -> PrefilterBuilder:
        return PrefilterBuilder()


class PrefilterBuilder:
    """Each field may be set once; the first error is raised by ``build``, whatever follows."""

    def __init__(self):
        self._set: dict[str, object] = {}
        self._error: PrefilterError | None = None

    def _put(self, name: str, value) -> PrefilterBuilder:
        if self._error is None:
            try:
                if name in self._set:
                    raise PrefilterError(f"{name} is already set")
                self._set[name] = value() if callable(value) else value
            except PrefilterError as e:
                self._error = e
        return self

    def slots(self):
        return self._put("slots", True)

    def slot_interslot_updates(self, on: bool):
        return self._put("interslot", on)

    def block_metas(self):
        return self._put("block_metas", True)

    def block_footers(self, include_certificates: bool = False):
        return self._put("block_footers", include_certificates)

    def block_accounts_include(self, keys):
        return self._put("block_accounts", frozenset(keys))

    def block_members(self, keys):
        return self._put("block_members", frozenset(keys))

    def block_include_accounts(self, on: bool):
        return self._put("block_with_accounts", on)

    def block_include_transactions(self, on: bool):
        return self._put("block_with_transactions", on)

    def block_include_entries(self, on: bool):
        return self._put("block_with_entries", on)

    def accounts(self, keys):
        return self._put("accounts", frozenset(keys))

    def account_owners(self, keys):
        return self._put("owners", frozenset(keys))

    def account_members(self, keys):
        return self._put("account_members", frozenset(keys))

    def account_filters(self, filters):
        return self._put("filters", lambda: tuple(validate_filters(filters)))

    def account_nonempty_txn_signature(self, required: bool):
        return self._put("signed", required)

    def accounts_include_all(self):
        return self._put("all_accounts", True)

    def transaction_accounts_include(self, keys):
        return self._put("include", frozenset(keys))

    def transaction_accounts_required(self, keys):
        return self._put("required", frozenset(keys))

    def transaction_accounts_exclude(self, keys):
        return self._put("exclude", frozenset(keys))

    def transaction_members(self, keys):
        return self._put("transaction_members", frozenset(keys))

    def transaction_vote(self, vote: bool):
        return self._put("vote", vote)

    def transaction_signature(self, signature: str):
        return self._put("signature", signature)

    def transaction_token_accounts(self, mode: str):
        return self._put("token_accounts", mode)

    def build(self) -> Prefilter:
        if self._error is not None:
            raise self._error
        g = self._set.get
        none = frozenset()
        account = AccountPart(g("accounts", none), g("owners", none), g("filters", ()), g("signed"), g("account_members", none))
        if g("all_accounts"):
            # what doesn't depend on keys stays
            account = AccountPart(filters=account.filters, nonempty_txn_signature=account.nonempty_txn_signature)
        elif account == AccountPart():
            account = None
        transaction = TransactionPart(g("include", none), g("required", none), g("exclude", none), g("vote"), g("signature"), g("token_accounts"), members=g("transaction_members", none))
        block = BlockPart(g("block_accounts", none), g("block_with_accounts"), g("block_with_transactions"), g("block_with_entries"), g("block_members", none))
        # other than the three levels come only if the commitment doesn't filter
        slot = SlotPart(g("interslot") is not True, g("interslot"))
        return Prefilter(
            account,
            transaction if transaction != TransactionPart() else None,
            BlockMetaPart() if g("block_metas") else None,
            BlockFooterPart(g("block_footers")) if "block_footers" in self._set else None,
            block if block != BlockPart() else None,
            slot if g("slots") or slot != SlotPart() else None,
        )


# --- named filters -----------------------------------------------------------------------------


@dataclass
class Filters:
    """Prefilters by parser id; the shared scan reads what any of them receives."""

    by_id: dict[str, Prefilter] = field(default_factory=dict)
    initial: dict[str, Prefilter] = field(init=False)

    def __post_init__(self):
        self.initial = dict(self.by_id)

    def update(self, parser: str, prefilter: Prefilter) -> bool:
        """Whether anything changed; an unknown id is refused."""
        if parser not in self.by_id:
            raise KeyError(parser)
        changed = self.by_id[parser] != prefilter
        self.by_id[parser] = prefilter
        return changed

    def merge(self, parser: str, prefilter: Prefilter) -> bool:
        return self.update(parser, self.by_id[parser].merge(prefilter))

    def reset(self) -> bool:
        changed = self.by_id != self.initial
        self.by_id = dict(self.initial)
        return changed

    def routed(self, df: DataFrame, kind: str, **arguments) -> DataFrame:
        """Rows that at least one filter receives, with ``filters``: the sorted ids of those that do.

        One scan under the disjunction of all predicates; each row says who gets it.
        """
        parts: Mapping[str, Column] = {name: getattr(p, kind).column(**arguments) for name, p in sorted(self.by_id.items()) if getattr(p, kind)}
        if not parts:
            return df.where(F.lit(False)).withColumn("filters", F.array().cast("array<string>"))
        anyone = reduce(lambda a, b: a | b, parts.values())
        names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in parts.items()]))
        return df.where(anyone).withColumn("filters", names)


def narrowed(prefilter: Prefilter, extra: Prefilter) -> Prefilter:
    """A parser's own prefilter with what a pipeline adds (by the same union rules)."""
    return replace(prefilter).merge(extra)
