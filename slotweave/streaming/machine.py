"""The ordered, fork-aware commit of slots as a state machine over events.

Pure Python and JSON-able, so that one instance per chain can live in a streaming state
store. Only compact, already decoded records pass through it; decoding runs before, in
parallel. ``slotweave.operators.slots`` gives the same results over whole tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

PENDING_LIMIT, RETAIN = 64, 512
#: Events of accounts go by the accounts' own frontier; statuses and metadata serve both.
_ACCOUNTS, _SHARED = ("account", "account_seen"), ("confirm", "finalize", "meta")


@dataclass
class Event:
    """created, entry (key: index, executed), meta (parent, expected, and entries with executed where entries are watched),
    record (key, payload, decoded), stat (key: what to count), tx_parsed, confirm, finalize, discard (key: reason);
    account_seen (an account event came in), account (key: version and pubkey, payload, decoded; it was parsed)."""

    kind: str
    slot: int
    bank: int | None = 0
    parent: int | None = None
    expected: int | None = None
    key: str | None = None
    payload: str | None = None
    decoded: bool = True
    entries: int | None = None
    executed: int | None = None


@dataclass
class Out:
    """kind: record, commit, account, account_commit, late, dropped or error."""

    kind: str
    slot: int
    bank: int | None
    key: str | None = None
    payload: str | None = None
    counts: dict = field(default_factory=dict)


def _new_bank() -> dict:
    return {
        "parent": None, "expected": None, "parsed": 0, "confirmed": False, "records": {}, "stats": {}, "created": False, "entries": {}, "watched": None,
        "flushed": False, "seen": 0, "frozen": None, "late": 0, "processed": 0, "accounts": {}, "accounts_flushed": False,
    }


class SlotMachine:
    """``whole_start``: the first slot counts only if the stream saw it from its creation and first entry on.
    ``accounts``: confirmed or finalized, the status that freezes a bank's number of accounts; None: no accounts.
    ``unique_banks``: bank ids are never used for two slots, so a repeat is fatal."""

    def __init__(self, state: dict | None = None, whole_start: bool = False, accounts: str | None = None, unique_banks: bool = False):
        s = state or {}
        self.whole_start: bool = s.get("whole_start", whole_start)
        self.accounts: str | None = s.get("accounts", accounts)
        self.unique_banks: bool = s.get("unique_banks", unique_banks)
        self.frontier: int | None = s.get("frontier")
        self.account_frontier: int | None = s.get("account_frontier")
        self.first: int | None = s.get("first")
        #: slot -> bank -> what is known of it
        self.slots: dict[int, dict[int, dict]] = {int(k): {int(b): v for b, v in banks.items()} for k, banks in s.get("slots", {}).items()}
        #: slot -> reason, for slots of which no bank can come any more (Forked: unless one is confirmed)
        self.gone: dict[int, str] = {int(k): v for k, v in s.get("gone", {}).items()}
        #: slot -> bank -> reason of banks that were dropped
        self.dead: dict[int, dict[int, str]] = {int(k): {int(b): v for b, v in banks.items()} for k, banks in s.get("dead", {}).items()}
        self.slot_of: dict[int, int] = {int(k): v for k, v in s.get("slot_of", {}).items()}
        self.failed: str | None = s.get("failed")

    def state(self) -> dict:
        names = ("whole_start", "accounts", "unique_banks", "frontier", "account_frontier", "first", "slots", "gone", "dead", "slot_of", "failed")
        return {n: getattr(self, n) for n in names}

    def apply(self, e: Event) -> list[Out]:
        """Outputs of one event. After a fatal error nothing more comes out; callers must stop then."""
        if self.failed:
            return []
        if self._behind(e):
            return [Out("late", e.slot, e.bank, e.key)] if e.kind in ("record", "account", "account_seen") else []
        if self.unique_banks and e.bank is not None and self.slot_of.setdefault(e.bank, e.slot) != e.slot:
            why = "bank ids are missing" if e.bank == 0 else f"bank {e.bank} is in slots {self.slot_of[e.bank]} and {e.slot}"
            return self._fail(e, why)
        if e.kind == "discard":
            return self._discard(e) or self._drain()
        if self.gone.get(e.slot, "Forked") != "Forked" or e.bank in self.dead.get(e.slot, ()):
            return self._for_dropped(e)
        if self.first is None or e.slot < self.first:
            self.first = e.slot
        b = self.slots.setdefault(e.slot, {}).setdefault(e.bank, _new_bank())
        if e.kind == "meta":
            known = (b["parent"], b["expected"])
            if known != (None, None) and known != (e.parent, e.expected):
                return self._fail(e, f"slot {e.slot}: its metadata came twice, with differences")
            if e.parent is not None and e.parent >= e.slot:
                return []  # malformed
            b["parent"], b["expected"] = e.parent, e.expected
            b["watched"] = None if e.entries is None else [e.entries, e.executed]
        elif e.kind == "created":
            b["created"] = True
        elif e.kind == "entry":
            b["entries"][e.key] = e.executed or 0  # a repeat counts once
        elif e.kind == "record":
            b["records"][e.key] = [e.payload, e.decoded]  # the last of a key wins
        elif e.kind == "stat":
            b["stats"][e.key] = b["stats"].get(e.key, 0) + 1
        elif e.kind == "tx_parsed":
            b["parsed"] += 1
        elif e.kind == "account_seen":
            if b["frozen"] is None:
                b["seen"] += 1
            else:
                b["late"] += 1
                return [Out("late", e.slot, e.bank, e.key)]
        elif e.kind == "account":
            b["processed"] += 1
            b["accounts"][e.key] = [e.payload, e.decoded]
        elif e.kind in ("confirm", "finalize"):
            if any(x["confirmed"] for k, x in self.slots[e.slot].items() if k != e.bank):
                return self._fail(e, f"slot {e.slot}: two banks are confirmed")
            self._confirm(e, b)
        if sum(map(len, self.slots.values())) > PENDING_LIMIT:
            return self._fail(e, f"more than {PENDING_LIMIT} banks are pending")
        return self._drain()

    def _behind(self, e: Event) -> bool:
        """Whether the event's slot is through: for accounts behind their own frontier."""
        passed = self.frontier is not None and e.slot <= self.frontier
        if self.accounts is None:
            return passed
        own = self.account_frontier is not None and e.slot <= self.account_frontier
        if e.kind in _ACCOUNTS:
            return own or (passed and e.bank not in self.slots.get(e.slot, {}))
        return passed and (own or e.kind not in _SHARED or e.bank not in self.slots.get(e.slot, {}))

    def _confirm(self, e: Event, b: dict) -> None:
        b["confirmed"] = True
        # a confirmation lifts a fork notice, and a child's that of the parent whose metadata is there
        self.gone.pop(e.slot, None)
        parent = b["parent"]
        if self.gone.get(parent) == "Forked" and any(x["parent"] is not None for x in self.slots.get(parent, {}).values()):
            del self.gone[parent]
        for other in [k for k in self.slots[e.slot] if k != e.bank]:
            del self.slots[e.slot][other]
            self.dead.setdefault(e.slot, {})[other] = "Unconfirmed"
        if b["frozen"] is None and self.accounts == {"confirm": "confirmed", "finalize": "finalized"}[e.kind]:
            b["frozen"] = b["seen"]

    def _for_dropped(self, e: Event) -> list[Out]:
        if e.kind in ("confirm", "finalize"):
            reason = self.gone.get(e.slot, "Forked")
            if reason == "Forked" and self.dead[e.slot][e.bank] == "Incomplete":  # it froze incomplete, so its slot never flushes
                self._end(e.slot, "Incomplete")
                return self._drain()
            if reason != "Incomplete":
                return self._fail(e, f"slot {e.slot}: a discarded bank is confirmed")
        return [Out("dropped", e.slot, e.bank, e.key)] if e.kind in ("record", "account") else []

    def _fail(self, e: Event, why: str) -> list[Out]:
        self.failed = why
        return [Out("error", e.slot, e.bank, None, why)]

    def _end(self, slot: int, reason: str) -> None:
        self.slots.pop(slot, None)
        self.gone[slot] = reason

    def _discard(self, e: Event) -> list[Out]:
        banks, reason = self.slots.get(e.slot, {}), e.key
        confirmed = [k for k, x in banks.items() if x["confirmed"]]
        if reason == "Forked":
            # drops nothing: the slot is passed over until a confirmation lifts it
            named = any(x["confirmed"] and x["parent"] == e.slot for s, other in self.slots.items() if s > e.slot for x in other.values())
            if not confirmed and not (named and any(x["parent"] is not None for x in banks.values())):
                self.gone.setdefault(e.slot, "Forked")
            return []
        if reason == "Cleared" and e.bank in banks and (banks[e.bank]["confirmed"] or banks[e.bank]["parent"] is not None):
            return self._fail(e, f"slot {e.slot}: a bank is cleared that was frozen")
        if e.bank is None or (reason == "Incomplete" and e.bank in confirmed):
            self._end(e.slot, reason)
            return []
        banks.pop(e.bank, None)
        self.dead.setdefault(e.slot, {}).setdefault(e.bank, reason)  # the first reason stays
        if not banks:
            self.slots.pop(e.slot, None)
        return []

    def _drain(self) -> list[Out]:
        out = self._drain_instructions()
        if self.accounts is not None:
            out += self._drain_accounts()
        for slot in sorted(self.slots):
            done = [k for k, x in self.slots[slot].items() if x["flushed"] and (self.accounts is None or x["accounts_flushed"])]
            passed = self.gone.get(slot) == "Forked" and self.frontier is not None and slot < self.frontier
            if done or passed:
                del self.slots[slot]
        if self.frontier is not None:
            for old in (self.gone, self.dead):
                for s in [s for s in old if s < self.frontier - RETAIN]:
                    del old[s]
            for bank in [k for k, s in self.slot_of.items() if s < self.frontier - RETAIN]:
                del self.slot_of[bank]
        return out

    def _drain_instructions(self) -> list[Out]:
        out: list[Out] = []
        for slot in sorted(self.slots):
            bank = self._confirmed(slot)
            if bank is not None and bank[1]["flushed"]:
                continue
            if bank is not None and (self._overshot(bank[1]) or self._cut_start(slot, bank[1])):
                self._end(slot, "Incomplete")
                continue
            if bank is None and self.gone.get(slot) == "Forked":
                continue
            if bank is None or not self._ready(slot, bank[1]):
                break
            k, x = bank
            for key in sorted(x["records"], key=_order):
                out.append(Out("record", slot, k, key, x["records"][key][0]))
            decoded = sum(1 for _, d in x["records"].values() if d)
            counts = {"transaction_count": x["parsed"], "decoded": decoded, "fallback": len(x["records"]) - decoded, **x["stats"]}
            out.append(Out("commit", slot, k, None, None, counts))
            x["flushed"], x["records"] = True, {}
            self.frontier = slot
        return out

    def _drain_accounts(self) -> list[Out]:
        """Accounts in slot order behind a frontier of their own, once their number is frozen and as many are processed."""
        out: list[Out] = []
        for slot in sorted(self.slots):
            bank = self._confirmed(slot)
            if bank is None:
                if self.gone.get(slot) == "Forked":
                    continue
                break
            k, x = bank
            if x["accounts_flushed"]:
                continue
            if x["frozen"] is None or x["processed"] < x["frozen"] or not self._follows(slot, x["parent"], self.account_frontier):
                break
            for key in sorted(x["accounts"], key=_order):
                out.append(Out("account", slot, k, key, x["accounts"][key][0]))
            decoded = sum(1 for _, d in x["accounts"].values() if d)
            counts = {"decoded": decoded, "fallback": len(x["accounts"]) - decoded, "processed": x["processed"], "late": x["late"]}
            out.append(Out("account_commit", slot, k, None, None, counts))
            x["accounts_flushed"], x["accounts"] = True, {}
            self.account_frontier = slot
        return out

    def _confirmed(self, slot: int) -> tuple[int, dict] | None:
        return next(((k, x) for k, x in self.slots[slot].items() if x["confirmed"]), None)

    @staticmethod
    def _overshot(x: dict) -> bool:
        """More entries or transactions than the metadata says: what came can't be trusted."""
        return x["watched"] is not None and (len(x["entries"]) > x["watched"][0] or sum(x["entries"].values()) > x["watched"][1])

    def _cut_start(self, slot: int, x: dict) -> bool:
        return self.whole_start and self.frontier is None and slot == self.first and not (x["created"] and "0" in x["entries"])

    def _ready(self, slot: int, x: dict) -> bool:
        if x["expected"] is None or x["parsed"] < x["expected"]:
            return False
        # a bank that froze early waits for its late entries
        if x["watched"] is not None and [len(x["entries"]), sum(x["entries"].values())] != x["watched"]:
            return False
        return self._follows(slot, x["parent"], self.frontier)

    def _follows(self, slot: int, parent: int | None, frontier: int | None) -> bool:
        if parent is None:
            return False
        if frontier is None:
            return parent < (self.first if self.first is not None else slot) or self.gone.get(parent) == "Incomplete"
        return parent <= frontier or self.gone.get(parent) == "Incomplete"


def _order(key: str) -> tuple:
    """Keys are dotted or colon-separated numbers; others sort as text behind them."""
    parts = key.replace(":", ".").split(".")
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in parts)
