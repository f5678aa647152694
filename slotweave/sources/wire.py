"""Transactions as they go over the wire: signatures and a legacy or versioned message."""

from __future__ import annotations

from slotweave.functions.encoding import short_u16

VOTE_PROGRAM = bytes.fromhex("0761481d357474bb7c4d7624ebd3bdb3d8355e73d11043fc0da3538000000000")


class WireError(ValueError):
    pass


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise WireError(f"{n} bytes wanted at {self.at}, {len(self.data)} there")
        self.at += n
        return self.data[self.at - n : self.at]

    def count(self) -> int:
        try:
            value, n = short_u16(self.data, self.at)
        except ValueError as e:
            raise WireError(str(e)) from e
        self.at += n
        return value


def parse(data: bytes) -> dict:
    """signatures, version (None: legacy), header, static_keys, recent_blockhash, instructions, lookups."""
    c = _Cursor(data)
    signatures = [c.take(64) for _ in range(c.count())]
    first = c.take(1)[0]
    version = first & 0x7F if first & 0x80 else None
    if version not in (None, 0):
        raise WireError(f"no such message version: {version}")
    required = c.take(1)[0] if version is not None else first
    readonly_signed, readonly_unsigned = c.take(2)
    keys = [c.take(32) for _ in range(c.count())]
    blockhash = c.take(32)
    instructions = []
    for _ in range(c.count()):
        program = c.take(1)[0]
        accounts = list(c.take(c.count()))
        instructions.append({"program_id_index": program, "accounts": accounts, "data": c.take(c.count())})
    lookups = []
    if version is not None:
        for _ in range(c.count()):
            table = c.take(32)
            lookups.append({"account_key": table, "writable": list(c.take(c.count())), "readonly": list(c.take(c.count()))})
    if c.at != len(data):
        raise WireError(f"{len(data) - c.at} bytes are left over")
    header = {"required": required, "readonly_signed": readonly_signed, "readonly_unsigned": readonly_unsigned}
    return {"signatures": signatures, "version": version, "header": header, "static_keys": keys, "recent_blockhash": blockhash, "instructions": instructions, "lookups": lookups}


def is_vote(t: dict) -> bool:
    """A legacy message of one or two signatures whose single instruction is the vote program's."""
    if t["version"] is not None or not 1 <= len(t["signatures"]) <= 2 or len(t["instructions"]) != 1:
        return False
    k = t["instructions"][0]["program_id_index"]
    return k < len(t["static_keys"]) and t["static_keys"][k] == VOTE_PROGRAM
