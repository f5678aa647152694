"""Dispatch: several parsers per row, tri-state outcomes, fallback records, keys and headers.

An outcome is a struct (outcome, kind, payload, error) with outcome ``parsed``, ``filtered``
or ``error``. Errors are data: a row that can't be decoded never fails its task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSED, FILTERED, ERROR = "parsed", "filtered", "error"


def outcome(state: str | Column, kind=None, payload=None, error=None) -> Column:
    text = lambda x: (F.lit(x) if isinstance(x, str) or x is None else x).cast("string")
    return F.struct(text(state).alias("outcome"), text(kind).alias("kind"), text(payload).alias("payload"), text(error).alias("error"))


@dataclass(frozen=True)
class Parser:
    """``program``: the key it parses; ``result``: an outcome Column over the row."""

    name: str
    program: object
    result: Column
    topic: str
    fallback: str | None = None


class DuplicateParser(ValueError):
    pass


class Registry:
    """Parsers in order. Names are unique; several may serve one program."""

    def __init__(self, key: str = "program"):
        self.key, self.parsers = key, []

    def register(self, parser: Parser) -> Registry:
        if any(p.name == parser.name for p in self.parsers):
            raise DuplicateParser(parser.name)
        self.parsers.append(parser)
        return self

    def dispatch(self, df: DataFrame) -> DataFrame:
        """Adds outcome, kind, payload, error, parser, topic, fallback.

        The first parser of the row's program that parses wins. Else the row goes to the
        fallback topic of the first parser of its program that failed and has one; else it
        is ``error`` if any failed, and ``filtered`` otherwise. Only parsers of the row's
        own program are evaluated.
        """
        nothing = F.lit(None).cast("struct<rank:int,outcome:string,kind:string,payload:string,error:string,parser:string,topic:string,fallback:boolean>")
        tried = []
        for p in self.parsers:
            r = p.result
            state = r["outcome"]
            falls = (state == ERROR) & F.lit(p.fallback is not None)
            rank = F.when(state == PARSED, 0).when(falls, 1).when(state == ERROR, 2).otherwise(3)
            topic = F.when(state == PARSED, p.topic).when(falls, F.lit(p.fallback))
            row = F.struct(
                rank.alias("rank"), state.alias("outcome"), r["kind"].alias("kind"), r["payload"].alias("payload"), r["error"].alias("error"),
                F.lit(p.name).alias("parser"), topic.alias("topic"), falls.alias("fallback"),
            )
            tried.append(F.when(F.col(self.key) == F.lit(p.program), row).otherwise(nothing))
        if not tried:
            best = nothing
        else:
            # in order of registration, the first of the least rank
            best = reduce(lambda a, b: F.when(b.isNull() | (a["rank"] <= b["rank"]), a).otherwise(b), tried)
        out = df.withColumn("_best", best)
        names = ("outcome", "kind", "payload", "error", "parser", "topic", "fallback")
        out = out.select(*df.columns, *[F.col(f"_best.{n}").alias(n) for n in names])
        return out.fillna(FILTERED, ["outcome"]).fillna(False, ["fallback"])


def handled(dispatched: DataFrame, handlers: dict[str, Column]) -> DataFrame:
    """Adds ``handler_errors``, array<struct<handler, error>>, of parsed rows.

    ``handlers``: by name a Column that is null where the handler took the row, else its
    error. All of them see every parsed row, and all their errors are kept.
    """
    failed = [F.when((F.col("outcome") == PARSED) & c.isNotNull(), F.struct(F.lit(n).alias("handler"), c.cast("string").alias("error"))) for n, c in handlers.items()]
    none = F.array().cast("array<struct<handler:string,error:string>>")
    return dispatched.withColumn("handler_errors", F.array_compact(F.array(*failed)) if failed else none)


#: Lookup tables of more rows are joined by a shuffle.
BROADCAST_ROWS = 100_000


def routed(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows with the parser names of their key: one row per (row, parser). ``keys``: on, parser.

    The lookup table is broadcast only if it is counted to be small.
    """
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, on)


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def instruction_key(slot="slot", signature="signature", ix="ix_index") -> Column:
    return F.concat_ws(":", text(slot), text(signature), text(ix))


def account_key(slot="slot", pubkey="pubkey", version="write_version") -> Column:
    return F.concat_ws(":", text(slot), text(pubkey), text(version))


def headers(*names: str, **more: Column) -> Column:
    """array<struct<key, value>> of the named columns; nulls are left out."""
    both = {n: F.col(n) for n in names} | more
    each = [F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), text(c).alias("value"))) for n, c in both.items()]
    return F.array_compact(F.array(*each))


def records(dispatched: DataFrame, key: Column, head: Column, raw: Column) -> DataFrame:
    """topic, key, value, headers, is_decoded, kind of rows that have a topic; fallback rows carry ``raw``."""
    decoded = F.col("outcome") == PARSED
    extra = F.array_compact(F.array(F.when(~decoded & F.col("error").isNotNull(), F.struct(F.lit("parse_error").alias("key"), F.col("error").alias("value")))))
    return dispatched.where("topic is not null").select(
        "topic", key.alias("key"), F.when(decoded, F.col("payload")).otherwise(raw).alias("value"), F.concat(head, extra).alias("headers"), decoded.alias("is_decoded"), "kind"
    )


def raw_instruction() -> Column:
    """An undecoded instruction as JSON: the fallback record's value. Null fields are left out."""
    b58 = lambda c: F.hex(c)  # noqa: E731  (keys stay hex here: base58 is for display)
    return F.to_json(
        F.struct(
            text("slot").alias("slot"), b58("signature").alias("signature"), "ix_index", b58("program").alias("program"),
            F.transform("accounts", b58).alias("accounts"), F.base64("data").alias("data"), F.col("error").alias("parse_error"),
        )
    )


def raw_account() -> Column:
    """An undecoded account as JSON."""
    return F.to_json(
        F.struct(
            text("slot").alias("slot"), F.hex("pubkey").alias("pubkey"), F.hex("owner").alias("owner"), text("lamports").alias("lamports"),
            text("write_version").alias("write_version"), F.base64("data").alias("data"), F.col("error").alias("parse_error"),
        )
    )


def marker(kind: str, *counts: str) -> Column:
    """A commit marker as JSON: slot, blockhash if there is one, counters. Watermarks have no counters."""
    return F.to_json(F.struct(F.lit(kind).alias("marker"), "slot", *counts))


def metrics(dispatched: DataFrame, kind: str | Column) -> DataFrame:
    """Counters by update kind: received, parsed, filtered, parse errors, fallbacks."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return dispatched.groupBy(k.alias("update")).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("outcome") == PARSED).alias("parsed"),
        F.count_if(F.col("outcome") == FILTERED).alias("filtered"),
        F.count_if(F.col("outcome") == ERROR).alias("errors"),
        F.count_if(F.col("fallback")).alias("fallbacks"),
    )


def observed(df: DataFrame, name: str) -> DataFrame:
    """The same counters beside a running query, as observed metrics."""
    return df.observe(name, F.count(F.lit(1)).alias("received"), F.count_if(F.col("outcome") == PARSED).alias("parsed"), F.count_if(F.col("outcome") == ERROR).alias("errors"))
