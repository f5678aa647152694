"""StructTypes of the update kinds. u64 values are DECIMAL(20, 0); recursion is rows with paths."""

from __future__ import annotations

from pyspark.sql import types as T

U64, I64, INT, TEXT, BYTES, FLAG = T.DecimalType(20, 0), T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def list_of(t: T.DataType) -> T.ArrayType:
    return T.ArrayType(t)


ACCOUNT = struct(
    slot=U64, bank_id=U64, is_startup=FLAG, pubkey=BYTES, owner=BYTES, lamports=U64, executable=FLAG, rent_epoch=U64,
    write_version=U64, data=BYTES, txn_signature=BYTES,
)
_CALL = {"program_id_index": INT, "accounts": list_of(INT), "data": BYTES}
TRANSACTION = struct(
    slot=U64, bank_id=U64, signature=BYTES, is_vote=FLAG, tx_index=U64, failed=FLAG, err=TEXT,
    static_keys=list_of(BYTES), loaded_writable=list_of(BYTES), loaded_readonly=list_of(BYTES),
    instructions=list_of(struct(**_CALL)),
    inner_instructions=list_of(struct(index=INT, instructions=list_of(struct(**_CALL, stack_height=INT)))),
    log_messages=list_of(TEXT), fee=U64, compute_units=U64,
    token_balances=list_of(struct(owner=BYTES, mint=BYTES, pre=U64, post=U64)),
)
INSTRUCTION = struct(
    slot=U64, bank_id=U64, signature=BYTES, tx_index=U64, is_vote=FLAG, failed=FLAG, program=BYTES, accounts=list_of(BYTES), data=BYTES,
    path=list_of(INT), flat_path=list_of(INT), ix_index=TEXT, log_start=INT, log_end=INT, fee_payer=BYTES,
)
BLOCK_META = struct(
    slot=U64, bank_id=U64, parent_slot=U64, blockhash=TEXT, parent_blockhash=TEXT, block_time=I64, block_height=U64,
    executed_transaction_count=U64, entries_count=U64,
    rewards=list_of(struct(pubkey=TEXT, lamports=I64, post_balance=U64, reward_type=INT, commission=TEXT)),
)
BLOCK_FOOTER = struct(slot=U64, bank_id=U64, certificates=list_of(BYTES))
BLOCK = T.StructType([*BLOCK_META.fields, *struct(transactions=list_of(TRANSACTION), accounts=list_of(ACCOUNT)).fields])
SLOT = struct(slot=U64, parent=U64, bank_id=U64, status=TEXT, dead_error=TEXT)
ENTRY = struct(slot=U64, bank_id=U64, index=U64, hash=BYTES, executed_transaction_count=U64)
RECORD = struct(topic=TEXT, key=TEXT, value=BYTES, headers=list_of(struct(key=TEXT, value=BYTES)), is_decoded=FLAG, kind=TEXT)

KINDS = {
    "account": ACCOUNT, "transaction": TRANSACTION, "instruction": INSTRUCTION, "block_meta": BLOCK_META,
    "block_footer": BLOCK_FOOTER, "block": BLOCK, "slot": SLOT, "entry": ENTRY,
}

#: Slot statuses in the order of finality; the others are events between slots.
COMMITMENTS = ("processed", "confirmed", "finalized")
INTERSLOT = ("first_shred_received", "created_bank", "completed", "dead")
