"""Programs that ship with the engine: the token program, its extensions' envelopes, the
upgradeable loader and the stake pool.

Fixed values: tags, names, account lists and layouts are the public interfaces of the programs. ``accounts`` are positions in the
instruction's account list; what is beyond them goes under ``rest``.
"""

from __future__ import annotations

from slotweave.decode.ir import Bool, Bytes, Enum, Items, Key, Node, Num, Option, Prefixed, Sized, Struct, ZeroOption
from slotweave.decode.program import AccountSpec, Kind, Match, Program

U8, U16, U32, U64 = Num("u8"), Num("u16"), Num("u32"), Num("u64")
KEY, TEXT = Key(), Prefixed(U32, Bytes(True))
#: Options of the token program: one byte in instructions, four and padded in accounts.
OPT_KEY, COPT_KEY, COPT_U64 = Option(KEY), Option(KEY, U32, True), Option(U64, U32, True)
SIGNERS = "multisig_signers"


def _ix(tag: int, name: str, accounts: str, args: dict[str, Node] | None = None, rest: str = SIGNERS, tag_type: Num = U8, more: bytes = b"") -> Kind:
    """``accounts``: names in order; a question mark behind a name: optional."""
    specs = tuple(AccountSpec(a.rstrip("?"), a.endswith("?")) for a in accounts.split())
    value = tag_type.pack(tag) + more
    return Kind(name, Struct(tuple((args or {}).items())), (Match(0, value),), specs, len(value), rest)


AMOUNT = {"amount": U64}
CHECKED = {"amount": U64, "decimals": U8}
AUTHORITY = {"authority_type": U8, "new_authority": OPT_KEY}
MINT_ARGS = {"decimals": U8, "mint_authority": KEY, "freeze_authority": OPT_KEY}

TOKEN_INSTRUCTIONS = (
    _ix(0, "InitializeMint", "mint", MINT_ARGS),
    _ix(1, "InitializeAccount", "account mint owner"),
    _ix(2, "InitializeMultisig", "multisig rent", {"m": U8}, "signers"),
    _ix(3, "Transfer", "source destination owner", AMOUNT),
    _ix(4, "Approve", "source delegate owner", AMOUNT),
    _ix(5, "Revoke", "source owner"),
    _ix(6, "SetAuthority", "account current_authority", AUTHORITY),
    _ix(7, "MintTo", "mint account mint_authority", AMOUNT),
    _ix(8, "Burn", "account mint owner", AMOUNT),
    _ix(9, "CloseAccount", "account destination owner"),
    _ix(10, "FreezeAccount", "account mint mint_freeze_authority"),
    _ix(11, "ThawAccount", "account mint mint_freeze_authority"),
    _ix(12, "TransferChecked", "source mint destination owner", CHECKED),
    _ix(13, "ApproveChecked", "source mint delegate owner", CHECKED),
    _ix(14, "MintToChecked", "mint account mint_authority", CHECKED),
    _ix(15, "BurnChecked", "account mint owner", CHECKED),
    _ix(16, "InitializeAccount2", "account mint", {"owner": KEY}),
    _ix(17, "SyncNative", "account"),
    _ix(18, "InitializeAccount3", "account mint", {"owner": KEY}),
    _ix(19, "InitializeMultisig", "multisig", {"m": U8}, "signers"),
    _ix(20, "InitializeMint", "mint", MINT_ARGS),
    _ix(21, "GetAccountDataSize", "mint"),
    _ix(22, "InitializeImmutableOwner", "account"),
    _ix(23, "AmountToUiAmount", "mint", AMOUNT),
    _ix(24, "UiAmountToAmount", "mint", {"ui_amount": Bytes(True)}),
    _ix(38, "WithdrawExcessLamports", "source destination authority"),
    _ix(45, "UnwrapLamports", "source destination authority", {"amount": Option(U64)}),
)

STATE = Enum((("Uninitialized", None), ("Initialized", None), ("Frozen", None)))
MINT = Struct((("mint_authority", COPT_KEY), ("supply", U64), ("decimals", U8), ("is_initialized", Bool()), ("freeze_authority", COPT_KEY)))
TOKEN_ACCOUNT = Struct(
    (
        ("mint", KEY), ("owner", KEY), ("amount", U64), ("delegate", COPT_KEY), ("state", STATE),
        ("is_native", COPT_U64), ("delegated_amount", U64), ("close_authority", COPT_KEY),
    )
)
MULTISIG = Struct((("m", U8), ("n", U8), ("is_initialized", Bool()), ("signers", Items(KEY, 11))))


def _sized(name: str, layout: Struct, size: int) -> Kind:
    return Kind(name, layout, (Match(size=size),))


class _Token(Program):
    """Accounts of a length that no kind has are none of this program's: filtered. Batches nest instructions."""

    BATCH, MAX_DEPTH = 255, 8

    def account(self, data):
        found = super().account(data)
        return ("filtered", None, None, None) if found[1] is None else found

    def instruction(self, data, keys, depth=0):
        if data[:1] != bytes([self.BATCH]):
            return super().instruction(data, keys)
        return self._batch(data[1:], keys, depth)

    def _batch(self, data, keys, depth):
        out, at, used = [], 0, 0
        while at < len(data):
            head = data[at : at + 2]
            if len(head) < 2 or at + 2 + head[1] > len(data) or used + head[0] > len(keys):
                return "error", "Batch", None, "the batch is cut"
            inner, own = data[at + 2 : at + 2 + head[1]], keys[used : used + head[0]]
            at, used = at + 2 + head[1], used + head[0]
            state, kind, value, _ = self.instruction(inner, own, depth + 1) if depth < self.MAX_DEPTH else ("error", None, None, None)
            # an inner instruction that can't be read keeps its place
            out.append({"kind": kind, **value} if state == "parsed" else None)
        return "parsed", "Batch", {"instructions": out, "remaining_accounts": keys[used:]}, None


TOKEN = _Token(
    "token", "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA",
    accounts=(_sized("Mint", MINT, 82), _sized("TokenAccount", TOKEN_ACCOUNT, 165), _sized("Multisig", MULTISIG, 355)),
    instructions=TOKEN_INSTRUCTIONS,
)

# --- token extensions ---------------------------------------------------------------------------

#: Extension types by number, with the layout of those that have a simple one; others stay bytes.
EXTENSIONS: tuple[tuple[str, Node | None], ...] = (
    ("Uninitialized", None),
    ("TransferFeeConfig", Struct((("transfer_fee_config_authority", KEY), ("withdraw_withheld_authority", KEY), ("withheld_amount", U64),
        ("older_transfer_fee", Struct((("epoch", U64), ("maximum_fee", U64), ("transfer_fee_basis_points", U16)))),
        ("newer_transfer_fee", Struct((("epoch", U64), ("maximum_fee", U64), ("transfer_fee_basis_points", U16))))))),
    ("TransferFeeAmount", Struct((("withheld_amount", U64),))),
    ("MintCloseAuthority", Struct((("close_authority", KEY),))),
    ("ConfidentialTransferMint", Struct((("authority", KEY), ("auto_approve_new_accounts", Bool()), ("auditor_elgamal_pubkey", Sized(32, Bytes()))))),
    ("ConfidentialTransferAccount", None),
    ("DefaultAccountState", Struct((("state", STATE),))),
    ("ImmutableOwner", Struct(())),
    ("MemoTransfer", Struct((("require_incoming_transfer_memos", Bool()),))),
    ("NonTransferable", Struct(())),
    ("InterestBearingConfig", Struct((("rate_authority", KEY), ("initialization_timestamp", Num("i64")), ("pre_update_average_rate", Num("i16")),
        ("last_update_timestamp", Num("i64")), ("current_rate", Num("i16"))))),
    ("CpiGuard", Struct((("lock_cpi", Bool()),))),
    ("PermanentDelegate", Struct((("delegate", KEY),))),
    ("NonTransferableAccount", Struct(())),
    ("TransferHook", Struct((("authority", KEY), ("program_id", KEY)))),
    ("TransferHookAccount", Struct((("transferring", Bool()),))),
    ("ConfidentialTransferFeeConfig", None),
    ("ConfidentialTransferFeeAmount", Struct((("withheld_amount", Sized(64, Bytes())),))),
    ("MetadataPointer", Struct((("authority", KEY), ("metadata_address", KEY)))),
    ("TokenMetadata", Struct((("update_authority", KEY), ("mint", KEY), ("name", TEXT), ("symbol", TEXT), ("uri", TEXT),
        ("additional_metadata", Items(Struct((("key", TEXT), ("value", TEXT))), U32))))),
    ("GroupPointer", Struct((("authority", KEY), ("group_address", KEY)))),
    ("TokenGroup", Struct((("update_authority", KEY), ("mint", KEY), ("size", U64), ("max_size", U64)))),
    ("GroupMemberPointer", Struct((("authority", KEY), ("member_address", KEY)))),
    ("TokenGroupMember", Struct((("mint", KEY), ("group", KEY), ("member_number", U64)))),
    ("ConfidentialMintBurn", None),
    ("ScaledUiAmountConfig", Struct((("authority", KEY), ("multiplier", Num("f64")), ("new_multiplier_effective_timestamp", Num("i64")), ("new_multiplier", Num("f64"))))),
    ("PausableConfig", Struct((("authority", KEY), ("paused", Bool())))),
    ("PausableAccount", Struct(())),
)

COMMON_EXT = {
    28: "DefaultAccountState", 30: "MemoTransfer", 33: "InterestBearingMint", 34: "CpiGuard",
    36: "TransferHook", 39: "MetadataPointer", 40: "GroupPointer", 41: "GroupMemberPointer",
}
#: Of these the second tag switches the extension on and off; of the others it initialises and updates.
SWITCHED = (30, 34)


#: Arguments by extension and step; those of the switches have none.
MAYBE_KEY = ZeroOption(KEY)
COMMON_ARGS: dict[str, tuple[dict[str, Node], dict[str, Node]]] = {
    "DefaultAccountState": ({"state": STATE}, {"state": STATE}),
    "InterestBearingMint": ({"rate_authority": MAYBE_KEY, "rate": Num("i16")}, {"rate": Num("i16")}),
    "TransferHook": ({"authority": MAYBE_KEY, "program_id": MAYBE_KEY}, {"program_id": MAYBE_KEY}),
    "MetadataPointer": ({"authority": MAYBE_KEY, "metadata_address": MAYBE_KEY}, {"metadata_address": MAYBE_KEY}),
    "GroupPointer": ({"authority": MAYBE_KEY, "group_address": MAYBE_KEY}, {"group_address": MAYBE_KEY}),
    "GroupMemberPointer": ({"authority": MAYBE_KEY, "member_address": MAYBE_KEY}, {"member_address": MAYBE_KEY}),
}


def _common() -> tuple[Kind, ...]:
    out = []
    for tag, name in COMMON_EXT.items():
        names = ("Enable", "Disable") if tag in SWITCHED else ("Initialize", "Update")
        for sub, what in enumerate(names):
            accounts = "account owner" if tag in SWITCHED else ("mint", "mint extension_authority")[sub]
            out.append(_ix(tag, f"{name}.{what}", accounts, COMMON_ARGS.get(name, ({}, {}))[sub], more=bytes([sub])))
    return tuple(out)


#: An encrypted balance, a public key of the encryption, and the offset of a proof's instruction.
CIPHER, POINT, PROOF = Sized(36, Bytes()), Sized(32, Bytes()), Num("i8")
CONFIDENTIAL_ARGS: dict[str, dict[str, Node]] = {
    "InitializeMint": {"authority": MAYBE_KEY, "auto_approve_new_accounts": Bool(), "auditor_elgamal_pubkey": ZeroOption(POINT)},
    "UpdateMint": {"auto_approve_new_accounts": Bool(), "auditor_elgamal_pubkey": ZeroOption(POINT)},
    "ConfigureAccount": {"decryptable_zero_balance": CIPHER, "maximum_pending_balance_credit_counter": U64, "proof_instruction_offset": PROOF},
    "EmptyAccount": {"proof_instruction_offset": PROOF},
    "Deposit": {"amount": U64, "decimals": U8},
    "Withdraw": {"amount": U64, "decimals": U8, "new_decryptable_available_balance": CIPHER, "equality_proof_instruction_offset": PROOF, "range_proof_instruction_offset": PROOF},
    "ApplyPendingBalance": {"expected_pending_balance_credit_counter": U64, "new_decryptable_available_balance": CIPHER},
    **dict.fromkeys(("ApproveAccount", "EnableConfidentialCredits", "DisableConfidentialCredits", "EnableNonConfidentialCredits", "DisableNonConfidentialCredits", "ConfigureAccountWithRegistry"), {}),
}
#: The program's versions differ in the ciphertexts of these, which stay bytes.
CONFIDENTIAL_RAW = ("Transfer", "TransferWithFee")
CONFIDENTIAL_FEE_ARGS: dict[str, dict[str, Node]] = {
    "InitializeConfidentialTransferFeeConfig": {"authority": MAYBE_KEY, "withdraw_withheld_authority_elgamal_pubkey": POINT},
    "WithdrawWithheldTokensFromMint": {"proof_instruction_offset": PROOF, "new_decryptable_available_balance": CIPHER},
    "WithdrawWithheldTokensFromAccounts": {"num_token_accounts": U8, "proof_instruction_offset": PROOF, "new_decryptable_available_balance": CIPHER},
    **dict.fromkeys(("HarvestWithheldTokensToMint", "EnableHarvestToMint", "DisableHarvestToMint"), {}),
}

FEE = {"transfer_fee_basis_points": U16, "maximum_fee": U64}
EXTENDED_INSTRUCTIONS = (
    *(k for k in TOKEN_INSTRUCTIONS if k.name not in ("WithdrawExcessLamports", "UnwrapLamports", "SetAuthority")),
    _ix(6, "SetAuthority", "account current_authority", AUTHORITY),
    _ix(25, "InitializeMintCloseAuthority", "mint", {"close_authority": OPT_KEY}),
    _ix(26, "TransferFee.InitializeTransferFeeConfig", "mint", {"transfer_fee_config_authority": OPT_KEY, "withdraw_withheld_authority": OPT_KEY, **FEE}, more=b"\0"),
    _ix(26, "TransferFee.TransferCheckedWithFee", "source mint destination owner", {"amount": U64, "decimals": U8, "fee_amount": U64}, more=b"\1"),
    _ix(26, "TransferFee.WithdrawWithheldTokensFromMint", "mint fee_recipient withdraw_withheld_authority", more=b"\2"),
    _ix(26, "TransferFee.WithdrawWithheldTokensFromAccounts", "mint fee_recipient withdraw_withheld_authority", {"num_token_accounts": U8}, "source_accounts_and_signers", more=b"\3"),
    _ix(26, "TransferFee.HarvestWithheldTokensToMint", "mint", None, "source_accounts", more=b"\4"),
    _ix(26, "TransferFee.SetTransferFee", "mint authority", FEE, more=b"\5"),
    *(
        _ix(27, f"ConfidentialTransfer.{n}", a, {"raw": Bytes()} if n in CONFIDENTIAL_RAW else CONFIDENTIAL_ARGS[n], more=bytes([i]))
        for i, (n, a) in enumerate(
            (
                ("InitializeMint", "mint"), ("UpdateMint", "mint authority"), ("ConfigureAccount", "account mint sysvar owner"), ("ApproveAccount", "account mint authority"),
                ("EmptyAccount", "account sysvar owner"), ("Deposit", "account mint owner"), ("Withdraw", "source_account mint destination owner"),
                ("Transfer", "source_account mint destination context_account owner"), ("ApplyPendingBalance", "account owner"),
                ("EnableConfidentialCredits", "account owner"), ("DisableConfidentialCredits", "account owner"), ("EnableNonConfidentialCredits", "account owner"),
                ("DisableNonConfidentialCredits", "account owner"), ("TransferWithFee", "source_account mint destination"), ("ConfigureAccountWithRegistry", "account mint registry"),
            )
        )
    ),
    _ix(29, "Reallocate", "account payer system_program owner", {"extension_types": Items(U16, None)}),
    _ix(31, "CreateNativeMint", "funding_account mint"),
    _ix(32, "InitializeNonTransferableMint", "mint"),
    *_common(),
    _ix(35, "InitializePermanentDelegate", "account", {"delegate": KEY}),
    *(
        _ix(37, f"ConfidentialTransferFee.{n}", a, CONFIDENTIAL_FEE_ARGS[n], r, more=bytes([i]))
        for i, (n, a, r) in enumerate(
            (
                ("InitializeConfidentialTransferFeeConfig", "mint", SIGNERS),
                ("WithdrawWithheldTokensFromMint", "mint fee_recipient sysvar withdraw_withheld_authority", SIGNERS),
                ("WithdrawWithheldTokensFromAccounts", "mint fee_recipient sysvar withdraw_withheld_authority", "source_accounts"),
                ("HarvestWithheldTokensToMint", "mint", "source_accounts"),
                ("EnableHarvestToMint", "mint confidential_transfer_fee_authority", SIGNERS),
                ("DisableHarvestToMint", "account confidential_transfer_fee_authority", SIGNERS),
            )
        )
    ),
    _ix(38, "WithdrawExcessLamports", "source_account destination_account authority"),
)


def _interface(namespace: str, name: str, accounts: str, args: dict[str, Node]) -> Kind:
    """Interfaces beside the program's own tags: eight bytes of the name's hash."""
    import hashlib

    tag = hashlib.sha256(namespace.encode()).digest()[:8]
    specs = tuple(AccountSpec(a) for a in accounts.split())
    return Kind(name, Struct(tuple(args.items())), (Match(0, tag),), specs, 8)


FIELD = Enum((("Name", None), ("Symbol", None), ("Uri", None), ("Key", TEXT)))
INTERFACES = (
    _interface("spl_token_metadata_interface:initialize_account", "TokenMetadata.Initialize", "metadata update_authority mint mint_authority", {"name": TEXT, "symbol": TEXT, "uri": TEXT}),
    _interface("spl_token_metadata_interface:updating_field", "TokenMetadata.UpdateField", "metadata update_authority", {"field": FIELD, "value": TEXT}),
    _interface("spl_token_metadata_interface:remove_key_ix", "TokenMetadata.RemoveKey", "metadata update_authority", {"idempotent": Bool(), "key": TEXT}),
    _interface("spl_token_metadata_interface:update_the_authority", "TokenMetadata.UpdateAuthority", "metadata current_update_authority", {"new_authority": MAYBE_KEY}),
    _interface("spl_token_metadata_interface:emitter", "TokenMetadata.Emit", "metadata", {"start": Option(U64), "end": Option(U64)}),
    _interface("spl_token_group_interface:initialize_token_group", "TokenGroup.InitializeGroup", "group mint mint_authority", {"update_authority": KEY, "max_size": U64}),
    _interface("spl_token_group_interface:update_group_max_size", "TokenGroup.UpdateGroupMaxSize", "group update_authority", {"max_size": U64}),
    _interface("spl_token_group_interface:update_authority", "TokenGroup.UpdateGroupAuthority", "group current_authority", {"new_authority": KEY}),
    _interface("spl_token_group_interface:initialize_member", "TokenGroup.InitializeMember", "member member_mint member_mint_authority group group_update_authority", {}),
)


class _Extended(_Token):
    """Base accounts with a list of extensions behind them: a type byte at 165, then (type, length, data)."""

    BASE, KIND_AT = 165, 165

    def account(self, data):
        if len(data) == 355 or len(data) <= self.BASE:
            return super().account(data)
        what = {1: ("ExtendedMint", MINT), 2: ("ExtendedTokenAccount", TOKEN_ACCOUNT)}.get(data[self.KIND_AT])
        if what is None:
            return "filtered", None, None, None
        from slotweave.decode.ir import DecodeError

        try:
            value, _ = what[1].read(data, 0, self.types)
            value["extensions"] = self.extensions(data[self.KIND_AT + 1 :])
        except DecodeError as e:
            return "error", what[0], None, str(e)
        return "parsed", what[0], value, None

    def extensions(self, data: bytes) -> list[dict]:
        from slotweave.decode.ir import DecodeError, take

        out, at = [], 0
        while at + 4 <= len(data):
            n, size = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 2 : at + 4], "little")
            if n == 0:
                break
            raw = take(data, at + 4, size)
            name, layout = EXTENSIONS[n] if n < len(EXTENSIONS) else (None, None)
            value = None
            if layout is not None:
                try:
                    value = layout.read(raw, 0, self.types)[0]
                except DecodeError:
                    value = None
            out.append({"type": n, "name": name, "value": value, "data": raw.hex()})
            at += 4 + size
        return out


TOKEN_EXTENSIONS = _Extended("token_extensions", "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb", accounts=TOKEN.accounts, instructions=(*EXTENDED_INSTRUCTIONS, *INTERFACES))

# --- upgradeable loader ---------------------------------------------------------------------------


class _Loader(Program):
    """An uninitialised account is none of interest."""

    def account(self, data):
        return ("filtered", None, None, None) if data[:4] == bytes(4) else super().account(data)


def _bincode(tag: int, name: str, accounts: str, args: dict[str, Node] | None = None) -> Kind:
    return _ix(tag, name, accounts, args, "remaining_accounts", U32)


LOADER = _Loader(
    "loader", "BPFLoaderUpgradeab1e11111111111111111111111",
    accounts=(
        Kind("Buffer", Struct((("authority", Option(KEY)), ("data", Bytes()))), (Match(0, U32.pack(1)),), skip=4),
        Kind("Program", Struct((("program_data", KEY),)), (Match(0, U32.pack(2)),), skip=4),
        Kind("ProgramData", Struct((("slot", U64), ("upgrade_authority", Option(KEY)), ("data", Bytes()))), (Match(0, U32.pack(3)),), skip=4),
    ),
    instructions=(
        _bincode(0, "InitializeBuffer", "buffer authority"),
        _bincode(1, "Write", "buffer authority", {"offset": U32, "bytes": Prefixed(U64, Bytes())}),
        _bincode(2, "Deploy", "payer program_data program buffer rent clock system_program authority", {"max_data_len": U64}),
        _bincode(3, "Upgrade", "program_data program buffer spill rent clock authority"),
        _bincode(4, "SetAuthority", "account current_authority new_authority?"),
        _bincode(5, "Close", "close_target recipient authority? program?"),
        _bincode(6, "ExtendProgram", "program_data program system_program? payer?", {"additional_bytes": U32}),
        _bincode(7, "SetAuthorityChecked", "account current_authority new_authority"),
    ),
)

# --- stake pool ---------------------------------------------------------------------------------------

RATE = Struct((("denominator", U64), ("numerator", U64)))
STAKE = {"lamports": U64, "transient_stake_seed": U64}
EPHEMERAL = {**STAKE, "ephemeral_stake_seed": U64}
META = {"name": TEXT, "symbol": TEXT, "uri": TEXT}
FEE_TYPE = Enum(
    (
        ("SolReferral", U8), ("StakeReferral", U8), ("Epoch", RATE), ("StakeWithdrawal", RATE),
        ("SolDeposit", RATE), ("StakeDeposit", RATE), ("SolWithdrawal", RATE),
    )
)
VALIDATOR_TYPE = Enum((("Deposit", None), ("Withdraw", None)))
FUNDING = Enum((("StakeDeposit", None), ("SolDeposit", None), ("SolWithdraw", None)))
_DEPOSIT = "stake_pool validator_list_storage stake_pool_deposit_authority stake_pool_withdraw_authority deposit_stake_address validator_stake_account reserve_stake_account pool_tokens_to manager_fee_account referrer_pool_tokens_account pool_mint clock sysvar_stake_history token_program stake_program"
_WITHDRAW = "stake_pool validator_list_storage stake_pool_withdraw stake_to_split stake_to_receive user_stake_authority user_transfer_authority user_pool_token_account manager_fee_account pool_mint clock token_program stake_program"
_DEPOSIT_SOL = "stake_pool stake_pool_withdraw_authority reserve_stake_account lamports_from pool_tokens_to manager_fee_account referrer_pool_tokens_account pool_mint system_program token_program deposit_authority?"
_WITHDRAW_SOL = "stake_pool stake_pool_withdraw_authority user_transfer_authority pool_tokens_from reserve_stake_account lamports_to manager_fee_account pool_mint clock sysvar_stake_history stake_program token_program sol_withdraw_authority?"
_MORE = "remaining_accounts"

FUTURE = Enum((("None", None), ("One", RATE), ("Two", RATE)))
STAKE_POOL_LAYOUT = Struct(
    (
        ("manager", KEY), ("staker", KEY), ("stake_deposit_authority", KEY), ("stake_withdraw_bump_seed", U8), ("validator_list", KEY),
        ("reserve_stake", KEY), ("pool_mint", KEY), ("manager_fee_account", KEY), ("token_program_id", KEY), ("total_lamports", U64),
        ("pool_token_supply", U64), ("last_update_epoch", U64),
        ("lockup", Struct((("unix_timestamp", Num("i64")), ("epoch", U64), ("custodian", KEY)))),
        ("epoch_fee", RATE), ("next_epoch_fee", FUTURE), ("preferred_deposit_validator_vote_address", Option(KEY)),
        ("preferred_withdraw_validator_vote_address", Option(KEY)), ("stake_deposit_fee", RATE), ("stake_withdrawal_fee", RATE),
        ("next_stake_withdrawal_fee", FUTURE), ("stake_referral_fee", U8), ("sol_deposit_authority", Option(KEY)), ("sol_deposit_fee", RATE),
        ("sol_referral_fee", U8), ("sol_withdraw_authority", Option(KEY)), ("sol_withdrawal_fee", RATE), ("next_sol_withdrawal_fee", FUTURE),
        ("last_epoch_pool_token_supply", U64), ("last_epoch_total_lamports", U64),
    )
)
VALIDATOR = Struct(
    (
        ("active_stake_lamports", U64), ("transient_stake_lamports", U64), ("last_update_epoch", U64), ("transient_seed_suffix", U64),
        ("unused", U32), ("validator_seed_suffix", U32), ("status", U8), ("vote_account_address", KEY),
    )
)

STAKE_POOL = Program(
    "stake_pool", "SPoo1Ku8WFXoNDMHPsrGSTSG1Y47rzgn41SLUNakuHy",
    accounts=(
        Kind("StakePool", STAKE_POOL_LAYOUT, (Match(0, b"\1"),), skip=1),
        Kind("ValidatorList", Struct((("max_validators", U32), ("validators", Items(VALIDATOR, U32)))), (Match(0, b"\2"),), skip=1),
    ),
    instructions=(
        _ix(0, "Initialize", "stake_pool manager staker stake_pool_withdraw_authority validator_list reserve_stake pool_mint manager_pool_account token_program deposit_authority?",
            {"fee": RATE, "withdrawal_fee": RATE, "deposit_fee": RATE, "referral_fee": U8, "max_validators": U32}, _MORE),
        _ix(1, "AddValidatorToPool", "stake_pool staker funder stake_pool_withdraw validator_list stake validator rent clock sysvar_stake_history stake_config system_program stake_program", {"raw_validator_seed": U32}, _MORE),
        _ix(2, "RemoveValidatorFromPool", "stake_pool staker stake_pool_withdraw validator_list stake_account transient_stake_account clock stake_program", None, _MORE),
        _ix(3, "DecreaseValidatorStake", "stake_pool staker stake_pool_withdraw_authority validator_list validator_stake transient_stake clock rent system_program stake_program", STAKE, _MORE),
        _ix(4, "IncreaseValidatorStake", "stake_pool staker stake_pool_withdraw_authority validator_list reserve_stake transient_stake validator_stake validator clock rent sysvar_stake_history stake_config system_program stake_program", STAKE, _MORE),
        _ix(5, "SetPreferredValidator", "stake_pool_address staker validator_list_address", {"validator_type": VALIDATOR_TYPE, "validator_vote_address": OPT_KEY}, _MORE),
        _ix(6, "UpdateValidatorListBalance", "stake_pool stake_pool_withdraw_authority validator_list_address reserve_stake clock sysvar_stake_history stake_program", {"start_index": U32, "no_merge": Bool()}, _MORE),
        _ix(7, "UpdateStakePoolBalance", "stake_pool withdraw_authority validator_list_storage reserve_stake manager_fee_account stake_pool_mint token_program", None, _MORE),
        _ix(8, "CleanupRemovedValidatorEntries", "stake_pool validator_list_storage", None, _MORE),
        _ix(9, "DepositStake", _DEPOSIT, None, _MORE),
        _ix(10, "WithdrawStake", _WITHDRAW, AMOUNT, _MORE),
        _ix(11, "SetManager", "stake_pool manager new_manager new_fee_receiver", None, _MORE),
        _ix(12, "SetFee", "stake_pool manager", {"fee": FEE_TYPE}, _MORE),
        _ix(13, "SetStaker", "stake_pool set_staker_authority new_staker", None, _MORE),
        _ix(14, "DepositSol", _DEPOSIT_SOL, AMOUNT, _MORE),
        _ix(15, "SetFundingAuthority", "stake_pool manager auth?", {"funding_type": FUNDING}, _MORE),
        _ix(16, "WithdrawSol", _WITHDRAW_SOL, AMOUNT, _MORE),
        _ix(17, "CreateTokenMetadata", "stake_pool manager stake_pool_withdraw_authority pool_mint payer token_metadata mpl_token_metadata system_program", META, _MORE),
        _ix(18, "UpdateTokenMetadata", "stake_pool manager stake_pool_withdraw_authority token_metadata mpl_token_metadata", META, _MORE),
        _ix(19, "IncreaseAdditionalValidatorStake", "stake_pool staker stake_pool_withdraw_authority validator_list reserve_stake ephemeral_stake transient_stake validator_stake validator clock stake_history stake_config system_program stake_program", EPHEMERAL, _MORE),
        _ix(20, "DecreaseAdditionalValidatorStake", "stake_pool staker stake_pool_withdraw_authority validator_list reserve_stake validator_stake ephemeral_stake transient_stake clock stake_history system_program stake_program", EPHEMERAL, _MORE),
        _ix(21, "DecreaseValidatorStakeWithReserve", "stake_pool staker stake_pool_withdraw_authority validator_list reserve_stake validator_stake transient_stake clock stake_history system_program stake_program", STAKE, _MORE),
        _ix(23, "DepositStakeWithSlippage", _DEPOSIT, {"minimum_pool_tokens_out": U64}, _MORE),
        _ix(24, "WithdrawStakeWithSlippage", _WITHDRAW, {"pool_tokens_in": U64, "minimum_lamports_out": U64}, _MORE),
        _ix(25, "DepositSolWithSlippage", _DEPOSIT_SOL, {"lamports_in": U64, "minimum_pool_tokens_out": U64}, _MORE),
        _ix(26, "WithdrawSolWithSlippage", _WITHDRAW_SOL, {"pool_tokens_in": U64, "minimum_lamports_out": U64}, _MORE),
    ),
)

PROGRAMS = {p.name: p for p in (TOKEN, TOKEN_EXTENSIONS, LOADER, STAKE_POOL)}
BY_ADDRESS = {p.address: p for p in PROGRAMS.values()}
