"""The predicate algebra: merge tables, validation limits, compiled columns."""

import base64

import pytest
from pyspark.sql import functions as F

from slotweave.functions.encoding import b58encode
from slotweave.operators.prefilter import (
    ALL_OWNERS, BALANCE_CHANGED, AccountPart, BlockFooterPart, BlockPart, DataSize, DataSlice, Filters, Lamports, Memcmp, Prefilter, PrefilterError, SlotPart, TokenAccountState, TransactionPart,
    validate_filters,
)

S = frozenset


@pytest.mark.parametrize("field", ["accounts", "owners", "members"])
def test_account_key_sets_unite(field):
    a, b = AccountPart(**{field: S({"a", "b"})}), AccountPart(**{field: S({"b", "c"})})
    assert getattr(a.merge(b), field) == {"a", "b", "c"}


def test_account_filters_survive_only_as_equal_multisets():
    x, y = DataSize(5), Lamports("gt", 1)
    assert AccountPart(filters=(x, y)).merge(AccountPart(filters=(y, x))).filters == (x, y)
    assert AccountPart(filters=(x,)).merge(AccountPart(filters=(x, x))).filters == ()
    assert AccountPart(filters=(x,)).merge(AccountPart()).filters == ()


@pytest.mark.parametrize("a,b,want", [(True, True, True), (True, False, None), (True, None, None), (None, None, None)])
def test_signature_choice_widens(a, b, want):
    assert AccountPart(nonempty_txn_signature=a).merge(AccountPart(nonempty_txn_signature=b)).nonempty_txn_signature is want


def test_transaction_merge():
    a = TransactionPart(include=S("ab"), required=S("r"), exclude=S("xy"), vote=True, signature="s", failed=False)
    b = TransactionPart(include=S("c"), required=S("q"), exclude=S("yz"), vote=False, signature="s", failed=True)
    m = a.merge(b)
    assert (m.include, m.required, m.exclude) == (S("abc"), S("rq"), S("y"))
    assert (m.vote, m.signature, m.failed) == (None, "s", None)
    assert a.merge(a) == a


@pytest.mark.parametrize(
    "a,b,want,cleared",
    [(None, None, None, False), (ALL_OWNERS, None, ALL_OWNERS, True), (None, BALANCE_CHANGED, BALANCE_CHANGED, True), (ALL_OWNERS, BALANCE_CHANGED, ALL_OWNERS, True), (ALL_OWNERS, ALL_OWNERS, ALL_OWNERS, False)],
)
def test_owner_modes_widen_and_clear_exclusion(a, b, want, cleared):
    m = TransactionPart(exclude=S("x"), token_accounts=a).merge(TransactionPart(exclude=S("x"), token_accounts=b))
    assert m.token_accounts == want and m.exclude == (S() if cleared else S("x"))


@pytest.mark.parametrize("a,b,want", [(None, None, None), (True, None, True), (None, False, False), (False, True, True)])
def test_slot_merge(a, b, want):
    assert SlotPart(True, a).merge(SlotPart(False, b)) == SlotPart(False, want)


def test_other_parts_merge():
    assert BlockFooterPart(False).merge(BlockFooterPart(True)).include_certificates
    assert BlockPart(include_entries=False).merge(BlockPart()).include_entries is False
    p = Prefilter(slot=SlotPart()).merge(Prefilter(account=AccountPart(owners=S("o"))))
    assert p.slot and p.account and not p.transaction
    assert Prefilter.union([]) == Prefilter()


@pytest.mark.parametrize(
    "bad",
    [
        Memcmp(0, b""), Memcmp(0, bytes(129)), Memcmp(0, "0OIl", "base58"), Memcmp(0, "1" * 176, "base58"), Memcmp(0, "A" * 176, "base64"),
        Memcmp(0, "QQ=", "base64"), Memcmp(0, "QR==", "base64"), TokenAccountState(False), Lamports("ge", 1),
    ],
)
def test_bad_filters(bad):
    with pytest.raises(PrefilterError):
        bad.validate()


def test_good_filters():
    Memcmp(3, bytes(128)).validate()
    assert Memcmp(0, b58encode(b"abc"), "base58").decoded() == b"abc"
    assert Memcmp(0, base64.b64encode(b"xyz").decode(), "base64").decoded() == b"xyz"


def test_filter_lists():
    assert len(validate_filters([DataSize(1)] * 9)) == 1  # repeats go first
    with pytest.raises(PrefilterError):
        validate_filters([Lamports("gt", i) for i in range(5)])
    with pytest.raises(PrefilterError):
        validate_filters([DataSize(1), DataSize(2)])


@pytest.mark.parametrize("bad", [[DataSlice(0, 0)], [DataSlice(2**64 - 1, 1)], [DataSlice(5, 1), DataSlice(0, 1)], [DataSlice(0, 4), DataSlice(3, 1)]])
def test_bad_slices(bad):
    with pytest.raises(PrefilterError):
        DataSlice.validate_all(bad)


def test_builder():
    b = Prefilter.builder().accounts({"a"}).accounts({"b"}).account_filters([DataSize(1), DataSize(2)])
    with pytest.raises(PrefilterError, match="already set"):  # the first error stays
        b.build()
    assert Prefilter.builder().build() == Prefilter()
    p = Prefilter.builder().accounts({"a"}).accounts_include_all().account_filters([DataSize(1)]).build()
    assert p.account == AccountPart(filters=(DataSize(1),))
    assert Prefilter.builder().slot_interslot_updates(True).build().slot == SlotPart(False, True)
    assert Prefilter.builder().slots().build().slot == SlotPart()
    assert Prefilter.builder().block_footers(True).build().block_footer.include_certificates


def test_filters_by_id():
    f = Filters({"p": Prefilter(slot=SlotPart())})
    with pytest.raises(KeyError):
        f.update("q", Prefilter())
    assert not f.update("p", Prefilter(slot=SlotPart()))
    assert f.merge("p", Prefilter(account=AccountPart(owners=S("o"))))
    assert f.reset() and not f.reset()


@pytest.fixture(scope="module")
def accounts(spark):
    token = bytearray(165)
    token[108] = 1
    rows = [(b"k1", b"o1", b"abcdef", 5, b"s"), (b"k2", b"o2", bytes(token), 7, None), (b"k3", b"o1", b"", 9, None)]
    return spark.createDataFrame(rows, "pubkey binary, owner binary, data binary, lamports bigint, txn_signature binary")


@pytest.mark.parametrize(
    "part,want",
    [
        (AccountPart(), "k1 k2 k3"), (AccountPart(owners=S({b"o1"})), "k1 k3"), (AccountPart(accounts=S({b"k1"}), members=S({b"k2"})), "k1 k2"),
        (AccountPart(filters=(Memcmp(2, b"cd"),)), "k1"), (AccountPart(filters=(DataSize(165), TokenAccountState())), "k2"),
        (AccountPart(filters=(Lamports("ne", 7), Lamports("gt", 5))), "k3"), (AccountPart(nonempty_txn_signature=True), "k1"), (AccountPart(nonempty_txn_signature=False), "k2 k3"),
    ],
)
def test_account_columns(accounts, part, want):
    for df in (accounts.where(part.column()), part.apply(accounts)):
        assert " ".join(sorted(bytes(r.pubkey).decode() for r in df.collect())) == want


def test_long_key_lists_join(accounts):
    part = AccountPart(accounts=S({b"k1", b"k3", *(b"x%d" % i for i in range(2000))}))
    df = part.apply(accounts)
    assert "LeftSemi" in df._jdf.queryExecution().toString()
    assert df.count() == 2


def test_transaction_columns(spark):
    rows = [(1, ["a", "b"], False, False), (2, ["b", "c"], True, False), (3, ["c"], False, True), (4, [], False, False)]
    t = spark.createDataFrame(rows, "signature int, account_keys array<string>, is_vote boolean, failed boolean")
    got = lambda p: sorted(r.signature for r in t.where(p.column()).collect())
    assert got(TransactionPart()) == [1, 2, 4]
    assert got(TransactionPart(failed=None)) == [1, 2, 3, 4]
    assert got(TransactionPart(include=S("c"), failed=None)) == [2, 3]
    assert got(TransactionPart(required=S("bc"), failed=None)) == [2]
    assert got(TransactionPart(include=S("b"), exclude=S("a"), failed=None)) == [2]
    assert got(TransactionPart(vote=True)) == [2]


def test_slot_and_block_parts(spark):
    s = spark.createDataFrame([(x,) for x in ("processed", "confirmed", "dead", "completed")], "status string")
    n = lambda p: s.where(p.column("confirmed")).count()
    assert (n(SlotPart()), n(SlotPart(False)), n(SlotPart(False, True))) == (1, 2, 4)
    b = spark.createDataFrame([(1, [(["a"],), (["b"],)], [1], [2])], "slot int, transactions array<struct<account_keys:array<string>>>, accounts array<int>, entries array<int>")
    out = BlockPart(accounts_include=S("a"), include_transactions=True).project(b)
    assert out.columns == ["slot", "transactions"] and len(out.first().transactions) == 1


def test_shared_scan(spark):
    t = spark.createDataFrame([(1, ["a"], False), (2, ["b"], True), (3, ["c"], False)], "signature int, account_keys array<string>, failed boolean")
    f = Filters({"x": Prefilter(transaction=TransactionPart(include=S("a"))), "y": Prefilter(transaction=TransactionPart(include=S("ab"), failed=None)), "z": Prefilter(slot=SlotPart())})
    assert {(r.signature, tuple(r.filters)) for r in f.routed(t, "transaction").collect()} == {(1, ("x", "y")), (2, ("y",))}
    assert f.routed(t, "account").count() == 0


def test_slices(spark):
    d = spark.createDataFrame([(b"0123456789",)], "data binary")
    assert bytes(d.select(DataSlice.column([DataSlice(1, 2), DataSlice(8, 9)])).first()[0]) == b"1289"
    assert d.select(F.lit(1)).count() == 1


def test_null_keys_and_owners(spark):
    """A null owner or key hides nothing: the transaction is judged by its other keys."""
    kind = "signature int, account_keys array<string>, token_balances array<struct<owner:string,pre:bigint,post:bigint>>, failed boolean, is_vote boolean"
    rows = [(1, ["a"], [(None, 1, 2)], False, False), (2, ["a", None], [("x", 1, 2)], False, False), (3, ["a"], None, False, False), (4, None, None, False, False), (5, ["b"], [], False, False)]
    df = spark.createDataFrame(rows, kind)
    got = lambda **k: sorted(r.signature for r in df.where(TransactionPart(**k).column()).collect())
    for mode in (None, "all", "balance_changed"):
        assert got(exclude=frozenset({"b"}), token_accounts=mode) == [1, 2, 3, 4]
        assert got(include=frozenset({"a"}), token_accounts=mode) == [1, 2, 3]
        assert got(required=frozenset({"a"}), token_accounts=mode) == [1, 2, 3]
    assert got(exclude=frozenset({"x"}), token_accounts="all") == [1, 3, 4, 5]
