"""Paths, flat indices, account resolution and log slices."""

import pytest
from pyspark.sql import functions as F

from slotweave.operators import flatten
from slotweave.schema import TRANSACTION


@pytest.mark.parametrize(
    "heights,want",
    [
        ([2, 2, 3, 3, 2], "3.1 3.2 3.2.1 3.2.2 3.3"), ([2], "3.1"), ([2, 3, 4, 2], "3.1 3.1.1 3.1.1.1 3.2"), ([2, 3, 4, 3], "3.1 3.1.1 3.1.1.1 3.1.2"),
        ([None, None], "3.1 3.2"), ([2, None, 3], "3.1 3.2 3.3"), ([3, 3], "3.1 3.2"), ([], ""),
    ],
)
def test_paths(spark, heights, want):
    df = spark.createDataFrame([(heights,)], "h array<int>")
    p = flatten.paths(F.col("h"), F.lit(2))
    assert df.select(F.array_join(F.transform(p, flatten.path_text), " ")).first()[0] == want


def test_relations(spark):
    rows = [([1], [1, 0], True, True), ([1], [1, 0, 2], False, True), ([1], [1], False, False), ([2], [1, 0], False, False)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, p boolean, q boolean")
    for r in df.select("p", "q", flatten.is_parent(F.col("a"), F.col("b")).alias("x"), flatten.is_ancestor(F.col("a"), F.col("b")).alias("y")).collect():
        assert (r.p, r.q) == (r.x, r.y)


LOGS = [
    "Program A invoke [1]", "Program log: Program B invoke [1]", "Program B invoke [2]", "Program B consumed 5", "Program B success", "Program C invoke [2]",
    "Program C failed: oops", "Program A success", "Program data: AAAA", "Program D invoke [1]", "Program return: D x", "Program E invoke [2]",
]


def test_line_kinds(spark):
    df = spark.createDataFrame([(LOGS,)], "l array<string>")
    k, d = df.select(flatten.line_kinds(F.col("l")), flatten.depths(F.col("l"))).first()
    assert k == ["invoke", "other", "invoke", "other", "close", "invoke", "close", "close", "other", "invoke", "other", "invoke"]
    assert d == [1, 1, 2, 2, 2, 2, 2, 1, 0, 1, 1, 2]


def test_split_and_direct(spark):
    df = spark.createDataFrame([(LOGS,)], "l array<string>")
    parts = df.select(flatten.split_outer(F.col("l"))).first()[0]
    assert [len(p) for p in parts] == [8, 3]
    own = spark.createDataFrame([(parts[0],)], "l array<string>").select(flatten.direct_lines(F.col("l"))).first()[0]
    assert own == [LOGS[0], LOGS[1], LOGS[7]]


def test_slices():
    tree = [(0,), (0, 0), (0, 1), (1,), (1, 0)]
    assert flatten.assign(LOGS, list("ABCDE"), tree) == [(0, 8), (2, 5), (5, 7), (9, 12), (11, 12)]
    # an outer call that writes nothing leaves the next line to the next call
    assert flatten.assign(LOGS[9:], ["P", "D"], [(0,), (1,)]) == [None, (0, 3)]
    assert flatten.assign([], ["A"], [(0,)]) == [None]


def test_log_slices_column(spark):
    df = spark.createDataFrame([(LOGS, list("AB"), [[0], [0, 0]])], "l array<string>, p array<string>, t array<array<int>>")
    out = df.select(flatten.log_slices(F.col("l"), F.col("p"), F.col("t"))).first()[0]
    assert [(x.log_start, x.log_end) for x in out] == [(0, 8), (2, 5)]


def test_slices_of_deep_calls():
    """One pass over the lines, without recursion: the tree may be deeper than Python's stack."""
    n = 5000
    logs = ["Program A invoke [1]", *[f"Program A invoke [{i}]" for i in range(2, n + 1)], *["Program A success"] * n]
    tree = [(0,) * i for i in range(1, n + 1)]
    assert flatten.assign(logs, ["A"] * n, tree) == [(i, 2 * n - i) for i in range(n)]
    # unclosed calls reach the log's end
    assert flatten.assign(logs[: n + 1], ["A"] * n, tree)[-2:] == [(n - 2, n + 1), (n - 1, n + 1)]


def test_log_slices_rows(spark):
    """Rows of one batch don't touch each other; absent lists are empty ones, absent lines and programs are none."""
    rows = [(LOGS, list("AB"), [[0], [0, 0]]), (None, ["A"], [[0]]), (LOGS[9:], ["P", "D"], [[0], [1]]), ([None, *LOGS[9:]], ["D"], [[0]]), (LOGS, None, [[0]]), ([], [], [])]
    df = spark.createDataFrame(rows, "l array<string>, p array<string>, t array<array<int>>").coalesce(1)
    out = [[x and tuple(x) for x in r[0]] for r in df.select(flatten.log_slices(F.col("l"), F.col("p"), F.col("t"))).collect()]
    assert out == [[(0, 8), (2, 5)], [None], [None, (0, 3)], [(1, 4)], [None], []]


def test_instructions(spark):
    key = lambda i: bytes([i]) * 32
    ix = lambda p, a: {"program_id_index": p, "accounts": a, "data": b"d"}
    inner = [{"index": 1, "instructions": [ix(0, [1]) | {"stack_height": h} for h in (2, 3, 2)]}]
    base = dict.fromkeys(TRANSACTION.names)
    base |= {"signature": b"s", "static_keys": [key(0), key(1)], "loaded_writable": [key(2)], "loaded_readonly": [key(3)]}
    rows = [
        base | {"instructions": [ix(1, [0, 3]), ix(0, [])], "inner_instructions": inner},
        base | {"signature": b"t", "instructions": [ix(9, [0])], "inner_instructions": []},
        base | {"signature": b"u", "instructions": [ix(1, [])], "inner_instructions": [{"index": 5, "instructions": []}]},
        base | {"signature": b"v"},
    ]
    out = flatten.instructions(spark.createDataFrame(rows, TRANSACTION)).collect()
    good = sorted((r.path, r.flat_path, r.ix_index, bytes(r.program)[0]) for r in out if bytes(r.signature) == b"s")
    assert good == [([0], [0], "1", 1), ([1], [1], "2", 0), ([1, 0], [1, 0], "2.1", 0), ([1, 0, 0], [1, 1], "2.2", 0), ([1, 1], [1, 2], "2.3", 0)]
    assert {bytes(r.signature): r.error for r in out if bytes(r.signature) != b"s"} == {b"t": "bad_account_index", b"u": "bad_inner_index", b"v": "missing_message"}
    first = next(r for r in out if bytes(r.signature) == b"s" and r.path == [0])
    assert [bytes(a)[0] for a in first.accounts] == [0, 3]


def test_instructions_in_one_pass(spark):
    """Faulty and good transactions come from one pass over the input; those without calls give no row."""
    ix = lambda a: {"program_id_index": 0, "accounts": a, "data": b"d"}
    base = dict.fromkeys(TRANSACTION.names) | {"static_keys": [b"k"]}
    rows = [base | {"signature": b"a", "instructions": [ix([0])]}, base | {"signature": b"b", "instructions": []}, base | {"signature": b"c"}]
    rows.append(base | {"signature": b"d", "instructions": [ix([0])], "inner_instructions": [{"index": -1, "instructions": None}]})
    out = flatten.instructions(spark.createDataFrame(rows, TRANSACTION))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert sorted((bytes(r.signature), r.error, r.ix_index) for r in out.collect()) == [(b"a", None, "1"), (b"c", "missing_message", None), (b"d", "bad_inner_index", None)]


def test_fallback_payload_builds_its_input_once(spark):
    """No filter repeats the folds that make the nested columns."""
    from __spark_entry__ import SMOKE_DIR, queries

    plan = queries()["json_fallback_payload"](spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    assert not [x for x in plan.splitlines() if " Filter " in f" {x}" and "exists(" in x]
