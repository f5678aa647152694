"""From nested transactions to instruction rows: account resolution, call paths, log slices.

A transaction is exploded once and its call tree comes from a fold over the stack heights,
all in built-in expressions. Log slices alone are found in Python, on Arrow batches, in one
pass over their lines.
Tree paths are arrays, whose order (lexicographic, a prefix first) is the order of calls.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a log line is: program names can't be one of the runtime's own tags.
_LINE = r"^Program (?!(?:log:|data:|return:) )([^ ]+) "
INVOKE, CLOSE = _LINE + r"invoke \[[0-9]+\]", _LINE + r"(?:success$|failed:)"
OUTER = _LINE + r"invoke \[1\]"
_RE_INVOKE, _RE_CLOSE, _RE_OUTER = re.compile(INVOKE), re.compile(CLOSE), re.compile(OUTER)


def paths(heights: Column, outer: Column) -> Column:
    """Tree paths of an outer instruction's inner ones, from their stack heights (null: unknown).

    The first is ``[outer, 0]``. A greater height descends, an equal or unknown one is the
    next sibling, a lesser one returns to that depth and takes the next sibling there.
    """
    none = F.array().cast("array<array<int>>")
    start = F.struct(none.alias("out"), F.array(outer.cast("int")).alias("at"), F.lit(None).cast("int").alias("before"), F.lit(True).alias("first"))

    def next_sibling(at: Column) -> Column:
        return F.concat(F.slice(at, 1, F.size(at) - 1), F.array(F.element_at(at, -1) + 1))

    def step(acc: Column, h: Column) -> Column:
        at, before = acc["at"], acc["before"]
        to = (
            F.when(acc["first"] | (h > before), F.concat(at, F.array(F.lit(0))))
            .when(h < before, next_sibling(F.slice(at, 1, F.greatest(F.least(h, F.size(at)), F.lit(1)))))
            .otherwise(next_sibling(at))
        )
        return F.struct(F.concat(acc["out"], F.array(to)).alias("out"), to.alias("at"), h.cast("int").alias("before"), F.lit(False).alias("first"))

    return F.aggregate(heights, start, step, lambda acc: acc["out"])


def is_parent(a: Column, b: Column) -> Column:
    """Whether path ``a`` is the direct parent of ``b``."""
    return (F.size(b) == F.size(a) + 1) & (F.slice(b, 1, F.size(a)) == a)


def is_ancestor(a: Column, b: Column) -> Column:
    return (F.size(b) > F.size(a)) & (F.slice(b, 1, F.size(a)) == a)


def path_text(path: Column) -> Column:
    """1-based, dotted: ``3.2.1`` for [2, 1, 0]."""
    return F.array_join(F.transform(path, lambda i: (i + 1).cast("string")), ".")


def line_kinds(lines: Column) -> Column:
    """invoke, close or other for each log line, by its structure."""
    kind = lambda x: F.when(x.rlike(INVOKE), "invoke").when(x.rlike(CLOSE), "close").otherwise("other")
    return F.transform(lines, kind)


def depths(lines: Column) -> Column:
    """The call depth of each line: invoke and close lines belong to the call that they open or close."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("d"))

    def step(acc: Column, kind: Column) -> Column:
        up = F.when(kind == "invoke", acc["d"] + 1).otherwise(acc["d"])
        down = F.when(kind == "close", F.greatest(up - 1, F.lit(0))).otherwise(up)
        return F.struct(F.concat(acc["out"], F.array(up)).alias("out"), down.alias("d"))

    return F.aggregate(line_kinds(lines), start, step, lambda acc: acc["out"])


def split_outer(lines: Column) -> Column:
    """One array of lines per outer invocation, from its invoke line to its close (or the log's end)."""
    none = F.array().cast("array<array<string>>")
    start = F.struct(none.alias("out"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("d"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["d"] == 0) & x.rlike(OUTER)
        inside = acc["d"] > 0
        done = opens & (F.size(acc["now"]) > 0)
        out = F.when(done, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])
        now = F.when(opens, F.array(x)).when(inside, F.concat(acc["now"], F.array(x))).otherwise(acc["now"])
        d = F.when(opens, 1).when(inside & x.rlike(INVOKE), acc["d"] + 1).when(inside & x.rlike(CLOSE), acc["d"] - 1).otherwise(acc["d"])
        return F.struct(out.alias("out"), now.alias("now"), d.alias("d"))

    return F.aggregate(lines, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))


def direct_lines(lines: Column) -> Column:
    """Of one instruction's slice, the lines of its own call alone."""
    return F.transform(F.filter(F.arrays_zip(lines.alias("x"), depths(lines).alias("d")), lambda z: z["d"] == 1), lambda z: z["x"])


def resolve(keys: Column, index: Column) -> Column:
    """The key at a 0-based index; null where the index is out of range."""
    return F.get(keys, index)


def instructions(transactions: DataFrame) -> DataFrame:
    """One row per call of a transaction, outer and inner, in call order by (signature, path).

    Adds to the transaction's columns: program, accounts, data, path, flat_path (``[o]``
    or ``[o, k]``, k counting all calls below ``o``), ix_index (its 1-based text), and
    ``error`` (missing_message, bad_inner_index or bad_account_index, else null). A faulty
    transaction gives one row with its error; it never fails the task.
    """
    keys = F.concat(*[F.coalesce(c, F.array().cast("array<binary>")) for c in ("static_keys", "loaded_writable", "loaded_readonly")])
    inner = F.coalesce(F.col("inner_instructions"), F.filter("inner_instructions", lambda _: F.lit(False)))
    n = F.size("instructions")
    bad = F.exists("inner_instructions", lambda i: (i["index"] < 0) | (i["index"] >= n))
    fault = F.when(F.col("instructions").isNull(), "missing_message").when(F.coalesce(bad, F.lit(False)), "bad_inner_index")
    none = F.lit(None)

    def call(ix: Column, path: Column, flat: Column) -> Column:
        fields = [ix["program_id_index"].alias("p"), ix["accounts"].alias("a"), ix["data"].alias("data"), path.alias("path"), flat.alias("flat_path")]
        return F.struct(*fields, none.cast("string").alias("fault"))

    def below(o: Column) -> Column:
        mine = F.flatten(F.transform(F.filter(inner, lambda g: g["index"] == o), lambda g: g["instructions"]))
        ways = paths(F.transform(mine, lambda x: x["stack_height"]), o)
        # zipped, so that the paths are found once and not once per call
        return F.transform(F.arrays_zip(mine.alias("x"), ways.alias("way")), lambda z, k: call(z["x"], z["way"], F.array(o.cast("int"), k.cast("int"))))

    def with_inner(x: Column, o: Column) -> Column:
        head = F.array(call(x, F.array(o.cast("int")), F.array(o.cast("int"))))
        return F.concat(head, F.coalesce(below(o), F.filter(head, lambda _: F.lit(False))))

    ints = "array<int>"
    faulty = F.struct(none.cast("int").alias("p"), none.cast(ints).alias("a"), none.cast("binary").alias("data"), none.cast(ints).alias("path"), none.cast(ints).alias("flat_path"), fault.alias("fault"))
    # good and faulty transactions explode together: the input is read once, and no filter repeats what made its columns
    calls = F.when(fault.isNull(), F.flatten(F.transform("instructions", with_inner))).otherwise(F.array(faulty))
    t = transactions.withColumn("_keys", keys).withColumn("_c", F.explode(calls))
    out_of_range = (F.col("_c.p") >= F.size("_keys")) | (F.col("_c.p") < 0) | F.exists("_c.a", lambda i: (i < 0) | (i >= F.size("_keys")))
    extra = {
        "program": resolve(F.col("_keys"), F.col("_c.p")),
        "accounts": F.transform("_c.a", lambda i: resolve(F.col("_keys"), i)),
        "data": F.col("_c.data"),
        "path": F.col("_c.path"),
        "flat_path": F.col("_c.flat_path"),
        "ix_index": path_text(F.col("_c.flat_path")),
        "error": F.coalesce(F.col("_c.fault"), F.when(out_of_range, "bad_account_index")),
    }
    return t.withColumns(extra).drop("_keys", "_c")


def log_slices(logs: Column, programs: Column, tree_paths: Column) -> Column:
    """[start, end) of each call's lines, for calls in order with program texts; null where it has none.

    An outer call takes the next outer invoke line if that line names its program. Inner
    calls take the invoke lines below it in order; an unclosed call reaches the log's end.
    """
    return _slices(logs, programs, tree_paths)


_OTHER, _INVOKE, _CLOSE, _OUTER = range(4)
#: Shapes of call trees that a batch remembers.
_SHAPES = 10_000


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("log_start", T.IntegerType()), T.StructField("log_end", T.IntegerType())])))
def _slices(logs: pa.Array, programs: pa.Array, tree_paths: pa.Array) -> pa.Array:
    """The call tree's walk needs a stack, which expressions lack. Each line text of a batch is matched once."""
    names: dict[str, int] = {}
    line_at, lines = _texts(logs)
    kinds = [_kind(x, names) for x in lines.dictionary.to_pylist()]
    codes = lines.indices.to_pylist()
    kind, name = [kinds[c][0] if c is not None else _OTHER for c in codes], [kinds[c][1] if c is not None else -1 for c in codes]
    program_at, texts = _texts(programs)
    known = [names.get(x, -2) for x in texts.dictionary.to_pylist()]
    wanted = [known[c] if c is not None else -2 for c in texts.indices.to_pylist()]
    tree_at, paths_ = _parts(tree_paths)
    path_at, steps = _parts(paths_)
    steps = steps.to_pylist()
    shapes: dict[tuple, tuple] = {}
    starts, ends = [None] * len(paths_), [None] * len(paths_)
    for i in range(len(logs)):
        a, b = tree_at[i], tree_at[i + 1]
        cuts = path_at[a : b + 1]
        key = (*[c - cuts[0] for c in cuts], *steps[cuts[0] : cuts[-1]])
        shape = shapes.get(key)
        if shape is None:
            if len(shapes) >= _SHAPES:
                shapes.clear()
            shape = shapes[key] = _shape([tuple(steps[x:y]) for x, y in itertools.pairwise(cuts)])
        lo, hi = line_at[i], line_at[i + 1]
        _walk(kind[lo:hi], name[lo:hi], wanted[program_at[i] : program_at[i + 1]], *shape, starts, ends, a)
    at, to = pa.array(starts, pa.int32()), pa.array(ends, pa.int32())
    each = pa.StructArray.from_arrays([at, to], ["log_start", "log_end"], mask=at.is_null())
    return pa.ListArray.from_arrays(pa.array(tree_at, pa.int32()), each)


def _parts(lists: pa.Array) -> tuple[list[int], pa.Array]:
    """(where each list starts, and the end; all lists' values). A null list is an empty one."""
    return list(itertools.accumulate(lists.value_lengths().fill_null(0).to_pylist(), initial=0)), lists.flatten()


def _texts(lists: pa.Array) -> tuple[list[int], pa.DictionaryArray]:
    at, values = _parts(lists)
    return at, values.dictionary_encode()


def _kind(line: str, names: dict[str, int]) -> tuple[int, int]:
    """(what a line is, the number of the program that it names, which ``names`` gets)."""
    if not line.startswith("Program "):
        return _OTHER, -1
    if m := _RE_OUTER.search(line):
        return _OUTER, names.setdefault(m[1], len(names))
    return _INVOKE if _RE_INVOKE.search(line) else _CLOSE if _RE_CLOSE.search(line) else _OTHER, -1


def _shape(tree: list[tuple[int, ...]]) -> tuple[list[int], list[list[int]]]:
    """(places of the outer calls, places of the calls below each call)."""
    place = {p: i for i, p in enumerate(tree)}
    children: dict[tuple, list[int]] = {}
    for p in tree:
        children.setdefault(p[:-1], []).append(place[p])
    return children.get((), []), [children.get(p, []) for p in tree]


def _walk(kind: list[int], name: list[int], wanted: list[int], outer: list[int], below: list[list[int]], starts: list, ends: list, base: int) -> None:
    """Puts the slices of one transaction into ``starts`` and ``ends`` from ``base`` on; each line is passed once."""
    n, cursor = len(kind), 0
    for root in outer:
        while cursor < n and kind[cursor] != _OUTER:
            cursor += 1
        if cursor == n:
            return
        if root >= len(wanted) or name[cursor] != wanted[root]:
            continue
        call, at, kids, given, depth = root, cursor, below[root], 0, 1
        stack, cursor = [], cursor + 1
        while cursor < n:
            k = kind[cursor]
            if k == _CLOSE:
                depth -= 1
                if not depth:
                    starts[base + call], ends[base + call] = at, cursor + 1
                    if not stack:
                        cursor += 1
                        break
                    call, at, kids, given, depth = stack.pop()
            elif k != _OTHER:
                if given < len(kids):
                    stack.append((call, at, kids, given + 1, depth))
                    call, at, kids, given, depth = kids[given], cursor, below[kids[given]], 0, 1
                else:
                    depth += 1
            cursor += 1
        else:
            for c, a, *_ in [(call, at), *reversed(stack)]:
                starts[base + c], ends[base + c] = a, n


def assign(logs: list[str], programs: list[str], tree: list[tuple[int, ...]]) -> list[tuple[int, int] | None]:
    """The slices of ``log_slices`` for one transaction."""
    names: dict[str, int] = {}
    found = [_kind(x, names) for x in logs]
    starts, ends = [None] * len(tree), [None] * len(tree)
    _walk([k for k, _ in found], [i for _, i in found], [names.get(p, -2) for p in programs], *_shape(tree), starts, ends, 0)
    return [None if a is None else (a, b) for a, b in zip(starts, ends, strict=True)]
