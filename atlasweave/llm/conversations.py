"""Cheapest edits that make conversations well-formed, by dynamic programming with square-root checkpoints.

A conversation is a row of symbols (the class of a role and whether its text is sound), read by an automaton of four states. The cost
vector of a place tells, for each state, what the rest costs at least. Vectors run backwards and edits are chosen forwards, so
vectors are kept only at checkpoints a square root of the length apart: walking forward, those of one stretch are computed
again from the checkpoint behind it. The same scheme runs twice. Between tasks the checkpoints are blocks of a
conversation: each block gives a small min-plus matrix, the matrices of one conversation fold into the vector behind each
block, and the blocks are walked side by side for every state they may begin in. Inside a task the
checkpoints lie in the block. No task holds a conversation, only its blocks' summaries.

Forms allowed are nothing, or an optional ``s`` and then ``ua`` once or more, in initials of roles. Edits: K keeps a row, R gives it the role
user or assistant (1), D deletes it (2), I inserts an empty one (5); a row that ends without a full stop and stays costs 5 more.
Of the cheapest edits those whose initials are least in ASCII are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasweave.llm.frames import saved

#: Rows of a block, unless the square root of the conversation's length is larger.
BLOCK_ROWS = 4096
#: States: nothing yet, after s, after u, after a. The only role that user or assistant can have next, and the state it leads to.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_END = (0, 10, 5, 0)
_FAR = 1 << 50
_LETTERS = "sua"
_WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by the CRC-32 of ``conv_id:turn``, modulo 20: 0 drops the row, 1 empties its
    text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls read as one space (the turn of a row stays null)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))), F.lit(20))
    worn = F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), worn.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def _key(conv: Column) -> Column:
    """A text that tells conversation ids apart, also from null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


# --- the automaton -------------------------------------------------------------------------------------------------------


def _keep(state: int, role: int) -> int | None:
    """The state after a row of role s, u, a or another in ``state``; None where it may not stand."""
    if role == 0:
        return 1 if state == 0 else None
    return _NEXT[state] if role < 3 and (role == 2) == (state == 2) else None


@lru_cache(maxsize=100_000)
def _back(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The cost vector before a row from the one after it."""
    role, fault = divmod(symbol, 3)
    out = []
    for state in range(4):
        cost = 2 + after[state]
        if fault < 2:
            kept = _keep(state, role)
            cost = min(cost, 5 * fault + 1 + after[_NEXT[state]], 5 * fault + after[kept] if kept is not None else _FAR)
        out.append(cost)
    for _ in range(2):  # inserted rows lead from state to state; more than two in a row come back to where they began
        out = [min(c, 5 + out[_NEXT[s]]) for s, c in enumerate(out)]
    return tuple(out)


def _step(before: tuple[int, ...], after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int, int]:
    """(initials, state behind, cost) of the cheapest edits of one row and of the rows inserted before it."""
    role, fault = divmod(symbol, 3)
    done, cost = "", 0
    while before[state] != 2 + after[state]:
        if before[state] == 5 + before[_NEXT[state]]:
            done, state, cost = done + "I", _NEXT[state], cost + 5
            continue
        kept = _keep(state, role)
        if kept is not None and before[state] == 5 * fault + after[kept]:
            return done + "K", kept, cost + 5 * fault
        return done + "R", _NEXT[state], cost + 5 * fault + 1
    return done + "D", state, cost + 2


@lru_cache(maxsize=100_000)
def _level(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(vector)
    return tuple(min(v - least, _FAR) for v in vector), least


def block_matrix(symbols: list[int]) -> list[list[int]]:
    """What a block costs from each state before it to each state behind it, rows inserted behind it left out."""
    columns = []
    for end in range(4):
        vector, total = tuple(0 if s == end else _FAR for s in range(4)), 0
        for symbol in reversed(symbols):
            vector, least = _level(_back(vector, symbol))
            total += least
        columns.append([min(v + total, _FAR) for v in vector])
    return [[columns[end][state] for end in range(4)] for state in range(4)]


def through(matrix: list[list[int]], after: list[int]) -> list[int]:
    """The vector before a block from the one behind it, which counts the rows inserted there."""
    return [min(cost + v for cost, v in zip(row, after)) for row in matrix]


def walk(symbols: list[int], after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """(initials, state behind, cost) of the cheapest edits of a block that begins in ``state`` and has the vector ``after`` behind it.

    Only the vectors at checkpoints are kept on the way back. Vectors count from their least entry, as only differences decide.
    """
    n = len(symbols)
    stride = isqrt(n - 1) + 1 if n else 1
    vector, marks = _level(tuple(after))[0], {}
    for k in range(n - 1, -1, -1):
        if (k + 1) % stride == 0 or k == n - 1:
            marks[k // stride] = vector
        vector = _level(_back(vector, symbols[k]))[0]
    out, cost = [], 0
    for start in range(0, n, stride):
        part = symbols[start : start + stride]
        behind = [marks[start // stride]]
        for symbol in reversed(part):
            behind.append(_level(_back(behind[-1], symbol))[0])
        for k, symbol in enumerate(part):
            last = behind[len(part) - 1 - k]
            done, state, more = _step(_back(last, symbol), last, symbol, state)
            out.append(done)
            cost += more
    return "".join(out), state, cost


def tail(state: int) -> str:
    """Initials of the rows inserted behind the last one."""
    return "I" * (_END[state] // 5)


def placed(symbols: list[int], audit: str, state: int) -> Iterator[tuple[int, int, str, str | None]]:
    """(row of the block, order, initial, new role) of each edit; a kept row has no new role."""
    row, before = 0, 0
    for initial in audit:
        if initial == "I":
            yield row, before, initial, _ROLE[state]
            before, state = before + 1, _NEXT[state]
            continue
        kept = _keep(state, symbols[row] // 3) if initial == "K" else None
        yield row, 9, initial, _ROLE[state] if initial == "R" else None
        state = kept if initial == "K" else _NEXT[state] if initial == "R" else state
        row, before = row + 1, 0


# --- the same as Spark jobs ----------------------------------------------------------------------------------------------


@dataclass
class Repair:
    """``conversations``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each id.
    ``rows``: (conv_id, key, place, order, edit, role, text): the repaired rows, each with its edit, in the order of place and order within a conversation."""

    conversations: DataFrame
    rows: DataFrame


def _mapped(frame: DataFrame, each, schema: str) -> DataFrame:
    """Rows that ``each`` makes of one row (a dictionary)."""
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    kinds = [_ARROW[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                out = [row for one in batch.slice(first, 500).to_pylist() for row in each(one)]
                columns = zip(*out) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))

    return frame.mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}


def _symbols(text: str) -> list[int]:
    return [ord(c) - 97 for c in text]


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> Repair:
    """The cheapest repair of conversations given by rows (conv_id, turn, role, text) of any order; other columns are ignored.

    Rows stand by turn, nulls first, and by role and text within a turn. Null roles and texts read as one space, and a null ``conv_id`` is a conversation too.
    ``ids`` may name further ids (conv_id) that have no row: theirs are zeros and empty texts. A row's first fault counts:
    blank (nothing but white space), duplicate (role and text stood earlier in the conversation), truncated (its last
    character but for white space ends no sentence). ``gaps`` counts missing turns between the least and the greatest.
    An empty table gives an empty result.
    """
    kind = rows.schema["conv_id"].dataType
    back = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind)
    given = rows.select(_key(F.col("conv_id")).alias("key"), "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    # equal rows are one with a count, so that no repeated row fills a range of its own
    grouped = given.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    initial = F.substring("role", 1, 1)
    last = F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)
    ordered = saved(
        grouped.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "key", "turn", "role", "text", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"),
            (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 3).alias("class"),
            (last == "").alias("is_blank"), (~last.isin(".", "!", "?")).alias("is_cut"),
            F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same"),
        )
    )
    slim = ordered.drop("role", "text")
    firsts = slim.groupBy("key", "same").agg(F.min("row").alias("first"))
    inside = Window.partitionBy("key", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    parts = slim.groupBy("key", "part").agg(F.sum("n").alias("rows"))
    whole = Window.partitionBy("key")
    offsets = parts.select("key", "part", F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("rows").over(whole).alias("total"))
    again = F.col("row") != F.col("first")
    forced = F.col("is_blank") | again
    letter = lambda fault: F.char(F.lit(97) + F.col("class") + fault)
    located = saved(
        slim.join(firsts, ["key", "same"]).withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["key", "part"]).select(
            "key", "row", "turn", "n", (F.col("start") + F.col("within")).alias("place"), "total", "is_blank", "is_cut", again.alias("again"),
            F.concat(letter(F.when(forced, 2).when(F.col("is_cut"), 1).otherwise(0)), F.repeat(letter(F.lit(2)), (F.col("n") - 1).cast("int"))).alias("symbols"),
        )
    )
    length = F.greatest(F.lit(block_rows), F.ceil(F.sqrt("total"))).cast("long")
    listed = F.sort_array(F.collect_list(F.struct("place", "symbols")))
    blocks = located.groupBy("key", F.floor(F.col("place") / length).alias("block")).agg(F.min("place").alias("first"), F.array_join(F.transform(listed, lambda x: x["symbols"]), "").alias("symbols"))
    by_block = whole.orderBy("block")
    blocks = saved(
        blocks.select(
            "key", "block", "first", "symbols", F.row_number().over(by_block.rowsBetween(Window.unboundedPreceding, 0)).alias("number"), F.count("*").over(whole).alias("blocks"),
            F.coalesce(F.lag(F.substring("symbols", -1, 1)).over(by_block), F.lit("")).alias("previous"),
        )
    )
    walked = saved(_walked(blocks))
    audits = walked.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "audit"))), lambda x: x["audit"]), "").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    faults = located.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("is_blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("is_blank"), 0).otherwise(F.col("n") - F.when(F.col("again"), 0).otherwise(1))).alias("duplicate"),
        F.sum((~F.col("is_blank") & ~F.col("again") & F.col("is_cut")).cast("long")).alias("truncated"),
    )
    keys = given.select("key").distinct() if ids is None else ids.select(_key(F.col("conv_id")).alias("key")).union(given.select("key")).distinct()
    found = keys.join(faults, "key", "left").join(audits, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    conversations = found.select(back.alias("conv_id"), "key", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    edits = _mapped(walked.select("key", "first", "symbols", "audit", "state"), _spread, "key string, place long, order int, edit string, new_role string")
    texts = located.select("row", "place").join(ordered.select("key", "row", "role", "text"), "row").select("key", "place", F.lit(9).alias("order"), "role", "text")
    repaired = edits.join(texts, ["key", "place", "order"], "left").select(
        back.alias("conv_id"), "key", "place", "order", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return Repair(conversations, repaired)


def _spread(block: dict) -> Iterator[tuple]:
    for row, order, edit, role in placed(_symbols(block["symbols"]), block["audit"], block["state"]):
        if edit != "D":
            yield block["key"], block["first"] + row, order, edit, role


def _illegal(previous: str, symbols: str) -> int:
    roles = [_LETTERS[s // 3] if s < 9 else "?" for s in _symbols(previous + symbols)]
    return sum(pair not in (("s", "u"), ("u", "a"), ("a", "u")) for pair in zip(roles, roles[1:]))


def _walked(blocks: DataFrame) -> DataFrame:
    """(key, number, first, symbols, state, audit, cost, illegal): the edits of each block."""

    def walks(block: dict) -> Iterator[tuple]:
        symbols, states = _symbols(block["symbols"]), range(1 if block["number"] == 1 else 4)
        for begin in states:
            audit, state, cost = walk(symbols, tuple(block["vector"] or _END), begin)
            if block["number"] == block["blocks"]:
                more = tail(state)
                audit, cost = audit + more, cost + 5 * len(more)
            yield block["key"], block["number"], block["first"], block["symbols"], begin, audit, state, cost, _illegal(block["previous"], block["symbols"])

    def matrix(block: dict) -> Iterator[tuple]:
        yield block["key"], block["number"], [c for row in block_matrix(_symbols(block["symbols"])) for c in row]

    def vectors(conversation: dict) -> Iterator[tuple]:
        vector = list(_END)
        yield conversation["key"], conversation["list"][-1]["number"], vector
        for one in reversed(conversation["list"]):
            vector = through([one["matrix"][k : k + 4] for k in (0, 4, 8, 12)], vector)
            least = min(vector)
            vector = [v - least for v in vector]
            yield conversation["key"], one["number"] - 1, vector

    def starts(conversation: dict) -> Iterator[tuple]:
        state, ends = 0, {(one["number"], one["begin"]): one["end"] for one in conversation["list"]}
        for number in range(1, max(n for n, _ in ends) + 1):
            yield conversation["key"], number, state
            state = ends[number, state]

    out = "key string, number int, first long, symbols string, state int, audit string, end int, cost long, illegal long"
    columns = ["key", "number", "blocks", "first", "symbols", "previous"]
    one = _mapped(blocks.where("blocks = 1").select(*columns, F.lit(None).cast("array<long>").alias("vector")), walks, out)
    many = blocks.where("blocks > 1").select(*columns)
    folded = lambda frame, *fields: frame.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("list"))
    matrices = _mapped(many.where("number > 1").select("key", "number", "symbols"), matrix, "key string, number int, matrix array<long>")
    # the vector behind block k comes from the blocks after it; the last one has the end of the conversation behind it
    behind = _mapped(folded(matrices, "number", "matrix"), vectors, "key string, number int, vector array<long>")
    tried = saved(_mapped(many.join(behind, ["key", "number"]).select(*columns, "vector"), walks, out))
    chosen = _mapped(folded(tried.select("key", "number", F.col("state").alias("begin"), "end"), "number", "begin", "end"), starts, "key string, number int, state int")
    picked = tried.join(chosen, ["key", "number", "state"])
    return one.unionByName(picked).drop("end")


def row_digests(repaired: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the SHA-256 of each conversation's ``role:text`` lines.

    The rows of a conversation are hashed as they stream by in order, so no conversation is held; a hash runs from the first
    to the last row, so one conversation's are read by one task.
    """
    lines = repaired.select("key", "place", "order", F.concat_ws(":", "role", "text").alias("line")).repartition("key").sortWithinPartitions("key", "place", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py().encode())
            if len(done) > 1000:
                yield _digests(done)
                done = []
        if now is not None:
            done.append((now, state.hexdigest()))
        yield _digests(done)

    return lines.select("key", "line").mapInArrow(run, "key string, repaired_sha256 string")


def _digests(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], ["key", "repaired_sha256"])
