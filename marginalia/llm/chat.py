"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is an optional system turn followed by pairs of a user and an
assistant turn. Every other sequence of roles is repaired at least cost: a turn may be merged with
the one before, given another role, or preceded by an empty turn; at the end empty turns complete
the last pair. The least cost is found by dynamic programming over the states of the automaton that
accepts legal sequences, and the repaired turns are rendered.

A step of the programme is a table of least costs from state to state, and tables of neighbouring
stretches combine to a table of both. So the turns are sorted over all partitions, each task solves
the stretches it holds for every state they may begin and end in, and a conversation that runs over
several tasks is put together from their tables, of which a task has at most two. No conversation,
however long, comes into one task, and only the roles are looked at twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import configure, materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ["", "system", "user", "assistant"]
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 3.0, 1.0, 2.0
KEEP, MERGED, AFTER_USER, AFTER_ASSISTANT = range(4)  # what precedes the turn: nothing, no border, an empty turn
_FAR = np.inf


def step_tables() -> tuple[np.ndarray, np.ndarray]:
    """cost[role, before, after] and how[role, before, after]; role 0 is any unknown role."""
    cost, how = np.full((4, 4, 4), _FAR), np.zeros((4, 4, 4), np.int8)
    for role in range(4):
        for before in range(4):
            for after in (SYSTEM, USER, ASSISTANT):
                named = 0.0 if role == after else RELABEL if role else UNKNOWN
                ways = []
                if after in LEGAL[before]:
                    ways.append((named, KEEP))
                if before == after:
                    ways.append((named + MERGE, MERGED))
                for empty, way in ((USER, AFTER_USER), (ASSISTANT, AFTER_ASSISTANT)):
                    if empty in LEGAL[before] and after in LEGAL[empty]:
                        ways.append((named + INSERT, way))
                if ways:
                    cost[role, before, after], how[role, before, after] = min(ways)
    return cost, how


COST, HOW = step_tables()
END_COST = np.array([0.0, 2 * INSERT, INSERT, 0.0])


def solve(roles: list[int], entries: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from each entry state to each state after the last turn, and for each turn the
    state before it on the best way (first by number among equals)."""
    best = np.full((len(entries), 4), _FAR)
    best[np.arange(len(entries)), entries] = 0.0
    back = np.zeros((len(roles), len(entries), 4), np.int8)
    for k, role in enumerate(roles):
        through = best[:, :, None] + COST[role][None]
        back[k] = through.argmin(1)
        best = through.min(1)
    return best, back


def follow(back: np.ndarray, entry_row: int, final: int) -> list[int]:
    """States after each turn on the best way to ``final``."""
    states = [0] * len(back)
    for k in range(len(back) - 1, -1, -1):
        states[k] = final
        final = int(back[k, entry_row, final])
    return states


def _ways(roles: list[int], entry: int, states: list[int]) -> bytes:
    """One byte for each turn: state before, state after, and what precedes it."""
    befores = [entry, *states[:-1]]
    return bytes(b << 4 | s << 2 | int(HOW[r, b, s]) for r, b, s in zip(roles, befores, states))


_PLACED = "piece long, number long, edge long, ways binary, ends boolean, costs array<double>"


def _repair(batches):
    """Adds the repair of each turn. A conversation inside a task is solved at once; one at its
    edges gets a repair for each pair of begin and end state."""
    piece = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    number = edge = 0
    key = None

    def solved(last: bool) -> pa.RecordBatch:
        nonlocal number, edge
        table = pa.Table.from_batches(held).combine_chunks()
        roles = [ROLES.get(r, 0) for r in table.column("role").to_pylist()]
        n = len(roles)
        inside = edge > 0 and not last
        if inside:
            best, back = solve(roles, (START,))
            final = int((best[0] + END_COST).argmin())
            ways = [bytes([w]) for w in _ways(roles, START, follow(back, 0, final))]
            costs = [None] * n
        else:
            best, back = solve(roles, (START, SYSTEM, USER, ASSISTANT))
            each = [_ways(roles, e, follow(back, e, f)) for e in range(4) for f in range(4)]
            ways = [bytes(w) for w in zip(*each)]
            costs = [None] * (n - 1) + [best.reshape(-1).tolist()]
        out = table
        for name, values, kind in (
            ("piece", [piece] * n, pa.int64()), ("number", range(number, number + n), pa.int64()),
            ("edge", [None if inside else edge] * n, pa.int64()), ("ways", ways, pa.binary()),
            ("ends", [k == n - 1 for k in range(n)], pa.bool_()), ("costs", costs, pa.list_(pa.float64())),
        ):
            out = out.append_column(name, pa.array(values, kind))
        number += n
        edge += 1
        return out

    for batch in batches:
        keys = batch.column("conv_id").to_pylist()
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != key:
                yield from solved(False).to_batches()
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from solved(True).to_batches()


def chain(edges: list[dict]) -> list[tuple[int, int, int, bool]]:
    """(piece, edge, which of the 16 repairs, ends the conversation) for each stretch at an edge.
    ``edges`` have piece, edge, conv_id and costs and come in order."""
    out, at = [], 0
    while at < len(edges):
        end = at + 1
        while end < len(edges) and edges[end]["conv_id"] == edges[at]["conv_id"]:
            end += 1
        best, back = np.array([0.0, _FAR, _FAR, _FAR]), []
        for e in edges[at:end]:
            through = best[:, None] + np.array(e["costs"]).reshape(4, 4)
            back.append(through.argmin(0))
            best = through.min(0)
        final = int((best + END_COST).argmin())
        chosen = []
        for b in reversed(back):
            chosen.append((int(b[final]), final))
            final = int(b[final])
        for k, (e, (x, y)) in enumerate(zip(edges[at:end], reversed(chosen))):
            out.append((e["piece"], e["edge"], 4 * x + y, at + k == end - 1))
        at = end
    return out


def _turn(role: Column | str, text: Column | str) -> Column:
    part = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(F.lit("<|im_start|>"), part(role), F.lit("\n"), part(text))


_CLOSE = "<|im_end|>\n"


def repair(turns: DataFrame) -> DataFrame:
    """Per turn of ``turns``: conv_id, turn, position, role, repaired_role, action and fragment.

    The fragments of a conversation in the order of ``position`` are its rendering: empty turns
    stand in the fragment of the turn they precede, the last fragment also closes the
    conversation. Turns go by turn, null first, then role and text, so ties and rows that repeat
    have an order. Unknown and null roles may become any role; a null text is empty; turns with a
    null conv_id make one conversation. Border marks inside a text are broken up. An empty table
    gives no rows; further columns are not carried.
    """
    spark = configure(turns.sparkSession)
    columns = ["conv_id", "turn", "role", "text"]
    ordered = turns.select(*columns).orderBy(*[F.col(c).asc_nulls_first() for c in columns])
    schema = f"{', '.join(f'{n} {t}' for n, t in ordered.dtypes)}, {_PLACED}"
    placed = materialize(ordered.mapInArrow(_repair, schema), "chat")
    # at most two stretches of each task
    edges = placed.where("costs is not null").select("piece", "edge", "conv_id", "costs").orderBy("piece", "edge").collect()
    chosen = spark.createDataFrame(chain([r.asDict() for r in edges]), "piece long, edge long, way long, closes boolean")
    way = F.conv(F.hex(F.substring(F.col("ways"), (F.coalesce("way", F.lit(0)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = placed.join(F.broadcast(chosen), ["piece", "edge"], "left").withColumn("way", way)
    before, after, how = F.shiftright("way", 4), F.shiftright("way", 2) % 4, F.col("way") % 4
    name = lambda state: F.element_at(F.array(*[F.lit(n) for n in NAMES]), state + 1)
    empty = F.when(how == AFTER_USER, _turn("user", _CLOSE)).when(how == AFTER_ASSISTANT, _turn("assistant", _CLOSE)).otherwise("")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    begin = F.when(how == MERGED, F.concat(F.lit("\n\n"), text)).otherwise(
        F.concat(F.when(before > START, _CLOSE).otherwise(""), empty, _turn(name(after), text))
    )
    last = F.col("ends") & F.coalesce("closes", F.lit(True))
    end = F.when(after == USER, _turn("assistant", _CLOSE)).when(
        after == SYSTEM, F.concat(_turn("user", _CLOSE), _turn("assistant", _CLOSE))
    ).otherwise("")
    fragment = F.concat(begin, F.when(last, F.concat(F.lit(_CLOSE), end)).otherwise(""))
    relabelled = ~F.col("role").eqNullSafe(name(after))
    action = F.concat_ws(
        "+", F.when(how == MERGED, "merge"), F.when(how >= AFTER_USER, "insert"), F.when(relabelled, "relabel"),
        F.when(last & (after != ASSISTANT), "complete"),
    )
    return known.select(
        "conv_id", "turn", (F.shiftleft("piece", 33) + F.col("number")).alias("position"), "role",
        name(after).alias("repaired_role"), F.coalesce(F.nullif(action, F.lit("")), F.lit("keep")).alias("action"),
        fragment.alias("fragment"),
    )
