"""Chat formatting: minimum-cost role repair over a legal-turn automaton.

A legal conversation is an optional system turn, then user and assistant in turn, with tool turns between assistant
turns, ending with the assistant. Every message keeps its role, takes another, or merges into the turn before; empty
turns may come between. Dynamic programming finds the sequence of least cost, which is then rendered.

A conversation may be enormous, so it is cut into chunks by turn number. A chunk's effect is a small matrix: the least
cost from every state before it to every state after it. The matrices of a conversation are combined (min-plus), which
fixes the states at the chunks' borders; then each chunk is repaired and rendered on its own.

Defined results: order is by turn (null first), role, text; a null text is empty; a null conv_id is a conversation of
its own; a null or unknown role may become any role at a small cost. Of repairs of equal cost, the states at the borders
of chunks are the first in STATES, from the last border back; then each chunk's, from its last message back; a merge goes
before insertions.
Columns beside the four are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4096
STATES = ("start", "system", "user", "assistant", "tool")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
ALIASES = {"human": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "function": "tool"}
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
FAR = 1 << 40

_N = len(STATES)
_CHUNK_ORDER = ("_conv", "_chunk")


def _chains() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest sequences of turns to insert between a state and a turn."""
    number = {s: i for i, s in enumerate(STATES)}
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in range(_N):
        reach: dict[int, tuple[int, ...]] = {s: ()}
        edge = [s]
        while edge:
            nxt = []
            for x in edge:
                for y in (number[z] for z in LEGAL[STATES[x]]):
                    if (s, y) not in out:
                        out[s, y] = reach[x] + ((x,) if x != s else ())
                        if y not in reach:
                            reach[y] = out[s, y]
                            nxt.append(y)
            edge = nxt
    return out


_CHAIN = _chains()


def _step() -> np.ndarray:
    out = np.full((_N, _N), FAR, np.int64)
    for (s, t), chain in _CHAIN.items():
        out[s, t] = INSERT * len(chain)
    for s in range(1, _N):
        out[s, s] = min(out[s, s], MERGE)
    return out


_STEP = _step()
#: Turns to insert at the end, so that the assistant has the last word; a conversation without turns needs none.
_ENDING = [(), *(() if s == "assistant" else _CHAIN[i, STATES.index("assistant")] + (STATES.index("assistant"),) for i, s in enumerate(STATES) if i)]
_END_COST = np.array([INSERT * len(x) for x in _ENDING], np.int64)


def _role(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in STATES[1:] else None


def _labels(role: str | None) -> np.ndarray:
    own = _role(role)
    return np.array([FAR, *(0 if s == own else RELABEL if own else RELABEL_UNKNOWN for s in STATES[1:])], np.int64)


_MATRICES: dict[str | None, np.ndarray] = {s: _STEP + _labels(s)[None, :] for s in (None, *STATES[1:])}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def chunk_matrix(roles: list[str | None]) -> np.ndarray:
    out = np.where(np.eye(_N, dtype=bool), 0, FAR).astype(np.int64)
    for r in roles:
        out = _product(out, _MATRICES[_role(r)])
    return out


def best_path(matrices: list[np.ndarray], start: int, ending: np.ndarray) -> list[int]:
    """States after each matrix, on a cheapest path from `start`; ending: what each last state costs."""
    cost = np.full(_N, FAR, np.int64)
    cost[start] = 0
    back = []
    for m in matrices:
        ways = cost[:, None] + m
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), FAR)
    state = int((cost + ending).argmin())
    path = [state]
    for b in reversed(back):
        state = int(b[state])
        path.append(state)
    return path[::-1]


def repair(roles: list[str | None], texts: list[str], entry: int = 0, leave: int | None = None, last: bool = True) -> Iterator[tuple]:
    """(index of the message or None, new role, action, text, rendered) of a chunk's turns from state `entry` to `leave`."""
    ending = _END_COST if leave is None else np.where(np.arange(_N) == leave, 0, FAR)
    path = best_path([_MATRICES[_role(r)] for r in roles], entry, ending)
    opened = entry != 0

    def turn(state: int, text: str) -> str:
        nonlocal opened
        close, opened = "<|end|>\n" if opened else "", True
        return f"{close}<|{STATES[state]}|>\n{text}"

    out: list[tuple] = []
    for i, (role, text, before, after) in enumerate(zip(roles, texts, path, path[1:])):
        if before == after and MERGE <= INSERT * len(_CHAIN.get((before, after), (0,) * _N)):
            out.append((i, STATES[after], "merge", text, f"\n\n{text}"))
            continue
        for s in _CHAIN[before, after]:
            out.append((None, STATES[s], "insert", "", turn(s, "")))
        out.append((i, STATES[after], "keep" if _role(role) == STATES[after] else "relabel", text, turn(after, text)))
    if last:
        for s in _ENDING[path[-1]]:
            out.append((None, STATES[s], "insert", "", turn(s, "")))
        if out:
            out[-1] = (*out[-1][:4], out[-1][4] + "<|end|>\n")
    return iter(out)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each key, from rows that come sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def format_chats(conversations: DataFrame) -> DataFrame:
    """A row for each given message and each inserted turn: conv_id, turn, role, new_role, action, text, rendered.

    A conversation's text is the concatenation of `rendered` in the order of chunk and position, both whole numbers:
    chunks go by turn, and position numbers a chunk's rows, with inserted turns (null role) before the message whose turn
    they bear, or at the end after the last one.
    """
    rows = conversations.select(
        F.struct(F.col("conv_id").isNotNull().alias("given"), F.coalesce("conv_id", F.lit(0)).alias("id")).alias("_conv"),
        F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(1 << 62))).alias("_chunk"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [*_CHUNK_ORDER, F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text"]
    sorted_rows = rows.repartition("_conv", "_chunk").sortWithinPartitions(*order)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk), own in _runs(batches, _CHUNK_ORDER):
            yield pa.RecordBatch.from_pylist([{"_conv": conv_of(conv), "_chunk": chunk, "matrix": chunk_matrix([r["role"] for r in own]).reshape(-1).tolist()}], effect_type)

    conv_type = pa.struct([("given", pa.bool_()), ("id", pa.int64())])
    effect_type = pa.schema([("_conv", conv_type), ("_chunk", pa.int64()), ("matrix", pa.list_(pa.int64()))])
    border_type = pa.schema([("_conv", conv_type), ("_chunk", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())])

    def conv_of(conv: dict | tuple) -> dict:
        return dict(conv) if isinstance(conv, dict) else {"given": conv[0], "id": conv[1]}

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), chunks in _runs(batches, ("_conv",)):
            path = best_path([np.array(c["matrix"]).reshape(_N, _N) for c in chunks], 0, _END_COST)
            out = [{"_conv": conv_of(conv), "_chunk": c["_chunk"], "entry": a, "leave": b, "last": c is chunks[-1]} for c, a, b in zip(chunks, path, path[1:])]
            yield pa.RecordBatch.from_pylist(out, border_type)

    kind = "_conv struct<given: boolean, id: bigint>, _chunk long"
    effect = sorted_rows.select("_conv", "_chunk", "turn", "role", "text").drop("text").mapInArrow(effects, f"{kind}, matrix array<bigint>")
    border = effect.repartition("_conv").sortWithinPartitions("_conv", "_chunk").mapInArrow(borders, f"{kind}, entry int, leave int, last boolean")
    ready = rows.join(border, ["_conv", "_chunk"]).repartition("_conv", "_chunk").sortWithinPartitions(*order)
    schema = pa.schema(
        [("conv_id", pa.int64()), ("chunk", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), *((c, pa.string()) for c in ("role", "new_role", "action", "text", "rendered"))]
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for (conv, chunk), own in _runs(batches, _CHUNK_ORDER):
            first = own[0]
            turns = repair([r["role"] for r in own], [r["text"] for r in own], first["entry"], first["leave"], first["last"])
            turns = list(turns)
            following = [None] * len(turns)
            nxt = own[-1]["turn"]
            for j in range(len(turns) - 1, -1, -1):
                nxt = own[turns[j][0]]["turn"] if turns[j][0] is not None else nxt
                following[j] = nxt
            for j, (i, new, action, text, rendered) in enumerate(turns):
                at = following[j]
                waiting.append(
                    {"conv_id": conv["id"] if conv["given"] else None, "chunk": chunk, "position": j, "turn": at, "role": own[i]["role"] if i is not None else None, "new_role": new, "action": action, "text": text, "rendered": rendered}
                )
            if len(waiting) >= 2048:
                yield pa.RecordBatch.from_pylist(waiting, schema)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema)

    return ready.mapInArrow(render, "conv_id long, chunk long, position long, turn long, role string, new_role string, action string, text string, rendered string")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
