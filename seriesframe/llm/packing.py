"""Packing of tokenised documents into sequences by bin completion.

Only lengths matter to a packing, and there are at most as many lengths as a sequence has tokens.
So Spark counts the pieces of every length, a branch-and-bound search over these counts finds
which lengths share a sequence, and how often, and every piece takes its place by its rank among
the pieces of its length. The search works on a table as small as a sequence, whatever the corpus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesframe.llm import bpe
from seriesframe.llm.arrow import map_arrow, text_chunks, texts_of
from seriesframe.session import materialize


@dataclass(frozen=True)
class Step:
    """``times`` sequences that hold the same lengths: (length, how many of it), longest first."""

    lengths: tuple[tuple[int, int], ...]
    times: int


def _largest(counts: np.ndarray) -> int:
    found = np.flatnonzero(counts)
    return int(found[-1]) if len(found) else 0


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences by waste: pieces above half a sequence, and what others cannot fill.

    For each k, pieces longer than capacity - k stand alone, those above half a sequence have
    one each, and those of at least k tokens must go into what these leave.
    """
    size = np.arange(capacity + 1)
    number, tokens = np.cumsum(counts), np.cumsum(counts * size)
    half = capacity // 2
    over_half = int(number[-1] - number[half])
    best = -(-int(tokens[-1]) // capacity)
    k = np.arange(0, half + 1)
    alone = number[-1] - number[capacity - k]
    paired = number[capacity - k] - number[half]
    paired_tokens = tokens[capacity - k] - tokens[half]
    below = np.where(k > 0, tokens[np.maximum(k - 1, 0)], 0)
    small_tokens = tokens[half] - below
    extra = np.maximum(0, -(-(small_tokens - (paired * capacity - paired_tokens)) // capacity))
    return max(best, over_half, int((alone + paired + extra).max()))


class Fillings(list):
    """Fillings, best first; ``complete`` is false if the search for them was cut off."""

    complete = True


def _dominated(chosen: dict[int, int], waste: int, left_out: int) -> bool:
    """True if a piece left out (a bit set of lengths) could replace some of the filling's, or none,
    and fit: lengths that exceed a sum of chosen pieces by at most the waste."""
    sums = 1
    for size, times in chosen.items():
        for _ in range(times):
            sums |= sums << size
    spread, width = sums << 1, 1
    while width < waste:
        more = min(width, waste - width)
        spread, width = spread | spread << more, width + more
    return bool(spread & left_out)


def fillings(
    counts: np.ndarray, room: int, most: int, thrift: float = 0.0, tries: int = 600
) -> Fillings:
    """Undominated fillings of ``room``, at most ``most`` of them, the best one first.

    Best is the least waste, with ``thrift`` tokens of waste taken for every piece saved.

    Lengths are tried from the longest down. A filling is dominated when a piece left out could
    take the place of some of its pieces, or of none, and still fit: the longer piece
    in the sequence leaves the easier rest. Enough full fillings, or ``tries`` places tried, end
    the search; the result is then marked as not complete.
    """
    lengths = np.flatnonzero(counts[: room + 1])
    number = dict(zip(lengths.tolist(), counts[lengths].tolist()))
    there = sum(1 << s for s in number)
    found: list[tuple[int, dict[int, int]]] = []
    chosen: dict[int, int] = {}
    open_tries, full = tries, 0

    def visit(below: int, left: int) -> None:
        """All ways to go on with lengths under ``below``."""
        nonlocal open_tries, full
        open_tries -= 1
        if open_tries < 0 or full >= 2 * most:
            return
        fitting = there & ((1 << min(below, left + 1)) - 1)
        if not fitting:
            used_up = sum(1 << s for s, k in chosen.items() if k == number[s])
            if not left or not _dominated(chosen, left, there & ~used_up):
                found.append((left, dict(chosen)))
                full += not left
            return
        while fitting and open_tries >= 0 and full < 2 * most:
            size = fitting.bit_length() - 1
            fitting ^= 1 << size
            for times in range(min(left // size, number[size]), 0, -1):
                chosen[size] = times
                visit(size, left - times * size)
                del chosen[size]

    visit(room + 1, room)
    found.sort(key=lambda f: (f[0] + thrift * sum(f[1].values()), sorted(-s for s in f[1])))
    made = Fillings([filling for _, filling in found[:most]] or [_best_fit(counts, room)])
    made.complete = len(found) <= most and open_tries >= 0 and full < 2 * most
    return made


def _best_fit(counts: np.ndarray, room: int) -> dict[int, int]:
    """The longest piece that fits, again and again."""
    chosen: dict[int, int] = {}
    for size in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        times = min(room // size, int(counts[size]))
        if times:
            chosen[size], room = times, room - times * size
    return chosen


def _place(counts: np.ndarray, first: int, chosen: dict[int, int], once: bool = False) -> Step:
    """Take as many like sequences out of ``counts`` as it has pieces for."""
    whole = dict(chosen)
    whole[first] = whole.get(first, 0) + 1
    times = 1 if once else min(int(counts[s]) // k for s, k in whole.items())
    for size, k in whole.items():
        counts[size] -= k * times
    return Step(tuple(sorted(whole.items(), reverse=True)), times)


def best_fit_plan(counts: np.ndarray, capacity: int) -> list[Step]:
    """The incumbent to beat: each sequence around the longest piece left, filled best fit."""
    counts, steps = counts.copy(), []
    while size := _largest(counts):
        counts[size] -= 1
        chosen = _best_fit(counts, capacity - size)
        counts[size] += 1
        steps.append(_place(counts, size, chosen))
    return steps


def plan(
    counts: np.ndarray, capacity: int, branches: int = 4, prices: tuple[float, ...] = (0.0, 1.5, 6.0),
    nodes: int | None = None,
) -> list[Step]:
    """Steps that pack all pieces: bin completion, depth first, best filling first.

    Every level completes the sequence of the longest piece left, repeated while its pieces last.
    A branch ends when its sequences and the bound of the rest reach the incumbent. Since a
    depth-first search only revises its last choices, it starts anew with other ``prices`` for using
    up small pieces. ``nodes`` bounds each start, by default a quarter more than the incumbent has
    steps, and 200: enough to go down once and to revise. What has been found is a full packing
    at any time, and it is optimal where it meets the bound or a start saw all its branches.
    """
    best = best_fit_plan(counts, capacity)
    target = lower_bound(counts, capacity)
    for price in prices:
        limit = nodes or len(best) * 5 // 4 + 200
        best, complete = _search(counts, capacity, best, target, branches, limit, price)
        if complete or sum(s.times for s in best) <= target:
            break
    return best


def _search(
    counts: np.ndarray, capacity: int, best: list[Step], target: int, branches: int, nodes: int, thrift: float
) -> tuple[list[Step], bool]:
    """(the best packing, true if the search has seen all it branches to)."""
    best_size = sum(s.times for s in best)
    whole = [True]

    def options(rest: np.ndarray) -> list[tuple[int, dict[int, int], bool]]:
        size = _largest(rest)
        rest[size] -= 1
        found = fillings(rest, capacity - size, branches + 1, thrift)
        rest[size] += 1
        whole[0] &= found.complete and len(found) <= branches
        many = [(size, f, False) for f in found[:branches]]
        return many + [(size, f, True) for f in found[:branches] if _repeats(rest, size, f) > 1]

    stack = [(counts.copy(), [], 0, options(counts.copy()))] if best_size > target else []
    while stack and nodes > 0 and best_size > target:
        rest, steps, used, open_options = stack[-1]
        if not open_options:
            stack.pop()
            continue
        size, chosen, once = open_options.pop(0)
        nodes -= 1
        rest = rest.copy()
        step = _place(rest, size, chosen, once)
        now, taken = [*steps, step], used + step.times
        if not rest.any():
            if taken < best_size:
                best, best_size = now, taken
        elif taken + lower_bound(rest, capacity) < best_size:
            stack.append((rest, now, taken, options(rest)))
    return best, not stack and whole[0]


def _repeats(counts: np.ndarray, first: int, chosen: dict[int, int]) -> int:
    whole = dict(chosen)
    whole[first] = whole.get(first, 0) + 1
    return min(int(counts[s]) // k for s, k in whole.items())


class Places:
    """Sequence and offset of the piece of a given length and rank, both counted from 0."""

    def __init__(self, steps: list[Step]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for step in steps:
            offset = 0
            for size, k in step.lengths:
                begin = used.get(size, 0)
                rows.setdefault(size, []).append((begin, k, sequence, offset))
                used[size] = begin + k * step.times
                offset += size * k
            sequence += step.times
        self.rows = {size: np.array(own, np.int64).T for size, own in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for own in np.split(order, cuts) if len(order) else ():
            size = int(lengths[own[0]])
            begins, k, base, offset = self.rows[size]
            at = np.searchsorted(begins, ranks[own], "right") - 1
            turn, slot = np.divmod(ranks[own] - begins[at], k[at])
            sequences[own], offsets[own] = base[at] + turn, offset[at] + slot * size
        return sequences, offsets


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only a first piece is shorter than a sequence."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def pack(
    docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset
    and, unless turned off, its ids.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Longer
    ones than ``capacity`` are cut, repeated rows are packed each. Pieces are tokenised once and
    written to the shared folder, numbered by length within their task; the counts by task and
    length turn these numbers into ranks, so no length is gathered in one place, however common.
    """
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    ids_column = ", ids array<int>" if with_ids else ""

    def tokenise(batches):
        table = bpe.WordIds(bpe.vocabulary(path))
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, own in text_chunks(batches):
            flat, sizes = table.encode(own)
            ends = np.cumsum(sizes)
            columns = {name: [] for name in ("row", "piece", "start", "length", "crc", "rank", "ids")}
            for row, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                ids = np.append(flat[end - size : end], np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(size + 1, capacity)):
                    part = ids[start : start + length]
                    values = (row, piece, start, length, zlib.crc32(part.tobytes()), seen[length], part)
                    seen[length] += 1
                    for name, value in zip(columns, values):
                        columns[name].append(value)
            made = {
                "doc_id": rows.column("doc_id").take(pa.array(columns["row"], pa.int64())),
                "piece": pa.array(columns["piece"], pa.int32()),
                "start": pa.array(columns["start"], pa.int64()),
                "length": pa.array(columns["length"], pa.int64()),
                "ids_crc32": pa.array(columns["crc"], pa.int64()),
                "task": pa.array([task] * len(columns["row"]), pa.int32()),
                "number": pa.array(columns["rank"], pa.int64()),
            }
            if with_ids:
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in columns["ids"]])])
                values = np.concatenate([*columns["ids"], np.zeros(0, "<u4")]).astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_pydict(made)

    pieces = materialize(
        map_arrow(
            texts, tokenise,
            f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long"
            + ids_column,
        ),
        "pieces",
    )
    cells = pieces.groupBy("length", "task").count()
    counts = np.zeros(capacity + 1, np.int64)
    for row in cells.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places = Places(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(
        "length", "task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base")
    )
    ranked = pieces.join(bases, ["length", "task"]).select(
        *(c for c in pieces.columns if c not in ("task", "number")),
        (F.col("base") + F.col("number")).alias("rank"),
    )

    def place(batches):
        for batch in batches:
            sequences, offsets = places.find(
                batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            )
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequences), pa.array(offsets)],
                [*kept.schema.names, "sequence_id", "offset"],
            )

    placed = map_arrow(
        ranked, place,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids_column}, "
        "sequence_id long, offset long",
    )
    return placed.withColumnRenamed("doc_id", id_col)
