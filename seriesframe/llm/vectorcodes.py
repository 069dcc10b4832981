"""Product codes of vectors, learned and assigned over a lexicographic trie of distinct parts.

Components become integers, vectors are cut into equal parts, and each part position has a codebook
that rounds of assignment and averaging improve. Sorted distinct parts of a position are the leaves
of a trie with one component per level. The distances of a prefix to all entries, summed over its
components, are the same for every part below it, so a depth-first traversal hands them down and
adds one component per level; a leaf takes the nearest entry, and its part enters that entry's sums
as often as it occurs. Only distinct parts are kept for the rounds, spread over tasks in the
order of the trie, and only sums per entry come back from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import map_arrow
from seriesframe.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Leaves whose distances are held at once.
BLOCK = 512
# Integer components below this cannot overflow the sums of squares of up to 1024 of them.
LARGEST = 1 << 25


def leaves(parts: np.ndarray, entries: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, squared distances to all entries) of runs of leaves, depth first.

    ``parts`` are the distinct parts in lexicographic order, one per row. Neighbouring subtries of
    at most ``block`` leaves together go down as one, a level at a time.
    """
    depth_of_trie = parts.shape[1]

    def step(values: np.ndarray, depth: int) -> np.ndarray:
        return (values[:, None] - entries[None, :, depth]) ** 2

    def together(begin: int, end: int, depth: int, above: np.ndarray) -> np.ndarray:
        """Distances of all leaves in a run of subtries under one node, with a row per prefix."""
        rows, node = above[None, :], np.zeros(end - begin, np.int64)
        for level in range(depth, depth_of_trie):
            values = parts[begin:end, level]
            opens = np.ones(end - begin, bool)
            opens[1:] = (node[1:] != node[:-1]) | (values[1:] != values[:-1])
            rows = rows[node[opens]] + step(values[opens], level)
            node = np.cumsum(opens) - 1
        return rows[node]

    stack = [(0, len(parts), 0, np.zeros(len(entries), np.int64))] if len(parts) else []
    while stack:
        begin, end, depth, above = stack.pop()
        while depth < depth_of_trie and parts[begin, depth] == parts[end - 1, depth]:
            above = above + step(parts[begin : begin + 1, depth], depth)[0]
            depth += 1
        if end - begin <= block or depth == depth_of_trie:
            yield begin, end, together(begin, end, depth, above)
            continue
        cuts = np.flatnonzero(np.diff(parts[begin:end, depth])) + begin + 1
        children = list(zip([begin, *cuts.tolist()], [*cuts.tolist(), end]))
        runs = [children[0]]
        for first, last in children[1:]:
            if last - runs[-1][0] <= block:
                runs[-1] = (runs[-1][0], last)
            else:
                runs.append((first, last))
        stack += [(first, last, depth, above) for first, last in reversed(runs)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of every row; ties go to the lower index.

    Rows may come in any order and more than once; the trie holds their distinct ones.
    """
    if not len(parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, where = np.unique(parts, axis=0, return_inverse=True)
    chosen, apart = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    for begin, end, distances in leaves(distinct, entries):
        chosen[begin:end] = distances.argmin(1)
        apart[begin:end] = np.take_along_axis(distances, chosen[begin:end, None], 1)[:, 0]
    where = where.reshape(-1)
    return chosen[where], apart[where]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    made = column.flatten().to_numpy().reshape(-1, width)
    if len(made) and max(-int(made.min()), int(made.max())) >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling; use a smaller scale")
    return made


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label and the integer vector of every row with finite components alone."""
    vector = F.col(f"`{vector_col}`")

    def finite(x: Column) -> Column:
        value = x.cast("double")
        return x.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))

    return vectors.filter(vector.isNotNull() & F.forall(vector, finite)).select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"),
    )


def learn(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """Codebooks (part position, entry, component) of rows with ``vec_id`` and an integer ``vector``;
    None without rows.

    They start as the parts of the ``entries`` smallest ids (fewer rows: fewer entries), of equal
    ids those with the smaller vectors. Each round's sums come from the distinct parts, kept in
    the shared folder in the order of the trie with their counts.
    """
    first = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "vector").limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    if not length or length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    width = length // parts
    seeds = [r["vector"] for r in first if len(r["vector"]) == length]
    books = np.array(seeds, np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    cut = F.array(*(
        F.struct(F.lit(p).alias("position"), F.slice("vector", p * width + 1, width).alias("part"))
        for p in range(parts)
    ))
    distinct = (
        rows.filter(F.size("vector") == length).select(F.inline(cut))
        .groupBy("position", "part").agg(F.count("*").alias("n"))
    )
    distinct = materialize(
        distinct.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts"
    )
    for _ in range(rounds):
        total = _sums(distinct, books).groupBy("position", "entry").agg(
            F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums")
        )
        for row in total.collect():  # parts x entries rows at most
            books[row["position"], row["entry"]] = np.floor_divide(np.array(row["sums"], np.int64), row["n"])
    return books


def _sums(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """Weighted sums of the parts nearest to each entry, one row per task, position and entry."""
    width = books.shape[2]

    def add(batches):
        sums, numbers = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            matrix = _matrix(batch.column("part"), width)
            positions, weights = batch.column("position").to_numpy(), batch.column("n").to_numpy()
            for position in np.unique(positions).tolist():
                own = positions == position
                chosen, _ = nearest(matrix[own], books[position])
                np.add.at(sums[position], chosen, matrix[own] * weights[own, None])
                np.add.at(numbers[position], chosen, weights[own])
        at = np.nonzero(numbers)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(numbers[at], pa.int64()),
             pa.array(sums[at].tolist(), pa.list_(pa.int64()))],
            ["position", "entry", "n", "sums"],
        )

    return map_arrow(distinct, add, "position int, entry int, n long, sums array<long>")


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (entry by part position) and error of every row."""
    parts, _, width = books.shape
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def encode(batches):
        for batch in batches:
            matrix = _matrix(batch.column("vector"), parts * width)
            found = [nearest(matrix[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            codes = np.stack([chosen for chosen, _ in found], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes.tolist(), pa.list_(pa.int32())),
                 pa.array(sum(apart for _, apart in found), pa.int64())],
                ["vec_id", "label", "codes", "error"],
            )

    return map_arrow(
        rows.filter(F.size("vector") == parts * width), encode,
        f"vec_id {kind['vec_id']}, label {kind['label']}, codes array<int>, error long",
    )


def written(books: np.ndarray) -> str:
    """All components as decimal integers, by part position, entry and component."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, np.ndarray | None]:
    """(one row per kept vector: id, label, codes, error, label_error; the codebooks).

    ``error`` is the squared distance to the coded vector, in scaled integers; ``label_error`` its
    sum over rows of the same label, those without a label together. Left out are null vectors,
    vectors with a null or non-finite component, and those of another length than the vector with
    the smallest id. Repeated rows are rows of their own, null ids come last in the order of ids,
    further columns are not read, and a table without vectors gives no rows and no codebooks.
    """
    rows = _kept(vectors, id_col, vector_col, label_col, scale)
    books = learn(rows, parts, entries, rounds)
    if books is None:
        made = rows.limit(0).select(
            "vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")
        )
    else:
        made = materialize(assign(rows, books), "codes")
    totals = made.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = made.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("vec_id").alias(id_col), "label", "codes", "error", "label_error"), books


def digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(("" if books is None else written(books)).encode()).hexdigest()
