"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is its five-word shingles, weighted by their counts. Every shingle sends exponential
arrivals into the registers of the signature, each register once, in an order of its own; the
earlier an arrival the sooner the larger the weight. A register keeps its first shingle, and a
shingle whose next arrival is later than every register's first one is finished. Two documents
agree in a register with a probability equal to their probability Jaccard similarity. With all
weights 1 that is the plain Jaccard similarity, so a text that repeats shingles has a second
signature of its plain set; both are banded alike, and in a text without repeats they are the same.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import map_arrow, text_chunks, texts_of
from seriesframe.llm.bits import among
from seriesframe.llm.components import components
from seriesframe.session import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REGISTERS = 256
BAND_ROWS, BANDS = 4, 16
SPREADS = 4.5
HUBS = 2
BLOCK = 500
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ROOM_PER_MEMBER = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        self[word] = value = zlib.crc32(data) | zlib.adler32(data[::-1]) << 32
        return value


class Shingler:
    """Hashed shingles of texts with their counts; word hashes are kept."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words = words
        self.hashes = _WordHashes()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct shingle hashes, counts). A shorter text is one shingle, an empty one none."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.hashes) > 200_000:
            self.hashes.clear()
        numbers = np.array([*map(self.hashes.__getitem__, words)], np.uint64)
        size = min(self.words, len(numbers))
        count = len(numbers) - size + 1
        value = np.full(count, size, np.uint64)
        for k in range(size):
            value = _mixed(value * _STEP + numbers[k : k + count])
        return np.unique(value, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of shingle hashes per weighted set; ``registers`` is a power of two.

    Arrival i of a shingle of weight w comes an exponential time of rate w * (registers - i) after
    the one before, into register (a * i + b) mod registers with an odd a and b of the shingle's own.
    """
    n = len(bags)
    first, winner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    if not len(owner):
        return winner.reshape(n, registers)
    shingle = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype(float)
    order = _mixed(shingle ^ _STEP)
    mask = np.uint64(registers - 1)
    odd, offset = (order >> np.uint64(20)) | np.uint64(1), order >> np.uint64(40)
    time, active = np.zeros(len(owner)), np.arange(len(owner))
    steps = np.arange(1, registers + 1, dtype=np.uint64) * _STEP
    for i in range(registers):
        seed = _mixed(shingle[active] + steps[i])
        uniform = ((seed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        time[active] += -np.log(uniform) / (weight[active] * (registers - i))
        register = ((odd[active] * np.uint64(i) + offset[active]) & mask).astype(np.int64)
        place = owner[active] * registers + register
        now = time[active]
        early = now < first[place]
        np.minimum.at(first, place[early], now[early])
        won = early & (now == first[place])
        winner[place[won]] = shingle[active[won]]
        last = first.reshape(n, registers).max(1)
        active = active[now < last[owner[active]]]
        if not len(active):
            break
    return winner.reshape(n, registers)


def bands_of(signature: np.ndarray, rows: int = BAND_ROWS, bands: int = BANDS) -> np.ndarray:
    """One hash per band of ``rows`` registers, for each signature."""
    bands = signature[:, : rows * bands].reshape(len(signature), -1, rows)
    value = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        value = _mixed(value * _STEP + bands[:, :, k])
    return value.astype(np.int64)


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """One bit of every register, as 64-bit integers: unlike registers differ in half of their bits."""
    bits = (_mixed(signature + _STEP) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def most_unlike_bits(similarity: float, registers: int) -> int:
    """Unlike sketch bits that a pair of this similarity exceeds by ``SPREADS`` deviations only."""
    share = (1 - similarity) / 2
    return int(registers * share + SPREADS * (registers * share * (1 - share)) ** 0.5)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(probability Jaccard of the weighted sets, plain Jaccard of the sets)."""
    every = np.union1d(a[0], b[0])
    if not len(every):
        return 0.0, 0.0
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    ratio = np.divide(x, y, out=np.full(len(every), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    ordered = ratio[order]
    below = np.concatenate([[0.0], np.cumsum(y[order])])
    above = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    at = np.searchsorted(ordered, ratio[both], "left")
    probability = float((x[both] / (above[at] + ratio[both] * below[at])).sum())
    return probability, float(both.mean())


def node_of(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()


def _banded(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, list]:
    """(bands, sketch) of every bag: those of the counted shingles, then, where shingles repeat,
    those of the plain set."""
    counted = signatures(bags)
    repeats = [k for k, (_, counts) in enumerate(bags) if counts.max(initial=1) > 1]
    plain = signatures([(bags[k][0], np.ones_like(bags[k][1])) for k in repeats])
    made = []
    for values in (bands_of, sketch_of):
        lists = values(counted).tolist()
        for k, more in zip(repeats, values(plain).tolist() if repeats else []):
            lists[k] += more
        made.append(lists)
    return made[0], made[1]


def _node():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _signed(texts: DataFrame) -> DataFrame:
    """doc_id, node (a digest of the text), bands and sketch (null for a text without words)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        shingler = Shingler()
        for chunk, own in text_chunks(batches):
            bags = [shingler(t) for t in own]
            bands, sketches = _banded(bags)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array([node_of(t) for t in own], pa.binary()),
                 *(pa.array([v if len(b[0]) else None for v, b in zip(values, bags)], lists)
                   for values in (bands, sketches))],
                ["doc_id", "node", "bands", "sketch"],
            )

    return map_arrow(texts, sign, f"doc_id {kind}, node binary, bands array<long>, sketch array<long>")


def _alike(similarity: float):
    """True for pairs of sketches ``sx``, ``sy`` that may come from texts this similar, counted or plain."""
    words = REGISTERS // 64

    def near(word):
        unlike = F.lit(0)
        for k in range(words):
            unlike = unlike + F.bit_count(word("sx", k).bitwiseXOR(word("sy", k)))
        return unlike <= most_unlike_bits(similarity, REGISTERS)

    def counted(sketch, k):
        return F.get(sketch, F.lit(k))

    def plain(sketch, k):
        return F.coalesce(F.get(sketch, F.lit(words + k)), F.get(sketch, F.lit(k)))

    return near(counted) | near(plain)


def _both(lists: list[list[int]], size: int) -> np.ndarray:
    """Bands or sketches as (texts, 2, size): counted and plain, the same in a text without repeats."""
    return np.array([x if len(x) > size else x + x for x in lists], np.int64).reshape(-1, 2, size)


def _linked(a: tuple, b: tuple, similarity: float) -> bool:
    """``a`` and ``b`` are (shingles, counts), sorted; counts are None where all are 1."""
    if a[1] is None and b[1] is None:
        # Without repeated shingles both similarities are the plain one.
        shared = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return shared >= (similarity - 1e-9) * (len(a[0]) + len(b[0]) - shared) and shared > 0
    sets = [(keys, np.ones(len(keys)) if counts is None else counts) for keys, counts in (a, b)]
    return max(similarities(*sets)) >= similarity - 1e-9


def _bags(table, shingles: str, counts: str) -> list[tuple]:
    return [
        (s.values.to_numpy(), c.values.to_numpy() if c.is_valid else None)
        for s, c in zip(table.column(shingles), table.column(counts))
    ]


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.Table:
    columns = list(zip(*((min(p), max(p)) for p in found))) or [(), ()]
    return pa.table([pa.array(c, pa.binary()) for c in columns], schema=_PAIR)


class _Links:
    """Verified links between texts, and the components that they make so far."""

    def __init__(self, members: DataFrame, shingles: DataFrame, similarity: float):
        self.members, self.shingles, self.similarity = members, shingles, similarity
        self.links = members.sparkSession.createDataFrame([], "a binary, b binary")
        self.labels = members.sparkSession.createDataFrame([], "node binary, label binary")
        # Members of buckets with the label of their component so far.
        self.placed = members.withColumn("label", F.col("node"))

    def open_pairs(self) -> tuple[int, int]:
        """(pairs of one bucket but two components, rows of such buckets)."""
        by_label = self.placed.groupBy("bucket", "label").agg(F.count("*").cast("double").alias("n"))
        row = by_label.groupBy("bucket").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")
        ).filter(F.col("n") * F.col("n") > F.col("squares")).agg(
            F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.sum("n")
        ).first()
        return int(row[0] or 0), int(row[1] or 0)

    def star(self, turn: int) -> None:
        """Test some members of each bucket against its members that are in other components.

        Hubs have the least hashes of their bucket, whatever the bucket, so texts that share many
        buckets meet few different hubs in them.
        """
        drawn = [
            F.min_by(
                F.struct(F.col("node").alias("y"), F.col("label").alias("ly"), F.col("sketch").alias("sy")),
                F.xxhash64("node", F.lit(turn * HUBS + k)),
            )
            for k in range(HUBS)
        ]
        hubs = self.placed.groupBy("bucket").agg(
            F.array(*drawn).alias("hubs"), F.min("label").alias("low"), F.max("label").alias("high"),
        ).filter("low <> high").select("bucket", "hubs")
        met = self.placed.withColumnsRenamed({"node": "x", "label": "lx", "sketch": "sx"}).join(hubs, "bucket")
        near = F.filter("hubs", lambda h: (h["ly"] != F.col("lx")))
        pairs = met.select("x", "sx", F.explode(near).alias("hub")).select("x", "sx", "hub.y", "hub.sy")
        ends = pairs.filter(_alike(self.similarity)).select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        )
        new = materialize(ends.distinct(), "pairs")
        one = self.shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
        two = self.shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
        similarity = self.similarity

        def verify(batches):
            for batch in batches:
                good = [
                    _linked(a, b, similarity)
                    for a, b in zip(_bags(batch, "sa", "ca"), _bags(batch, "sb", "cb"))
                ]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        self._add(map_arrow(new.join(one, "a").join(two, "b"), verify, "a binary, b binary"))

    def _add(self, found: DataFrame) -> None:
        self.links = materialize(found.union(self.links), "links")
        self.labels = components(self.links)

    def place(self) -> None:
        placed = self.members.join(self.labels, "node", "left")
        self.placed = materialize(placed.withColumn("label", F.coalesce("label", "node")), "placed")

    def rest(self) -> None:
        """Test all pairs of one bucket that are in different components.

        A bucket is cut into blocks of about ``BLOCK`` members and a task gets two blocks, so rows
        are copied once per block and no pair is ever a row. A pair is tested in the first band that
        it shares, counted or plain.
        """
        sizes = self.placed.groupBy("bucket").agg(
            F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
        ).filter("low <> high").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("node", F.lit(0)), F.col("blocks")).cast("int")
        dealt = self.placed.join(sizes, "bucket").withColumn("own", own).join(self.shingles, "node")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        rows = dealt.select("bucket", "band", "own", other, "node", "label", "sketch", "bands", "shingles", "counts")
        rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
        similarity, most = self.similarity, most_unlike_bits(self.similarity, REGISTERS)

        def compare(table: pa.Table) -> pa.Table:
            i, j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
            block = table.column("own").to_numpy()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            nodes, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
            number = {label: k for k, label in enumerate(dict.fromkeys(labels))}
            label = np.array([number[x] for x in labels])
            sketch = _both(table.column("sketch").to_pylist(), REGISTERS // 64).view(np.uint64)
            bands = _both(table.column("bands").to_pylist(), BANDS)
            bags, found = _bags(table, "shingles", "counts"), []
            for x in left:
                ys = right[right > x] if i == j else right
                ys = ys[label[ys] != label[x]]
                ys = ys[np.bitwise_count(sketch[ys] ^ sketch[x]).sum(2).min(1) <= most]
                shared = (bands[ys] == bands[x]) | (bands[ys] == bands[x, ::-1])
                ys = ys[shared.any(1).argmax(1) == band]
                found += ((nodes[x], nodes[y]) for y in ys if _linked(bags[x], bags[y], similarity))
            return _pairs(found)

        self._add(rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary"))


def near_classes(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, node (a digest of the text) and label: texts are in one class if links join them.

    Two texts are linked if their probability Jaccard over counted shingles, or their plain Jaccard
    over shingles, is at least ``similarity``; candidates are texts that share a band of either
    signature and whose sketches, a bit per register, do not rule out both. Equal texts are one node. Within a band's
    bucket a few members at a time are tested against those in other components, so a bucket of
    many copies costs a few rows per member. When few pairs are left between components, or
    another turn would not halve them, they are all tested in blocks: no candidate link is left out.
    """
    texts = texts_of(docs, id_col, text_col)
    signed = materialize(_signed(texts), "signed")
    nodes = signed.filter("bands IS NOT NULL").groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    # A plain band that is also the counted one is the same bucket.
    banded = nodes.select("node", "sketch", "bands", F.posexplode("bands").alias("at", "hash")).filter(
        (F.col("at") < BANDS) | (F.col("hash") != F.get("bands", F.col("at") - BANDS))
    ).withColumn("band", F.col("at") % BANDS).select(
        "node", "sketch", "band", F.xxhash64("band", "hash").alias("bucket")
    )
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = shared.filter("low <> high").select("bucket")
    members = materialize(banded.join(shared, "bucket", "left_semi"), "members")
    wanted = materialize(
        members.select("node").distinct().withColumn("hash", F.xxhash64("node")), "wanted"
    )

    def shingle(batches):
        shingler = Shingler()
        for chunk, own in text_chunks(batches):
            bags = [shingler(t) for t in own]
            bands, _ = _banded(bags)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("node"), pa.array(bands, pa.list_(pa.int64())),
                 pa.array([np.sort(b[0].astype(np.int64)) if b[1].max(initial=1) == 1 else b[0].astype(np.int64) for b in bags], pa.list_(pa.int64())),
                 pa.array([b[1].astype(np.int32) if b[1].max(initial=1) > 1 else None for b in bags], pa.list_(pa.int32()))],
                ["node", "bands", "shingles", "counts"],
            )

    keyed = texts.withColumn("node", _node()).withColumn("hash", F.xxhash64("node"))
    chosen = among(keyed, wanted, "hash").join(wanted.select("node"), "node")
    once = chosen.groupBy("node").agg(F.first("text").alias("text"))
    shingles = materialize(
        map_arrow(once, shingle, "node binary, bands array<long>, shingles array<long>, counts array<int>"),
        "shingles",
    )
    links = _Links(members, shingles, similarity)
    pairs, rows = links.open_pairs()
    turn, before = 0, None
    while pairs > _ROOM_PER_MEMBER * rows and (before is None or pairs <= before / 2):
        links.star(turn)
        links.place()
        before, turn = pairs, turn + 1
        pairs, rows = links.open_pairs()
    if pairs:
        links.rest()
    return signed.join(links.labels, "node", "left").select(
        "doc_id", "node", F.coalesce("label", "node").alias("label")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class) and class_size.

    A null text counts as empty; texts without words are one class if equal. Repeated rows are each
    a row of the result. Ids that are null take no part in the smallest id.
    """
    classes = materialize(near_classes(docs, id_col=id_col, text_col=text_col, **options), "classes")
    sizes = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return classes.join(sizes, "label").select(F.col("doc_id").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, one of each class: the one with the smallest id, of equal ids any one.

    Only classes of several rows are joined to the texts.
    """
    classes = materialize(near_classes(docs, id_col=id_col, text_col=text_col, **options), "classes")
    sizes = classes.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("first"),
        F.count("*").alias("size"),
    ).filter("size > 1")
    several = classes.join(sizes, "label").groupBy("label", "node", "first").agg(F.lit(1))
    several = materialize(
        several.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.node").alias("first_node")), "several"
    )
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    # Rows travel as one struct, so that their columns cannot clash with these.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.md5(text)).alias("node"),
        F.col(f"`{id_col}`").alias("own_id"),
    )
    marked = rows.join(several, "node", "left")
    alone = marked.filter("first_node IS NULL").select("row.*")
    firsts = marked.filter((F.col("node") == F.col("first_node")) & F.col("own_id").eqNullSafe(F.col("first_id")))
    return alone.union(firsts.dropDuplicates(["first_node"]).select("row.*"))
