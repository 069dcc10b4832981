"""Removal of word passages that repeat across documents, by a compressed FM-index per shard.

Every window of words has an anchor, the short word sequence in it whose hash is smallest. Equal
windows have equal anchors, so runs of windows with one anchor, cut out as segments, can be dealt
into shards by it, and only anchors of several documents matter. A shard builds the FM-index of its
distinct segments: their suffixes in order and the words before them in a wavelet tree. It streams
the segments through the index by backward search, from the last word to the first. The interval of
suffixes that start with the words read so far is the matching statistic, capped at a window's
length; a full window's interval names the smallest document in which the window occurs.

An anchor so common that its segments would burden one shard is refined: its windows are parted by
where the anchor lies in them, and each part is keyed by all words that its windows have in common.
Halves of halves end in single windows, of which only one copy is left, so shards stay bounded.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.arrow import map_arrow, ship, text_chunks
from seriesframe.llm.bits import among
from seriesframe.session import materialize

WINDOW, ANCHOR = 50, 8
SHARD_WORDS, KEY_WORDS = 200_000, 50_000
_LAST_ID = (1 << 63) - 1
_PLACE_BITS = 26
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = zlib.crc32(word) | zlib.adler32(word[::-1]) << 32
        return value


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or b"").split()


def segments_of(
    numbers: np.ndarray, sizes: np.ndarray, window: int, anchor: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, windows, words before the anchor, anchor's hash) of each run of windows
    with one anchor; ``numbers`` are the word hashes of texts of the given sizes, joined."""
    ends = np.cumsum(sizes)
    count = len(numbers) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    value = np.full(len(numbers) - anchor + 1, anchor, np.uint64)
    for k in range(anchor):
        value = _mixed(value * _STEP + numbers[k : k + len(value)])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (value & ~low) | np.arange(len(value), dtype=np.uint64)
    width, span = 1, window - anchor + 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:count], least[span - width : span - width + count])
    place = (least & low).astype(np.int64)
    start = np.arange(count)
    text = np.searchsorted(ends, start, "right")
    whole = start + window <= ends[text]
    opens = np.ones(count, bool)
    opens[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    opens &= whole
    first = np.flatnonzero(opens)
    # A run ends before the next one, at the latest at the last window of its text.
    stop = np.minimum(np.append(first[1:], count), ends[text[first]] - window + 1)
    at = place[first]
    begins = (ends - sizes)[text[first]]
    return text[first], first - begins, stop - first, at - first, value[at].astype(np.int64)


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector per level, packed, with counts per word of it."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(int(symbols.max(initial=1)).bit_length() - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)]).astype(np.int32)
            zeros = int(len(ones) - ones.sum())
            self.levels.append((bit, words, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def walk(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where ``places`` of the sequence lead in the order of the last level, for each symbol."""
        for bit, words, before, zeros in self.levels:
            at, inside = places >> 6, (places & 63).astype(np.uint64)
            ones = before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << inside) - np.uint64(1)))
            places = np.where(symbols >> bit & 1, zeros + ones, places - ones)
        return places


class FMIndex:
    """Backward search over ``tokens``, whose 0 ends each text; exact for patterns up to ``depth``."""

    def __init__(self, tokens: np.ndarray, depth: int):
        self.size, self.ranks = len(tokens), {}
        rank, width = tokens.astype(np.int64), 1
        self.ranks[1] = rank
        while width < depth:
            ahead = np.zeros_like(rank)
            ahead[:-width or None] = rank[width:] + 1 if width < len(rank) else ahead[:-width or None]
            pair = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(pair, kind="stable")
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.concatenate([[0], pair[order][1:] != pair[order][:-1]]))
            width *= 2
            self.ranks[width] = rank
        self.suffixes = np.argsort(rank, kind="stable")
        self.tree = WaveletTree(tokens[self.suffixes - 1])
        symbols = np.arange(int(tokens.max()) + 1)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(tokens))[:-1]])
        self.shift = smaller - self.tree.walk(symbols, np.zeros(len(symbols), np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with a symbol and what the old intervals start with."""
        both = self.tree.walk(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return both[: len(low)] + self.shift[symbols], both[len(low) :] + self.shift[symbols]

    def blocks(self, length: int) -> np.ndarray:
        """Begins of the runs of suffixes that agree in their first ``length`` words."""
        if not length:
            return np.zeros(1, np.int64)
        width = 1 << (length.bit_length() - 1)
        rank = self.ranks[width]
        later = np.minimum(self.suffixes + length - width, self.size - 1)
        one, two = rank[self.suffixes], rank[later]
        return np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))


def matches(texts: list[list[bytes]], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of every text the smallest owner of a text in which it occurs.

    All texts go through the index of all of them at once, a word of each per step.
    """
    number: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    tokens = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    for begin, text in zip(begins.tolist(), texts):
        tokens[begin : begin + len(text)] = [number.setdefault(w, len(number) + 1) for w in text]
    index = FMIndex(tokens, window)
    owner = np.repeat(owners, sizes + 1)[index.suffixes]
    full = index.blocks(window)
    least = np.minimum.reduceat(owner, full)
    shorter = np.append(index.blocks(window - 1), index.size)
    found = np.zeros(len(tokens), np.int64)
    order = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(texts), np.int64), np.full(len(texts), index.size)
    for step in range(int(sizes.max(initial=0))):
        active = order[: np.searchsorted(-sizes[order], -step, "left")]
        at = begins[active] + sizes[active] - 1 - step
        lo, hi = index.extend(tokens[at], low[active], high[active])
        if step >= window - 1:
            found[at] = least[np.searchsorted(full, lo, "right") - 1]
            # Give up the last word: all suffixes that agree in one word less.
            block = np.searchsorted(shorter, lo, "right") - 1
            lo, hi = shorter[block], shorter[block + 1]
        low[active], high[active] = lo, hi
    return [found[b : b + max(0, n - window + 1)] for b, n in zip(begins.tolist(), sizes.tolist())]


def _anchors(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """owner, text_key, start, windows, before and key of every segment."""

    def find(batches):
        hashes = _WordHashes()
        for rows, own in text_chunks(batches):
            if len(hashes) > 200_000:
                hashes.clear()
            words = [words_of(t) for t in own]
            numbers = np.array([h for w in words for h in map(hashes.__getitem__, w)], np.uint64)
            if len(numbers) >> _PLACE_BITS:
                raise ValueError("a text has more words than a place can count")
            text, start, windows, before, key = segments_of(
                numbers, np.array([len(w) for w in words], np.int64), window, anchor
            )
            took = pa.array(text, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("owner").take(took), rows.column("text_key").take(took), pa.array(start, pa.int32()),
                 pa.array(windows, pa.int32()), pa.array(before, pa.int32()), pa.array(key, pa.int64())],
                ["owner", "text_key", "start", "windows", "before", "key"],
            )

    return map_arrow(
        texts, find, "owner long, text_key long, start int, windows int, before int, key long"
    )


_SEGMENT = "owner long, text_key long, start int, windows int, before int, key long, content binary"


def _cut_out(marked: DataFrame, window: int) -> DataFrame:
    """The segments of ``marked`` texts with their words."""

    def cut(batches):
        for rows, own in text_chunks(batches):
            owners, keys = rows.column("owner").to_pylist(), rows.column("text_key").to_pylist()
            made = []
            for owner, text_key, text, marks in zip(owners, keys, own, rows.column("marks").to_pylist()):
                words = words_of(text)
                for m in marks:
                    content = b" ".join(words[m["start"] : m["start"] + m["windows"] + window - 1])
                    made.append((owner, text_key, m["start"], m["windows"], m["before"], m["key"], content))
            yield _batch(made, _SEGMENT)

    return map_arrow(marked, cut, _SEGMENT)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


def halves(
    words: list[bytes], windows: int, before: int, low: int, high: int, window: int
) -> list[tuple[int, int, int, int, int, int, bytes]]:
    """(first word, windows, before, low, high, key, content) of a segment's two parts, windows with up
    to (low + high) / 2 words before the anchor and those with more; an empty part is left out."""
    middle, made = (low + high) // 2, []
    for least, most in ((low, middle), (middle + 1, high)):
        first, last = max(0, before - most), min(windows - 1, before - least)
        if least > most or first > last:
            continue
        part, place = words[first : last + window], before - first
        common = b" ".join(part[place - least : place - most + window])
        key = hashlib.blake2b(b"%d %d " % (least, most) + common, digest_size=8).digest()
        made.append((first, last - first + 1, place, least, most, int.from_bytes(key, "little", signed=True), b" ".join(part)))
    return made


def _content_key() -> Column:
    return F.xxhash64("content").alias("content_key")


_PIECE = (
    "root_key long, root_content long, shift int, windows int, before int, low int, high int, first long, "
    "last long, key long, content binary"
)


def _refine(pieces: DataFrame, window: int) -> DataFrame:
    """The two parts of every piece."""

    def split(batches):
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                parts = halves(r["content"].split(), r["windows"], r["before"], r["low"], r["high"], window)
                made += (
                    (r["root_key"], r["root_content"], r["shift"] + first, windows, before, low, high, r["first"],
                     r["last"], key, content)
                    for first, windows, before, low, high, key, content in parts
                )
            yield _batch(made, _PIECE)

    return map_arrow(pieces.select(*(part.split()[0] for part in _PIECE.split(", "))), split, _PIECE)


def _bounded(segments: DataFrame, window: int, anchor: int, key_words: int) -> tuple[DataFrame, DataFrame]:
    """(contents, places): distinct contents (key, content, first and last owner, words), refined until
    no key has more than ``key_words`` words, and where each stands in which distinct segments.

    Each distinct segment is refined once, however many documents hold it.
    """
    once = segments.groupBy("key", "content").agg(
        F.min("owner").alias("first"), F.max("owner").alias("last"), F.max("windows").alias("windows"),
        F.max("before").alias("before"),
    ).withColumns({
        "root_key": F.col("key"), "root_content": F.xxhash64("content"), "shift": F.lit(0), "low": F.lit(0),
        "high": F.lit(window - anchor),
    })
    pieces = materialize(once, "pieces")
    key_words = max(key_words, window)  # a single window is not refined
    contents, places = [], []
    while True:
        distinct = pieces.groupBy("key", "content").agg(
            F.min("first").alias("first"), F.max("last").alias("last"),
            (F.max("windows") + (window - 1)).cast("long").alias("words"),
        )
        distinct = materialize(distinct, "contents") if contents else pieces.select(
            "key", "content", "first", "last", (F.col("windows") + (window - 1)).cast("long").alias("words")
        )
        hot = distinct.groupBy("key").agg(F.sum("words").alias("all")).filter(F.col("all") > key_words)
        hot = materialize(hot.select("key"), "hot-keys")
        contents.append(distinct.join(hot, "key", "left_anti"))
        places.append(pieces.join(hot, "key", "left_anti"))
        if hot.isEmpty():
            break
        pieces = materialize(_refine(pieces.join(hot, "key", "left_semi"), window), "pieces")

    def every(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    names = ["root_key", "root_content", "shift", "key", _content_key()]
    return every(contents), every([p.select(*names) for p in places])


def _search(contents: DataFrame, window: int, shard_words: int) -> DataFrame:
    """key, content_key, begin, end, first: spans of a content's words all of whose windows start in
    document ``first``, for spans that matter to some owner of the content."""
    total = contents.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    schema = "key long, content_key long, begin int, end int, first long"
    rows = contents.select(
        F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).alias("shard"), "key", "content", _content_key(), "first", "last"
    )

    def report(table: pa.Table) -> pa.Table:
        texts = [c.split() for c in table.column("content").to_pylist()]
        owners, last = table.column("first").to_numpy(), table.column("last").to_numpy()
        keys, content_keys = table.column("key").to_numpy(), table.column("content_key").to_numpy()
        made = []
        for row, firsts in enumerate(matches(texts, owners, window)):
            cuts = [0, *(np.flatnonzero(np.diff(firsts)) + 1).tolist(), len(firsts)]
            made += (
                (keys[row], content_keys[row], begin, end + window - 1, firsts[begin])
                for begin, end in zip(cuts, cuts[1:]) if firsts[begin] < last[row]
            )
        return pa.Table.from_batches([_batch(made, schema)])

    ship(contents.sparkSession)
    return rows.groupBy("shard").applyInArrow(report, schema)


def repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS,
    key_words: int = KEY_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, text (as bytes) and gone, its word spans (begin, end) that are
    covered by windows of ``window`` words which also start in a document with a smaller id; null
    where there is none.

    Ids are integers. A null id counts as the largest, rows with one id do not look at each other,
    repeated rows are rows of the result each. Null and empty texts have no words.
    """
    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST_ID)).alias("owner"),
        F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_key"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
    )
    found = materialize(_anchors(texts.drop("doc_id"), window, anchor), "anchors")
    shared = found.groupBy("key").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    shared = shared.filter("low < high").select("key")
    marks = materialize(
        found.join(shared, "key").groupBy("owner", "text_key").agg(
            F.collect_set(F.struct("start", "windows", "before", "key")).alias("marks")
        ),
        "marks",
    )
    marked = among(texts.drop("doc_id"), marks, "text_key").join(marks, ["owner", "text_key"])
    segments = materialize(_cut_out(marked.select("owner", "text_key", "text", "marks"), window), "segments")
    contents, places = _bounded(segments, window, anchor, key_words)
    found_in = materialize(_search(contents, window, shard_words), "spans").join(places, ["key", "content_key"])
    spans = materialize(
        found_in.select(
            F.col("root_key").alias("key"), F.col("root_content").alias("content_key"), "first",
            (F.col("shift") + F.col("begin")).alias("begin"), (F.col("shift") + F.col("end")).alias("end"),
        ),
        "segment-spans",
    )
    held = segments.select("owner", "text_key", "start", "key", _content_key())
    span = F.struct((F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"))
    gone = held.join(spans, ["key", "content_key"]).filter(F.col("first") < F.col("owner"))
    gone = gone.groupBy("owner", "text_key").agg(F.collect_set(span).alias("gone"))
    return texts.join(materialize(gone, "gone"), ["owner", "text_key"], "left").select("doc_id", "text", "gone")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, text (the words that stay, joined by one space), n_words and
    n_removed; see :func:`repeats`."""
    marked = repeats(docs, id_col=id_col, text_col=text_col, **options)
    kind = marked.schema["doc_id"].dataType.simpleString()

    def keep(batches):
        for rows, own in text_chunks(batches):
            texts, counts, removed = [], [], []
            for text, spans in zip(own, rows.column("gone").to_pylist()):
                words = words_of(text)
                counts.append(len(words))
                if spans:
                    stays = np.ones(len(words), bool)
                    for span in spans:
                        stays[span["begin"] : span["end"]] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                removed.append(counts[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(removed, pa.int64())],
                ["doc_id", "text", "n_words", "n_removed"],
            )

    made = map_arrow(marked, keep, f"doc_id {kind}, text string, n_words long, n_removed long")
    return made.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_removed")
