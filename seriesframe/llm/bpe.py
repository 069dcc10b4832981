"""Byte-level BPE: a distinct-word table, ids joined back by position, decoding by pieces.

A word is the text from one space up to the next. The pre-tokenizer never joins characters across
a cut before a space that follows a non-space, so the ids of a text are those of its words in order.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from seriesframe.llm.arrow import gather, map_arrow, text_chunks, texts_of

BLOCK_CHARS = 32_000_000
CACHED_WORDS = 200_000
MARK = "￿"
FIRST, ESCAPED = MARK + "0", MARK + "1"
_SPACE_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s)(?= )")
_PLAIN = re.compile("[\t\n!-~¡-ɏ]+")
# Fixed value: the pre-tokenizer's pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def words_of(text: str | None) -> list[str]:
    """Keys of a text's words: without their leading space, the first one marked as such."""
    if not text:
        return []
    if MARK not in text and not _SPACE_RUN.search(text):
        words = text.split(" ")
        words[0] = FIRST + words[0]
        return words
    first, *rest = _CUT.split(text)
    return [FIRST + first, *(ESCAPED + w[1:] if w[1:2] == MARK else w[1:] for w in rest)]


def spelled(key: str) -> str:
    """The piece of text that a word's key stands for."""
    if key.startswith(MARK):
        return key[2:] if key.startswith(FIRST) else " " + key[2:]
    return " " + key


class Vocabulary:
    """Encodes words and knows the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.added = [token["content"] for token in spec["added_tokens"]]
        ranks = {
            bytes(of_char[c] for c in token): i
            for token, i in spec["model"]["vocab"].items() if token not in self.added
        }
        pieces = {i: piece for piece, i in ranks.items()}
        pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.binary())
        self.sizes = np.array([len(p.as_py()) for p in self.pieces], np.int64)
        self.opens = np.array([p.as_py()[:1] == b" " for p in self.pieces])
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._ranks = tiktoken.Encoding(
            "words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word).

        Runs of plain Latin words go through the rank encoder in one call, since only a word's
        first id opens with a space; all others through the tokenizer itself.
        """
        parts: list[np.ndarray] = [None] * len(keys)
        plain, rest = [], []
        for i, key in enumerate(keys):
            simple = _PLAIN.fullmatch(key) and not any(a in key for a in self.added)
            (plain if simple else rest).append(i)
        for at in range(0, len(plain), 4096):
            run = plain[at : at + 4096]
            ids = np.array(self._ranks.encode_ordinary("".join(" " + keys[i] for i in run)), np.uint32)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(run):
                for i, part in zip(run, np.split(ids, begins[1:])):
                    parts[i] = part
            else:
                rest += run
        for at in range(0, len(rest), 4096):
            run = rest[at : at + 4096]
            found = self._tokenizer.encode_batch([spelled(keys[i]) for i in run], add_special_tokens=False)
            for i, one in zip(run, found):
                parts[i] = np.array(one.ids, np.uint32)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' pieces: a join of the ids with the piece table by position."""
        if not len(ids):
            return b""
        _, offsets, data = self.pieces.take(pa.array(ids, pa.uint32())).buffers()
        return data.to_pybytes()[: int(np.frombuffer(offsets, np.int32)[len(ids)])]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordIds:
    """A table word -> ids that grows as words come, for texts of one task or block."""

    class _Numbers(dict):
        def __missing__(self, key):
            self[key] = number = len(self)
            return number

    def __init__(self, vocab: Vocabulary, most: int | None = CACHED_WORDS):
        self.vocab, self.most = vocab, most
        self.clear()

    def clear(self) -> None:
        self.number = self._Numbers()
        self.flat, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def put(self, keys: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        """Take over words, new ones all, with their ids."""
        for key in keys:
            self.number[key]
        self._extend(flat, counts)

    def _extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        self.starts = np.cumsum(self.counts) - self.counts

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each); missing words are encoded here."""
        if self.most and len(self.number) > self.most:
            self.clear()
        sizes, numbers = [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            numbers += map(self.number.__getitem__, words)
        known = len(self.counts)
        if len(self.number) > known:
            self._extend(*self.vocab.encode(list(self.number)[known:]))
        index = np.array(numbers, np.int64)
        lengths = self.counts[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        return gather(self.flat, self.starts[index], lengths), np.diff(ends[bounds])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list]]:
    """Rows with the number of the block they belong to: runs of a task's rows."""
    task, block, size = TaskContext.get().partitionId() << 32, 0, 0
    for rows, texts in text_chunks(batches):
        chars = sum(len(t or "") for t in texts)
        if size and size + chars > BLOCK_CHARS:
            block, size = block + 1, 0
        size += chars
        yield task + block, rows, texts


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _dealt(words: Iterable[str], slots: int) -> dict[int, list[str]]:
    """The words of each slot, sorted."""
    dealt: dict[int, list[str]] = {}
    for word in words:
        dealt.setdefault(zlib.crc32(word.encode("utf-8", "surrogatepass")) % slots, []).append(word)
    return {slot: sorted(own) for slot, own in dealt.items()}


def _check(words: list[str]) -> int:
    return zlib.crc32("\0".join(words).encode("utf-8", "surrogatepass"))


_SLOTS = pa.schema([("slot", pa.int32()), ("block", pa.int64()), ("words", pa.binary())])
_FOUND = pa.schema(
    [("block", pa.int64()), ("slot", pa.int32()), ("words", pa.int64()), ("ids", pa.binary())]
)
_TEXTS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("rows", pa.binary())])


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    finish=None, schema: str = "ids array<int>, decoded string",
) -> DataFrame:
    """One row per document: its id, BPE ids and the text decoded from them.

    Three steps. Each block of texts sends its distinct words, dealt into slots by word. A slot's
    task holds the table of its distinct words, encodes each once and answers every block that
    asked with ids in the order of its words. The block's texts meet the answers and put the ids in
    the words' places. Texts travel once, compressed, words once, ids without their words. A block holds about 32 million characters, a slot a share of the vocabulary,
    and a word occurs once per block at most, so frequent words burden no task.

    A null or empty text has no ids. Blocks follow the row order of ``docs``; should a recomputed
    task see another order, the checksum of a slot's words does not fit and they are encoded where
    they stand.
    ``finish(ids, decoded bytes)`` may turn each result into other columns, named in ``schema``.
    """
    spark = docs.sparkSession
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    finish = finish or (lambda ids, decoded: (ids.tolist(), decoded.decode("utf-8", "replace")))

    def ask(batches):
        open_block, words = None, set()

        def sent():
            return _rows(_SLOTS, [
                (slot, open_block, _pack(pa.record_batch([pa.array(own, pa.string())], ["word"])))
                for slot, own in _dealt(words, slots).items()
            ])

        for block, _, chunk in _blocks(batches):
            if block != open_block:
                if words:
                    yield sent()
                open_block, words = block, set()
            for text in chunk:
                words.update(words_of(text))
        if words:
            yield sent()

    def answer(table: pa.Table) -> pa.Table:
        vocab = vocabulary(path)
        narrow = np.uint16 if len(vocab.pieces) <= 1 << 16 else np.uint32
        number = WordIds._Numbers()
        asked = []
        for slot, block, packed in zip(*(table.column(c) for c in ("slot", "block", "words"))):
            own = _unpack(packed.as_buffer()).column(0).to_pylist()
            asked.append((block.as_py(), slot.as_py(), _check(own), np.array([number[w] for w in own])))
        flat, counts = vocab.encode(list(number))
        starts = np.cumsum(counts) - counts
        rows = []
        for block, slot, check, index in asked:
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts[index])]), pa.int32()),
                pa.array(gather(flat, starts[index], counts[index]).astype(narrow)),
            )
            rows.append((block, slot, check, _pack(pa.record_batch([ids], ["ids"]))))
        return pa.Table.from_batches([_rows(_FOUND, rows)])

    def send(batches):
        for place, (block, rows, _) in enumerate(_blocks(batches)):
            yield _rows(_TEXTS, [(block, place, _pack(rows))])

    result_schema = f"doc_id {kind}, {schema}"

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        vocab = vocabulary(path)
        table = WordIds(vocab, None)
        keys, flats, counts = [], [], []
        sent_rows = [_unpack(p.as_buffer()) for p in left.sort_by("place").column("rows")]
        words = {w for rows in sent_rows for t in rows.column("text").to_pylist() for w in words_of(t)}
        dealt = _dealt(words, slots)
        for slot, check, packed in zip(*(right.column(c) for c in ("slot", "words", "ids"))):
            own = dealt.get(slot.as_py(), [])
            if own and _check(own) == check.as_py():
                ids = _unpack(packed.as_buffer()).column(0)
                keys.append(own)
                flats.append(ids.flatten().to_numpy().astype(np.uint32))
                counts.append(np.diff(ids.offsets.to_numpy()))
        if keys:
            table.put(
                [w for own in keys for w in own], np.concatenate(flats),
                np.concatenate(counts).astype(np.int64),
            )
        made = []
        for rows in sent_rows:
            ids, sizes = table.encode(rows.column("text").to_pylist())
            data = vocab.decode(ids)
            lengths = np.concatenate([[0], np.cumsum(vocab.sizes[ids])])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            results = [
                finish(ids[a:b], data[lengths[a] : lengths[b]]) for a, b in zip(ends[:-1], ends[1:])
            ]
            made.append(pa.RecordBatch.from_arrays(
                [rows.column("doc_id"),
                 *(pa.array([r[i] for r in results], f.type) for i, f in enumerate(fields))],
                ["doc_id", *(f.name for f in fields)],
            ))
        return pa.Table.from_batches(made)

    fields = list(to_arrow_schema(StructType.fromDDL(schema)))
    found = (
        map_arrow(texts, ask, "slot int, block long, words binary")
        .groupBy("slot").applyInArrow(answer, "block long, slot int, words long, ids binary")
    )
    sent = map_arrow(texts, send, "block long, place int, rows binary")
    made = sent.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(assemble, result_schema)
    return made.select(F.col("doc_id").alias(id_col), *(f.name for f in fields))
