"""Token ids as flat binary files with 64-bit offsets, in the order of the document key.

A folder holds per shard ``<shard>.ids`` (unsigned little-endian integers of ``width`` bytes,
nothing else) and ``<shard>.idx`` (documents and first position of the shard as two 64-bit numbers, then
per document the key, whether it has one, and documents + 1 offsets in ids from the first id
of the whole folder).  Shards follow the keys, so the ids of all shards one after another are
the ids of all documents in order, and an offset is valid in that joined file as well.

Writing takes three steps.  Texts are dealt by ranges of the key and sorted; every task
encodes its range and writes one shard with offsets from 0; the sizes of the shards are then
added up (a prefix sum over one number per shard) and a last job moves every index to its base.  A file is written under a name of its own and renamed, so a
task that runs twice leaves one whole file.  Readers map the files into memory and take
slices, so a shard may be larger than memory.

The folder must be a place that all executors mount, as flat files are no Spark format.

Results: NULL and empty texts have no ids but the end id.  Rows with a NULL key come first.
Rows that share a key stand in the order of their texts' hashes; equal rows are
interchangeable.  Other columns are not written.  An empty table gives no shards.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm.textkit import stored, take_spans, text_blocks

# characters of chunks a task remembers before it starts over
REMEMBERED_CHARS = 1 << 23
# bytes of text that are cut and encoded at once, and ids that are read at once
PIECE_BYTES, PIECE_IDS = 8 << 20, 1 << 20
# chunks that go through the library as one text, a line each
LINES = 200
# one word, perhaps after a blank
_WORD = re.compile(r" ?\S+")

# Bytes of the multi-byte white space of Unicode, as (lead, second, third bytes).
_BLANKS = ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,)))


def _solid(data: np.ndarray) -> np.ndarray:
    """Bytes that surely belong to no white space."""
    solid = data > 32
    for lead, seconds, thirds in _BLANKS:
        at = np.flatnonzero(data[:-1] == lead)
        at = at[np.isin(data[at + 1], seconds)]
        if thirds is not None:
            at = at[at + 2 < len(data)]
            at = at[np.isin(data[at + 2], thirds)]
            solid[at + 2] = False
        solid[at] = solid[at + 1] = False
    return solid


def chunk_starts(data: np.ndarray, offsets: np.ndarray, marks: bool = True) -> np.ndarray:
    """Starts of chunks that a byte-level vocabulary encodes apart from each other.

    A chunk begins with a text, where white space follows another character, and (with
    ``marks``) where a mark other than an apostrophe follows a letter or digit: there every match of the splitting
    pattern ends, and none looks back.  Only ASCII decides; around other white space nothing is cut.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        lower = data | 32
        word = ((lower >= 97) & (lower <= 122)) | ((data >= 48) & (data <= 57))
        mark = (data > 32) & (data < 127) & ~word & (data != 39)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        cut[1:] = _solid(data)[:-1] & blank[1:]
        if marks:
            cut[1:] |= word[:-1] & mark[1:]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts by a tokenizer file; each distinct chunk goes through the library once."""

    def __init__(self, content: bytes, special: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_str(content.decode())
        # without it the texts of special tokens are ordinary text
        self.special = special
        self.model.encode_special_tokens = not special
        line = self.model.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.remembered = 0
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for c in coded for i in c], np.uint32), np.fromiter(map(len, coded), np.int64, len(coded))

    def _as_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one text: a line end is an id of its own, which no word holds."""
        texts = ["\n".join(words[i : i + LINES]) + "\n" for i in range(0, len(words), LINES)]
        ids, _ = self._one_by_one(texts)
        ends = np.flatnonzero(ids == self.line)
        return ids[ids != self.line], np.diff(ends, prepend=-1) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after another, and their bounds per text."""
        if self.remembered > REMEMBERED_CHARS:
            self._forget()
        # the string of a special token holds marks
        starts = chunk_starts(data, offsets, not self.special)
        places = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        chunks = pa.LargeStringArray.from_buffers(len(starts), places, pa.py_buffer(np.ascontiguousarray(data)))
        chunks = chunks.dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.known]
        lines = [c for c in new if _WORD.fullmatch(c)] if self.line is not None else []
        rest = [c for c in new if not _WORD.fullmatch(c)] if self.line is not None else new
        for some, (coded, sizes) in ((lines, self._as_lines(lines)), (rest, self._one_by_one(rest))):
            first = len(self.known)
            self.known.update(zip(some, range(first, first + len(some))))
            self.remembered += sum(map(len, some))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, coded])
        known = self.known
        numbers = np.fromiter((known[c] for c in distinct), np.int64, len(distinct))
        which = numbers[chunks.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        sizes = self.at[which + 1] - self.at[which]
        ids = take_spans(self.ids, self.at[which], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.searchsorted(starts, offsets)]


def id_width(content: bytes, end_id: int | None = 0) -> int:
    """Bytes of an id: 2 if all ids of the tokenizer file are below 65,536, else 4."""
    import json

    found = json.loads(content)
    vocabulary = found["model"]["vocab"]
    most = max([len(vocabulary) - 1, end_id or 0, *vocabulary.values(), *(t["id"] for t in found.get("added_tokens", []))])
    return 2 if most < 1 << 16 else 4


def _local(folder: str) -> str:
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder}: id files need a folder that all executors mount")
    return folder


def _publish(path: str, *parts) -> None:
    """Write the parts under a name of this attempt, then give the file its name."""
    own = f"{path}.{uuid.uuid4().hex}.part"
    with open(own, "wb") as file:
        for part in parts:
            file.write(part)
        file.flush()
        os.fsync(file.fileno())
    os.replace(own, path)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, special: bool = False) -> int:
    """Write the ids of every row as shards below ``folder``; the number of ids written.

    ``tokenizer`` is a file of the tokenizers library as the driver sees it; its content is
    sent with the job.  ``end_id`` follows the ids of every document (None: nothing does); with
    ``special`` a special token's string in a text becomes its id.  The driver keeps two numbers
    per shard.  Rows that share a key are split by the hash of their text and their place, so no
    key can fill a shard.
    """
    path = _local(folder)
    spark = docs.sparkSession
    os.makedirs(path, exist_ok=True)
    with open(tokenizer, "rb") as file:
        content = file.read()
    kind = f"<u{id_width(content, end_id)}"
    end = [] if end_id is None else [end_id]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        own = f"{path}/{number:08d}"
        part = f"{own}.{uuid.uuid4().hex}.part"
        encoder, keys, known, sizes = None, [], [], []
        with open(part, "wb") as file:
            for table in _larger(batches, PIECE_BYTES):
                encoder = encoder or Encoder(content, special)
                column = table.column(0).combine_chunks()
                known.append(np.asarray(column.is_valid()).astype(np.uint8))
                keys.append(column.fill_null(0).to_numpy())
                for lo, hi, data, offsets in text_blocks(table.column(1), PIECE_BYTES):
                    ids, bounds = encoder.encode(data, offsets)
                    ids = np.insert(ids, np.repeat(bounds[1:], len(end)), end * (hi - lo)) if end else ids
                    sizes.append(np.diff(bounds) + len(end))
                    file.write(ids.astype(kind))
            file.flush()
            os.fsync(file.fileno())
        n = sum(map(len, keys))
        if not n:
            os.remove(part)
            return
        os.replace(part, f"{own}.ids")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        _publish(f"{own}.idx", np.array([n, 0], "<u8"), np.concatenate(keys).astype("<i8"), np.concatenate(known), offsets)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (number, n, int(offsets[-1]))], names=["shard", "docs", "ids"])

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    rows = rows.withColumns({"th": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.col("key").asc_nulls_first(), "th", "place"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = dealt.select("key", "text").mapInArrow(shard, "shard long, docs long, ids long")
    shards = sorted((r["shard"], r["ids"]) for r in stored(written).collect())
    numbers = np.array([s for s, _ in shards], np.int64)
    bases = np.concatenate([[0], np.cumsum([n for _, n in shards])]).astype(np.int64)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own = f"{path}/{numbers[i]:08d}.idx"
                index = ShardIndex(own)
                # from the offsets' own first value, so that a second run changes nothing
                moved = index.offsets - index.offsets[0] + np.uint64(bases[i])
                _publish(own, np.array([index.docs, bases[i]], "<u8"), index.keys, index.known, moved)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64())], names=["id"])

    if len(numbers):
        spark.range(0, len(numbers), 1, len(numbers)).mapInArrow(move, "id long").count()
    return int(bases[-1])


def _larger(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Consecutive batches of about ``most`` bytes together."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


class ShardIndex:
    """The mapped index of one shard."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        self.docs, self.base = (int(v) for v in whole[:16].view("<u8"))
        n = self.docs
        self.keys = whole[16 : 16 + 8 * n].view("<i8")
        self.known = whole[16 + 8 * n : 16 + 9 * n]
        # not on a border of 8 bytes, so the numbers are copied
        self.offsets = np.frombuffer(whole[16 + 9 * n :].tobytes(), "<u8")


def read_ids(spark: SparkSession, folder: str, width: int = 2, key: str = "doc_id", packed: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids) of every document of a folder, from its files.

    ``ids`` is an array, or with ``packed`` the ids as little-endian unsigned 32-bit integers.
    One task per shard maps its two files; nothing but the shards' names passes the driver.
    """
    path = _local(folder)
    names = sorted(f.removesuffix(".ids") for f in os.listdir(path) if f.endswith(".ids")) if os.path.isdir(path) else []
    kind, schema = f"<u{width}", f"key long, start long, n_tokens long, ids {'binary' if packed else 'array<long>'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                index = ShardIndex(f"{path}/{names[i]}.idx")
                size = os.path.getsize(f"{path}/{names[i]}.ids")
                ids = np.memmap(f"{path}/{names[i]}.ids", kind, "r") if size else np.zeros(0, kind)
                local = (index.offsets - np.uint64(index.base)).astype(np.int64)
                lo = 0
                while lo < index.docs:
                    hi = max(lo + 1, int(np.searchsorted(local, local[lo] + PIECE_IDS, "right")) - 1)
                    part = np.asarray(ids[local[lo] : local[hi]])
                    at = local[lo : hi + 1] - local[lo]
                    keys = pa.array(index.keys[lo:hi], pa.int64(), mask=index.known[lo:hi] == 0)
                    if packed:
                        whole = part.astype("<u4")
                        cells = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(whole)])
                    else:
                        cells = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(part.astype(np.int64)))
                    columns = [keys, pa.array(index.offsets[lo:hi].astype(np.int64)), pa.array(np.diff(at)), cells]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids"])
                    lo = hi

    if not names:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    return spark.range(0, len(names), 1, len(names)).mapInArrow(run, schema).withColumnRenamed("key", key)
