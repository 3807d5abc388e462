"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives byte strings and their ranks.  ``byte_characters`` maps each byte to a
printable character, the form in which the library keeps a byte-level vocabulary; the merge
list is read off the ranks.  Texts are split by the pattern first, each distinct piece goes
through the library once while it is remembered, and ids are put together with numpy.
Decoding reverses the byte table.  A token may hold part of a character: characters are put
together from the joined bytes, never token by token.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepwell.llm.textkit import take_spans

# characters of the pieces a task remembers before it starts over, and of text handled at once
REMEMBERED_CHARS = 1 << 20
SLICE_CHARS = 1 << 19


def byte_characters() -> list[str]:
    """The character of each byte: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file (base64, blank, number)."""
    with open(path, "rb") as lines:
        return _ranks(lines.read())


def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def _content(path: str) -> bytes:
    """The rank file as the driver sees it; tasks get its bytes with the job."""
    with open(path, "rb") as file:
        return file.read()


class ByteTable:
    """The way back: bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = sorted((r, t) for t, r in ranks.items())
        size = by_id[-1][0] + 1 if by_id else 0
        self.lengths = np.zeros(size, np.int64)
        for r, t in by_id:
            self.lengths[r] = len(t)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after another."""
        if len(ids) and int(ids.max()) >= len(self.lengths):
            raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
        return take_spans(self.bytes, self.starts[ids], self.lengths[ids])

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids; list i is ``ids[bounds[i] : bounds[i + 1]]``."""
        whole = self.decode(ids).tobytes()
        cuts = np.concatenate([[0], np.cumsum(self.lengths[ids])])[bounds]
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Codec(ByteTable):
    """Encoder and decoder of one rank file; built once per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        super().__init__(ranks)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chars = byte_characters()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            known = [(ranks[x], ranks[y], x, y) for x, y in cuts if x in ranks and y in ranks]
            merges += [(shown[x], shown[y]) for _, _, x, y in sorted(known)]
        vocab = {shown[t]: r for t, r in ranks.items()}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.remembered = 0
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their bounds per text."""
        if self.remembered > REMEMBERED_CHARS:
            self._forget()
        pieces = [self.pattern.findall(t) for t in texts]
        new = [w for w in dict.fromkeys(w for p in pieces for w in p) if w not in self.known]
        if new:
            coded = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(new, add_special_tokens=False)]
            first = len(self.known)
            self.remembered += sum(map(len, new))
            self.known.update((w, first + i) for i, w in enumerate(new))
            sizes = np.array([len(c) for c in coded], np.int64)
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, *coded])
        known = self.known
        which = np.fromiter((known[w] for p in pieces for w in p), np.int64)
        sizes = self.at[which + 1] - self.at[which]
        ids = take_spans(self.ids, self.at[which], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.cumsum([0, *map(len, pieces)])]

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last that each token of one text touches.

        Tokens that share the bytes of a character both cover that character.
        """
        data = self.decode(ids)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        chars = np.cumsum((data & 0xC0) != 0x80)
        return chars[starts] - 1, chars[ends - 1]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: bool = False
) -> DataFrame:
    """Append the token ids of ``text`` (``array<int>``) to every row.

    NULL and empty texts have no tokens (an empty array).  Other columns pass through
    untouched; a column named like an added one is replaced.  With ``offsets``, ``starts``
    and ``ends`` give each token's characters.  No shuffle; repeated rows stay.
    """
    extra = [ids, "starts", "ends"] if offsets else [ids]
    keep = [c for c in docs.columns if c not in extra]
    rows = docs.select(*[docs[c] for c in keep])
    schema = ", ".join([f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema] + [f"{_quoted(c)} array<int>" for c in extra])
    content = _content(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(_ranks(content), pattern)
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for lo, hi in _slices(texts):
                flat, bounds = codec.encode(texts[lo:hi])
                lists = [flat]
                if offsets:
                    spans = [codec.offsets(flat[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                    lists += [np.concatenate([s[i] for s in spans]) for i in (0, 1)]
                added = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v.astype(np.int32))) for v in lists]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *added], names=[*keep, *extra])

    return rows.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Append the bytes (``binary``) that the token ids of every row stand for.

    NULL and empty lists give empty bytes.  An id outside the vocabulary is an error.
    """
    keep = [c for c in docs.columns if c != data]
    rows = docs.select(*[docs[c] for c in keep])
    schema = ", ".join([f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema] + [f"{_quoted(data)} binary"])
    content = _content(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or ByteTable(_ranks(content))
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part.column(part.schema.get_field_index(ids))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array([len(v) if v is not None else 0 for v in lists], np.int64)
                column = pa.array(table.texts(flat, np.concatenate([[0], np.cumsum(sizes)])), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*keep, data])

    return rows.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, packed, decoded): encode every text and decode its ids again, in one pass.

    ``packed`` holds the ids as little-endian unsigned 32-bit integers, ``decoded`` the bytes
    that they stand for.  The same rows as ``decode(encode(...))``, with one Python worker and
    one vocabulary per core.  NULL and empty texts have no ids and no bytes.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    content = _content(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(_ranks(content), pattern)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                flat, bounds = codec.encode(texts[lo:hi])
                raw, at = flat.astype("<u4").tobytes(), 4 * bounds
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32))),
                    pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary()),
                    pa.array(codec.texts(flat, bounds), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "packed", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, packed binary, decoded binary").withColumnRenamed("key", key)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
