"""Packing of tokenized documents into windows by best-fit decreasing.

A document is its token ids followed by one end id. Documents longer than a window are first cut
into full windows; what is left of each is placed, in decreasing length, into the open window with
the least sufficient room, which a segment tree over remaining capacities finds. Each input
partition is packed by itself, in blocks of bounded size, so nothing is shuffled, a task holds at
most one block, and a task that runs again gives the same windows.

Defined results. A null text is an empty one, and an empty one is the end id alone. Repeated rows
are packed like others. The string of an added token, such as <|endoftext|>, is that token's id. Very
long texts are tokenized whole, runs of a million blanks included. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm.common import give_back, small_batches

WINDOW = 1024
END = 0
BLOCK = 32_768  # remainders that are packed together
ROWS = 512  # pieces of a batch that is handed to Spark, 2 MB of ids
#: The word pattern of byte-level BPE files (fixed value, as published with the vocabulary).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files write bytes: printable Latin-1 bytes stand for
    themselves, the others follow in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of a tokenizer file as little-endian unsigned 32-bit bytes.

    In a byte-level BPE file whose ids follow the order of its merges, an id is the rank of its
    merge. Such a file's vocabulary runs in tiktoken, which gives the same ids in about a third of
    the time; any other file runs in tokenizers, and so does a text whose word pattern tiktoken can't match
    (it gives up on runs of about a million blanks). The string of an added token in a text is that token
    if `added`, as tokenizers has it by itself, else ordinary text.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.added = path, added
        self.ranked = self._ranked(spec)
        self.allowed = "all" if added else set()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = not self.added
        return found

    @staticmethod
    def _ranked(spec: dict) -> tiktoken.Encoding | None:
        before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            return None
        added = spec.get("added_tokens") or []
        if any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip")):
            return None
        special = {t["content"]: t["id"] for t in added if t.get("special")}
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or len(special) < len(added):
            return None
        letters = _bytes_of_letters()
        words = sorted((i, t) for t, i in model["vocab"].items() if t not in special)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [t for _, t in words[256:]] != merges or [i for i, _ in words] != list(range(len(words))):
            return None
        ranks = {bytes(letters[c] for c in t): i for i, t in words}
        return tiktoken.Encoding("ranked", pat_str=WORD, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if self.ranked:
            for text in texts:
                try:
                    ids = self.ranked.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
                except ValueError:  # the pattern's backtracking is bounded
                    yield from self._plain([text])
                else:
                    yield ids.astype("<u4", copy=False).tobytes()
        else:
            yield from self._plain(texts)

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(x.ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker; added tokens are read as tokens."""
    if path not in _ENCODERS:
        give_back()  # what earlier operators left
        _ENCODERS[path] = Encoder(path, added=True)
        give_back()  # the parsed file
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Rooms:
    """A segment tree over capacities 0..window: which of them open windows have left."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.some = [0] * (2 * self.size)  # open windows below each node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        at = room + self.size
        while at:
            self.some[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least need, as (room, window)."""
        some, at = self.some, need + self.size
        while not some[at]:
            while at & 1:  # a right child: nothing more below its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if some[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            some[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, and the number of windows."""
    rooms, n = Rooms(window), 0
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = rooms.take(need)
        room, w = found if found else (window, n)
        n += not found
        which[i], offset[i] = w, window - room
        if room > need:
            rooms.put(room - need, w)
    return which, offset, n


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end: int = END,
    tokenizer: str | None = None,
) -> DataFrame:
    """A row for each piece: id_col, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    last = np.array([end], dtype="<u4").tobytes()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema[0].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(path), TaskContext.get().partitionId() << 33
        rest: list[tuple] = []
        full: list[tuple] = []
        id_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def whole() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(full), ROWS):
                yield out(full[at : at + ROWS])
            full.clear()

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            which, offset, n = best_fit_decreasing(np.array([r[2] for r in rest], np.int64), window)
            for at in range(0, len(rest), ROWS):
                some = zip(rest[at : at + ROWS], which[at : at + ROWS].tolist(), offset[at : at + ROWS].tolist(), strict=True)
                yield out([(*r, sequence + w, o) for r, w, o in some])
            sequence += n
            rest.clear()

        for b in batches:
            id_type = b.schema[0].type
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                ids += last
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    if len(piece) == 4 * window:
                        full.append((doc, start, window, piece, n, sequence, 0))
                        sequence += 1
                    else:
                        rest.append((doc, start, len(piece) // 4, piece, n))
                if len(full) >= ROWS:
                    yield from whole()
                if len(rest) >= BLOCK:
                    yield from packed()
        yield from whole()
        if rest:
            yield from packed()

    return docs.mapInArrow(each, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
