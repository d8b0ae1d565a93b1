"""Hierarchical multi-length packing of whole documents into training sequences."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidefold.llm.common import slices, text_of, trim

TIERS = (1024, 512, 256, 128)
#: Sequences of one tier that make a step group.
GROUP = 8
_BLOCK_BYTES = 4 << 20
#: How byte-level BPE cuts a text before merging (a fixed value of the format).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain, strict=True), *((b, 256 + k) for k, b in enumerate(rest))]}


def _fast(path: str) -> tiktoken.Encoding | None:
    """The same byte-level BPE as a tiktoken encoding; None if the file is of another kind.

    tiktoken joins whatever neighbours make a token, the file only its listed pairs. Both give the same ids if ids
    rise with the merges, one merge to a token, and every token's own bytes encode to it alone: neighbours x and y
    that make a token by another split would need a lesser merge across them not to have happened, yet it did when
    the token's own bytes were encoded.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    vocabulary, letters = model["vocab"], _byte_letters()
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    tokens = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
    if len({*merged}) + 256 != len(tokens) or any(bytes([b]) not in tokens for b in range(256)):
        return None
    found = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=tokens, special_tokens={})
    return found if all(found._core_bpe.encode_single_piece(t) == [i] for t, i in tokens.items()) else None


class Encoder:
    """Byte-level BPE ids as the `tokenizers` library gives them, by tiktoken where that is proven equal (see `_fast`).

    Texts with one of the file's added tokens (an id of its own, as is the library's default), and those that
    tiktoken's pattern engine can't take (a million white spaces in a row), are encoded by the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.fast = _fast(path)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if self.fast and not self.added.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file: tasks that follow each other in a worker share it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


Piece = tuple[int, int, int]  # document, first token, tokens


class Packer:
    """Packs pieces into windows of the tiers' sizes; what doesn't fill the shortest tier waits for the next block."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        if any(a <= b for a, b in zip(tiers, tiers[1:], strict=False)) or any(t < 1 or t & t - 1 for t in tiers):
            raise ValueError("tiers must be falling powers of two")
        self.tiers = tiers
        self.by_length: list[list[Piece]] = [[] for _ in range(tiers[0] + 1)]
        self.mask = 0

    def add(self, doc: int, tokens: int) -> list[list[Piece]]:
        """Whole windows of the longest tier come out at once; the rest of the document is routed by its length."""
        top = self.tiers[0]
        whole = tokens // top
        if tokens % top:
            self._put((doc, whole * top, tokens % top))
        return [[(doc, k * top, top)] for k in range(whole)]

    def _put(self, piece: Piece) -> None:
        self.by_length[piece[2]].append(piece)
        self.mask |= 1 << piece[2]

    def _take(self, most: int, least: int = 1) -> Piece | None:
        """The longest waiting piece of least..most tokens."""
        n = (self.mask & ((1 << most + 1) - 1)).bit_length() - 1
        if n < least:
            return None
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.mask ^= 1 << n
        return piece

    def _cut(self, gap: int) -> Piece | None:
        """Exactly `gap` tokens off the shortest waiting piece that has more; its rest is routed anew."""
        above = self.mask >> gap + 1
        if not above:
            return None
        doc, start, n = self._take(gap + (above & -above).bit_length())
        self._put((doc, start + gap, n - gap))
        return doc, start, gap

    def _fill(self, window: list[Piece], gap: int) -> int:
        """Shorter pieces as long as they fit, then a cut one; what remains open."""
        while gap and (piece := self._take(gap)):
            window.append(piece)
            gap -= piece[2]
        if gap and (piece := self._cut(gap)):
            window.append(piece)
            gap = 0
        return gap

    def pack(self) -> list[list[Piece]]:
        """Windows of each tier, longest first, all of them full."""
        out = []
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while piece := self._take(tier, shorter + 1):
                window = [piece]
                if self._fill(window, tier - piece[2]):
                    for p in window:
                        self._put(p)
                    break
                out.append(window)
        return out

    def rest(self) -> list[list[Piece]]:
        """The last pieces, cut into windows of powers of two: nothing is padded."""
        out = self.pack()
        left = sum(n * len(p) for n, p in enumerate(self.by_length))
        while left:
            size = min(self.tiers[0], 1 << left.bit_length() - 1)
            window: list[Piece] = []
            self._fill(window, size)
            out.append(window)
            left -= size
        return out


def step_groups(windows: list[list[Piece]], size: int = GROUP) -> list[tuple[int, int]]:
    """(window, group): groups of windows of equal length with nearly equal attention cost, dealt in snake order."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(windows):
        by_length.setdefault(sum(p[2] for p in w), []).append(k)
    out, first = [], 0
    for length in sorted(by_length, reverse=True):
        own = sorted(by_length[length], key=lambda k: -sum(p[2] ** 2 for p in windows[k]))
        groups = -(-len(own) // size)
        for i, k in enumerate(own):
            turn, place = divmod(i, groups)
            out.append((k, first + (place if turn % 2 == 0 else groups - 1 - place)))
        first += groups
    return out


SCHEMA = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = 0) -> DataFrame:
    """One row for each piece of a document: key, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group.

    A document is the ids of its text (null: empty) and `end_id`. Each partition streams through once, in blocks of
    _BLOCK_BYTES of text: documents give whole windows of the longest tier, their rests are routed to the shortest
    tier that holds them, each tier is packed longest first, and gaps are filled from shorter tiers, by cutting a
    piece where none fits. Pieces that fill no window wait for the next block; at a partition's end they go into
    windows of lesser powers of two. So every window is full, memory is bounded by a block, and nothing is shuffled.
    `tier` is the window's length, `ids` are little-endian unsigned 32-bit. Sequence and step group ids carry the
    partition's number in their upper bits. An empty text is one token; repeated keys are separate documents, each
    with pieces of its own; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer).encode, Packer(tiers)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 33
        data: dict[int, tuple[object, bytes]] = {}
        sequence = group = number = 0
        eos = np.array([end_id], "<u4").tobytes()
        names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence, group
            columns: list[list] = [[] for _ in names]
            groups = dict(step_groups(windows))
            for k, window in enumerate(windows):
                offset, tier = 0, sum(p[2] for p in window)
                for doc, start, n in window:
                    name, ids = data[doc]
                    for column, value in zip(columns, (name, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, base + sequence, offset, tier, base + group + groups[k]), strict=True):
                        column.append(value)
                    offset += n
                sequence += 1
            group += max(groups.values(), default=-1) + 1
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        key_type = pa.int64()
        for b in slices(batches, _BLOCK_BYTES, "text"):
            key_type = b.schema.field("key").type
            windows = []
            for name, ids in zip(b.column("key").to_pylist(), map(encode, b.column("text").to_pylist()), strict=True):
                data[number] = (name, ids + eos)
                windows += packer.add(number, len(ids) // 4 + 1)
                number += 1
            yield rows(windows + packer.pack())
            waiting = {p[0] for bucket in packer.by_length for p in bucket}
            data = {k: v for k, v in data.items() if k in waiting}
        if data:
            yield rows(packer.rest())
        trim()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).mapInArrow(run, f"key {kind}, {SCHEMA}")
