"""Substring dedup by prefix-free parsing: a dictionary of phrases, the parse, and the corpus order of both together.

A text is cut into phrases at triggers, places chosen by a hash of the bytes that follow, so that equal passages
are cut alike. A phrase's tag is the 128-bit hash of its bytes with enough context on both sides to hold every
window that belongs to it. Of a phrase found in several documents, all but the first need no closer look: all
their windows are repeats. The first occurrences go on. Two windows in different phrases can be equal only if the
phrases share the windows' anchor; around such anchors each task holds a dictionary of distinct contexts and a
parse, the documents' occurrences of them. The dictionary's suffix array and the parse's order (by context, then
document) combine into the corpus order of all windows: runs of equal ones, documents rising within each. A run's
first document keeps the bytes, all later ones lose them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import slices, text_of, trim, utf8_values
from tidefold.sources.checkpoints import written

LENGTH = 50
#: Bytes of an anchor. Every window of LENGTH bytes has one: its part of this size with the smallest hash.
ANCHOR = 16
#: One anchor in so many starts a phrase.
PERIOD = 16
#: Bytes of text parsed at a time; a longer text is parsed in pieces of this size, so memory doesn't grow with it.
_SLICE = 1 << 20
#: Bytes of records looked at together.
_CHUNK = 4 << 20
#: Bytes of text whose records a task holds, about: so many buckets there are, or more. The anchors take some 11 times that in a task.
_BUCKET = 8 << 20
#: Bytes of records dealt to buckets together: with many buckets, rows of a few records each would cost more than those.
_DEALT = 8 << 20
#: Records of one anchor from which its contexts may be dealt by more than the anchor: if they are also more than one
#: in _MOST_HOT of all, so that no more than _MOST_HOT anchors can be such.
_HOT = 4096
_MOST_HOT = 1_000_000
#: Open records of one anchor from which on their sides, of 16 bits, no longer tell them apart: all of them are looked at.
_COMMON = 1 << 16
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)
_48 = np.uint64((1 << 48) - 1)


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    k, out = 1, values
    while 2 * k <= width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    rest = width - k
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Parse:
    """Anchors of pieces of documents, in order, and the phrases they fall into. Positions count from the piece's start."""

    piece: np.ndarray
    at: np.ndarray
    first: np.ndarray  # windows first..last have this anchor
    last: np.ndarray
    hash: np.ndarray
    left: np.ndarray  # hashes of the ANCHOR bytes before and after the anchor: a window holds one or the other
    right: np.ndarray  # left if it starts there or before, else right; 0 where no window of this anchor does
    phrase: np.ndarray
    tag: np.ndarray  # of each phrase, two numbers
    head: np.ndarray  # first anchor of each phrase

    def context_tags(self, texts: list[bytes], which: np.ndarray) -> np.ndarray:
        """For anchors the hash of the bytes that their windows cover: equal tags mean equal windows."""
        digest = xxhash.xxh3_64_intdigest
        rows = zip(self.piece[which].tolist(), self.first[which].tolist(), (self.last[which] + LENGTH).tolist(), (self.at - self.first)[which].tolist(), strict=True)
        return np.fromiter((digest(texts[d][x:y], a) for d, x, y, a in rows), np.uint64, len(self.at[which]))


def pieces(texts: list[bytes], length: int = LENGTH) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(pieces, document of each, its start): texts of at most _SLICE bytes whole; of longer ones each window lies in exactly one piece."""
    out, doc, start = [], [], []
    for d, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), _SLICE):
            out.append(t if len(t) <= _SLICE else t[a : a + _SLICE + length - 1])
            doc.append(d)
            start.append(a)
            if len(t) <= _SLICE:
                break
    return out, np.array(doc, np.int64), np.array(start, np.int64)


def parse(texts: list[bytes], length: int = LENGTH) -> Parse | None:
    """None if no text has `length` bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not len(sizes) or sizes.max() < length:
        return None
    data = b"".join(texts)
    n = len(data) - ANCHOR + 1
    w = _words(data)
    h = w[:n] * _MIX[0]
    h ^= (w[8 : n + 8] + _MIX[3]) * _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    owner = _slide(h & ~_LOW | np.arange(n, dtype=np.uint64), length - ANCHOR + 1)
    inside = np.zeros(len(data) + 1, np.int8)
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    v = np.flatnonzero(np.cumsum(inside[: len(owner)], dtype=np.int8))
    o = (owner[v] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
    a, first, last = o[new], v[new], v[np.append(new[1:], len(v)) - 1]
    piece = np.searchsorted(ends, a, side="right")
    ha = h[a]
    other = np.concatenate(([True], piece[1:] != piece[:-1]))
    begins = other | ((ha >> np.uint64(8)) % np.uint64(PERIOD) == 0)
    head = np.flatnonzero(begins)
    d = piece[head]
    same_before, same_after = ~other[head], np.append(~other[head[1:]], False)
    pa_, pe = a[head], np.append(a[head[1:]], 0)
    lo = np.where(same_before, np.maximum(pa_ - (length - ANCHOR), starts[d]), starts[d])
    hi = np.where(same_after, np.minimum(pe + length, ends[d]), ends[d])
    core = np.stack((pa_ - lo, np.where(same_after, pe - lo, -1)), 1).tolist()
    digest = xxhash.xxh3_128_digest
    tag = b"".join(digest(data[x:y], p << 32 | q & 0xFFFFFFFF) for x, y, (p, q) in zip(lo.tolist(), hi.tolist(), core, strict=True))
    base = starts[piece]
    side = lambda at, there: np.where(there, (h[np.where(there, at, 0)] >> np.uint64(40)) % np.uint64(0xFFFF) + np.uint64(1), np.uint64(0)).astype(np.uint16)
    left, right = side(a - ANCHOR, first <= a - ANCHOR), side(a + ANCHOR, last > a - ANCHOR)
    return Parse(piece, a - base, first - base, last - base, ha, left, right, np.cumsum(begins) - 1, np.frombuffer(tag, "<u8").reshape(-1, 2), head)


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        yield int(bucket[i]), [c[i:j] for c in columns]


def _pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, out, at = len(data) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(data, k, n, at))
        at += size
    return out


#: Bits of a found value that is an anchor (its hash of 48 bits): in this context it is settled; it has the records told by the tag.
_SETTLED, _BUSY = 1 << 62, 1 << 61

_ANCHORS, _PHRASES, _CONTEXTS, _DIRECT = 0, 1, 2, 3
#: Columns of the records in a blob. Documents are places in the row's own table of keys and text hashes.
_KINDS = {
    _ANCHORS: ["<u4", "<u2", "<u8", "<u2", "<u2", "<u4"],
    _PHRASES: ["<u8", "<u8", "<u4", "<u4", "<u4"],
    _CONTEXTS: [f"S{2 * LENGTH - ANCHOR}", "<u4", "u1", "u1", "<u4"],
    _DIRECT: ["<u4", "<u4", "<u4"],
}
_FOUND = "k bigint, th int, value bigint, tag bigint"
_ROWS = "bucket int, kind int, docs binary, blob binary"


def _blob_rows(kind: int, bucket: np.ndarray, columns: list[np.ndarray], doc: np.ndarray, table: np.ndarray) -> Iterator[tuple]:
    """One row a bucket; each carries only the documents it names, keys as differences."""
    for b, own in _by_bucket(bucket, [*columns, doc]):
        names, place = np.unique(own[-1], return_inverse=True)
        keys = table[names, 0]
        yield b, kind, _pack([np.diff(keys, prepend=0), table[names, 1].astype("<i4")]), _pack([*own[:-1], place.astype("<u4")])


class _Dealt:
    """Records of several slices, dealt to buckets together once there are _DEALT bytes of them."""

    def __init__(self) -> None:
        self.tables: list[np.ndarray] = []
        self.records: dict[int, list[list[np.ndarray]]] = {}
        self.docs = self.size = 0

    def table(self, table: np.ndarray) -> None:
        """The documents (key and text hash) that records added from here on name by their place."""
        self.docs += len(self.tables[-1]) if self.tables else 0
        self.tables.append(table)

    def add(self, kind: int, bucket: np.ndarray, columns: list[np.ndarray], doc: np.ndarray) -> None:
        self.records.setdefault(kind, []).append([bucket, *columns, doc + self.docs])
        self.size += sum(c.nbytes for c in self.records[kind][-1])

    def emit(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """A batch if there is enough for one."""
        if self.size < _DEALT and not last:
            return
        table = np.concatenate(self.tables) if self.tables else np.empty((0, 2), np.int64)
        for kind in list(self.records):
            bucket, *columns, doc = (np.concatenate(c) for c in zip(*self.records.pop(kind), strict=True))
            yield _emit(list(_blob_rows(kind, bucket, columns, doc, table)))
        self.tables, self.docs, self.size = self.tables[-1:], 0, 0


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.record_batch([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["bucket", "kind", "docs", "blob"])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal neighbours begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _least(group: tuple[np.ndarray, ...], values: np.ndarray) -> np.ndarray:
    """For each element the least value of its group (equal neighbours in all of `group`)."""
    heads = _heads(*group)
    return np.repeat(np.minimum.reduceat(values, heads), np.diff(np.append(heads, len(values)))) if len(values) else values


def _table(b: pa.RecordBatch) -> np.ndarray:
    return np.stack((b.column("key").to_numpy(zero_copy_only=False).astype("<i8"), b.column("th").to_numpy(zero_copy_only=False).astype("<i8")), 1)


def _slim(b: pa.RecordBatch, length: int) -> tuple[pa.RecordBatch, list[bytes]]:
    """Only the texts that have a window."""
    b = b.filter(pa.compute.greater_equal(pa.compute.binary_length(b.column("text")), length))
    return b, utf8_values(b.column("text"))


def _in_parts(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, Parse]]:
    """(pieces, row of each, its start, their parse) for runs of pieces of at most _SLICE bytes about."""
    b, texts = _slim(b, LENGTH)
    cut, doc, start = pieces(texts)
    del texts
    at = 0
    while at < len(cut):
        size, end = len(cut[at]), at + 1
        while end < len(cut) and size + len(cut[end]) <= 2 * _SLICE:
            size += len(cut[end])
            end += 1
        p = parse(cut[at:end])
        if p is not None:
            yield cut[at:end], doc[at:end], start[at:end], p
        at = end


def _parsed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases and anchors of each slice, dealt to buckets; copies within the slice are settled here."""
    dealt = _Dealt()
    for whole in slices(batches, _SLICE, "text"):
        table = _table(_slim(whole, LENGTH)[0])
        key = table[:, 0]
        dealt.table(table)
        for texts, doc, base, p in _in_parts(whole):
            pp = p.piece[p.head]
            pd = doc[pp]
            start, end = base[pp] + p.first[p.head], base[pp] + p.last[np.append(p.head[1:], len(p.at)) - 1] + LENGTH
            one, two = p.tag[:, 0], p.tag[:, 1]
            order = np.lexsort((key[pd], two, one))
            least = np.empty(len(order), np.int64)
            least[order] = _least((one[order], two[order]), key[pd][order])
            late = key[pd] > least
            dealt.add(_DIRECT, pd[late] % buckets, [start[late].astype("<u4"), end[late].astype("<u4")], pd[late])
            own = ~late
            dealt.add(_PHRASES, (one[own] % np.uint64(buckets)).astype(np.int64), [one[own], two[own], start[own].astype("<u4"), end[own].astype("<u4")], pd[own])
            keep = own[p.phrase]
            h, tag = p.hash[keep], p.context_tags(texts, keep)
            dealt.add(_ANCHORS, (h % np.uint64(buckets)).astype(np.int64), [(h >> np.uint64(16) & _LOW).astype("<u4"), (h >> np.uint64(48)).astype("<u2"), tag, p.left[keep].astype("<u2"), p.right[keep].astype("<u2")], doc[p.piece[keep]])
            yield from dealt.emit()
    yield from dealt.emit(last=True)
    trim()


def _span(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans as negative numbers; anchors are the others."""
    return -1 - ((start.astype(np.int64) << 31) | (end.astype(np.int64) - start))


def _found(key: np.ndarray, th: np.ndarray, value: np.ndarray, tag: np.ndarray | None = None) -> pa.RecordBatch:
    tag = np.zeros(len(key), np.int64) if tag is None else tag
    return pa.record_batch([pa.array(key, pa.int64()), pa.array(th.astype(np.int32)), pa.array(value.astype(np.int64)), pa.array(tag.astype(np.int64))], ["k", "th", "value", "tag"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[np.ndarray]]]:
    """Records of a task's blobs in chunks of bounded size, by kind, the document replaced by its key and text hash."""
    held: dict[int, list[list[np.ndarray]]] = {}
    size = 0
    for b in batches:
        for kind, docs, blob in zip(b.column("kind").to_pylist(), b.column("docs").to_pylist(), b.column("blob").to_pylist(), strict=True):
            *columns, doc = _unpack(blob, _KINDS[kind])
            keys, hashes = _unpack(docs, ["<i8", "<i4"])
            held.setdefault(kind, []).append([*columns, np.cumsum(keys)[doc], hashes[doc]])
            size += len(blob) + 16 * len(doc)
            if size > _CHUNK:
                yield {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in held.items()}
                held, size = {}, 0
    if held:
        yield {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in held.items()}


def _joined(old: list[np.ndarray] | None, new: list[np.ndarray]) -> list[np.ndarray]:
    return new if old is None else [np.concatenate(x) for x in zip(old, new, strict=True)]


def _first_phrases(state: list[np.ndarray] | None, new: list[np.ndarray]) -> tuple[list[np.ndarray], pa.RecordBatch]:
    """Of each phrase the occurrences in its first document stay; later ones come out as spans."""
    one, two, start, end, key, th = _joined(state, new)
    order = np.lexsort((key, two, one))
    one, two, start, end, key, th = (c[order] for c in (one, two, start, end, key, th))
    late = key > _least((one, two), key)
    out = _found(key[late], th[late], _span(start[late], end[late]))
    # to decide later ones, one occurrence of the first document is enough
    keep = np.zeros(len(key), bool)
    keep[_heads(one, two)] = True
    return [c[keep] for c in (one, two, start, end, key, th)], out


def _meeting(anchor: np.ndarray, side: np.ndarray, tag: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether records have others of their anchor and side, in several contexts and documents. Side 0 is none."""
    out = np.zeros(len(anchor), bool)
    there = np.flatnonzero(side)
    unit = anchor[there].view(np.uint64) << np.uint64(16) | side[there].view(np.uint64)
    order = np.argsort(unit, kind="stable")
    which = there[order]
    heads = _heads(unit[order])
    if len(heads):
        several = lambda x: np.minimum.reduceat(x, heads) != np.maximum.reduceat(x, heads)
        out[which] = np.repeat(several(tag[which]) & several(key[which]), np.diff(np.append(heads, len(which))))
    return out


def _shared_anchors(state: list[np.ndarray] | None, new: list[np.ndarray]) -> tuple[list[np.ndarray], pa.RecordBatch]:
    """Records of anchors to look at come out: those whose windows a smaller document has, all alike (marked _SETTLED),
    and those that, by the anchor and one of its sides, stand in several contexts and documents: equal windows have
    the anchor and a side in common. All but the settled ones stay, as later chunks may meet them.

    The state's `seen` is -1 for records that came out. An anchor of _COMMON open records leaves one, whose `seen`
    counts them; its later records come out at once.
    """
    anchor, tag, sides, key, th, seen = _joined(state, new)
    order = np.lexsort((key, tag, anchor))
    anchor, tag, sides, key, th, seen = (c[order] for c in (anchor, tag, sides, key, th, seen))
    if not len(anchor):
        return [anchor, tag, sides, key, th, seen], _found(key, th, anchor, tag)
    heads = _heads(anchor)
    span = np.diff(np.append(heads, len(anchor)))
    settled = (key > _least((anchor, tag), key)) & (seen <= 0)
    open_ = np.add.reduceat(((seen <= 0) & ~settled).astype(np.int64), heads)
    before = np.add.reduceat(np.maximum(seen, 0), heads)
    common = (before > 0) | (open_ >= _COMMON)
    several = (np.minimum.reduceat(tag, heads) != np.maximum.reduceat(tag, heads)) & (np.minimum.reduceat(key, heads) != np.maximum.reduceat(key, heads))
    asked = np.repeat(common, span)
    near = np.flatnonzero(np.repeat(several & ~common, span))
    asked[near] = _meeting(anchor[near], sides[near] & 0xFFFF, tag[near], key[near]) | _meeting(anchor[near], sides[near] >> 16, tag[near], key[near])
    fresh = (settled | asked) & (seen == 0)
    out = _found(key[fresh], th[fresh], np.where(settled, anchor | _SETTLED, anchor)[fresh], np.where(settled, tag, 0)[fresh])
    is_head = np.zeros(len(anchor), bool)
    is_head[heads] = True
    each = np.repeat(common, span)
    keep = np.where(each, is_head, ~settled)
    seen = np.where(each, np.repeat(before + open_, span), np.where(asked, -1, seen))
    return [c[keep] for c in (anchor, tag, sides, key, th, seen)], out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of settled phrases, and the anchors of documents whose contexts are to be compared."""
    anchors = phrases = None
    held: list[np.ndarray] = []
    for chunk in _gathered(batches):
        if _DIRECT in chunk:
            start, end, key, th = chunk[_DIRECT]
            yield _found(key, th, _span(start, end))
        if _PHRASES in chunk:
            phrases, out = _first_phrases(phrases, chunk[_PHRASES])
            yield out
        if _ANCHORS in chunk:
            low, high, tag, before, after, key, th = chunk[_ANCHORS]
            held.append(np.stack((low.astype(np.int64) | high.astype(np.int64) << 32, tag.view(np.int64), before.astype(np.int64) | after.astype(np.int64) << 16, key, th.astype(np.int64), np.zeros(len(key), np.int64))))
            # new records are taken in once they are as many as the state, so sorting stays in proportion to the input
            if anchors is None or sum(x.shape[1] for x in held) >= len(anchors[0]):
                anchors, out = _shared_anchors(anchors, list(np.concatenate(held, axis=1)))
                held = []
                yield out
    if held:
        anchors, out = _shared_anchors(anchors, list(np.concatenate(held, axis=1)))
        yield out
    if anchors is not None and len(anchors[0]):  # of anchors with many records, how many
        heads = _heads(anchors[0])
        count = np.add.reduceat(np.abs(anchors[5]), heads)
        hot, count = anchors[0][heads][count >= _HOT], count[count >= _HOT]
        yield _found(hot * 0, hot * 0, hot | _BUSY, count)
    trim()


def _halves(context: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, which, lo, hi): contexts dealt by their anchor with half a window's other bytes, on the left or right.

    A window has at least half of those bytes on one side of its anchor, so equal ones meet on that side.
    """
    left = LENGTH - ANCHOR
    half = left // 2
    out = []
    for a, z, b, e in ((left - half, left + ANCHOR, lo, np.minimum(hi, left - half)), (left, left + ANCHOR + left - half, np.maximum(lo, left - half + 1), hi)):
        which = np.flatnonzero(b <= e)
        raw = np.ascontiguousarray(context[which, a:z])
        digests = np.fromiter((xxhash.xxh3_64_intdigest(r) for r in raw), np.uint64, len(which))
        out.append((digests, which, b[which], e[which]))
    return out


def _contexts(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The bytes around every shared anchor, dealt to buckets by the anchor (hot ones by more); settled ones become spans."""
    left, size = LENGTH - ANCHOR, 2 * LENGTH - ANCHOR
    out = _Dealt()
    for whole in slices(batches, _SLICE, "text"):
        b, _ = _slim(whole, LENGTH)
        lists = b.column("anchors")
        out.table(_table(b))
        rows_of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        values, value_tags = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
        done = values >= _SETTLED
        asked = np.unique(np.stack((rows_of[~done], values[~done]), 1), axis=0)
        known = set(zip(rows_of[done].tolist(), (values[done] ^ _SETTLED).tolist(), value_tags[done].tolist(), strict=True))
        near_rows = np.unique(np.stack((rows_of[done], values[done] ^ _SETTLED), 1), axis=0)
        for texts, doc, base, p in _in_parts(whole):
            own, row = (p.hash >> np.uint64(16) & _48).astype(np.int64), doc[p.piece]
            near = np.flatnonzero(_among(row, own, near_rows))
            tags = p.context_tags(texts, near).view(np.int64)
            settled = np.zeros(len(own), bool)
            settled[near] = np.fromiter((x in known for x in zip(row[near].tolist(), own[near].tolist(), tags.tolist(), strict=True)), bool, len(near))
            hit = np.flatnonzero(settled)
            joined = np.zeros(len(hit), bool)  # to the anchor before: one span
            joined[1:] = (hit[1:] == hit[:-1] + 1) & (p.piece[hit[1:]] == p.piece[hit[:-1]]) & (p.first[hit[1:]] == p.last[hit[:-1]] + 1)
            a = hit[~joined]
            z = hit[np.append(np.flatnonzero(~joined)[1:], len(hit)) - 1] if len(hit) else hit
            start = base[p.piece]
            out.add(_DIRECT, row[a] % buckets, [(start[a] + p.first[a]).astype("<u4"), (start[a] + p.last[z] + LENGTH).astype("<u4")], row[a])
            keep = np.flatnonzero(_among(row, own, asked) & ~settled)
            data = np.frombuffer(bytes(left) + b"".join(texts) + bytes(size), np.uint8)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            begin = (np.cumsum(sizes) - sizes)[p.piece]
            for part in np.array_split(keep, len(keep) // 16384 + 1):
                if not len(part):
                    continue
                at, h, d = p.at[part], p.hash[part], row[part]
                context = np.lib.stride_tricks.sliding_window_view(data, size)[begin[part] + at]  # each starts `left` before the anchor
                lo, hi = p.first[part] - at + left, p.last[part] - at + left
                busy = np.isin(own[part], hot)
                dealt = [(h[~busy], np.flatnonzero(~busy), lo[~busy], hi[~busy])]
                if busy.any():
                    where = np.flatnonzero(busy)
                    dealt += [(x, where[w], b_, e_) for x, w, b_, e_ in _halves(context[busy], lo[busy], hi[busy])]
                place = np.arange(size)
                for digest, w, lo_, hi_ in dealt:
                    bytes_ = context[w] * ((place >= lo_[:, None]) & (place < hi_[:, None] + LENGTH))  # zeros for bytes of no window: they compress
                    out.add(_CONTEXTS, (digest % np.uint64(buckets)).astype(np.int64), [bytes_.view(f"S{size}").ravel(), (start[part][w] + at[w]).astype("<u4"), lo_.astype("u1"), hi_.astype("u1")], d[w])
                yield from out.emit()
    yield from out.emit(last=True)
    trim()


def _among(row: np.ndarray, value: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether (row, value), the value below 2 ** 48, is among the pairs."""
    return np.isin(row << 48 | value, pairs[:, 0] << 48 | pairs[:, 1]) if len(pairs) else np.zeros(len(row), bool)


def suffix_runs(data: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): suffixes of `data` at the given places in the order of their first `length` bytes, without those
    that equal no other; `run` numbers the runs of equal ones.

    Eight bytes a round: suffixes that already differ from both neighbours drop out, the rest is sorted on.
    """
    w = _words(data + bytes(8))
    order = np.arange(len(at))
    run = np.zeros(len(at), np.int64)
    for k in range(0, length, 8):
        key = w[at[order] + k].byteswap()
        if length - k < 8:
            key = key >> np.uint64(8 * (8 - length + k))
        by = np.lexsort((key, run)) if k else np.argsort(key, kind="stable")
        order, run, key = order[by], run[by], key[by]
        new = np.concatenate(([True], (run[1:] != run[:-1]) | (key[1:] != key[:-1]))) if len(order) else np.empty(0, bool)
        alone = new & np.append(new[1:], True)
        run = np.cumsum(new)
        order, run = order[~alone], run[~alone]
    return order, run


def corpus_order(dictionary: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int, phrase: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, offset, least): for every window of the dictionary that repeats, the smallest key of its run.

    dictionary: distinct contexts of `size` bytes with windows at lo..hi; the parse: `phrase` (entry) and `key` of each
    occurrence. The dictionary's suffix array puts windows into lexicographic order; within a run of equal ones,
    occurrences follow in the parse's order, of which the first key is what decides.
    """
    n = hi.astype(np.int64) - lo + 1
    entry = np.repeat(np.arange(len(n)), n)
    off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo.astype(np.int64), n)
    first = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(first, phrase, key)
    order, run = suffix_runs(np.ascontiguousarray(dictionary).tobytes(), entry * size + off, LENGTH)
    least = first[entry]
    if len(order):
        least[order] = _least((run,), least[order])
    return entry, off, least


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that some smaller document has, from the contexts around shared anchors.

    A chunk's new records join what stayed of earlier ones once they are as many: of each context, all occurrences
    in its first document with a window not yet settled; so copies, however many, don't gather here.
    """
    left, size = LENGTH - ANCHOR, 2 * LENGTH - ANCHOR
    state: list[np.ndarray] | None = None
    held: list[list[np.ndarray]] = []

    def settle(records: list[np.ndarray]) -> tuple[list[np.ndarray], pa.RecordBatch]:
        context, at, lo, hi, key, th = records
        order = np.lexsort((key, hi, lo, context))
        context, at, lo, hi, key, th = (c[order] for c in (context, at, lo, hi, key, th))
        heads = _heads(context, lo, hi)
        phrase = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(context))))
        entry, off, least = corpus_order(context[heads].astype(f"S{size}"), lo[heads], hi[heads], size, phrase, key)
        # windows of each occurrence: those of its dictionary entry
        n = (hi.astype(np.int64) - lo + 1)
        begin = np.concatenate(([0], np.cumsum(n[heads])))[phrase]
        rec = np.repeat(np.arange(len(n)), n)
        window = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        late = key[rec] > least[window]
        hit = np.flatnonzero(late)
        out = _found(key[:0], th[:0], key[:0])
        if len(hit):  # neighbouring windows of one record make one span
            own = off[window]
            cut = np.concatenate(([True], (rec[hit[1:]] != rec[hit[:-1]]) | (own[hit[1:]] != own[hit[:-1]] + 1)))
            a, z = hit[cut], hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
            r = rec[a]
            out = _found(key[r], th[r], _span(at[r] - left + own[a], at[r] - left + own[z] + LENGTH))
        open_ = np.bincount(rec[~late], minlength=len(n)) > 0
        # of equal contexts the smallest document's decide all later ones; each of them goes if a smaller document comes
        keep = open_ & (key == key[heads][phrase])
        return [c[keep] for c in (context, at, lo, hi, key, th)], out

    for chunk in _gathered(batches):
        if _DIRECT in chunk:
            start, end, key, th = chunk[_DIRECT]
            yield _found(key, th, _span(start, end))
        if _CONTEXTS not in chunk:
            continue
        context, at, lo, hi, key, th = chunk[_CONTEXTS]
        held.append([context, at.astype(np.int64), lo, hi, key, th])
        if state is None or sum(len(x[0]) for x in held) >= len(state[0]):
            state, out = settle([np.concatenate(c) for c in zip(*([state] if state else []), *held, strict=True)])
            held = []
            yield out
    if held:
        yield settle([np.concatenate(c) for c in zip(*([state] if state else []), *held, strict=True)])[1]
    trim()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of a document's spans cut out of its bytes."""
    for b in slices(batches, _SLICE, "text"):
        out: list[list] = [[], [], [], []]
        for data, values in zip(utf8_values(b.column("text")), b.column("spans").to_pylist(), strict=True):
            packed = -1 - np.array(values or [], np.int64)
            start = packed >> 31
            end = start + (packed & 0x7FFFFFFF)
            by = np.argsort(start, kind="stable")
            start, reach = start[by], np.maximum.accumulate(end[by]) if len(by) else end
            new = np.concatenate(([True], start[1:] > reach[:-1])) if len(by) else np.empty(0, bool)
            a = start[new].tolist()
            z = reach[np.append(np.flatnonzero(new)[1:], len(by)) - 1].tolist() if len(by) else []
            kept = b"".join(data[x:y] for x, y in zip([0, *z], [*a, len(data)], strict=True))
            for column, value in zip(out, (a, z, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        yield pa.record_batch([b.column("key"), b.column("text"), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary()), pa.array(out[3])], ["key", "text", "starts", "ends", "kept", "kept_sha256"])


def buckets_of(size: int | None) -> int:
    """Buckets for so many bytes of text, however few partitions the session has: a task's records don't grow with the input."""
    return max(1, -(-(size or 0) // _BUCKET))


def repeated_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(key, text, starts, ends, kept, kept_sha256): every byte covered by a LENGTH-byte string that also starts in a
    document with a smaller key is cut out; starts and ends are the removed runs, `kept` the bytes that remain.

    `key` must be an integer. Texts are UTF-8 bytes, whole; null is empty; texts under LENGTH bytes stay as they are.
    Rows of equal key never remove each other's bytes, and each gets its own runs; rows without a key keep all. An
    empty table gives no rows; other columns are not read. Phrases are equal by 128 bits of hash, an anchor's windows
    by 64 beside the anchor's own 48, all others byte by byte. Three exchanges of fixed-size records (anchors and
    phrases, shared anchors, contexts) and one of the texts; tasks hold slices of bounded size and, of copies, one.
    The contexts of hot anchors (at most _MOST_HOT, known to all tasks) are dealt by half a window's bytes more.
    """
    spark = docs.sparkSession
    data = text_of(docs, text)
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_of(docs.select(F.sum(F.octet_length(data))).first()[0]))
    # rows are known by key and a hash of text, neither ever null, so that both joins find the texts dealt alike
    missing = docs[key].isNull()
    read = docs.select(docs[key].cast("bigint").alias("key"), F.coalesce(docs[key].cast("bigint"), F.lit(0)).alias("k"), F.hash(data, missing).alias("th"), data.alias("text"))
    dealt = read.where("key is not null").mapInArrow(lambda it: _parsed(it, parts), _ROWS).repartitionById(parts, F.col("bucket"))
    found = written(dealt.mapInArrow(_shared, _FOUND))
    is_hot = (F.col("value") >= _BUSY) & (F.col("value") < _SETTLED)
    asking = found.where((F.col("value") >= 0) & ~is_hot)
    hot = np.empty(0, np.int64)
    if found.where(is_hot).limit(1).count():
        least = max(_HOT, asking.count() // _MOST_HOT)
        hot = np.sort(found.where(is_hot & (F.col("tag") >= least)).select("value").toPandas()["value"].to_numpy(np.int64) ^ _BUSY)
    texts = read.repartition(parts, "k", "th")
    anchors = asking.repartition(parts, "k", "th").groupBy("k", "th").agg(F.collect_set(F.struct("value", "tag")).alias("anchors"))
    asked = texts.join(anchors, ["k", "th"]).select("key", "th", "text", "anchors")  # the same columns as below: dealt once
    around = asked.mapInArrow(lambda it: _contexts(it, parts, hot), _ROWS).repartitionById(parts, F.col("bucket"))
    spans = around.mapInArrow(_repeats, _FOUND).unionAll(found.where("value < 0")).select("k", "th", "value")
    spans = spans.repartition(parts, "k", "th").groupBy("k", "th").agg(F.collect_set("value").alias("spans"))
    cut = texts.join(spans, ["k", "th"], "left").select("key", "text", "spans")
    return cut.mapInArrow(_removed, "key bigint, text string, starts array<bigint>, ends array<bigint>, kept binary, kept_sha256 string")
