"""Removal of byte strings that also start in an earlier document, by longest-previous-factor arrays.

A byte goes if one of the ``SPAN``-byte windows that cover it also starts in a document of a smaller doc_id. The
windows are judged in three steps, each on what the one before leaves open:

1. Texts are cut at content-defined places. A chunk, taken with the SPAN - 1 bytes after it so that it holds all
   bytes of the windows that start in it, is covered in full where a smaller document has the same chunk (by 128 bits of BLAKE2).
2. Every window has a minimiser, the least hash of its ``GRAM``-byte strings, which depends on the
   window alone. Windows whose minimiser occurs in one distinct chunk only have no match. Minimisers
   are dealt to buckets by their hash, at most one for each flush of a task, minimiser and chunk.
3. Runs of windows with a shared minimiser are dealt by the minimiser. In a bucket, windows whose 64-bit hash no other window
   has are left out; the suffixes at the others are sorted (to SPAN bytes) and get their array of longest common
   prefixes. The longest previous factor of a suffix is the longer of what it shares with the previous and with
   the next suffix of a smaller document; a window goes where that has SPAN bytes. Minimisers of very many chunks (edges of
   common passages) are dealt window by window instead, so that no bucket holds all of a frequent one.

Tasks settle equal pieces among themselves before anything is shuffled, a bounded number of bytes at a time. Later texts are read
again only for documents with a chunk or a minimiser in question.

Defined cases: null text is empty (nothing removed, digest of no bytes); rows that repeat a doc_id and text give equal rows; rows
of one doc_id and different texts are judged apart, each against smaller doc_ids alone (they are told from each other by 64 bits of
their digests); a null doc_id is neither smaller nor larger than any, so nothing is removed; of equal texts under different ids the
smallest id keeps its bytes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx

SPAN = 50
GRAM = 22
CHUNK_MASK = np.uint64(127)
#: A minimiser of more chunks than this is dealt window by window.
FREQUENT = 20_000
BUCKET_BYTES = 16 << 20
#: Windows that a task sorts at a time, minimisers that it holds, and bytes of pieces that it holds.
SORTED_WINDOWS, HELD_ENTRIES, HELD_BYTES = 300_000, 400_000, 6 << 20
BROADCAST_IDS = 1_000_000
#: What tells a text: its doc_id and, where texts of that doc_id differ, 64 bits of its digest (else 0).
ROW = ["doc_id", "variant"]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = tx._power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tx._BYTE[data] * power[: len(data)], out=sums[1:])
    return tx.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n])


def _minimisers(hashes: np.ndarray) -> np.ndarray:
    """The least of the SPAN - GRAM + 1 hashes from each position on."""
    need, width, out = SPAN - GRAM + 1, 1, hashes
    while 2 * width <= need:
        out = np.minimum(out[:-width], out[width:]) if len(out) > width else out[:0]
        width *= 2
    rest = need - width
    return np.minimum(out[:-rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]


class Slice:
    """Chunks and minimisers of the rows of one slice."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, minimise: bool = True):
        self.data, self.bounds = data, bounds
        hashes = _gram_hashes(data)
        sizes = np.diff(bounds)
        self.stop = np.maximum(bounds[1:] - SPAN + 1, bounds[:-1])  # windows start before it
        cut = np.flatnonzero((hashes & CHUNK_MASK) == 0) + GRAM
        row = np.searchsorted(bounds, cut, "right") - 1
        inside = (row < len(sizes)) & (cut - GRAM >= bounds[np.minimum(row, len(sizes) - 1)]) & (cut < self.stop[np.minimum(row, len(sizes) - 1)])
        starts = np.concatenate([bounds[:-1][sizes >= SPAN], cut[inside]])
        self.chunk_start = np.sort(starts)
        self.chunk_row = np.searchsorted(bounds, self.chunk_start, "right") - 1
        following = np.append(self.chunk_start[1:], len(data))
        self.chunk_stop = np.minimum(following, self.stop[self.chunk_row]) if len(starts) else following[:0]
        self.chunk_key = tx.span_hashes(data, self.chunk_start, self.chunk_stop + SPAN - 1, False) if len(starts) else np.zeros(0, np.uint64)
        self.chunk_first = np.searchsorted(self.chunk_row, np.arange(len(sizes) + 1))
        if minimise:
            least = _minimisers(hashes)
            self.least = np.concatenate([least, np.zeros(len(data) + 1 - len(least), np.uint64)])

    def runs(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Minimiser, first window, end window and chunk of the runs of equal minimisers in the chunks kept."""
        a, b = self.chunk_start[keep], self.chunk_stop[keep]
        flags = np.zeros(len(self.data) + 1, np.int32)
        flags[a] += 1
        np.add.at(flags, b, -1)
        on = np.cumsum(flags[:-1]) > 0
        new = np.zeros(len(self.data), bool)
        new[a] = True
        new[1:] |= self.least[1 : len(self.data)] != self.least[: len(self.data) - 1]
        first = np.flatnonzero(new & on)
        chunk = np.searchsorted(self.chunk_start, first, "right") - 1
        end = np.minimum(np.append(first[1:], len(self.data)), self.chunk_stop[chunk])
        return self.least[first], first, end, chunk


def _binary(values: np.ndarray, width: int = 8) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(raw: bytes, width: int = 8) -> np.ndarray:
    cut = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(cut), 8), np.uint8)
    out[:, :width] = cut
    return out.view("<u8").ravel()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, bounds in tx.text_slices(batch.column("text")):
            s, raw = Slice(data, bounds, False), data.tobytes()
            at = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in at]
            chunks = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s.chunk_start.tolist(), (s.chunk_stop + SPAN - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(bounds)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(s.chunk_first, pa.int32()), pa.array(chunks, pa.binary()))],
                names=["doc_id", "n_bytes", "sha", "chunks"],
            )


def _entries(buckets: int):
    """For each flush, minimiser and chunk the smallest doc_id; what has two chunks in the flush is known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for first, end, data, bounds in tx.text_slices(batch.column("text")):
                s = Slice(data, bounds)
                least, _, _, chunk = s.runs(np.ones(len(s.chunk_start), bool))
                ids = batch.column("doc_id").slice(first, end - first).to_numpy(zero_copy_only=False)
                parts.append((least, s.chunk_key[chunk], ids[s.chunk_row[chunk]]))
                held += len(least)
                if held >= HELD_ENTRIES:
                    yield from _dealt_entries(parts, buckets)
                    parts, held = [], 0
        if parts:
            yield from _dealt_entries(parts, buckets)

    return run


def _dealt_entries(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    value, tag, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, tag, value))
    value, tag, doc = value[order], tag[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (tag[1:] != tag[:-1])
    value, tag, doc = value[new], tag[new], doc[new]
    head = np.ones(len(value), bool)
    head[1:] = value[1:] != value[:-1]
    group = np.cumsum(head) - 1
    several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    for known, pick in ((False, ~several), (False, several & head), (True, several)):
        v, t, d = value[pick], tag[pick], doc[pick]
        if not len(v):
            continue
        marker = not known and bool(several[pick].any())
        if marker:  # it has the number of chunks in the place of a document
            d = np.bincount(group)[group[pick]]
        b = (d.view(np.uint64) if known else v) % np.uint64(buckets)
        order = np.argsort(b, kind="stable")
        b, v, t, d = b[order], v[order], t[order], d[order]
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        ends = np.append(at[1:], len(b))
        wide = 4 if len(d) and 0 <= d.min() and d.max() < 2**32 else 8
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(b[at].astype(np.int64)), pa.array([2 if known else 1 if marker else 0] * len(at), pa.int32()), pa.array([wide] * len(at), pa.int32()),
                pa.array([_binary(v[x:y]) if known else _binary(v[x:y] // np.uint64(buckets), 6) for x, y in zip(at, ends, strict=True)], pa.binary()),
                pa.array([b"" if known else _binary(t[x:y], 5) for x, y in zip(at, ends, strict=True)], pa.binary()),
                pa.array([_binary(d[x:y].view(np.uint64), wide) for x, y in zip(at, ends, strict=True)], pa.binary()),
            ],
            names=["bucket", "kind", "wide", "value", "tag", "doc"],
        )


def _shared(buckets: int, frequent: int):
    """doc_id and minimiser of the entries whose minimiser occurs in two chunks at least; frequent minimisers also in a row of their own."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        done = [(r["doc"], r["wide"], r["value"]) for r in rows if r["kind"] == 2]
        docs = [_numbers(d, w) for d, w, _ in done]
        values = [_numbers(v) for _, _, v in done]
        many = [np.zeros(len(v), bool) for v in values]
        rest = [r for r in rows if r["kind"] != 2]
        if rest:
            cut = np.concatenate([_numbers(r["value"], 6) for r in rest])
            tag = np.concatenate([_numbers(r["tag"], 5) for r in rest])
            doc = np.concatenate([_numbers(r["doc"], r["wide"]) for r in rest])
            marker = np.concatenate([np.full(len(r["value"]) // 6, r["kind"] == 1) for r in rest])
            order = np.lexsort((tag, cut))
            cut, tag, doc, marker = cut[order], tag[order], doc[order], marker[order]
            head = np.append(True, cut[1:] != cut[:-1])
            group = np.cumsum(head) - 1
            fresh = head | np.append(True, tag[1:] != tag[:-1])
            n = np.bincount(group, weights=fresh) + np.bincount(group, weights=np.where(marker, doc - np.uint64(1), 0))
            keep = (n[group] > 1) & ~marker
            low = np.uint64(table.column("bucket")[0].as_py())
            docs.append(doc[keep])
            # the six bytes that were sent do not hold the whole value; what was cut off only adds candidates
            values.append(cut[keep] * np.uint64(buckets) + low)
            many.append(np.zeros(keep.sum(), bool))
            often = head & (n[group] > frequent)
            docs.append(np.zeros(often.sum(), np.uint64))
            values.append(cut[often] * np.uint64(buckets) + low)
            many.append(np.ones(often.sum(), bool))
        doc = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        return pa.table({"doc_id": pa.array(doc.view(np.int64)), "value": pa.array((value & np.uint64((1 << 44) - 1)).astype(np.int64)), "frequent": pa.array(np.concatenate(many) if many else np.zeros(0, bool))})

    return run


def _words(text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The SPAN bytes from each position on as big-endian words, the first word first."""
    out = []
    for i in range(0, SPAN, 8):
        width = min(8, SPAN - i)
        w = np.zeros(len(at), np.uint64)
        for j in range(width):
            w = (w << np.uint64(8)) | text[at + i + j]
        out.append(w)
    return out


def _factor_before(doc: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What each suffix shares with the nearest one before it that has a smaller document; shared[i] is what i has in common with i - 1.

    Pointers jump over suffixes of documents that are not smaller, so the number of rounds is logarithmic.
    """
    to, low = np.arange(len(doc)) - 1, shared.copy()
    active = np.flatnonzero(to >= 0)
    while len(active):
        active = active[(to[active] >= 0) & (low[active] > 0)]
        active = active[doc[to[active]] >= doc[active]]
        over = to[active]
        low[active] = np.minimum(low[active], low[over])
        to[active] = to[over]
    return np.where(to >= 0, low, 0)


def longest_previous_factors(text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For the suffix at each place (of SPAN bytes at least) the length, up to SPAN, of the longest prefix that also starts in a smaller document."""
    words = _words(text, at)
    order = np.lexsort((doc, *reversed(words)))
    sorted_docs, places = doc[order], at[order]
    shared = np.full(len(at), SPAN, np.int64)
    shared[:1] = 0
    left = np.arange(1, len(at))
    for i in range(SPAN):
        differ = text[places[left] + i] != text[places[left - 1] + i]
        shared[left[differ]] = i
        left = left[~differ]
    before = _factor_before(sorted_docs, shared)
    after = _factor_before(sorted_docs[::-1], np.append(0, shared[:0:-1]) if len(at) else shared)[::-1]
    out = np.zeros(len(at), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _equal_pieces(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Indices of the pieces of the smallest document that has them, and (index, first window, end window) of the others, which are covered."""
    numbers: dict[bytes, int] = {}
    which = np.fromiter((numbers.setdefault(p, len(numbers)) for p in pieces), np.int64, len(pieces))
    least = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    first = docs == least[which]  # all places of a piece in its first document share their fate
    return np.flatnonzero(first), [(int(i), int(starts[i]), int(starts[i]) + len(pieces[i]) - SPAN + 1) for i in np.flatnonzero(~first)]


def _settle(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes], values: np.ndarray) -> list[tuple[int, int, int]]:
    """(index of a piece, first window, end window) found to be covered.

    Equal pieces are settled by their smallest document; the windows of the distinct ones by their suffixes.
    """
    left, covered = _equal_pieces(docs, starts, pieces)
    # equal windows have equal minimisers, so the minimisers are sorted apart, some at a time
    order = left[np.argsort(values[left], kind="stable")]
    count = np.array([len(pieces[i]) - SPAN + 1 for i in order], np.int64)
    head = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1])[: len(order)])
    groups = np.append(head, len(order))
    upto, first = np.concatenate([[0], np.cumsum(count)]), 0
    for g in range(len(head)):
        if upto[groups[g + 1]] - upto[groups[first]] >= SORTED_WINDOWS or g == len(head) - 1:
            block = order[groups[first] : groups[g + 1]]
            first = g + 1
            if len(block) > 1 and max(len(pieces[i]) for i in block) > SPAN:  # single windows are settled by the pieces
                covered += [(int(block[i]), x, y) for i, x, y in _settled_windows(docs[block], starts[block], [pieces[i] for i in block])]
    return covered


def _settled_windows(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> list[tuple[int, int, int]]:
    """(index of a piece, first window, end window) of the windows that an earlier document of these has."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    offset = np.cumsum(sizes) - sizes
    count = sizes - SPAN + 1
    owner = np.repeat(np.arange(len(pieces)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = offset[owner] + within
    # a window whose hash no other has is equal to none
    hashes = tx.span_hashes(text, at, at + SPAN, False)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    again = order[np.append(same, False) | np.append(False, same)]
    again.sort()
    hit = np.zeros(len(at), np.int8)
    hit[again] = longest_previous_factors(text, at[again], docs[owner[again]]) >= SPAN
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while a < b:  # a stretch may go on into the next piece
            o = owner[a]
            end = min(b, int(np.searchsorted(owner, o, "right")))
            out.append((int(o), int(starts[o] + within[a]), int(starts[o] + within[a]) + end - a))
            a = end
    return out


PIECES = "bucket long, value long, doc_id long, variant long, start int, n_windows int, piece binary"
_PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _open_pieces(buckets: int):
    """Runs of windows with a shared minimiser outside covered chunks, as pieces of text; what the task settles itself has no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for first, end, data, bounds in tx.text_slices(batch.column("text")):
                s, raw = Slice(data, bounds), data.tobytes()
                rows = batch.slice(first, end - first)
                covered = np.zeros(len(s.chunk_start), bool)
                for r, idx in enumerate(rows.column("covered").to_pylist()):
                    if idx:
                        covered[s.chunk_first[r] + np.array(idx)] = True
                least, a, b, chunk = s.runs(~covered)
                row = s.chunk_row[chunk]
                # the minimisers asked for, as (row, value) pairs, against those of the runs
                asked, often = rows.column("value"), rows.column("frequent")
                counts = np.diff(asked.offsets.to_numpy())
                values = asked.flatten().to_numpy(zero_copy_only=False)
                wanted = _pair(np.repeat(np.arange(end - first), counts), values)
                order = np.argsort(wanted)
                have = _pair(row, (least & np.uint64((1 << 44) - 1)).astype(np.int64))
                at = np.minimum(np.searchsorted(wanted[order], have), max(len(wanted) - 1, 0))
                hit = np.flatnonzero(wanted[order][at] == have) if len(wanted) else np.zeros(0, np.int64)
                many = often.flatten().to_numpy(zero_copy_only=False)[order][at[hit]] if len(hit) else np.zeros(0, bool)
                ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
                pieces = [raw[x : y + SPAN - 1] for x, y in zip(a[hit].tolist(), b[hit].tolist(), strict=True)]
                variants = rows.column("variant").to_numpy(zero_copy_only=False)
                held.append(((least[hit] & np.uint64((1 << 44) - 1)).astype(np.int64), ids[row[hit]], variants[row[hit]], (a[hit] - bounds[row[hit]]).astype(np.int64), many.astype(bool), pieces))
                size += int((b[hit] - a[hit]).sum()) + (SPAN + 40) * len(pieces)
                if size >= HELD_BYTES:
                    yield from _emitted(held, buckets)
                    held, size = [], 0
        if held:
            yield from _emitted(held, buckets)

    return run


def _emitted(held: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    value, doc, variant, start, many = (np.concatenate([h[i] for h in held]) for i in range(5))
    pieces = [p for h in held for p in h[5]]

    def batch(bucket: pa.Array, values: pa.Array, which: np.ndarray, first: np.ndarray, n: np.ndarray, cut: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([bucket, values, pa.array(doc[which]), pa.array(variant[which]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), cut], names=_PIECE_NAMES)

    left, covered = _equal_pieces(doc, start, pieces)
    once, often = left[~many[left]], left[many[left]]
    if covered:
        which, x, y = (np.array(c, np.int64) for c in zip(*covered, strict=True))
        none = pa.nulls(len(which), pa.int64())
        yield batch(none, none, which, x, y - x, pa.nulls(len(which), pa.binary()))
    own = [pieces[i] for i in once]
    yield batch(pa.array(value[once] % buckets), pa.array(value[once]), once, start[once], np.array([len(p) - SPAN + 1 for p in own], np.int64), pa.array(own, pa.binary()))
    for i in often:
        p, n = pieces[i], len(pieces[i]) - SPAN + 1
        cut = [p[j : j + SPAN] for j in range(n)]
        same = np.full(n, i)
        yield batch(pa.array([_piece_hash(c) % buckets for c in cut], pa.int64()), pa.array(value[same]), same, start[i] + np.arange(n), np.ones(n, np.int64), pa.array(cut, pa.binary()))


def _pair(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number for a row of a slice and a 44-bit value; rows of a slice are below 2 ** 20."""
    return row.astype(np.int64) << 44 | value


def _piece_hash(piece: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=7).digest(), "little")


COVERED = "doc_id long, variant long, start int, n_windows int"


def _covered(table: pa.Table) -> pa.Table:
    docs, starts = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
    if table.column("piece").null_count:
        return table.select(["doc_id", "variant", "start", "n_windows"])
    out = _settle(docs, starts, table.column("piece").to_pylist(), table.column("value").to_numpy())
    which, first, end = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))
    variants = table.column("variant").to_numpy()
    return pa.table({"doc_id": pa.array(docs[which]), "variant": pa.array(variants[which]), "start": pa.array(first.astype(np.int32)), "n_windows": pa.array((end - first).astype(np.int32))})


def removed_bytes(data: np.ndarray, bounds: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
    """A flag for each byte of the slice."""
    s = Slice(data, bounds, False)
    mark = np.zeros(len(data) + 1, np.int64)
    for r, (chunks, at, n) in enumerate(zip(rows.column("covered").to_pylist(), rows.column("starts").to_pylist(), rows.column("counts").to_pylist(), strict=True)):
        if chunks:
            k = s.chunk_first[r] + np.array(chunks)
            np.add.at(mark, s.chunk_start[k], 1)
            np.add.at(mark, s.chunk_stop[k] + SPAN - 1, -1)
        if at:
            a = bounds[r] + np.array(at)
            np.add.at(mark, a, 1)
            np.add.at(mark, a + np.array(n) + SPAN - 1, -1)
    return np.cumsum(mark[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, bounds in tx.text_slices(batch.column("text")):
            rows = batch.slice(first, end - first)
            gone = removed_bytes(data, bounds, rows)
            left = np.cumsum(np.concatenate([[0], ~gone]))
            kept = data[~gone].tobytes()
            edge = np.concatenate([[False], gone[1:] & ~gone[:-1]]) if len(gone) else gone
            if len(gone):
                edge[bounds[:-1][bounds[:-1] < len(gone)]] = gone[bounds[:-1][bounds[:-1] < len(gone)]]
            runs = np.cumsum(np.concatenate([[0], edge]))
            a, b = left[bounds[:-1]], left[bounds[1:]]
            texts = [kept[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("variant"), pa.array(np.diff(bounds) - (b - a)), pa.array(runs[bounds[1:]] - runs[bounds[:-1]]), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary())],
                names=[*ROW, "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def _only(docs: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The documents of ``ids``, by a broadcast up to a number of ids that is checked."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, keys, "left_semi")


def _with_variants(docs: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Both with their variants, and whether texts of one doc_id differ anywhere."""
    digests = profile.select("doc_id", F.xxhash64("sha").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    several = tx.written(digests.filter("doc_id is not null and a <> b").select("doc_id"), "several-texts")
    n = several.count()
    if not n:
        return docs.withColumn("variant", F.lit(0).cast("long")), profile.withColumn("variant", F.lit(0).cast("long")), False
    several = several.withColumn("several", F.lit(True))

    def told(rows: DataFrame, sha) -> DataFrame:
        rows = rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id", "left")
        return rows.withColumn("variant", F.when(F.col("several"), F.xxhash64(sha)).otherwise(F.lit(0).cast("long"))).drop("several")

    return told(docs, F.sha2(F.col("text").cast("binary"), 256)), told(profile, F.col("sha")), True


def repeated_spans(docs: DataFrame, with_text: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes, ``with_text``)."""
    with tx.scratch():
        return tx.written(_repeated_spans(docs, with_text, frequent), "spans", keep=True)


def _repeated_spans(docs: DataFrame, with_text: bool, frequent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    profile = tx.written(docs.mapInArrow(_profile, "doc_id long, n_bytes long, sha string, chunks array<binary>"), "profile")
    docs, profile, several = _with_variants(docs, profile)
    known = docs.filter("doc_id is not null")
    # where no doc_id has several texts, it is the only key: texts that are dealt by it for one join stay where they are for the next
    keys = ROW if several else ROW[:1]
    total = profile.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(24, int(total) // BUCKET_BYTES)

    rows = profile.select(*keys, F.posexplode("chunks").alias("at", "chunk"))
    firsts = rows.groupBy("chunk").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("chunk", "lo")
    later = tx.written(rows.join(firsts, "chunk").filter("doc_id > lo").groupBy(*keys).agg(F.collect_set("at").alias("covered")), "covered-chunks")
    # minimisers are asked for by doc_id, so one that has several texts is not left out for one of them
    whole = profile.filter("variant = 0").join(later, keys).filter(F.size("covered") == F.size("chunks")).select("doc_id").distinct()

    entries = known.select("doc_id", "text").mapInArrow(_entries(buckets), "bucket long, kind int, wide int, value binary, tag binary, doc binary")
    shared = tx.written(entries.groupBy("bucket").applyInArrow(_shared(buckets, frequent), "doc_id long, value long, frequent boolean").distinct(), "shared")
    often = shared.filter("frequent").select("value").distinct().withColumn("frequent", F.lit(True))
    asked = shared.filter("not frequent").select("doc_id", "value").join(whole, "doc_id", "left_anti")
    # one value for FREQUENT chunks and more at most, so few; Spark broadcasts them where its own threshold allows
    open_values = asked.join(often, "value", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    by_doc = open_values.groupBy("doc_id").agg(F.collect_list("value").alias("value"), F.collect_list("frequent").alias("frequent"))
    variants = profile.filter("doc_id is not null").select(*ROW).distinct()
    by_row = tx.written(by_doc.join(variants, "doc_id") if several else by_doc, "shared-minimisers")

    asked = _only(known, by_row.select(*keys), keys).dropDuplicates(keys).join(by_row, keys).join(later, keys, "left")
    pieces = asked.select(*ROW, "text", "value", "frequent", "covered").mapInArrow(_open_pieces(buckets), PIECES)
    # rows that a batch has settled pass through groups of their own, dealt by document
    keyed = pieces.withColumn("bucket", F.coalesce("bucket", -1 - F.pmod("doc_id", F.lit(buckets))))
    windows = keyed.groupBy("bucket").applyInArrow(_covered, COVERED)
    spans = tx.written(windows.groupBy(*keys).agg(F.collect_list("start").alias("starts"), F.collect_list("n_windows").alias("counts")), "covered-windows")

    found = tx.written(later.join(spans, keys, "full"), "covered")
    changed = _only(known, found.select(*keys), keys).join(found, keys).select(*ROW, "text", "covered", "starts", "counts")
    kept = changed.mapInArrow(_kept, "doc_id long, variant long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    kept = kept if several else kept.drop("variant")
    if not with_text:
        out = profile.select(*keys, "n_bytes", "sha").join(kept.drop("kept").dropDuplicates(keys), keys, "left")
        return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    out = docs.join(kept.dropDuplicates(keys), keys, "left")
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"), F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(tx.table(spark, sf_dir, "documents"))
