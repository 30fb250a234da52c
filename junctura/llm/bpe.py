"""BPE encoding and decoding that reuses content-defined chunks.

A text is cut at blanks where a rolling hash of the ``ROLL`` bytes before meets a mask, so equal
passages of different documents give equal chunks whatever stands before them. A worker encodes
each distinct chunk once and keeps it in a bounded table for the documents that follow. A chunk
that is not in the table is put together in the same way from its words (chunks of mask 0), which
need the tokenizer itself only when they are new, too.

At each joint of two chunks the last word of one and the first of the next are encoded together. If
the ids or the decoded text differ from those of the two apart, the joint is repaired: the chunks around it are encoded as one text,
with one more on both sides each time, until the ids of the outermost chunks come out as they are alone; at the widest that is the whole
document, so the result is always the library's. A document with a repaired joint is decoded by the library itself. Words are
encoded apart only for a tokenizer that drops white space, lower-cases and never merges across
white space or from a letter to a full stop or comma (``words_apart``); others get their chunks whole.

Defined cases: null text counts as empty (no ids, empty decoded text); repeated rows are encoded one
by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx

ROLL = 16
MASK = 127
#: Bounds of a worker's tables: entries that were not used since the last time a table was full go.
WORD_BYTES, CHUNK_BYTES = 140 << 20, 24 << 20
END = "</w>"
_STOP = re.compile(rb"(?<=[a-z0-9])([.,]+)(?=\s|$)")


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of the blanks at which a chunk ends, from the bytes before them in their row alone."""
    blank = np.flatnonzero(data == 32)
    start = bounds[np.searchsorted(bounds, blank, "right") - 1] if len(blank) else blank
    blank = blank[blank - start > ROLL]
    if not len(blank):
        return blank
    return blank[(tx.span_hashes(data, blank - ROLL, blank, False) & np.uint64(MASK)) == 0]


class Table(dict):
    """What was found for a key, within about ``bound`` bytes; the older half goes when it is full."""

    def __init__(self, bound: int):
        self.bound, self.size, self.old = bound, 0, {}

    def __missing__(self, key: bytes) -> bytes:
        found = self.old[key]
        self.keep(key, found)
        return found

    def keep(self, key: bytes, ids: bytes) -> None:
        self[key] = ids
        self.size += len(key) + len(ids) + 170

    def new(self, keys: set[bytes]) -> list[bytes]:
        return [k for k in keys if k not in self and k not in self.old]

    def settle(self) -> None:
        if self.size > self.bound // 2:
            self.old = dict(self)
            self.clear()
            self.size = 0


class Encoder:
    """Encodes and decodes documents with tables of the chunks and words it has met."""

    def __init__(self, path: str, words_apart: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words_apart = words_apart
        self.words, self.chunks = Table(WORD_BYTES), Table(CHUNK_BYTES)
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.pieces = np.array([self.tokenizer.decode([i], skip_special_tokens=False) for i in range(size)], object)
        self.ends = np.array([str(x).endswith(END) for x in self.pieces])

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """What the library itself gives: little-endian 32-bit ids."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def decoded(self, ids: bytes) -> str:
        return " ".join(self.pieces[np.frombuffer(ids, "<u4")].tolist())

    def _learn_words(self, words: set[bytes]) -> None:
        new = self.words.new(words)
        easy = [w for w in new if w.decode().isalpha()]  # letters: one run of pieces, of which the last ends the word
        for part in (easy[i : i + 20_000] for i in range(0, len(easy), 20_000)):
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw = ids.tobytes()
                for w, a, b in zip(part, [0, *(ends[:-1] * 4).tolist()], (ends * 4).tolist(), strict=True):
                    self.words.keep(w, raw[a:b])
        rest = self.words.new(set(new))
        for w, ids in zip(rest, self.plain(rest), strict=True):
            self.words.keep(w, ids)

    def _split(self, chunk: bytes) -> list[bytes]:
        return _STOP.sub(rb" \1", chunk.lower()).split()

    def _learn_chunks(self, chunks: set[bytes]) -> None:
        new = self.chunks.new(chunks)
        if self.words_apart:
            split = [self._split(c) for c in new]
            self._learn_words({w for ws in split for w in ws})
            found = self.words.__getitem__
            units = [b"".join(map(found, ws)) for ws in split]
        else:
            units = self.plain(new)
        for c, ids in zip(new, units, strict=True):
            self.chunks.keep(c, ids)

    def documents(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each row."""
        raw, at = data.tobytes(), cuts(data, bounds)
        pieces = []
        for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), np.searchsorted(at, bounds[:-1]).tolist(), np.searchsorted(at, bounds[1:]).tolist(), strict=True):
            ends = [a, *at[i:j].tolist(), b]
            pieces.append([raw[x:y] for x, y in zip(ends, ends[1:], strict=False)])
        self.words.settle()
        self.chunks.settle()
        self._learn_chunks({c for own in pieces for c in own})
        joints = [[_joint(a, b) for a, b in zip(own, own[1:], strict=False)] for own in pieces]
        whole = list({j for own in joints for j in own})
        halves = list({x for j in whole for x in j})
        apart = dict(zip(halves, self.plain(halves), strict=True))
        joined = self.plain([a + b for a, b in whole])
        decoded = self.tokenizer.decode_batch([np.frombuffer(x, "<u4").tolist() for x in joined], skip_special_tokens=False)
        wrong = {j for j, ids, text in zip(whole, joined, decoded, strict=True) if ids != apart[j[0]] + apart[j[1]] or text != self.decoded(ids)}
        out = []
        for own, js in zip(pieces, joints, strict=True):
            if wrong and not wrong.isdisjoint(js):
                ids = self.repaired(own, [i for i, j in enumerate(js) if j in wrong])
                out.append((ids, self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)))
            else:
                ids = b"".join(map(self.chunks.__getitem__, own))
                out.append((ids, self.decoded(ids)))
        return out

    def repaired(self, own: list[bytes], wrong: list[int]) -> bytes:
        """Ids of a document of chunks of which some do not join; joint i lies between chunks i and i + 1."""
        units = [(i, i + 1, self.chunks[c]) for i, c in enumerate(own)]  # first chunk, end chunk, ids
        for joint in wrong:
            width = 1
            while True:
                lo, hi = max(joint + 1 - width, 0), min(joint + 1 + width, len(own))
                inner = [u for u in units if u[0] < hi and u[1] > lo]
                lo, hi = inner[0][0], inner[-1][1]
                ids = self.plain([b"".join(own[lo:hi])])[0]
                left, right = inner[0][2], inner[-1][2]
                # the outermost stretches keep their ids, so the joints to what lies beyond stay as they were judged
                if (lo == 0 or width > 1 and ids.startswith(left)) and (hi == len(own) or width > 1 and ids.endswith(right)):
                    units = [u for u in units if u[1] <= lo] + [(lo, hi, ids)] + [u for u in units if u[0] >= hi]
                    break
                width += 1
        return b"".join(u[2] for u in units)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words_apart: bool) -> Encoder:
    """One tokenizer for each worker process; the tables are those of a task."""
    if (path, words_apart) not in _encoders:
        _encoders[path, words_apart] = Encoder(path, words_apart)
    return _encoders[path, words_apart]


def _joint(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """The last word of a and, with the blank before it, the first of b."""
    end = b.find(b" ", 1)
    return a[a.rfind(b" ", 0, len(a) - 1) + 1 :], b if end < 0 else b[:end]


def _units(path: str, words_apart: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[bytes, str]]]]:
        own = encoder(path, words_apart)
        try:
            for batch in batches:
                for first, end, data, bounds in tx.text_slices(batch.column("text")):
                    yield batch.column("doc_id").slice(first, end - first), own.documents(data, bounds)
        finally:  # a worker lives on after its task and must not hold the tables
            own.words, own.chunks = Table(WORD_BYTES), Table(CHUNK_BYTES)
            tx.release_memory()

    return run


def encode_decode(docs: DataFrame, path: str, words_apart: bool = True) -> DataFrame:
    """doc_id, ids and the text that the ids decode to."""
    units = _units(path, words_apart)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, found in units(batches):
            ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(u[0]) // 4 for u in found)]).astype(np.int32), pa.array(np.frombuffer(b"".join(u[0] for u in found), "<i4")))
            yield pa.RecordBatch.from_arrays([doc_id, ids, pa.array([u[1] for u in found], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(out, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str, words_apart: bool = True) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    units = _units(path, words_apart)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, found in units(batches):
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array([len(u[0]) // 4 for u in found], pa.int64()), pa.array([hashlib.sha256(u[0]).hexdigest() for u in found], pa.string()), pa.array([hashlib.sha256(u[1].encode()).hexdigest() for u in found], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_documents(docs: DataFrame, path: str, words_apart: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, and a digest of the text that the ids decode to."""
    units = _units(path, words_apart)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, found in units(batches):
            sizes = [len(u[0]) // 4 for u in found]
            ids = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.array(np.frombuffer(b"".join(u[0] for u in found), "<i4")))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(sizes, pa.int64()), ids, pa.array([hashlib.sha256(u[1].encode()).hexdigest() for u in found], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(out, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(tx.table(spark, sf_dir, "documents"), tokenizer_path())
