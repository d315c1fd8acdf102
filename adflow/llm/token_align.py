"""Cross-tokenizer alignment by external spill counting.

Each text is encoded on both sides: byte-level BPE (A) and SentencePiece (B).
Byte offsets at which tokens of both sides end cut the text into groups; tokens
of one group are linked.  For each id pair the number of documents that hold it
linked is counted over the corpus, and every document is told how its links do
in those counts.

The counting spills and merges:

1. A task gathers the pair-document records of its documents into *runs* of
   bounded size (``LINKS`` links), sorts each by (radix of the A id, A id, B id,
   document) and writes it as zstd frames of at most ``FRAME`` records, one row
   a frame.  Copies of a pair inside a document are one record with a number.
2. Runs are merged ``FAN_IN`` at a time, radix by radix: a heap holds the last
   pair of each run's current frame, and what lies up to the least of them is
   counted.  Merged runs are merged again until each radix has one; it holds at
   most one entry a pair, so vocabularies bound it, not documents.
3. That last merge is in order of A ids, so the highest count of an A id is
   known where its pairs end: they are marked before they are written.
4. Records and marked counts meet again by (radix, chunk of runs); each run's
   documents get their sums as one row of two arrays, and add them up.

No step gathers more than ``FAN_IN`` runs of a radix, held compressed; a hot pair
or A id is one record a document and run, already counted within each run, and
an A id's records in one task are those of ``FAN_IN`` runs at most.

Defined results: a null or empty text has no tokens, nor has one whose tokens'
bytes are not blank plus text (SentencePiece may normalise); special tokens'
strings are plain text; each of repeated rows counts as a document and gets its
row; ids may be null; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adflow.llm.base import Scratch, arrow_map, ship_code
from adflow.llm.bpe import vocabulary
from adflow.llm.words import byte_sizes, stretches

LINKS = 1 << 21       # links of the documents in one run
MOST_DOCS = 1 << 18   # documents in one run; more than texts of no bytes in a SLICE
SLICE = 1 << 20       # bytes of text that are aligned at a time; a longer text is aligned alone
EXPANDED = 1 << 20    # links that are written out at a time
DENSE = 1 << 12       # a group of more links is counted by its distinct ids
FRAME = 1 << 16       # records in one zstd frame
RADIX = 64            # parts of the A ids
FAN_IN = 32           # runs merged at a time
#: Texts for the slower library: letters beyond Latin, on which Unicode versions differ, and endless words.
RARE = re.compile("[^\x00-ɏ]|\\S{1000}|\\s{1000}")

_NO = np.zeros(0, np.uint64)


# -- both sides of a text ------------------------------------------------------------------------

class Side:
    """The bytes of each id, and its decimal form."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array(list(map(len, tokens)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.digits = [str(i).encode() for i in range(len(tokens))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        return self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.starts[ids] - upto + sizes, sizes)]


class Encoders:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        from adflow.llm.bpe import PATTERN
        own = vocabulary(path_a)
        ranks = {token: i for token, i in own.ids.items() if i not in set(own.special.values())}
        merged = [own.ids[own.bytes[a] + own.bytes[b]] for a, b in own.merge]
        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        #: ids in the order of merges can be used as ranks
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={}) \
            if merged == sorted(set(merged)) and min(merged, default=256) >= 256 else None
        self.a = Side(own.bytes)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b = Side([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
                       for i in range(self.pieces.get_piece_size()) for p in [self.pieces.id_to_piece(i)]])
        self.bits_b = (len(self.b.sizes) - 1).bit_length()
        if len(self.a.sizes) << self.bits_b > 1 << 32:
            raise ValueError("an id pair must fit 32 bits")
        #: decimal id plus what follows it: , or | after an A id, , or ; after a B id
        self.written = np.array([d + s for side, ends in ((self.a, b",|"), (self.b, b",;"))
                                 for s in (ends[:1], ends[1:]) for d in side.digits], object)

    def ids_a(self, text: str) -> np.ndarray:
        if self.fast is None or RARE.search(text):
            return np.array(self.library.encode(" " + text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text on both sides; none where a side's bytes are not blank plus text."""
        none = np.zeros(0, np.int64)
        out_a, out_b = [], []
        for text, pieces in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            ids_a, ids_b, want = self.ids_a(text) if text else none, np.array(pieces, np.int64), b" " + text.encode()
            same = bool(text) and all(side.sizes[ids].sum() == len(want) and side.joined(ids).tobytes() == want
                                      for side, ids in ((self.a, ids_a), (self.b, ids_b)))
            out_a.append(ids_a if same else none)
            out_b.append(ids_b if same else none)
        return out_a, out_b


@lru_cache(maxsize=2)
def encoders(path_a: str, path_b: str) -> Encoders:
    return Encoders(path_a, path_b)


@dataclass
class Aligned:
    """Texts aligned together: one entry a text, and their links (pair << 32 | text) with a number each."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    links: Iterator[tuple[np.ndarray, np.ndarray]]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(list(map(len, lists)), out=ends[1:])
    return np.concatenate([np.zeros(0, np.int64), *lists]), ends


def align_texts(texts: list[str], own: Encoders) -> Aligned:
    (ids_a, upto_a), (ids_b, upto_b) = map(_flat, own.encode(texts))
    end_a, end_b = np.cumsum(own.a.sizes[ids_a]), np.cumsum(own.b.sizes[ids_b])   # texts end at the same bytes on both sides
    marks = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)
    marks[end_a] = 1
    marks[end_b] += 2
    cut_a, cut_b = marks[end_a] == 3, marks[end_b] == 3
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    groups = int(cut_a.sum())
    p, q = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    after_a, after_b = np.cumsum(p), np.cumsum(q)
    groups_upto = np.concatenate([[0], np.cumsum(cut_a)])[upto_a]
    links_upto = np.concatenate([[0], np.cumsum(p * q)])
    # groups as text: the A ids of a group, then its B ids
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + (after_b - q)[group_a]] = ids_a + cut_a * len(own.a.sizes)
    codes[np.arange(len(ids_b)) + after_a[group_b]] = ids_b + cut_b * len(own.b.sizes) + 2 * len(own.a.sizes)
    both = (upto_a + upto_b).tolist()
    digests = [hashlib.sha256(b"".join(own.written[codes[i:j]].tolist())[:-1]).hexdigest() if j > i else ""
               for i, j in zip(both, both[1:], strict=False)]

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text_of = np.repeat(np.arange(len(texts)), np.diff(groups_upto)).astype(np.uint64)   # of each group
        dense = p * q > DENSE
        work = np.concatenate([[0], np.cumsum(np.where(dense, 0, p * q))])
        start = 0
        while start < groups:
            stop = max(start + 1, int(np.searchsorted(work, work[start] + EXPANDED, side="right")) - 1)
            i, j = int(after_a[start] - p[start]), int(after_a[stop - 1])
            of = group_a[i:j]
            times = np.where(dense[of], 0, q[of])
            upto = np.cumsum(times)
            total = int(upto[-1])
            other = np.arange(total) + np.repeat((after_b - q)[of] - upto + times, times)
            pair = np.repeat(ids_a[i:j] << own.bits_b, times) | ids_b[other]
            yield (pair.astype(np.uint64) << np.uint64(32)) | np.repeat(text_of[of], times), np.ones(total, np.int64)
            start = stop
        for g in np.flatnonzero(dense):   # a long stretch without a common end: by distinct ids
            some_a, n_a = np.unique(ids_a[after_a[g] - p[g]:after_a[g]], return_counts=True)
            some_b, n_b = np.unique(ids_b[after_b[g] - q[g]:after_b[g]], return_counts=True)
            step = max(1, EXPANDED // len(some_b))
            for at in range(0, len(some_a), step):
                pair = (some_a[at:at + step, None] << own.bits_b | some_b).ravel()
                yield (pair.astype(np.uint64) << np.uint64(32)) | text_of[g], (n_a[at:at + step, None] * n_b).ravel()

    return Aligned(np.diff(upto_a), np.diff(upto_b), np.diff(groups_upto),
                   np.diff(links_upto[groups_upto]), digests, links())


# -- frames ------------------------------------------------------------------------------------

def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, their bytes in planes, as one zstd frame."""
    planes = [struct.pack("<I", len(columns[0]))]
    for c in columns:
        planes.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes())
    return zstandard.compress(b"".join(planes), 1)


def _unpacked(frame: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.decompress(frame)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def _steps(pairs: np.ndarray) -> np.ndarray:
    return np.diff(pairs.astype(np.int64), prepend=0).astype(np.uint32)


def _pairs(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.int64))


def _radix(ids_a: np.ndarray) -> np.ndarray:
    return (ids_a * 0x9E3779B1 & 0xFFFFFFFF) * RADIX >> 32


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of each."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


RUNS = ("run long, radix int, frame int, pairs binary, docs binary, place int, doc_id long, "
        "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")


class _Spill:
    """Records gathered until they make a run."""

    def __init__(self, bits_b: int):
        self.bits_b, self.number = bits_b, TaskContext.get().partitionId() << 32
        self._new()

    def _new(self) -> None:
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = self.docs = 0

    def add(self, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
        for keys, times in links:
            keys, times = _summed(keys + np.uint64(self.docs), times)
            self.keys.append(keys)
            self.times.append(times)
            self.size += len(keys)

    def run(self) -> Iterator[dict]:
        keys, times = _summed(np.concatenate([_NO, *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.times]))
        pair, doc = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        radix = _radix(pair >> self.bits_b)
        order = np.argsort(radix.astype(np.uint16), kind="stable")
        pair, doc, times = pair[order], doc[order], times[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(radix, minlength=RADIX))])
        for r in range(RADIX):
            for n, at in enumerate(range(ends[r], ends[r + 1], FRAME)):
                upto = min(at + FRAME, ends[r + 1])
                some, counts = np.unique(pair[at:upto], return_counts=True)
                yield {"run": self.number, "radix": r, "frame": n, "pairs": _packed(_steps(some), counts.astype(np.uint64)),
                       "docs": _packed(doc[at:upto], times[at:upto].astype(np.uint64))}
        self.number += 1
        self._new()


_RUNS = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("frame", pa.int32()), ("pairs", pa.binary()),
                   ("docs", pa.binary()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                   ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def _spilled(docs: DataFrame, path_a: str, path_b: str, most_links: int) -> DataFrame:
    """Rows of documents (``radix`` null) and of frames."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoders(path_a, path_b)
        spill = _Spill(own.bits_b)
        for batch in batches:
            for at, upto in stretches(byte_sizes(batch.column("text")), SLICE):
                part = batch.slice(at, upto - at)
                done = align_texts([t or "" for t in part.column("text").to_pylist()], own)
                n = part.num_rows
                if spill.docs > 0 and (spill.size + int(done.n_links.sum()) > most_links or spill.docs + n > MOST_DOCS):
                    for row in spill.run():
                        yield pa.RecordBatch.from_pylist([row], _RUNS)
                none = [pa.nulls(n, f.type) for f in list(_RUNS)[1:5]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, spill.number)), *none, pa.array(np.arange(spill.docs, spill.docs + n), pa.int32()),
                     part.column("doc_id"), *[pa.array(c, pa.int64()) for c in (done.n_a, done.n_b, done.n_groups, done.n_links)],
                     pa.array(done.digests, pa.string())], schema=_RUNS)
                spill.add(done.links)
                spill.docs += n
        for row in spill.run():
            yield pa.RecordBatch.from_pylist([row], _RUNS)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, RUNS)


# -- merge -------------------------------------------------------------------------------------

class _Reader:
    """The frames of one run, one unpacked at a time."""

    def __init__(self, frames: list[bytes]):
        self.frames = iter(frames)

    def load(self) -> bool:
        frame = next(self.frames, None)
        if frame is None:
            return False
        steps, self.counts = _unpacked(frame, np.uint32, np.uint64)
        self.pairs = _pairs(steps)
        return True

    def upto(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        n = int(np.searchsorted(self.pairs, limit, side="right"))
        out = self.pairs[:n], self.counts[:n]
        self.pairs, self.counts = self.pairs[n:], self.counts[n:]
        return out


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order, each once, with the sum of its counts over all runs."""
    readers = [r for r in map(_Reader, runs) if r.load()]
    heap = [(int(r.pairs[-1]), n) for n, r in enumerate(readers)]
    heapq.heapify(heap)
    while heap:
        limit = heap[0][0]
        got = [readers[n].upto(limit) for _, n in heap]
        yield _summed(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        read = []   # all of these frames
        while heap and heap[0][0] == limit:
            read.append(heapq.heappop(heap)[1])
        for n in read:
            if readers[n].load():   # the next frame may begin with the pair that ended this one
                heapq.heappush(heap, (int(readers[n].pairs[-1]), n))


def _in_frames(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in pieces of at least a frame, but for the last; a pair that two parts share is added up."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        if held and len(part[0]) and len(held[-1][0]) and held[-1][0][-1] == part[0][0]:
            part[1][0] += held[-1][1][-1]
            held[-1] = tuple(c[:-1] for c in held[-1])
            size -= 1
        held.append(part)
        size += len(part[0])
        if size >= FRAME + 1:   # the last row stays, as the next part may go on with its pair
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield tuple(c[:-1] for c in whole)
            held, size = [tuple(c[-1:] for c in whole)], 1
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _by_side(parts: Iterator[tuple[np.ndarray, np.ndarray]], bits_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole A ids at a time, with a mark at the pairs of each A id's highest count."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def marked() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, counts = (np.concatenate(c) for c in zip(*held, strict=True))
        side = pairs >> bits_b
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side))))
        return pairs, counts, (counts == most).astype(np.uint8)

    for pairs, counts in parts:
        last = int(np.searchsorted(pairs >> bits_b, pairs[-1] >> bits_b))   # the last A id may go on
        if last or (held and held[-1][0][-1] >> bits_b != pairs[0] >> bits_b):
            held.append((pairs[:last], counts[:last]))
            yield marked()
            held = []
        held.append((pairs[last:], counts[last:]))
    if held:
        yield marked()


COUNTS = "radix int, chunk long, run long, frame int, pairs binary"
_COUNTS = pa.schema([("radix", pa.int32()), ("chunk", pa.int64()), ("run", pa.int64()), ("frame", pa.int32()), ("pairs", pa.binary())])


def _frames_by_run(table: pa.Table, *columns: str) -> dict[int, list[tuple]]:
    """The frames of each run in order."""
    out: dict[int, list[tuple]] = {}
    rows = zip(table["run"].to_pylist(), table["frame"].to_pylist(), *[table[c] for c in columns], strict=True)
    for run, _, *values in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(run, []).append(tuple(v.as_py() for v in values))
    return out


def _merge(frames: DataFrame, bits_b: int, last: bool) -> DataFrame:
    """One run for each (radix, chunk) of ``frames``; the last merge marks each A id's highest counts."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        radix, chunk = (k.as_py() for k in key)
        runs = [[f for f, in own] for own in _frames_by_run(table, "pairs").values()]
        parts = _in_frames(merged(runs))
        if last:
            packed = [_packed(_steps(p), c, best) for p, c, best in _by_side(parts, bits_b)]
        else:
            packed = [_packed(_steps(p), c) for p, c in parts]
        return pa.Table.from_pylist([{"radix": radix, "chunk": 0, "run": chunk, "frame": n, "pairs": f}
                                     for n, f in enumerate(packed)], _COUNTS)

    return frames.groupBy("radix", "chunk").applyInArrow(run, COUNTS)


def _sums(records: DataFrame, counts: DataFrame) -> DataFrame:
    """For each run and radix: what its documents get, as one row of two arrays."""
    schema = pa.schema([("run", pa.int64()), ("place", pa.int32()), ("sums", pa.binary())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = [_unpacked(f, np.uint32, np.uint64, np.uint8) for own in _frames_by_run(right, "pairs").values() for f, in own]
        pairs = np.concatenate([np.zeros(0, np.int64), *[_pairs(k[0]) for k in known]])
        totals = np.concatenate([_NO, *[k[1] for k in known]]).astype(np.int64)
        best = np.concatenate([np.zeros(0, np.uint8), *[k[2] for k in known]])
        out = []
        for number, frames in _frames_by_run(left, "pairs", "docs").items():
            docs = np.zeros((2, MOST_DOCS), np.int64)
            most = 0
            for held, of in frames:
                steps, counts = _unpacked(held, np.uint32, np.uint64)
                doc, times = _unpacked(of, np.uint32, np.uint64)
                at = np.repeat(np.searchsorted(pairs, _pairs(steps)), counts.astype(np.int64))
                times = times.astype(np.int64)
                np.add.at(docs[0], doc, times * best[at])
                np.add.at(docs[1], doc, times * totals[at])
                most = max(most, int(doc.max()) + 1)
            out.append({"run": number, "place": -1, "sums": _packed(docs[0, :most], docs[1, :most])})
        return pa.Table.from_pylist(out, schema)

    return (records.groupBy("radix", "chunk").cogroup(counts.groupBy("radix", "chunk"))
            .applyInArrow(run, "run long, place int, sums binary"))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums, then of documents, run by run."""
    now, sums = None, np.zeros((2, MOST_DOCS), np.int64)
    for batch in batches:
        places = batch.column("place").to_numpy()
        best, total = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        runs = batch.column("run").to_numpy()
        cuts = np.flatnonzero(np.diff(runs, prepend=runs[:1] - 1)).tolist() if len(runs) else []
        for i, j in zip(cuts, [*cuts[1:], len(runs)], strict=True):
            if runs[i] != now:
                now = runs[i]
                sums[:] = 0
            first = i + int((places[i:j] < 0).sum())
            for frame in batch.column("sums").slice(i, first - i).to_pylist():
                some = _unpacked(frame, np.int64, np.int64)
                sums[0, :len(some[0])] += some[0]
                sums[1, :len(some[1])] += some[1]
            best[first:j], total[first:j] = sums[0, places[first:j]], sums[1, places[first:j]]
        batch = batch.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))
        yield batch.select([c.split()[0] for c in _OUT.split(", ")]).filter(pa.array(places >= 0))


@dataclass
class Alignment:
    """``documents`` (one row each) and ``pairs`` (``a_id, b_id, n_docs, best``: one row for each linked id pair)."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str, most_links: int = LINKS, fan_in: int = FAN_IN) -> Alignment:
    """Align the texts of ``docs(doc_id, text)`` under a byte-level BPE file and a SentencePiece model."""
    spark = docs.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "align")
    bits_b = encoders(path_a, path_b).bits_b
    spilled = scratch.write(_spilled(docs, path_a, path_b, most_links), "runs")
    frames = spilled.where("radix is not null").select("run", "radix", "frame", "pairs", "docs")
    runs = frames.select("run").distinct().count()
    chunks = max(1, math.ceil(runs / fan_in))
    chunk = lambda n: F.pmod(F.xxhash64("run"), F.lit(n)).cast("long").alias("chunk")
    counts, n, level = frames.select("radix", chunk(chunks), "run", "frame", "pairs"), chunks, 0
    while n > 1:
        counts = scratch.write(_merge(counts, bits_b, False), f"counts-{level}")
        n, level = math.ceil(n / fan_in), level + 1
        counts = counts.select("radix", (F.col("run") % n).alias("chunk"), "run", "frame", "pairs")
    counts = scratch.write(_merge(counts, bits_b, True), "counts")
    # a chunk's runs are what one task holds; the counts of its radix go to each chunk
    to_chunks = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    sums = _sums(frames.select("radix", chunk(chunks), "run", "frame", "pairs", "docs"), to_chunks)
    rows = spilled.where("radix is null").select("run", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    added = (rows.unionByName(sums, allowMissingColumns=True).repartition("run")
             .sortWithinPartitions("run", "place"))
    return Alignment(arrow_map(added, _added, _OUT), _pair_rows(counts, bits_b))


def _pair_rows(counts: DataFrame, bits_b: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame in batch.column("pairs"):
                steps, totals, best = _unpacked(frame.as_py(), np.uint32, np.uint64, np.uint8)
                pairs = _pairs(steps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs >> bits_b, pa.int32()), pa.array(pairs & (1 << bits_b) - 1, pa.int32()),
                     pa.array(totals.astype(np.int64)), pa.array(best.astype(bool))], ["a_id", "b_id", "n_docs", "best"])

    return arrow_map(counts.select("pairs"), run, "a_id int, b_id int, n_docs long, best boolean")


def alignment_report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The columns of query ``op12_token_align``."""
    return align(docs, path_a, path_b).documents
