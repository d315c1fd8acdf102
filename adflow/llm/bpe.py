"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a prefix, followed one byte further, ends in one *last token*;
what stands before that token is the encoding of a shorter prefix.  So a word's
encoding follows from the last token at each of its prefixes, and words that
share a prefix share those states.  Distinct words are put into a trie
(compressed: sorted words, each with the length it shares with the one before,
which is the trie's preorder) and traversed depth first; the states of the path
from the root are kept, so a shared prefix is worked out once.

The last token at a prefix is the one token ending there whose seam with the
last token of what remains is *stable*: undoing merges from the latest on, no
earlier merge joins the two sides.  Seams are memoised.

Encoding runs in the tasks that scan the table, with no shuffle.  A task holds
one Arrow batch (bounded by Spark in bytes), the vocabulary, and a cache of
encoded words of bounded size; texts are handled whole, in slices cut where the
pre-tokeniser cuts anyway.

Defined results: null texts count as empty and have no ids; special tokens of
the file that occur in a text are encoded as such; null ids decode to the empty
text; byte sequences that are not UTF-8 decode to U+FFFD; all input columns are
kept, but one named as the output column is replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adflow.llm.base import arrow_map

# The pattern by which byte-level BPE splits a text before the merges.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A word starts at every blank before a non-blank, whatever stands before it.
CUT = regex.compile(r" (?=\S)")
UNSURE = regex.compile(r" (?:\s|\Z)")
SLICE = 1 << 20        # characters of text that are split into words at a time
CACHED = 200_000       # encoded words that a worker keeps of late, and as many from before
MEMO = 1_000_000       # seams, and steps of the automaton, that a worker keeps
BATCH = 1024           # rows that are decoded at a time
LOOKED_UP = 2048       # rows whose equal pieces are looked up once
GATHERED = 1 << 16     # pieces whose ids are gathered at a time
LEARNT = 50_000        # new words that are put into one trie
MARKS = frozenset(punctuation)   # of ASCII
LATIN = "ɏ"       # beyond, Unicode versions differ and the library's pre-tokeniser splits


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gathered(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the elements of runs ``codes`` (each of ``sizes`` from ``starts`` on) lie, and where each run ends up."""
    size = sizes[codes]
    upto = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(size, out=upto[1:])
    return np.arange(upto[-1]) + np.repeat(starts[codes] - upto[:-1], size), upto


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = byte_characters()
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.path = path
        self.ids = {raw(token): i for token, i in file["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.longest = max(map(len, self.ids))
        self.rank = [-1] * size
        self.parts = [(i, i) for i in range(size)]
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            pair = self.ids[raw(a)], self.ids[raw(b)]
            whole = self.ids[raw(a) + raw(b)]
            self.merge[pair] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = rank, pair
        self.special_pattern = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.sizes = list(map(len, self.bytes))
        self.id_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.seams: dict[int, bool] = {}
        self.step: dict[int, int] = {}   # state * 256 + byte -> state; made when first used
        self.first: dict[str, bytes] = {}   # words at the start of a slice -> ids as int32 bytes
        self.after: dict[str, bytes] = {}   # words after one blank, without it -> the same
        self.before: dict[str, bytes] = {}  # what ``after`` held when it was full
        self.words: dict[str, bytes] = {}   # words of pieces of several -> the same
        self._library = None
        self.flat: np.ndarray | None = None

    # -- seams ---------------------------------------------------------------------------------

    def stable(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether the merges (of a rank under ``before``) leave tokens ``a`` and ``b`` side by side."""
        rank, parts = self.rank, self.parts
        if before is None:
            before = len(self.merge)
        while True:
            joint = self.merge.get((a, b))
            if joint is not None and joint < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:       # the left one was made last: a tie goes to it, being further left
                before, a = rank[a], parts[a][1]
            else:
                before, b = rank[b] + 1, parts[b][0]

    def _automaton(self) -> None:
        """Which token that the merges can make is the longest to end at each state, and at each byte after it."""
        made: dict[int, bool] = {i: True for i in self.ids.values() if self.rank[i] < 0}
        for (a, b), rank in self.merge.items():   # in order of rank: the parts come first
            whole = self.ids[self.bytes[a] + self.bytes[b]]
            if self.parts[whole] == (a, b):
                made[whole] = made.get(a, False) and made.get(b, False) and self.stable(a, b, rank)
        self.ending: list[int] = [-1]             # state -> the longest token that ends there
        for token, i in self.ids.items():
            state = 0
            for byte in token:
                state = self.step.setdefault(state << 8 | byte, len(self.ending))
                if state == len(self.ending):
                    self.ending.append(-1)
            if made.get(i):
                self.ending[state] = i
        self.edges = dict(self.step)
        self.shorter: list[int] = [-1] * len(self.bytes)   # token -> the longest token that is a proper suffix of it
        self.back = [0] * len(self.ending)                 # state -> the state of its longest proper suffix
        order, depth = [], [(k, t) for k, t in self.edges.items()]
        below: dict[int, list[tuple[int, int]]] = {}
        for k, t in depth:
            below.setdefault(k >> 8, []).append((k & 255, t))
        level = [0]
        while level:
            order = [(s, byte, t) for s in level for byte, t in below.get(s, ())]
            for s, byte, t in order:
                self.back[t] = self.next_state(self.back[s], byte) if s else 0
                suffix = self.ending[self.back[t]]
                if self.ending[t] < 0:
                    self.ending[t] = suffix
                else:
                    self.shorter[self.ending[t]] = suffix
            level = [t for _, _, t in order]

    def next_state(self, state: int, byte: int) -> int:
        found = self.edges.get(state << 8 | byte)
        while found is None and state:
            state = self.back[state]
            found = self.edges.get(state << 8 | byte)
        return found or 0

    # -- trie ----------------------------------------------------------------------------------

    def forget(self) -> None:
        """Give back what only the texts of one task need: the worker process outlives it."""
        for cache in (self.first, self.after, self.before, self.words, self.seams):
            cache.clear()

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct words, as int32."""
        if not self.step:
            self._automaton()
        step, ending, shorter, seams = self.step, self.ending, self.shorter, self.seams
        size, bytes_of = self.sizes, self.id_bytes
        out: dict[str, bytes] = {}
        trie = sorted([(w.encode(), w) for w in words])
        depth = 1 + max((len(w) for w, _ in trie), default=0)
        last, states = [-1] * depth, [0] * depth   # last token and automaton state at each depth of the path
        before = b""
        for word, name in trie:
            shared = 0
            for a, b in zip(word, before):  # noqa: B905  the shorter one ends it
                if a != b:
                    break
                shared += 1
            state, end = states[shared], shared
            for byte in word[shared:]:
                end += 1
                key = state << 8 | byte
                try:
                    state = step[key]
                except KeyError:
                    state = step[key] = self.next_state(state, byte)
                token = ending[state]
                start = end - size[token]
                while start:
                    seam = last[start] << 20 | token
                    try:
                        fits = seams[seam]
                    except KeyError:
                        fits = seams[seam] = self.stable(last[start], token)
                    if fits:
                        break
                    token = shorter[token]
                    start = end - size[token]
                last[end] = token
                states[end] = state
            before = word
            token = last[end]
            ids = bytes_of[token]
            end -= size[token]
            while end:
                token = last[end]
                ids = bytes_of[token] + ids
                end -= size[token]
            out[name] = ids
        if len(seams) > MEMO:
            seams.clear()
        if len(step) - len(self.edges) > MEMO:
            self.step = dict(self.edges)
        return out

    # -- texts ---------------------------------------------------------------------------------

    def split_words(self, piece: str) -> list[str]:
        if piece.isascii() or max(piece) <= LATIN:
            return PATTERN.findall(piece)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel
            self._library = ByteLevel(add_prefix_space=False)
        return [piece[a:b] for _, (a, b) in self._library.pre_tokenize_str(piece)]

    def _slices(self, text: str) -> Iterator[list[str] | bytes]:
        """The words of a text, slice by slice; special tokens as their ids.  A word after the first lacks its blank."""
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield np.int32(self.special[part]).tobytes()
                continue
            start = 0
            while start >= 0:
                cut = CUT.search(part, start + SLICE) if len(part) - start > SLICE else None
                piece = part[start:cut.start()] if cut else part[start:]
                # blanks in a row: cut only before a non-blank
                yield CUT.split(piece) if UNSURE.search(piece) else piece.split(" ")
                start = cut.start() if cut else -1

    def _learn(self, pieces: set[str], cache: dict[str, bytes], blank: str) -> None:
        """Fill ``cache`` with the ids of ``pieces`` behind ``blank``; words that are known from other pieces stay as they are."""
        whole, marked, split = [], [], []
        for p in pieces:
            if p.isalpha():
                latin = p.isascii() or max(p) <= LATIN
                (whole if latin else split).append(p)
            elif p[-1:] in MARKS and p[:-1].isalpha() and (p.isascii() or max(p) <= LATIN):
                marked.append(p)      # letters and one mark: two words
            else:
                split.append(p)
        parts = [(p, self.split_words(blank + p)) for p in split]
        after, before, words = self.after, self.before, self.words
        known: dict[str, bytes] = {}
        new: set[str] = set()
        for w in {w for _, ws in parts for w in ws}.union([blank + p[:-1] for p in marked], [p[-1] for p in marked]):
            ids = words.get(w)
            if ids is None and w[0] == " " and w[1:].isalpha():
                ids = after.get(w[1:]) or before.get(w[1:])
            if ids is None:
                new.add(w)
            else:
                known[w] = ids
        fresh = []
        for p in whole:
            w = blank + p
            ids = known.get(w) or words.get(w)
            if ids is None:
                fresh.append((p, w))
            else:
                cache[p] = ids
        learnt = self.encode_words(new.union([w for _, w in fresh]))
        for p, w in fresh:
            cache[p] = learnt[w]
        for w in new:
            known[w] = words[w] = learnt[w]
        for p in marked:
            cache[p] = known[blank + p[:-1]] + known[p[-1]]
        for p, ws in parts:
            cache[p] = b"".join([known[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32; the new words of many texts share a trie."""
        out: list[bytes] = []
        pending: list[list[list[str] | bytes]] = []
        first: set[str] = set()
        after: set[str] = set()
        for n, text in enumerate(texts, 1):
            slices: list[list[str] | bytes] = []
            for words in self._slices(text):
                if not isinstance(words, bytes):
                    first.add(words[0])
                    after.update(words[1:] if len(words) < 3 else set(words[1:]).difference(self.after))
                slices.append(words)
            pending.append(slices)
            if n == len(texts) or len(first) + len(after) >= LEARNT:
                self._learn(first.difference(self.first), self.first, "")
                after.difference_update(self.after)
                for word in after.intersection(self.before):
                    self.after[word] = self.before[word]
                self._learn(after.difference(self.after), self.after, " ")
                for slices in pending:
                    out.append(b"".join([words if isinstance(words, bytes) else
                                         self.first[words[0]] + b"".join(map(self.after.__getitem__, words[1:]))
                                         for words in slices]))
                pending, first, after = [], set(), set()
                self._drop()
        return out

    def _drop(self) -> None:
        if len(self.first) > CACHED:
            self.first.clear()
        if len(self.words) > CACHED // 2:
            self.words.clear()
        if len(self.after) > CACHED:
            self.before, self.after = self.after, {}

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, null as empty.  Equal pieces of a batch are looked up once and their ids gathered;
        texts with special tokens, blanks in a row or more than a slice go through :meth:`encode_batch`."""
        texts = pc.fill_null(texts, "")
        other = np.zeros(len(texts), bool)
        for token in self.special:
            other |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        names = texts.to_pylist()
        other |= np.fromiter((len(t) > SLICE or UNSURE.search(t) is not None for t in names), bool, len(names))
        odd = np.flatnonzero(other)
        if len(odd):
            rest = self.encode_batch([names[i] for i in odd])
            texts = pc.if_else(pa.array(other), "", texts)
        pieces = pc.split_pattern(texts, " ")
        ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        known, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        self.after.update([(p, self.before[p]) for p in known if p not in self.after and p in self.before])
        self._learn({p for p in known if p not in self.after}, self.after, " ")
        ids = list(map(self.after.__getitem__, known))
        first = ["" if o else t.partition(" ")[0] for t, o in zip(names, other.tolist(), strict=True)]
        self._learn(set(first).difference(self.first), self.first, "")
        codes[ends[:-1]] = len(ids) + np.arange(len(first))   # the first piece of a text has no blank before it
        ids += map(self.first.__getitem__, first)
        if len(odd):
            for i, held in zip(odd.tolist(), rest, strict=True):
                ids[len(known) + i] = held
        self._drop()
        flat = np.frombuffer(b"".join(ids), dtype=np.int32)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        upto = np.concatenate([[0], np.cumsum(sizes[codes])])[ends]
        some = range(0, len(codes), GATHERED)
        values = np.concatenate([flat[:0], *[flat[gathered(starts, sizes, codes[at:at + GATHERED])[0]] for at in some]])
        return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values, pa.int32()))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of the ids between each two of ``ends``: one gather of the tokens' bytes."""
        if self.flat is None:
            self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
            self.lengths = np.array(self.sizes, dtype=np.int64)
            self.starts = np.cumsum(self.lengths) - self.lengths
        place, upto = gathered(self.starts, self.lengths, ids)
        cuts = upto[ends]
        texts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(cuts), pa.py_buffer(self.flat[place]))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:   # some ids end inside a character
            texts = pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return texts.cast(pa.string())


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _some_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def _replaced(batch: pa.RecordBatch, keep: list[str], name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], column], [*keep, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    keep = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    return [f.name for f in keep], T.StructType([*keep, T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col array<int>``: the ids of ``text_col`` under the vocabulary file ``path``."""
    keep, schema = _schema(df, ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        try:
            for batch in _some_rows(batches, LOOKED_UP):
                yield _replaced(batch, keep, ids_col, own.encode_array(batch.column(text_col)))
        finally:
            own.forget()

    return arrow_map(df, run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of the ids in ``ids_col``, special tokens included."""
    keep, schema = _schema(df, text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in _some_rows(batches, BATCH):
            lists = batch.column(ids_col)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            yield _replaced(batch, keep, text_col, own.decode_batch(lists.flatten().to_numpy(), ends))

    return arrow_map(df, run, schema)


def roundtrip_report(docs: DataFrame, path: str) -> DataFrame:
    """The columns of query ``op1_bpe``: count and digest of the ids, digest of the decoded text."""
    done = decode(encode(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
