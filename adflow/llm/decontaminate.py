"""Benchmark decontamination with a generalised suffix automaton of the items.

Items and documents become sequences of normalised words (A-Z lower-cased; a word
is a run of digits, a-z and characters beyond ASCII).  A *window* is ten words
of an item in a row; an item of fewer words is one window as a whole.  The
automaton holds every factor of every item in at most two states a word; streaming
a document's words through it gives, at each word, the longest match that ends
there.  Where that match reaches the window's length, the windows that end there,
and the items that hold them, hang on one state: the one of the match's last ten
words.  The hit words of a document are the union of such windows.

The automaton is entered only in *runs*: stretches of words of which every two
neighbours stand side by side in some item (a table of bits of bounded size tells
most of the others; the automaton decides).  Documents are read once, with no
shuffle.  Items are dealt into blocks of bounded size by hash, an item of very
many words into stretches that overlap by a window less one word; a task builds
one block's automaton from its words.  A benchmark of several blocks has the runs
written once, and each block walks them.

Broadcast: the bits (at most 2**``MOST_BITS`` bytes) and one block's words (about
``BLOCK`` of eight bytes at a time).  Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words; rows of one item id are one
item; an item without id hits words but is not counted or named; each of repeated
documents gets its row; an empty benchmark hits nothing; an empty table gives an
empty table; further columns are kept, but one named as an output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adflow.llm.base import UPPER, Scratch, arrow_map, ship_code
from adflow.llm.words import byte_sizes, stretches, word_hashes

WINDOW = 10          # words
BLOCK = 1 << 17      # words of items in one automaton
STRETCH = 1 << 12    # words of an item that go into one block together
MOST_BITS = 25       # the tables of words and pairs have at most 2**MOST_BITS entries of a byte
COVERAGE = 0.5       # documents of a larger share of hit words go

#: Digits, letters and every byte beyond ASCII make words.
WORD = np.zeros(256, np.uint8)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

_ODD = np.uint64(0xD6E8FEB86659FD93)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RUNS = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("words", T.BinaryType())]))


class Automaton:
    """The factors of many word sequences, and which windows and items end at each state."""

    def __init__(self, sequences: Iterable[tuple[list[int], int]], window: int):
        """``sequences``: words, and the number of the item that they are of."""
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = list(sequences)
        for words, _ in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: state of a match -> the state of its last ``window`` words (0: it is shorter)
        self.whole = [0] * len(self.length)
        for s in by_length:
            if self.length[s] >= window:
                self.whole[s] = self.whole[self.link[s]] or s
        self.items: dict[int, set[int]] = {}
        shorter: dict[int, dict[int, set[int]]] = {}   # state -> length -> items of so few words that end there
        for words, item in sequences:
            state = 0
            for word in words:
                state = self.next[state][word]
                if self.whole[state]:
                    self.items.setdefault(self.whole[state], set()).add(item)
            if 0 < len(words) < window:
                shorter.setdefault(state, {}).setdefault(len(words), set()).add(item)
        #: state -> the nearest state, itself or along the links, at which a short item ends (0: none)
        self.marked = [0] * len(self.length)
        self.shorter = shorter
        for s in by_length:
            self.marked[s] = s if s in shorter else self.marked[max(self.link[s], 0)]

    def _extend(self, last: int, word: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        known = nexts[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, word)
        new = len(length)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = new
            at = link[at]
        if at >= 0:
            to = nexts[at][word]
            link[new] = to if length[to] == length[at] + 1 else self._split(at, to, word)
        return new

    def _split(self, at: int, to: int, word: int) -> int:
        """A state of its own for the factors of ``to`` that are one word longer than those of ``at``."""
        nexts, link, length = self.next, self.link, self.length
        copy = len(length)
        nexts.append(dict(nexts[to]))
        length.append(length[at] + 1)
        link.append(link[to])
        link[to] = copy
        while at >= 0 and nexts[at].get(word) == to:
            nexts[at][word] = copy
            at = link[at]
        return copy

    def hits(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """Start, end (exclusive) and items of every window that occurs in ``words``."""
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for end, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                yield end - window, end, self.items[self.whole[state]]
            mark = self.marked[state]
            while mark:
                for size, items in self.shorter[mark].items():
                    if mark != state or matched >= size:
                        yield end - size, end, items
                mark = self.marked[max(link[mark], 0)]


class Bits:
    """Which words, and which two words in a row, may occur in the items."""

    def __init__(self, words: int):
        self.shift = np.uint64(64 - min(MOST_BITS, max(12, math.ceil(math.log2(16 * max(words, 1))))))
        self.words = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.pairs = np.zeros_like(self.words)
        self.least = WINDOW

    def add(self, words: np.ndarray, window: int) -> None:
        self.words[words >> self.shift] = True
        self.pairs[self._pair(words)] = True
        self.least = min(self.least, window, len(words))

    def _pair(self, words: np.ndarray) -> np.ndarray:
        return (words[:-1] * _ODD + words[1:]) * _ODD >> self.shift

    def runs(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of words, none across the end of a text."""
        if self.least == 1:
            live = self.words[words >> self.shift]
            live = np.concatenate([live, [False]])
            cuts = ends[1:-1]
            inner = cuts[(cuts > 0) & (cuts < len(words))]
        else:
            live = np.zeros(len(words) + 1, bool)
            if len(words) > 1:
                live[:len(words) - 1] = self.pairs[self._pair(words)]
            cuts = ends[1:-1]
            live[cuts[cuts > 0] - 1] = False
            inner = np.zeros(0, np.int64)
        edge = np.diff(np.concatenate([[False], live]).astype(np.int8))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if self.least == 1:
            both = inner[live[inner] & live[inner - 1]]   # a text that ends inside a run cuts it
            return np.sort(np.concatenate([start, both])), np.sort(np.concatenate([stop, both]))
        stop = stop + 1   # a run of pairs holds one word more
        long = stop - start >= self.least
        return start[long], stop[long]


def item_stretches(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, words``: the words of each item as hashes, long items in overlapping stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item").to_pylist()
            for a, b in stretches(byte_sizes(batch.column("text"))):
                words, _, ends = word_hashes(batch.column("text").slice(a, b - a), WORD)
                out: list[tuple] = []
                for t in range(b - a):
                    own = words[ends[t]:ends[t + 1]]
                    for at in range(0, max(len(own) - window + 1, min(len(own), 1)), STRETCH):
                        out.append((ids[a + t], own[at:at + STRETCH + window - 1].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()),
                                                  pa.array([o[1] for o in out], pa.binary())], ["item", "words"])
    picked = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(picked, run, "item long, words binary").distinct()


@lru_cache(maxsize=1)
def _automaton(broadcast_id: int, window: int, shared: "_Block") -> tuple[Automaton, list[int | None]]:
    rows = shared.words.value
    numbers: dict[int | None, int] = {}
    sequences = [(np.frombuffer(w, np.uint64).tolist(), numbers.setdefault(i, len(numbers))) for i, w in rows]
    return Automaton(sequences, window), list(numbers)


class _Block:
    """One block's words as a broadcast; equal if it is the same broadcast, so that a worker builds it once."""

    def __init__(self, words: Broadcast):
        self.words, self.number = words, words._jbroadcast.id() if words._jbroadcast is not None else 0

    def __getstate__(self):
        return {"words": self.words, "number": self.number}

    def __hash__(self) -> int:
        return hash(self.number)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Block) and other.number == self.number

    def automaton(self, window: int) -> tuple[Automaton, list[int | None]]:
        return _automaton(self.number, window, self)


def _united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _names(df: DataFrame, *outputs: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in {o.lower() for o in outputs}]


def _struct(df: DataFrame, names: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[df.schema[n] for n in names], *more])


def _find_runs(docs: DataFrame, keep: list[str], text_col: str, bits: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Bits = bits.value
        for batch in batches:
            texts = batch.column(text_col)
            for a, b in stretches(byte_sizes(texts)):
                words, _, ends = word_hashes(texts.slice(a, b - a), WORD)
                start, stop = table.runs(words, ends)
                of = np.searchsorted(ends, start, side="right") - 1
                at = pa.array(start - ends[of], pa.int64())
                found = pa.array([words[i:j].tobytes() for i, j in zip(start.tolist(), stop.tolist(), strict=True)],
                                 pa.binary())
                upto = np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([at, found], ["at", "words"]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in keep], pa.array(np.diff(ends)), runs],
                    [*keep, "n_words", "runs"])

    return arrow_map(docs, run, _struct(docs, keep, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS)))


def _walk(found: DataFrame, keep: list[str], block: _Block, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, ids = block.automaton(window)
        for batch in batches:
            spans_of, items_of = [], []
            for runs in batch.column("runs").to_pylist():
                spans: list[tuple[int, int]] = []
                items: set[int] = set()
                for r in runs:
                    for start, end, held in automaton.hits(np.frombuffer(r["words"], np.uint64).tolist()):
                        start, end = start + r["at"], end + r["at"]
                        if spans and spans[-1][0] <= start <= spans[-1][1]:   # the usual case: one word further
                            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                        else:
                            spans.append((start, end))
                        if not held <= items:
                            items |= held
                spans_of.append([{"start": s, "end": e} for s, e in _united(spans)])
                items_of.append(sorted(ids[i] for i in items if ids[i] is not None))
            kinds = [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(spans_of, kinds[0]), pa.array(items_of, kinds[1])],
                [*keep, "spans", "items"])

    return arrow_map(found, run, _struct(found, keep, T.StructField("spans", SPANS),
                                         T.StructField("items", T.ArrayType(T.LongType()))))


def matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
            item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK,
            keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those of ``keep``) with ``n_words``, ``spans`` (word numbers, end exclusive) and
    ``items`` (ids, ascending)."""
    spark = docs.sparkSession
    ship_code(spark)
    sc = spark.sparkContext
    scratch = Scratch(spark, "decontaminate")
    held = scratch.write(item_stretches(items, item_id_col, item_text_col, window), "items")
    total = held.agg(F.coalesce(F.sum(F.length("words") / 8), F.lit(0)).cast("long")).first()[0]
    blocks = max(1, math.ceil(total / block))
    bits, shared = Bits(total), []
    for n in range(blocks):   # each bounded: hashes deal stretches of at most STRETCH words evenly
        rows = [(r["item"], bytes(r["words"])) for r in
                held.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == n).collect()]
        for _, words in rows:
            bits.add(np.frombuffer(words, np.uint64), window)
        shared.append(_Block(sc.broadcast(rows)))
        del rows
    table = sc.broadcast(bits)
    names = _names(docs, "n_words", "spans", "items") if keep is None else keep
    row = docs.select(F.struct(*names).alias("row"), F.col(text_col).cast("string").alias("words_of"),
                      F.monotonically_increasing_id().alias("uid"))
    if blocks == 1:
        done = _walk(_find_runs(row, ["row"], "words_of", table), ["row", "n_words"], shared[0], window)
        return done.select("row.*", "n_words", "spans", "items")
    found = scratch.write(_find_runs(row, ["row", "uid"], "words_of", table), "runs")
    runs = found.where(F.size("runs") > 0).select("uid", "runs")
    hit = [scratch.write(_walk(runs, ["uid"], b, window).where(F.size("spans") > 0), f"hits-{n}")
           for n, b in enumerate(shared)]
    hits = hit[0]
    for part in hit[1:]:
        hits = hits.unionByName(part)
    # one row per block and document, each no longer than the document
    hits = hits.groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
                                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grown = F.aggregate(
        "all", F.array().cast(SPANS),
        lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
                               F.concat(F.slice(done, 1, F.size(done) - 1),
                                        F.array(F.struct(F.element_at(done, -1)["start"].alias("start"),
                                                         F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    joined = found.select("uid", "row", "n_words").join(hits.select("uid", grown.alias("spans"), "items"), "uid", "left")
    return joined.select("row.*", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
                         F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", most_coverage: float = COVERAGE,
                  **how) -> DataFrame:
    """``docs`` without hit words; a document goes if more than ``most_coverage`` of its words are hit.

    A span goes from its first word up to the next word that stays.
    """
    columns = docs.columns
    row = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = matches(row, items, "text", **how)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = found.where(F.coalesce(F.try_divide(covered, F.col("n_words")), F.lit(0.0)) <= most_coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            spans = batch.column("spans").to_pylist()
            new: list[str | None] = texts.to_pylist()
            for t, cuts in enumerate(spans):
                if not cuts:
                    continue
                _, starts, _ = word_hashes(texts.slice(t, 1), WORD)
                data, at, parts = new[t].encode(), 0, []
                for c in cuts:
                    parts.append(data[at:starts[c["start"]]])
                    at = int(starts[c["end"]]) if c["end"] < len(starts) else len(data)
                new[t] = b"".join([*parts, data[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], ["row", "text"])

    cut = arrow_map(kept.select("row", "text", "spans"), run, _struct(kept, ["row", "text"]))
    return cut.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in columns])


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of query ``op13_decontamination``."""
    found = matches(docs, items, keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT uid, places.n, i, item_id FROM places JOIN windows ON places.n = windows.n AND places.t = windows.t),
hit AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM found) GROUP BY uid),
held AS (SELECT uid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
         FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN held USING (uid)
"""
