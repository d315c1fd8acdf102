"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the multiset of its runs of five words (white space separates,
A-Z are lower-cased); its weights are the counts.  ProbMinHash lets each run
arrive by a Poisson process whose rate is its weight, every arrival at a random
register; a register keeps the run that came first, so two documents agree in a
register with their probability Jaccard similarity.  A run stops arriving once
it is later than every register of its document.

Bands of registers give bucket keys.  In each bucket the least text is the hub,
and every other text is verified against it: as many pairs as bucket entries,
however large the bucket.  Verified links give components.  Where a bucket still
holds several components, texts of different ones could be linked other than
through the hub.  These texts get ``FINE`` registers more; registers (a byte
each) are compared inside the tasks, in blocks of ``BLOCK`` texts, and only
pairs whose registers allow the similarity (within ``SIGMAS`` standard
deviations) are emitted, in the first bucket that they share, and verified.  The
texts of mixed buckets above ``BLOCK`` texts are dealt anew, by ``SPLIT`` bands of
their finer registers; what is still large is compared block by block all the
same.  At similarity 0.8 two texts miss one another with probability about 1e-4,
of which the second deal makes less than 1e-5, whatever the sizes of the buckets.

Copies of a text are one node (by a 128-bit hash of the text), so they are
collapsed before any shuffle of pairs; verification reads the whole texts.

Defined results: a text of fewer than five words is one run of all its words;
null and empty texts have no runs and are classed with their copies only;
``class_id`` is the least id of the class (nulls last); repeated rows each get
their row; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adflow.llm.base import Scratch, arrow_map
from adflow.llm.components import components
from adflow.llm.words import byte_sizes, mix, shingle_hashes, stretches, word_hashes

SIMILARITY = 0.8
BANDS, ROWS = 32, 6
RUNS = 1 << 19    # arrivals drawn at a time
FINE = 768        # registers of the texts that are compared without a hub
SIGMAS = 4.0      # by which the registers may fall short of the similarity
BLOCK = 2048      # texts of a bucket whose registers are compared at a time
SPLIT = 64, 8     # bands and rows, out of the finer registers, for the texts of larger buckets
_STEP = np.uint64(0xD1342543DE82EF95)


def weighted_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs: text number, hash, count; sorted by text and hash."""
    words, _, ends = word_hashes(texts)
    runs, upto = shingle_hashes(words, ends)
    owner = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], runs[at], np.diff(np.append(at, len(runs)))


def prob_minhash(owner: np.ndarray, runs: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """The run that came first at each of ``size`` registers of each text (0: text without runs)."""
    first = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, np.uint64)
    time, nth = np.zeros(len(runs)), np.zeros(len(runs), np.uint64)
    while len(runs):
        ahead = int(max(1, min(64, RUNS // 2 // len(runs))))   # arrivals drawn at a time
        draw = mix(runs[:, None] + (nth[:, None] + np.arange(1, ahead + 1, dtype=np.uint64)) * _STEP)
        gap = -np.log(((draw >> np.uint64(24)).astype(np.float64) + 1) * 2.0 ** -40) / weight[:, None]
        arrival = time[:, None] + np.cumsum(gap, axis=1)
        register = ((draw & np.uint64(0xFFFFFF)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
        place = owner[:, None] * size + register
        early = arrival < first[place]
        t, p = arrival[early], place[early]
        np.minimum.at(first, p, t)
        won = t == first[p]
        winner[p[won]] = np.broadcast_to(runs[:, None], early.shape)[early][won]
        some, back = np.unique(owner, return_inverse=True)
        latest = first.reshape(texts, size)[some].max(axis=1)[back]
        on = arrival[:, -1] < latest
        time, nth = arrival[on, -1], nth[on] + np.uint64(ahead)
        owner, runs, weight = owner[on], runs[on], weight[on]
    return winner.reshape(texts, size)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    odd = (mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1))
    parts = winners.reshape(len(winners), bands, rows) * odd
    return mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """``id, a, b, keys, marks``: the text's 128-bit hash, its bucket keys (none for a text without
    words) and a byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in stretches(byte_sizes(batch.column(3))):
                part = batch.slice(start, stop - start)
                owner, runs, weight = weighted_runs(part.column(3))
                n = stop - start
                first = prob_minhash(owner, runs, weight, n, bands * rows)
                keys, marks = band_keys(first, bands, rows), (first >> np.uint64(56)).astype(np.uint8)
                filled = np.isin(np.arange(n), owner)
                lists = [k if ok else [] for k, ok in zip(keys, filled, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(lists, pa.list_(pa.int64())),
                                                  pa.array([m.tobytes() for m in marks], pa.binary())],
                                                 ["id", "a", "b", "keys", "marks"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("a"),
                        F.xxhash64(F.lit(1), text).alias("b"), text.alias("text"))
    return arrow_map(rows_, run, "id long, a long, b long, keys array<long>, marks binary")


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two weight vectors over the same runs: sum over common i of 1 / sum over j of max(x_j/x_i, y_j/y_i)."""
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio)
    r, xs, ys = ratio[order], np.cumsum(x[order]), np.concatenate([np.cumsum(y[order][::-1])[::-1], [0]])
    upto = np.searchsorted(r, ratio[both], side="right")
    return float((1 / (xs[upto - 1] / x[both] + ys[upto] / y[both])).sum())


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The similarity of each pair of texts."""
    n = len(left)
    sides = [weighted_runs(s) for s in (left, right)]
    owner = np.concatenate([s[0] for s in sides])
    runs = np.concatenate([s[1] for s in sides])
    count = np.concatenate([s[2] for s in sides]).astype(np.float64)
    second = np.repeat([False, True], [len(s[0]) for s in sides])
    order = np.lexsort((runs, owner))
    owner, runs, count, second = owner[order], runs[order], count[order], second[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(n)
    x = np.add.reduceat(np.where(second, 0, count), at)
    y = np.add.reduceat(np.where(second, count, 0), at)
    owner = owner[at]
    common, most = np.minimum(x, y), np.maximum(x, y)
    out = np.bincount(owner, common, n) / np.maximum(np.bincount(owner, most, n), 1)
    # counts that differ on a common run: the ratio of the two documents is not 1 throughout
    uneven = np.unique(owner[(common > 0) & (x != y)])
    ends = np.searchsorted(owner, np.arange(n + 1))
    for p in uneven:
        own = slice(ends[p], ends[p + 1])
        out[p] = probability_jaccard(x[own], y[own])
    return out


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``u, v, similarity`` of ``pairs(u, v)`` with ``texts(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in stretches(byte_sizes(batch.column(2)) + byte_sizes(batch.column(3))):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(similarities(part.column(2), part.column(3)))], ["u", "v", "similarity"])

    rows = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")).hint("merge"), "v")
    rows = rows.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")).hint("merge"), "u")
    return arrow_map(rows.select("u", "v", "tu", "tv"), run, "u long, v long, similarity double")


def finer_marks(texts: DataFrame) -> DataFrame:
    """``node, fine``: a byte of each of ``FINE`` registers of ``texts(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in stretches(byte_sizes(batch.column(1))):
                part = batch.slice(start, stop - start)
                first = prob_minhash(*weighted_runs(part.column(1)), stop - start, FINE)
                marks = (first >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.tobytes() for m in marks], pa.binary())], ["node", "fine"])

    return arrow_map(texts.select("node", "text"), run, "node long, fine binary")


def split_keys(texts: DataFrame) -> DataFrame:
    """``node, keys``: bucket keys from bands of the finer registers of ``texts(node, text)``."""
    bands, rows = SPLIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in stretches(byte_sizes(batch.column(1))):
                part = batch.slice(start, stop - start)
                first = prob_minhash(*weighted_runs(part.column(1)), stop - start, FINE)
                keys = band_keys(first[:, :bands * rows], bands, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "keys"])

    return arrow_map(texts.select("node", "text"), run, "node long, keys array<long>")


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of ``placed(key, band, node, label)`` whose bucket holds several labels, with its size ``n``."""
    mixed = (placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where("lo <> hi").select("key", "n"))
    return placed.join(mixed.hint("merge"), "key").select("key", "band", "node", "label", "n")


def _least(size: int, similarity: float, sigmas: float) -> float:
    """Registers of ``size`` in which two texts of that similarity agree, less so many standard deviations."""
    return size * similarity - sigmas * float(np.sqrt(size * similarity * (1 - similarity)))


def _alike(marks: np.ndarray, fine: np.ndarray, label: np.ndarray, first: np.ndarray, second: np.ndarray,
           similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``first`` x ``second`` (row numbers) of different labels whose registers allow the similarity."""
    rough, close = _least(marks.shape[1], similarity, SIGMAS + 1), _least(fine.shape[1], similarity, SIGMAS)
    left, right = [], []
    for at in range(0, len(first), 64):
        some = first[at:at + 64]
        same = (marks[some][:, None] == marks[second][None]).sum(axis=2) >= rough
        i, j = np.nonzero(same & (label[some][:, None] != label[second][None]))
        for cut in range(0, len(i), 8192):
            a, b = some[i[cut:cut + 8192]], second[j[cut:cut + 8192]]
            on = (fine[a] == fine[b]).sum(axis=1) >= close
            left.append(a[on])
            right.append(b[on])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _possible(open_: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """``u, v`` (u < v): texts of different labels in a bucket of ``open_`` whose registers allow the similarity.

    A bucket of n texts is cut into blocks; every two blocks meet in one group of at most two blocks of rows.
    ``marks`` holds the keys of each text (of at most 64 bands), too: a pair is emitted in the first band
    whose bucket it shares here.
    """
    marks = open_.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("bands")).join(marks.hint("merge"), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    rows = open_.withColumn("own", own).select("key", "band", "node", "label", "own", F.explode(meets).alias("m"))
    rows = rows.select("key", "m.i", "m.j", "own", "band", "node", "label").join(marks.hint("merge"), "node")
    rows = (rows.select("key", "i", "j", "own", "band", "node", "label", "bands", "keys", "marks", "fine")
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            group = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield pairs(table.slice(0, last), cuts[:-1])
            held = table.slice(last)
        if held is not None:
            yield pairs(held, np.zeros(0, np.int64))

    def pairs(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if table.num_rows:
            node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
            own, j = table.column("own").to_numpy(), table.column("j").to_numpy()
            i, band, bands = (table.column(c).to_numpy() for c in ("i", "band", "bands"))
            byte, fine = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(table.num_rows, -1)
                          for c in ("marks", "fine"))
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            for start, stop in zip(np.append(0, cuts), np.append(cuts, table.num_rows), strict=True):
                at = np.arange(start, stop)
                one, two = (at, at) if i[start] == j[start] else (at[own[at] == i[start]], at[own[at] == j[start]])
                if len(one) and len(two):
                    a, b = _alike(byte, fine, label, one, two, similarity)
                    if len(a):
                        shared = keys[a] == keys[b]   # a bucket that both share is here for both or for none
                        shared &= ((bands[a] & bands[b])[:, None] >> np.arange(shared.shape[1]) & 1).astype(bool)
                        first = shared.argmax(axis=1) == band[start]
                        a, b = a[first], b[first]
                    u.append(node[a])
                    v.append(node[b])
        u, v = np.concatenate(u), np.concatenate(v)
        pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])

    return arrow_map(rows, run, "u long, v long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                 bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``id, a, b, class_id, class_size`` (a, b: the text's hash)."""
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.write(signatures(docs, id_col, text_col, bands, rows), "signatures")
    nodes = (signed.groupBy("a", "b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"),
                                          F.first("keys").alias("keys"), F.first("marks").alias("marks"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = scratch.write(nodes, "nodes")
    entries = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = scratch.write(entries.join(shared.hint("merge"), "key").select("key", "band", "hub", "node"), "entries")
    stars = entries.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()

    needed = entries.select("node").distinct().join(nodes, "node").select("node", "a", "b", "least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("least"), F.xxhash64(text).alias("a"),
                         F.xxhash64(F.lit(1), text).alias("b"), text.alias("text"))
    same = [source["a"] == needed["a"], source["b"] == needed["b"], source["least"].eqNullSafe(needed["least"])]
    one = Window.partitionBy("node").orderBy(F.lit(1))    # repeated rows of one id
    texts = (source.join(needed.hint("merge"), same).select("node", "text")
             .withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth"))
    texts = scratch.write(texts, "texts")

    verified = scratch.write(verify(stars, texts), "stars")
    links = verified.where(F.col("similarity") >= similarity).select("u", "v")
    labels = components(links, scratch, "labels")

    # buckets that still hold several components
    placed = entries.select("key", "band", "node").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = scratch.write(_mixed(placed), "open")
    fine = finer_marks(texts.join(open_.select("node").distinct().hint("merge"), "node", "left_semi"))
    marks = scratch.write(nodes.select("node", "marks", "keys").join(fine.hint("merge"), "node"), "marks")
    rest = _possible(open_.where(F.col("n") <= BLOCK), marks, similarity)
    large = open_.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        whole = large.select("node", "label").distinct()
        split = split_keys(texts.join(whole.select("node").hint("merge"), "node", "left_semi"))
        split = scratch.write(split, "split")
        finer = (split.join(whole.hint("merge"), "node").select("node", "label", F.posexplode("keys").alias("band", "key")))
        rest = rest.unionByName(_possible(scratch.write(_mixed(finer), "finer"),
                                          marks.drop("keys").join(split.hint("merge"), "node"), similarity))
    rest = scratch.write(rest.distinct().join(verified.select("u", "v"), ["u", "v"], "left_anti"), "possible")
    more = scratch.write(verify(rest, texts), "rest").where(F.col("similarity") >= similarity).select("u", "v")
    if not more.isEmpty():
        known = labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
        labels = components(known.unionByName(more), scratch, "relabels")

    named = (nodes.join(labels.hint("merge"), "node", "left")
             .select("a", "b", "least", "copies", F.coalesce("label", "node").alias("label")))
    sizes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = scratch.write(named.join(sizes.hint("merge"), "label").select("a", "b", "class_id", "class_size"), "classes")
    return signed.select("id", "a", "b").join(classes.hint("merge"), ["a", "b"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    classes = near_classes(docs, id_col, text_col, similarity)
    kept = classes.where(F.col("id").eqNullSafe(F.col("class_id"))).select("id", "a", "b").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("rid"),
                       F.xxhash64(text).alias("ra"), F.xxhash64(F.lit(1), text).alias("rb"))
    rows = rows.join(kept.hint("merge"), F.col("rid").eqNullSafe(F.col("id")) & (F.col("ra") == F.col("a"))
                     & (F.col("rb") == F.col("b")), "left_semi")
    one = Window.partitionBy("rid", "ra", "rb").orderBy(F.lit(1))   # repeated rows of one id
    return rows.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")


def near_report(docs: DataFrame) -> DataFrame:
    """The columns of query ``op7_near_dedup``."""
    return near_classes(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size",
                                     F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
