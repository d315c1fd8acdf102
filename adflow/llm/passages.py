"""Fuzzy passages that repeat across documents: seeds, collinear chains, alignment.

Seeds are runs of ``SEED`` words, thinned by minimisers: of every ``WINDOW``
consecutive runs the one of least hash is kept, so two texts that share
``SEED + WINDOW - 1`` words in a row share a seed whatever surrounds it.  A seed
travels with a byte for each of the ``SIDE`` words on either side of it, so most
chance matches are told apart where equal seeds meet, after one shuffle.

The places of a seed meet through *leaders*: its first place is one; a place that
agrees with a leader in ``LIKE`` of the words beside it is matched with the first
such leader, any other is matched with the leader that agrees best (in ``AGREE``
words at least) and becomes a leader itself.  So a passage in very many texts
gives as many matches as places, not their square, and texts put together from
sentences that occur elsewhere still meet one another: their words beside the
seed are not those of the other holders.  The leaders of a seed that has more than
``DIRECT`` are compared as well, all of them, in squares that are dealt over tasks.

Equal texts stand for one another: a task seeds the first of them only, and
pairs of texts are brought to the first of their copies before they are aligned;
its copies are rows of their own in the result.

The matches of two texts are chained: the best chain that is ordered in both,
where a gap costs ``GAP`` per word skipped on either side, found with a Fenwick
tree over the positions (its prefix maxima answer "best chain that ends before
here").  Chains are then aligned on the words: gaps between their seeds with at
most one shift, both ends extended while words agree.  Along the alignment a
word that agrees gains what makes ``SIMILARITY`` break even, one that does not
loses 1 - so every stretch of greatest gain has at least that share of equal
words; one of at least ``MIN_WORDS`` is a passage, and the search goes on beside
it.  Of overlapping passages with one document the longer stays.

Words are between ASCII white space, A-Z lower-cased; whole texts are read.

Defined results: documents of fewer than ``MIN_WORDS`` words, null and empty
texts hold no passage; repeats inside one document are not reported; repeated
rows count as documents of their own; of equal texts the first row read stands
for all, and each other one repeats it as a whole; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adflow.llm.base import Scratch, arrow_map
from adflow.llm.words import byte_sizes, mix, stretches, text_bytes, word_hashes

SEED, WINDOW = 6, 6
MIN_WORDS = 45
SIMILARITY = 0.8
REPEAT = 20        # words between the seeds that are kept of a word repeated over and over
GAP = 0.1          # cost of a word that a chain skips on either side
NEAR = 4           # words by which an extension may shift
SIDE = 6           # words on either side of a seed that are compared where equal seeds meet
AGREE, LIKE = 5, 11  # of these words: as many as a match needs, and as make it as good as any
ROUNDS = 12        # leaders of a seed that are compared with all seeds of a batch at once
DIRECT = 2048      # leaders of a seed that are compared where its places meet; those of more in squares
SQUARE = 8192      # places and leaders of a square
DROP = 8           # an extension ends so far below its best score


def minimisers(words: np.ndarray, ends: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position (in words of the text) and hash of each seed that is kept."""
    if len(words) < SEED:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = np.zeros(len(words) - SEED + 1, np.uint64)
    for k in range(SEED):
        runs += words[k:len(words) - SEED + 1 + k] * np.uint64((2 * k + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF | 1)
    runs = mix(runs)
    counts = np.diff(ends)
    windows = np.where(counts >= max(least, SEED), np.maximum(counts - SEED + 1 - WINDOW, 0) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + ends[owner]
    if len(runs) >= WINDOW:
        view = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
        low = np.zeros(len(view), np.int64)
        for at in range(0, len(view), 1 << 16):
            low[at:at + (1 << 16)] = view[at:at + (1 << 16)].argmin(axis=1)
    else:
        low = np.zeros(0, np.int64)
    full = counts[owner] - SEED + 1 >= WINDOW
    pick = np.zeros(len(owner), np.int64)
    pick[full] = start[full] + low[start[full]]
    for i in np.flatnonzero(~full):   # a text with fewer runs than a window
        s, e = ends[owner[i]], ends[owner[i] + 1] - SEED + 1
        pick[i] = s + runs[s:e].argmin()
    new = np.ones(len(pick), bool)
    new[1:] = pick[1:] != pick[:-1]
    owner, pick = owner[new], pick[new]
    value = runs[pick]
    # a word repeated over and over makes every run a minimum: one in REPEAT words is enough
    first = np.ones(len(pick), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(pick) >= WINDOW)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(pick)), 0)) if len(pick) else first.astype(int)
    step = (pick - pick[begin]) // REPEAT
    keep = first.copy()
    keep[1:] |= step[1:] != step[:-1]
    return owner[keep], (pick - ends[owner])[keep], value[keep]


def best_chains(here: np.ndarray, there: np.ndarray) -> list[list[int]]:
    """Collinear chains of matches (positions in either text), as lists of match numbers, best first.

    ``score(j) = SEED + max(0, max over i before j in both of score(i) - GAP * words skipped)``;
    with ``score(i) + GAP * (here_i + there_i)`` in a Fenwick tree over ``here``, filled in order of
    ``there``, the inner maximum is a prefix maximum.
    """
    places = np.unique(here).tolist()
    size = len(places)
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (size + 1)
    order = np.lexsort((here, there)).tolist()
    here_, there_ = here.tolist(), there.tolist()
    score, back = [0.0] * len(order), [-1] * len(order)
    at = 0
    while at < len(order):
        upto = at
        while upto < len(order) and there_[order[upto]] == there_[order[at]]:   # one position there: ask before adding
            j = order[upto]
            i = bisect_left(places, here_[j])
            best = (-1.0, -1)
            while i > 0:
                if tree[i] > best:
                    best = tree[i]
                i &= i - 1
            reach = GAP * (here_[j] + there_[j])
            gain = best[0] - reach
            score[j], back[j] = (SEED + gain, best[1]) if best[1] >= 0 and gain > 0 else (float(SEED), -1)
            upto += 1
        for j in order[at:upto]:
            entry = (score[j] + GAP * (here_[j] + there_[j]), j)
            i = bisect_left(places, here_[j]) + 1
            while i <= size:
                if tree[i] < entry:
                    tree[i] = entry
                i += i & -i
        at = upto
    chains, used = [], [False] * len(order)
    for j in sorted(range(len(order)), key=lambda j: -score[j]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = back[j]
        if chain:
            chains.append(chain[::-1])
    return chains


Block = tuple[int, int, int]   # words skipped in either text, then words laid side by side


def _extend(a: np.ndarray, b: np.ndarray) -> list[Block]:
    """Blocks from the starts of ``a`` and ``b`` on, while they gain agreeing words."""
    i = j = 0
    blocks: list[Block] = []
    while True:
        best = (0, 0, 0, 0)
        for shift in range(-NEAR, NEAR + 1):
            skip_a, skip_b = max(shift, 0), max(-shift, 0)
            x, y = a[i + skip_a:], b[j + skip_b:]
            n = min(len(x), len(y))
            if not n or (shift and not blocks):
                continue
            run = np.cumsum(np.where(x[:n] == y[:n], 1, -1))
            low = np.flatnonzero(np.maximum.accumulate(run) - run > DROP)
            run = run[:low[0]] if len(low) else run
            top = int(run.argmax())
            gain = int(run[top]) - 2 * abs(shift)
            if gain > best[0]:
                best = (gain, skip_a, skip_b, top + 1)
        if best[0] <= 0 or (best[1] + best[2] and best[0] < NEAR):
            return blocks
        blocks.append(best[1:])
        i, j = i + best[1] + best[3], j + best[2] + best[3]


def _between(a: np.ndarray, b: np.ndarray) -> list[Block]:
    """The best alignment of two gaps with one shift."""
    n = min(len(a), len(b))
    left = np.concatenate([[0], np.cumsum(a[:n] == b[:n])])
    right = np.concatenate([[0], np.cumsum(a[::-1][:n] == b[::-1][:n])])
    cut = int((left + right[::-1]).argmax())
    return [(0, 0, cut), (len(a) - n, len(b) - n, n - cut)]


def columns(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The alignment around ``chain``: per column the next word of either text, and whether the two are laid side by side and agree."""
    i, j = chain[0]
    back = _extend(a[:i][::-1], b[:j][::-1])
    start = i - sum(x + n for x, _, n in back), j - sum(y + n for _, y, n in back)
    blocks = []
    for x, y, n in back[::-1]:   # seen from the other side, the skip follows the words
        blocks += [(0, 0, n), (x, y, 0)]
    for p, q in chain:
        step = max(i - p, j - q, 0)   # overlaps the seed before
        p, q = p + step, q + step
        n = max(0, min(SEED - step, len(a) - p, len(b) - q))
        blocks += [*_between(a[i:p], b[j:q]), (0, 0, n)]
        i, j = p + n, q + n
    blocks += _extend(a[i:], b[j:])
    at_a, at_b, side = [], [], []
    i, j = start
    for x, y, n in blocks:
        for skip_a, skip_b, beside in ((x, 0, 0), (0, y, 0), (0, 0, n)):
            size = skip_a + skip_b + beside
            if size:
                at_a.append(i + np.arange(size) * (1 if skip_a or beside else 0))
                at_b.append(j + np.arange(size) * (1 if skip_b or beside else 0))
                side.append(np.full(size, bool(beside)))
                i, j = i + skip_a + beside, j + skip_b + beside
    at_a, at_b, side = np.concatenate(at_a), np.concatenate(at_b), np.concatenate(side)
    equal = side.copy()
    equal[side] = a[at_a[side]] == b[at_b[side]]
    return at_a, at_b, equal


def stretches_alike(equal: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int]]:
    """Stretches of columns of greatest gain that are long enough, one beside the other."""
    gain = np.where(equal, (1 - similarity) / similarity, -1.0) + np.where(equal, 1e-9, 0)
    out, todo = [], [(0, len(equal))]
    while todo:
        low, high = todo.pop()
        if high - low < min_words:
            continue
        total = np.concatenate([[0], np.cumsum(gain[low:high])])
        least = np.minimum.accumulate(total)
        stop = int((total - least).argmax())
        start = int(total[:stop + 1].argmin()) if stop else 0
        if stop - start < min_words:
            if stop == start:
                continue
            todo += [(low, low + start), (low + stop, high)]
            continue
        out.append((low + start, low + stop))
        todo += [(low, low + start), (low + stop, high)]
    return out


def passages_of(a: np.ndarray, b: np.ndarray, chains: list[list[tuple[int, int]]], min_words: int,
                similarity: float) -> list[tuple[int, int, int, int, float]]:
    found: list[tuple[int, int, int, int, float]] = []
    for chain in chains:
        i, j = chain[0]
        if any(s <= i and chain[-1][0] + SEED <= e and t <= j and chain[-1][1] + SEED <= u for s, e, t, u, _ in found):
            continue
        at_a, at_b, equal = columns(a, b, chain)
        for low, high in stretches_alike(equal, min_words, similarity):
            s, e, t, u = int(at_a[low]), int(at_a[high - 1]) + 1, int(at_b[low]), int(at_b[high - 1]) + 1
            if min(e - s, u - t) >= min_words:
                found.append((s, e, t, u, float(equal[low:high].sum()) / max(e - s, u - t)))
    found.sort(key=lambda f: f[0] - f[1])
    kept: list[tuple[int, int, int, int, float]] = []
    for f in found:
        if not any(f[0] < k[1] and k[0] < f[1] for k in kept):
            kept.append(f)
    return sorted(kept)


def beside(words: np.ndarray, ends: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A byte (1 to 255; 0 beyond the text) for each of the ``SIDE`` words before and after each seed."""
    byte = (words >> np.uint64(56)).astype(np.uint8)
    np.maximum(byte, 1, out=byte)
    at = ends[owner] + place
    out = np.zeros((len(at), 2 * SIDE), np.uint8)
    for k in range(SIDE):
        for column, near in ((SIDE - 1 - k, at - 1 - k), (SIDE + k, at + SEED + k)):
            inside = (near >= ends[owner]) & (near < ends[owner + 1])
            out[inside, column] = byte[near[inside]]
    return out


def seeds(docs: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """``seed, u, near, far``: the kept seeds of each row of ``docs(uid, a, text)``, but for texts that the task has
    read before; ``near`` holds the place and four of the bytes beside it, ``far`` the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start, stop in stretches(byte_sizes(batch.column(2))):
                part = batch.slice(start, stop - start)
                new = []
                for a in part.column(1).to_pylist():
                    new.append(a not in seen)
                    seen.add(a)
                words, _, ends = word_hashes(pc.if_else(pa.array(new), part.column(2), pa.scalar("")))
                owner, place, value = minimisers(words, ends, min_words)
                sides = beside(words, ends, owner, place)
                near = place << 32 | np.ascontiguousarray(sides[:, 8:]).view(np.uint32)[:, 0].astype(np.int64)
                far = np.ascontiguousarray(sides[:, :8]).view(np.int64)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(part.column(0).to_numpy()[owner]),
                                                  pa.array(near), pa.array(far)], ["seed", "u", "near", "far"])

    return arrow_map(docs, run, "seed long, u long, near long, far long")


def _agree(sides: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    a = sides[one]
    return ((a == sides[other]) & (a != 0)).sum(axis=1)


def _best_leaders(node: np.ndarray, sides: np.ndarray, leader_node: np.ndarray, leader_sides: np.ndarray,
                  earlier: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each place the first leader that agrees in ``LIKE`` words, or else the first of those that agree best:
    the words that agree (``LIKE`` at most) and the leader's number.  ``earlier``: places and leaders are the same
    rows, and a place meets those before it only."""
    words, found = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
    columns = np.ascontiguousarray(leader_sides.T)
    for at in range(0, len(node), 128):
        some = sides[at:at + 128]
        upto = min(at + 128, len(leader_node)) if earlier else len(leader_node)
        count = np.zeros((len(some), upto), np.uint8)
        for k, column in enumerate(columns):
            equal = some[:, k, None] == column[None, :upto]
            equal[some[:, k] == 0] = False
            count += equal
        count[node[at:at + 128, None] == leader_node[None, :upto]] = 0
        if earlier:
            count[np.arange(upto)[None] >= at + np.arange(len(some))[:, None]] = 0
        np.minimum(count, LIKE, out=count)
        pick = count.argmax(axis=1)
        words[at:at + 128], found[at:at + 128] = count[np.arange(len(some)), pick], pick
    return words, found


def _met(seed: np.ndarray, node: np.ndarray, sides: np.ndarray, direct: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per place, sorted by seed, the words that agree with its best leader and that leader's row; the places of each
    seed with more than ``direct`` leaders, which have met ``ROUNDS`` leaders only."""
    n = len(seed)
    best, to = np.zeros(n, np.int64), np.full(n, -1)
    rows, large = np.arange(n), []
    for _ in range(ROUNDS):
        if len(rows) < 2:
            break
        new = np.concatenate([[True], seed[rows[1:]] != seed[rows[:-1]]])
        leader = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        some = (leader != rows) & (node[leader] != node[rows])
        count = np.zeros(len(rows), np.int64)
        count[some] = _agree(sides, rows[some], leader[some])
        better = count > best[rows]
        best[rows[better]], to[rows[better]] = count[better], leader[better]
        rows = rows[~new & (count < LIKE)]
        if len(rows):   # a place alone has met all leaders
            alone = np.concatenate([[True], seed[rows[1:]] != seed[rows[:-1]]]) & np.concatenate([seed[rows[1:]] != seed[rows[:-1]], [True]])
            rows = rows[~alone]
    if len(rows):
        for some in np.split(rows, np.flatnonzero(np.diff(seed[rows])) + 1):
            if len(some) > direct:
                large.append(some)
                continue
            words, found = _best_leaders(node[some], sides[some], node[some], sides[some], True)
            better = words > best[some]
            best[some[better]], to[some[better]] = words[better], some[found[better]]
    return best, to, large


def meet(seed: np.ndarray, node: np.ndarray, sides: np.ndarray, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray]:
    """Matches (row numbers) of places sorted by seed: at most one a place, with a leader.

    All leaders of a seed are compared, those of more than ``direct`` square by square.
    """
    best, to, large = _met(seed, node, sides, direct)
    for some in large:
        for i in range(0, len(some), direct):
            for j in range(0, i + 1, direct):
                one, other = some[i:i + direct], some[j:j + direct]
                words, found = _best_leaders(node[one], sides[one], node[other], sides[other], i == j)
                better = words > best[one]   # squares come in the leaders' order, so the first of equals stays
                best[one[better]], to[one[better]] = words[better], other[found[better]]
    hit = np.flatnonzero(best >= AGREE)
    return hit, to[hit]


def _sides(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return np.concatenate([far[:, None].view(np.uint8), (near & 0xFFFFFFFF).astype(np.uint32)[:, None].view(np.uint8)], axis=1)


def _matches(u: np.ndarray, v: np.ndarray, here: np.ndarray, there: np.ndarray) -> list[pa.Array]:
    """The columns ``u, v, here, there`` of matches: the later text first."""
    swap = u < v
    return [pa.array(c) for c in (np.where(swap, v, u), np.where(swap, u, v), np.where(swap, there, here).astype(np.int32),
                                  np.where(swap, here, there).astype(np.int32))]


def _same_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups by the first ``keys`` columns, by which the rows arrive sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:   # up to the last group of the batch, which may go on
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(keys)], axis=1)
        other = np.flatnonzero((values != values[-1]).any(axis=1))
        at = int(other[-1]) + 1 if len(other) else 0
        if at or (held and any(held[-1].column(c)[-1].as_py() != values[0, c] for c in range(keys))):
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


LEFT = ["seed", "n", "places", "near", "far", "words"]   # of a place that has not met all leaders of its seed


def _meet(direct: int):
    """Places sorted by seed -> matches ``u, v, here, there``; a place of a seed with more than ``direct`` leaders comes
    with the best it has met so far (``v`` null: nothing) and with the columns ``LEFT``, which are null in matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _same_key(batches, 1):
            seed, node, near, far = (table.column(c).to_numpy() for c in ("seed", "u", "near", "far"))
            some = np.zeros(len(seed), bool)
            some[1:] = seed[1:] == seed[:-1]
            some[:-1] |= some[1:]
            seed, node, near, far = seed[some], node[some], near[some], far[some]
            if not len(seed):
                continue
            best, to, large = _met(seed, node, _sides(near, far), direct)
            place = near >> 32
            done = best >= AGREE
            for rows in large:
                done[rows] = False
            a = np.flatnonzero(done)
            b = to[a]
            yield pa.RecordBatch.from_arrays([*_matches(node[a], node[b], place[a], place[b]),
                                              *[pa.nulls(len(a), pa.int64())] * len(LEFT)], ["u", "v", "here", "there", *LEFT])
            for rows in large:
                none = to[rows] < 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows]), pa.array(node[to[rows]], mask=none), pa.array(place[rows].astype(np.int32)),
                     pa.array(place[to[rows]].astype(np.int32), mask=none), pa.array(seed[rows]), pa.array(np.arange(len(rows))),
                     pa.array(np.full(len(rows), len(rows))), pa.array(near[rows]), pa.array(far[rows]), pa.array(best[rows])],
                    ["u", "v", "here", "there", *LEFT])
    return run


def _square(side: int):
    """The places of squares ``seed, i, j``, sorted by their number ``n`` in the seed -> per place of block ``i``
    the best leader of block ``j``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _same_key(batches, 3):
            columns = [table.column(c).to_numpy() for c in ("seed", "i", "j", "n", "u", "near", "far")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(columns[0])], strict=True):
                seed, i, j, n, u, near, far = (c[a:b] for c in columns)
                sides, block = _sides(near, far), n // side
                one, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
                if not len(one) or not len(other):
                    continue
                words, found = _best_leaders(u[one], sides[one], u[other], sides[other], bool(i[0] == j[0]))
                hit = words >= AGREE
                one, other, words = one[hit], other[found[hit]], words[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (seed[one], n[one], u[one], near[one] >> 32, words, -n[other], u[other], near[other] >> 32)],
                    ["seed", "n", "u", "here", "words", "order", "v", "there"])
    return run


def all_matches(places: DataFrame, scratch: Scratch, direct: int = DIRECT, side: int = SQUARE) -> DataFrame:
    """``u, v, here, there``: each of ``places(seed, u, near, far)`` with its best leader, of all that its seed has.

    Seeds with more than ``direct`` leaders are dealt over squares of ``side`` places by ``side`` leaders.
    """
    col = F.col
    met = arrow_map(places.repartition("seed").sortWithinPartitions("seed", "u", "near"), _meet(direct),
                    "u long, v long, here int, there int, " + ", ".join(f"{c} long" for c in LEFT))
    met = scratch.write(met, "matches")
    matches, left = met.where("seed IS NULL").select("u", "v", "here", "there"), met.where("seed IS NOT NULL")
    if left.isEmpty():
        return matches
    block = F.floor(col("n") / side)
    dealt = (left.select("seed", "n", "u", "near", "far", block.alias("block"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.floor((col("places") - 1) / side))).alias("with"))
             .select("seed", F.greatest("block", "with").alias("i"), F.least("block", "with").alias("j"), "n", "u", "near", "far"))
    met = arrow_map(dealt.repartition("seed", "i", "j").sortWithinPartitions("seed", "i", "j", "n"), _square(side),
                    "seed long, n long, u long, here long, words long, order long, v long, there long")
    # what a place met in the rounds stands before all that are left
    met = met.unionByName(left.where(col("words") >= AGREE).select("seed", "n", "u", col("here").cast("long").alias("here"), "words",
                                                                   F.lit(1).cast("long").alias("order"), "v", col("there").cast("long").alias("there")))
    best = met.groupBy("seed", "n").agg(F.max(F.struct("words", "order", "u", "here", "v", "there")).alias("m")).select("m.*")
    later = col("u") > col("v")
    return matches.unionByName(best.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.when(later, col("here")).otherwise(col("there")).cast("int").alias("here"),
        F.when(later, col("there")).otherwise(col("here")).cast("int").alias("there")))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The matches of each (document, hub), which arrive sorted; at most a batch and a group are held."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
        rows = np.concatenate([*held, rows]) if held else rows
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        start = 0
        for cut in cuts:
            yield int(rows[start, 0]), int(rows[start, 1]), rows[start:cut, 2], rows[start:cut, 3]
            start = cut
        held = [rows[start:]] if start < len(rows) else []
    if held:
        rows = held[0]
        yield int(rows[0, 0]), int(rows[0, 1]), rows[:, 2], rows[:, 3]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int, list[list[dict[str, int]]]]] = []
    pack = lambda: pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
        pa.array([r[2] for r in out], pa.list_(pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32())]))))], ["u", "v", "chains"])
    for u, v, here, there in _groups(batches):
        chains = best_chains(here, there) if len(here) > 1 else [[0]]
        out.append((u, v, [[{"p": int(here[j]), "q": int(there[j])} for j in chain] for chain in chains]))
        if len(out) >= 1000:
            yield pack()
            out = []
    yield pack()


def _align(min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in stretches(byte_sizes(batch.column(3)) + byte_sizes(batch.column(4))):
                part = batch.slice(start, stop - start)
                sides = [(word_hashes(part.column(c)), text_bytes(part.column(c))) for c in (3, 4)]
                (wa, fa, ea), (da, ba) = sides[0]
                (wb, _, eb), _ = sides[1]
                out: list[tuple] = []
                for n, (u, v, chains) in enumerate(zip(*[part.column(c).to_pylist() for c in range(3)], strict=True)):
                    a, b = wa[ea[n]:ea[n + 1]], wb[eb[n]:eb[n + 1]]
                    for s, e, t, w, share in passages_of(a, b, [[(m["p"], m["q"]) for m in c] for c in chains], min_words, similarity):
                        first = fa[ea[n] + s]
                        last = fa[ea[n] + e] if ea[n] + e < ea[n + 1] else ba[n + 1]
                        text = da[first:last].tobytes().decode("utf-8", "replace").rstrip()
                        out.append((u, v, s, e, t, w, share, text))
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)],
                    ["u", "v", "start_word", "end_word", "hub_start", "hub_end", "similarity", "passage"])
    return run


CHAINS = "u long, v long, chains array<array<struct<p:int,q:int>>>"
FOUND = ("u long, v long, start_word int, end_word int, hub_start int, hub_end int, similarity double, passage string")


def _same_order(docs: DataFrame) -> bool:
    """Whether every scan of ``docs`` gives its rows in the same places: it is files or local rows, and no shuffle."""
    todo, steady = [docs._jdf.queryExecution().optimizedPlan()], {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "Union"}
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in steady and not node.nodeName().startswith("Relation"):
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                      similarity: float = SIMILARITY) -> DataFrame:
    """A row per passage that a document repeats from another: ids, word spans (end exclusive), similarity, text."""
    scratch = Scratch(docs.sparkSession, "passages")
    col = F.col
    text = F.coalesce(col(text_col), F.lit(""))
    if not _same_order(docs):
        docs = scratch.write(docs.select(id_col, text_col), "documents")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), col(id_col).cast("long").alias("id"),
                       F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.alias("text"))
    table = scratch.write(rows.select("uid", "id", "a", "b"), "rows")   # the same scan as that of the seeds, so the same uids
    copies = table.groupBy("a", "b").agg(F.min(F.struct("uid", "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = scratch.write(table.join(copies.hint("merge"), ["a", "b"])
                           .select("uid", "id", "a", "b", col("first.uid").alias("of"), col("first.id").alias("hub_doc_id")), "copies")

    places = seeds(rows.select("uid", "a", "text"), "text", min_words)
    matches = all_matches(places, scratch)
    chained = arrow_map(matches.repartition("u").sortWithinPartitions("u", "v", "there", "here"), _chain, CHAINS)
    chained = scratch.write(chained, "chains")
    first = copies.where("uid <> of").select("uid", "of")
    to = lambda df, c: (df.join(first.select(col("uid").alias(c), "of").hint("merge"), c, "left")
                        .withColumn(c, F.coalesce("of", c)).drop("of"))
    pairs = to(to(chained, "u"), "v").where("u <> v").groupBy("u", "v").agg(F.flatten(F.collect_list("chains")).alias("chains"))
    pairs = scratch.write(pairs, "pairs")

    wanted = pairs.select(col("u").alias("uid")).union(pairs.select("v")).union(copies.select("of")).distinct()
    wanted = wanted.join(table.hint("merge"), "uid")
    source = rows.select("id", "a", "b", "text")
    one = Window.partitionBy("uid").orderBy("text")   # repeated rows
    texts = (source.join(wanted.hint("merge"), source["id"].eqNullSafe(wanted["id"]) & (source["a"] == wanted["a"]) & (source["b"] == wanted["b"]))
             .select("uid", wanted["id"], "text").withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth"))
    texts = scratch.write(texts, "texts")
    own = texts.select(col("uid").alias("u"), col("id").alias("doc_id"), col("text").alias("tu"))
    hub = texts.select(col("uid").alias("v"), col("text").alias("tv"))
    laid = pairs.join(hub.hint("merge"), "v").join(own.select("u", "tu").hint("merge"), "u").select("u", "v", "chains", "tu", "tv")
    found = scratch.write(arrow_map(laid, _align(min_words, similarity), FOUND), "found")
    passages = (found.join(own.select("u", "doc_id").hint("merge"), "u")
                .join(texts.select(col("uid").alias("v"), col("id").alias("hub_doc_id")).hint("merge"), "v")
                .select("doc_id", "hub_doc_id", "start_word", "end_word", "hub_start", "hub_end", "similarity", "passage"))
    # every other one of equal texts repeats the first as a whole
    blank = "[\\x09-\\x0D\\x1C-\\x20]+"
    whole = texts.join(copies.select(col("of").alias("uid")).distinct().hint("merge"), "uid", "left_semi").select(
        col("uid").alias("of"), F.regexp_replace("text", f"^{blank}|{blank}$", "").alias("passage"))
    whole = whole.withColumn("words", F.size(F.split("passage", blank))).where(col("words") >= min_words)
    others = copies.where("uid <> of").join(whole.hint("merge"), "of")
    return passages.unionByName(others.select(
        col("id").alias("doc_id"), "hub_doc_id", F.lit(0).alias("start_word"), col("words").alias("end_word"), F.lit(0).alias("hub_start"),
        col("words").alias("hub_end"), F.lit(1.0).alias("similarity"), "passage"))


def passages_report(docs: DataFrame) -> DataFrame:
    """The columns of query ``op8_substring_dedup``."""
    return repeated_passages(docs)
