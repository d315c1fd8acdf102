"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a sample of its labelled text.  A text
is parsed greedily into the longest phrases that occur in that sample; the
language that needs the fewest phrases wins; a phrase costs the bits of a place
in the largest sample, whatever the language, so a small sample is not cheap.
The sample is bounded and documented (``PER_LANGUAGE`` excerpts of ``PER_TEXT``
characters, cut to ``SAMPLE`` bytes): the rows of least hash in each language, of
which only a few times as many are ever shuffled.  It travels with the tasks,
which build the automata once per worker.

Texts are read whole, in lanes of ``LANE`` bytes; a phrase ends at the end of a
lane.  All lanes of a batch take a step at a time, in all languages.  Nothing is
shuffled but the sample.

Texts are lower-cased, and what is not a letter becomes one blank per run, for
learning and for prediction alike.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no row can be learned from.  Excerpts without a letter are
not learned, nor is a language that has no others.  Rows with a null language are
predicted but not learned from; ties go to the language that sorts first; all
input columns are kept, but ones named as an output are replaced; repeated rows
each get their row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adflow.llm.base import arrow_map, crc32_fold, early
from adflow.llm.words import byte_sizes, stretches

PER_LANGUAGE = 96    # excerpts to learn a language from
PER_TEXT = 600       # characters of each
SAMPLE = 24_000      # bytes of a language that are learned
LANE = 1024          # bytes that are parsed in one go
LANES = 16_384       # lanes that a task parses at a time
HELD = 1 << 23       # bytes of text that a task holds as numbers at a time
SHARPNESS = 4.0      # score = softmax of minus so many times the bits per byte
BLANK = 32
UNDETERMINED = "und"

#: (language, normalised text) in order of language
Model = tuple[tuple[str, bytes], ...]


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' normalised bytes one after the other, and where each starts and ends."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    keep = letter.copy()
    keep[1:] |= letter[:-1]          # the first of a run of others becomes a blank
    keep[ends[:-1][ends[:-1] < len(data)]] |= True
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    return np.where(letter, data, BLANK).astype(np.uint8)[keep], kept


def learn(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id") -> Model:
    """The model of the rows where ``may_learn`` holds."""
    order = F.xxhash64(id_col, text_col)
    start = 1 + F.pmod(order, F.greatest(F.length(text_col) - PER_TEXT, F.lit(1)))
    rows = (docs.where(may_learn & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
            .select(F.col(lang_col).alias("lang"), order.alias("order"),
                    F.col(text_col).substr(start.cast("int"), F.lit(PER_TEXT)).alias("text"))
            .where(F.col("text").rlike(r"\p{L}")))
    found = rows.groupBy("lang").count().collect()   # a row a language
    if not found:
        return ()
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, 4.0 * PER_LANGUAGE / r["count"]))])
    rows = rows.where(early(F.col("order"), share[F.col("lang")]))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= PER_LANGUAGE)
    texts: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "nth").collect():   # bounded: PER_LANGUAGE excerpts a language
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, normalise(pa.array([" ".join(parts)]))[0].tobytes()[:SAMPLE]) for lang, parts in texts.items())


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The steps of each state; state 0 is the start, and every path from it spells a substring."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in data:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = steps[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and steps[at].get(symbol) == to:
                    steps[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return steps


class Parser:
    """The automata of all languages: entry = 2 * next state + 1 if a phrase starts.

    Most states have one step, along the sample: such a state keeps its symbol and
    entry, and only the others a row of the table.  States are numbered with the
    rows first; a state's missing steps are those of its language's first row,
    which lead to where the next phrase starts and count it.
    """

    def __init__(self, model: Model):
        self.languages = [lang for lang, _ in model]
        self.bits = np.log2(max(2, *[len(text) for _, text in model]))   # of a phrase, in any language
        used = sorted({b for _, text in model for b in text})
        self.symbol = np.full(256, len(used), dtype=np.uint8 if len(used) < 255 else np.uint16)
        self.symbol[used] = np.arange(len(used))
        self.width = width = len(used) + 1
        automata = [suffix_automaton(text) for _, text in model]
        many = [[n for n, s in enumerate(steps) if len(s) != 1] for steps in automata]
        rows = sum(1 + len(m) for m in many)       # a language's first row is that of no match
        self.table = np.empty((rows, width), dtype=np.int32)
        lone_symbol, lone_entry, self.start, row, lone = [], [], [], 0, rows
        for steps, own in zip(automata, many, strict=True):
            number = np.full(len(steps), -1, dtype=np.int64)
            number[own] = row + 1 + np.arange(len(own))
            single = number < 0
            number[single] = lone + np.arange(int(single.sum()))
            first = np.full(width, 2 * row + 1, dtype=np.int32)
            for byte, to in steps[0].items():
                first[self.symbol[byte]] = 2 * number[to] + 1
            self.table[row:row + 1 + len(own)] = first
            for n in own:
                for byte, to in steps[n].items():
                    self.table[number[n], self.symbol[byte]] = 2 * number[to]
            step = [next(iter(steps[n].items())) for n in np.flatnonzero(single)]
            lone_symbol.append(self.symbol[[b for b, _ in step]] if step else np.zeros(0, self.symbol.dtype))
            lone_entry.append((2 * number[[t for _, t in step]]).astype(np.int32))
            self.start.append(row)
            row, lone = row + 1 + len(own), lone + len(step)
        self.rows, self.table = rows, self.table.ravel()
        self.lone_symbol = np.concatenate([*lone_symbol, np.zeros(1, self.symbol.dtype)])
        self.lone_entry = np.concatenate([*lone_entry, np.zeros(1, np.int32)])

    def steps(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The entries that ``symbols`` lead to from ``state`` (languages x lanes)."""
        lone = state - np.int32(self.rows)
        single = lone >= 0
        first = np.array(self.start, np.int32)[:, None]
        to = self.table[np.where(single, first, state) * self.width + symbols]
        np.maximum(lone, 0, out=lone)
        return np.where(single & (self.lone_symbol[lone] == symbols), self.lone_entry[lone], to)

    def phrases(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases per language and text."""
        lengths = np.diff(ends)
        lanes = -(-lengths // LANE)
        owner = np.repeat(np.arange(len(lengths)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = ends[:-1][owner] + nth * LANE
        size = np.minimum(lengths[owner] - nth * LANE, LANE)
        counts = np.zeros((len(self.languages), len(lengths)))
        symbols = self.symbol[data]
        order = np.argsort(-size, kind="stable")
        for cut in range(0, len(order), LANES):
            part = order[cut:cut + LANES]
            n = size[part]
            at = np.zeros((n[0], len(part)), dtype=symbols.dtype)
            for lane, (b, k) in enumerate(zip(begin[part], n, strict=True)):
                at[:k, lane] = symbols[b:b + k]
            running = len(part) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
            state = np.repeat(np.array(self.start, dtype=np.int32)[:, None], len(part), axis=1)
            found = np.zeros(state.shape, dtype=np.int32)
            for step, active in enumerate(running):
                to = self.steps(state[:, :active], at[step, :active])
                found[:, :active] += to & 1
                state[:, :active] = to >> 1
            for k in range(len(self.languages)):
                counts[k] += np.bincount(owner[part], weights=found[k], minlength=len(lengths))
        return counts


@lru_cache(maxsize=2)
def parser(model: Model) -> Parser:
    return Parser(model)


def predict(texts: pa.Array, model: Model) -> tuple[pa.Array, np.ndarray]:
    """Language and score of each text."""
    none = np.zeros(len(texts))
    if not model or not len(texts):
        return pa.array([UNDETERMINED] * len(texts), pa.string()), none
    own = parser(model)
    data, ends = normalise(texts)
    bits = own.phrases(data, ends) * own.bits / np.maximum(np.diff(ends), 1)
    best = bits.argmin(axis=0)
    odds = np.exp(-SHARPNESS * (bits - bits.min(axis=0)))
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    lang = [own.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)]
    return pa.array(lang, pa.string()), np.where(lettered, 1 / odds.sum(axis=0), none)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred",
             score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score."""
    outputs = (lang_col.lower(), score_col.lower())
    keep = [f for f in docs.schema.fields if f.name.lower() not in outputs]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in stretches(byte_sizes(batch.column(text_col)), HELD):
                part = batch.slice(start, stop - start)
                lang, score = predict(part.column(text_col), model)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], lang, pa.array(score)],
                                                 [*names, lang_col, score_col])

    return arrow_map(docs, run, schema)


def held_out() -> Column:
    return F.coalesce(crc32_fold(F.col("doc_id"), 4) == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """The columns of query ``op2_language_id``."""
    model = learn(docs, ~held_out())
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
