"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation's turns, in order, are to be edited so that the initials of the
roles read ``(s?(ua)+)?``.  The deductions are weighted hyperedges: from item
``[i, q]`` (the first i turns are settled, the roles so far lead to state q) and
an edit of turn i follows ``[i + 1, q']``; an insertion leads from ``[i, q]`` to
``[i, q']``.  An item's weight is (cost, audit): costs add up, the audit gains
the edit's initial.  Both functions are superior (an audit is below any that it
begins) and, as no two audits of one item and cost begin each other, monotone;
so the agenda, popped by least weight, finalises each item once, and the goal
first with the cheapest edits and among those the least audit.

Turns are dealt out by ranges of (conversation, turn, role, digest of the text) and
sorted; a task cuts them into *pieces* of bounded size.  A conversation that lies
inside a task is one piece and solved there.  One that is longer, or is cut by a
range, has each piece solved from every state (the chart of lightest weights from
state to state); the charts, without texts, are chained per conversation, and
each piece's share of the audit goes back to its turns.  So no task holds the
texts of a long conversation; the digest alone reads them in order, as a stream.
Repeated rows are counted before they are shuffled, and duplicates are found by
an aggregation.

Defined results: a null role or text counts as one blank; turns without number
come first; turns of one number are ordered by role, then by the text's SHA-256;
repeated rows are repeated turns (duplicates after the first); rows without
``conv_id`` are one conversation; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adflow.llm.base import Scratch, arrow_map, partitions

PIECE = 512                # turns solved at a time
PIECE_CHARS = 1 << 22      # characters of text in a piece; a longer turn is one alone
ROWS = 256                 # pieces that go out together
STATES = range(4)          # 0 nothing yet, 1 after s, 2 after u, 3 after a
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

Weight = tuple[int, str]
SPACE = " \t\n\v\f\r"


# -- the agenda ---------------------------------------------------------------------------------

def lightest(turns: list[tuple[str, str]], start: int = 0, goals: tuple[int, ...] = FINAL,
             every: bool = False) -> dict[int, Weight]:
    """Lightest (cost, audit) by end state, from ``start`` over ``turns`` (role's initial, fault).

    Only the lightest of ``goals``, or with ``every`` all states that can be reached.
    """
    n = len(turns)
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    out: dict[int, Weight] = {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n and (every or q in goals):
            out[q] = (cost, audit)
            if not every:
                return out
        for role in "ua":
            to = AFTER.get((q, role))
            if to is not None and (i, to) not in final:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, to))
        if i == n:
            continue
        initial, fault = turns[i]
        if (i + 1, q) not in final:
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
        if fault in ("blank", "duplicate"):
            continue
        more = TRUNCATED if fault == "truncated" else 0
        to = AFTER.get((q, initial))
        if to is not None:
            heapq.heappush(agenda, (cost + KEEP + more, audit + "K", i + 1, to))
        for role in "ua":
            to = AFTER.get((q, role))
            if to is not None:
                heapq.heappush(agenda, (cost + REROLE + more, audit + "R", i + 1, to))
    return out


def applied(turns: list[dict], start: int, audit: str) -> list[dict]:
    """The repaired turns (role, text, edit) that the edits of ``audit`` make of ``turns``."""
    out, q, rest = [], start, iter(turns)
    for edit in audit:
        turn = {"text": ""} if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            role = turn["role"]
            q = AFTER[q, role[:1]]
        else:
            initial = "a" if q == 2 else "u"
            role, q = NAMES[initial], AFTER[q, initial]
        out.append({"role": role, "text": turn["text"], "edit": edit})
    return out


# -- turns --------------------------------------------------------------------------------------

def _fault(text: str) -> str:
    seen = text.rstrip(SPACE)
    if not seen:
        return "blank"
    return "" if seen[-1] in ".!?" else "truncated"


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()),
    *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string()),
    ("chart", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ("turns", _TURNS)])
PIECES = ("conv_id long, part int, seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string, chart array<struct<start:int,end:int,cost:long,audit:string>>, "
          "turns array<struct<role:string,text:string>>")


def _pieces(batches: Iterator[pa.RecordBatch], most: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns, cut into solved pieces of at most ``most`` turns."""
    part, seq = TaskContext.get().partitionId(), 0
    now: tuple | None = None       # the conversation, as a tuple
    begun = False                  # its first turn is known to be in this task
    opened = False                 # some of its pieces have gone out
    turns: list[dict] = []
    faults: list[str] = []
    chars = 0

    out: list[dict] = []
    held = 0                       # characters in ``out``

    def piece(whole: bool) -> None:
        nonlocal seq, turns, faults, chars, opened, held
        initials = [t["role"][:1] for t in turns]
        items = list(zip(initials, faults, strict=True))
        chart = []
        for start in ((0,) if begun and not opened else STATES):
            for end, (cost, audit) in lightest(items, start, every=not whole).items():
                chart.append({"start": start, "end": end, "cost": cost, "audit": audit})
        row = {"conv_id": now[0], "part": part, "seq": seq, "whole": whole, "first": initials[0], "last": initials[-1],
               "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
               "chart": chart, "turns": turns, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}}
        out.append(row)
        held += chars
        seq, turns, faults, chars, opened = seq + 1, [], [], 0, True

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "again", "copies")]
        for conv, role, text, again, copies in zip(*columns, strict=True):
            if now != (conv,):
                if turns:
                    piece(whole=begun and not opened)
                begun, opened, now = now is not None, False, (conv,)
            fault = _fault(text)
            for copy in range(copies):
                if turns and (len(turns) >= most or chars + len(text) > most_chars):
                    piece(whole=False)
                if len(out) >= ROWS or held > most_chars:
                    yield pa.RecordBatch.from_pylist(out, _PIECES)
                    out, held = [], 0
                turns.append({"role": role, "text": text})
                faults.append("duplicate" if fault != "blank" and (again or copy) else fault)
                chars += len(text)
    if turns:   # the next task may go on with it
        piece(whole=False)
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECES)


CHAIN = ("conv_id long, part int, seq long, start int, cost long, audit string, "
         "blank long, duplicate long, truncated long, illegal long")
_CHAIN = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int32()), ("cost", pa.int64()),
                    ("audit", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Charts in order -> one row a conversation (``part`` null), and each piece's start state and share of the audit."""
    now: tuple | None = None

    def conversation() -> Iterator[pa.RecordBatch]:
        end = min((q for q in FINAL if q in best), key=lambda q: best[q])
        cost, audit = best[end]
        yield pa.RecordBatch.from_pylist([{"conv_id": now[0], "cost": cost, "audit": audit, **counts}], _CHAIN)
        q, rows = end, []
        for (part, seq), came in reversed(back):
            q, share = came[q]
            rows.append({"part": part, "seq": seq, "start": q, "audit": share})
        for at in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_pylist(rows[at:at + 1024], _CHAIN)

    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["conv_id"],):
                if now is not None:
                    yield from conversation()
                now, last = (row["conv_id"],), None
                best: dict[int, Weight] = {0: (0, "")}
                back: list[tuple] = []
                counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            new: dict[int, Weight] = {}
            came: dict[int, tuple[int, str]] = {}
            for edge in row["chart"]:
                if edge["start"] in best:
                    cost, audit = best[edge["start"]]
                    weight = cost + edge["cost"], audit + edge["audit"]
                    if edge["end"] not in new or weight < new[edge["end"]]:
                        new[edge["end"]], came[edge["end"]] = weight, (edge["start"], edge["audit"])
            best = new
            back.append(((row["part"], row["seq"]), came))
            for c in counts:
                counts[c] += row[c]
            counts["illegal"] += last is not None and last + row["first"] not in LEGAL
            last = row["last"]
    if now is not None:
        yield from conversation()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
    for batch in batches:
        done = [applied(*row) for row in zip(*[batch.column(c).to_pylist() for c in ("turns", "start", "audit")], strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "part", "seq", "whole")], pa.array(done, kind)],
                                         ["conv_id", "part", "seq", "whole", "repaired"])


class Repair:
    """A repaired table: ``summary`` (one row a conversation) and ``pieces`` of repaired turns."""

    def __init__(self, summary: DataFrame, pieces: DataFrame):
        self.summary, self.pieces = summary, pieces

    def turns(self) -> DataFrame:
        """``conv_id, part, seq, pos, role, text, edit``: the repaired turns, in order of part, seq, pos."""
        return (self.pieces.select("conv_id", "part", "seq", F.posexplode("repaired").alias("pos", "t"))
                .select("conv_id", "part", "seq", "pos", "t.role", "t.text", "t.edit"))

    def digests(self) -> DataFrame:
        """``conv_id, repaired_sha256``: of ``role:text`` per turn, newline-joined; conversations without turns have none."""
        lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        texts = self.pieces.where(F.size("repaired") > 0).select("conv_id", "part", "seq", "whole", lines.alias("lines"))
        whole = texts.where("whole").select("conv_id", F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))
        cut = (texts.where("not whole").select("conv_id", "part", "seq", "lines").repartition("conv_id")
               .sortWithinPartitions("conv_id", "part", "seq"))
        return whole.unionByName(arrow_map(cut, _digest, "conv_id long, repaired_sha256 string"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each conversation, as they pass by."""
    now, state = None, None
    row = lambda: pa.RecordBatch.from_arrays(
        [pa.array([now[0]], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])
    for batch in batches:
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if now != (conv,):
                if now is not None:
                    yield row()
                now, state = (conv,), hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(lines.encode())
    if now is not None:
        yield row()


def repair(turns: DataFrame, piece: int = PIECE, piece_chars: int = PIECE_CHARS) -> Repair:
    """Repair ``turns(conv_id, turn, role, text)``."""
    spark = turns.sparkSession
    scratch = Scratch(spark, "repair")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         blank("role"), blank("text"))
            .groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)))
    rows = scratch.write(rows, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")   # turns without number come first
    seen = (rows.groupBy("conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("earliest"))
            .where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "earliest"))
    order = ["conv_id", "turn", "role", "digest"]
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                     & (F.col("digest") == F.col("d")), "left")
    rows = rows.select(*order, "text", "copies", F.coalesce(place > F.col("earliest"), F.lit(False)).alias("again"))
    pieces = arrow_map(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order),
                       partial(_pieces, most=piece, most_chars=piece_chars), PIECES)
    pieces = scratch.write(pieces, "pieces")
    totals = ("blank", "duplicate", "truncated", "illegal")
    whole, cut = pieces.where("whole"), pieces.where("not whole")
    chained = scratch.write(arrow_map(
        cut.select("conv_id", "part", "seq", "first", "last", *totals, "chart").repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "seq"), _chain, CHAIN), "chained")
    only = F.col("chart")[0]
    summary = (whole.select("conv_id", *totals, only["cost"].alias("cost"), only["audit"].alias("audit"))
               .unionByName(chained.where("part is null").select("conv_id", *totals, "cost", "audit")))
    shares = chained.where("part is not null").select("part", "seq", "start", "audit")
    named = ["conv_id", "part", "seq", "whole", "turns", "start", "audit"]
    solved = whole.select(*named[:5], F.lit(0).alias("start"), only["audit"].alias("audit")).unionByName(
        cut.join(shares, ["part", "seq"]).select(*named))
    done = arrow_map(solved, _apply, "conv_id long, part int, seq long, whole boolean, "
                                     "repaired array<struct<role:string,text:string,edit:string>>")
    return Repair(summary, done)


# -- the query ------------------------------------------------------------------------------------

def damage(turns: DataFrame, kinds: int = 20) -> DataFrame:
    """``turns`` with rows dropped, emptied, cut short, repeated or given to the user by crc32 of ``conv_id:turn``."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % kinds
    text: Column = F.when(F.col("key") == 1, F.lit("")).when(
        F.col("key") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), key.alias("key"))
            .where("key <> 0")
            .select("conv_id", "turn", F.when(F.col("key") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.explode(F.when(F.col("key") == 3, F.array(F.lit(0), F.lit(1)))
                                                  .otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def repair_report(conversations: DataFrame, **how) -> DataFrame:
    """The columns of query ``op11_chat_repair``."""
    turns = damage(conversations)
    done = repair(turns, **how)
    numbered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn").groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (numbered, done.summary, done.digests()):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: crc32 by a table made of its polynomial; then the cheapest repair by a recursion over turns and states
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
              ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
damaged AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(s, ''), lambda ch: ord(ch)::BIGINT),
                            lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS k FROM keyed, crc),
turns AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM damaged WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM turns),
faulty AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
inserted(q, r, cost, audit, lines) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
         (0, 2, 5, 'I', 'user:'), (1, 2, 5, 'I', 'user:'), (3, 2, 5, 'I', 'user:'), (2, 3, 5, 'I', 'assistant:'),
         (0, 3, 10, 'II', E'user:\nassistant:'), (1, 3, 10, 'II', E'user:\nassistant:')),
after(q, c, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves AS (   -- of each turn, from each state: where it leads, what it costs and writes
  SELECT conv_id, i, q, q AS r, 2 AS cost, 'D' AS audit, '' AS line FROM faulty, (VALUES (0), (1), (2), (3)) s(q)
  UNION ALL
  SELECT conv_id, i, q, r, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', role || ':' || text
  FROM faulty JOIN after USING (c) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, q, r, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', CASE r WHEN 3 THEN 'assistant:' ELSE 'user:' END || text
  FROM faulty, (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) s(q, r) WHERE fault NOT IN ('blank', 'duplicate')),
best AS (
  SELECT conv_id, 0::BIGINT AS i, r AS q, {'cost': cost, 'audit': audit, 'lines': lines} AS w FROM counted, inserted WHERE inserted.q = 0
  UNION ALL
  SELECT conv_id, i, q, w FROM (
    SELECT b.conv_id, m.i, x.r AS q,
           {'cost': b.w.cost + m.cost + x.cost, 'audit': b.w.audit || m.audit || x.audit,
            'lines': array_to_string(list_filter([b.w.lines, m.line, x.lines], lambda p: p <> ''), E'\n')} AS w
    FROM best b JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 AND m.q = b.q JOIN inserted x ON x.q = m.r) z
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY w.cost, w.audit) = 1),
repaired AS (
  SELECT conv_id, arg_min(w, {'cost': w.cost, 'audit': w.audit}) AS w
  FROM (SELECT b.* FROM best b JOIN counted n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.n = b.i WHERE q IN (0, 3)) e GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0)::BIGINT AS cost,
       coalesce(w.audit, '') AS audit, sha256(coalesce(w.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
