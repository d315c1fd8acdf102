"""Session join of views and clicks on a stream, with bounded state rows.

A session's end is not known before the watermark has passed it, so its clicks
have to wait.  Ads are dealt by hash into ``GROUPS`` groups, and a group is one key
of the state, so a micro-batch costs state calls and data frames by the rows of
its groups and not by its ads.  A group's events wait in map state, in rows of at
most ``CHUNK`` entries: open sessions as ``(ad, start, last event)``, view counts per
``(bucket, ad, campaign)`` and click times per ``(bucket, ad)``, in order of time, the
latter two under the buckets that a row spans.  A bucket is as long as the gap, so
an ad's events in it are of one session, and sessions that meet are joined by their
bounds alone: nothing stored is moved.  A pair needs nothing of its view but the
campaign, so views are counts.  A timer of a group goes off when the watermark
passes the end of its first session: the pairs of all sessions that are over are
written, from the rows that span their buckets, and taken out of those rows.

``applyInPandas``-style state is used because Spark's session aggregate holds a
session in one row, and a stream-stream join cannot tell when a click of an open
session may be dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = 128         # of ads, for the life of a stream
CHUNK = 512          # sessions, view counts or click times in one state row
PAIRS = 1 << 15      # pairs in one batch to the JVM

PAIR_SCHEMA = "campaign_id string, ad_id string, ts_clicked long, window struct<start: timestamp, end: timestamp>"


def state_delay(delay_ms: int, gap_ms: int) -> int:
    """The watermark delay that :func:`session_pairs` needs so that ``delay_ms`` of disorder are borne.

    An event is late only if a session of its own would be over, which is a gap
    after the event; the operator itself drops events before the watermark.
    """
    return delay_ms + gap_ms


def _processor(gap_us: int, chunk: int, pairs: int):
    """The state processor's class, made in here so that it travels to the executors by value."""
    import json

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    def coded(names):
        """A number per name, and the names (null is one) in order of number."""
        codes, held = pd.factorize(np.asarray(names, dtype=object), use_na_sentinel=False)
        return codes, np.array([None if pd.isna(x) else x for x in held], dtype=object)

    def packed(names):
        codes, held = coded(names)
        return json.dumps(held.tolist()).encode(), codes.astype(np.int32).tobytes()

    def unpacked(held, codes):
        return np.array(json.loads(held), dtype=object)[np.frombuffer(codes, np.int32)]

    def longs(column):
        return column.astype(np.int64).tobytes()

    def joined(ads, start, last):
        """Spans of each ad that lie within the gap, as one."""
        codes, names = coded(ads)
        order = np.lexsort((start, codes))
        codes, start, last = codes[order], start[order], last[order]
        reach = pd.Series(last).groupby(codes).cummax().to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (start[1:] - reach[:-1] > gap_us)]))
        return names[codes[first]], start[first], np.maximum.reduceat(last, first)

    class Over:
        """Sessions that are over, to be found by ad and bucket."""

        def __init__(self, ads, start, last):
            self.codes, self.names = coded(ads)
            order = np.lexsort((start, self.codes))
            self.codes, self.start, self.last = self.codes[order], start[order], last[order]
            low, self.high = self.start // gap_us, self.last // gap_us
            self.index = {name: n for n, name in enumerate(self.names)}
            self.lows = np.unique(low)
            self.width = len(self.lows) + 1
            self.place = self.codes * self.width + np.searchsorted(self.lows, low) + 1
            by = np.argsort(low, kind="stable")
            self.begins, self.reach = low[by], np.maximum.accumulate(self.high[by])

        def touches(self, low, high):
            """Whether a session has buckets in common with these."""
            before = np.searchsorted(self.begins, high, side="right")
            return before > 0 and self.reach[before - 1] >= low

        def find(self, held, codes, bucket):
            """The session of each entry, or -1."""
            code = np.array([self.index.get(name, -1) for name in json.loads(held)], np.int64)[np.frombuffer(codes, np.int32)]
            rank = np.searchsorted(self.lows, bucket, side="right")
            at = np.maximum(np.searchsorted(self.place, code * self.width + rank, side="right") - 1, 0)
            return np.where((code >= 0) & (self.codes[at] == code) & (self.start[at] // gap_us <= bucket) & (bucket <= self.high[at]), at, -1)

    class SessionPairs(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            span = "low long, high long, number long"
            self.open = handle.getMapState("open", "number long", "ads binary, codes binary, start binary, last binary")
            self.views = handle.getMapState("views", span, "ads binary, codes binary, bucket binary, campaigns binary, "
                                                           "campaign_codes binary, n binary")
            self.clicks = handle.getMapState("clicks", span, "ads binary, codes binary, bucket binary, ts binary")
            self.numbers = handle.getValueState("numbers", "next long")

        def handleInputRows(self, key, rows, timerValues):
            spans = []
            number = self.numbers.get()[0] if self.numbers.exists() else 0
            for pdf in rows:
                pdf = pdf.sort_values("t", kind="stable")
                ads, t, ts = pdf["ad_id"].to_numpy(object), pdf["t"].to_numpy(), pdf["ts"].to_numpy()
                bucket, view = t // gap_us, pdf["is_view"].to_numpy().astype(bool)
                spans.append(joined(ads, t, t))
                if view.any():
                    own = pd.DataFrame({"bucket": bucket[view], "ad": ads[view], "campaign": pdf["campaign_id"].to_numpy(object)[view]})
                    counts = own.groupby(["bucket", "ad", "campaign"], dropna=False, sort=False).size().reset_index(name="n")
                    counts = [counts[c].to_numpy() for c in ("bucket", "ad", "campaign", "n")]   # in order of bucket
                    for k in range(0, len(counts[0]), chunk):
                        self._put_views(number, *[c[k:k + chunk] for c in counts])
                        number += 1
                bucket, ads, ts = bucket[~view], ads[~view], ts[~view]
                for k in range(0, len(ts), chunk):
                    self._put_clicks(number, bucket[k:k + chunk], ads[k:k + chunk], ts[k:k + chunk])
                    number += 1
            self.numbers.update((number,))
            if spans:
                self._hold(*joined(*[np.concatenate(c) for c in zip(self._held(), *spans, strict=True)]))
            return iter([])

        def _put_views(self, number, bucket, ads, campaigns, n) -> None:
            self.views.updateValue((int(bucket.min()), int(bucket.max()), number),
                                   (*packed(ads), longs(bucket), *packed(campaigns), longs(n)))

        def _put_clicks(self, number, bucket, ads, ts) -> None:
            self.clicks.updateValue((int(bucket.min()), int(bucket.max()), number), (*packed(ads), longs(bucket), longs(ts)))

        def _held(self):
            """Ad, start and last event of the open sessions."""
            parts = [(unpacked(v[0], v[1]), np.frombuffer(v[2], np.int64), np.frombuffer(v[3], np.int64)) for v in self.open.values()]
            none = np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return [np.concatenate(c) for c in zip(none, *parts, strict=True)]

        def _hold(self, ads, start, last) -> None:
            """These sessions are open, and no others; a timer for the first to end."""
            self.open.clear()
            for k in range(0, len(ads), chunk):
                own = slice(k, k + chunk)
                self.open.updateValue((k,), (*packed(ads[own]), longs(start[own]), longs(last[own])))
            if len(ads):
                self.handle.registerTimer(-(-int(last.min()) // 1000))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            ads, start, last = self._held()
            done = last <= timerValues.getCurrentWatermarkInMs() * 1000
            if not done.any():
                return
            over = Over(ads[done], start[done], last[done])
            self._hold(ads[~done], start[~done], last[~done])
            views = self._take_views(over)
            pieces, size = [], 0
            for own in [k for k in self.clicks.keys() if over.touches(k[0], k[1])]:
                held, codes, bucket, ts = self.clicks.getValue(own)
                bucket, ts = np.frombuffer(bucket, np.int64), np.frombuffer(ts, np.int64)
                at = over.find(held, codes, bucket)
                inside = at >= 0
                if not inside.any():
                    continue
                self.clicks.removeKey(own)
                if not inside.all():
                    self._put_clicks(own[2], bucket[~inside], unpacked(held, codes)[~inside], ts[~inside])
                for piece in self._pairs(at[inside], ts[inside], views):
                    pieces.append(piece)
                    size += len(piece[0])
                    if size >= pairs:
                        yield self._frame(over, views, pieces)
                        pieces, size = [], 0
            if size:
                yield self._frame(over, views, pieces)

        def _take_views(self, over):
            """Campaign and count of the views of sessions that are over, and where each session's begin and end."""
            found = [pd.DataFrame({"at": np.zeros(0, np.int64), "campaign": np.zeros(0, object), "n": np.zeros(0, np.int64)})]
            for own in [k for k in self.views.keys() if over.touches(k[0], k[1])]:
                held, codes, bucket, names, campaign_codes, n = self.views.getValue(own)
                bucket, n = np.frombuffer(bucket, np.int64), np.frombuffer(n, np.int64)
                at = over.find(held, codes, bucket)
                inside = at >= 0
                if not inside.any():
                    continue
                campaigns = unpacked(names, campaign_codes)
                found.append(pd.DataFrame({"at": at[inside], "campaign": campaigns[inside], "n": n[inside]}))
                self.views.removeKey(own)
                if not inside.all():
                    self._put_views(own[2], bucket[~inside], unpacked(held, codes)[~inside], campaigns[~inside], n[~inside])
            all_ = pd.concat(found).groupby(["at", "campaign"], dropna=False, sort=False)["n"].sum().reset_index().sort_values("at", kind="stable")
            at, session = all_["at"].to_numpy(), np.arange(len(over.start))
            return (all_["campaign"].to_numpy(object), all_["n"].to_numpy().astype(np.int64),
                    np.searchsorted(at, session), np.searchsorted(at, session, side="right"))

        def _pairs(self, at, ts, views):
            """Session, entry of ``views`` and click time of each pair, at most ``pairs`` at a time."""
            _, n, begin, end = views
            many = end[at] - begin[at]
            if not many.any():
                return
            click = np.repeat(np.arange(len(at)), many)
            entry = np.repeat(begin[at] - np.cumsum(many) + many, many) + np.arange(len(click))
            upto = np.cumsum(n[entry])
            for k in range(0, int(upto[-1]), pairs):
                row = np.searchsorted(upto, np.arange(k, min(k + pairs, int(upto[-1]))), side="right")
                yield at[click[row]], entry[row], ts[click[row]]

        def _frame(self, over, views, pieces):
            at, entry, ts = (np.concatenate(c) for c in zip(*pieces, strict=True))
            return pd.DataFrame({"campaign_id": views[0][entry], "ad_id": over.names[over.codes[at]], "ts_clicked": ts,
                                 "start": over.start[at], "end": over.last[at] + gap_us})

        def close(self) -> None:
            pass

    return SessionPairs()


def session_pairs(tagged: DataFrame, gap_ms: int, chunk: int = CHUNK, pairs: int = PAIRS,
                  groups: int = GROUPS) -> DataFrame:
    """Every view x click pair of a session of an ad, from a stream ``(ad_id, campaign_id, ts, event_time,
    is_view)`` whose watermark is as late as :func:`state_delay` says; written when the session is over."""
    rows = tagged.withColumn("t", F.unix_micros("event_time")).withColumn("ads", F.pmod(F.xxhash64("ad_id"), F.lit(groups)))
    out = rows.groupBy("ads").transformWithStateInPandas(
        statefulProcessor=_processor(gap_ms * 1000, chunk, pairs), outputMode="append", timeMode="eventTime",
        outputStructType="campaign_id string, ad_id string, ts_clicked long, start long, end long")
    window = F.struct(F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"))
    return out.select("campaign_id", "ad_id", "ts_clicked", window.alias("window"))
