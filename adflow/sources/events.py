"""Ad events: Kafka-shaped source, JSON decode / encode, type filter, projection.

Wire rows have the Kafka column shape ``(key, value, timestamp, partition,
offset)``; the value is a JSON object whose three fields are strings:
``{"ts": "<epoch ms>", "id": "<ad id>", "et": "<event type>"}``.
The record timestamp is the event time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adflow.functions.counting import counted

WIRE_COLUMNS = ("key", "value", "timestamp", "partition", "offset")


def read_events(
    spark: SparkSession,
    fmt: str,
    options: dict[str, str] | None = None,
    path: str | None = None,
    schema: str | None = None,
    streaming: bool = False,
    starting_offsets: str = "latest",
) -> DataFrame:
    """Open the ad-event source.

    ``fmt='kafka'`` reads one topic (``options`` carries ``kafka.bootstrap.servers``
    and ``subscribe``); file formats (parquet/json) replay rows of the same wire
    shape, which is how the tests drive it (no Kafka connector in this image).
    """
    opts = dict(options or {})
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        opts.setdefault("startingOffsets", starting_offsets)
        df = reader.format("kafka").options(**opts).load()
        return df.select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            "timestamp", "partition", "offset",
        )
    reader = reader.format(fmt).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def _string_field(name: str) -> Column:
    """The JSON string at ``name`` of the variant ``__doc``; null when it is missing or of another kind."""
    field = F.try_variant_get("__doc", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get("__doc", f"$.{name}", "string"))


def _once(df: DataFrame, keep: list[str], name: str, value: Column) -> DataFrame:
    """``keep`` and ``value`` as column ``name``, worked out once a row: a generator is not merged into what reads it."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _parsed(df: DataFrame) -> DataFrame:
    """``df`` plus ``__event`` ``(ts, id, et)``, null when the record is malformed.

    All three fields must be JSON strings and ``ts`` a whole number in decimal
    digits (an optional sign, no blanks) that fits a long.  Each record is parsed
    once and each field read once.
    """
    doc = _once(df, df.columns, "__doc", F.try_parse_json(F.col("value").cast("string")))
    text = _once(doc, df.columns, "__text", F.struct(*[_string_field(n).alias(n) for n in ("ts", "id", "et")]))
    ts = F.when(F.col("__text.ts").rlike("^[+-]?[0-9]+$"), F.expr("try_cast(__text.ts AS BIGINT)"))
    event = F.struct(ts.alias("ts"), F.col("__text.id").alias("id"), F.col("__text.et").alias("et"))
    whole = ts.isNotNull() & F.col("__text.id").isNotNull() & F.col("__text.et").isNotNull()
    return _once(text, df.columns, "__event", F.when(whole, event))


def decode(df: DataFrame, mode: str = "failfast", skipped: str | Observation | None = None) -> DataFrame:
    """JSON value -> ``(ad_id, ts, et, event_time)``.

    ``failfast``: any malformed record fails the job, whichever columns are read
    later.  The check is a row predicate and also stands before every output
    column, so neither column pruning nor the order of filters can skip it.
    ``permissive``: malformed records are dropped here and returned by
    :func:`quarantined`; ``skipped`` counts them (``rows``: records, ``malformed``).
    Event time is the record ``timestamp`` when present, else ``ts``.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode must be 'failfast' or 'permissive'")
    staged = _parsed(df)
    event = F.col("__event")
    if mode == "failfast":
        stop = F.raise_error(F.concat(F.lit("malformed ad event: "), F.coalesce(F.col("value").cast("string"), F.lit("null"))))
        staged = staged.where(F.when(event.isNull(), stop.cast("boolean")).otherwise(F.lit(True)))
        event = F.when(event.isNull(), stop.cast("struct<ts:bigint,id:string,et:string>")).otherwise(event)
    else:
        staged = counted(staged, skipped, malformed=event.isNull()).where(event.isNotNull())
    has_record_time = "timestamp" in df.columns
    event_time = F.col("timestamp").cast("timestamp") if has_record_time else F.timestamp_millis(event["ts"])
    return staged.select(event["id"].alias("ad_id"), event["ts"].alias("ts"), event["et"].alias("et"),
                         event_time.alias("event_time"))


def decode_all(df: DataFrame) -> DataFrame:
    """Every record as ``wire`` (its columns) and ``event`` ``(ad_id, ts, et, event_time)``, null when malformed."""
    staged = _parsed(df)
    e = F.col("__event")
    time = F.col("timestamp").cast("timestamp") if "timestamp" in df.columns else F.timestamp_millis(e["ts"])
    event = F.struct(e["id"].alias("ad_id"), e["ts"].alias("ts"), e["et"].alias("et"), time.alias("event_time"))
    return staged.select(F.struct(*df.columns).alias("wire"), F.when(e.isNotNull(), event).alias("event"))


def quarantined(df: DataFrame) -> DataFrame:
    """The records :func:`decode` cannot turn into an ad event (wire columns kept)."""
    keep = [c for c in WIRE_COLUMNS if c in df.columns]
    return _parsed(df).where(F.col("__event").isNull()).select(*keep)


def encode(df: DataFrame) -> DataFrame:
    """``(ad_id, ts, et)`` -> Kafka rows ``(key, value, timestamp)``; ts travels as a digit string."""
    value = F.to_json(F.struct(
        F.col("ts").cast("string").alias("ts"),
        F.col("ad_id").alias("id"),
        F.col("et").alias("et"),
    ))
    return df.select(
        F.col("ad_id").alias("key"),
        value.alias("value"),
        F.timestamp_millis(F.col("ts")).alias("timestamp"),
    )


def of_type(df: DataFrame, et: str) -> DataFrame:
    """Case-sensitive event-type filter (pushed into the scan by Catalyst)."""
    return df.where(F.col("et") == F.lit(et))


def project(df: DataFrame) -> DataFrame:
    """Keep ``(ad_id, ts)`` plus the event-time column the windows need."""
    cols = ["ad_id", "ts"] + (["event_time"] if "event_time" in df.columns else [])
    return df.select(*cols)


def with_event_time(df: DataFrame, delay_ms: int | None = None,
                    ts_col: str = "ts") -> DataFrame:
    """Ensure a TIMESTAMP ``event_time`` (whole seconds kept as given) and, for
    streams, a bounded-out-of-orderness watermark of ``delay_ms``."""
    if "event_time" not in df.columns:
        df = df.withColumn("event_time", F.timestamp_millis(F.col(ts_col)))
    else:
        df = df.withColumn("event_time", F.col("event_time").cast("timestamp"))
    if delay_ms is not None:
        df = df.withWatermark("event_time", f"{int(delay_ms)} milliseconds")
    return df
