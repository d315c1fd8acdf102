"""Job configuration: the nine positional arguments of the ad job, as a record."""

from __future__ import annotations

from dataclasses import dataclass, replace

WINDOW_KINDS = ("tumbling", "sliding", "session")


def parse_bool(text: str) -> bool:
    """Lenient boolean: only 'true' (any case) is true, anything else false."""
    return str(text).strip().lower() == "true"


@dataclass(frozen=True)
class PipelineConfig:
    job_name: str = "advertising"
    brokers: str = "localhost:9092"
    source_topic: str = "ad-events"
    sink_topic: str = "ad-notifications"
    checkpoint_interval_ms: int = 30_000
    window_kind: str = "tumbling"
    window_size_ms: int = 60_000
    apply_join: bool = False
    apply_aggregate: bool = True
    watermark_delay_ms: int = 1_000
    starting_offsets: str = "latest"

    def __post_init__(self):
        validate_window(self.window_kind, self.window_size_ms)
        if self.checkpoint_interval_ms <= 0:
            raise ValueError("checkpoint interval must be positive")
        if self.starting_offsets not in ("latest", "earliest"):
            raise ValueError("starting_offsets must be 'latest' or 'earliest'")

    @classmethod
    def from_args(cls, args: list[str]) -> "PipelineConfig":
        if len(args) != 9:
            raise ValueError(
                f"the job takes nine arguments, not {len(args)}: name, brokers, source topic, sink topic, "
                "checkpoint interval (ms), window kind, window size (ms), join, aggregate"
            )
        return cls(
            job_name=args[0],
            brokers=args[1],
            source_topic=args[2],
            sink_topic=args[3],
            checkpoint_interval_ms=int(args[4]),
            window_kind=args[5],
            window_size_ms=int(args[6]),
            apply_join=parse_bool(args[7]),
            apply_aggregate=parse_bool(args[8]),
        )

    def with_window(self, kind: str, size_ms: int) -> "PipelineConfig":
        return replace(self, window_kind=kind, window_size_ms=size_ms)


def validate_window(kind: str, size_ms: int) -> None:
    if kind not in WINDOW_KINDS:
        raise ValueError(f"{kind!r} is none of the window kinds {', '.join(WINDOW_KINDS)}")
    if size_ms <= 0:
        raise ValueError("window size must be positive")
    if kind == "sliding" and size_ms // 5 <= 0:
        raise ValueError("sliding window size must be at least 5 ms (slide = size / 5)")


# Named presets of the experiment (fixed values of the reference setup).
PRESET_A = PipelineConfig(
    checkpoint_interval_ms=30_000,
    window_kind="tumbling",
    window_size_ms=60_000,
    apply_join=False,
    apply_aggregate=True,
)
PRESET_B = PipelineConfig(
    checkpoint_interval_ms=5_000,
    window_kind="sliding",
    window_size_ms=10_000,
    apply_join=True,
    apply_aggregate=True,
)
