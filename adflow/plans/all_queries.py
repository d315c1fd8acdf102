"""Import every query module so the registry is complete."""

from adflow.plans import ads_queries  # noqa: F401
from adflow.plans import series_queries  # noqa: F401
from adflow.plans import metric_queries  # noqa: F401
from adflow.plans import stream_queries  # noqa: F401
