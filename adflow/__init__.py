"""adflow: ad-stream and time-series analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function.  The ads half
works on batch and streaming input alike; the series / metrics / profiles half
works on long tables keyed by ``(series_id, ts)``.
"""

from adflow.session import get_session, scratch_dir  # noqa: F401

__all__ = ["get_session", "scratch_dir"]
