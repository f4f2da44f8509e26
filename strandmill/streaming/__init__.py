"""The same transformations over reads that keep arriving."""

from .reads import collected, lint_stream, repeated_names, stream_reads, windowed_counts

__all__ = ["collected", "lint_stream", "repeated_names", "stream_reads", "windowed_counts"]
