"""Reading and writing FASTQ files, name lists, lint logs and raw copies."""

from .fastq import FastqSource, line_counts, read_fastq, read_segments, register, write_fastq, write_parts, write_segments
from .text import copy_bytes, read_log, read_names

__all__ = ["FastqSource", "copy_bytes", "line_counts", "read_fastq", "read_log", "read_names", "read_segments", "register", "write_fastq", "write_parts", "write_segments"]
