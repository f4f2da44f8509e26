"""Column expressions over byte strings, read names and quality scores."""

from .bytestrings import byte_length, display, from_bytes, to_bytes
from .names import check_allowlist_name, first_part, name_id, parse_separator
from .quality import error_probability, phred_score

__all__ = [
    "byte_length", "check_allowlist_name", "display", "error_probability", "first_part", "from_bytes", "name_id",
    "parse_separator", "phred_score", "to_bytes",
]
