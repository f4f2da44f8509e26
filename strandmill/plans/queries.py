"""The core's queries over the test tables, with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestrings import display
from ..functions.names import first_part, name_id
from ..functions.quality import error_probability, phred_score
from ..operators import filters, lint, metrics, pairs, parsing, sampling, validators
from ..schema import as_reads
from ..sources import fastq, files, text
from ..streaming import reads as streams
from . import commands
from .runtime import keep, new_folder, remove, table

FILE = ["file_id"]
SEED = 7


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return as_reads(table(spark, d, "fastq_reads"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    out = _reads(spark, d)
    return out.select("read_id", "file_id", "record_no", "segment", *[display(F.col(c)).alias(c) for c in ("definition", "sequence", "plus_line", "quality")])


def name_rules(spark: SparkSession, d: str) -> DataFrame:
    definition = F.col("definition")
    return _reads(spark, d).select("read_id", display(first_part(definition)).alias("lint_name"), display(name_id(definition)).alias("allowlist_name"), display(first_part(definition, ":")).alias("colon_name"))


_VIOLATION = [*FILE, "segment", "record_no", "line_no", "col_no", "validator_code"]


def lint_reads(spark: SparkSession, d: str) -> DataFrame:
    """All rules over all files, pairs together."""
    return lint.lint(_reads(spark, d), paired=True, keys=FILE, staged=True).select(*_VIOLATION, "validator_name", "pass", "validator_rank")


def _lint(code: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        specs = [s for s in validators.SINGLE if s.code == code]
        return lint.single_violations(_reads(spark, d), specs, FILE).select(*_VIOLATION, "message")

    return run


def lint_p001(spark: SparkSession, d: str) -> DataFrame:
    return lint.pair_violations(_reads(spark, d), validators.PAIRED, 0, FILE).select(*_VIOLATION, "message")


def lint_s007_prefiltered(spark: SparkSession, d: str) -> DataFrame:
    """As lint_s007, by way of Bloom filters."""
    return lint.duplicate_names(_reads(spark, d), FILE, prefilter=True).select(*_VIOLATION, "message")


def lint_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the passes over all files read and found."""
    found = _reads(spark, d)
    return lint.totals(found, lint.lint(found, paired=True, keys=FILE), paired=True)


def lint_own_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of one's own, of records and of pairs, beside none of the built-in ones."""
    short = validators.ValidatorSpec("X001", "ShortSequence", "high", lambda field, failed: F.when(F.length(field("sequence")) < 20, failed(validators.SEQUENCE, 1, "short sequence")))
    order = validators.ValidatorSpec("X002", "NamesInOrder", "high", lambda field, failed: F.when(field("name_1") > field("name_2"), failed(validators.NAME, 1, "names out of order")))
    return lint.lint(_reads(spark, d), paired=True, keys=FILE, single=[short], mates=[order], duplicates=False).select(*_VIOLATION, "validator_name", "message")


def lint_s007(spark: SparkSession, d: str) -> DataFrame:
    return lint.duplicate_names(_reads(spark, d), FILE).select(*_VIOLATION, "message")


def lint_level_low(spark: SparkSession, d: str) -> DataFrame:
    return lint.lint(_reads(spark, d), single_level="low", keys=FILE).select(*_VIOLATION, "message")


def lint_counts(spark: SparkSession, d: str) -> DataFrame:
    return lint.lint(_reads(spark, d), paired=True, keys=FILE, staged=True).groupBy("validator_code").agg(F.count(F.lit(1)).alias("failure_count"))


def pair_parity(spark: SparkSession, d: str) -> DataFrame:
    two = table(spark, d, "fastq_reads").where("segment = 1").select("file_id").distinct()
    return pairs.parity(_reads(spark, d).join(two, "file_id", "left_semi"), FILE)


def filter_pattern(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_pattern(_reads(spark, d), "^TC", FILE).select("read_id", "file_id", "record_no", "segment")


def filter_posix(spark: SparkSession, d: str) -> DataFrame:
    """A pattern with POSIX classes."""
    return filters.filter_pattern(_reads(spark, d), "^[[:upper:]]+[[:^alnum:]]", FILE).select("read_id", "file_id", "record_no", "segment")


def filter_flags(spark: SparkSession, d: str) -> DataFrame:
    """A pattern with flags inside and a repeated repeat."""
    return filters.filter_pattern(_reads(spark, d), "^(?i)t(?-i:C)[^Nn](?:a{2}){2}++", FILE).select("read_id", "file_id", "record_no", "segment")


def filter_names_file(spark: SparkSession, d: str) -> DataFrame:
    """As filter_names, with the list read from a text file."""
    path = new_folder(spark, "names")
    lines = table(spark, d, "name_list").where("name IS NOT NULL").select("name")
    lines.coalesce(1).write.option("lineSep", "\n").text(path)
    try:
        names = keep(text.read_names(spark, path), "names")
    finally:
        remove(spark, path)
    named = _reads(spark, d).where(~((F.col("segment") == 0) & F.col("definition").rlike(_NO_NAME)))
    return filters.filter_names(named, names, FILE).select("read_id", "file_id", "record_no", "segment")


_NO_NAME = r"(?s)\A([/ ][^/ ]*)?\z"


def _through_files(spark: SparkSession, d: str, names: list[str], by_segment: bool = False, copied: bool = False) -> DataFrame:
    """All reads, in order of arrival, written as FASTQ files, one or one a segment, and read again."""
    paths = [new_folder(spark, "fastq") + name for name in names]
    copies = [new_folder(spark, "copy") + name for name in names] if copied else []
    numbered = _reads(spark, d).withColumn("record_no", F.col("read_id"))
    try:
        fastq.write_segments(numbered if by_segment else numbered.withColumn("segment", F.lit(0)), paths)
        for path, copy in zip(paths, copies):
            text.copy_bytes(path, copy)
        again = keep(fastq.read_segments(spark, copies or paths, split_bytes=1 << 20), "reads")
    finally:
        for path in paths + copies:
            files.remove(path)
    return again.select("record_no", *(["segment"] if by_segment else []), *[display(F.col(c)).alias(c) for c in ("definition", "sequence", "plus_line", "quality")])


def fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Through a plain file, which is read in splits."""
    return _through_files(spark, d, [".fastq"])


def fastq_gzip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Through a file of gzip members."""
    return _through_files(spark, d, [".fastq.gz"])


def fastq_copy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Through a raw copy of a file."""
    return _through_files(spark, d, [".fastq"], copied=True)


def fastq_segments_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Through a file for each segment, one of them compressed."""
    return _through_files(spark, d, [".1.fastq", ".2.fastq.gz"], by_segment=True)


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a plain and of a compressed file of all reads."""
    paths = [new_folder(spark, "lines") + name for name in (".fastq", ".fastq.gz")]
    try:
        for path in paths:
            fastq.write_fastq(_reads(spark, d).withColumn("record_no", F.col("read_id")), path)
        return keep(fastq.line_counts(spark, paths, 1 << 20).select(F.substring_index("path", ".", -1).alias("extension"), "lines"), "lines")
    finally:
        for path in paths:
            files.remove(path)


def _commanded(spark: SparkSession, d: str, work: Callable[[str, str], DataFrame | None]) -> DataFrame:
    """What a command makes of a file of all reads: the table it gives, or the file it writes."""
    source, target = new_folder(spark, "source") + ".fastq", new_folder(spark, "target") + ".fastq"
    try:
        fastq.write_fastq(_reads(spark, d).withColumn("record_no", F.col("read_id")), source)
        found = work(source, target)
        return keep(fastq.read_fastq(spark, target) if found is None else found, "made")
    finally:
        files.remove(source)
        files.remove(target)


def _as_shown(reads: DataFrame) -> DataFrame:
    return reads.select("record_no", *[display(F.col(c)).alias(c) for c in ("definition", "sequence", "plus_line", "quality")])


def command_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter command from file to file."""
    return _as_shown(_commanded(spark, d, lambda source, target: commands.filter_files(spark, [source], [target], sequence_pattern="^T(C|G)")))


def command_subsample(spark: SparkSession, d: str) -> DataFrame:
    """The subsample command from file to file, by an exact count."""
    def work(source: str, target: str) -> None:
        commands.subsample_files(spark, source, target, record_count=1000, seed=SEED)

    return _as_shown(_commanded(spark, d, work))


def command_lint(spark: SparkSession, d: str) -> DataFrame:
    """The lint command over a file."""
    return _commanded(spark, d, lambda source, _: commands.lint_files(spark, source)[0].select("line_no", "col_no", "validator_code", "message"))


def phred_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Each score of a quality byte as an error probability, and back."""
    scores = spark.range(94).select(F.col("id").cast("int").alias("score"))
    return scores.select("score", error_probability(F.col("score")).alias("probability"), F.round(phred_score(error_probability(F.col("score"))), 9).alias("again"))


def quality_undecodable(spark: SparkSession, d: str) -> DataFrame:
    """Records whose scores the mean quality refuses."""
    return metrics.undecodable(_every(_reads(spark, d)))

def filter_names(spark: SparkSession, d: str) -> DataFrame:
    named = _reads(spark, d).where(~((F.col("segment") == 0) & F.col("definition").rlike(_NO_NAME)))
    return filters.filter_names(named, as_list(table(spark, d, "name_list")), FILE).select("read_id", "file_id", "record_no", "segment")


def as_list(names: DataFrame) -> DataFrame:
    """The list's names in byte form."""
    from ..functions.bytestrings import from_bytes

    return names.select(from_bytes(F.col("name")).alias("name"))


def filter_missing_segments(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.filter_pattern(_reads(spark, d), "^TC", FILE)
    return filters.missing_segments(kept, 2, FILE).select("file_id", "record_no")


def sample_fraction(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_fraction(table(spark, d, "fastq_reads"), 0.33, SEED, FILE).select("read_id", "file_id", "record_no", "segment")


def _one_file(spark: SparkSession, d: str) -> DataFrame:
    """All reads as one file, numbered by arrival; mates lie in files of their own here."""
    return table(spark, d, "fastq_reads").select(F.col("read_id").alias("record_no"), F.lit(0).alias("segment"), "sequence", "quality")


def sample_exact(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_exact(_one_file(spark, d), 1000, SEED).select("record_no")


def sample_exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """An exact sample of all records as one file of pairs, mates together; a record delivered again counts once."""
    place = F.col("file_id") * 2**32 + F.col("record_no")  # all files as one
    once = table(spark, d, "fastq_reads").select(place.alias("record_no"), "segment").distinct()
    whole = once.join(once.where("segment = 0").select("record_no"), "record_no", "left_semi")  # lost first mates aren't records of a pair of files
    return sampling.sample_exact(whole.select("record_no", "segment"), 1000, SEED)


def describe_lengths(spark: SparkSession, d: str) -> DataFrame:
    return metrics.describe_lengths(_reads(spark, d))


def describe_files(spark: SparkSession, d: str) -> DataFrame:
    return metrics.describe_lengths(_reads(spark, d), ["file_id", "segment"])


def _every(reads: DataFrame) -> DataFrame:
    return reads.select(F.col("read_id").alias("record_no"), F.lit(0).alias("segment"), "sequence", "quality")


def _graphic(spark: SparkSession, d: str) -> DataFrame:
    """Reads as one file, less those with a quality byte that isn't graphic ASCII, as the SQL has it: fewer than the reference decodes."""
    return _every(_reads(spark, d).where(~F.col("quality").rlike("[\\x00-\\x20\\x7F-\\xFF]")))


def _rounded(described: DataFrame) -> DataFrame:
    return described.withColumn("avg_quality_score_per_position", F.concat_ws(",", F.transform("avg_quality_score_per_position", lambda x: F.format_string("%.6f", x))))


def describe_quality(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_quality(_graphic(spark, d)).withColumn("mean_quality", F.round("mean_quality", 6))


def describe(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.describe(_graphic(spark, d)))


def running_longest(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_longest(_graphic(spark, d)).select("record_no", "longest")


def describe_quality_all(spark: SparkSession, d: str) -> DataFrame:
    """Over all rows; only scores that the reference refuses are left out."""
    return metrics.mean_quality(_every(_reads(spark, d)), skip_invalid=True).withColumn("mean_quality", F.round("mean_quality", 6))


def describe_all(spark: SparkSession, d: str) -> DataFrame:
    """Over all rows; only scores that the reference refuses are left out."""
    return _rounded(metrics.describe(_every(_reads(spark, d)), skip_invalid=True))


def describe_more(spark: SparkSession, d: str) -> DataFrame:
    """With metrics of one's own beside the built-in ones."""
    bases = F.sum(F.length("sequence")).alias("x")
    more = [metrics.Metric("bases", bases), metrics.Metric("empty_sequences", F.count(F.when(F.col("sequence") == "", 1)))]
    return metrics.describe(_every(_reads(spark, d)), skip_invalid=True, more=more).drop("avg_quality_score_per_position")


def running_longest_all(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_longest(_every(_reads(spark, d))).select("record_no", "longest")


def names_loaded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "name_list").agg(F.countDistinct("name").alias("names"))


def stream_lint(spark: SparkSession, d: str) -> DataFrame:
    arriving = as_reads(streams.stream_reads(spark, f"{d}/fastq_reads.parquet"))
    return streams.collected(streams.lint_stream(arriving, keys=FILE)).select(*_VIOLATION, "message")


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    arriving = streams.stream_reads(spark, f"{d}/fastq_reads.parquet")
    counts = streams.collected(streams.windowed_counts(arriving, "received_at", keys=["instrument_id"]), "complete")
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def stream_repeated_names(spark: SparkSession, d: str) -> DataFrame:
    """Repeated names of a stream, with state; of each name the first read to arrive isn't there."""
    arriving = as_reads(streams.stream_reads(spark, f"{d}/fastq_reads.parquet"))
    found = streams.collected(streams.repeated_names(arriving, "read_id", "received_at", "36500 days", ranges=16))
    return found.select(display(F.col("name")).alias("name"), "read_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.split_loaded(parsing.parse_lines(table(spark, d, "lint_lines"), keep=["line_id"]))[1]


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    return parsing.split_loaded(parsing.parse_lines(table(spark, d, "lint_lines"), keep=["line_id", "file_id", "logged_at"]))[0].withColumn(
        "logged_at", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (
        reads, name_rules, lint_reads, lint_p001, lint_s007, lint_level_low, lint_counts, pair_parity, filter_pattern, filter_names,
        filter_missing_segments, sample_fraction, sample_exact, describe_lengths, describe_files, describe_quality, describe,
        running_longest, describe_quality_all, describe_all, running_longest_all, describe_more, names_loaded, lint_s007_prefiltered, lint_totals,
        lint_own_rules, filter_posix, filter_flags, filter_names_file, fastq_round_trip, fastq_gzip_round_trip,
        fastq_copy_round_trip, fastq_segments_round_trip, line_counts, command_filter, command_subsample, command_lint, phred_scalars, quality_undecodable, sample_exact_pairs, stream_lint, stream_daily, stream_repeated_names, p6_found, p6_loaded,
    )}
    return out | {f"lint_{s.code.lower()}": _lint(s.code) for s in validators.SINGLE}


_R = """r AS (SELECT read_id, file_id, record_no, segment, coalesce(definition, '') AS definition, coalesce(sequence, '') AS sequence,
    coalesce(plus_line, '') AS plus_line, coalesce(quality, '') AS quality, regexp_extract(coalesce(definition, ''), '^[^/ ]*') AS n FROM fastq_reads)"""


def _violation(code: str, line: str, col: str, where: str, message: str | None = "''", extra: str = "") -> str:
    shown = f", {message} AS message" if message else ""
    return f"""SELECT file_id, segment, record_no, record_no * 4 + {line} + 1 AS line_no, CAST({col} AS BIGINT) AS col_no,
        '{code}' AS validator_code{shown}{extra} FROM r WHERE {where}"""


# A character outside is shown as the first of its bytes.
_BYTE = "chr(CAST('0x' || substr(hex(encode(substr({0}, length(regexp_extract({0}, '{1}')) + 1, 1))), 1, 2) AS INTEGER))"
_BAD_BASE, _BAD_SCORE = _BYTE.format("sequence", "^[ACGTNacgtn]*"), _BYTE.format("quality", "^[!-~]*")

_RULES = {
    "S003": ("0", "1", "n NOT LIKE '@%'", "'missing @ prefix'"),
    "S004": (
        "CASE WHEN n = '' THEN 0 WHEN sequence = '' THEN 1 WHEN plus_line = '' THEN 2 ELSE 3 END", "1", "n = '' OR sequence = '' OR plus_line = '' OR quality = ''",
        "CASE WHEN n = '' THEN 'empty name' WHEN sequence = '' THEN 'empty sequence' WHEN plus_line = '' THEN 'empty plus line' ELSE 'empty quality' END",
    ),
    "S002": ("1", "length(regexp_extract(sequence, '^[ACGTNacgtn]*')) + 1", "NOT regexp_full_match(sequence, '[ACGTNacgtn]*')", f"'invalid sequence character: ''' || {_BAD_BASE} || ''''"),
    "S001": ("2", "1", "plus_line NOT LIKE '+%'", "'missing + prefix'"),
    "S005": ("1", "1", "strlen(sequence) <> strlen(quality)", "'sequence-quality scores lengths mismatch: expected ' || strlen(sequence) || ', got ' || strlen(quality)"),
    "S006": ("3", "length(regexp_extract(quality, '^[!-~]*')) + 1", "NOT regexp_full_match(quality, '[!-~]*')", f"'invalid quality score character: ''' || {_BAD_SCORE} || ''''"),
}

_PAIRS = f"""WITH {_R}, p AS (SELECT file_id, record_no, max(n) FILTER (segment = 0) AS n1, max(n) FILTER (segment = 1) AS n2 FROM r GROUP BY file_id, record_no)"""
_P001 = """SELECT file_id, 0 AS segment, record_no, record_no * 4 + 1 AS line_no, CAST(1 AS BIGINT) AS col_no, 'P001' AS validator_code"""
_S007 = """(SELECT *, min(record_no) OVER (PARTITION BY file_id, n) AS first FROM r WHERE segment = 0)"""
_NAMES = {"S003": "NameValidator", "S004": "CompleteValidator", "S002": "AlphabetValidator", "S001": "PlusLineValidator", "S005": "ConsistentSeqQualValidator", "S006": "QualityStringValidator"}


def _all_rules(columns: bool) -> str:
    extra = lambda name, at, rank: f", '{name}' AS validator_name, {at} AS pass, {rank} AS validator_rank"
    parts = [_violation(c, r[0], r[1], r[2], None, extra(_NAMES[c], 1, i)) for i, (c, r) in enumerate(_RULES.items())]
    parts.append(f"{_P001}{extra('NamesValidator', 1, 6)} FROM p WHERE n1 <> n2")
    parts.append(f"""SELECT file_id, 0, record_no, record_no * 4 + 1, CAST(1 AS BIGINT), 'S007'{extra("DuplicateNameValidator", 2, 0)} FROM {_S007} WHERE record_no > first""")
    return f"{_PAIRS} " + " UNION ALL ".join(parts)


def _digits(key: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:' || {key}), 1, 13) AS BIGINT)"


_GRAPHIC = f"""{_R}, g AS (SELECT read_id AS record_no, sequence, quality, max(strlen(sequence)) OVER (ORDER BY read_id ROWS UNBOUNDED PRECEDING) AS longest
    FROM r WHERE NOT regexp_matches(quality, '[^!-~]')),
    q AS (SELECT p AS position, round(-10 * log10(avg(pow(10, -(ascii(substr(quality, CAST(p + 1 AS INTEGER), 1)) - 33) / 10.0))), 6) AS mean_quality
    FROM (SELECT quality, unnest(range(CAST(least(length(quality), longest) AS BIGINT))) AS p FROM g) GROUP BY p)"""


# All rows, byte by byte; those with a byte that the reference refuses have no scores.
_BYTES = f"""{_R}, l AS (SELECT read_id AS record_no, sequence, hex(encode(quality)) AS h, max(strlen(sequence)) OVER (ORDER BY read_id ROWS UNBOUNDED PRECEDING) AS longest FROM r),
    q AS (SELECT p AS position, round(-10 * log10(avg(pow(10, -(CAST('0x' || substr(h, CAST(2 * p + 1 AS INTEGER), 2) AS INTEGER) - 33) / 10.0))), 6) AS mean_quality
    FROM (SELECT h, unnest(range(CAST(least(length(h) // 2, longest) AS BIGINT))) AS p FROM l
        WHERE NOT regexp_matches(left(h, CAST(2 * longest AS INTEGER)), '^([0-9A-F]{{2}})*([01][0-9A-F]|20)')) GROUP BY p)"""
_LENGTHS = "count(*) AS record_count, min(strlen(sequence)) AS min_sequence_length, max(strlen(sequence)) AS max_sequence_length"


def _filtered(chosen: str, records: str = "r") -> str:
    """Records of segment 0 for which ``chosen`` holds, and the rows of other segments at their places."""
    return f"""f AS (SELECT * FROM {records} WHERE segment = 0 AND {chosen}) SELECT read_id, file_id, record_no, segment FROM f UNION ALL
        SELECT read_id, file_id, record_no, segment FROM r WHERE segment <> 0 AND (file_id, record_no) IN (SELECT (file_id, record_no) FROM f)"""


_CUT = lambda c: f"regexp_replace({c}, chr(13) || '$', '') AS {c}"  # noqa: E731  a carriage return before a line's end goes
_ROUND_TRIP = f"WITH {_R} SELECT row_number() OVER (ORDER BY read_id) - 1 AS record_no, {', '.join(map(_CUT, ('definition', 'sequence', 'plus_line', 'quality')))} FROM r"
_LINES = ("definition", "sequence", "plus_line", "quality")
# The same as one file: a line feed ends a line, and a carriage return before it goes.
_FILE = f"""r AS (SELECT *, regexp_extract(definition, '^[^/ ]*') AS n FROM (SELECT 0 AS file_id, 0 AS segment, row_number() OVER (ORDER BY read_id) - 1 AS record_no,
    {', '.join(_CUT(f"coalesce({c}, '')").replace(f"AS coalesce({c}, '')", f"AS {c}") for c in _LINES)} FROM fastq_reads))"""


def _written(chosen: str) -> str:
    """The records of a file that a command writes, numbered anew."""
    return f"WITH {_FILE} SELECT row_number() OVER (ORDER BY record_no) - 1 AS record_no, {', '.join(_LINES)} FROM r WHERE {chosen}"


# A name is the definition without its first byte, so one whose first character has more bytes is no listed name.
_NAMED = "NOT regexp_full_match(definition, '([/ ][^/ ]*)?') AND strlen(left(definition, 1)) = 1 AND regexp_replace(substr(definition, 2), '[/ ][^/ ]*$', '') IN"


def oracle_sql() -> dict[str, str]:
    out = {f"lint_{c.lower()}": f"WITH {_R} {_violation(c, *r)}" for c, r in _RULES.items()}
    s007 = f"""WITH {_R} SELECT file_id, 0 AS segment, record_no, record_no * 4 + 1 AS line_no, CAST(1 AS BIGINT) AS col_no, 'S007' AS validator_code,
            'duplicate name: ''' || n || '''' AS message FROM {_S007} WHERE record_no > first"""
    return out | {
        "lint_s007_prefiltered": s007,
        "reads": f"WITH {_R} SELECT read_id, file_id, record_no, segment, definition, sequence, plus_line, quality FROM r",
        "name_rules": f"""WITH {_R} SELECT read_id, n AS lint_name,
            repeat(chr(65533), strlen(left(definition, 1)) - 1) || regexp_replace(substr(definition, 2), '[/ ][^/ ]*$', '') AS allowlist_name,
            split_part(definition, ':', 1) AS colon_name FROM r""",
        "lint_reads": _all_rules(True),
        "lint_counts": f"SELECT validator_code, count(*) AS failure_count FROM ({_all_rules(True)}) GROUP BY validator_code",
        "lint_totals": f"""WITH v AS ({_all_rules(True)}) SELECT p AS pass, (SELECT count(*) FROM fastq_reads WHERE segment = 0) AS record_count,
            (SELECT count(*) FROM v WHERE pass = p) AS failure_count FROM (SELECT unnest([1, 2]) AS p)""",
        "lint_own_rules": f"""{_PAIRS} {_violation("X001", "1", "1", "strlen(sequence) < 20", "'short sequence'", ", 'ShortSequence' AS validator_name")}
            UNION ALL SELECT file_id, 0, record_no, record_no * 4 + 1, CAST(1 AS BIGINT), 'X002', 'names out of order', 'NamesInOrder' FROM p WHERE n1 > n2""",
        "filter_posix": f"WITH {_R}, {_filtered("regexp_matches(sequence, '^[[:upper:]]+[[:^alnum:]]')")}",
        "filter_flags": f"WITH {_R}, {_filtered("regexp_matches(sequence, '^[Tt]C[^Nn]((a|A){2}){2}')")}",
        "filter_names_file": f"WITH {_R}, {_filtered(_NAMED + " (SELECT regexp_replace(name, chr(13) || '$', '') FROM name_list WHERE name IS NOT NULL)")}",
        "fastq_round_trip": _ROUND_TRIP,
        "fastq_gzip_round_trip": _ROUND_TRIP,
        "fastq_copy_round_trip": _ROUND_TRIP,
        "fastq_segments_round_trip": _ROUND_TRIP.replace("OVER (ORDER BY read_id) - 1 AS record_no", "OVER (PARTITION BY segment ORDER BY read_id) - 1 AS record_no, segment"),
        "line_counts": "SELECT unnest(['fastq', 'gz']) AS extension, CAST(4 * count(*) AS BIGINT) AS lines FROM fastq_reads",
        "command_filter": _written("regexp_matches(sequence, '^T(C|G)')"),
        "command_subsample": _written(f"record_no IN (SELECT record_no FROM r ORDER BY {_digits('record_no')}, record_no LIMIT 1000)"),
        "command_lint": f"WITH {_FILE} SELECT line_no, col_no, validator_code, message FROM ({" UNION ALL ".join(_violation(c, *r) for c, r in _RULES.items())})",
        "phred_scalars": "SELECT CAST(s AS INTEGER) AS score, pow(10.0, -s / 10.0) AS probability, CAST(s AS DOUBLE) AS again FROM (SELECT unnest(range(94)) AS s)",
        "quality_undecodable": f"WITH {_BYTES} SELECT record_no FROM l WHERE regexp_matches(left(h, CAST(2 * longest AS INTEGER)), '^([0-9A-F]{{2}})*([01][0-9A-F]|20)')",
        "sample_exact_pairs": f"""WITH once AS (SELECT DISTINCT file_id * 4294967296 + record_no AS record_no, segment FROM fastq_reads)
            SELECT record_no, segment FROM once WHERE record_no IN (SELECT record_no FROM once WHERE segment = 0 ORDER BY {_digits("record_no")}, record_no LIMIT 1000)""",
        "describe_all": f"""WITH {_BYTES} SELECT {_LENGTHS}, (SELECT string_agg(printf('%.6f', coalesce(mean_quality, CAST('NaN' AS DOUBLE))), ',' ORDER BY position) FROM
            (SELECT unnest(range(CAST((SELECT max(longest) FROM l) AS BIGINT))) AS position) LEFT JOIN q USING (position)) AS avg_quality_score_per_position FROM l""",
        "describe_quality_all": f"""WITH {_BYTES} SELECT position, coalesce(mean_quality, CAST('NaN' AS DOUBLE)) AS mean_quality
            FROM (SELECT unnest(range(CAST((SELECT max(longest) FROM l) AS BIGINT))) AS position) LEFT JOIN q USING (position)""",
        "running_longest_all": f"WITH {_BYTES} SELECT record_no, longest FROM l",
        "describe_more": f"WITH {_R} SELECT {_LENGTHS}, sum(strlen(sequence)) AS bases, count(*) FILTER (sequence = '') AS empty_sequences FROM r",
        "lint_p001": f"{_PAIRS} {_P001}, 'names mismatch: expected ''' || n2 || ''', got ''' || n1 || '''' AS message FROM p WHERE n1 <> n2",
        "lint_s007": s007,
        "lint_level_low": f"WITH {_R} " + " UNION ALL ".join(_violation(c, *_RULES[c][:2], f"segment = 0 AND ({_RULES[c][2]})", _RULES[c][3]) for c in ("S004", "S001")),
        "pair_parity": f"""WITH {_R}, k AS (SELECT file_id, record_no, max(CAST(segment = 0 AS INT)) AS h1, max(CAST(segment = 1 AS INT)) AS h2 FROM r
            WHERE file_id IN (SELECT file_id FROM r WHERE segment = 1) AND segment IN (0, 1) GROUP BY file_id, record_no)
            SELECT file_id, min(record_no) AS first_unmatched, arg_min(CASE WHEN h1 = 0 THEN 0 ELSE 1 END, record_no) AS ended FROM k WHERE h1 <> h2 GROUP BY file_id""",
        "filter_pattern": f"""WITH {_R} SELECT read_id, file_id, record_no, segment FROM r WHERE segment = 0 AND sequence LIKE 'TC%' UNION ALL
            SELECT read_id, file_id, record_no, segment FROM r WHERE segment <> 0 AND (file_id, record_no) IN (SELECT (file_id, record_no) FROM r WHERE segment = 0 AND sequence LIKE 'TC%')""",
        "filter_names": f"WITH {_R}, {_filtered(_NAMED + ' (SELECT name FROM name_list)')}",
        "filter_missing_segments": f"""WITH {_R}, f AS (SELECT file_id, record_no FROM r WHERE segment = 0 AND sequence LIKE 'TC%')
            SELECT file_id, record_no FROM (SELECT DISTINCT file_id, record_no FROM f) WHERE (file_id, record_no) NOT IN (SELECT (file_id, record_no) FROM r WHERE segment <> 0)""",
        "sample_fraction": f"SELECT read_id, file_id, record_no, segment FROM fastq_reads WHERE {_digits('file_id' + chr(32) + '||' + chr(32) + chr(39) + ':' + chr(39) + ' || record_no')} / 4503599627370496.0 <= 0.33",
        "sample_exact": f"SELECT read_id AS record_no FROM fastq_reads ORDER BY {_digits('read_id')}, read_id LIMIT 1000",
        "describe_lengths": f"WITH {_R} SELECT count(*) AS record_count, min(strlen(sequence)) AS min_sequence_length, max(strlen(sequence)) AS max_sequence_length FROM r",
        "describe_files": f"WITH {_R} SELECT file_id, segment, count(*) AS record_count, min(strlen(sequence)) AS min_sequence_length, max(strlen(sequence)) AS max_sequence_length FROM r GROUP BY ALL",
        "describe_quality": f"WITH {_GRAPHIC} SELECT position, mean_quality FROM q",
        "describe": f"""WITH {_GRAPHIC} SELECT count(*) AS record_count, min(strlen(sequence)) AS min_sequence_length, max(strlen(sequence)) AS max_sequence_length,
            (SELECT string_agg(printf('%.6f', mean_quality), ',' ORDER BY position) FROM q) AS avg_quality_score_per_position FROM g""",
        "running_longest": f"WITH {_GRAPHIC} SELECT record_no, longest FROM g",
        "stream_lint": f"WITH {_R} " + " UNION ALL ".join(_violation(c, *r) for c, r in _RULES.items()),
        "stream_daily": """SELECT strftime(received_at, '%Y-%m-%d') AS window_start, instrument_id, count(*) AS record_count FROM fastq_reads
            WHERE received_at IS NOT NULL GROUP BY ALL""",
        "stream_repeated_names": f"""WITH {_R.replace("FROM fastq_reads", "FROM fastq_reads WHERE received_at IS NOT NULL AND segment = 0")}
            SELECT name, read_id FROM (SELECT n AS name, read_id, row_number() OVER (PARTITION BY n ORDER BY read_id) AS nth FROM r) WHERE nth > 1""",
        "names_loaded": "SELECT count(DISTINCT name) AS names FROM name_list",
        "p6_found": _P6 + "SELECT line_id, reason FROM judged WHERE reason <> ''",
        "p6_loaded": _P6 + """SELECT line_id, file_id, strftime(logged_at, '%Y-%m-%d %H:%M:%S.%f') AS logged_at, f[1] AS source, CAST(f[2] AS BIGINT) AS record_no, CAST(f[3] AS BIGINT) AS definition_end,
            CAST(f[4] AS BIGINT) AS sequence_end, CAST(f[5] AS BIGINT) AS plus_line_end, nullif(f[6], '') AS code, nullif(f[7], '') AS line_type,
            CAST(nullif(f[8], '') AS BIGINT) AS col_no, f[9] AS message FROM judged WHERE reason = ''""",
    }


_FIELD = '("([^"]|"")*"|[^",]*)'
_P6 = f"""WITH cut AS (SELECT *, CASE WHEN right(line_text, 1) = chr(13) THEN left(line_text, -1) ELSE line_text END AS t FROM lint_lines),
    split AS (SELECT *, regexp_full_match(t, '(?s){_FIELD}(,{_FIELD})*') AS quoted, regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS raw FROM cut),
    plain AS (SELECT *, list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM split),
    judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 9 THEN 'columns'
        WHEN f[1] = '' OR NOT (regexp_full_match(f[2], '[0-9]+') AND regexp_full_match(f[3], '[0-9]+') AND regexp_full_match(f[4], '[0-9]+') AND regexp_full_match(f[5], '[0-9]+')
            AND regexp_full_match(f[8], '[0-9]*')) THEN 'value'
        WHEN TRY_CAST(f[2] AS BIGINT) IS NULL OR NOT coalesce(0 < TRY_CAST(f[3] AS BIGINT) AND TRY_CAST(f[3] AS BIGINT) < TRY_CAST(f[4] AS BIGINT) AND TRY_CAST(f[4] AS BIGINT) < TRY_CAST(f[5] AS BIGINT), false) THEN 'value'
        WHEN f[8] <> '' AND NOT coalesce(TRY_CAST(f[8] AS BIGINT) > 0, false) THEN 'value'
        WHEN NOT ((f[6] = '' AND f[7] = '') OR (regexp_full_match(f[6], 'S00[1-7]|P001') AND f[7] IN ('Name', 'Sequence', 'PlusLine', 'Quality'))) THEN 'value'
        ELSE '' END AS reason FROM plain)
"""
