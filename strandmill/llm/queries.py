"""The training-data problems as queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.runtime import keep, table
from . import distinct, frequent, mixing, percentiles, sampling, seen, spans, tokens

COMBINATIONS = [
    ["run_day"], ["instrument_id"], ["library_id"], ["run_day", "instrument_id"], ["run_day", "library_id"],
    ["instrument_id", "library_id"], ["run_day", "instrument_id", "library_id"], ["site"], ["model"], ["site", "model"],
]
PERCENTAGES = [0.05, 0.25, 0.5, 0.75, 0.9, 0.99]


#: Ends of the batches of p9_by_batch, by year of entry; what is left, also rows without a time, comes last.
YEARS = [2011, 2013, 2015]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The corpus; one of fewer splits than the session has cores is dealt out to all of them."""
    return table(spark, d, "documents", tasks=spark.sparkContext.defaultParallelism)


def _day() -> F.Column:
    return F.date_format("run_day", "yyyy-MM-dd").alias("run_day")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "fastq_reads").where("segment = 0"), "name", "read_id")


def p1_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_report(table(spark, d, "fastq_reads").where("segment = 0"), "name", "read_id")


def p1_rate_checked(spark: SparkSession, d: str) -> DataFrame:
    """What of the report doesn't depend on how the input lies in pieces, and whether fingerprints gave answers at all."""
    report = p1_error_rate(spark, d)
    answers = F.col("exact_in_piece") + F.col("exact_in_batch") + F.col("by_fingerprint") - F.col("wrong_answers")
    return report.select("lookups", answers.alias("repeats"), "wrong_answers", "measured_rate", (F.col("by_fingerprint") > 0).alias("by_fingerprint"))


def p1_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Day after day against the stored index of the days before; of 48 ranges, the index's own number."""
    found = seen.seen_by_piece(table(spark, d, "fastq_reads").where("segment = 0"), "name", "read_id", "run_day", ranges=48)
    return found.select(_day(), "read_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_values(table(spark, d, "fastq_reads"), "sequence", 0.01).select("sequence")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_values(table(spark, d, "fastq_reads"), "sequence", 0.001).select("sequence", "n")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    reads, keys = table(spark, d, "fastq_reads").where("segment = 0"), ["run_day", "instrument_id"]
    counts = distinct.count_groups(distinct.distinct_pairs(reads, ["name", "sequence"], keys), keys)
    return counts.where("n_values >= 30 and n_distinct * 2 < n_values").select(_day(), "instrument_id", "field")


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    pairs = distinct.distinct_pairs(table(spark, d, "fastq_reads"), ["name", "sequence"], ["run_day", "instrument_id", "library_id"])
    wide = pairs.join(table(spark, d, "instruments").select("instrument_id", "site", "model"), "instrument_id", "left")
    counts = distinct.count_combinations(wide, COMBINATIONS)
    return counts.withColumn("run_day", F.date_format("run_day", "yyyy-MM-dd"))


def p3_merged(spark: SparkSession, d: str) -> DataFrame:
    """Counts of instruments from partial results, one for each third of the days, stored and merged."""
    reads, keys = table(spark, d, "fastq_reads"), ["instrument_id"]
    parts = [keep(distinct.distinct_pairs(part, ["name", "sequence"], keys), "pairs") for part in _thirds(reads)]
    return distinct.count_groups(distinct.merge_pairs(parts, keys), keys)


def _thirds(rows: DataFrame) -> list[DataFrame]:
    """Rows in three pieces by day; those without a day are in the first."""
    third = F.coalesce(F.pmod(F.dayofmonth("run_day"), F.lit(3)), F.lit(0))
    return [rows.where(third == i) for i in range(3)]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = percentiles.percentiles(table(spark, d, "position_sums"), "error_probability_sum", ["run_day", "instrument_id"], [0.5, 0.9])
    return found.where("n_values >= 30 and p_90 >= 5 * p_50").select(_day(), "instrument_id")


def _p4(spark: SparkSession, d: str, key: str) -> DataFrame:
    found = percentiles.percentiles(table(spark, d, "position_sums"), "error_probability_sum", [key], PERCENTAGES)
    return found.select(key, "n_values", *[c for c in found.columns if c.startswith("p_")])


def p4_by_instrument(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d, "instrument_id")


def p4_by_position(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d, "pos_no")


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all values from partial results, one for each third of the days, stored and merged."""
    parts = [keep(percentiles.value_counts(part, "error_probability_sum", ["instrument_id"]), "counts") for part in _thirds(table(spark, d, "position_sums"))]
    found = percentiles.percentiles_of_counts(percentiles.merge_counts(parts), PERCENTAGES)
    return found.select(F.col("g.k0").alias("instrument_id"), "n_values", *[c for c in found.columns if c.startswith("p_")])


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.subsample_files(table(spark, d, "fastq_reads"), table(spark, d, "subsample_args"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each job, the records drawn, how often the most drawn one was, and whether all rows are of its file."""
    drawn = p5_sample(spark, d)
    reads = table(spark, d, "fastq_reads").select("read_id", F.col("file_id").alias("_file"), F.col("record_no").alias("_record"), F.col("segment").alias("_segment"))
    own = (F.col("file_id") == F.col("_file")) & (F.col("record_no") == F.col("_record")) & (F.col("segment") == F.col("_segment"))
    checked = drawn.join(reads, "read_id", "left").groupBy("job_id", "read_id").agg(F.count(F.lit(1)).alias("times"), F.first("record_no").alias("record_no"), F.min(F.coalesce(own, F.lit(False))).alias("own"))
    return checked.groupBy("job_id").agg(F.countDistinct("record_no").alias("records"), F.max("times").alias("most_times"), F.min("own").alias("of_its_file"))


def p5_refused(spark: SparkSession, d: str) -> DataFrame:
    return sampling.refused_jobs(table(spark, d, "subsample_args"), table(spark, d, "fastq_reads"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(_documents(spark, d))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each text from its token ids again, as a digest of its bytes."""
    decoded = tokens.decode_column(tokens.encode_column(_documents(spark, d)))
    return decoded.select("doc_id", F.md5("bytes").alias("digest"), F.length("bytes").cast("long").alias("n_bytes"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, d), table(spark, d, "mix_targets"))


def p8_shares_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each target: whether the share reached is within 0.02 of its own (of those with documents), and whether no document is used too often."""
    return _checked(p8_shares(spark, d), F.col("target_share") / F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0))))


def p8_whole_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each target of the mix of all tokens: whether it gives its share, or all it may if that is less."""
    report = p8_shares_whole(spark, d)
    return report.select(
        "source", "target_share", "max_repeats",
        F.when(F.col("short"), F.col("tokens") == F.col("available_tokens") * F.col("max_repeats")).otherwise(F.col("tokens") >= F.col("wanted_tokens") * 0.99).alias("met"),
        (F.col("most_uses") <= F.col("max_repeats")).alias("uses_kept"),
    )


def _checked(report: DataFrame, share: F.Column) -> DataFrame:
    expected = F.when(F.col("available_tokens") > 0, share).otherwise(F.lit(0.0))
    return report.select(
        "source", "target_share", "max_repeats", (F.abs(F.col("reached_share") - expected) < 0.02).alias("met"), (F.col("most_uses") <= F.col("max_repeats")).alias("uses_kept")
    )


def p8_mix_whole(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_whole(_documents(spark, d), table(spark, d, "mix_targets"))


def p8_shares_whole(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report_whole(_documents(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.pairs_of_records(*spans.shared_pairs(_documents(spark, d)))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_lengths(_documents(spark, d))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """A row per document instead of pairs: its class of equal texts, and the texts it shares a passage with."""
    return spans.class_rows(*spans.shared_pairs(_documents(spark, d)))


def p9_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """As p9_found, with the documents coming in batches by their time of entry to one stored index."""
    year, documents = F.year("ingested_at"), _documents(spark, d)
    bounds = [(None, YEARS[0]), *zip(YEARS, YEARS[1:])]
    batches = [documents.where((year < high) if low is None else (year >= low) & (year < high)) for low, high in bounds]
    batches.append(documents.where(year.isNull() | (year >= YEARS[-1])))
    return spans.pairs_of_records(*spans.shared_pairs_in_batches(batches))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_error_rate, p1_rate_checked, p1_by_day, p2_found, p2_counts, p3_found, p3_distinct, p3_merged, p4_found, p4_by_instrument, p4_by_position, p4_merged,
        p5_sample, p5_counts, p5_refused, p7_ids, p7_decoded, p8_mix, p8_shares, p8_shares_checked, p8_whole_checked, p8_mix_whole, p8_shares_whole, p9_found, p9_shared, p9_classes, p9_by_batch,
    )}


_PAIRS = """
    (SELECT run_day, instrument_id, library_id, 'name' AS field, name AS v, segment FROM fastq_reads
     UNION ALL SELECT run_day, instrument_id, library_id, 'sequence', sequence, segment FROM fastq_reads)
"""


def _combination(keys: list[str]) -> str:
    every = ["run_day", "instrument_id", "library_id", "site", "model"]
    shown = {"run_day": "strftime(run_day, '%Y-%m-%d')"}
    columns = ", ".join((f"{shown.get(k, k)} AS {k}" if k in keys else f"CAST(NULL AS VARCHAR) AS {k}") for k in every)
    return f"""
        SELECT '{",".join(keys)}' AS grouping, {columns}, field, count(*) AS n_values, count(DISTINCT v) AS n_distinct
        FROM wide WHERE v IS NOT NULL AND v <> '' GROUP BY {", ".join(keys)}, field
    """


def _quantiles(key: str) -> str:
    """Interpolation written out: the same arithmetic on both sides, to the last bit."""
    at = "CAST({p} AS DOUBLE) * (n - 1)"
    low, high = "v[CAST(floor({at}) AS BIGINT) + 1]", "v[CAST(ceil({at}) AS BIGINT) + 1]"
    columns = []
    for p in PERCENTAGES:
        place = at.format(p=p)
        x, y = low.format(at=place), high.format(at=place)
        columns.append(f"{x} + ({y} - {x}) * ({place} - floor({place})) AS {percentiles.percent_name(p)}")
    return f"""
        SELECT {key}, n AS n_values, {", ".join(columns)}
        FROM (SELECT {key}, count(*) AS n, list(error_probability_sum ORDER BY error_probability_sum) AS v FROM position_sums
            WHERE error_probability_sum IS NOT NULL AND NOT isnan(error_probability_sum) GROUP BY {key})
    """


def _frequent(percent: str, columns: str) -> str:
    return f"""
        SELECT {columns} FROM (SELECT sequence, count(*) AS n FROM fastq_reads WHERE sequence <> '' GROUP BY sequence)
        WHERE n >= {percent} * (SELECT count(*) FROM fastq_reads WHERE sequence <> '')
    """


# Every window of 200 characters of every long text, each hashed: nothing is chosen or left out.
_WINDOWS = """
    texts AS (SELECT md5_number(text) AS doc, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200 GROUP BY text),
    places AS (SELECT doc, text, unnest(range(length(text) - 199)) AS pos FROM texts),
    windows AS (SELECT doc, pos, md5_number(substr(text, pos + 1, 200)) AS w FROM places),
    common AS (SELECT w FROM windows GROUP BY w HAVING count(DISTINCT doc) > 1),
    hits AS (SELECT doc, pos, w FROM windows WHERE w IN (SELECT w FROM common)),
    members AS (SELECT doc_id, md5_number(text) AS doc FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
    linked AS (SELECT DISTINCT x.doc AS a, y.doc AS b FROM (SELECT DISTINCT doc, w FROM hits) x JOIN (SELECT DISTINCT doc, w FROM hits) y USING (w) WHERE x.doc <> y.doc)
"""
_SHARED_PAIRS = f"""
    WITH {_WINDOWS} SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM
    (SELECT a, b FROM linked UNION ALL SELECT doc, doc FROM texts) p JOIN members x ON x.doc = p.a JOIN members y ON y.doc = p.b WHERE x.doc_id < y.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT read_id FROM (SELECT read_id, min(read_id) OVER (PARTITION BY name) AS first FROM fastq_reads
            WHERE segment = 0 AND name <> '') WHERE read_id > first
        """,
        "p1_rate_checked": """
            SELECT count(*) AS lookups, count(*) - count(DISTINCT name) AS repeats, CAST(0 AS BIGINT) AS wrong_answers, CAST(0 AS DOUBLE) AS measured_rate,
            count(*) > 8192 AS by_fingerprint FROM fastq_reads WHERE segment = 0 AND name <> ''
        """,
        "p1_by_day": """
            SELECT strftime(run_day, '%Y-%m-%d') AS run_day, read_id FROM (SELECT run_day, read_id,
            row_number() OVER (PARTITION BY name ORDER BY run_day NULLS FIRST, read_id) AS n FROM fastq_reads WHERE segment = 0 AND name <> '') WHERE n > 1
        """,
        "p2_found": _frequent("0.01", "sequence"),
        "p2_counts": _frequent("0.001", "sequence, n"),
        "p3_found": f"""
            SELECT strftime(run_day, '%Y-%m-%d') AS run_day, instrument_id, field FROM {_PAIRS}
            WHERE segment = 0 AND v IS NOT NULL AND v <> '' GROUP BY ALL HAVING count(*) >= 30 AND 2 * count(DISTINCT v) < count(*)
        """,
        "p3_distinct": f"WITH wide AS (SELECT p.*, i.site, i.model FROM {_PAIRS} p LEFT JOIN instruments i USING (instrument_id)) "
        + " UNION ALL ".join(_combination(k) for k in COMBINATIONS),
        "p4_found": """
            SELECT strftime(run_day, '%Y-%m-%d') AS run_day, instrument_id FROM position_sums
            WHERE error_probability_sum IS NOT NULL AND NOT isnan(error_probability_sum) GROUP BY ALL
            HAVING count(*) >= 30 AND quantile_cont(error_probability_sum, 0.9) >= 5 * quantile_cont(error_probability_sum, 0.5)
        """,
        "p3_merged": f"""
            SELECT instrument_id, field, count(*) AS n_values, count(DISTINCT v) AS n_distinct FROM {_PAIRS} WHERE v IS NOT NULL AND v <> '' GROUP BY ALL
        """,
        "p4_merged": _quantiles("instrument_id"),
        "p5_counts": """
            SELECT job_id, least(record_count, records) AS records, CAST(1 AS BIGINT) AS most_times, true AS of_its_file FROM subsample_args
            JOIN (SELECT file_id, count(DISTINCT record_no) AS records FROM fastq_reads WHERE record_no IS NOT NULL GROUP BY file_id) USING (file_id)
            WHERE record_count > 0 AND probability IS NULL
        """,
        "p5_refused": """
            SELECT job_id, file_id, record_count, probability, CASE WHEN file_id IS NULL THEN 'file' WHEN record_count IS NULL OR record_count < 1 THEN 'count'
            WHEN probability IS NOT NULL THEN 'both' ELSE 'records' END AS reason FROM subsample_args WHERE file_id IS NULL OR record_count IS NULL OR record_count < 1
            OR probability IS NOT NULL OR file_id NOT IN (SELECT file_id FROM fastq_reads WHERE file_id IS NOT NULL AND record_no IS NOT NULL)
        """,
        "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
        "p8_shares_checked": "SELECT source, target_share, CAST(max_repeats AS BIGINT) AS max_repeats, true AS met, true AS uses_kept FROM mix_targets",
        "p8_whole_checked": "SELECT source, target_share, CAST(max_repeats AS BIGINT) AS max_repeats, true AS met, true AS uses_kept FROM mix_targets",
        "p4_by_instrument": _quantiles("instrument_id"),
        "p9_found": _SHARED_PAIRS,
        "p9_by_batch": _SHARED_PAIRS,
        "p9_classes": f"""
            WITH {_WINDOWS}, classes AS (SELECT doc, min(doc_id) AS class_id, count(*) AS class_size FROM members GROUP BY doc),
            links AS (SELECT a AS doc, count(*) AS links FROM linked GROUP BY a)
            SELECT doc_id, class_id, class_size, coalesce(links, 0) AS links FROM members JOIN classes USING (doc) LEFT JOIN links USING (doc)
        """,
        "p9_shared": f"""
            WITH {_WINDOWS}, classes AS (SELECT doc, min(doc_id) AS class_id, count(*) AS class_size FROM members GROUP BY doc),
            cover AS (SELECT doc, sum(least(200, coalesce(following - pos, 200))) AS covered FROM
                (SELECT doc, pos, lead(pos) OVER (PARTITION BY doc ORDER BY pos) AS following FROM hits) GROUP BY doc),
            told AS (SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(k.class_size, 1) AS class_size, coalesce(length(text), 0) AS n_chars,
                CAST(CASE WHEN k.class_size > 1 THEN length(text) ELSE coalesce(c.covered, 0) END AS BIGINT) AS shared_chars
                FROM documents d LEFT JOIN classes k ON d.doc_id IS NOT NULL AND length(text) >= 200 AND k.doc = md5_number(text) LEFT JOIN cover c ON c.doc = k.doc)
            SELECT *, CASE WHEN n_chars > 0 THEN shared_chars / n_chars ELSE 0.0 END AS shared_share FROM told
        """,
        "p4_by_position": _quantiles("pos_no"),
    }
