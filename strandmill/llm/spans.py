"""Long exact spans shared between records, by a log-structured index of window hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import keep, new_folder, shuffle_partitions
from .prefilter import may_match
from .span_index import CROWD, PRINTS, SpanIndex, part_of
from .windows import chosen_windows, code_points, level_step, levels_needed, pieces, window_hashes

#: Characters a shared span has at least, and of the hashed windows inside it.
SPAN, GRAM = 200, 100

#: Pairs of one text verified by one task at most; those of a text in more are spread over several.
HOT_PAIRS = 10_000

#: Texts a task remembers, so that copies which lie together are hashed and sent once.
COPIES = 1 << 20


def fingerprints(texts: DataFrame, ranges: int, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Rows ``(part, hash, doc, context)``: the chosen windows of each text.  ``texts``: ``(doc, text)``.

    ``doc`` is a number of the text itself, so copies of a text give the same rows; a
    task gives them once.  A null or short text gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                new = []
                for doc, text in zip(ids.tolist(), batch.column(1).to_pylist()):
                    new.append("" if text is None or doc in known else text)
                    known.add(doc)
                if len(known) > COPIES:
                    known.clear()
                found: tuple[list, list, list] = ([], [], [])
                for numbers, parts in pieces(new, span):
                    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
                    ends = np.cumsum(lengths)
                    hashes, around, owner = chosen_windows(code_points("".join(parts)), ends - lengths, ends, span, gram)
                    for held, x in zip(found, (hashes, ids[np.asarray(numbers)[owner]], around)):
                        held.append(x)
                if found[0]:
                    h, d, c = (np.concatenate(x) for x in found)
                    yield pa.RecordBatch.from_arrays([pa.array(part_of(h, ranges)), pa.array(h), pa.array(d), pa.array(c)], names=PRINTS.names)

    return texts.select("doc", "text").mapInArrow(run, PRINTS)


def _refined(rows: DataFrame, texts: DataFrame, span: int, gram: int, all_pairs: bool) -> DataFrame:
    """Links of crowded windows: ``(a, b)`` only where what lies around the window agrees too.

    ``rows``: ``(doc, hash)``.  With ``all_pairs`` a key is the window with the levels
    around it that must agree, one for each way to part them into left and right: a few
    keys a window, and texts of one key have nearly a span in common.  Without it keys
    are whole spans around the window, and each text is linked to the least of its span
    alone, so that a phrase of very many texts makes no more links than texts.
    """
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("whole", T.LongType())])
    wanted = rows.groupBy("doc").agg(F.collect_set("hash").alias("hashes"))  # of one text: at most its windows
    step, needed = level_step(span, gram), levels_needed(span, gram)

    def keys(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not all_pairs:
            spans = window_hashes(codes, span).astype(np.int64)
            near = np.zeros(len(spans) + span, dtype=np.int64)
            np.add.at(near, np.maximum(0, at - (span - gram)), 1)
            np.add.at(near, at + 1, -1)
            return np.unique(spans[np.cumsum(near)[: len(spans)] > 0])
        wide = window_hashes(codes, gram + needed * step)
        out = []
        for left in range(needed + 1):
            first = at - left * step
            first = first[(first >= 0) & (first < len(wide))]
            out.append(wide[first] * np.uint64(2 * left + 1))
        return np.unique(np.concatenate(out)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, hashes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codes = code_points(text)
                h = (window_hashes(codes, gram) >> np.uint64(7)).astype(np.int64)
                found = keys(codes, np.flatnonzero(np.isin(h, np.asarray(hashes))))
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), doc), pa.int64()), pa.array(found)], names=["doc", "whole"])

    spans = may_match(texts, F.col("doc"), wanted, "doc").join(wanted, "doc").select("doc", "text", "hashes").mapInArrow(run, schema).distinct()
    if not all_pairs:
        least = spans.groupBy("whole").agg(F.min("doc").alias("a"))
        return spans.join(least, "whole").where(F.col("a") < F.col("doc")).select("a", F.col("doc").alias("b")).distinct()
    left, right = spans.select("whole", F.col("doc").alias("a")), spans.select("whole", F.col("doc").alias("b"))
    return left.join(right, "whole").where(F.col("a") < F.col("b")).select("a", "b").distinct()


Prepared = tuple[np.ndarray, np.ndarray, np.ndarray]


def prepared(text: str, span: int) -> Prepared:
    """Hashes of a text's windows by place, the same sorted, and the places in that order."""
    h = window_hashes(code_points(text), span).astype(np.int64)
    order = np.argsort(h, kind="stable")
    return h, h[order], order


def shared_intervals(x: str, y: str, span: int = SPAN, of_y: Prepared | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The maximal stretches of each text made of windows of ``span`` that the other has verbatim too.

    Windows of equal hash that run along in both texts are compared as one stretch.
    """
    hx = window_hashes(code_points(x), span).astype(np.int64)
    hy, sorted_y, order = of_y or prepared(y, span)
    if not len(hx) or not len(hy):
        return [], []
    # A table of 16 bits of each hash leaves few places to be searched for.
    table = np.zeros(1 << 16, dtype=bool)
    table[hy & 0xFFFF] = True
    at_x = np.flatnonzero(table[hx & 0xFFFF])
    where = np.minimum(np.searchsorted(sorted_y, hx[at_x]), len(hy) - 1)
    same = sorted_y[where] == hx[at_x]
    at_x, where = at_x[same], where[same]
    if not len(at_x):
        return [], []
    at_y = order[where]
    cut = np.flatnonzero((np.diff(at_x) != 1) | (np.diff(at_y) != 1)) + 1
    true = np.ones(len(at_x), dtype=bool)
    for first, last in zip([0, *cut.tolist()], [*cut.tolist(), len(at_x)]):
        i, j, n = int(at_x[first]), int(at_y[first]), last - first + span - 1
        if x[i : i + n] != y[j : j + n]:  # a hash in common by chance: each window by itself
            true[first:last] = [x[i + k : i + k + span] == y[j + k : j + k + span] for k in range(last - first)]
    in_y = np.zeros(len(hy), dtype=bool)
    in_y[where[true]] = True
    again = sorted_y[1:] == sorted_y[:-1]
    if again.any():  # a window that comes again in y counts at each place; ``where`` names the first
        group = np.concatenate([[0], np.cumsum(~again)])
        in_y = (np.bincount(group[in_y], minlength=group[-1] + 1) > 0)[group]
    return _stretches(at_x[true], span), _stretches(np.sort(order[in_y]), span)


def _stretches(at: np.ndarray, span: int) -> list[tuple[int, int]]:
    if not len(at):
        return []
    cut = np.flatnonzero(at[1:] > at[:-1] + span)
    first, last = np.concatenate([[at[0]], at[cut + 1]]), np.concatenate([at[cut], [at[-1]]])
    return [(int(a), int(b) + span) for a, b in zip(first, last)]


_SPANS = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("upto", T.LongType())]))
_TEXTS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("second", T.LongType())])
_VERIFIED = T.StructType([T.StructField("a", _TEXTS), T.StructField("b", _TEXTS), T.StructField("of_a", _SPANS), T.StructField("of_b", _SPANS)])
_ARROW_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("upto", pa.int64())]))


def _with_text(pairs: DataFrame, texts: DataFrame, side: str, hot: DataFrame, other: str) -> DataFrame:
    """The pairs with the text of one side; a text of very many pairs is sent to several tasks, each with a part of them."""
    mine = hot.select(F.col("doc").alias(side), "salts")
    salt = F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")
    asked = pairs.join(mine, side, "left").withColumn(f"{side}_salt", salt).drop("salts")
    sent = texts.join(hot, "doc", "left").select(
        F.col("doc").alias(side), F.col("text").alias(f"{side}_text"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias(f"{side}_salt")
    )
    return asked.join(sent, [side, f"{side}_salt"]).drop(f"{side}_salt")


def _verified(pairs: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """The pairs whose texts do share a span, with the stretches of both.

    ``texts`` has ``(doc, second, text)``.  Of them only those of a pair are sent on, and
    copies are put together before they are.
    """
    packed = pa.struct([("doc", pa.int64()), ("second", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, Prepared] | None = None  # pairs come by b, whose text stays for its pairs
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for a, b, of_one, of_other in zip(*(c.to_pylist() for c in whole.slice(at, 1000).columns)):
                    # A number that stands for two texts has both.
                    for x, y in ((x, y) for y in of_other for x in of_one):
                        if known is None or known[0] != y["text"]:
                            known = (y["text"], prepared(y["text"], span))
                        of_a, of_b = shared_intervals(x["text"], y["text"], span, of_y=known[1])
                        if of_a:
                            row = {"doc": a, "second": x["second"]}, {"doc": b, "second": y["second"]}, [{"from": f, "upto": t} for f, t in of_a], [{"from": f, "upto": t} for f, t in of_b]
                            for held, new in zip(out, row):
                                held.append(new)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], packed), pa.array(out[1], packed), pa.array(out[2], _ARROW_SPANS), pa.array(out[3], _ARROW_SPANS)], names=["a", "b", "of_a", "of_b"])

    docs = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    # Rows of texts in many pairs: a HOT_PAIRS-th of the pairs at most.  Written, so that the joins know its size.
    hot = keep(docs.groupBy(F.col("a").alias("doc")).count().where(F.col("count") > HOT_PAIRS).select("doc", F.ceil(F.col("count") / HOT_PAIRS).cast("int").alias("salts")), "hot")
    asked = may_match(texts, F.col("doc"), docs, "a")
    by_doc = asked.groupBy("doc").agg(F.collect_set(F.struct("second", "text")).alias("text"))
    both = _with_text(_with_text(pairs, by_doc, "a", hot, "b"), by_doc, "b", hot, "a")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, _VERIFIED)


def _numbered(documents: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """Rows ``(id, doc, second, text)`` of texts long enough: two 64-bit numbers of the text itself."""
    text = F.col(text_col)
    return documents.where(F.col(id_col).isNotNull() & (F.length(text) >= span)).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("doc"), F.xxhash64(F.lit("second"), text).alias("second"), text.alias("text")
    )


def new_index(spark, folder: str | None = None, ranges: int | None = None, span: int = SPAN, gram: int | None = None) -> SpanIndex:
    """An empty index in ``folder``, or in one of its own in the shared folder; of as many hash ranges as a shuffle has partitions."""
    gram = gram or max(1, span // 2)
    if span - gram + 1 > 128:
        gram = span - 127
    return SpanIndex.create(spark, folder or new_folder(spark, "spans"), ranges or shuffle_partitions(spark), span, gram)


def shared_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int | None = None,
                 crowd: int = CROWD, all_pairs: bool = True, index: SpanIndex | None = None, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of different texts that share a span, and the texts of the records.

    Returns ``(a, b, of_a, of_b)``, a and b being texts ``(doc, second)``, and
    ``(id, doc, second)`` for each record with a text of ``span`` characters or more.
    Records of one text have one ``doc``; the number comes from the text, so neither
    repeated ids nor repeated texts lose a link.

    Chosen windows of the texts are written as a sorted run of the index, which is
    merge-joined with itself and the runs before it; the pairs it names are verified on
    the whole texts.  A window that many texts have is refined first, so a common phrase
    makes no pairs.  With an ``index`` that holds ``earlier`` documents, the pairs are
    those of a new text with any; the run then stays in it.  Without one all is joined
    at once and no run stays.
    """
    spark = documents.sparkSession
    own = index is None
    index = new_index(spark, span=span, gram=gram) if own else index
    span, gram = index.span, index.gram
    rows = _numbered(documents, id_col, text_col, span)
    classes = keep(rows.select("id", "doc", "second"), "classes")
    run = index.add(fingerprints(rows, index.ranges, span, gram))
    links = keep(index.links(run, crowd, levels_needed(span, gram)).distinct(), "links")
    if own:
        index.drop()
    else:
        index.commit(run)
    texts = rows if earlier is None else rows.unionByName(_numbered(earlier, id_col, text_col, span))
    few = links.where(~F.col("crowd")).select("a", "b")
    many = links.where("crowd").select(F.col("a").alias("doc"), F.col("b").alias("hash"))
    pairs = few
    if not many.isEmpty():
        pairs = keep(few.unionByName(_refined(many, texts, span, gram, all_pairs)).distinct(), "pairs")
    return _verified(pairs, texts.select("doc", "second", "text"), span), classes


def shared_pairs_in_batches(batches: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """shared_pairs() of all the batches together, found batch after batch through one stored index."""
    index = new_index(batches[0].sparkSession, span=span)
    verified = classes = earlier = None
    for batch in batches:
        pairs, own = shared_pairs(batch, id_col, text_col, span, crowd=crowd, index=index, earlier=earlier)
        pairs = keep(pairs, "verified")
        verified, classes = (pairs, own) if verified is None else (verified.unionByName(pairs), classes.unionByName(own))
        earlier = batch if earlier is None else earlier.unionByName(batch)
    index.drop()
    return verified, classes


def pairs_of_records(verified: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows ``(doc_id_a, doc_id_b)``: the pairs written out for all records of the texts.

    As many rows as there are pairs; class_rows() and shared_lengths() are the forms that don't grow so.
    """
    text = F.struct("doc", "second")
    first, second = classes.select(F.col("id").alias("i"), text.alias("a")), classes.select(F.col("id").alias("j"), text.alias("b"))
    across = verified.select("a", "b").join(first, "a").join(second, "b").select("i", "j")
    within = first.join(second.withColumnRenamed("b", "a"), "a").where(F.col("i") < F.col("j")).select("i", "j")
    both = across.unionByName(within).where(F.col("i") != F.col("j"))
    return both.select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b")).distinct()


def class_rows(verified: DataFrame, classes: DataFrame) -> DataFrame:
    """One row ``(doc_id, class_id, class_size, links)`` per record of a text long enough.

    A class is the records of one text, named by the least id; ``links`` are the other
    texts it shares a span with.
    """
    text = F.struct("doc", "second")
    sizes = classes.groupBy(text.alias("text")).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    # Both directions from one row, so that the pairs are verified once.
    sides = F.explode(F.array(F.struct(F.col("a").alias("text"), F.col("b").alias("other")), F.struct(F.col("b").alias("text"), F.col("a").alias("other"))))
    links = verified.select(sides.alias("s")).select("s.text", "s.other").distinct().groupBy("text").agg(F.count(F.lit(1)).alias("links"))
    return classes.select(F.col("id").alias("doc_id"), text.alias("text")).join(sizes, "text").join(links, "text", "left").select("doc_id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"))


def shared_lengths(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """One row per record: ``(id_col, class_id, class_size, n_chars, shared_chars, shared_share)``.

    ``shared_chars`` are the characters in spans that another record has verbatim.
    Records of equal text are a class, named by the least id; they are shared whole.
    Null, short and unshared texts have 0; a null id stays a row.  Links between texts
    of a crowd go to the least of them, so nothing grows with the square of a group.
    """
    verified, classes = shared_pairs(documents, id_col, text_col, span, crowd=crowd, all_pairs=False)
    verified = keep(verified, "verified")
    sides = verified.select(F.col("a").alias("text"), F.col("of_a").alias("s")).unionByName(verified.select(F.col("b").alias("text"), F.col("of_b").alias("s")))
    cover = (
        sides.select("text", F.explode("s").alias("s")).select("text", F.col("s.from").alias("from"), F.col("s.upto").alias("upto")).distinct()
        .withColumn("reach", F.max("upto").over(Window.partitionBy("text").orderBy("from", "upto").rowsBetween(Window.unboundedPreceding, -1)))
        .groupBy("text").agg(F.sum(F.greatest(F.lit(0), F.col("upto") - F.greatest(F.col("from"), F.coalesce("reach", "from")))).alias("covered"))
    )
    of_text = F.struct("doc", "second")
    facts = classes.groupBy(of_text.alias("text")).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")).join(cover, "text", "left")
    numbered = documents.select(
        id_col, F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"),
        F.when(F.col(id_col).isNotNull() & (F.length(text_col) >= span), F.struct(F.xxhash64(text_col).alias("doc"), F.xxhash64(F.lit("second"), F.col(text_col)).alias("second"))).alias("text"),
    )
    return (
        numbered.join(facts, "text", "left")
        .select(
            id_col, F.coalesce("class_id", F.col(id_col).cast("long")).alias("class_id"), F.coalesce("members", F.lit(1).cast("long")).alias("class_size"), "n_chars",
            F.when(F.col("members") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("shared_chars"),
        )
        .withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
    )
