"""Exact duplicates by tree-merge of sorted digest runs, in DataFrame operations only.

Rows fall into runs by doc_id, and a run is sorted by digest. In round k run r takes over the runs r + j * FAN^k for j
below FAN, as in a binomial tree whose nodes have FAN - 1 children a round: the sorted runs meet by ranges of the digest
(so that the last round is many tasks too) and a merge of them keeps one row for each text. The rows of a text that
meet have equal digests, are verified by their length and an independent hash at every level (texts that differ there
stay apart), and leave the smallest or largest identifier and the sum of their sizes. A text that a third of all rows
share is spread over all runs first, is combined before it is exchanged, and is FAN rows at most in every later merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parts, scratch, stored

#: Rows that a run has at most on average, runs that one merge takes, and rows of a range of digests.
RUN_ROWS, FAN, RANGE_ROWS = 1_000_000, 4, 50_000


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def witness_of(text: Column) -> Column:
    return F.struct(F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("hash"))


def whole(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, witness): SHA-256 of the text, and its length with an independent hash to verify merges by."""
    t = whole(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(t).alias("digest"), witness_of(t).alias("witness"))


def tree_merge(slim: DataFrame, rows: int, keep: str = "smallest") -> DataFrame:
    """(digest, witness, keep_id, copies, group_size), one row for each text of slim(doc_id, digest, witness).

    copies counts the rows that have keep_id; a row without doc_id is kept only where all of a text have none.
    """
    runs = FAN * FAN
    while runs * RUN_ROWS < rows:
        runs *= FAN
    ranges = parts(rows, RANGE_ROWS, 8)
    at = F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * ranges / F.lit(float(1 << 32))).cast("int")
    text = ["range", "digest", "witness"]
    level = slim.select("doc_id", "digest", "witness", at.alias("range"), F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"))
    level = level.groupBy("run", *text, "doc_id").agg(F.count("*").alias("n"))
    # min and max of structs merge sorted rows; the first field puts rows without doc_id last
    least = keep == "smallest"
    level = level.select("run", *text, F.struct((F.col("doc_id").isNull() if least else F.col("doc_id").isNotNull()).alias("side"), "doc_id", F.col("n").alias("copies")).alias("best"), F.col("n").alias("group_size"))
    best = (F.min if least else F.max)("best").alias("best")
    level = level.groupBy("run", *text).agg(best, F.sum("group_size").alias("group_size"))
    while runs > 1:
        runs //= FAN  # runs that are left; the others, in steps of so many, are taken over
        level = level.withColumn("run", F.pmod(F.col("run"), F.lit(runs)))
        level = level.repartition(ranges, "run", "range").sortWithinPartitions("run", *text)
        level = level.groupBy("run", *text).agg(best, F.sum("group_size").alias("group_size"))
    return level.select("digest", "witness", F.col("best.doc_id").alias("keep_id"), F.col("best.copies").alias("copies"), "group_size")


def exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, digest, keep_id, group_size, kept.

    A null text counts as empty. Rows that repeat a doc_id count one by one; a row stays if its doc_id is keep_id, and
    rows without doc_id stay where all rows of a text have none. An empty table gives an empty result; other columns
    are ignored.
    """
    slim = stored(digests(docs))
    classes = tree_merge(slim, slim.count(), keep).where("group_size > 1").select("digest", "witness", F.col("keep_id").alias("k"), F.col("group_size").alias("g"))
    classes = stored(classes)
    found = slim.join(classes, ["digest", "witness"], "left")
    one = F.col("g").isNull()
    keep_id = F.when(one, F.col("doc_id")).otherwise(F.col("k"))
    return found.select("doc_id", "digest", keep_id.alias("keep_id"), F.coalesce("g", F.lit(1).cast("long")).alias("group_size"), keep_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def remove_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs with one row of each text: that of the smallest (or largest) doc_id, one of them where several have it.

    It goes by rows, not by doc_id: another text of the same doc_id stays. A text whose rows all lack doc_id keeps one
    of them. All columns stay.
    """
    with scratch(docs.sparkSession) as hold:
        slim = stored(digests(docs))
        classes = stored(tree_merge(slim, slim.count(), keep).where("group_size > 1"))
        gone = slim.join(classes, ["digest", "witness"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        gone = hold(gone.select("doc_id", F.col("witness.hash").alias("hash")).distinct())
        twice = hold(classes.where("copies > 1").select("keep_id", F.col("witness.hash").alias("hash")))
    mine, hash_ = docs["doc_id"].cast("long"), F.xxhash64(whole())
    out = docs.join(gone, mine.eqNullSafe(gone["doc_id"]) & (hash_ == gone["hash"]), "left_anti")
    if twice.isEmpty():
        return out
    again = mine.eqNullSafe(twice["keep_id"]) & (hash_ == twice["hash"])
    several = out.join(twice, again, "left_semi").withColumns({"_id": F.col("doc_id").cast("long"), "_digest": digest_of(whole())})
    return out.join(twice, again, "left_anti").unionByName(several.dropDuplicates(["_id", "_digest"]).drop("_id", "_digest"))
