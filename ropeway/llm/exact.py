"""Exact deduplication against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ropeway.llm.base import SPACE, fresh_name, pack, query, stored, table
from ropeway.session import scratch_path

#: Digests that one index bucket should hold; 4 million rows are about 150 MB.
DIGESTS_PER_BUCKET = 4_000_000


def normalised(text):
    """Text in which each run of ASCII white space is one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text):
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select("doc_id", digest(F.col("text")).alias("digest"))


def buckets_for(rows: int) -> int:
    """Buckets for an index that will hold ``rows`` digests."""
    return max(16, -(-rows // DIGESTS_PER_BUCKET))


@dataclass
class DigestIndex:
    """One row per known text: its digest and the id that stays.

    The files lie at ``path`` in a folder that all executors share, bucketed and
    sorted by digest, so a later session opens them again and a join with new
    digests moves only the new side.
    """

    spark: SparkSession
    path: str
    buckets: int
    id_type: str = "bigint"

    def __post_init__(self):
        self.name = fresh_name("digest_index")
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {self.id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, batch: DataFrame) -> None:
        """Append the first id of every digest of ``batch`` (doc_id, digest) the index lacks.

        The new digests are dealt like the index buckets and meet it in a sort-merge
        anti-join.  Ingesting a batch again, for instance after a failure half way,
        changes nothing: its digests are known by then, under the same ids.
        """
        first = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        lacking = first.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        lacking.repartition(self.buckets, "digest").write.insertInto(self.name)


def decide(index: DigestIndex, rows: DataFrame) -> DataFrame:
    """keep_id, group_size and kept of every (doc_id, digest) row whose digest the index holds.

    The row whose id the index names stays.  Rows without an id stay only where no
    row of their group has one.  Where the staying id comes more than once in its
    group, one of these equal rows stays.
    """
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")).join(index.rows(), "digest")
    # read from a table both sides of the join are bare exchanges, whose hot partitions can be split
    groups = stored(groups, "digest-groups")
    named = rows.join(groups.hint("merge"), "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not repeats(rows):
        return named
    order = Window.partitionBy("digest").orderBy("doc_id")
    one = named.where("kept").withColumn("kept", F.row_number().over(order) == 1)
    return named.where("not kept").unionByName(one)


def repeats(rows: DataFrame) -> bool:
    """Whether any row repeats another's id and text."""
    return rows.groupBy("digest", "doc_id").count().where("count > 1").limit(1).count() > 0


def build_index(spark: SparkSession, rows: DataFrame, batches: int = 2) -> DigestIndex:
    """An index of all (doc_id, digest) rows, ingested in ``batches`` steps of rising ids.

    Smaller ids come first, so the smallest id of equal texts is the one that stays.
    """
    n = rows.count()
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), buckets_for(n), dict(rows.dtypes)["doc_id"])
    shares = [i / batches for i in range(1, batches)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 1000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows
        if low is not None:
            part = part.where((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        index.ingest(part)
    return index


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts are equal when they agree after each run of ASCII white space became one
    space; NULL and empty texts are equal.  The smallest doc_id of a group stays (a
    row without an id only in a group without ids); of rows that repeat the staying
    id and text, one stays.  An empty table gives an empty table.
    """
    rows = stored(digests(docs), "digests")
    index = build_index(spark, rows)
    packed = pack(docs, _id=F.col("doc_id"), _digest=digest(F.col("text")))
    same = (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("keep_id"))
    left = packed.join(index.rows(), same, "left_semi")
    if repeats(rows):
        left = left.dropDuplicates(["_digest"])
    return left.select("_row.*")


@query(
    "op6_exact_dedup",
    r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW w AS (PARTITION BY h)
""",
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its group, by ingesting the corpus into a fresh index in two batches."""
    rows = stored(digests(table(spark, sf, "documents")), "digests")
    return decide(build_index(spark, rows), rows).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
