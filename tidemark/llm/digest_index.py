"""Exact deduplication against a persistent digest index. DataFrame operations only.

The index is a table bucketed and sorted by the digest. A batch is reduced to one row per digest
(partial aggregation, so a text that fills a third of the rows costs one row a task), the digests
that the index lacks are found by a sort-merge anti-join that reads the index without a shuffle, and
those are appended. The texts themselves are never shuffled to take the decision.

The number of buckets is the table's own once it exists, whatever a later session's settings are. Each
append adds a sorted file to the buckets; ``compact`` makes it one sorted file a bucket again. The table
lies in the warehouse, or at ``location``, which has to be a folder that all executors see.

Defined results: null text counts as empty; of equal texts in a batch, the row with the largest
doc_id stays, unless the index already had the text, then none stays; rows alike in doc_id and text
are decided alike, and ``deduplicate`` returns one of them; a null doc_id stays only where its text
has no other; an empty batch leaves the index as it was; texts of any length are one digest; further
columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, materialise, skew_safe_lookup

INDEX = "digest binary, keep_id long, copies long"


def text_digest(text: Column | str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


@dataclass(frozen=True)
class DigestIndex:
    spark: SparkSession
    table: str
    buckets: int | None = None
    location: str | None = None

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def bucket_count(self) -> int:
        """The table's; for a new one the parameter, or else the session's shuffle partitions."""
        if self.exists():
            facts = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {self.table}").collect()}
            return int(facts["Num Buckets"])
        return self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _save(self, digests: DataFrame, mode: str, table: str | None = None) -> None:
        writer = digests.write.format("parquet").mode(mode)
        if self.location and table is None:
            writer = writer.option("path", self.location)
        writer.bucketBy(self.bucket_count(), "digest").sortBy("digest").saveAsTable(table or self.table)

    def create(self) -> DigestIndex:
        """An empty index; one of that name is dropped."""
        self.drop()
        self._save(self.spark.createDataFrame([], INDEX), "overwrite")
        return self

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compact(self) -> None:
        """One sorted file a bucket: the rows are read bucket by bucket and written anew, then put in the
        old ones' place. Where that was broken off, the rows are in the table named with _compacted."""
        other = f"{self.table}_compacted"
        self.spark.sql(f"DROP TABLE IF EXISTS {other}")
        self._save(self.rows().repartition(self.bucket_count(), "digest"), "overwrite", other)
        self._save(self.spark.table(other).repartition(self.bucket_count(), "digest"), "overwrite")
        self.spark.sql(f"DROP TABLE {other}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """groups: one row per digest of the new data."""
        new = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        self._save(new.select("digest", "keep_id", "copies"), "append")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append what is new in docs; row per document: doc_id, digest, keep_id, copies in this batch, kept."""
        digests = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest")), "digests")
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        groups = materialise(groups, "digest-groups")
        self.append(groups)
        stays = self.rows().select("digest", "keep_id").hint("merge")
        facts = materialise(groups.select("digest", "copies").join(stays, "digest"), "digest-facts")
        return skew_safe_lookup(digests, facts, "digest", "copies", digests.count()).withColumn(
            "kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))
        )


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    one, digest, other = (free_name(docs, c) for c in ("kept_id", "text_digest", "kept_digest"))
    kept = index.ingest(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(one), F.col("digest").alias(other)).distinct()
    keyed = docs.withColumn(digest, text_digest(text_col))
    joined = keyed.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(one)) & (F.col(digest) == F.col(other)), "left_semi")
    return joined.dropDuplicates([id_col, digest]).select(*docs.columns)
