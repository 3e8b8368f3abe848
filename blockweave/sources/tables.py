"""Block matrices kept as bucketed tables, so that later joins on the bucketed key need no shuffle."""

from __future__ import annotations

import uuid

from ..matrix import BlockMatrix
from .staging import drop_folder, scratch_path


class BlockTable:
    """A block matrix written once, in buckets of ``by``, to the shared folder.

    Later operators read the files: a lost executor costs nothing but the tasks it ran. The table belongs to whoever made
    it and ends with :meth:`drop`, or with the ``with`` block that holds it; ``matrix`` must not be read after that.
    """

    def __init__(self, m: BlockMatrix, by: tuple[str, ...] = ("br", "bc"), buckets: int | None = None):
        spark = m.df.sparkSession
        self.by, self.buckets = by, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"blocks_{uuid.uuid4().hex}", scratch_path(spark, "block-table")
        # Dealt as the buckets are, so that each is one file.
        dealt = m.df.repartition(self.buckets, *by).sortWithinPartitions(*by)
        dealt.write.bucketBy(self.buckets, *by).sortBy(*by).option("path", self.path).saveAsTable(self.name)
        self._spark = spark
        self.matrix = m.with_df(spark.table(self.name))

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_folder(self._spark, self.path)

    def __enter__(self) -> BlockTable:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def bucket_blocks(m: BlockMatrix, by: tuple[str, ...] | str = ("br", "bc"), buckets: int | None = None) -> BlockTable:
    """``m`` in buckets of its position (for sums), of ``bc`` or of ``br`` (for products, left and right operand).

    ``buckets`` is the number of partitions of a later join, ``spark.sql.shuffle.partitions`` unless given; tables that are
    to be joined need the same. Writing shuffles once.
    """
    return BlockTable(m, (by,) if isinstance(by, str) else tuple(by), buckets)
