"""Tables as inputs of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a plain file scan over as many partitions as there are cores, if it has fewer.

    A file of one row group is one task, whatever its size, and reading its texts costs far more than moving them once.  A table of many
    row groups, as any large one, is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
