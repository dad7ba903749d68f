"""SparkSession settings the operators rely on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

# UTC keeps date and timestamp casts independent of the machine. AQE sizes shuffle partitions,
# splits skewed joins and splits hot partitions of a rebalance before a write.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app_name: str = "eventide", conf: Mapping[str, str] | None = None) -> SparkSession:
    """Create or reuse a session; ``conf`` adds to or overrides the settings above.

    Master, executor sizes and shuffle partitions are left to the submitter.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
