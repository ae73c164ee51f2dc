import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-check-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


CLASHING = ["repo", "path", "cwe", "text", "line", "other_line", "line_delta", "file", "tool", "stream", "seq", "cell", "block", "cls", "chunk", "n", "row", "stage", "size", "node", "label", "kind", "value", "role", "weight"]
TABLES = "scans findings structural_hits external_findings baseline_entries votes documents eval_items mix_targets"


@pytest.fixture(scope="session")
def edge_folders(spark, tmp_path_factory):
    """Folders of the tables: without rows, and with null, blank and repeated rows beside columns whose names clash."""
    from pyspark.sql import functions as F

    empty, dirty = str(tmp_path_factory.mktemp("empty")), str(tmp_path_factory.mktemp("dirty"))
    for name in TABLES.split():
        real = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        real.limit(0).write.parquet(f"{empty}/{name}.parquet")
        nulls = spark.createDataFrame([tuple(None for _ in real.columns)], real.schema)
        first = real.limit(40)
        blank = first.limit(3).select(*(F.lit("").alias(c) if t == "string" and i else F.col(c) for i, (c, t) in enumerate(real.dtypes)))
        rows_ = first.unionByName(first).unionByName(nulls).unionByName(nulls).unionByName(blank)
        more = rows_.withColumns({c: F.lit("x") for c in CLASHING if c not in real.columns})
        more.coalesce(1).write.parquet(f"{dirty}/{name}.parquet")
    return empty, dirty
