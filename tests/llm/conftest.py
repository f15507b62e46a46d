import os
import sys

import pytest

for folder in (os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))):
    sys.path.insert(0, folder)
from edge_rows import CLASH, EDGE  # noqa: E402

@pytest.fixture(scope="session")
def edge(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    rows = [(i, t, "en" if k % 2 else None, "s", None if t is None else len(t), *["clash"] * len(CLASH)) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest table, as Spark and as (doc_id, text) pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
