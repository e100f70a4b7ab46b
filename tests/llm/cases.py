"""Rows of the stored tables, read without Spark."""

import pyarrow.parquet as pq


def documents(sf):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
