import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (or (doc_id, text, source) rows), with extra columns whose names operators use inside."""
    def build(rows, extra=True):
        full = [(i, r, "en", f"s{i % 3}", len(r or "")) if not isinstance(r, tuple) else (r[0], r[1], "en", r[2], len(r[1] or ""))
                for i, r in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            df = df.selectExpr("*", "7 AS size", "'x' AS row", "1 AS kept", "2 AS u", "3 AS p", "4 AS target", "5 AS piece", "6 AS root",
                               "8 AS _cell", "9 AS band", "10 AS length", "11 AS toxic", "12 AS score", "13 AS shard")
        return df
    return build
