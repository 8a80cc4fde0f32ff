"""Queries over tables with keys and texts beyond those of the small tables, against their SQL."""

from pathlib import Path

import duckdb
import pytest
from oracle import TABLES, same

from pagelake.plans import ORACLES, QUERIES

PART = "SELECT * REPLACE (p_partkey + {0} AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet'"
MADE = {
    "structure_stage": {"part": f"{PART.format(999_990)} UNION ALL {PART.format(123_456_781)}"},
    "translation_scores": {"conversations": "SELECT k AS conv_id, 1 AS turn, 'user' AS role, repeat('Ein Wort ', k * 100) || repeat('x', k % 3) AS text FROM range(215, 230) r(k) UNION ALL SELECT k, 1, 'user', repeat('Ein Satz. ', k) FROM range(1400, 1403) r(k)"},
}


@pytest.mark.parametrize("name", sorted(MADE))
def test_query_equals_its_sql_on_larger_keys_and_texts(spark, tmp_path, name):
    for t in TABLES:
        made = MADE[name].get(t)
        if made:
            duckdb.sql(f"COPY ({made}) TO '{tmp_path}/{t}.parquet'")
        else:
            Path(tmp_path, f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    same(spark, str(tmp_path), QUERIES[name], ORACLES[name])
