"""What only large tables showed, on small ones."""

from __future__ import annotations

import datetime as dt
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_oracle import rows

from kinemill.operators import windows
from kinemill.plans.catalog import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent


def test_moved_poses_meet_no_other_pose(spark, tmp_path):
    """Of two poses in each video and frame, the one lies one unit left of the other, as many do in a large table."""
    own = [(1000 * (100 * f + 10 * u + s), dt.datetime(2024, 1, 1 + f), u + 6 * s, "view", 10.0 + s, '{"k": 50}') for f in range(8) for u in (0, 2, 4) for s in range(2)]
    kinds = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    pq.write_table(pa.Table.from_pydict(dict(zip(kinds.names, zip(*own, strict=True), strict=True)), kinds), tmp_path / "events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = QUERIES["j13c_pose_content"](spark, str(tmp_path)).toPandas(), duck.sql(ORACLE_SQL["j13c_pose_content"]).df()
    assert want["n_equal"].tolist() == [2, 2, 2] and rows(got) == rows(want)


def test_ranks_first_of_a_session():
    """A session's first plan: Spark then planned a filter by a column that its input lacks, and the query failed."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from kinemill.plans.catalog import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
print("rows", QUERIES["s09_session_groups"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "rows True" in out.stdout.split("\n"), out.stderr[-2000:]


@pytest.mark.parametrize("buckets", [1, 2, 3, 7, 64, 200])
def test_ranks_and_offsets_in_ranges(spark, buckets):
    rng = random.Random(buckets)
    own = [(k, rng.choice([None, float("nan"), *range(-20, 40)]), rng.randrange(5)) for k in range(500)]
    data = spark.createDataFrame([(k, None if v is None else float(v), n) for k, v, n in own], "id long, v double, n long")
    place = lambda v: (v is not None, v is not None and v != v, v if v is not None and v == v else 0)
    want = [k for k, v, _ in sorted(own, key=lambda r: (place(r[1]), r[0]))]
    got = windows.global_rank(data, "v", ["id"], "row", buckets).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["row"])] == want and sorted(r["row"] for r in got) == list(range(500))
    ends, at = {}, 0
    for k, _, n in own:
        ends[k] = (at, at := at + n)
    assert {r["id"]: (r["start"], r["end"]) for r in windows.running_offsets(data, "id", "n", buckets).collect()} == ends
    assert windows.global_rank(data.where("id < 0"), "v", ["id"]).count() == 0
