"""Sessions whose name holds a colon, and code that is shipped to the workers."""

import os
import subprocess
import sys

from conftest import record
from traceframe.operators import causal, gate
from traceframe.quality import rules
from traceframe.sources.ndjson import scan_ndjson


def test_a_session_may_hold_colons(spark, write_trace):
    over = {"session_id": "inject:ab", "version": 2}
    rows = [
        record(1, **over, call_id="inject:ab:1"), record(2, **over, call_id="inject:ab:2", parent_id="inject:ab:1", depth=1),
        record(3, **over, call_id="inject:ab:3", parent_id="other:1", depth=1),
    ]
    events = scan_ndjson(spark, write_trace(rows))
    links = {r.call_id: r.link for r in causal.link_status(events).collect()}
    assert links == {"inject:ab:1": "root", "inject:ab:2": "ok", "inject:ab:3": "session"}
    found = [r for r in rules.causality(events).collect() if "cross_session" in str(r)]
    assert len(found) == 1


def test_the_gate_counts_every_endpoint(spark):
    rows = [("t", "", True, f"https://x.test/api/{i}", 1, i) for i in range(20)]
    counts = spark.createDataFrame(rows, "trace_id string, resource_class string, actionable boolean, endpoint string, events long, first_index long")
    g = gate.capture_gate(counts, shown_endpoints=5).first()
    assert g.observed_actionable_endpoint_count == 20 and len(g.matched_endpoints) == 5


def test_workers_find_the_package_elsewhere(tmp_path):
    """A query with Python operators runs with the working directory and path outside the repository."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {top!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
print("rows", e.queries()["string_leaves"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows" in out.stdout, out.stderr[-2000:]
