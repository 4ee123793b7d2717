import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from traceframe.functions.lookup import with_family  # noqa: E402
from traceframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        # A handful of rows per test: compiling each plan would take most of the time.
        spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def write_trace(tmp_path):
    def write(rows, name="trace.ndjson"):
        path = tmp_path / name
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
        return str(path)

    return write


FAMILY_ROWS = [
    ("Function.prototype.call", "dynamic_dispatch"), ("Function.prototype.apply", "dynamic_dispatch"), ("Reflect.apply", "dynamic_dispatch"),
    ("Bitwise.xor", "int_bitwise"), ("Bitwise.or", "int_bitwise"), ("Shift.left", "int_bitwise"), ("Shift.unsignedRight", "int_bitwise"),
    ("Date.now", "anti_debug_timing"), ("String.prototype.slice", "string_transform"), ("TextEncoder.encode", "text_codec"),
    ("JSON.stringify", "json_serialization"), ("btoa", "base64"), ("DataView.getUint8", "byte_buffer"),
]


def with_families(events):
    """Events with the families that the tests use."""
    return with_family(events, events.sparkSession.createDataFrame(FAMILY_ROWS, "api STRING, family STRING"))


def record(i=1, version=1, **over):
    """A record that meets the contract, with members replaced or (None marker ...) dropped."""
    row = {
        "schema_version": version, "event_id": f"session-1:{i}", "session_id": "session-1", "seq": i, "t": "call",
        "wall_time_us": 1780000000000000 + i, "mono_time_us": 123456789 + i, "category": "reverse", "phase": "call",
        "api": "TextEncoder.encode", "args": [{"input": "x", "input_ref": "r"}], "stack": [], "pid": 100, "tid": 200,
        "frame_url": "https://x/", "origin": "https://x", "result": None, "error": None, "truncated": False,
    }
    if version == 2:
        row.update(call_id=f"session-1:{i}", parent_id=None, depth=0, causality_kind="singleton", duration_us=None)
    row.update(over)
    return {k: v for k, v in row.items() if v != "DROP"}
