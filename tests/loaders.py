"""A loader for tests: writes down what it is asked for, and fails at its first call in a folder where that is wanted."""

import os
import uuid

import pyarrow as pa


def noted(ranges: pa.Table, options: dict):
    folder = options["notes"]
    if "fail_once" in options and not os.path.exists(f"{folder}/failed"):
        open(f"{folder}/failed", "w").close()
        raise OSError("not yet")
    with open(f"{folder}/asked-{uuid.uuid4().hex}", "w") as f:
        f.writelines(f"{k} {a} {b}\n" for k, a, b in zip(*(ranges.column(c).to_pylist() for c in ("k", "start_date", "end_date")), strict=True))
    rows = [(k, a, 1.0) for k, a in zip(ranges.column("k").to_pylist(), ranges.column("start_date").to_pylist(), strict=True)]
    rows += [(k, b, 2.0) for k, _, b in rows for b in ranges.column("end_date").to_pylist()]  # some outside the key's own range
    yield pa.RecordBatch.from_pydict({"k": [r[0] for r in rows], "d": pa.array([r[1] for r in rows], pa.date32()), "v": [r[2] for r in rows]})
