"""Parts of an export: names, bounds, order, long rows, an empty day, a run that is repeated."""

import datetime as dt
import gzip
import json
import os
import random

import pytest

from helpers import at, dicts, trace, traces
from tracelake.sources import export

DAY = dt.date(2026, 2, 12)


def run(spark, rows, root, bound):
    parts = dicts(export.export_day(traces(spark, rows), DAY, "UTC", str(root), part_bytes=bound), "part_number")
    folder = root / "260212" / "parts"
    files = {n: (folder / n).read_bytes() for n in os.listdir(folder) if not n.startswith(".")}
    return parts, files


def noise(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))


@pytest.mark.parametrize("bound", [4_000, 30_000, 10_000_000])
def test_no_part_above_its_bound(spark, tmp_path, bound):
    rng = random.Random(bound)
    rows = [trace(rng.choice([f"e{i}", "same", None]), rng.choice([i, 7]), request_body=noise(rng, rng.randrange(300))) for i in range(150)]
    rows += [trace(f"long{i}", i * 31, request_body=noise(rng, 600)) for i in range(4)] + [trace("longer", 50, request_body=noise(rng, 2_500))]
    parts, files = run(spark, rows, tmp_path, bound)
    assert [p["part_number"] for p in parts] == list(range(1, len(parts) + 1)) and set(files) == {p["part_name"] for p in parts}
    seen = []
    for p in parts:
        data = files[p["part_name"]]
        plain = gzip.decompress(data)
        assert (len(data), len(plain), plain.count(b"\n")) == (p["compressed_bytes"], p["plain_bytes"], p["records"])
        assert p["records"] == 1 or max(len(data), len(plain)) <= bound
        seen += [json.loads(line) for line in plain.splitlines()]
        assert p["part_name"] == f"request_details_260212_part_{p['part_number']:06d}_{p['first_at']:%H%M}_{p['last_at']:%H%M}.ndjson.gz"
    assert [(r["timestamp"], r.get("id") or "") for r in seen] == sorted((f"{r['timestamp']:%Y-%m-%dT%H:%M:%S.%f}Z", r["id"] or "") for r in rows)
    assert (len(parts) == 1) == (bound == 10_000_000)


def test_empty_day_and_repeated_run(spark, tmp_path):
    assert run(spark, [trace("a", -86_400 * 3)], tmp_path, 5_000) == ([], {})
    rows = [trace(f"e{i}", i) for i in range(40)]
    first, files = run(spark, rows, tmp_path, 5_000)
    again, same = run(spark, rows, tmp_path, 5_000)
    assert first == again and files.keys() == same.keys() and len(files) > 1
    assert export.read_export(spark, str(tmp_path / "260212" / "parts"), traces(spark, rows).schema).count() == 40
    fewer, left = run(spark, rows[:3], tmp_path, 5_000)
    assert sum(p["records"] for p in fewer) == 3 and set(left) == {p["part_name"] for p in fewer}
    assert at(0).date() == DAY
