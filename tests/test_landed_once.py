"""Responses that land often are shuffled and written once each."""

import json
from pathlib import Path

from txrisk.sources import explorer

SCHEMA = "address string, page bigint, landed_at bigint, status string, message string, result string"


def _rows():
    for i in range(40):
        for at in range(1 + i % 4):
            result = json.dumps([{"hash": f"{i}-{at}", "value": "1" * 50}])
            yield (f"0x{i}" if i else None, i % 3 or None, at, "0" if at == 2 else "1", "OK", result)
    # The same response twice, and one time with two texts.
    yield from [("0xa", 1, 5, "1", "OK", "[]")] * 2 + [("0xa", 1, 5, "1", "OK", '[{"hash":"z"}]')]


def test_many_pages_and_few_pages_give_the_same(spark, monkeypatch):
    landed = spark.createDataFrame(list(_rows()), SCHEMA)
    for prefer_ok in (True, False):
        few = explorer.newest(landed, prefer_ok)
        monkeypatch.setattr(explorer, "fits_broadcast", lambda keys: False)
        many = explorer.newest(landed, prefer_ok)
        monkeypatch.undo()
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
        assert many.count() == 41
        # Responses meet once, in a window, and by no join.
        plan = many._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Window [") == 1


def test_landed_files_are_compressed(spark, tmp_path):
    landed = spark.createDataFrame(list(_rows()), SCHEMA)
    explorer.land(landed, str(tmp_path), "txlist", "1")
    files = [f.name for f in Path(tmp_path).rglob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = explorer.read_envelopes(spark, str(tmp_path))
    assert sorted(map(str, back.collect())) == sorted(map(str, landed.select(*back.columns).collect()))
