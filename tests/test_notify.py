from millrace.plans import notify as N
from millrace.plans.processor import Processor
from millrace.sources import sinks

import pytest


def test_events_go_where_they_are_wanted():
    seen, posted = [], []
    targets = [N.Target("call", lambda s, t: seen.append((s, t)), ("quarantine",), "$contract/$event", "$message ($run)"), N.Target("webhook", "http://x", ("failure",))]
    assert N.notify(targets, "quarantine", "orders", "3 rows", run="r1") == []
    assert N.notify(targets, "failure", "orders", "boom", post=lambda u, b: posted.append((u, b))) == []
    assert seen == [("orders/quarantine", "3 rows (r1)")] and posted[0][0] == "http://x" and b"boom" in posted[0][1]


def test_a_target_that_fails_is_reported():
    def broken(*_):
        raise OSError("down")

    assert N.notify([N.Target("call", broken)], "success", "c", "x") == ["call: down"]
    assert "unknown kind" in N.notify([N.Target("pigeon", "x")], "success", "c", "x")[0]
    with pytest.raises(ValueError, match="unknown events"):
        N.targets_of([{"target": "x", "on_events": ["lunch"]}])


def test_a_run_tells_of_itself(spark, tmp_path):
    seen = []
    spark.range(10).write.parquet(str(tmp_path / "in"))
    contract = {
        "name": "c", "source": {"path": str(tmp_path / "in")}, "lineage": {"enabled": False}, "quality": {"row_rules": [{"name": "r", "sql": "id < 8"}], "dataset_rules": [{"row_count_between": {"min": 100}}]},
        "service_levels": {"row_count": {"min_rows": 9}}, "notifications": [{"type": "call", "target": lambda s, t: seen.append((s, t))}],
    }
    log = sinks.RunLog(spark, str(tmp_path / "log"))
    n = Processor(contract, spark).run_all(sinks.SnapshotTable(spark, str(tmp_path / "t")), log=log)
    assert n["good"] == 8 and [s for s, _ in seen] == ["c: quarantine", "c: dataset_rule_failed", "c: service_level_broken"]
    assert log.read().first()["message"] == "service level broken: row_count"
