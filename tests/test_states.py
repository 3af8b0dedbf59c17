"""Streams with state, stopped and started again."""

from __future__ import annotations

import json
import time

import pytest

from cairnspark.streaming import states as S, watch as W


@pytest.fixture()
def place(spark, tmp_path):
    S.with_state_store(spark)
    (tmp_path / "in").mkdir()

    def arrive(name, rows):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        (tmp_path / name).rename(tmp_path / "in" / name)

    return tmp_path, arrive


def test_debounce_goes_on_after_a_restart(spark, place):
    folder, arrive = place

    def run(until):
        events = W.event_files(spark, str(folder / "in"), "path string, seq long, kind string")
        live = S.written(S.debounced_live(events, 15_000), f"{folder}/rows", f"{folder}/checkpoint", mode="append", every="300 milliseconds")
        for _ in range(400):
            time.sleep(0.2)
            if until(live):
                break
        live.stop()

    def emitted():
        return sorted(tuple(r) for r in spark.read.schema("path string, n long, kind string").parquet(f"{folder}/rows/*").collect()) if (folder / "rows").exists() else []

    arrive("one.json", [{"path": "a", "seq": 2, "kind": "modify"}, {"path": "a", "seq": 1, "kind": "create"}, {"path": "b", "seq": 1, "kind": "remove"}])
    run(lambda live: any(p["numInputRows"] for p in live.recentProgress))
    # the second start finds a's count and moves its timer before it is due; b has had its quiet time
    arrive("two.json", [{"path": "a", "seq": 3, "kind": "remove"}])
    run(lambda live: len(emitted()) >= 2)
    assert emitted() == [("a", 3, "remove"), ("b", 1, "remove")]


def test_reconciliation_and_rings_over_restarts(spark, place):
    folder, arrive = place
    looks = [("a", 1, "x"), ("a", 2, "x"), ("b", 3, None), ("a", 4, "y"), ("b", 5, "q"), ("a", 6, None), ("a", 7, None), ("b", 8, "q"), ("a", 9, "y")]
    for i in range(3):
        arrive(f"{i}.json", [{"path": p, "seq": s, "hash": h} for p, s, h in looks[3 * i : 3 * i + 3]][::-1])
        files = W.event_files(spark, str(folder / "in"), "path string, seq long, hash string")
        S.written(S.reconciled_live(files), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
        events = W.event_files(spark, str(folder / "in"), "path string, seq long, hash string", size=1 << 20).selectExpr("path as key", "seq", "coalesce(hash, '-') as event")
        S.written(S.last_events(events, 3), f"{folder}/rings", f"{folder}/ring-checkpoint").awaitTermination()
    found = {(r["path"], r["seq"]): r["outcome"] for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert found == {
        ("a", 1): "new", ("a", 2): "unchanged", ("b", 3): "absent", ("a", 4): "reindexed", ("b", 5): "new", ("a", 6): "deleted", ("a", 7): "absent", ("b", 8): "unchanged", ("a", 9): "new",
    }
    rings = spark.read.parquet(f"{folder}/rings")
    last = {k: [(r["seq"], r["event"]) for r in rings.where(f"key = '{k}' and batch = 2").orderBy("place").collect()] for k in "ab"}
    assert last == {"a": [(6, "-"), (7, "-"), (9, "y")], "b": [(3, "-"), (5, "q"), (8, "q")]}
