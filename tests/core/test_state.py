import random

from lodegraph.operators.incremental import Incremental
from lodegraph.plans import catalog, state_queries
from lodegraph.streaming import processors
from pyspark.sql import functions as F


def brute_pulses(events, quiet, hold):
    """Pulses and dropped events of one owner, from all its events (at, event_id) in order; a pulse at the end is pending."""
    out, fire, first, n, until = [], None, None, 0, -1
    for at, event in sorted(events):
        if fire is not None and at >= fire:
            out.append(("pulse", fire, first, n))
            fire, first, n, until = None, None, 0, fire + hold
        if at < until:
            out.append(("dropped", at, event, 1))
            continue
        first, n, fire = (event if fire is None else first), n + 1, at + quiet
    return out, fire, first, n


def test_events_in_a_hold_are_dropped(spark):
    at = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{at}/events.parquet").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at")).collect()
    end = max(r["at"] for r in own)
    want = set()
    for user in {r.user_id for r in own}:
        rows, fire, first, n = brute_pulses([(r["at"], r.event_id) for r in own if r.user_id == user], state_queries.QUIET, state_queries.HOLD)
        rows += [("pulse", fire, first, n)] if fire is not None else []
        want |= {(user, *r) for r in rows if r[1] <= end - 2 * state_queries.QUIET}
    rows = [tuple(r) for r in catalog.QUERIES["watch_pulses"](spark, at).collect()]
    assert set(rows) == want and len(rows) == len(want) and {r[1] for r in rows} == {"pulse", "dropped"}


def test_state_passes_from_trigger_to_trigger(spark, tmp_path):
    """Events in three files, a trigger each: pulses and holds reach over them; repeats count once."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(40_000), k, rng.randrange(3)) for k in range(90))
    kinds = {k: "end" if rng.random() < 0.05 else "step" for _, k, _ in rows}
    for part in range(3):
        own = [r for r in rows if part * 14_000 <= r[0] < (part + 1) * 14_000]
        twice = own + own[:3]  # sent again
        df = spark.createDataFrame([(u, k, t, kinds[k]) for t, k, u in twice], "user_id long, event_id long, ms long, kind string")
        df.select("user_id", "event_id", F.timestamp_millis("ms").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "user_id long, event_id long, ts timestamp, kind string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    got = state_queries._drained(spark, processors.runs(stream().select(F.col("user_id").cast("string").alias("run"), "event_id", "ts", "kind"), {"end": "completed"}), "t7").collect()
    for user in range(3):
        own = [(t, k) for t, k, u in rows if u == user]
        first = next((n for n, (_, k) in enumerate(own) if kinds[k] == "end"), None)
        mine = [r for r in got if r.run == str(user)]
        if first is None:
            assert mine == []
        else:
            (closed,) = [r for r in mine if r.what == "closed"]
            assert (closed.event_id, closed.events, closed.status) == (own[first][1], first, "completed")
            assert {r.event_id for r in mine if r.what == "rejected"} >= {k for _, k in own[first + 1 :]}


def test_only_what_has_changed_is_built_again(spark, tmp_path):
    built = []

    def build(own):
        built.append(sorted(r.project for r in own.select("project").distinct().collect()))
        return own.groupBy("project").agg(F.sum("x").alias("s"))

    rows = lambda *own: spark.createDataFrame(own, "project string, x int")
    model = Incremental(spark, str(tmp_path), build)
    first = [("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    assert model.refresh(rows(*first)) == "full" and model.refresh(rows(*reversed(first))) == "unchanged"
    assert model.refresh(rows(("a", 1), ("a", 2), ("b", 9), ("c", 4))) == "incremental"
    assert model.refresh(rows(("a", 1), ("a", 2), ("b", 9), ("c", 5), ("c", None))) == "incremental"
    assert built == [["a", "b", "c"], ["b"], ["c"]]
    assert {(r.project, r.s, r["of"]) for r in model.rows().collect()} == {("a", 3, 1), ("b", 9, 2), ("c", 5, 3)}
    assert model.refresh(rows(("a", 1), ("b", 9))) == "full" and built[-1] == ["a", "b"]
    assert {(r.project, r.s, r["of"]) for r in model.rows().collect()} == {("a", 1, 4), ("b", 9, 4)}
