"""Connection health on small hand-made event logs."""

from meshframes.operators import health as hl
from meshframes.schema import ReconnectPolicy

EV = "source string, at_ms long, state string, error string, seq long"


def _ev(spark, rows):
    return spark.createDataFrame([(s, t, st, e, i) for i, (s, t, st, e) in enumerate(rows)], EV)


def test_state_asof_and_connected_seconds(spark):
    ce = _ev(spark, [("a", 0, "connecting", None), ("a", 1000, "connected", None), ("a", 5000, "connected", None),
                     ("b", 0, "connected", None), ("b", 2000, "reconnect_wait", "x")])
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    st = {r["source"]: (r["state"], r["state_code"]) for r in hl.state_asof(ce, 9500, cat).collect()}
    assert st == {"a": ("connected", 4), "b": ("reconnect_wait", 5), "c": ("disconnected", 1)}
    cs = {r["source"]: r["connected_secs"] for r in hl.connected_seconds(ce, 9500, cat).collect()}
    assert cs == {"a": 8, "b": None, "c": None}


def test_episodes(spark):
    ce = _ev(spark, [("a", 0, "connected", None), ("a", 10_000, "disconnected", None),
                     ("a", 12_000, "reconnect_wait", "e"), ("a", 20_500, "connected", None)])
    got = sorted((r["spell"], r["kind"], r["start_ms"], r["end_ms"], r["seconds"], r["changes"]) for r in hl.episodes(ce).collect())
    assert got == [(1, "connected", 0, 10_000, 10, 1), (2, "offline", 10_000, 20_500, 10, 2), (3, "connected", 20_500, None, None, 1)]


def test_retry_waits_backoff_and_degraded(spark):
    rows = [("a", 0, "connected", None), ("a", 1000, "disconnected", None)]
    t = 1000
    for _ in range(8):
        t += 10_000
        rows.append(("a", t, "reconnect_wait", "e"))
    rows.append(("a", t + 1, "connected", None))
    rows.append(("a", t + 2, "reconnect_wait", None))
    p = ReconnectPolicy(initial_delay_s=1, max_delay_s=30, offline_threshold_s=60, offline_delay_s=300)
    got = [(r["kind"], r["attempt"], r["wait_s"]) for r in hl.retry_waits(_ev(spark, rows), p).orderBy("at_ms").collect()]
    assert got == [("normal", 0, 1.0), ("normal", 1, 2.0), ("normal", 2, 4.0), ("normal", 3, 8.0), ("normal", 4, 16.0),
                   ("degraded", None, 300.0), ("degraded", None, 300.0), ("degraded", None, 300.0), ("normal", 0, 1.0)]


def test_last_packet_age_levels_and_quiet(spark):
    frames = spark.createDataFrame([("a", 100_000), ("b", 30_000), ("b", 200_000)], "source string, received_at_ms long")
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    ages = hl.last_packet_age(frames, 150_000, cat)
    got = {r["source"]: (r["last_packet_secs_ago"], r["idle_level"]) for r in ages.collect()}
    assert got == {"a": (50, "ok"), "b": (120, "warn"), "c": (None, None)}
    states = spark.createDataFrame([("a", "connected"), ("b", "connected"), ("c", "connected")], "source string, state string")
    assert sorted(r["source"] for r in hl.quiet_sources(states, ages).collect()) == ["b", "c"]
    table = hl.status_table(states.filter("source <> 'c'").union(spark.createDataFrame([("c", "disabled")], "source string, state string")), ages)
    assert [r["status"] for r in table.collect()] == ["down", "up", "up"]


def test_overall_status_levels(spark):
    def level(states):
        df = spark.createDataFrame([(s,) for s in states], "state string")
        return hl.overall_status(df).first()["level"]

    assert level(["connected", "connected"]) == "ok"
    assert level(["reconnect_wait", "disabled"]) == "bad"
    assert level(["connected", "disconnected"]) == ""
    assert level([]) == ""


def test_offline_clock_of_a_source_that_never_connected_starts_at_its_first_failure(spark):
    rows = [("s", 0, 0, "connecting"), ("s", 50_000, 1, "reconnect_wait"), ("s", 61_000, 2, "reconnect_wait"), ("s", 111_000, 3, "reconnect_wait")]
    ev = spark.createDataFrame(rows, "source string, at_ms long, seq long, state string")
    got = [(r["kind"], r["wait_s"]) for r in hl.retry_waits(ev).orderBy("at_ms").collect()]
    assert got == [("normal", 1.0), ("normal", 2.0), ("degraded", 300.0)]
