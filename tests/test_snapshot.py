"""Whole snapshots against a plain replay of the relay's per-tick rule."""

import json
import random

import pytest

from meshframes.operators import health as hl
from meshframes.sources.output import telemetry_messages

URLS = {"a": "wss://a/ws", "b": "wss://b/ws", "quiet": "wss://quiet/ws", "late": None}


def _inputs(seed, tick_times):
    r = random.Random(seed)
    span = max(tick_times) + 4_000 if tick_times else 10_000
    states = ["connected", "connected", "reconnect_wait", "disconnected", "connecting"]
    conn = [(s, r.randrange(-5_000, span), i, r.choice(states)) for i in range(60) for s in (r.choice(["a", "b", "stranger"]),)]
    conn.append(("late", span - 1, 99, "connected"))
    frames = [(r.choice(["a", "b", "stranger"]), r.randrange(-5_000, span)) for _ in range(80)]
    rates = [(s, t, float(r.randrange(9)), float(r.randrange(900))) for t in tick_times for s in ("a", "b") if r.random() < 0.7 or s == "a"]
    cpu = [(inst, r.randrange(-5_000, span), i, float(i % 7)) for i in range(30) for inst in ("i-0", "i-1")]
    mem = [(inst, r.randrange(0, span), i, i * 1000) for i in range(20) for inst in ("i-0", "i-1")]
    subs = [(r.randrange(-5_000, span), r.random() < 0.7) for _ in range(40)]
    return conn, frames, rates, cpu, mem, subs


def _plain(tick_times, conn, frames, rates, cpu, mem, subs):
    out = []
    for t in sorted(tick_times):
        sources = []
        for s in sorted(URLS):
            mine = sorted((at, i, st) for x, at, i, st in conn if x == s and at <= t)
            state, since = (mine[-1][2] if mine else "disconnected"), None
            if state == "connected":
                for at, _, st in reversed(mine):
                    if st != "connected":
                        break
                    since = at
            heard = [at for x, at in frames if x == s and at <= t]
            p, b = next(((p, b) for x, at, p, b in rates if x == s and at == t), (0.0, 0.0))
            sources.append((s, URLS[s], state, p, b, None if since is None else (t - since) // 1000, (t - max(heard)) // 1000 if heard else None))
        last = lambda rows: max(((at, i, v) for x, at, i, v in rows if x == "i-0" and at <= t), default=(0, 0, 0))[2]
        clients = sum(1 if o else -1 for at, o in subs if at <= t)
        out.append((t, sources, sum(x[3] for x in sources), round(sum(x[4] for x in sources) * 8 / 1000, 6), float(last(cpu)), last(mem), clients))
    return out


def _run(spark, conn, frames, rates, cpu, mem, subs):
    mk = spark.createDataFrame
    return hl.telemetry_snapshot(
        mk([(i, u) for i, u in URLS.items()], "id string, url string"),
        mk(rates, "source string, at_ms long, packets_per_s double, bytes_per_s double"),
        mk(conn, "source string, at_ms long, seq long, state string"),
        mk(frames, "source string, received_at_ms long"),
        mk(cpu, "instance string, at_ms long, event_id long, cpu_percent double"),
        mk(mem, "instance string, at_ms long, event_id long, rss_bytes long"),
        mk(subs, "at_ms long, opened boolean"), "i-0")


@pytest.mark.parametrize("ticks", [[i * 1000 for i in range(40)], [0, 7, 1009, 5000, 5003, 30_017], [12_000]], ids=["each second", "uneven", "one"])
def test_snapshots_against_a_replay(spark, monkeypatch, ticks):
    monkeypatch.setattr(hl, "TICK_BLOCK", 4)  # spells reach over many blocks
    given = _inputs(len(ticks), ticks)
    snap = _run(spark, *given)
    got = [(r.at_ms, [tuple(x) for x in r.sources], r.pps, round(r.kbps, 6), r.cpu_percent, r.memory_bytes, r.clients) for r in snap.orderBy("at_ms").collect()]
    assert got == _plain(ticks, *given)
    assert [f.name for f in snap.schema["sources"].dataType.elementType.fields] == ["id", "url", "state", "packets", "bytes", "connected_secs", "last_packet_secs_ago"]


def test_messages_keep_missing_values_as_null(spark):
    given = _inputs(5, [1000, 2000])
    m = json.loads(telemetry_messages(_run(spark, *given)).orderBy("at_ms").first()["message"])
    assert list(m) == ["sources", "pps", "kbps", "cpu_percent", "memory_bytes", "clients"]
    quiet = next(x for x in m["sources"] if x["id"] == "quiet")
    assert quiet == {"id": "quiet", "url": "wss://quiet/ws", "state": "disconnected", "packets": 0.0, "bytes": 0.0, "connected_secs": None, "last_packet_secs_ago": None}


def test_no_ticks_no_snapshot(spark):
    conn, frames, _, cpu, mem, subs = _inputs(1, [0])
    assert _run(spark, conn, frames, [], cpu, mem, subs).count() == 0


def test_grid_of_ticks(spark):
    grid = lambda ts: hl.tick_grid(spark.createDataFrame([(t,) for t in ts], "at_ms long"))
    assert grid([3_600_000, 7_200_000]) == 3_600_000 and grid([1000, 61_000]) == 1000 and grid([0, 10_000]) == 10_000 and grid([5, 1000]) == 1
    ticks = spark.createDataFrame([(5, 0), (9, 1), (20, 2)], "at_ms long, tick long")
    times = spark.createDataFrame([(t,) for t in (-3, 5, 6, 9, 10, 20, 21)], "at_ms long")
    assert {(r.at_ms, r.tick) for r in hl.first_ticks(times, ticks, 1).collect()} == {(-3, 0), (5, 0), (6, 1), (9, 1), (10, 2), (20, 2), (21, 3)}
