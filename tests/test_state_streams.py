"""State machines over streams of several batches and restarts against their tables and one event at a time."""

import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming import buffers, conversations

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, stream, folder, name):
    """All that is there now, one file a batch, with the query's own checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def plainly(events):
    """One conversation's events in order, by the rules as told."""
    out, statuses, requests, parts, writers, answering, update = [], set(), set(), [], set(), False, (None, None)
    for n, (conv, seq, kind, message, text, tools) in enumerate(events):
        told = [("status", "thinking")] if n == 0 else []
        end = False
        if kind == "stage" and text in conversations.STAGES:
            told.append((conversations.STAGES[text], text))
        if kind in ("chunk", "update") and tools:
            if kind == "chunk":
                requests.add(message)
            if kind == "chunk" and message in writers:
                told.append(("error", conversations.REQUEST_WITH_TEXT))
                end = True
            else:
                for tool, status in [("recipe_search", "searching_recipe_kb"), ("web_search", "searching_web"), (None, "using_tool")]:
                    called = tool in tools if tool else bool(set(tools) - {"recipe_search", "web_search", "generate_dish_image"})
                    if called and status not in statuses:
                        statuses.add(status)
                        told.append(("status", status))
        elif kind == "chunk" and text:
            if message in requests:
                told.append(("error", conversations.REQUEST_WITH_TEXT))
                end = True
            else:
                told += [("status", "generating_answer")] * (not answering) + [("token", text)]
                answering = True
                parts.append(text)
                writers.add(message)
        elif kind == "update" and text:
            update = (message, text)
        elif kind == "end":
            end, whole, final = True, "".join(parts), text or ""
            if whole and whole != final:
                told.append(("error", conversations.UNLIKE_FINAL))
            elif message is not None and writers and writers != {message}:
                told.append(("error", conversations.OTHER_MESSAGE))
            elif update[0] is not None and update[0] == message and update[1] != final:
                told.append(("error", conversations.UNLIKE_UPDATE))
            else:
                if not whole:
                    told += [("status", "generating_answer")] * (not answering) + [("token", final)]
                told += [("status", "completed"), ("done", None)]
        out += [(conv, seq, part, *t) for part, t in enumerate(told)]
        if end:
            break
    return out


def talk(rng, conv):
    events, seq, said = [], 0, ""
    tools = ["recipe_search", "web_search", "lookup", "generate_dish_image"]
    for _ in range(rng.randint(0, 14)):
        seq += rng.randint(1, 3)
        kind = rng.choice(["stage", "chunk", "chunk", "chunk", "tools", "tools", "update", "updated"])
        if kind == "stage":
            events.append((conv, seq, "stage", None, rng.choice([*conversations.STAGES, "other", None]), None))
        elif kind == "chunk":
            text = rng.choice(["ab", "c", "", None, "dé "])
            said += text or ""
            events.append((conv, seq, "chunk", "m" if rng.random() < 0.95 else rng.choice(["t1", "m2"]), text, rng.choice([None, []])))
        elif kind == "tools":
            events.append((conv, seq, "chunk", rng.choice(["t1", "t2"]) if rng.random() < 0.95 else "m", None, rng.sample(tools, rng.randint(1, 2))))
        elif kind == "update":
            events.append((conv, seq, "update", None, None, rng.sample(tools, 1)))
        else:
            events.append((conv, seq, "update", rng.choice(["m", "m3"]), rng.choice([said, said, "else"]), None))
    if rng.random() < 0.8:
        for _ in range(rng.randint(1, 2)):  # an end may come twice
            seq += 1
            events.append((conv, seq, "end", rng.choice(["m", "m", "m", None, "m9"]), said if rng.random() < 0.8 else "else", None))
    return events


SCHEMA = "conv_id long, seq long, kind string, message_id string, text string, tools array<string>"


def test_conversations_as_stream_table_and_one_event_at_a_time(rocks, tmp_path):
    rng = random.Random(7)
    talks = [talk(rng, c if c != 7 else None) for c in range(120)]
    expected = sorted((t for events in talks for t in plainly(events)), key=repr)
    every = [e for events in talks for e in events]
    table = rocks.createDataFrame(every, SCHEMA)
    assert sorted(map(tuple, conversations.told(table).collect()), key=repr) == expected
    assert {t[4] for t in expected if t[3] == "error"} == {conversations.REQUEST_WITH_TEXT, conversations.UNLIKE_FINAL, conversations.OTHER_MESSAGE, conversations.UNLIKE_UPDATE}
    ends = [t[0] for t in expected if t[3] in ("done", "error")]
    assert len(ends) == len(set(ends)) > 60
    source = str(tmp_path / "in")
    stream = lambda: conversations.told_stream(rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    for part in range(3):  # three runs, each from the checkpoint of the one before, of two batches each
        for half in range(2):
            slot = 2 * part + half
            rows = [e for events in talks for i, e in enumerate(events) if i * 6 // max(1, len(events)) == slot]
            rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = run(rocks, stream(), str(tmp_path), "told")
    assert sorted(map(tuple, out.select("conv_id", "seq", "part", "event", "value").collect()), key=repr) == expected


def test_buffers_as_stream_table_and_one_put_at_a_time(rocks, tmp_path):
    rng, ttl, capacity = random.Random(3), 100, 4
    start, puts = datetime(2024, 1, 1), []
    for key in range(5):
        at = 0
        for n in range(40):
            at += rng.choice([0, 1, 5, 20, 40, 100, 101, 230])
            puts.append((key, n if rng.random() < 0.9 else 0, start + timedelta(seconds=at)))
    expected = []
    for key in range(5):
        there = []
        for _, item, ts in sorted((p for p in puts if p[0] == key), key=lambda p: (p[2], p[1])):
            for t, i in [x for x in there if (ts - x[0]).total_seconds() > ttl]:
                there.remove((t, i))
                expected.append((key, i, t, "expired", t + timedelta(seconds=ttl)))
            if len(there) >= capacity:
                t, i = there.pop(0)
                expected.append((key, i, t, "evicted", ts))
            there.append((ts, item))
        expected += [(key, i, t, "expired", t + timedelta(seconds=ttl)) for t, i in there]
    expected = sorted(expected, key=repr)
    schema = "key long, item long, ts timestamp"
    table = rocks.createDataFrame(puts + [(1, 1, None)], schema)
    assert sorted(map(tuple, buffers.fates(table, ttl, capacity).collect()), key=repr) == expected
    assert {e[3] for e in expected} == {"expired", "evicted"}
    now = start + timedelta(seconds=700)
    there = {(k, i, t) for k, i, t, _, _ in expected if t <= now} - {(k, i, t) for k, i, t, fate, at in expected if at < now or (fate == "evicted" and at <= now)}
    assert {tuple(r) for r in buffers.held(table, str(now), ttl, capacity).collect()} == there
    source, late = str(tmp_path / "in"), start + timedelta(days=2)
    stream = lambda: buffers.fates_stream(rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), ttl, capacity)
    ordered = sorted(puts, key=lambda p: p[2])
    cuts = [0, 70, 140, len(ordered)]
    for a, b in zip(cuts, cuts[1:]):
        while b < len(ordered) and ordered[b][2] == ordered[b - 1][2]:
            b += 1
        rocks.createDataFrame([p for p in ordered if (p[2] > ordered[a - 1][2] if a else True) and p[2] <= ordered[b - 1][2]], schema).coalesce(1).write.mode("append").parquet(source)
        run(rocks, stream(), str(tmp_path), "fates")
    rocks.createDataFrame([(99, 0, late)], schema).coalesce(1).write.mode("append").parquet(source)  # time goes on, without a put of theirs
    out = run(rocks, stream(), str(tmp_path), "fates")
    got = sorted(map(tuple, out.select("key", "item", "put", "fate", "at").where("key < 99").collect()), key=repr)
    assert (set(expected) - set(got), set(got) - set(expected)) == (set(), set()) and got == expected
