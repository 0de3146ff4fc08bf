"""Folder sources, logs, nested JSON and capped sinks on small files; event-time windows."""

import datetime
import json
import shutil

import pytest

from sparkloom.operators import multipack
from sparkloom.sources import trees
from sparkloom.streaming import events


def lines(folder):
    return [x for part in sorted(folder.glob("part-*")) for x in part.read_text().splitlines()]


def test_inputs_are_resolved_and_capped(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, n in (("a", 5), ("d/b", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"k": k}) + "\n" for k in range(n)))
    (tmp_path / "c.txt").write_text("x")
    spark.range(4).selectExpr("cast(id as int) k").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    assert [x.rsplit("/", 1)[1] for x in trees.resolve_inputs([str(tmp_path / "*.jsonl"), str(tmp_path / "d")])] == ["a.jsonl", "b.jsonl"]
    for bad, error in ((str(tmp_path / "c.txt"), ValueError), (str(tmp_path / "none*"), FileNotFoundError)):
        with pytest.raises(error):
            trees.resolve_inputs([bad])
    rows = trees.read_inputs(spark, [str(tmp_path)], "k int", cap=3).collect()
    assert sorted(r.k for r in rows) == sorted([0, 1, 2, 0, 1, 0, 1, 2])


def test_conversations_and_logs(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "conversations": [{"from": "user", "value": "hi"}, {"from": "gpt", "value": "yo"}]}]))
    assert [tuple(r) for r in trees.read_conversations(spark, str(tmp_path / "c.json")).collect()] == [("a", 0, "user", "hi"), ("a", 1, "gpt", "yo")]
    (tmp_path / "logs").mkdir()
    own = [{"type": "session", "id": "s1"}, {"type": "message", "message": {"role": "user", "content": "q"}}, {"type": "other"}, {"type": "message", "message": {"role": "assistant", "content": "a"}}]
    (tmp_path / "logs" / "x.jsonl").write_text("\n".join(map(json.dumps, own)))
    (tmp_path / "logs" / "y.jsonl").write_text(json.dumps(own[1]))
    rows = trees.read_session_logs(spark, str(tmp_path / "logs")).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in rows] == [("s1", 0, "user", "q"), ("s1", 1, "assistant", "a"), ("y", 0, "user", "q")]


def test_registry_tasks_and_config(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "set" / "train"))
    assert trees.read_dataset(spark, str(tmp_path), {"s": ("parquet", "set")}, "s", cap=3).count() == 3
    tasks = spark.createDataFrame([("b", 5), ("a", 3), ("c", 1)], "task string, n_tokens long")
    assert [(r.task, r.base) for r in trees.task_bases(tasks).orderBy("task").collect()] == [("a", 0), ("b", 3), ("c", 8)]
    (tmp_path / "c.yaml").write_text('- prefix: "law"\n  max_per_file: 10\n  repeat: 2\n- prefix: wiki\n  long_context: truncate\n')
    assert [tuple(r) for r in trees.prefix_config(spark, str(tmp_path / "c.yaml")).collect()] == [(0, "law", 10, "drop", 2), (1, "wiki", None, "truncate", 1)]


def test_json_strings_and_nested(spark):
    rows = spark.createDataFrame([('{"a": ["x", {"b": " y "}], "c": 1, "d": ""}',), ("plain",), (None,)], "j string")
    assert [r.text for r in trees.json_strings(rows, "j").collect()] == ["x", "y", "plain"]
    assert [r.j.a for r in trees.parse_nested(spark.createDataFrame([('{"a": 3}',), ("bad",), (None,)], "j string"), "j", "a int").collect()] == [3]
    assert trees.holding_terms(rows, "j", ["pla", "zzz"]).count() == 1


def test_trees(spark, tmp_path):
    for name, text in (("law/a.md", "12345"), ("law/b.md", "abcde"), ("law/.junk.md", "no"), ("act/z.md", "zzzzz"), ("act/b.md", "b")):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    root = str(tmp_path / "r")
    assert [r.text for r in trees.sample_tree(spark, root, 9).orderBy("path").collect()] == ["b", "zzzzz", "123"]
    assert {(r.folder, r.files, r.bytes) for r in trees.folder_sizes(spark, root).collect()} >= {("act", 2, 6)}
    found = {r.entity: r.path.rsplit("/", 1)[1] for r in trees.entity_index(spark, root, ["z.md", "b.md"]).collect()}
    assert found == {"law": "b.md", "act": "z.md"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(k, "s" if k % 2 else "t", "x" * k) for k in range(6)], "k long, source string, x string")
    stats = trees.write_jsonl_with_stats(rows, str(tmp_path / "out"))
    assert stats["rows"] == 6 and stats["by_source"] == {"s": 3, "t": 3}
    assert json.loads(lines(tmp_path / "out.stats.json")[0]) == stats
    size = [len(json.dumps({"k": k, "source": "s", "x": "x" * k}, separators=(",", ":"))) + 1 for k in range(6)]
    trees.write_capped_jsonl(rows, str(tmp_path / "capped"), "k", sum(size[:3]) + 1)
    assert [json.loads(x)["k"] for x in lines(tmp_path / "capped")] == [0, 1, 2]
    for first, want in ((False, []), (True, [0])):
        trees.write_capped_jsonl(rows, str(tmp_path / f"first{first}"), "k", 3, first_row=first)
        assert [json.loads(x)["k"] for x in lines(tmp_path / f"first{first}")] == want
    pair = spark.createDataFrame([("q", "a")], "instruction string, response string")
    trees.write_messages(pair, str(tmp_path / "chat"))
    assert json.loads(lines(tmp_path / "chat")[0]) == {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    trees.write_pages(spark.createDataFrame([("p1", "# one\ntwo"), ("p2", "x")], "name string, body string"), str(tmp_path / "pages"))
    assert lines(tmp_path / "pages" / "name=p1") == ["# one", "two"]


def test_windows_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "a.parquet")
    source = events.read_events(spark, str(tmp_path / "in"))
    events.drain(events.tumbling_counts(source), str(tmp_path / "t"), str(tmp_path / "tm"))
    events.drain(events.sessions(source), str(tmp_path / "s"), str(tmp_path / "sm"))
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # windows that the watermark hasn't passed are still open
    last = table.agg({"ts": "max"}).first()[0] - datetime.timedelta(minutes=10)
    hours = {(r.start.replace(tzinfo=None), r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    want = {}
    for r in table.collect():
        start = r.ts.replace(minute=0, second=0, microsecond=0)
        if start + datetime.timedelta(hours=1) <= last:
            want[start, r.event_type] = want.get((start, r.event_type), 0) + 1
    assert hours == want
    assert 0 < spark.read.parquet(str(tmp_path / "s")).agg({"n": "sum"}).first()[0] <= table.count()


def test_tails_of_shards_are_packed(spark):
    rows = spark.createDataFrame([(k, 10) for k in range(103)], "sample_id long, length long")
    packed = multipack.pack(rows, capacity=20, ranks=4, shard_rows=20).collect()
    ids = [r.sample_id for r in packed]
    assert len(ids) == len(set(ids)) and len(ids) > 103 - 4
    loads = {}
    for r in packed:
        loads[r.shard, r.batch, r.rank] = loads.get((r.shard, r.batch, r.rank), 0) + 10
    assert max(loads.values()) <= 20
