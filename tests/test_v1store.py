"""The token store: what is written comes back by scan, by epoch and by span; failed tasks leave no part of it."""

import json
import random

import pytest

from sparkloom.plans import stores
from sparkloom.sources import v1store


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(None if k == 17 else k * 7, [rng.randrange(2**31) for _ in range(rng.choice((0, 1, 5, 40)))], [rng.randrange(99) for _ in range(rng.choice((0, 2, 9)))]) for k in range(300)]


SCHEMA = "sample_id long, inst array<int>, resp array<int>"


def offsets(rows):
    out, at = [], 0
    for key, inst, resp in rows:
        out.append((key, at, len(inst), at + len(inst), len(resp), inst, resp))
        at += len(inst) + len(resp)
    return out


@pytest.mark.parametrize(("parts", "take"), [(1, 65_536), (4, 50), (7, 3)])
def test_round_trip(spark, rows, tmp_path, parts, take, monkeypatch):
    monkeypatch.setattr(v1store, "READ_SAMPLES", take)
    monkeypatch.setattr(v1store, "BATCH_SAMPLES", 11)
    path = str(tmp_path / "v1")
    v1store.write_store(spark.createDataFrame(rows, SCHEMA).coalesce(1) if parts == 1 else spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), SCHEMA), path, context_size="64")
    want = offsets(rows)
    assert sorted(map(repr, (tuple(r) for r in v1store.read_store(spark, path).collect()))) == sorted(map(repr, want))
    spans = v1store.read_store(spark, path, ids=False)
    assert "inst" not in spans.columns and sorted(r.resp_start for r in spans.collect()) == sorted(w[3] for w in want)
    meta = v1store.read_metadata(path)
    assert meta["total_length"] == sum(w[2] + w[4] for w in want) and meta["max_seq_len"] == 64 and meta["vocab_size"] is None
    v1store.write_epochs(spark, path, 2)
    orders = []
    for k in range(2):
        found = v1store.read_epoch(spark, path, k).collect()
        assert sorted(repr(tuple(r)[1:]) for r in found) == sorted(map(repr, want))
        assert sorted(r.pos for r in found) == list(range(300))
        orders.append([r.sample_id for r in sorted(found, key=lambda r: r.pos)])
    assert orders[0] != orders[1]


def test_appended_parts_stand_behind(spark, rows, tmp_path):
    path = str(tmp_path / "v1")
    one = lambda x: spark.createDataFrame(x, SCHEMA).coalesce(1)
    v1store.write_store(one(rows[:100]), path)
    v1store.write_store(one(rows[100:]), path, mode="append")
    assert sorted(map(repr, (tuple(r) for r in v1store.read_store(spark, path).collect()))) == sorted(map(repr, offsets(rows)))


def test_too_long_samples_and_failed_tasks_leave_nothing(spark, tmp_path):
    path = tmp_path / "v1"
    with pytest.raises(Exception, match="the longest sample has 9 ids"):
        v1store.write_store(spark.createDataFrame([(1, [0] * 5, [1] * 4)], SCHEMA), str(path), context_size="9")
    assert not list(path.rglob("*.ids")) and not (path / "metadata.json").exists()
    empty = spark.createDataFrame([], SCHEMA)
    v1store.write_store(empty, str(path))
    assert v1store.read_store(spark, str(path)).count() == 0
    (path / "tokens" / "part-000000-of-a-lost-task.ids").write_bytes(b"\0" * 40)
    v1store.write_store(spark.createDataFrame([(1, None, [1, 2])], SCHEMA), str(path), tokenizer_info=json.dumps({"boq": 1}))
    assert [tuple(r) for r in v1store.read_store(spark, str(path)).collect()] == [(1, 0, 0, 0, 2, [], [1, 2])]
    assert v1store.read_metadata(str(path))["tokenizer_info"] == {"boq": 1}


def test_framing_runs_once_behind_the_deal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = stores.samples_of(docs)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1


def test_a_file_for_each_page(spark, tmp_path):
    from sparkloom.sources.pagefiles import write_page_files

    path = tmp_path / "pages"
    write_page_files(spark.createDataFrame([(f"q{k}", f"# Question {k}\n\nÉ") for k in range(9)] + [("none", None)], "name string, body string").repartition(3), str(path))
    assert sorted(x.name for x in path.iterdir()) == sorted([*(f"q{k}.md" for k in range(9)), "none.md"])
    assert (path / "q3.md").read_text() == "# Question 3\n\nÉ" and (path / "none.md").read_text() == ""
    with pytest.raises(Exception, match="no name for a file"):
        write_page_files(spark.createDataFrame([("a/b", "x")], "name string, body string"), str(path))
    assert len(list(path.glob("*.md"))) == 10
