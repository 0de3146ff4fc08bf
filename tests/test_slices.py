"""Python holds objects of few rows at once: batches are taken by slices, and results leave by slices."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql.types import LongType

from sparkloom import session
from sparkloom.operators import chunking, setjoin


class Rows:
    """Stands for a DataFrame whose Arrow function is to be called here."""

    schema = {"doc_id": SimpleNamespace(dataType=LongType())}

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return lambda *batches: list(run(iter(batches)))


def test_slices_are_few_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(session, "SLICE_BYTES", 1000)
    texts = [None, ""] + ["x"] * 2000 + ["y" * 900] * 40 + ["z" * 5000] * 3
    parts = list(session.slices(iter([pa.record_batch({"t": texts}), pa.record_batch({"t": pa.array([], pa.string())})])))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= 256 and (p.num_rows == 1 or p.nbytes <= 2000) for p in parts)


def test_chunks_leave_by_slices():
    texts = [None, "  ", "short"] + [f"{k} line\n" * 40 for k in range(3000)]
    out = chunking.chunks(Rows(), "newline", 100)(pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": texts}))
    assert len(out) > 10
    got = [(r["doc_id"], r["chunk_index"], r["body"]) for b in out for r in b.to_pylist()]
    assert got == [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate(chunking.cut(t or "", 100, 0, ("\n",), 0.6))]


def test_sets_leave_by_slices():
    sets = [None, []] + [[f"w{k % 7}", f"v{k % 11}", "hot"] for k in range(3000)]
    batch = pa.record_batch({"id": pa.array(range(len(sets))), "words": pa.array(sets, pa.list_(pa.string()))})
    for prefix in (False, True):
        out = setjoin._placed(Rows(), {"hot": 1}, 0.5, prefix)(batch)
        assert len(out) > 10
        got = [(r["id"], r["size"], r["word"], r["place"]) for b in out for r in b.to_pylist()]
        assert got == [(i, 3, w, k) for i, own in enumerate(sets) if own for k, w in enumerate(sorted(own, key=lambda w: (w == "hot", w))[: 2 if prefix else 3])]
