"""Archives, zipped XML and HTML tables."""

import zipfile

from sparkloom.sources import archives


def test_zip_and_hwpx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../x/한글.txt", "one")
        z.writestr("b.bin", b"\0\1")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    rows = archives.read_zip(spark, str(tmp_path)).collect()
    assert sorted((r.member, bytes(r.content)) for r in rows) == [("b.bin", b"\0\1"), ("x/한글.txt", b"one")]
    with zipfile.ZipFile(tmp_path / "d.hwpx", "w") as z:
        for k, body in ((10, "last"), (2, "first")):
            z.writestr(f"Contents/section{k}.xml", f'<s xmlns:h="u"><h:p><h:t>{body} </h:t><h:t>part</h:t></h:p><h:p/></s>')
    assert [r.text for r in archives.read_hwpx(spark, str(tmp_path)).collect()] == ["first part\nlast part"]


def test_stored_name():
    info = zipfile.ZipInfo("시험.txt".encode("cp949").decode("cp437"))
    assert archives.member_name(info) == "시험.txt"


def test_answer_tables(spark):
    page = "<table><tr><th>No</th><th>Answer</th></tr><tr><td>1</td><td>③</td><td>2</td><td>5</td></tr><tr><td>x</td><td>y</td></tr></table><table><tr><td>3</td><td>4</td></tr></table>"
    rows = archives.answer_tables(spark.createDataFrame([(7, page), (8, None)], "page_id long, html string"), ("No", "Answer"))
    assert sorted(tuple(r) for r in rows.collect()) == [(7, 0, 1, "③"), (7, 0, 2, "5")]
