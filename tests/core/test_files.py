import pyarrow as pa
from gleanery.functions import columns as C
from gleanery.sources import io


def test_files_are_told_by_what_they_hold(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.txt").write_bytes(b"\xef\xbb\xbf" + '{"data": [{"id": 1, "t": "甲"}, {"id": 2, "t": "乙"}], "n": 2}'.encode())
    (tmp_path / "j" / "b.json").write_text('{"id": 3, "t": "x"}\n\n{"id": 4, "t": "y z"}\n')
    (tmp_path / "j" / "c.csv").write_text('[{"id": 5}]')
    got = sorted((r.id, r.t) for r in io.read_any(spark, str(tmp_path / "j")).collect())
    assert got == [(1, "甲"), (2, "乙"), (3, "x"), (4, "y z"), (5, None)]
    assert io.file_records(b'{"products": [{"a": 1}], "sellers": [{"b": 2}]}') == ['{"products": [{"a": 1}], "sellers": [{"b": 2}]}']
    assert io.file_records(b'{"products": [{"a": 1}], "n": []}') == ['{"a": 1}'] and io.file_records(b'{"x": {"y": [1]}}', "x.y") == ["1"]
    assert io.file_records(b"a,b\n1,2") is None and io.file_records(b"") is None


def test_each_file_has_its_encoding(spark, tmp_path):
    (tmp_path / "u.csv").write_text("城市,n\n北京,1\n", encoding="utf-8")
    (tmp_path / "g.csv").write_bytes("城市,n\n广州,2\n".encode("gbk"))
    (tmp_path / "late.csv").write_bytes(b"\xb3\xc7\xca\xd0,n\n" + b"a,3\n" * 30_000 + "深圳,4\n".encode("gb18030"))
    rows = io.read_csv(spark, str(tmp_path)).collect()
    assert {r.城市 for r in rows} == {"北京", "广州", "a", "深圳"} and len(rows) == 30_003
    assert {r.城市 for r in io.read_any(spark, str(tmp_path)).collect()} == {"北京", "广州", "a", "深圳"}


def test_captured_responses(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"json": {"d": {"rows": [{"a": 1}, {"a": 2}, 7]}}}, {"d": {"rows": {"a": 3}}}, {"json": {"x": 1}}]')
    (tmp_path / "d.json").write_text('{"no": "list"}')
    (tmp_path / "e.json").write_text("broken")
    got = sorted(r[0] for r in io.capture_records(spark, str(tmp_path), "d.rows").selectExpr("to_json(record)").collect())
    assert got == ['{"a":1}', '{"a":2}', '{"a":3}']
    assert io.capture_records(spark, str(tmp_path)).count() == 3


def test_lists_of_captured_responses_a_line(spark, tmp_path):
    (tmp_path / "lines.txt").write_text('\n[{"d": {"rows": [{"a": 1}]}}]\r\n["x"]\n\n{"no": "list"}\n[{"json": {"d": {"rows": [{"a": 2}, {"a": 3}]}}}]\n')
    (tmp_path / "one.txt").write_text('[\n  {"d": {"rows": [\n{"a": 4},\n{"a": 5}]}}\n]\n')
    got = sorted(r[0] for r in io.capture_records(spark, str(tmp_path), "d.rows").selectExpr("to_json(record)").collect())
    assert got == [f'{{"a":{i}}}' for i in range(1, 6)]


def test_python_holds_a_portion_at_a_time():
    """Columns of Arrow batches in pieces of bounded rows and bytes, nothing lost, also beside each other."""
    wide = pa.array([b"x" * (1 << 20)] * 9 + [b"y" * (6 << 20), None], pa.binary())
    many = pa.array([b""] * 1000, pa.binary())
    for column in (wide, many, wide.slice(3), many.slice(0, 0)):
        parts = list(C.portions([column]))
        assert [x for p in parts for x in p.to_pylist()] == column.to_pylist()
        assert all(len(p) <= C.PORTION_ROWS and (len(p) == 1 or p.nbytes <= C.PORTION_BYTES) for p in parts)
    pairs = list(C.portions([(pa.array(range(11)), wide)]))
    assert [i for a, _ in pairs for i in a.to_pylist()] == list(range(11)) and all(len(a) == len(b) for a, b in pairs)
