"""Records and an account out of files of mixed kinds, some broken, some published twice."""

import io
import random
import zipfile

from gleanery.functions import columns as C
from gleanery.sources import many_files, workbook
from pyspark.sql import functions as F

HEAD = ["序号", "应用名称", "企业名称", "版本"]


def docx(rows):
    body = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
    return out.getvalue()


def xlsx(rows):
    out = io.BytesIO()
    workbook.write_workbook(out, rows[0], iter([list(r) for r in rows[1:]]))
    return out.getvalue()


def comma(rows):
    return "\n".join(",".join(map(str, r)) for r in rows).encode("gb18030")


def listed(prefix, n, start=0, glue=False):
    return [HEAD, *[[str(i + 1), f"{prefix}{start + i}" + ("1.0" if glue else ""), f"{prefix}公司{i}", "1.0"] for i in range(n)]]


def test_many_files(spark):
    again = [["复测名单", "", "", ""], *listed("丙", 5)]
    files = {
        "a.docx": docx(listed("甲", 20)), "b.xlsx": xlsx(listed("甲", 20, 1)), "c.csv": comma(listed("乙", 10)), "d.csv": comma(listed("乙", 10)), "e.csv": comma(again),
        "f.xlsx": b"PK\x03\x04 broken", "g.pdf": b"%PDF-1.4 x", "h.csv": b"", "i.json": '[{"序号": "1", "应用名称": "丁", "企业名称": "丁公司", "版本": "2"}]'.encode(), "j.txt": b"no list here", "k.xlsx": xlsx(listed("甲", 20))[:300],
        "l.json": b"{broken",
    }
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in files.items()], "path string, content binary").repartition(3)
    records, account = many_files.tables_of(df)
    told = {r.path: (r.chain, r.n_rows, r.part, r.kept_file) for r in account.collect()}
    assert told["a.docx"] == ("docx", 20, "kept", "a.docx") and told["b.xlsx"] == ("xlsx", 20, "same list", "a.docx")  # 19 of 20 names
    assert told["c.csv"] == ("csv", 10, "kept", "c.csv") and told["d.csv"][2:] == ("same list", "c.csv")
    assert told["e.csv"] == ("csv", 5, "kept", "e.csv") and told["i.json"] == ("json", 1, "kept", "i.json")
    assert {p: t[1:] for p, t in told.items() if p in "f.xlsx g.pdf h.csv j.txt k.xlsx l.json"} == {p: (0, "nothing", None) for p in ("f.xlsx", "g.pdf", "h.csv", "j.txt", "k.xlsx", "l.json")}
    errors = {r.path: r.error for r in account.collect() if r.error}
    assert set(errors) == {"f.xlsx", "g.pdf", "k.xlsx", "l.json"} and errors["f.xlsx"].startswith("BadZipFile") and told["h.csv"][0] == told["j.txt"][0] == "csv"
    got = {}
    for r in records.collect():
        got.setdefault((r.source_file, r.list_kind), []).append(r.app_name)
    assert {k: len(v) for k, v in got.items()} == {("a.docx", ""): 20, ("c.csv", ""): 10, ("e.csv", "复测"): 5, ("i.json", ""): 1}
    assert sorted(got["c.csv", ""]) == sorted(f"乙{i}" for i in range(10))


def test_the_cleaner_upload_stays(spark):
    glued = [HEAD, *[[str(i), f"app{i} 1.0", f"co{i}", "1.0" if i < 3 else "2"] for i in range(1, 9)]]
    clean = [HEAD, *[[str(i), f"app{i} 1.0", f"co{i}", "2"] for i in range(1, 9)]]
    df = spark.createDataFrame([("1.csv", bytearray(comma(glued))), ("2.csv", bytearray(comma(clean))), ("3.csv", bytearray(comma(clean)))], "path string, content binary")
    records, account = many_files.tables_of(df)
    assert {r.path: r.kept_file for r in account.collect()} == {"1.csv": "2.csv", "2.csv": "2.csv", "3.csv": "2.csv"}
    assert {r.source_file for r in records.collect()} == {"2.csv"}
    assert many_files.tables_of(df.limit(0))[1].count() == 0


def test_leaders_against_a_loop(spark):
    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = {(a, b) for a in names for b in names if a < b and rng.random() < 0.08}
    kept, want = [], {}
    for n in names:
        hit = next((k for k in kept if (k, n) in pairs), None)
        if hit is None:
            kept.append(n)
        else:
            want[n] = hit
    got = many_files.leaders(spark.createDataFrame(sorted(pairs), "a string, b string"))
    assert {r.member: r.leader for r in got.collect()} == want


def test_kinds_of_real_files(spark):
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("notes.txt", "xl/workbook.xml word/document.xml")
        z.writestr("inner.xlsx", xlsx(listed("甲", 2)))
    deck = io.BytesIO()
    with zipfile.ZipFile(deck, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ppt/presentation.xml", "<p/>")
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 64
    cases = [
        (docx(listed("甲", 2)), "docx"), (xlsx(listed("甲", 2)), "xlsx"), (plain.getvalue(), "zip"), (deck.getvalue(), "pptx"), (xlsx(listed("甲", 2))[:-30], "zip"), (b"%PDF-1.7", "pdf"),
        (ole + "Workbook".encode("utf-16-le"), "xls"), (ole + "WordDocument".encode("utf-16-le"), "doc"), (ole, "ole"), (b"\x1f\x8b\x08", "gz"), (b"GIF89a", "gif"), (b"text", "unknown"), (b"", "unknown"), (None, "unknown"),
    ]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    assert [r.k for r in df.select("i", C.file_kind(F.col("b")).alias("k")).orderBy("i").collect()] == [k for _, k in cases]
