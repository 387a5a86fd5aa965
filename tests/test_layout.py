"""Places on PDF pages, and tables found by them."""

from __future__ import annotations

import zlib

import pytest

from sievework.operators import layout
from sievework.plans.pages import pdf_file
from sievework.sources import files, pdf, rich

WORDS = "path string, page int, x0 double, y0 double, x1 double, y1 double, text string"
RULES = "path string, page int, x0 double, y0 double, x1 double, y1 double"


def words_of(rows, left=0.0, step=100.0, top=100.0, path="a", page=1):
    """A word of its letters' width in each cell, 20 points a row."""
    return [(path, page, left + step * j + 5, top + 20.0 * i + 5, left + step * j + 5 + 5 * len(c), top + 20.0 * i + 15, c) for i, row in enumerate(rows) for j, c in enumerate(row) if c]


def grid_of(n, m, left=0.0, step=100.0, top=100.0, path="a", page=1):
    across = [(path, page, left, top + 20.0 * i, left + step * m, top + 20.0 * i) for i in range(n + 1)]
    return across + [(path, page, left + step * j, top, left + step * j, top + 20.0 * n) for j in range(m + 1)]


def found(spark, words, rules=()):
    rows = layout.tables(spark.createDataFrame(words, WORDS), spark.createDataFrame(list(rules), RULES)).collect()
    return {(r["path"], r["page"], r["table_index"], r["method"]): r["data"] for r in rows}


HALF = [["h", "k"], ["1", "2"], ["3", ""]]
ONE = [["h", "k"], ["1", "2"], ["3", "4"]]
TWO = [["x", "y", "z"], ["4", "5", "6"], ["7", "8", "9"], ["", "a", ""]]


def test_ruled_tables_beside_and_below(spark):
    words = words_of(HALF) + words_of(TWO, left=300.0) + words_of(TWO, top=400.0) + words_of([["aside"]], top=350.0)
    rules = grid_of(3, 2) + grid_of(4, 3, left=300.0) + grid_of(4, 3, top=400.0)
    want = {("a", 1, 1, "lattice"): HALF, ("a", 1, 2, "lattice"): TWO, ("a", 1, 3, "lattice"): TWO}
    assert found(spark, words, rules) == want
    assert found(spark, words[::-1] * 1, rules * 3) == want  # neither order nor repeated rules matter


def test_a_file_with_rules_is_not_read_by_gaps(spark):
    words = words_of(ONE) + words_of(TWO, page=2) + words_of(ONE, path="b")
    assert found(spark, words, grid_of(3, 2)) == {("a", 1, 1, "lattice"): ONE, ("b", 1, 1, "stream"): ONE}


def test_tables_by_gaps(spark):
    text = words_of([["Alone"]], top=60.0) + words_of([["Below"]], top=300.0)
    assert found(spark, text + words_of(TWO[:3]) + words_of(ONE, top=400.0)) == {("a", 1, 1, "stream"): TWO[:3], ("a", 1, 2, "stream"): ONE}
    # Words close to each other are one cell, and lines that lean by a point are one line.
    near = [("a", 1, 5.0, 106.0, 25.0, 116.0, "full"), ("a", 1, 30.0, 105.0, 50.0, 115.0, "name"), ("a", 1, 105.0, 105.0, 120.0, 115.0, "key")]
    assert found(spark, near + words_of([["b", "1"], ["c", "2"]], top=120.0)) == {("a", 1, 1, "stream"): [["full name", "key"], ["b", "1"], ["c", "2"]]}


def test_two_lines_in_a_cell(spark):
    words = words_of(ONE) + [("a", 1, 5.0, 128.0, 10.0, 138.0, "more")]
    assert found(spark, words, grid_of(3, 2))["a", 1, 1, "lattice"] == [["h", "k"], ["1 more", "2"], ["3", "4"]]


def test_marks_without_places_and_empty_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [], grid_of(3, 2)) == {}
    odd = [("a", 1, None, 1.0, 2.0, 3.0, "x"), ("a", None, 1.0, 1.0, 2.0, 3.0, "x"), ("a", 1, 5.0, 105.0, 9.0, 115.0, " "), ("a", 1, 5.0, 105.0, 9.0, 115.0, None), (None, 1, 5.0, 105.0, 9.0, 115.0, "x")]
    assert found(spark, odd + words_of(ONE), [("a", 1, None, 1.0, 2.0, 3.0)]) == {("a", 1, 1, "stream"): ONE}
    assert found(spark, words_of(ONE) * 2) == {("a", 1, 1, "stream"): [[" ".join([c] * 2) if c else "" for c in r] for r in ONE]}


def said(data):
    return [m[7] for m in pdf.marks_of(data) if m[1] == "word"]


def test_words_of_a_page():
    page = "BT /F 10 Tf 50 700 Td [(He) -20 (llo) -400 (w\\157rld)] TJ 0 -14 Td (a\\(b\\)) Tj 12 TL (next) ' <4142> Tj ET"
    assert said(pdf_file([page])) == ["Hello", "world", "a(b)", "nextAB"]
    assert pdf.text_of(pdf_file([page, "", "BT /F 8 Tf (z) Tj ET"])) == ["Hello world\na(b)\nnextAB", "", "z"]


def test_rules_and_backgrounds():
    page = "10 10 100 50 re S 10 100 100 1 re f 200 200 90 90 re f 5 5 m 90 90 l S 5 300 m 90 300 l n 1 0 0 1 0 400 cm 0 0 m 9 0 l S"
    assert sorted(tuple(round(v) for v in m[3:7]) for m in pdf.marks_of(pdf_file([page])) if m[1] == "rule") == [(0, 400, 9, 400), (10, 699, 110, 700), (10, 740, 10, 790), (10, 740, 110, 740), (10, 790, 110, 790), (110, 740, 110, 790)]


def test_packed_streams_objects_and_maps():
    """Deflated contents, objects within a stream, a two-byte font with its map, and a form that is moved."""
    flat = lambda about, body: f"<< {about} /Filter /FlateDecode /Length {len(z := zlib.compress(body))} >>\nstream\n".encode() + z + b"\nendstream"
    held = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] >>", b"<< /MediaBox [0 0 600 800] /Contents 7 0 R /Resources 4 0 R >>", b"<< /Font << /F 5 0 R >> /XObject << /X 8 0 R >> >>", b"<< /Subtype /Type0 /ToUnicode 6 0 R >>"]
    starts = [sum(len(h) + 1 for h in held[:i]) for i in range(len(held))]
    head = " ".join(f"{i + 1} {a}" for i, a in enumerate(starts)).encode() + b" "
    cmap = b"2 beginbfchar <0001> <00E9> <0002> <00740065> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    bodies = {9: flat(f"/Type /ObjStm /N 5 /First {len(head)}", head + b" ".join(held)), 6: flat("", cmap), 7: flat("", b"q 1 0 0 1 100 0 cm /X Do Q"), 8: flat("/Subtype /Form /Matrix [1 0 0 1 0 50]", b"BT /F 10 Tf 1 0 0 1 5 600 Tm <000100020010> Tj <00110012> Tj ET"), 10: flat("/Type /XRef /Root 1 0 R", b"")}
    data = b"%PDF-1.5\n" + b"".join(f"{k} 0 obj\n".encode() + v + b"\nendobj\n" for k, v in bodies.items()) + b"startxref\n0\n%%EOF"
    [(page, kind, place, x0, y0, x1, y1, text, *_)] = pdf.marks_of(data)
    assert (page, kind, x0, y0, y1, text) == (1, "word", 105, 140, 150, "éteabc")


@pytest.mark.parametrize("junk", [b"", b"x", b"%PDF-1.4\n" + b"%" * 200_000, b"%PDF-1.4\n1 0 obj << /Kids [", b"%PDF-1.4\ntrailer << /Root 1 0 R /Encrypt 2 0 R >>", b"%PDF-1.4\n1 0 obj\n<< /Pages 1 0 R /Kids [1 0 R 1 0 R] >>\nendobj\ntrailer << /Root 1 0 R >>\nstartxref"])
def test_files_that_hold_no_page(junk):
    try:
        assert list(pdf.marks_of(junk)) == []
    except ValueError:
        pass


def test_pictures_with_places_and_metadata(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file(["", "1 0 0 1 10 10 cm 200 0 0 100 0 0 cm /B Do"], [("A", 10, 10), ("B", 100, 50)], "Some title"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "c.pdf").write_bytes(b"no file")
    scanned = files.scan(spark, str(tmp_path))
    got = [(r["image_index"], r["page"], tuple(r["position"]) if r["position"] else None) for r in rich.images(scanned).orderBy("image_index").collect()]
    assert got == [(1, 1, None), (2, 1, None), (3, 2, None), (4, 2, (10.0, 690.0, 210.0, 790.0))]
    told = {r["path"][-5]: r for r in files.extract(scanned).collect()}
    assert told["a"]["metadata"] == {"title": "Some title", "author": "nobody"} and told["a"]["page_count"] == 2
    assert told["c"]["error"] == "ValueError: not a PDF file"
    status = {r["path"][-5]: (r["status"], r["n_tables"], r["n_images"]) for r in rich.extract_all(scanned).collect()}
    assert status["a"] == ("ok", 0, 4) and status["c"] == ("failed", 0, 0)


def test_a_callers_method_comes_first(spark, tmp_path):
    data = pdf_file(["\n".join(f"BT /F 10 Tf {50 + 100 * j} {700 - 14 * i} Td ({c}) Tj ET" for i, row in enumerate([["h", "k"], ["1", "2"], ["3", "4"]]) for j, c in enumerate(row))])
    for name in "ab":
        (tmp_path / f"{name}.pdf").write_bytes(data + name.encode())
    scanned = files.scan(spark, str(tmp_path))
    own = lambda content: [[["own", "x"], ["1", "2"], ["3", "4"]]] if content.endswith(b"a") else []
    got = {r["path"][-5]: (r["method"], r["data"][0]) for r in rich.tables(scanned, [("own", own)]).collect()}
    assert got == {"a": ("own", ["own", "x"]), "b": ("stream", ["h", "k"])}
