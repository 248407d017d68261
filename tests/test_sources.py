"""Readers and sinks on files made by hand."""

from tessera.sources import io, markup


def test_markdown_folder(spark, tmp_path):
    for name, text in (("a.md", "# A\nx"), ("b.md", "y\n\nz"), ("c.txt", "no")):
        (tmp_path / name).write_text(text)
    assert {tuple(r) for r in io.read_markdown(spark, str(tmp_path)).collect()} == {("a", "# A\nx"), ("b", "y\n\nz")}


def test_question_set_skips_blank_lines_and_missing_ids(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "2", "question": "b", "category": "x", "expected": [{"file_stem": "f", "section_path": "1"}]}\n\n{"question": "c", "category": "y"}\n{"id": "1", "question": "a", "category": "x"}\n')
    assert io.read_items(spark, str(tmp_path / "q.jsonl")).count() == 3
    assert [r.id for r in io.read_items(spark, str(tmp_path / "q.jsonl"), "x", 1).collect()] == ["1"]


def test_nested_report_keeps_files_without_formulas(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"files": [\n {"file": "a", "formula_detail": [{"fid": "1", "ok": true}, {"fid": "2", "ok": false}]},\n {"file": "b", "formula_detail": []}]}')
    rows = io.read_report(spark, str(tmp_path / "r.json")).collect()
    assert sorted((r.file, r.fid) for r in rows if r.fid) == [("a", "1"), ("a", "2")] and [r.fid for r in rows if r.file == "b"] == [None]


def test_import_plan(spark, tmp_path):
    import hashlib

    for name in ("QTKD 1.docx", "phieu do.pdf", "khac.pdf", "moi.md"):
        (tmp_path / name).write_bytes(name.encode())
    sha = lambda n: hashlib.sha256(n.encode()).hexdigest()
    ledger = spark.createDataFrame([("QTKD 1.docx", sha("QTKD 1.docx"), "qtkd"), ("phieu do.pdf", sha("phieu do.pdf"), "khac"), ("khac.pdf", "other", "khac")], "name string, sha256 string, doc_type string")
    got = {r.name: (r.action, r.size_bytes) for r in io.import_plan(spark, str(tmp_path), ledger).collect()}
    assert got == {"QTKD 1.docx": ("skip", 11), "phieu do.pdf": ("update type", 12), "khac.pdf": ("replace", 8), "moi.md": ("insert", 6)}


def test_sweep_files(spark, tmp_path):
    rows = spark.createDataFrame([(0.1, 10, 0.5, [1]), (0.1, 60, 0.7, []), (0.2, 10, 0.6, [2])], "alpha double, k int, recall double, misses array<long>")
    io.write_sweep(rows, str(tmp_path), "recall")
    grid = spark.read.option("header", True).csv(f"{tmp_path}/grid").orderBy("alpha").collect()
    assert [tuple(r) for r in grid] == [("0.1", "0.5", "0.7"), ("0.2", "0.6", None)]


def test_markup(spark):
    html = '<title>T</title><script>var t="<p>no</p>";</script><h1>H &amp; h</h1><p><b>a</b> b<br>c<p>d</p><!-- <p>x</p> --><a href="/u">l</a><footer>'
    r = markup.to_sections(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].heading, r[0].paragraphs, r[0].links) == ("T", "H & h", ["a b c", "d"], ["/u"])
    assert r[2].paragraphs == [] and r[1].title is None


def test_files_are_written_whole_and_by_name(spark, tmp_path):
    import pytest

    rows = spark.createDataFrame([("a.md", "x\ny"), ("b +%.md", None)], "name string, text string")
    assert sorted(map(tuple, io.write_files(rows, f"{tmp_path}/out").collect())) == [("a.md", 3), ("b +%.md", 0)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.md", "b +%.md"]
    assert {tuple(r) for r in io.read_markdown(spark, f"{tmp_path}/out").collect()} >= {("a", "x\ny")}
    with pytest.raises(Exception, match="no file name"):
        io.write_files(spark.createDataFrame([("../a", "x")], "name string, text string"), f"{tmp_path}/out")


def test_sweep_report(spark):
    rows = spark.createDataFrame([(a, k, 10, 0.5 + a / 10, 0.4) for a in (0.4, 0.5) for k in (30, 60) if (a, k) != (0.4, 30)], "alpha double, k int, n long, recall double, mrr double")
    decision = spark.createDataFrame([(0.5, 60, False, "the present setting is first")], "alpha double, k int, change boolean, reason string")
    text = io.sweep_report(rows, decision)
    assert "| 1 | 0.5 | 60 | 0.550 | 0.400 |" in text and "| 0.4 | - | 0.540 |" in text and "- Change: no\n- Reason: the present" in text


PAGE = """<html><head><title>x</title><body><nav><h2>no</nav><h1>Title <b>b</b>old</h1>text &amp; more<p>one<br>two<ul><li>a<li>b</ul><h2>This is a sentence.</h2>
<table border=1><caption>Cap</caption><tr><th rowspan=2>A<th colspan="2">B</tr><tr><th>x<th>y</tr><tr><td rowspan=2>r|s<td>1<br>2<td>3</tr><tr></tr><tr><td>4<td><table><tr><td>in<td>ner</table></tr></table>after</table> # x<h3>Hình 2</h3><footer>no</footer>"""


def test_markup_as_markdown(spark):
    from tessera.operators import chunking, tables

    rows = [(1, PAGE), (2, None), (3, ""), (4, "a < b <p># h"), (5, "<table><tr><td colspan=2>h</table><table><td>k</td></table>"), (6, '<!-- <h1>a --><h2 title="a>b">H</h2></table><tr><td>loose<nav>n'), (7, "p > q> <b>r ></b> s<"), (8, "x >")]
    found = markup.to_markdown(spark.createDataFrame(rows, "page_id long, html string"))
    got = {r.page_id: r.text for r in found.collect()}
    assert got[1] == (
        "# Title bold\n\ntext & more\n\none two\n\n- a\n\n- b\n\nThis is a sentence.\n\nCap\n\n| A | B - x | B - y |\n| --- | --- | --- |\n| r\\|s | 1 / 2 | 3 |\n| r\\|s |  |  |\n| 4 | in / ner |  |\n\nafter\n\n\\# x\n\nHình 2"
    )
    assert got[2] == got[3] == "" and got[4] == "a < b\n\n\\# h" and got[5] == "| h | h |\n| --- | --- |\n\n| k |\n| --- |" and got[6].startswith("## H") and "n" not in got[6].split("H")[1].replace("loose", "")
    assert got[7] == "p > q> r > s<" and got[8] == "x >"
    assert [(r.heading, r.level) for r in chunking.sections(found, "page_id").collect() if r.file_stem == 1] == [("Title bold", 1)]
    cells = tables.cells(tables.tables(found.withColumnRenamed("page_id", "doc"))).filter("doc = 1 AND row_no = 1").orderBy("col_no").collect()
    assert [(c.label, c.value) for c in cells] == [("A", "r|s"), ("B - x", "1 / 2"), ("B - y", "3")]
    assert markup.to_markdown(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_cells_without_spans_cost_no_failed_cast(spark):
    """A cast that may fail raises and drops an error for each cell; spans are cast only where there are digits."""
    pages = spark.createDataFrame([(1, "<table><tr><td rowspan='' colspan=x>a<td colspan=00002>b<td>c</table>")], "page_id long, html string")
    found = markup.to_markdown(pages)
    assert "try_cast" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.first().text == "| a | b | b | c |\n| --- | --- | --- | --- |"


def test_lines_of_a_unit_are_cut_once(spark):
    """The text of a cell or block is cut into lines once for all that is made of it; tags and spans may be written in capitals, and a first cell over two rows makes two header rows."""
    pages = spark.createDataFrame([(1, "<H2>Span</H2><TABLE><TR><TD ROWSPAN=2>a<TD>span<TR><TD>c<BR>d&nbsp;</TABLE>"), (2, "<p>no span</p>")], "page_id long, html string")
    found = markup.to_markdown(pages)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("&nbsp;") == 1
    assert {r.page_id: r.text for r in found.collect()} == {1: "## Span\n\n| a | span - c / d |\n| --- | --- |", 2: "no span"}


def test_grid_equals_marking_squares():
    """Random spans: every square belongs to the first cell that reaches it, and each cell starts in the first square of its row that is free when its turn comes."""
    import random

    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(1, 6)
        cells = [(r, rnd.choice([1, 1, 1, 2, 3, 0]), rnd.choice([1, 1, 2, 3]), f"{r}.{k}") for r in range(n) for k in range(rnd.randint(0, 4))]
        squares = {}
        for r, down, over, text in cells:
            c = next(c for c in range(100) if (r, c) not in squares)
            last = max(x[0] for x in cells) if not down else min(r + down - 1, max(x[0] for x in cells))
            for y in range(r, last + 1):
                for x in range(c, c + over):
                    squares.setdefault((y, x), text)
        got = markup.grid(cells)
        first = cells[0][0] if cells else 0
        assert {(y + first, x): v for y, row in enumerate(got) for x, v in enumerate(row) if v} == squares


def test_headings_that_are_text(spark):
    texts = ["1 Phạm vi", "- a", "– b", "Sai số.", "a;", "Hình 1. Sơ đồ", "Bảng 2", "Bảng tính", "x" * 70 + ". " + "y" * 20, ""]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(markup.is_heading(markup.F.col("t"))).collect()]
    assert got == [True, False, False, False, False, False, False, True, False, False]
