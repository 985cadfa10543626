"""Operators over pages, texts and stores against worked cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.functions import cells
from folioflow.functions import text as T
from folioflow.operators import assemble, formulas, grids, layout, lines, store, tables, vision
from folioflow.plans import documents, pages
from folioflow.sources import sinks


def spread(text, y, left, right, size=12.0):
    return layout.Line(text, y, left, right, size)


def page(texts):
    return [tables.Line(t, 12.0 * i) for i, t in enumerate(texts)]


TABLES = [
    (["| Name | Age | City |", "|------|-----|------|", "| John | 30 | NYC |", "| Jane | 25 | LA |"], (3, 3)),
    (["Name        Age    City", "John        30     New York", "Jane        25     Los Angeles", "Bob         35     Chicago"], (4, 3)),
    (["This is a normal paragraph of text.", "It should not be detected as a table.", "Even though it has multiple lines."], None),
    (["| Year | Revenue | Profit |", "|------|---------|--------|", "| 2020 | $1.2M | $200K |", "| 2021 | $1.5M | $350K |", "| 2022 | $2.0M | $500K |"], (4, 3)),
    (["Introduction paragraph.", "", "| Item | Quantity |", "|------|----------|", "| A | 10 |", "| B | 20 |", "", "Conclusion paragraph."], (3, 2)),
    (["Venice, Italy: Over 1,500 signatories urged the    Gaza/Israel: The IDF", "festival to drop Gal Gadot.                        recovered and identified the", "Sanaa, Yemen: An Israeli strike killed Houthi PM   bodies of hostages Ilan Weiss", 'Ahmed al-Rahawi and several ministers; the         z"l and Idan Shtivi z"l.', "group vowed retaliation.                           Frankfurt am Main, Germany:"], None),
    (["Minneapolis, USA: Videos tied to the school-church shooting suspect showed rifles.", "New York City, USA: Vandals daubed graffiti on the building in Greenwich Village.", "Lyon, France: A newly unveiled Holocaust memorial was scratched with graffiti."], None),
    (["The quick brown fox jumps over the lazy dog.", "A wonderful serenity has taken possession of my entire soul.", "I am alone, and feel the charm of existence in this spot."], None),
]


@pytest.mark.parametrize("texts, shape", TABLES)
def test_detected_tables(texts, shape):
    found = tables.detect_tables(page(texts))
    assert (found != []) == (shape is not None)
    if shape:
        assert (len(found[0].rows), len(found[0].alignments)) == shape and "|" in tables.to_markdown(found[0])


def test_table_parts():
    assert tables.to_markdown(tables.Table([["a", "num"], ["x|y", "12"]], ["left", "right"], 1, 0, 1, "bordered")) == "| a   | num |\n| --- | --: |\n| x\\|y |  12 |"
    assert tables.to_markdown(tables.Table([["abcd"]], ["center"], 1, 0, 0, "ascii")) == "| abcd |\n| :--: |"
    assert tables.column_places([50, 52, 300, 304, 51]) == [51, 302] and tables.nearest([50, 150], 100) == 0
    row = [tables.Cell("a", 50), tables.Cell("b", 58), tables.Cell("c", 300)]
    assert tables.positioned_grid([row], [50, 300]) == [["a b", "c"]]
    assert [c.text for c in tables.cells_of([("x", 0, 10), ("y", 6, 10), ("z", 40, 10)])] == ["xy", "z"]
    assert tables.rows_by_height([tables.Line("b", 101, 50), tables.Line("a", 100, 0), tables.Line("c", 130)])[0][0].text == "a"
    three = [(float(12 * i), [tables.Cell(t, x) for t, x in zip(r, (50, 150, 250))]) for i, r in enumerate((["Name", "Age", "City"], ["John", "30", "NYC"], ["Jane", "25", "LA"]))]
    assert [len(t.rows) for t in tables.positioned_tables(three)] == [3] and not tables.positioned_tables([])
    assert cells.is_numeric("($1,200.5") is False and cells.is_numeric("(12)") and cells.is_numeric("$1,200.50") and not cells.is_numeric("12)")


def test_python_and_column_cells_agree(spark):
    some = ["", " 12 ", "$1,200.50", "(12)", "-3.5%", "12)", "a b", "Total", "Figure 2(a) shows the structure of the stacked", "one two three four five.", "x" * 61, "the cat sat on the mat with a hat and more words", "1.2.3", "()"]
    c = F.col("s")
    rows = spark.createDataFrame([(s,) for s in some], "s string").select("s", T.is_short_token(c), T.is_numeric(c), T.is_sentence(c), T.is_prose_fragment(c), F.to_json(T.split_cells(c))).collect()
    for s, *flags, split in rows:
        assert flags == [cells.is_short_token(s), cells.is_numeric(s), bool(s.strip()) and cells.is_sentence(s), bool(s.strip()) and cells.is_prose_fragment(s)], s
        assert json.loads(split) == cells.split_cells(s), s


def test_profiles_agree(spark):
    grids_ = {1: [["Name", "Age"], ["John", "30"], ["Jane Doe", ""]], 2: [["the whole cell is a long sentence of words here."] * 2] * 3, 3: [["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"], ["7", "8", "9"]]}
    rows = [(g, r, c, t) for g, grid in grids_.items() for r, row in enumerate(grid) for c, t in enumerate(row)]
    got = grids.passes(grids.profile(spark.createDataFrame(rows, "grid int, r int, c int, text string"), "grid", "r", "c", "text")).collect()
    for r in got:
        own = cells.Profile(grids_[r.grid])
        assert (r.is_table, round(r.score, 6)) == (own.passes(), round(own.score, 6))


def test_likelihood(spark):
    texts = ["| A | B | C |", "$100.00    $200.00    $300.00", "This is normal text.", "10\t20\t30\t40"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.table_likelihood(F.col("t"))).collect()]
    assert got[0] >= 0.3 and got[1] >= 0.3 and got[2] <= 0.2 and got[3] >= 0.2


def test_layout():
    one = [spread(t, y, 50, 550) for t, y in (("This is a paragraph of text that spans most of the page width.", 100), ("It continues with more content in the same column structure.", 120), ("The text flows naturally from line to line without breaks.", 140))]
    columns = layout.columns_of(one, 612)
    assert len(columns) == 1 and not layout.is_column_prose(columns, layout.regions_of(columns))
    left = ["The quick brown fox jumps over the lazy dog.", "This is academic prose that discusses important topics.", "The research methodology was carefully designed.", "Results show significant improvements in performance.", "Further analysis is needed to confirm these findings."]
    right = ["In this section we present our analysis.", "The data was collected over six months.", "Participants were randomly selected from the pool.", "Statistical analysis revealed strong correlations.", "These results support our initial hypothesis."]
    two = [spread(t, 100 + 20 * i, 50, 280) for i, t in enumerate(left)] + [spread(t, 100 + 20 * i, 330, 560) for i, t in enumerate(right)]
    columns = layout.columns_of(two, 612)
    regions = layout.regions_of(columns)
    assert len(columns) == 2 and layout.is_column_prose(columns, regions) and not layout.table_blocks(regions)
    assert layout.reading_order(columns).startswith(left[0]) and layout.reading_order(columns).endswith(right[-1])
    kind = lambda texts, size=12.0: layout.classify(layout.Block([spread(t, 100 + 20 * i, 50, 250, size) for i, t in enumerate(texts)]))[0]
    assert kind(["The quick brown fox jumps over the lazy dog. This is a complete sentence.", "Another sentence follows with more content that flows naturally.", "The paragraph continues with additional text and punctuation."]) == "prose"
    assert kind(["2020    $1.2M    $200K", "2021    $1.5M    $350K", "2022    $2.0M    $500K"]) == "potential-table"
    assert kind(["Introduction"], 18.0) == "heading" and kind(["• First item in the list", "• Second item follows", "• Third item here"]) == "list"
    mixed = [spread("Results", 50, 50, 150, 18.0), *one[:2], spread("Year", 180, 50, 100), spread("2020", 200, 50, 100), spread("$1.2M", 200, 150, 210)]
    regions = layout.regions_of(layout.columns_of(mixed, 612))
    assert len({r.kind for r in regions}) >= 2 and layout.columns_of([], 612) == []


@pytest.mark.parametrize("text, low, high", [("Hello world", 0, 0.1), ("x = 2 + 3", 0, 0.1), ("α + β = γ", 0.3, 1), ("E = mc²", 0.1, 0.5), ("∫f(x)dx", 0.3, 1), ("∑ᵢ₌₀ⁿ xᵢ", 0.3, 1)])
def test_density(text, low, high):
    assert low <= formulas.density(text) <= high


def test_formulas():
    assert [formulas.contains_math(t) for t in ("Regular paragraph without math.", "The formula is E = mc².", "Let α be a constant.", "If x ≤ 5 then...", "The weather is sunny today.")] == [False, True, True, True, False]
    assert [len(formulas.segments(t)) for t in ("Text $x=2$ more text", "Before $$y = mx + b$$ after", "Plain text only")] == [3, 3, 1]
    assert [formulas.is_display(t) for t in ("$$x = 2$$", "\\[x = 2\\]", "Short text")] == [True, True, False]
    assert [formulas.to_latex(t) for t in ("α", "²", "₂", "≤", "∫", "x¹²")] == [r"\alpha", "^{2}", "_{2}", r"\leq", r"\int", "x^{12}"]
    assert r"\pi" in formulas.marked_up("The area is A = πr²") and r"\leq" in formulas.marked_up("If α ≤ β then...")
    assert formulas.normal_latex("a=b+3 / 4") == r"a = b + \frac{3}{4}" and formulas.expressions("x $y$ z") == ["$y$"]
    for t in ("Text $x=2$ with α and more", "", "∑x₂ = √2"):
        assert "".join(s.text for s in formulas.segments(t)) == t


def test_column_formulas_agree(spark):
    texts = ["", "Hello world", "E = mc²", "α + β = γ", "The formula is E = mc² and it is known to all of us here.", "∑x₂ = √2 ± 1/2", "$$x = 2$$", "x" * 60 + "α", "sum of 3/4 and \n x² = y₂ + β"]
    c = F.col("t")
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.math_density(c), T.contains_math(c), T.looks_like_prose(c), T.is_display_math(c)).collect():
        assert (round(r[1], 9), r[2], r[3], r[4]) == (round(formulas.density(r[0]), 9), formulas.contains_math(r[0]), formulas.looks_like_prose(r[0]), formulas.is_display(r[0])), r[0]


def block(y, *texts, size=12, name="Times", h=12):
    return {"type": "text", "bbox": {"x": 0, "y": y, "w": 100, "h": h}, "lines": [{"text": t, "x": 0, "y": y + 12 * i, "font": {"size": size, "name": name}} for i, t in enumerate(texts)]}


def test_assembly():
    blocks = [block(70, "paragraph ends."), block(10, "Big Title", size=24), block(40, "This sentence goes on with", "more words here.", "Next sentence of the", h=36), block(100, "• one", "2) two", "three"), block(140, "Bold words", name="Times-BoldItalic"), {"type": "image"}]
    assert assemble.paragraphs(blocks) == ["# Big Title", "This sentence goes on with more words here.", "Next sentence of the paragraph ends.", "- one", "2. two", "three", "***Bold words***"]
    assert assemble.page_markdown([]) == "" and assemble.page_markdown([block(0, "a"), block(20, "| x | 1 |", "| y | 2 |", "| z | 3 |")]).count("| --- |") == 1
    assert assemble.line_height(block(0, "a", "b")) == 12 and assemble.heading_level(15, 12) == 2


def test_vision():
    found = vision.elements('say [{"text": "Head &amp;amp; x", "top": 10, "left": 5, "height": 50}]', '[{"description": "cat", "top": 200, "left": 10}, {"description": "dog", "top": 200, "left": 10}]', '[{"text": "near", "top": 15}, {"text": "para", "top": 300}, {"text": "PARA!", "top": 400}]')
    assert [e["content"] for e in found] == ["Head &amp; x", "cat", "para", "PARA!"]
    assert vision.to_markdown(vision.distinct(vision.reading_order(found))) == "# Head &amp; x\n\n\n\n![cat](image)\n\n*cat*\n\n\n\npara"
    assert vision.image_regions('[{"photo": "a", "x": 80, "y": 110, "w": 400}, {"photo": "b') == [{"description": "a", "after": "", "bounds": {"x": 0.1, "y": 0.1, "width": 0.5, "height": 150 / 1100}}]
    assert vision.image_regions(None) == vision.image_regions("none") == [] and vision.crop({"x": 0.9, "y": 0, "width": 0.5, "height": 0.01}, 1000, 1000) is None
    assert vision.equations("Here are two:\n$x$\nequation one\n\\alpha") == ["$x$", "\\alpha"] and vision.equations("NONE") == []
    assert vision.with_equations("# T\nfoo � bar", ["$x$", "$y$"]) == "# T\n\n\n$y$\n\nfoo $x$" and vision.with_equations("a", []) == "a"
    text, kept = vision.with_images("# T\n\nbody", [{"description": "a (b)", "bounds": None}], {0: "data:image/png;base64," + "A" * 100})
    assert text == "# T\n\n![a \\(b\\)](#img_0)\n\n*a \\(b\\)*\n\nbody" and len(kept) == 1
    assert vision.with_images("# T\n\nbody", [{"description": "a", "bounds": None}], {})[0] == "# T\n\n*[Image: a]*\n\nbody"


def test_text_repairs(spark):
    frame = spark.createDataFrame([(1, "•\nFirst item text"), (2, "-\nItem one\n-\nItem two"), (3, "• Complete item\n• Another item"), (4, "  A long head was\nbroken incorrectly"), (5, "# Heading\nParagraph text"), (6, "Complete sentence.\nNew sentence here."), (7, "This is a long para-\ngraph that was bro-\nken incorrectly.\n\n•\nStandalone bullet item\n\nShort\norphan")], "doc_id int, text string")
    merged = {r.doc_id: r.text for r in lines.merge_bullets(lines.lines_of(frame)).collect()}
    assert merged[1] == "- First item text" and merged[2] == "- Item one\n- Item two" and merged[3] == "• Complete item\n• Another item"
    whole = {r.doc_id: r.text for r in lines.defragment(lines.lines_of(frame)).collect()}
    assert whole[4] == "A long head was broken incorrectly" and whole[5] == "# Heading\nParagraph text" and whole[6] == "Complete sentence.\nNew sentence here."
    done = {r.doc_id: r.text for r in documents.apply_transforms(frame).collect()}[7]
    assert "paragraph" in done and "- Standalone" in done and "Short orphan" in done


def test_statistics(spark):
    sample = "# Main Heading\n\nThis is foo_bar **bo**ld.\n\n## Subheading\n\n| Column A | Column B |\n|----------|----------|\n| Data 1 | Data 2 |\n\n- List item one\n- List item two\n3) third\n\n![Image description](image.png)\n"
    r = lines.statistics(spark.createDataFrame([(1, sample), (2, "")], "doc_id int, text string")).orderBy("doc_id").collect()
    # The image's description counts: its link is taken out first, as a link's text.
    assert (r[0].headings, r[0].tables, r[0].list_items, r[0].images, r[0].words) == (2, 1, 3, 1, 2 + 4 + 1 + 8 + 8 + 2) and r[1].words == 0
    shown = spark.range(1).select(T.format_stats(*[F.lit(n) for n in (1234, 1, 2, 0, 1, 3)])).head()[0]
    assert shown == "1,234 words | 1 heading | 2 tables | 1 image | 3 pages"


def test_running_lines(spark):
    rows = [(1, i, f"Document Title\nSection {i}\nbody {chr(96 + i) * 3}\nPage {i}\nFooter text") for i in range(1, 6)] + [(2, 1, "Title\nEnd"), (2, 2, "Title\nEnd")]
    pages_ = spark.createDataFrame(rows, "doc_id int, page_no int, text string")
    found = lines.running_lines(pages_, "doc_id", "page_no", "text")
    assert {(r.doc_id, r.kind, r.place, r.pattern) for r in found.collect()} == {(1, "header", 0, "document title"), (1, "header", 1, "section #"), (1, "footer", 0, "footer text"), (1, "footer", 1, "page #")}
    done = {r.doc_id: r for r in documents.convert(pages_).collect()}
    assert done[1].markdown == "body aaa\n\nbody bbb\n\nbody ccc\n\nbody ddd\n\nbody eee" and done[1].pages == 5 and done[2].markdown.startswith("Title")


def test_plans_handle_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id int, page_no int, text string")
    assert documents.convert(none).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (None, 2, ""), (3, None, "x")], "doc_id int, page_no int, text string")
    assert {r.markdown for r in documents.convert(odd).collect()} <= {"", "x"}
    empty = spark.createDataFrame([(1, None, None), (2, [], "{}"), (3, [], '{"blocks": []}')], "doc_id int, lines array<struct<text:string,y:double,min_x:double,max_x:double,size:double>>, st_json string")
    assert pages.regions(empty, ("doc_id",)).count() == 0 and pages.positioned_tables(empty, ("doc_id",)).count() == 0
    assert {r.doc_id: (r.markdown, r.error) for r in pages.structured_markdown(empty, ("doc_id",)).collect()} == {1: (None, "JSONDecodeError"), 2: (None, "KeyError"), 3: ("", None)}
    assert pages.math_markup(spark.createDataFrame([(1, None)], "doc_id int, text string"), ("doc_id",)).head().marked is None


def test_store(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in store.put_setting(old, spark.createDataFrame([("b", ""), ("c", "3")], "key string, value string")).collect()} == {("a", "1"), ("c", "3")}
    assert {tuple(r) for r in store.insert(old, spark.createDataFrame([("b", "9"), ("c", "3")], "key string, value string"), "key").collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    assert {tuple(r) for r in store.patch(old, spark.createDataFrame([("b", "9"), ("z", "3")], "key string, value string"), "key").collect()} == {("a", "1"), ("b", "9")}
    key, other = F.lit("k" * 32), F.lit("o" * 32)
    own = spark.range(1).select(store.encrypted(F.lit("secret"), key).alias("e"))
    assert own.select(store.decrypted(F.col("e"), key)).head()[0] == "secret" and own.select(store.decrypted(F.col("e"), other)).head()[0] == ""


def test_zip(spark):
    rows = [(1, "a.PDF", "old", "completed"), (2, "a.PDF", "new", "completed"), (3, "b.pdf", None, "completed"), (4, "c.pdf", "x", "pending")]
    got = sinks.zipped(spark.createDataFrame(rows, "file_id int, name string, markdown string, status string")).collect()
    archive = zipfile.ZipFile(io.BytesIO(got[0].content))
    assert len(got) == 1 and got[0].entries == 2 and {n: archive.read(n) for n in archive.namelist()} == {"a.md": b"new", "b.md": b""}
