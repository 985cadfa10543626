import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioflow import catalog, catalog_plans
from folioflow.functions import latex
from folioflow.functions import text as T
from folioflow.operators import fonts, lines, store
from folioflow.sources.sinks import write_markdown

FOLDER = "/root/testdata/sf0.001"


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_hyphenation(spark):
    assert value(spark, "This is a com-\nprehensive test.", T.dehyphenate) == "This is a comprehensive test."
    assert value(spark, "Extra-\n   ordinary", T.dehyphenate) == "Extraordinary"
    assert value(spark, "self-contained text", T.dehyphenate) == "self-contained text"


def test_math(spark):
    assert value(spark, "The formula is E = mc².", T.contains_math)
    assert not value(spark, "The weather is sunny today.", T.contains_math)
    assert value(spark, "x = 2 + 3", T.math_density) <= 0.1


@pytest.mark.parametrize(("text", "want"), [("α", "\\alpha"), ("x²³ + y₁₀", "x^{23} + y_{10}"), ("a ≤\n b", "a \\leq b"), ("∫ x", "\\int x"), ("", ""), (None, None)])
def test_latex(spark, text, want):
    assert value(spark, text, latex.to_latex) == want


def test_fonts(spark):
    rows = [(1, 0, 0, "ab", 10.2, 0.0), (1, 0, 1, "cd", 14.0, 12.0), (1, 0, 2, None, None, 10.0), (2, 0, 0, "x", 0.0, 5.0)]
    frame = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, text string, font_size double, y double")
    assert {r.doc_id: r.body for r in fonts.font_profile(frame).collect()} == {1: 10.0, 2: 12.0}
    assert {r.doc_id: r.height for r in fonts.line_heights(frame).collect()} == {1: 12.0, 2: 12.0}


def test_markdown_sink(spark, tmp_path):
    write_markdown(spark.createDataFrame([("a.PDF", "# é"), ("b", None)], "name string, markdown string"), str(tmp_path / "out"))
    assert {r.entry: r.value for r in spark.read.text(str(tmp_path / "out")).collect()}["a.md"] == "# é"


def test_case_of_every_character_is_that_of_sql(spark, tmp_path):
    rows = [(i, chr(i), f"{chr(i)}A {chr(i)}B\U00010D50\n") for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    pq.write_table(pa.table(dict(zip(("i", "c", "t"), zip(*rows)))), tmp_path / "c.parquet")
    spark.read.parquet(str(tmp_path / "c.parquet")).select("i", T.upper_letter(F.col("c")).alias("u"), T.lower(F.col("c")).alias("l"), T.lower(F.col("t")).alias("t"), T.lower(F.concat(F.lit("x"), "c", F.lit("Σ"))).alias("e")).write.parquet(str(tmp_path / "out"))
    own = f"SELECT i, upper(c) AS u, lower(c) AS l, lower(t) AS t, lower('x' || c || 'Σ') AS e FROM '{tmp_path}/c.parquet'"
    assert duckdb.sql(f"({own}) EXCEPT SELECT i, u, l, t, e FROM '{tmp_path}/out/*.parquet'").fetchall() == []


def test_drop_caps_of_letters_with_odd_cases(spark, tmp_path):
    texts = ["ßa\nb\nc\nd\nßx\nΟΔΟΣ\nİI", "ŉ\nx", "ﬁ\nΣ", "ᾳ\nΑΣ ΑΣ", "é\nÉ", "a\nbc\nd", "", None, "\U00010D70\n\U00010D50A"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = catalog_plans.drop_caps(spark, str(tmp_path)).collect()
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        assert sorted(map(tuple, got)) == sorted(base.execute(catalog.oracle_sql()["drop_caps"]).fetchall())


def test_bullets(spark):
    frame = spark.createDataFrame([(1, "•\nFirst item text"), (2, "• Complete item\n• Another item")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in lines.merge_bullets(lines.lines_of(frame)).collect()}
    assert got == {1: "- First item text", 2: "• Complete item\n• Another item"}


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


@pytest.mark.parametrize("name", ["doc_stats", "grid_profiles", "table_markdown", "header_footer_patterns", "defragment_lines"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = catalog.queries()[name](spark, FOLDER)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, want)) and want
