"""Registered queries of whole documents and pages; `catalog` has those of single operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _CELLS, _FILES, _IS_NUMERIC, _LINES, _NORM, _PRINTED, _PAGES, _RUNNING, _TRIM, _WS, _docs, _query
from .functions import text as T
from .operators import fonts, lines, store
from .plans import documents, pages
from .sources import dialogue_pages, marked_lines, mathematical, order_cells, order_pages, placed_pages, printed_lines, read, stored_files

_WORDS_OF = lambda c: f"regexp_split_to_array({c}, '{_WS}+')"
_RESEMBLES = f"len(list_intersect({_WORDS_OF('p')}, {_WORDS_OF(_NORM('x'))})) >= 0.8 * len(list_distinct(list_concat({_WORDS_OF('p')}, {_WORDS_OF(_NORM('x'))})))"
_CLEANED = f"""pa AS (SELECT doc_id, list(pattern ORDER BY pattern) AS ps FROM (SELECT DISTINCT doc_id, pattern FROM pt) GROUP BY doc_id),
cl AS (SELECT pg.doc_id, pg.page_no, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (length({_TRIM('x')}) > 0 AND len(list_filter(coalesce(ps, []), lambda p: {_RESEMBLES})) > 0)), chr(10)) AS text
  FROM pg LEFT JOIN pa ON pg.doc_id = pa.doc_id)"""


@_query(f"WITH RECURSIVE {_PAGES}, {_RUNNING}, {_CLEANED} SELECT * FROM cl")
def remove_headers_footers(spark, d):
    turns = dialogue_pages(read(spark, d, "conversations"))
    return lines.remove_running_lines(turns, lines.running_lines(turns, "doc_id", "page_no", "text"), "doc_id", "page_no", "text")


def _counts(t: str) -> str:
    line = f"string_split({t}, chr(10))"
    row = lambda i: f"regexp_matches({_TRIM(f'{line}[{i}]')}, '^\\|.+\\|$')"
    return rf"""len(regexp_extract_all(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?m)^#+{_WS}+', '', 'g'), '[*_`~]', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g'), '|', ' '), '[A-Za-z0-9_]+')) AS words,
  len(regexp_extract_all({t}, '(?m)^#+{_WS}+.+$')) AS headings, len(list_filter(range(1, len({line}) + 1), lambda i: {row('i')} AND NOT (i > 1 AND {row('i - 1')}))) AS tables,
  len(regexp_extract_all({t}, '(?m)^{_WS}*[-*+]{_WS}+.+$')) + len(regexp_extract_all({t}, '(?m)^{_WS}*[0-9]+[.)]{_WS}+.+$')) AS list_items, len(regexp_extract_all({t}, '!\[[^\]]*\]\([^)]+\)')) AS images"""


_MANY = ", ".join(f"CASE WHEN {c} > 0 THEN {c} || ' {n}' || CASE WHEN {c} = 1 THEN '' ELSE 's' END END" for c, n in (("headings", "heading"), ("tables", "table"), ("list_items", "list item"), ("images", "image")))
_SUMMARY = f"concat_ws(' | ', CASE WHEN words > 0 THEN format('{{:,}}', words) || ' words' END, {_MANY}, CASE WHEN pages > 1 THEN pages || ' pages' END)"


def _repaired(source: str) -> str:
    """CTEs from `source` (doc_id, t) to rp (doc_id, text): hyphenation, lone bullets and orphan lines."""
    return rf"""hy AS (SELECT doc_id, regexp_replace(replace(regexp_replace(t, '([A-Za-z0-9_])-{_WS}*\n{_WS}*([A-Za-z0-9_])', '\1\2', 'g'), chr(173), ''), '([A-Za-z0-9_])–{_WS}*\n{_WS}*([A-Za-z0-9_])', '\1\2', 'g') AS t FROM {source}),
b0 AS (SELECT doc_id, i, p[i] AS raw FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS p FROM hy))),
b1 AS (SELECT *, regexp_matches({_TRIM('raw')}, '^[{T.BULLETS}*-]$') AS lone, lead({_TRIM('raw')}) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM b0),
b2 AS (SELECT *, coalesce(lone AND length(after) > 0 AND NOT regexp_matches(after, '^[{T.BULLETS}0-9*-]'), false) AS takes FROM b1),
b3 AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM b2),
b4 AS (SELECT doc_id, i, CASE WHEN takes THEN '- ' || after ELSE raw END AS raw FROM b3 WHERE NOT gone),
d1 AS (SELECT *, {_TRIM('raw')} AS now, lag({_TRIM('raw')}) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM b4),
d2 AS (SELECT *, coalesce(length(now) BETWEEN 1 AND 45 AND NOT regexp_matches(now, '^#') AND NOT regexp_matches(now, '^[-*0-9]+[.)]\s') AND length(before) > 0 AND NOT regexp_matches(now, '^[A-Z]') AND (NOT regexp_matches(before, '[.!?:;]$') OR regexp_matches(now, '^[a-z]')), false) AS g FROM d1),
d3 AS (SELECT *, sum(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM d2),
d4 AS (SELECT doc_id, island, CASE WHEN count(*) > 1 THEN string_agg(now, ' ' ORDER BY i) ELSE min(raw) END AS line FROM d3 GROUP BY doc_id, island),
rp AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY island) AS text FROM d4 GROUP BY doc_id)"""


@_query(f"""WITH {_LINES}, j AS (SELECT doc_id, string_agg(CASE WHEN line_no % 5 = 0 THEN raw || 'semi-' ELSE raw END, chr(10) ORDER BY line_no) AS t FROM m GROUP BY doc_id), {_repaired('j')} SELECT * FROM rp""")
def apply_transforms(spark, d):
    rows = marked_lines(_docs(spark, d)).withColumn("raw", F.when(F.col("line_no") % 5 == 0, F.concat("raw", F.lit("semi-"))).otherwise(F.col("raw")))
    return documents.apply_transforms(documents.lines_to_text(rows, "doc_id", "line_no", "raw"))


_FOLDED = _TRIM(r"regexp_replace(rp.text, '\n{3,}', chr(10) || chr(10), 'g')")


@_query(f"""WITH RECURSIVE {_PAGES}, {_RUNNING}, {_CLEANED},
wh AS (SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (length({_TRIM('text')}) > 0), '') AS t, count(*) AS pages FROM cl GROUP BY doc_id), {_repaired('wh')},
fi AS (SELECT rp.doc_id, {_FOLDED} AS markdown, pages FROM rp JOIN wh ON rp.doc_id = wh.doc_id),
co AS (SELECT doc_id, markdown, {_counts('markdown')}, pages FROM fi)
SELECT *, {_SUMMARY} AS summary FROM co""")
def convert_documents(spark, d):
    return documents.convert(dialogue_pages(read(spark, d, "conversations")))


_FLAG = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
_MATH = rf"""mt AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN translate(substr(text, 1, 400), 'aeo', 'αεω') WHEN 1 THEN substr(text, 1, 400) || ' x² ≤ y' WHEN 2 THEN 'Let $a/b$ and α = 3/4 + β² be given. ' || substr(text, 1, 400)
  WHEN 3 THEN translate(substr(text, 1, 400), 'io', chr(65533) || chr(57345)) ELSE '∑x₂ = √2 ± 1/2' END AS t FROM documents),
ms AS (SELECT *, {_TRIM('t')} AS x, length(t) - length(translate(t, '{T.STRONG.replace("'", "''")}', '')) AS strong, length(t) - length(translate(t, '=+*', '')) AS weak FROM mt),
md AS (SELECT *, CASE WHEN strong = 0 THEN 0.0 ELSE least(1.0, (strong + weak * 0.3) / length(t) + 0.05 * {_FLAG(f"regexp_matches(t, '[0-9]+{_WS}*/{_WS}*[0-9]+')")} + 0.15 * {_FLAG("regexp_matches(t, '[a-zA-Z][₀-ₜ⁰-ⁿ]+')")}
  + 0.1 * {_FLAG(f"regexp_matches(t, '(^|{_WS})[a-zA-Z]{_WS}*={_WS}*[^=]')")} + 0.15 * {_FLAG("regexp_matches(t, 'sqrt|√')")} + 0.2 * {_FLAG("regexp_matches(t, 'sum|∑|int|∫')")}) END AS density, len({_WORDS_OF('x')}) AS n FROM ms),
mp AS (SELECT *, length(x) >= 20 AND n >= 5 AND {_FLAG("regexp_matches(x, '[.!?]$')")} + {_FLAG(f"regexp_matches(x, '(?i)(^|[^A-Za-z0-9_])({'|'.join(T.PROSE_WORDS)})([^A-Za-z0-9_]|$)')")} + {_FLAG(f"length(regexp_replace(x, '{_WS}', '', 'g')) > 4 * n")} + {_FLAG('n > 10')} >= 2 AS prose FROM md)"""


@_query(f"""WITH {_MATH}
SELECT doc_id, round(density, 6) AS density, prose, CASE WHEN strong = 0 THEN false WHEN length(t) < 50 THEN true WHEN prose AND density < 0.3 THEN false ELSE density > 0.15 OR strong >= 3 END AS has_math,
  (density > 0.25 AND length(t) < 100) OR (length(t) < 50 AND length(t) - length(translate(t, '{T.STRONG[:-2].replace("'", "''")}', '')) > 0) AS is_inline FROM mp""")
def math_flags(spark, d):
    c = F.col("text")
    return mathematical(_docs(spark, d)).select("doc_id", F.round(T.math_density(c), 6).alias("density"), T.looks_like_prose(c).alias("prose"), T.contains_math(c).alias("has_math"), T.is_inline_math(c).alias("is_inline"))


_TRACES = " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in T.GARBLED)
_LOST = r"[\x{FFFD}\x{E000}-\x{F8FF}]"


@_query(rf"""WITH {_MATH}, ga AS (SELECT doc_id, t, len(regexp_extract_all(t, '{_LOST}')) AS lost, length(t) - length(replace(t, chr(65533), '')) >= 3 OR len(regexp_extract_all(t, '[\x{{E000}}-\x{{F8FF}}]')) >= 2 OR {_TRACES} >= 3 OR regexp_matches(t, '[()=+*/∑∫-]{_WS}*{_LOST}') AS garbled FROM mt),
gp AS (SELECT *, (lost + 2 * len(regexp_extract_all(t, '[>@]{_WS}*[A-Za-z]|[A-Za-z]{_WS}*[>@]'))) / length(t) * 100 AS p FROM ga)
SELECT doc_id, garbled, CASE WHEN length(t) >= 50 AND garbled AND (p > 1 OR lost > 5) THEN floor(p * 10 + 0.5) / 10 END AS percentage FROM gp""")
def garbled_text(spark, d):
    c = F.col("text")
    return mathematical(_docs(spark, d)).select("doc_id", T.is_garbled(c).alias("garbled"), T.garbled_percentage(c).alias("percentage"))


_NORMAL = _TRIM(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_WS}*={_WS}*', ' = ', 'g'), '{_WS}*[+]{_WS}*', ' + ', 'g'), '{_WS}*-{_WS}*', ' - ', 'g'), '([0-9]+){_WS}*/{_WS}*([0-9]+)', '\\frac{{\1}}{{\2}}', 'g'), '{_WS}+', ' ', 'g')")


@_query(f"WITH {_MATH} SELECT doc_id, {_NORMAL} AS latex FROM mt")
def normal_latex(spark, d):
    return mathematical(_docs(spark, d)).select("doc_id", T.normal_latex(F.col("text")).alias("latex"))


@_query(rf"""WITH {_MATH}, di AS (SELECT doc_id, x, (starts_with(x, '$$') AND ends_with(x, '$$')) OR (contains(x, chr(10)) AND density > 0.35)
  OR (length(x) < 200 AND density > 0.4 AND (regexp_matches(x, '[=≤≥≠≈≃⇒→⇔↦∝]') OR regexp_matches(x, '(?i)∫|\\int|integral|∑|\\sum|summation|matrix'))) AS is_display FROM mp)
SELECT doc_id, is_display, CASE WHEN starts_with(x, '$') THEN x WHEN is_display THEN '$$' || chr(10) || x || chr(10) || '$$' ELSE '$' || x || '$' END AS delimited FROM di""")
def display_math(spark, d):
    c = F.col("text")
    return mathematical(_docs(spark, d)).select("doc_id", T.is_display_math(c).alias("is_display"), T.delimited(c, T.is_display_math(c)).alias("delimited"))


@_query()
def math_segments(spark, d):
    return pages.math_segments(mathematical(_docs(spark, d)), ("doc_id",))


@_query()
def math_markup(spark, d):
    return pages.math_markup(mathematical(_docs(spark, d)), ("doc_id",))


@_query()
def detected_tables(spark, d):
    return pages.detect_tables(order_pages(read(spark, d, "lineitem")), ("grid",))


@_query()
def positioned_tables(spark, d):
    wide = lambda x: F.struct(x.text.alias("text"), x.y.alias("y"), F.lit(50.0).alias("min_x"), (50 + 7.0 * F.length(x.text)).alias("max_x"), x["size"].alias("size"))
    return pages.positioned_tables(order_pages(read(spark, d, "lineitem")).withColumn("lines", F.transform("lines", wide)), ("grid",))


@_query()
def page_regions(spark, d):
    return pages.regions(placed_pages(_docs(spark, d)), ("doc_id", "page_no"))


@_query()
def page_reading_order(spark, d):
    return pages.reading_order(placed_pages(_docs(spark, d)), ("doc_id", "page_no"))


@_query()
def structured_markdown(spark, d):
    return pages.structured_markdown(placed_pages(_docs(spark, d)), ("doc_id", "page_no"))


def _replies(spark, d):
    """Replies as a vision model might give them, made of documents."""
    item = lambda kind, key, text: F.concat(F.lit(f'[{{"type": "{kind}", "{key}": "'), F.translate(text, '"\\\n', "   "), F.lit('", "top": '), (F.col("doc_id") % 400).cast("string"), F.lit(', "left": 10}]'))
    docs = _docs(spark, d).where("text IS NOT NULL")
    replies = {"headlines": item("headline", "text", F.substring("text", 1, 30)), "images": item("image", "description", F.substring("text", 31, 30)), "paragraphs": item("paragraph", "text", F.substring("text", 61, 90)), "photos": F.lit('[{"photo": "a (cat)", "x": 80, "y": 110, "w": 400}, {"photo": "cut'), "equations": F.lit("Here are two:\n$x^2$\n\\alpha"), "garbled": F.col("doc_id") % 2 == 0}
    return docs.select("doc_id", "text", *[v.alias(k) for k, v in replies.items()])


@_query()
def vision_pages(spark, d):
    return pages.vision_pages(_replies(spark, d), ("doc_id",))


@_query()
def hybrid_pages(spark, d):
    return pages.hybrid_pages(_replies(spark, d), ("doc_id",))


_SOLID = f"regexp_replace(x, '{_WS}', '', 'g')"
_CODE_LINE = f"regexp_matches(lower({_TRIM('x')}), '^(def|class|for|while|if|import|const|let|var|function) ') OR contains(x, ' -> ') OR (contains({_TRIM('x')}, ': ') AND contains(x, '=')) OR length({_SOLID}) - length(translate({_SOLID}, '{{}}[]();<>/=*+-', '')) >= 0.35 * length({_SOLID})".replace("{{}}", "{}")


@_query(f"""WITH {_LINES}, a AS (SELECT doc_id, list_filter(list(CASE WHEN doc_id % 2 = 0 THEN replace(raw, ' ', ' = ') ELSE raw END ORDER BY line_no), lambda x: {_TRIM('x')} <> '') AS f FROM m GROUP BY doc_id),
c AS (SELECT doc_id, len(f) AS n, len(list_filter(f, lambda x: {_CODE_LINE})) AS hits FROM a) SELECT doc_id, hits >= 2 AND hits >= n / 2 AS is_code FROM c""")
def code_blocks(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.replace("raw", F.lit(" "), F.lit(" = "))).otherwise(F.col("raw"))
    own = marked_lines(_docs(spark, d)).withColumn("raw", raw).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x.raw).alias("p"))
    return own.select("doc_id", T.is_code_block(F.col("p")).alias("is_code"))


_DECODED = "replace(replace(replace(replace(replace(replace(regexp_replace(html, '</?(point_box|collection)[^>]*>', '', 'g'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', '''')"
_CLEAN = _TRIM(f"regexp_replace({_DECODED}, '{_WS}+', ' ', 'g')")
_CAPTION = _TRIM(r"replace(regexp_replace(html, '([\[\]()])', '\\\1', 'g'), chr(10), ' ')")


@_query(f"SELECT page_id, {_CLEAN} AS cleaned, substr({_CAPTION}, 1, 200) AS caption FROM pages")
def cleaned_replies(spark, d):
    return read(spark, d, "pages").select("page_id", T.clean_reply(F.col("html")).alias("cleaned"), T.safe_caption(F.col("html")).alias("caption"))


@_query(f"""WITH {_FILES}, pr AS (SELECT 'src' || i AS project_id FROM range(0, 25) t(i)), p AS (SELECT project_id, count(*) AS n FROM f GROUP BY project_id)
SELECT pr.project_id, coalesce(n, 0) AS n_files FROM pr LEFT JOIN p ON pr.project_id = p.project_id""")
def counts_of_all_projects(spark, d):
    projects = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("project_id"))
    return store.file_counts(projects, stored_files(read(spark, d, "documents")))


@_query(f"WITH {_FILES} SELECT CAST(row_number() OVER (ORDER BY size DESC, file_id) AS BIGINT) AS place, file_id, name, status, CAST(CASE WHEN status = 'completed' THEN 100 ELSE 0 END AS BIGINT) AS progress FROM f WHERE project_id = 'src2'")
def files_of_project(spark, d):
    return store.files_of(stored_files(read(spark, d, "documents")), "src2", "size")


@_query(f"WITH {_FILES}, n AS (SELECT file_id, 'src9' AS project_id, name, size, 'pending' AS status FROM f WHERE file_id % 10 = 0 UNION ALL SELECT -1 - file_id, project_id, name, size, status FROM f WHERE file_id % 50 = 0)"
    " SELECT * FROM f UNION ALL SELECT * FROM n WHERE file_id NOT IN (SELECT file_id FROM f)")
def insert_files(spark, d):
    files = stored_files(read(spark, d, "documents"))
    again = files.where("file_id % 10 = 0").withColumn("project_id", F.lit("src9")).withColumn("status", F.lit("pending"))
    new = files.where("file_id % 50 = 0").withColumn("file_id", -1 - F.col("file_id"))
    return store.insert(files, again.unionByName(new), "file_id")


@_query(f"WITH {_FILES} SELECT file_id, project_id, CASE WHEN file_id % 3 = 0 THEN 'renamed' ELSE name END AS name, size, CASE WHEN file_id % 6 = 0 THEN 'error' ELSE status END AS status FROM f")
def patch_files(spark, d):
    files = stored_files(read(spark, d, "documents"))
    changes = files.where("file_id % 3 = 0").select("file_id", F.lit("renamed").alias("name"), F.when(F.col("file_id") % 6 == 0, "error").alias("status"))
    return store.patch(files, changes, "file_id")


@_query(f"""WITH {_FILES}, i AS (SELECT file_id, '#img_' || (file_id % 40) AS link, 'Picture ' || file_id AS alt FROM f), g AS (SELECT 'img_' || i AS id, 'data:image/png;base64,' || i AS data_url FROM range(0, 30) t(i))
SELECT file_id, coalesce(data_url, '[Image: ' || alt || ']') AS shown FROM i LEFT JOIN g ON link = '#' || id""")
def image_lookup(spark, d):
    files = stored_files(read(spark, d, "documents"))
    links = files.select("file_id", F.concat(F.lit("![Picture "), F.col("file_id").cast("string"), F.lit("](#img_"), (F.col("file_id") % 40).cast("string"), F.lit(")")).alias("markdown"))
    images = spark.range(30).select(F.concat(F.lit("img_"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("data:image/png;base64,"), F.col("id").cast("string")).alias("data_url"))
    return store.shown_images(links, images, "file_id").select("file_id", "shown")


_STYLED = f"""{_LINES}, {_PRINTED}, st AS (SELECT doc_id, line_no // 5 AS block, text, font_size, CASE WHEN line_no % 3 = 0 THEN 'Times-Bold' WHEN line_no % 7 = 0 THEN 'Times-Italic' ELSE 'Times' END AS font FROM pl)"""


@_query(f"""WITH {_STYLED}, w AS (SELECT doc_id, block, sum(length(text)) AS n, sum(font_size * length(text)) AS s, sum(CASE WHEN contains(lower(font), 'bold') THEN length(text) ELSE 0 END) AS b, sum(CASE WHEN contains(lower(font), 'italic') THEN length(text) ELSE 0 END) AS i FROM st GROUP BY doc_id, block),
a AS (SELECT *, CASE WHEN n > 0 THEN s / n ELSE 12.0 END AS size FROM w)
SELECT doc_id, CAST(block AS BIGINT) AS block, round(size, 6) AS size, CASE WHEN size >= 15 THEN 1 WHEN size >= 12.5 THEN 2 WHEN size >= 11 THEN 3 ELSE 0 END AS level, b > 0.5 * n AS bold, i > 0.5 * n AS italic FROM a""")
def block_styles(spark, d):
    rows = printed_lines(_docs(spark, d)).withColumn("block", F.floor(F.col("line_no") / 5)).withColumn("font", F.when(F.col("line_no") % 3 == 0, "Times-Bold").when(F.col("line_no") % 7 == 0, "Times-Italic").otherwise("Times"))
    return fonts.block_styles(rows, ["doc_id", "block"], F.lit(10.0)).withColumn("size", F.round("size", 6))


@_query(f"""WITH {_CELLS} SELECT grid, c, CASE WHEN sum(CASE WHEN {_IS_NUMERIC} THEN 1 ELSE 0 END) > 0.5 * count(*) FILTER (length(trim(text)) > 0) THEN 'right' ELSE 'left' END AS alignment FROM g GROUP BY grid, c""")
def whole_column_alignments(spark, d):
    c = F.col("text")
    numeric, filled = F.sum(T.is_numeric(c).cast("int")), F.sum((F.length(T.trim(c)) > 0).cast("int"))
    return order_cells(read(spark, d, "lineitem")).groupBy("grid", "c").agg(F.when(numeric > 0.5 * filled, "right").otherwise("left").alias("alignment"))


_SPANS = f"""{_LINES}, sp AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 0 THEN upper(substr(s, 1, 1)) ELSE lower(s) END AS text, CASE WHEN line_no % 4 = 0 THEN CAST(30 AS DOUBLE) ELSE CAST(12 AS DOUBLE) END AS font_size FROM l)"""


@_query(f"""WITH {_SPANS}, me AS (SELECT doc_id, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS median FROM sp GROUP BY doc_id),
x AS (SELECT sp.*, regexp_matches({_TRIM('text')}, '^[A-Z]$') AND font_size >= 1.5 * median AS cap, lead(text) OVER w AS after, lead(font_size) OVER w AS after_size FROM sp JOIN me ON sp.doc_id = me.doc_id WINDOW w AS (PARTITION BY sp.doc_id ORDER BY line_no)),
y AS (SELECT *, coalesce(cap AND regexp_matches({_TRIM('after')}, '^[a-z]'), false) AS takes FROM x), z AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS gone FROM y)
SELECT doc_id, line_no, CASE WHEN takes THEN {_TRIM('text')} || after ELSE text END AS text, CASE WHEN takes THEN after_size ELSE font_size END AS font_size FROM z WHERE NOT gone""")
def drop_caps(spark, d):
    rows = lines.lines_of(_docs(spark, d))
    text = F.when(F.col("line_no") % 4 == 0, T.upper_letter(F.substring("raw", 1, 1))).otherwise(T.lower(F.col("raw")))
    return lines.without_drop_caps(rows.select("doc_id", "line_no", text.alias("text"), F.when(F.col("line_no") % 4 == 0, 30.0).otherwise(12.0).alias("font_size")))


_CHECKED = rf"""{_LINES}, j AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS t FROM m GROUP BY doc_id)"""


@_query(rf"""WITH {_CHECKED}, c AS (SELECT t, len(regexp_extract_all(t, '[A-Za-z0-9_]+')) AS words, length(regexp_replace(t, '{_WS}', '', 'g')) AS chars, len(regexp_extract_all(t, '(?m)^\|.*\|$')) AS rows_, len(regexp_extract_all(t, '(?m)^\|[\s:-]+\|$')) AS seps,
  length(t) - length(replace(t, '$', '')) AS dollars, (length(t) - length(replace(t, '**', ''))) // 2 AS bolds, length(regexp_replace(t, '\*{{2,}}', '', 'g')) - length(replace(regexp_replace(t, '\*{{2,}}', '', 'g'), '*', '')) AS stars, doc_id FROM j)
SELECT doc_id, words, len(regexp_extract_all(t, '(?m)^#+{_WS}+.+$')) AS headings, len(regexp_extract_all(t, '(?m)^{_WS}*[-*+0-9.]+{_WS}+.+$')) AS lists, stars % 2 = 0 AND bolds % 2 = 0 AS emphasis_even, rows_ < 2 OR seps > 0 AS tables_ruled, chars = 0 OR chars BETWEEN 2 * greatest(words, 1) AND 15 * greatest(words, 1) AS word_density FROM c""")
def markdown_warnings(spark, d):
    whole = documents.lines_to_text(marked_lines(_docs(spark, d)), "doc_id", "line_no", "raw")
    return lines.warnings(whole)


@_query(rf"""WITH {_CHECKED}, v AS (SELECT length({_TRIM('t')}) > 0 AND NOT contains(t, 'undefined') AND NOT contains(t, '[object Object]') AND NOT contains(t, repeat(chr(10), 4)) AND (length(t) - length(replace(t, '```', ''))) // 3 % 2 = 0 AND len(regexp_extract_all(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) * 100 < length(t) AS ok FROM j)
SELECT count(*) AS files, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM v""")
def validation_summary(spark, d):
    checked = lines.validate(documents.lines_to_text(marked_lines(_docs(spark, d)), "doc_id", "line_no", "raw"))
    return checked.agg(F.count("*").alias("files"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("failed"))
