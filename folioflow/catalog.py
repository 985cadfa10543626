"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import latex
from .functions import text as T
from .operators import fonts, grids, lines, store
from .operators.islands import ordered
from .sources import dialogue_pages, marked_lines, order_cells, printed_lines, read, stored_files
from .streaming import latest_status as last_status

FLAGSHIP = "convert_documents"

#: Pieces of SQL that the statements below share.
_WS = T.WS
_TRIM = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_LINES = """l AS (
  SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no, p[n] AS s FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
m AS (
  SELECT doc_id, line_no, CASE line_no % 7 WHEN 1 THEN '• ' || s WHEN 2 THEN CAST(line_no AS VARCHAR) || ') ' || s WHEN 3 THEN 'Label Name: ' || s
    WHEN 4 THEN '| ' || replace(s, ' ', ' | ') || ' |' WHEN 5 THEN '| ' || replace(s, ' ', ' | ') || ' |' WHEN 6 THEN '•' ELSE s END AS raw FROM l)"""
_CELLS = """k AS (
  SELECT l_orderkey AS grid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS r, [CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR), '$' || CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR), l_returnflag, 'shipped on day ' || strftime(l_shipdate, '%d') || ' of it.'] AS t FROM lineitem),
g AS (SELECT grid, r, CAST(i - 1 AS INTEGER) AS c, t[i] AS text FROM (SELECT grid, r, t, unnest(range(1, 5)) AS i FROM k))"""
_FILES = """f AS (
  SELECT doc_id AS file_id, source AS project_id, 'file' || CAST(doc_id % 100 AS VARCHAR) || '.PDF' AS name, n_chars AS size,
    CASE WHEN doc_id % 5 = 0 THEN 'pending' WHEN doc_id % 7 = 0 THEN 'error' ELSE 'completed' END AS status FROM documents)"""
_NUMERIC = r"(regexp_matches({o}, '^[0-9]+$') OR (regexp_matches({o}, '^[-(]') AND regexp_matches(regexp_replace(regexp_replace({o}, '^[-(]', ''), '\)$', ''), '^[0-9]+$')))"
_ONCE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(text), ',', ''), '^[$€£¥₹]', ''), '[$€£¥₹]$', ''), '^([^.]*)\.', '\1'), '^([^%]*)%', '\1')"
_IS_NUMERIC = _NUMERIC.format(o=_ONCE)
_CORE = r"regexp_replace(regexp_replace(trim(text), '^[()\[\]{}%$€£+-]+', ''), '[()\[\]{}%$€£+-]+$', '')"
_IS_SHORT = rf"(length(trim(text)) BETWEEN 1 AND 24 AND NOT contains(trim(text), ' ') AND regexp_matches({_CORE}, '^([0-9]+|[0-9]*\.[0-9]+|[A-Za-z0-9]+)$'))"
_IS_SENT = r"(len(regexp_split_to_array(trim(text), '\s+')) >= 5 AND regexp_matches(trim(text), '[.!?…]+$'))"

_IS_PROSE = rf"""(length({_TRIM('text')}) > 60 OR (len(regexp_split_to_array({_TRIM('text')}, '{_WS}+')) >= 4 AND length({_TRIM('text')}) > 40
  AND len(list_filter(regexp_split_to_array(lower({_TRIM('text')}), '{_WS}+'), lambda x: regexp_replace(x, '[^a-z]', '', 'g') IN {T.CELL_WORDS})) >= 0.15 * len(regexp_split_to_array({_TRIM('text')}, '{_WS}+')))
  OR (len(regexp_split_to_array({_TRIM('text')}, '{_WS}+')) >= 5 AND regexp_matches({_TRIM('text')}, '^[A-Z]') AND length(regexp_replace(text, '{_WS}', '', 'g')) >= 3.5 * len(regexp_split_to_array({_TRIM('text')}, '{_WS}+'))))"""

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


@_query(rf"""
WITH {_LINES}, t AS (SELECT doc_id, line_no, raw, {_TRIM('raw')} AS x FROM m)
SELECT doc_id, line_no, CASE WHEN regexp_matches(raw, '^[{T.BULLETS}]') THEN 'bullet' WHEN regexp_matches(raw, '^[0-9]+[.)]{_WS}+') THEN 'number' END AS kind,
  CASE WHEN regexp_matches(raw, '^[{T.BULLETS}]') THEN regexp_replace(raw, '^[{T.BULLETS}]{_WS}*', '') ELSE raw END AS content,
  regexp_matches(x, '([.!?:]["''”’)]*|["”])$') AS terminal, regexp_matches(x, '^[a-z,;:–—"''”’)\]-]') AS continuation,
  regexp_matches(x, '^[A-Z][A-Za-z]*({_WS}+[A-Z][A-Za-z]*)*:{_WS}') AS label,
  regexp_matches(x, '[.!?]["''”’)]*$') OR lower(list_last(regexp_split_to_array(x, '{_WS}+'))) NOT IN {T.OPEN_WORDS} AS complete,
  regexp_matches(x, '^([-•◦*]{_WS}|([0-9]+|[A-Za-z])[.)]{_WS}+)') AS list_like
FROM t""")
def line_predicates(spark, d):
    c = F.col("raw")
    return marked_lines(_docs(spark, d)).select("doc_id", "line_no", T.list_kind(c).alias("kind"), T.list_content(c).alias("content"), T.ends_terminal(c).alias("terminal"), T.starts_as_continuation(c).alias("continuation"), T.has_label(c).alias("label"), T.ends_complete_thought(c).alias("complete"), T.list_like(c).alias("list_like"))


@_query(rf"""
WITH h AS (SELECT doc_id, replace(replace(text, ' th', ' t-' || chr(10) || 'h'), ' de', ' d–' || chr(10) || 'e') AS t FROM documents)
SELECT doc_id, regexp_replace(t, '([A-Za-z0-9_])-{_WS}*\n{_WS}*([A-Za-z0-9_])', '\1\2', 'g') AS plain,
  regexp_replace(regexp_replace(t, '([A-Za-z0-9_])-{_WS}*\n{_WS}*([A-Za-z0-9_])', '\1\2', 'g'), '([A-Za-z0-9_])–{_WS}*\n{_WS}*([A-Za-z0-9_])', '\1\2', 'g') AS all_kinds FROM h""")
def fix_hyphenation(spark, d):
    t = F.replace(F.replace("text", F.lit(" th"), F.lit(" t-\nh")), F.lit(" de"), F.lit(" d–\ne"))
    return _docs(spark, d).withColumn("t", t).select("doc_id", T.dehyphenate(F.col("t")).alias("plain"), T.dehyphenate_all(F.col("t")).alias("all_kinds"))


_NORM = lambda c: f"lower({_TRIM(f'''regexp_replace(regexp_replace({c}, '[0-9]+', '#', 'g'), '{_WS}+', ' ', 'g')''')})"


@_query(f"""
WITH {_LINES}, p AS (SELECT doc_id, line_no, {_NORM('raw')} AS pattern, lag({_NORM('raw')}) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM m),
w AS (SELECT *, list_distinct(regexp_split_to_array(pattern, '{_WS}+')) AS a, list_distinct(regexp_split_to_array(before, '{_WS}+')) AS b FROM p WHERE before IS NOT NULL)
SELECT doc_id, line_no, pattern, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM w""")
def line_similarity(spark, d):
    rows = marked_lines(_docs(spark, d)).withColumn("pattern", T.comparable(F.col("raw")))
    rows = rows.withColumn("before", F.lag("pattern").over(ordered(["doc_id"], ["line_no"]))).where("before IS NOT NULL")
    return rows.select("doc_id", "line_no", "pattern", F.round(T.jaccard(F.col("pattern"), F.col("before")), 6).alias("similarity"))


@_query(rf"""
WITH {_LINES}, x AS (SELECT doc_id, line_no, regexp_replace(regexp_replace({_TRIM('raw')}, '^[{T.BULLETS}]{_WS}*', '- '), '^([0-9]+)[.)]{_WS}+', '\1. ') AS s FROM m),
j AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line_no) AS t FROM x GROUP BY doc_id)
SELECT doc_id, {_TRIM(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")} AS markdown FROM j""")
def plain_text_to_markdown(spark, d):
    whole = marked_lines(_docs(spark, d)).groupBy("doc_id").agg(lines.joined("raw", "line_no").alias("t"))
    return whole.select("doc_id", T.plain_markdown(F.col("t")).alias("markdown"))


@_query(rf"""
WITH {_LINES}, x AS (SELECT *, {_TRIM('raw')} AS now, lag({_TRIM('raw')}) OVER w AS before FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
y AS (SELECT *, coalesce(length(now) BETWEEN 1 AND 45 AND NOT regexp_matches(now, '^#') AND NOT regexp_matches(now, '^[-*0-9]+[.)]\s') AND length(before) > 0 AND NOT regexp_matches(now, '^[A-Z]')
  AND (NOT regexp_matches(before, '[.!?:;]$') OR regexp_matches(now, '^[a-z]')), false) AS g FROM x),
z AS (SELECT *, sum(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM y),
u AS (SELECT doc_id, island, CASE WHEN count(*) > 1 THEN string_agg(now, ' ' ORDER BY line_no) ELSE min(raw) END AS line FROM z GROUP BY doc_id, island)
SELECT doc_id, string_agg(line, chr(10) ORDER BY island) AS text FROM u GROUP BY doc_id""")
def defragment_lines(spark, d):
    return lines.defragment(marked_lines(_docs(spark, d)))


@_query(rf"""
WITH {_LINES}, x AS (SELECT *, regexp_matches({_TRIM('raw')}, '^[{T.BULLETS}*-]$') AS lone, lead({_TRIM('raw')}) OVER w AS after FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
y AS (SELECT *, coalesce(lone AND length(after) > 0 AND NOT regexp_matches(after, '^[{T.BULLETS}0-9*-]'), false) AS takes FROM x),
z AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS gone FROM y)
SELECT doc_id, string_agg(CASE WHEN takes THEN '- ' || after ELSE raw END, chr(10) ORDER BY line_no) AS text FROM z WHERE NOT gone GROUP BY doc_id""")
def merge_bullet_lines(spark, d):
    return lines.merge_bullets(marked_lines(_docs(spark, d)))


_WHOLE = f"{_LINES}, j AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS t FROM m GROUP BY doc_id)"


def _whole(spark, d):
    return marked_lines(_docs(spark, d)).groupBy("doc_id").agg(lines.joined("raw", "line_no").alias("text"))


@_query(rf"""
WITH {_WHOLE}, r AS (SELECT doc_id, line_no, regexp_matches({_TRIM('raw')}, '^\|.+\|$') AS x FROM m),
s AS (SELECT doc_id, sum(CASE WHEN x AND NOT coalesce(b, false) THEN 1 ELSE 0 END) AS tables FROM (SELECT doc_id, x, lag(x) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM r) GROUP BY doc_id)
SELECT j.doc_id, len(regexp_extract_all(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#+{_WS}+', '', 'g'), '[*_`~]', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g'), '|', ' '), '[A-Za-z0-9_]+')) AS words,
  len(regexp_extract_all(t, '(?m)^#+{_WS}+.+$')) AS headings, CAST(tables AS BIGINT) AS tables,
  len(regexp_extract_all(t, '(?m)^{_WS}*[-*+]{_WS}+.+$')) + len(regexp_extract_all(t, '(?m)^{_WS}*[0-9]+[.)]{_WS}+.+$')) AS list_items, len(regexp_extract_all(t, '!\[[^\]]*\]\([^)]+\)')) AS images
FROM j JOIN s ON j.doc_id = s.doc_id""")
def doc_stats(spark, d):
    return lines.statistics(_whole(spark, d))


@_query(rf"""
WITH {_WHOLE}, c AS (SELECT doc_id, length({_TRIM('t')}) > 0 AS has_text, NOT contains(t, 'undefined') AS no_undefined, NOT contains(t, '[object Object]') AS no_object, NOT contains(t, repeat(chr(10), 4)) AS no_wide_gaps,
  (length(t) - length(replace(t, '```', ''))) // 3 % 2 = 0 AS fences_even, len(regexp_extract_all(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) * 100 < length(t) AS few_controls,
  (length(t) - length(replace(t, '**', ''))) // 2 % 2 = 0 AS bold_even, (length(t) - length(replace(t, '$', ''))) % 2 = 0 AS dollars_even, CAST(length(t) AS BIGINT) AS characters, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines FROM j)
SELECT *, has_text AND no_undefined AND no_object AND no_wide_gaps AND fences_even AND few_controls AS passed FROM c""")
def validate_markdown(spark, d):
    return lines.validate(_whole(spark, d))


@_query(f"WITH {_CELLS} SELECT grid, r, c, {_IS_SHORT} AS short, {_IS_NUMERIC} AS num, {_IS_SENT} AS sent, {_IS_PROSE} AS prose FROM g")
def cell_classes(spark, d):
    c = F.col("text")
    return order_cells(read(spark, d, "lineitem")).select("grid", "r", "c", T.is_short_token(c).alias("short"), T.is_numeric(c).alias("num"), T.is_sentence(c).alias("sent"), T.is_prose_fragment(c).alias("prose"))




@_query(f"""
WITH {_CELLS}, k2 AS (SELECT grid, r, length(trim(text)) AS ln, CAST(length(trim(text)) > 0 AS INTEGER) AS f, CAST({_IS_SHORT} AS INTEGER) AS s, CAST({_IS_NUMERIC} AS INTEGER) AS n, CAST({_IS_SENT} AS INTEGER) AS e, CAST({_IS_PROSE} AS INTEGER) AS o FROM g),
w AS (SELECT grid, r, count(*) AS width, sum(f) AS f, sum(s) AS s, sum(n) AS n, sum(e) AS e, sum(o) AS o, sum(ln) AS ln, max(ln) AS mx FROM k2 GROUP BY grid, r),
p AS (SELECT grid, count(*) AS n_rows, max(width) AS n_cols, CAST(sum(f) AS BIGINT) AS non_empty, CAST(sum(s) AS BIGINT) AS short_cells, CAST(sum(n) AS BIGINT) AS numeric_cells, CAST(sum(e) AS BIGINT) AS sentence_cells, CAST(sum(o) AS BIGINT) AS prose_cells, CAST(sum(ln) AS BIGINT) AS total_len, max(mx) AS max_len, min(width) = max(width) AS even FROM w GROUP BY grid),
q AS (SELECT *, sentence_cells / non_empty AS rs, prose_cells / non_empty AS rp, total_len / non_empty AS mean FROM p),
v AS (SELECT * EXCLUDE (even, rs, rp, mean), n_rows * 1.0 + n_cols * 0.8 + 3 * short_cells / non_empty + 2 * numeric_cells / non_empty
  - CASE WHEN rs > 0.8 THEN 4 * rs WHEN rs > 0.4 THEN 2 * rs ELSE 0 END - CASE WHEN rp > 0.5 THEN 6 * rp WHEN rp > 0.3 THEN 3 * rp WHEN rp > 0.15 THEN 1.5 * rp ELSE 0 END
  - CASE WHEN greatest(rs, rp) > 0.6 AND short_cells + numeric_cells < 0.3 * non_empty THEN 5 ELSE 0 END - CASE WHEN mean > 80 THEN 4 WHEN mean > 50 THEN 2 ELSE 0 END - CASE WHEN max_len > 100 THEN 2 ELSE 0 END
  + CASE WHEN n_rows >= 4 AND n_cols >= 3 AND prose_cells < 0.3 * non_empty THEN 2 ELSE 0 END + CASE WHEN even THEN 1.5 ELSE 0 END + CASE WHEN non_empty >= 0.6 * n_rows * n_cols THEN 1 ELSE 0 END AS score FROM q)
SELECT * REPLACE (round(score, 6) AS score), n_rows >= 2 AND n_cols >= 2 AND non_empty > 0 AND non_empty >= 0.25 * n_rows * n_cols AND score >= 2
  AND (total_len <= 60 * non_empty OR short_cells + numeric_cells >= 0.5 * non_empty) AND (max_len <= 80 OR total_len <= 40 * non_empty OR short_cells + numeric_cells >= 0.4 * non_empty)
  AND (short_cells >= 0.15 * non_empty OR numeric_cells > 0 OR (n_rows >= 4 AND n_cols >= 3 AND total_len <= 30 * non_empty))
  AND (sentence_cells < 0.4 * non_empty OR numeric_cells >= 0.2 * non_empty OR short_cells >= 0.3 * non_empty) AS is_table FROM v""")
def grid_profiles(spark, d):
    return grids.passes(grids.profile(order_cells(read(spark, d, "lineitem")), "grid", "r", "c", "text")).withColumn("score", F.round("score", 6))


_COLUMNS = f"""q AS (SELECT grid, c, CAST(least(greatest(max(length(text)), 3), 50) AS BIGINT) AS width,
  CASE WHEN sum(CASE WHEN r > 0 AND {_IS_NUMERIC} THEN 1 ELSE 0 END) > 0.7 * sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) THEN 'right' ELSE 'left' END AS alignment FROM g GROUP BY grid, c)"""


@_query(f"WITH {_CELLS}, {_COLUMNS} SELECT * FROM q")
def grid_columns(spark, d):
    return grids.columns(order_cells(read(spark, d, "lineitem")), "grid", "r", "c", "text")


@_query(f"""
WITH {_CELLS}, {_COLUMNS}, v AS (SELECT g.grid, g.r, g.c, CASE WHEN alignment = 'right' THEN repeat(' ', greatest(width - length(text), 0)) || text ELSE text || repeat(' ', greatest(width - length(text), 0)) END AS v,
  CASE WHEN alignment = 'right' THEN repeat('-', width - 1) || ':' ELSE repeat('-', width) END AS d FROM g JOIN q ON g.grid = q.grid AND g.c = q.c),
l AS (SELECT grid, r, '| ' || string_agg(v, ' | ' ORDER BY c) || ' |' || CASE WHEN r = 0 THEN chr(10) || '| ' || string_agg(d, ' | ' ORDER BY c) || ' |' ELSE '' END AS line FROM v GROUP BY grid, r)
SELECT grid, string_agg(line, chr(10) ORDER BY r) AS markdown FROM l GROUP BY grid""")
def table_markdown(spark, d):
    return grids.to_markdown(order_cells(read(spark, d, "lineitem")), "grid", "r", "c", "text")


@_query(rf"""
WITH {_LINES}, b AS (SELECT doc_id, line_no, contains(raw, '|') OR contains(raw, '¦') OR (regexp_matches(raw, '^[\s+|=:¦-]+$') AND contains(raw, '-')) AS x FROM m),
i AS (SELECT *, sum(CASE WHEN x THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM b)
SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM i WHERE x GROUP BY doc_id, k HAVING count(*) >= 2""")
def bordered_tables(spark, d):
    return grids.bordered_runs(marked_lines(_docs(spark, d)))


_SPLIT = lambda c: f"CASE WHEN regexp_replace({c}, '{_WS}+$', '') = '' THEN [''] WHEN regexp_matches(regexp_replace({c}, '{_WS}+$', ''), '[ \\t]{{3,}}') THEN regexp_split_to_array(regexp_replace({c}, '{_WS}+$', ''), '[ \\t]{{3,}}') ELSE regexp_split_to_array(regexp_replace({c}, '{_WS}+$', ''), '[ \\t]{{2,}}') END"
_SPACED = f"{_LINES}, sp AS (SELECT DISTINCT doc_id, replace(replace(raw, ' an', '   an'), 'e ', 'e  12,5 ') AS s FROM m)"


def _spaced(spark, d):
    wide = F.replace(F.replace("raw", F.lit(" an"), F.lit("   an")), F.lit("e "), F.lit("e  12,5 "))
    return marked_lines(_docs(spark, d)).select("doc_id", wide.alias("line")).distinct()


@_query(rf"""
WITH {_SPACED}, p AS (SELECT doc_id, s, len({_SPLIT('s')}) AS n FROM sp)
SELECT doc_id, s AS line, least((CASE WHEN contains(s, '|') THEN 3 ELSE 0 END) + (CASE WHEN n >= 2 THEN 2 ELSE 0 END) + (CASE WHEN n >= 4 THEN 1 ELSE 0 END) + (CASE WHEN len(regexp_extract_all(s, '[0-9]+([,.0-9]*)?')) >= 3 THEN 2 ELSE 0 END)
  + (CASE WHEN regexp_matches(s, '\t|{_WS}{{3}}') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(s, '[$€£%]') THEN 1 ELSE 0 END), 10) / 10 AS score FROM p""")
def table_likelihood(spark, d):
    return _spaced(spark, d).select("doc_id", "line", T.table_likelihood(F.col("line")).alias("score"))


@_query(rf"WITH {_SPACED} SELECT doc_id, s AS line, array_to_string({_SPLIT('s')}, '¬') AS cells, CAST(len({_SPLIT('s')}) AS INTEGER) AS n_cells FROM sp")
def split_cells(spark, d):
    cells = T.split_cells(F.col("line"))
    return _spaced(spark, d).select("doc_id", "line", F.array_join(cells, "¬").alias("cells"), F.size(cells).alias("n_cells"))


_PAGES = "pg AS (SELECT conv_id AS doc_id, turn AS page_no, 'Report ' || CAST(conv_id AS VARCHAR) || chr(10) || text || chr(10) || 'Page ' || CAST(turn AS VARCHAR) AS text FROM conversations)"
_RUNNING = f"""fl AS (SELECT doc_id, page_no, list_filter(string_split(text, chr(10)), lambda s: length({_TRIM('s')}) > 0) AS ls FROM pg),
ht AS (SELECT doc_id, page_no, 'header' AS kind, CAST(i - 1 AS INTEGER) AS place, ls[i] AS s FROM (SELECT doc_id, page_no, ls, unnest(range(1, least(len(ls), 3) + 1)) AS i FROM fl)
  UNION ALL SELECT doc_id, page_no, 'footer', CAST(i - 1 AS INTEGER), ls[len(ls) - i + 1] FROM (SELECT doc_id, page_no, ls, unnest(range(1, least(len(ls), 3) + 1)) AS i FROM fl)),
tt AS (SELECT doc_id, count(*) AS total FROM pg GROUP BY doc_id HAVING count(*) >= 3),
rn AS (SELECT ht.doc_id, kind, place, page_no, {_NORM('s')} AS q, total FROM ht JOIN tt ON ht.doc_id = tt.doc_id),
rq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, place ORDER BY page_no) AS i FROM rn WHERE q <> ''),
rc AS (
  SELECT doc_id, kind, place, total, i, [{{'p': q, 'n': 1}}] AS st FROM rq WHERE i = 1
  UNION ALL
  SELECT doc_id, kind, place, total, i, CASE WHEN k IS NULL OR k = 0 THEN list_append(st, {{'p': q, 'n': 1}}) ELSE list_transform(st, lambda x, j: CASE WHEN j = k THEN {{'p': x.p, 'n': x.n + 1}} ELSE x END) END
  FROM (SELECT rq.*, rc.st, list_position(list_transform(rc.st, lambda x: len(list_intersect(regexp_split_to_array(x.p, '{_WS}+'), regexp_split_to_array(q, '{_WS}+'))) >= 0.8 * len(list_distinct(list_concat(regexp_split_to_array(x.p, '{_WS}+'), regexp_split_to_array(q, '{_WS}+'))))), true) AS k
    FROM rc JOIN rq ON rq.doc_id = rc.doc_id AND rq.kind = rc.kind AND rq.place = rc.place AND rq.i = rc.i + 1)),
rz AS (SELECT doc_id, kind, place, total, arg_max(st, i) AS st FROM rc GROUP BY ALL),
rl AS (SELECT doc_id, kind, place, total, unnest(st) AS u FROM rz),
pt AS (SELECT doc_id, kind, place, u.p AS pattern, CAST(u.n AS BIGINT) AS n_pages FROM rl WHERE u.n >= 0.5 * total)"""


@_query(f"WITH RECURSIVE {_PAGES}, {_RUNNING} SELECT * FROM pt")
def header_footer_patterns(spark, d):
    return lines.running_lines(dialogue_pages(read(spark, d, "conversations")), "doc_id", "page_no", "text")


@_query(f"WITH {_FILES} SELECT project_id, count(*) AS n_files FROM f GROUP BY project_id")
def project_file_counts(spark, d):
    files = stored_files(read(spark, d, "documents"))
    return store.file_counts(files.select("project_id").distinct(), files)


@_query(f"WITH {_FILES} SELECT status, count(*) AS n_files FROM f GROUP BY status")
def file_status_counts(spark, d):
    return store.status_counts(stored_files(read(spark, d, "documents")))


@_query(f"WITH {_FILES} SELECT file_id, project_id, name, size + CASE WHEN file_id % 4 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN file_id % 4 = 0 THEN 'completed' ELSE status END AS status FROM f")
def upsert_files(spark, d):
    files = stored_files(read(spark, d, "documents"))
    return store.upsert(files, files.where("file_id % 4 = 0").withColumn("size", F.col("size") + 1).withColumn("status", F.lit("completed")), "file_id")


@_query(f"WITH {_FILES} SELECT * FROM f WHERE project_id NOT IN ('src1', 'src3')")
def cascade_delete(spark, d):
    files = stored_files(read(spark, d, "documents"))
    projects = files.select("project_id").distinct()
    return store.delete_project(projects, files, projects.where("project_id IN ('src1', 'src3')"))[1]


@_query(f"WITH {_FILES}, x AS (SELECT name, max(file_id) AS file_id FROM f WHERE status = 'completed' GROUP BY name) SELECT regexp_replace(name, '(?i)\\.pdf$', '.md') AS entry, file_id FROM x")
def export_entries(spark, d):
    done = stored_files(read(spark, d, "documents")).where("status = 'completed'")
    return done.groupBy("name").agg(F.max("file_id").alias("file_id")).select(T.markdown_name(F.col("name")).alias("entry"), "file_id")


@_query(f"WITH {_FILES} SELECT file_id, CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024, 1)) ELSE printf('%.1f MB', round(size / 1048576, 1)) END AS shown FROM f")
def file_sizes(spark, d):
    return stored_files(read(spark, d, "documents")).select("file_id", T.file_size(F.col("size")).alias("shown"))


_PRINTED = """pl AS (
  SELECT doc_id, line_no // 20 AS page_no, line_no, s AS text, 8 + (length(s) * 7 % 29) / 4 AS font_size, CAST(line_no * 12 - length(s) % 3 * 8 AS DOUBLE) AS y FROM l)"""


@_query(f"""
WITH {_LINES}, {_PRINTED}, z AS (SELECT doc_id, page_no, floor(font_size * 2 + 0.5) / 2 AS body, sum(length(text)) AS w, min(line_no) AS first FROM pl GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY w DESC, first) AS k FROM z)
SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, body, body * 1.5 AS h1, body * 1.25 AS h2, round(body * 1.1, 6) AS h3 FROM r WHERE k = 1""")
def font_profiles(spark, d):
    return fonts.font_profile(printed_lines(_docs(spark, d))).withColumn("h3", F.round("h3", 6))


@_query(f"""
WITH {_LINES}, {_PRINTED}, a AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS gap FROM pl)
SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, count(*) AS n_lines, round(CASE WHEN count(*) < 2 THEN 12.0 ELSE coalesce(avg(gap) FILTER (gap > 0), 1.2 * avg(font_size)) END, 6) AS height FROM a GROUP BY doc_id, page_no""")
def block_line_heights(spark, d):
    return fonts.line_heights(printed_lines(_docs(spark, d))).withColumn("height", F.round("height", 6))


@_query(f"""
WITH {_LINES}, c AS (SELECT doc_id, len(string_split(raw, '|')) AS n, count(*) AS w, min(line_no) AS first FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, first) AS k FROM c)
SELECT doc_id, CAST(n AS INTEGER) AS n_cells, w AS weight FROM r WHERE k = 1""")
def most_common_cell_counts(spark, d):
    rows = marked_lines(_docs(spark, d)).withColumn("n", F.size(F.split("raw", r"\|")))
    return fonts.first_seen_mode(rows, ["doc_id"], "n", "line_no", name="n_cells")


def _latex_sql() -> str:
    t = "translate(text, 'aeiostn', 'αε²₂≤√₄')"
    for sign, (marks, plain) in (("^", latex.RAISED), ("_", latex.LOWERED)):
        t = f"regexp_replace({t}, '([{marks}]+)', '{sign}{{\\1}}', 'g')"
    t = f"translate(translate({t}, '{latex.RAISED[0]}', '{latex.RAISED[1]}'), '{latex.LOWERED[0]}', '{latex.LOWERED[1]}')"
    for mark, command in latex.COMMANDS.items():
        t = "replace({}, '{}', '{} ')".format(t, mark, command.replace("'", "''"))
    return f"SELECT doc_id, trim(regexp_replace({t}, '\\s+', ' ', 'g')) AS latex FROM documents"


@_query(_latex_sql())
def unicode_to_latex(spark, d):
    return _docs(spark, d).select("doc_id", latex.to_latex(F.translate("text", "aeiostn", "αε²₂≤√₄")).alias("latex"))


@_query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def latest_status(spark, d):
    return last_status(read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
