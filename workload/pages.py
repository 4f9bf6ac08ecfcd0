"""Page geometry, tables and text quality."""

from pyspark.sql import functions as F

from paperloom.functions import layout as L
from paperloom.functions import quality as Q
from paperloom.functions import tables as T
from paperloom.functions.documents import full_text
from paperloom.functions.strings import has_cjk
from paperloom.functions.tokens import word_set
from paperloom.operators.evaluation import compare_extractions, table_recall, text_overlap
from paperloom.operators.rows import each, each_struct
from paperloom.sources.readers import is_valid_pdf
from paperloom.sources.writers import page_lines
from workload.base import FILINGS_SQL, filings, register

# --- blocks: one per line of a document -------------------------------------------------------

BLOCKS_SQL = """blocks AS (
  SELECT doc_id, i - 1 AS i, len(ls) * 12.0 AS height, line,
    CASE WHEN length(line) % 2 = 0 THEN 50.0 ELSE 320.0 END AS x0, (i - 1) * 12.0 AS y0,
    CASE WHEN length(line) % 2 = 0 THEN 50.0 ELSE 320.0 END + least(length(line), 240) AS x1, (i - 1) * 12.0 + 10 AS y1
  FROM (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def blocks(t):
    """``doc_id, height, blocks(text, bbox)``: the page of a document, lines as blocks."""
    lines = F.split("text", "\n")

    def block(line, i):
        x0 = F.when(F.length(line) % 2 == 0, 50.0).otherwise(320.0)
        box = L.box(x0, i * 12.0, x0 + F.least(F.length(line), F.lit(240)), i * 12.0 + 10)
        return F.struct(i.alias("i"), line.alias("text"), box.alias("bbox"))

    return t.documents.select(
        "doc_id", (F.size(lines) * 12.0).alias("height"), F.transform(lines, block).alias("blocks")
    )


@register(
    "layout_columns",
    f"""WITH {BLOCKS_SQL} SELECT doc_id, CASE WHEN sum(CASE WHEN (x0 + x1) / 2 < 300 THEN 1 ELSE 0 END) > 3
      AND sum(CASE WHEN (x0 + x1) / 2 < 300 THEN 0 ELSE 1 END) > 3 THEN 'double_column' ELSE 'single_column' END AS layout_type
    FROM blocks GROUP BY doc_id""",
)
def layout_columns(t):
    boxes = F.transform("blocks", lambda b: b["bbox"])
    return blocks(t).select("doc_id", L.layout_type(boxes, 600.0).alias("layout_type"))


_TYPED = """typed AS (SELECT *, CASE WHEN y1 < height * 0.15::DOUBLE THEN 'header' WHEN y0 > height * 0.9::DOUBLE THEN 'footer' ELSE 'text' END AS block_type FROM blocks)"""  # zones only; titles count as content


@register(
    "header_footer",
    f"""WITH {BLOCKS_SQL}, {_TYPED}, b AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS body FROM typed)
    SELECT doc_id, CAST(i AS BIGINT) AS block_no, CASE WHEN block_type = 'text' AND length(body) <= 100 AND regexp_matches(body,
      '^(第[一二三四五六七八九十]+[章节]|第\\d+[章节]|\\d+[、.．]\\s*\\S+|[一二三四五六七八九十]+[、]\\s*\\S+|[\\(（]\\d+[）\\)]\\s*\\S+|[1-9]\\d*\\.\\d+\\s+\\S+)') THEN 'title' ELSE block_type END AS block_type
    FROM b""",
)
def header_footer(t):
    typed = F.transform(
        "blocks", lambda b: F.struct(b["i"].cast("bigint").alias("block_no"), L.block_type(b["bbox"], b["text"], F.col("height")).alias("block_type"))
    )
    return each_struct(blocks(t), ["doc_id"], typed, "block_no")


@register(
    "content_text",
    f"""WITH {BLOCKS_SQL}, {_TYPED} SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (block_type = 'text'), '') AS body,
      count(*) FILTER (block_type = 'text') AS n_blocks FROM typed GROUP BY doc_id""",
)
def content_text(t):
    typed = F.transform(
        "blocks", lambda b: F.struct(b["text"].alias("text"), L.block_type(b["bbox"], b["text"], F.col("height")).alias("block_type"))
    )
    kept = L.content_blocks(typed)
    return blocks(t).select(
        "doc_id",
        F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("body"),
        F.size(kept).cast("bigint").alias("n_blocks"),
    )


@register(
    "bbox_merge",
    f"""WITH {BLOCKS_SQL} SELECT doc_id, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM blocks GROUP BY doc_id""",
)
def bbox_merge(t):
    merged = L.merge_boxes(F.transform("blocks", lambda b: b["bbox"]))
    return blocks(t).select("doc_id", merged.alias("m")).select("doc_id", "m.*")


_LINE_BOX = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
  l_linenumber * 10.0::DOUBLE AS x0, l_quantity * 15 AS y0, l_linenumber * 10.0::DOUBLE + l_partkey % 600 AS x1, l_quantity * 15 + l_suppkey % 50 + 1 AS y1 FROM lineitem"""


@register(
    "region_classify",
    f"""SELECT l_returnflag, region, count(*) AS n_boxes, sum(CASE WHEN y1 < 120 OR y0 > 720 THEN 0 ELSE 1 END)::BIGINT AS n_content FROM (
      SELECT *, CASE WHEN y1 < 800 * 0.15::DOUBLE THEN 'header' WHEN y0 > 800 * 0.9::DOUBLE THEN 'footer'
        WHEN y1 - y0 > (x1 - x0) * 0.3::DOUBLE THEN 'text' WHEN x1 - x0 > 600 * 0.8::DOUBLE THEN 'table' ELSE 'text' END AS region
      FROM ({_LINE_BOX})) GROUP BY 1, 2""",
)
def region_classify(t):
    box = _line_box()
    typed = t.lineitem.select(
        "l_returnflag",
        L.region_type(box, F.lit(600.0), F.lit(800.0)).alias("region"),
        L.is_content(box, F.lit(800.0)).alias("content"),
    )
    return typed.groupBy("l_returnflag", "region").agg(
        F.count("*").alias("n_boxes"), F.count_if("content").alias("n_content")
    )


def _line_box():
    x0, y0 = F.col("l_linenumber") * F.lit(10.0), F.col("l_quantity") * 15
    return L.box(x0, y0, x0 + F.col("l_partkey") % 600, y0 + F.col("l_suppkey") % 50 + 1)


@register(
    "bbox_iou",
    f"""WITH b AS (SELECT *, 20.0::DOUBLE AS a0, 100.0::DOUBLE AS b0, 300.0::DOUBLE AS a1, l_quantity * 16 AS b1 FROM ({_LINE_BOX})),
    o AS (SELECT *, least(x1, a1) - greatest(x0, a0) AS w, least(y1, b1) - greatest(y0, b0) AS h FROM b),
    s AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN w * h / ((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - w * h) ELSE 0 END AS iou FROM o)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(iou, 6) AS iou FROM s WHERE iou > 0""",
)
def bbox_iou(t):
    fixed = L.box(F.lit(20.0), F.lit(100.0), F.lit(300.0), F.col("l_quantity") * 16)
    scored = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", L.iou(_line_box(), fixed).alias("raw")
    )
    return scored.where("raw > 0").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("raw", 6).alias("iou")
    )


# --- tables: one per part, with gaps ----------------------------------------------------------

PART_TABLE_SQL = """ptab AS (SELECT p_partkey, CAST([
  ['item', NULL, CASE WHEN p_size > 25 THEN ' unit  price ' END, 'size'],
  [NULL, NULL, NULL, NULL],
  [p_name, NULL, CASE WHEN p_size > 25 THEN CAST(p_partkey AS VARCHAR) END, CAST(p_size AS VARCHAR)],
  [CASE WHEN p_size % 3 = 0 THEN p_brand END, NULL, NULL, CASE WHEN p_size % 5 <> 0 THEN '' END]] AS VARCHAR[][]) AS data FROM part)"""


def part_tables(t):
    def text(value):
        return value.cast("string")

    null = F.lit(None).cast("string")
    big = F.col("p_size") > 25
    rows = F.array(
        F.array(F.lit("item"), null, F.when(big, " unit  price "), F.lit("size")),
        F.array(null, null, null, null),
        F.array(F.col("p_name"), null, F.when(big, text(F.col("p_partkey"))), text(F.col("p_size"))),
        F.array(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), null, null, F.when(F.col("p_size") % 5 != 0, "")),
    )
    return t.part.select("p_partkey", rows.alias("data"))


_CLEAN = f"""{PART_TABLE_SQL},
r AS (SELECT p_partkey, list_filter(data, lambda r: len(list_filter(r, lambda c: c IS NOT NULL)) > 0) AS rows FROM ptab),
u AS (SELECT *, list_filter([1, 2, 3, 4], lambda i: len(list_filter(rows, lambda r: r[i] IS NOT NULL)) > 0) AS used FROM r),
clean AS (SELECT p_partkey, list_transform(rows, lambda r: list_transform(used, lambda i: trim(regexp_replace(coalesce(r[i], ''), '\\s+', ' ', 'g')))) AS data FROM u)"""


def _flat(table):
    return F.array_join(F.transform(table, lambda r: F.array_join(r, "|")), "/")


def _flat_sql(table):
    return f"array_to_string(list_transform({table}, lambda r: array_to_string(r, '|')), '/')"


@register("table_clean", f"WITH {_CLEAN} SELECT p_partkey, {_flat_sql('data')} AS cells FROM clean")
def table_clean(t):
    return part_tables(t).select("p_partkey", _flat(T.clean_table("data")).alias("cells"))


@register(
    "table_trim",
    f"WITH {PART_TABLE_SQL} SELECT p_partkey, {_flat_sql('list_transform(data, lambda r: list_transform(r, lambda c: trim(coalesce(c, chr(32)))))')} AS cells FROM ptab",
)
def table_trim(t):
    return part_tables(t).select("p_partkey", _flat(T.trim_cells("data")).alias("cells"))


_MD = """'| ' || array_to_string({r}, ' | ') || ' |'"""


def _markdown_sql(has_header):
    line = _MD.format(r="r")
    head = _MD.format(r="data[1]")
    rule = _MD.format(r="list_transform(data[1], lambda c: '---')")
    body = "data[2:]" if has_header else "data"
    return f"array_to_string(list_concat([{head}, {rule}], list_transform({body}, lambda r: {line})), chr(10))"


@register(
    "table_markdown",
    f"WITH {_CLEAN} SELECT p_partkey, {_markdown_sql(True)} AS with_header, {_markdown_sql(False)} AS without_header FROM clean",
)
def table_markdown(t):
    clean = part_tables(t).select("p_partkey", T.clean_table("data").alias("data"))
    return clean.select(
        "p_partkey",
        T.to_markdown("data").alias("with_header"),
        T.to_markdown("data", has_header=False).alias("without_header"),
    )


_TEXTUAL = "len(list_filter({r}, lambda c: c IS NOT NULL AND c <> '' AND regexp_full_match(c, '[0-9]+'))) = 0"
_FILLED = "len(list_filter({r}, lambda c: c IS NOT NULL AND c <> '')) > 0"


@register(
    "table_header_row",
    f"""WITH {PART_TABLE_SQL}, v AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN data WHEN 1 THEN data[3:] ELSE list_reverse(data) END AS data FROM ptab)
    SELECT p_partkey, CAST(CASE WHEN len(data) < 2 THEN 0 WHEN {_TEXTUAL.format(r='data[1]')} THEN 0
      WHEN {_TEXTUAL.format(r='data[2]')} AND {_FILLED.format(r='data[1]')} THEN 1
      WHEN len(data) >= 3 AND {_TEXTUAL.format(r='data[3]')} AND {_FILLED.format(r='data[2]')} THEN 2 ELSE 0 END AS BIGINT) AS header FROM v""",
)
def table_header_row(t):
    data = (
        F.when(F.col("p_partkey") % 3 == 0, F.col("data"))
        .when(F.col("p_partkey") % 3 == 1, F.slice("data", 3, 2))
        .otherwise(F.reverse("data"))
    )
    return part_tables(t).select("p_partkey", T.header_row(data).cast("bigint").alias("header"))


@register(
    "table_merge_cells",
    f"""WITH {_CLEAN}, m AS (SELECT p_partkey, data, array_to_string(list_filter(list_concat(data[1][1:2], data[2][1:2]), lambda c: c <> ''), ' ') AS merged FROM clean),
    f AS (SELECT p_partkey, list_transform(data, lambda r, i: list_transform(r, lambda c, j: CASE WHEN i = 1 AND j = 1 THEN merged WHEN i <= 2 AND j <= 2 THEN '' ELSE c END)) AS data FROM m)
    SELECT p_partkey, {_flat_sql('data')} AS cells FROM f""",
)
def table_merge_cells(t):
    clean = part_tables(t).select("p_partkey", T.clean_table("data").alias("data"))
    return clean.select("p_partkey", _flat(T.merge_cells("data", 0, 1, 0, 1)).alias("cells"))


_TEXT_TABLE = """src AS (SELECT doc_id, string_split(trim(text, ' ' || chr(10)), chr(10)) AS ls FROM documents),
li AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM src),
ce AS (SELECT doc_id, n, i, regexp_matches(line, '[\\t|]') AS marked,
  list_filter(list_transform(regexp_split_to_array(trim(trim(line, '|')), '[\\t|]'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM li),
st AS (SELECT doc_id, min(i) AS start FROM ce WHERE marked AND len(cells) > 0 GROUP BY 1),
stop AS (SELECT doc_id, min(i) AS stop FROM ce JOIN st USING (doc_id) WHERE i > start AND NOT marked GROUP BY 1),
rows AS (SELECT doc_id, i, cells FROM ce JOIN st USING (doc_id) LEFT JOIN stop USING (doc_id)
  WHERE n >= 2 AND i >= start AND i < coalesce(stop, n + 1) AND marked AND len(cells) > 0),
tab AS (SELECT doc_id, count(*) AS n_rows, string_agg(array_to_string(cells, '|'), '/' ORDER BY i) AS cells FROM rows GROUP BY 1 HAVING count(*) >= 2)"""


@register("table_from_text", f"WITH {_TEXT_TABLE} SELECT doc_id, n_rows, cells FROM tab")
def table_from_text(t):
    found = t.documents.select("doc_id", T.table_from_text("text").alias("rows")).where("rows IS NOT NULL")
    return found.select("doc_id", F.size("rows").cast("bigint").alias("n_rows"), _flat("rows").alias("cells"))


@register(
    "table_jaccard",
    f"""WITH {_CLEAN}, c AS (SELECT p_partkey, list_distinct(list_transform(flatten(clean.data), lambda x: lower(trim(x)))) AS a,
      list_distinct(list_transform(flatten(ptab.data), lambda x: lower(trim(coalesce(x, ''))))) AS b FROM clean JOIN ptab USING (p_partkey)),
    s AS (SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS sim FROM c)
    SELECT p_partkey, round(sim, 6) AS similarity, CASE WHEN sim > 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS table_recall FROM s""",
)
def table_jaccard(t):
    sets = part_tables(t).select(
        "p_partkey", T.cell_set(T.clean_table("data")).alias("a"), T.cell_set("data").alias("b")
    )
    return sets.select(
        "p_partkey",
        F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"),
        table_recall(F.array("a"), F.array("b")).alias("table_recall"),
    )


@register(
    "all_tables",
    f"""WITH {_TEXT_TABLE}, d AS (SELECT doc_id, source FROM documents)
    SELECT source, count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM tab JOIN d USING (doc_id) GROUP BY source""",
)
def all_tables(t):
    """Tables of a collection, counted per source."""
    pages = t.documents.select("source", F.array(T.table_from_text("text")).alias("tables"))
    tables = each(pages, ["source"], "tables", "rows")
    return tables.groupBy("source").agg(
        F.count("*").alias("n_tables"), F.sum(F.size("rows")).cast("bigint").alias("n_rows")
    )


# --- text of whole documents ------------------------------------------------------------------


@register(
    "full_text_markers",
    """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      chr(10) || '--- 第 ' || i || ' 页 ---' || chr(10) || chr(10) || x), chr(10)) AS body FROM documents""",
)
def full_text_markers(t):
    """Documents with one page per line."""
    pages = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("page_num"), F.array(x).alias("texts")))
    return t.documents.select("doc_id", full_text(pages).alias("body"))


@register(
    "markdown_export",
    """WITH l AS (SELECT source, doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents))
    SELECT source, doc_id AS page_num, 0::BIGINT AS ord, '## 第 ' || doc_id || ' 页' || chr(10) AS line FROM documents
    UNION ALL SELECT source, doc_id, 1, '### 文本内容' || chr(10) FROM documents
    UNION ALL SELECT source, doc_id, i + 1, x || chr(10) FROM l
    UNION ALL SELECT DISTINCT source, doc_id, n + 2, '---' || chr(10) FROM l""",
)
def markdown_export(t):
    pages = t.documents.select(
        "source",
        F.col("doc_id").alias("page_num"),
        F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"))).alias("text_blocks"),
        F.array().cast("array<struct<markdown:string,data:array<array<string>>>>").alias("tables"),
    )
    return page_lines(pages).select("source", "page_num", F.col("ord").cast("bigint").alias("ord"), "line")


# --- quality ----------------------------------------------------------------------------------

_BROKEN_SQL = """broken AS (SELECT doc_id, CASE WHEN lang = 'de' THEN translate(text, 'enr', chr(57344) || chr(57345) || chr(65533))
  WHEN lang = 'fr' THEN replace(text, 'euxe', '(cid:12)') WHEN lang = 'es' THEN replace(text, 'a', chr(7)) ELSE text END AS text FROM documents),
sq AS (SELECT doc_id, text, regexp_replace(text, '\\s', '', 'g') AS solid FROM broken)"""


def _broken(t):
    text = (
        F.when(F.col("lang") == "de", F.translate("text", "enr", "\ue000\ue001\ufffd"))
        .when(F.col("lang") == "fr", F.replace("text", F.lit("euxe"), F.lit("(cid:12)")))
        .when(F.col("lang") == "es", F.replace("text", F.lit("a"), F.lit("\x07")))
        .otherwise(F.col("text"))
    )
    return t.documents.select("doc_id", text.alias("text"))


@register(
    "garbled_detect_v2",
    f"""WITH {_BROKEN_SQL}, g AS (SELECT *, len(regexp_extract_all(solid, '[\\x{{E000}}-\\x{{F8FF}}\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) / length(solid) AS share FROM sq)
    SELECT doc_id, round(share, 6) AS share, regexp_matches(text, '\\(cid\\s*:\\s*\\d+\\s*\\)') OR share >= 0.3 AS garbled_page,
      regexp_matches(text, '\\(cid\\s*:\\s*\\d+\\s*\\)') OR share >= 0.5 AS garbled FROM g""",
)
def garbled_detect_v2(t):
    return _broken(t).select(
        "doc_id",
        F.round(Q.garbled_share("text"), 6).alias("share"),
        Q.is_garbled("text", 0.3).alias("garbled_page"),
        Q.is_garbled("text").alias("garbled"),
    )


@register(
    "garbled_detect_v3",
    f"""WITH {_BROKEN_SQL}, g AS (SELECT *, len(regexp_extract_all(solid, '[\\x{{E000}}-\\x{{F8FF}}\\x{{FFFD}}]')) / length(solid) AS share FROM sq)
    SELECT doc_id, round(share, 6) AS share, regexp_matches(text, '\\(cid\\s*:\\s*\\d+\\s*\\)') OR share >= 0.3 AS garbled FROM g""",
)
def garbled_detect_v3(t):
    return _broken(t).select(
        "doc_id",
        F.round(Q.garbled_share("text", basic=True), 6).alias("share"),
        Q.is_garbled_basic("text").alias("garbled"),
    )


_CHARS_SQL = """solid AS (SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'ABCDEF+Song' ELSE 'Arial' END AS font,
  regexp_replace(CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '[A-Za-z0-9]', '', 'g') ELSE html END, '\\s', '', 'g') AS body FROM pages),
counts AS (SELECT page_id, font, length(body) AS n, len(regexp_extract_all(body, '[\\x{2E80}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{AC00}-\\x{D7AF}\\x{3040}-\\x{30FF}]')) AS cjk,
  len(regexp_extract_all(body, '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]')) AS punct FROM solid)"""


def _chars(t):
    font = F.when(F.contains("url", F.lit("/en/")), "ABCDEF+Song").otherwise("Arial")
    body = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "[A-Za-z0-9]", "")).otherwise(F.col("html"))
    return t.pages.select("page_id", "html", font.alias("font"), body.alias("body")).select(
        "page_id",
        "html",
        F.transform(F.split("body", ""), lambda c: F.struct(c.alias("text"), F.col("font").alias("fontname"))).alias("chars"),
    )


@register(
    "font_encoding_issue",
    f"""WITH {_CHARS_SQL} SELECT page_id, n >= 20 AND font = 'ABCDEF+Song' AND cjk / n < 0.05 AND punct / n > 0.4 AS font_issue FROM counts""",
)
def font_encoding_issue(t):
    return _chars(t).select("page_id", Q.font_encoding_issue("chars").alias("font_issue"))


@register(
    "ocr_fallback",
    f"""WITH {_CHARS_SQL}, d AS (SELECT *, n >= 20 AND font = 'ABCDEF+Song' AND cjk / n < 0.05 AND punct / n > 0.4 AS issue FROM counts)
    SELECT page_id, CASE WHEN issue AND page_id % 2 = 0 THEN 'ocr' ELSE 'extracted' END AS origin FROM d""",
)
def ocr_fallback(t):
    """Even pages have OCR blocks, odd pages none."""
    extracted = F.array(F.struct(F.col("html").alias("text"), F.lit("extracted").alias("origin")))
    ocr = F.array(F.struct(F.lit("seen").alias("text"), F.lit("ocr").alias("origin")))
    none = F.slice(ocr, 1, 0)
    recognised = F.when(F.col("page_id") % 2 == 0, ocr).otherwise(none)
    chosen = Q.text_with_ocr(extracted, F.col("chars"), recognised)
    return _chars(t).select("page_id", F.get(chosen, F.lit(0))["origin"].alias("origin"))


@register(
    "visible_chars",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      NOT (l_returnflag = 'A' AND l_discount > 0.05 AND l_tax > 0.03 AND l_linestatus = 'O') AS visible FROM lineitem""",
)
def visible_chars(t):
    char = F.struct(
        F.when(F.col("l_returnflag") == "A", "DeviceGray").otherwise("DeviceRGB").alias("ncs"),
        F.array(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("stroking_color"),
        F.array(F.when(F.col("l_tax") > 0.03, 1).otherwise(0)).alias("non_stroking_color"),
        F.when(F.col("l_linestatus") == "O", "[x").otherwise("9").alias("text"),
    )
    marks = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", char.alias("c"))
    return marks.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", Q.visible_char(F.col("c")).alias("visible"))


@register(
    "file_magic_filter",
    """SELECT page_id, url LIKE 'https%' AND octet_length(encode('%PDF-1.7' || html)) > 10000 AS accepted FROM pages""",
)
def file_magic_filter(t):
    content = F.encode(F.when(F.col("url").startswith("https"), F.concat(F.lit("%PDF-1.7"), "html")).otherwise(F.col("html")), "UTF-8")
    return t.pages.select("page_id", is_valid_pdf(content).alias("accepted"))


@register(
    "cjk_presence",
    f"WITH {FILINGS_SQL} SELECT chunk_id, regexp_matches(query, '[一-鿿]') AS in_query, regexp_matches(revenue, '[一-鿿]') AS in_amount FROM filings",
)
def cjk_presence(t):
    return filings(t).select("chunk_id", has_cjk("query").alias("in_query"), has_cjk("revenue").alias("in_amount"))


def _words(text):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> ''))"


@register(
    "text_prf",
    f"""WITH w AS (SELECT doc_id, {_words("replace(text, ' the ', ' teh ')")} AS a, {_words('text')} AS b FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(b) > 0 AND len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS p,
      CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END AS r FROM w)
    SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""",
)
def text_prf(t):
    """Extraction with a systematic misreading against the true text."""
    read = F.replace("text", F.lit(" the "), F.lit(" teh "))
    sets = t.documents.select("doc_id", word_set(read).alias("a"), word_set("text").alias("b"))
    scored = sets.select("doc_id", text_overlap(F.col("a"), F.col("b")).alias("s")).select("doc_id", "s.*")
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_MISREAD, _UNSPACED = "replace({0}, ' the ', ' teh ')", "replace({0}, ', ', ',')"


def _tables_sql(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda x: list_distinct(list_transform(string_split(x, ' '), lambda y: lower(trim(y)))))"


@register(
    "extraction_compare",
    f"""WITH m AS (SELECT 'misread' AS method, doc_id, {_words(_MISREAD.format('text'))} AS a, {_tables_sql(_MISREAD.format('text'))} AS ta FROM documents
      UNION ALL SELECT 'unspaced', doc_id, {_words(_UNSPACED.format('text'))}, {_tables_sql(_UNSPACED.format('text'))} FROM documents WHERE doc_id % 10 <> 0
      UNION ALL SELECT 'unspaced', doc_id, [], [] FROM documents WHERE doc_id % 10 = 0),
    t AS (SELECT doc_id, {_words('text')} AS b, {_tables_sql('text')} AS tb FROM documents),
    s AS (SELECT method, CASE WHEN len(b) > 0 AND len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS p,
      CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END AS r,
      len(list_filter(tb, lambda w: len(list_filter(ta, lambda e: len(list_intersect(e, w)) / len(list_distinct(list_concat(e, w))) > 0.8)) > 0)) / len(tb) AS tr
      FROM m JOIN t USING (doc_id))
    SELECT method, count(*) AS n_documents, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
      round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(tr), 6) AS table_recall FROM s GROUP BY method""",
)
def extraction_compare(t):
    """Two readings of all documents, one of which lacks some; each line stands for a table of its words."""

    def read(text):
        cells = F.transform(F.split(text, "\n"), lambda x: F.array_distinct(F.transform(F.split(x, " "), lambda y: F.lower(F.trim(y)))))
        return t.documents.select("doc_id", word_set(text).alias("words"), cells.alias("tables"))

    misread = read(F.replace("text", F.lit(" the "), F.lit(" teh ")))
    unspaced = read(F.replace("text", F.lit(", "), F.lit(","))).where("doc_id % 10 <> 0")
    return compare_extractions({"misread": misread, "unspaced": unspaced}, read(F.col("text")))
