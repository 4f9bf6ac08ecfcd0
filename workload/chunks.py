"""Splitting documents into chunks."""

from pyspark.sql import functions as F

from paperloom.functions.extraction import enrich_chunk
from paperloom.functions.titles import is_title, overlap_tail
from paperloom.operators import chunking
from paperloom.operators.evaluation import best_by
from paperloom.operators.rows import each_struct
from paperloom.plans.experiments import chunk_grid, summarise
from paperloom.streaming.ingest import chunk_texts
from workload.base import FILINGS_SQL, Tables, filings, register


def windows_sql(size: int, overlap: int, out: str = "win", minimum: int = 100) -> str:
    """Recursive CTE ``out(doc_id, ord, s, e)``, offsets from zero."""
    marks = ["'。'", "'！'", "'？'", "chr(10)", "'.'", "'!'", "'?'"]
    body = f"substr(text, s + 1, {size})"
    # position of the last mark inside the window, counted from the window start; -1 if absent
    last = [f"(length(w) - strpos(reverse(w), {m}))" for m in marks]
    cases = " ".join(
        f"WHEN strpos(w, {m}) > 0 AND {p} > {minimum} THEN s + {p} + 1" for m, p in zip(marks, last)
    )
    step = f"e - {overlap}"
    return f"""
{out}(doc_id, ord, s, e, n) AS (
  SELECT doc_id, 0, 0, CASE WHEN n <= {size} THEN n {cases} ELSE s + {size} END, n
  FROM (SELECT doc_id, length(text) AS n, 0 AS s, substr(text, 1, {size}) AS w FROM documents) WHERE n > 0
  UNION ALL
  SELECT doc_id, ord, s, CASE WHEN s + {size} >= n THEN n {cases} ELSE s + {size} END, n
  FROM (SELECT {out}.doc_id, ord + 1 AS ord, {step} AS s, {out}.n, substr(text, {step} + 1, {size}) AS w
    FROM {out} JOIN documents USING (doc_id) WHERE e < {out}.n))"""


_PIECES = """pieces AS (SELECT doc_id, ord, regexp_replace(substr(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS text
  FROM win JOIN documents USING (doc_id)),
kept AS (SELECT * FROM pieces WHERE length(text) >= 100 OR ord = 0)"""


@register(
    "chunk_sentence_512_100",
    f"WITH RECURSIVE {windows_sql(512, 100)}, {_PIECES} SELECT doc_id, CAST(ord AS BIGINT) AS ord, text FROM kept",
)
def chunk_sentence(t):
    return chunk_texts(t.documents, "doc_id").select("doc_id", F.col("ord").cast("bigint").alias("ord"), "text")


@register(
    "chunk_stats",
    f"""WITH RECURSIVE {windows_sql(512, 100)}, {_PIECES}
    SELECT lang, count(*) AS total_chunks, round(avg(length(kept.text)), 6) AS avg_chunk_length,
      min(length(kept.text)) AS min_chunk_length, max(length(kept.text)) AS max_chunk_length, 0::BIGINT AS table_chunks
    FROM kept JOIN documents USING (doc_id) GROUP BY lang""",
)
def chunk_stats(t):
    texts = t.documents
    chunks = chunk_texts(texts, "doc_id").join(texts.select("doc_id", "lang"), "doc_id")
    return chunking.chunk_statistics(chunks.withColumn("chunk_type", F.lit("text")), ["lang"])


def _pages(t: Tables):
    """Documents as pages: one block per line, one table from the words of each line."""
    lines = F.split("text", "\n")
    none = F.lit(None).cast("array<double>")
    return t.documents.select(
        F.col("source"),
        F.col("doc_id").alias("page_num"),
        F.transform(
            lines,
            lambda x, i: F.struct(
                x.alias("text"), F.when(i == 0, "header").otherwise("text").alias("block_type")
            ),
        ).alias("text_blocks"),
        F.array(
            F.struct(
                F.transform(lines, lambda x: F.split(x, " ")).alias("data"),
                F.lit(None).cast("string").alias("markdown"),
                none.alias("bbox"),
            )
        ).alias("tables"),
    )


_TABLE_MD = """md AS (SELECT doc_id, source, text, list_transform(string_split(text, chr(10)), lambda x: '| ' || array_to_string(string_split(x, ' '), ' | ') || ' |') AS rows,
  '| ' || array_to_string(list_transform(string_split(string_split(text, chr(10))[1], ' '), lambda x: '---'), ' | ') || ' |' AS rule FROM documents),
marks AS (SELECT doc_id, source, array_to_string(list_concat([rows[1], rule], rows[2:]), chr(10)) AS mark FROM md)"""


@register(
    "chunk_pages",
    f"""WITH RECURSIVE {windows_sql(512, 100)}, {_TABLE_MD},
    pieces AS (SELECT doc_id, ord, regexp_replace(substr(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS text FROM win JOIN documents USING (doc_id)),
    tab AS (SELECT * FROM marks WHERE length(trim(mark)) >= 100),
    kept AS (SELECT doc_id, 'table' AS chunk_type, 0 AS ord, mark AS text FROM tab
      UNION ALL SELECT doc_id, 'text', ord, text FROM pieces
      WHERE length(text) >= 100 OR (ord = 0 AND doc_id NOT IN (SELECT doc_id FROM tab)))
    SELECT source || '#' || doc_id || '#' || chunk_type || '#' || ord AS chunk_id, chunk_type, chunk_type = 'table' AS has_table,
      '[' || source || ' 第' || doc_id || '页] ' || kept.text AS text FROM kept JOIN documents USING (doc_id)""",
)
def chunk_pages(t):
    chunks = chunking.chunk_pages(_pages(t))
    return chunks.select("chunk_id", "chunk_type", "has_table", "text")


def _brief(chunks):
    return chunks.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "text")


@register(
    "chunk_fixed_500",
    """SELECT doc_id, CAST(i AS BIGINT) AS ord, substr(text, i * 500 + 1, 500) AS text
    FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500) AS BIGINT))) AS i FROM documents WHERE length(text) > 50)
    WHERE length(substr(text, i * 500 + 1, 500)) > 50""",
)
def chunk_fixed_500(t):
    return _brief(each_struct(t.documents, ["doc_id"], chunking.fixed_slices("text"), "ord"))


@register(
    "chunk_sliding_512_50",
    """SELECT doc_id, CAST(i AS BIGINT) AS ord, substr(text, i * 462 + 1, 512) AS text
    FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 512) / 462) AS BIGINT), 0) + 1)) AS i FROM documents)
    WHERE trim(substr(text, i * 462 + 1, 512), ' ' || chr(10)) <> ''""",
)
def chunk_sliding(t):
    return _brief(each_struct(t.documents, ["doc_id"], chunking.sliding_slices("text"), "ord"))


# The paragraph packer over lines as paragraphs. Its state is (open_at, open_to) per paragraph.
_PACK = """
para AS (SELECT doc_id, ord, p, length(p) AS n,
    sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY ord) - length(p) - 2 AS s
  FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))),
fold(doc_id, ord, a, b, fa, fb) AS (
  SELECT doc_id, ord, CASE WHEN n > 512 THEN s + n ELSE s END, s + n, NULL::HUGEINT, NULL::HUGEINT FROM para WHERE ord = 1
  UNION ALL
  SELECT doc_id, para.ord,
    CASE WHEN (b - a) + n > 512 THEN CASE WHEN n > 512 THEN s + n ELSE s END WHEN b > a THEN a ELSE s END,
    s + n,
    CASE WHEN (b - a) + n > 512 AND b > a THEN a END, CASE WHEN (b - a) + n > 512 AND b > a THEN b END
  FROM fold JOIN para USING (doc_id) WHERE para.ord = fold.ord + 1),
last AS (SELECT doc_id, max(ord) AS ord FROM para GROUP BY doc_id),
body AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS body FROM documents),
packed AS (
  SELECT doc_id, fa AS s, trim(substr(body, CAST(fa + 1 AS BIGINT), CAST(fb - fa AS BIGINT)), ' ' || chr(10)) AS text FROM fold JOIN body USING (doc_id) WHERE fa IS NOT NULL
  UNION ALL SELECT doc_id, a, trim(substr(body, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), ' ' || chr(10)) FROM fold JOIN last USING (doc_id, ord) JOIN body USING (doc_id) WHERE b > a
  UNION ALL SELECT doc_id, s + i, substr(p, CAST(i + 1 AS BIGINT), 512) FROM (SELECT doc_id, s, p, unnest(range(0, n, 462)) AS i FROM para WHERE n > 512))"""


@register(
    "chunk_table_protect",
    f"""WITH RECURSIVE {_PACK}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ord, text FROM packed""",
)
def chunk_table_protect(t):
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    pages = t.documents.select(
        "source",
        F.col("doc_id").alias("page_num"),
        F.array(F.struct(body.alias("text"), F.lit("text").alias("block_type"))).alias("text_blocks"),
        F.array().cast("array<struct<markdown:string>>").alias("tables"),
    )
    chunks = chunking.protect_tables(pages)
    return chunks.select(F.col("page_num").alias("doc_id"), F.col("ord").cast("bigint").alias("ord"), "text")


_TITLE_REGEX = (
    "^(第[一二三四五六七八九十]+章|第[一二三四五六七八九十]+节|第\\d+章|第\\d+节|\\d+[、.．]|[一二三四五六七八九十]+[、]|[\\(（]\\d+[）\\)]|[1-9]\\d*\\.\\d+)"
)


@register(
    "chunk_title_packing",
    f"""WITH RECURSIVE blocks AS (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: regexp_replace(CASE WHEN i % 5 = 3 THEN i || '、' ELSE '' END || x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ts FROM documents),
    fold AS (
      SELECT doc_id, 0 AS n, '' AS held, CAST([] AS VARCHAR[]) AS done FROM blocks
      UNION ALL
      SELECT doc_id, n + 1,
        CASE WHEN title OR held = '' THEN t
          WHEN length(held) + length(t) > 512 AND length(held) >= 100 THEN
            CASE WHEN length(held) <= 50 THEN held
              WHEN regexp_matches(right(held, 50), '(?s)^.+[。！？.!?][^。！？.!?]*$') THEN regexp_extract(right(held, 50), '(?s)^.+[。！？.!?]([^。！？.!?]*)$', 1)
              ELSE right(held, 50) END || t
          ELSE held || chr(10) || t END,
        CASE WHEN (title OR (held <> '' AND length(held) + length(t) > 512)) AND length(held) >= 100 THEN list_append(done, held) ELSE done END
      FROM (SELECT doc_id, n, held, done, ts[n + 1] AS t, length(ts[n + 1]) <= 100 AND regexp_matches(ts[n + 1], '{_TITLE_REGEX}') AS title
            FROM fold JOIN blocks USING (doc_id) WHERE n < len(ts))),
    whole AS (
      SELECT doc_id, CASE WHEN length(held) >= 100 THEN list_append(done, held) ELSE done END AS texts FROM fold JOIN blocks USING (doc_id) WHERE n = len(ts))
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS ord, regexp_replace(texts[i], '^\\s+|\\s+$', '', 'g') AS text
    FROM (SELECT doc_id, texts, unnest(range(1, len(texts) + 1)) AS i FROM whole)""",
)
def chunk_title_packing(t):
    """Lines as blocks, every fifth with a number in front, which makes the short ones headings."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(F.concat(F.when((i + 1) % 5 == 3, F.concat((i + 1).cast("string"), F.lit("、"))).otherwise(""), x).alias("text")),
    )
    packed = t.documents.select("doc_id", chunking.pack_by_titles(lines).alias("texts"))
    pieces = packed.select("doc_id", F.posexplode_outer("texts").alias("ord", "text")).where("text IS NOT NULL")
    return pieces.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "text")


_GRID_CTES = ",".join(
    windows_sql(size, overlap, f"w{size}_{overlap}", minimum=max(100, overlap))
    for size in (256, 512, 1024)
    for overlap in (50, 100, 200)
)
_GRID_ROWS = " UNION ALL ".join(
    f"SELECT {size}::BIGINT AS chunk_size, {overlap}::BIGINT AS overlap, {max(100, overlap)} AS floor, ord, doc_id, s, e FROM w{size}_{overlap}"
    for size in (256, 512, 1024)
    for overlap in (50, 100, 200)
)
_GRID = f"""WITH RECURSIVE {_GRID_CTES}, grid_rows AS ({_GRID_ROWS}),
sized AS (SELECT chunk_size, overlap, floor, ord, length(regexp_replace(substr(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g')) AS n
  FROM grid_rows JOIN documents USING (doc_id)),
grid AS (SELECT chunk_size, overlap, count(*) AS total_chunks, round(avg(n), 6) AS avg_chunk_length,
  min(n) AS min_chunk_length, max(n) AS max_chunk_length FROM sized WHERE n >= floor OR ord = 0 GROUP BY 1, 2)"""


@register("chunk_grid", f"{_GRID} SELECT * FROM grid")
def chunk_grid_query(t):
    return chunk_grid(t.documents)


@register(
    "chunk_grid_by_size",
    f"""{_GRID} SELECT chunk_size, round(avg(total_chunks), 2) AS total_chunks, round(avg(avg_chunk_length), 2) AS avg_chunk_length,
    round(avg(min_chunk_length), 2) AS min_chunk_length, round(avg(max_chunk_length), 2) AS max_chunk_length FROM grid GROUP BY 1""",
)
def chunk_grid_by_size(t):
    return summarise(chunk_grid(t.documents), "chunk_size")


@register(
    "best_config",
    f"{_GRID} SELECT * FROM grid ORDER BY avg_chunk_length DESC, chunk_size, overlap LIMIT 1",
)
def best_config(t):
    return best_by(chunk_grid(t.documents), "avg_chunk_length", [F.asc("chunk_size"), F.asc("overlap")])


@register(
    "chunk_enrich",
    f"""WITH {FILINGS_SQL}, c AS (SELECT *, string_split(replace(source, '.pdf', ''), '_')[2] AS co FROM filings)
    SELECT chunk_id, co || ' ' || co || ' 【公司：' || co || '】 ' || text || ' 【来源：' || source || ' 页码：' || page_num || '】' AS text FROM c""",
)
def chunk_enrich(t):
    return filings(t).select(
        "chunk_id", enrich_chunk(F.col("text"), F.col("source"), F.col("page_num")).alias("text")
    )


_LINE_SQL = """lines AS (SELECT doc_id, n, CASE n % 7 WHEN 0 THEN '第' || n || '章' WHEN 1 THEN n || '、' WHEN 2 THEN '(' || n || ')'
    WHEN 3 THEN n || '.' || n || ' ' WHEN 4 THEN '一、 ' ELSE '' END || line AS line
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@register(
    "title_detect",
    f"""WITH {_LINE_SQL}, s AS (SELECT doc_id, n, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM lines)
    SELECT doc_id, CAST(n AS BIGINT) AS line_no,
      length(line) <= 100 AND regexp_matches(line, '^(第[一二三四五六七八九十]+章|第[一二三四五六七八九十]+节|第\\d+章|第\\d+节|\\d+[、.．]|[一二三四五六七八九十]+[、]|[\\(（]\\d+[）\\)]|[1-9]\\d*\\.\\d+)') AS chunk_title,
      length(line) <= 100 AND regexp_matches(line, '^(第[一二三四五六七八九十]+[章节]|第\\d+[章节]|\\d+[、.．]\\s*\\S+|[一二三四五六七八九十]+[、]\\s*\\S+|[\\(（]\\d+[）\\)]\\s*\\S+|[1-9]\\d*\\.\\d+\\s+\\S+)') AS layout_title,
      regexp_matches(line, '^(第[一二三四五六七八九十]+章|第\\d+章|\\d+[、.]|[一二三四五六七八九十]+[、]|[\\(（]\\d+[）\\)])') AS page_title
    FROM s""",
)
def title_detect(t):
    n = (F.col("i") + 1).cast("string")
    prefix = (
        F.when((F.col("i") + 1) % 7 == 0, F.concat(F.lit("第"), n, F.lit("章")))
        .when((F.col("i") + 1) % 7 == 1, F.concat(n, F.lit("、")))
        .when((F.col("i") + 1) % 7 == 2, F.concat(F.lit("("), n, F.lit(")")))
        .when((F.col("i") + 1) % 7 == 3, F.concat(n, F.lit("."), n, F.lit(" ")))
        .when((F.col("i") + 1) % 7 == 4, "一、 ")
        .otherwise("")
    )
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    named = lines.select("doc_id", "i", F.concat(prefix, "line").alias("line"))
    return named.select(
        "doc_id",
        (F.col("i") + 1).cast("bigint").alias("line_no"),
        is_title("line", "chunker").alias("chunk_title"),
        is_title("line", "layout").alias("layout_title"),
        is_title("line", "page").alias("page_title"),
    )


@register(
    "overlap_tail",
    """WITH t AS (SELECT doc_id, text, right(text, 100) AS tail FROM documents),
    p AS (SELECT *, list_max(list_transform(['。', '！', '？', '.', '!', '?'], lambda m:
      CASE WHEN strpos(tail, m) > 0 THEN length(tail) - strpos(reverse(tail), m) ELSE -1 END)) AS pos FROM t)
    SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN pos > 0 THEN substr(tail, CAST(pos + 2 AS BIGINT)) ELSE tail END AS tail FROM p""",
)
def overlap_tail_query(t):
    return t.documents.select("doc_id", overlap_tail("text").alias("tail"))
