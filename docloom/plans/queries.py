"""The registered queries over the given tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import dimensions as D
from ..functions import text as T
from ..operators import archive, audit, blocks, cells, checksums, convert, detect, images, layout, markdown, pixels, relations, resample

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WS = T.WS.replace(r"\x0B", r"\v")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '{WS}+', ' ', 'g'))"


_SQL_MAIN = r"""regexp_replace(regexp_replace(
  CASE WHEN regexp_matches(html, '(?s)<main\b[^>]*>.*?</main>') THEN regexp_extract(html, '(?s)<main\b[^>]*>(.*?)</main>', 1) ELSE html END,
  '(?s)<ul class="(?:links|tools)">.*?</ul>', '', 'g'), '(?s)<section class="app[^"]*".*?</section>', '', 'g')"""
_SQL_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


def _sql_duplicates(tags: tuple[str, ...], least: int) -> str:
    each = " UNION ALL ".join(
        rf"SELECT page_id, url, unnest(regexp_extract_all(m, '(?s)<{t}\b[^>]*>(.*?)</{t}>', 1)) AS f FROM (SELECT page_id, url, {_SQL_MAIN} AS m FROM pages)" for t in tags
    )
    return f"""
SELECT fragment, count(*) AS n_pages, min(url) AS first_url, max(url) AS last_url
FROM (SELECT DISTINCT page_id, url, {_sql_clean('f')} AS fragment FROM ({each}))
WHERE length(fragment) >= {least} GROUP BY fragment HAVING count(*) > 1
"""


# ---- pages


@query(_sql_duplicates(("p", "li"), 40))
def duplicate_fragments(spark, sf_dir):
    return audit.duplicate_fragments(table(spark, sf_dir, "pages"))


@query(_sql_duplicates(("h1",), 5))
def duplicate_headings(spark, sf_dir):
    return audit.duplicate_fragments(table(spark, sf_dir, "pages"), ("h1",), 5)


@query(r"""
SELECT page_id, title, length(title) AS title_length, length(title) BETWEEN 15 AND 70 AS length_ok, count(*) OVER (PARTITION BY title) AS n_same
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
""")
def title_quality(spark, sf_dir):
    return audit.title_quality(table(spark, sf_dir, "pages"))


_SQL_VISIBLE = _sql_clean(r"regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g')")


@query(rf"""
SELECT page_id, CASE WHEN v = '' THEN 0 ELSE len(string_split(v, ' ')) END AS n_words,
       len(regexp_extract_all(html, '<h1[\s>]')) AS n_h1, len(regexp_extract_all(html, '<h2[\s>]')) AS n_h2,
       strlen(html) AS n_bytes, strlen(html) < 102400 AS light, len(regexp_extract_all(html, '<p\b')) AS n_p
FROM (SELECT page_id, html, {_SQL_VISIBLE} AS v FROM pages)
""")
def page_facts(spark, sf_dir):
    return audit.page_facts(table(spark, sf_dir, "pages"))


_SQL_LINKS = rf"""
SELECT page_id, path, href,
       CASE WHEN regexp_matches(href, '^(https?:|mailto:|tel:)') THEN 'external' WHEN t NOT LIKE '/%' THEN 'relative' ELSE 'internal' END AS kind,
       t AS target, CASE WHEN contains(href, '#') THEN substr(href, instr(href, '#') + 1) END AS anchor
FROM (SELECT page_id, path, href, CASE WHEN string_split(href, '#')[1] = '' THEN path ELSE string_split(href, '#')[1] END AS t
      FROM (SELECT page_id, {_SQL_PATH} AS path, unnest(regexp_extract_all(html, '<a\b[^>]*\shref="([^"]+)"', 1)) AS href FROM pages))
"""


@query(_SQL_LINKS)
def internal_links(spark, sf_dir):
    return audit.links(table(spark, sf_dir, "pages"))


@query(rf"""
SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM ({_SQL_LINKS})
WHERE kind = 'internal' AND target NOT IN (SELECT {_SQL_PATH} FROM pages) GROUP BY target
""")
def broken_links(spark, sf_dir):
    return audit.broken_links(table(spark, sf_dir, "pages"))


@query(rf"""
SELECT DISTINCT page_id, target, anchor FROM ({_SQL_LINKS}) l
WHERE kind = 'internal' AND anchor <> '' AND target IN (SELECT {_SQL_PATH} FROM pages)
  AND NOT EXISTS (SELECT 1 FROM (SELECT {_SQL_PATH} AS p, unnest(regexp_extract_all(html, '\sid="([^"]+)"', 1)) AS a FROM pages) i WHERE i.p = l.target AND i.a = l.anchor)
""")
def broken_anchors(spark, sf_dir):
    return audit.broken_anchors(table(spark, sf_dir, "pages"))


@query(rf"""
SELECT page_id, {_SQL_PATH} AS path FROM pages
WHERE {_SQL_PATH} NOT IN (SELECT target FROM ({_SQL_LINKS}) WHERE kind = 'internal' AND target <> path)
""")
def orphan_pages(spark, sf_dir):
    return audit.orphan_pages(table(spark, sf_dir, "pages"))


_SQL_REDIRECTS = rf"""
SELECT DISTINCT regexp_replace(p, '/+$', '') AS source, p AS destination FROM (SELECT {_SQL_PATH} AS p FROM pages) WHERE p LIKE '%/' AND p <> '/'
"""


@query(rf"""
WITH r AS ({_SQL_REDIRECTS}), o AS (SELECT DISTINCT * FROM (SELECT {_SQL_PATH} AS source, {_SQL_PATH} || '/' AS destination FROM pages) WHERE source NOT LIKE '%/')
SELECT *, 'left' AS side FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM o)
UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM r)
""")
def redirect_diff(spark, sf_dir):
    """Redirects that pages with an end slash ask for, against what those without would ask for."""
    pages = table(spark, sf_dir, "pages")
    path = audit.page_path(F.col("url"))
    other = pages.where(~path.endswith("/")).select(path.alias("source"), F.concat(path, F.lit("/")).alias("destination")).distinct()
    return audit.set_difference(audit.redirects(pages), other)


@query(r"""
SELECT DISTINCT '<url><loc>' || replace(replace(replace(replace(regexp_replace(url, '#.*$', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</loc></url>' AS entry
FROM pages WHERE NOT contains(html, 'noindex')
""")
def sitemap_rows(spark, sf_dir):
    return audit.sitemap(table(spark, sf_dir, "pages"))


@query(rf"""
SELECT page_id, i AS position, parts[i] AS name, '/' || array_to_string(parts[1:i], '/') AS item
FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT page_id, list_filter(string_split({_SQL_PATH}, '/'), lambda x: x <> '') AS parts FROM pages))
""")
def breadcrumbs(spark, sf_dir):
    return audit.breadcrumbs(table(spark, sf_dir, "pages"))


@query(rf"""
SELECT page_id, '{{"@type":"BreadcrumbList","itemListElement":[' || string_agg('{{"@type":"ListItem","position":' || i || ',"name":"' || parts[i] || '","item":"/' || array_to_string(parts[1:i], '/') || '"}}', ',' ORDER BY i) || ']}}' AS schema
FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT page_id, list_filter(string_split({_SQL_PATH}, '/'), lambda x: x <> '') AS parts FROM pages))
GROUP BY page_id
""")
def breadcrumb_schema(spark, sf_dir):
    return audit.breadcrumb_schema(table(spark, sf_dir, "pages"))


_SQL_TAG = "regexp_matches(tag, '^/?(ul|li|h1|p|div|article|nav|footer)$')"
#: Blocks of pages that hold no other block tags than these, lists in one level, and no quoted ">" in tags.
_SQL_BLOCKS = rf"""
WITH tk AS (
    SELECT doc_id, ts[pos] AS tok, pos, regexp_extract(lower(ts[pos]), '^<(/?[a-z][a-z0-9]*)', 1) AS tag
    FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS pos FROM (
        SELECT page_id AS doc_id, list_filter(regexp_extract_all(
            regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<![a-z][^>]*>', '', 'g'), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>', '', 'g'),
            '(?is)</?[a-z][^>]*>|[^<]+'), lambda t: NOT regexp_matches(t, '(?i)^</?(html|head|body|meta)\b')) AS ts FROM pages))
), st AS (
    SELECT *, last_value(CASE WHEN {_SQL_TAG} THEN tag END IGNORE NULLS) OVER w AS cur, last_value(CASE WHEN {_SQL_TAG} THEN pos END IGNORE NULLS) OVER w AS cur_pos,
           last_value(CASE WHEN tag = 'ul' THEN pos END IGNORE NULLS) OVER w AS ul, sum(CASE tag WHEN 'b' THEN 1 WHEN '/b' THEN -1 ELSE 0 END) OVER w AS run_b,
           lag(tag) OVER w AS was, lead(tag) OVER w AS will
    FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ru AS (
    SELECT doc_id, pos, CASE WHEN cur IN ('h1', 'p', 'li') THEN cur ELSE 'p' END AS kind, CASE WHEN cur IN ('h1', 'p', 'li') THEN cur_pos ELSE pos END AS block, ul,
           cur = 'h1' OR run_b > least(low_b, 0) AS bold,
           CASE WHEN tag = 'br' THEN chr(10) ELSE regexp_replace(replace(replace(replace(replace(replace(replace(tok, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '{WS}+', ' ', 'g') END AS t
    FROM (SELECT *, min(run_b) OVER (PARTITION BY doc_id ORDER BY pos) AS low_b FROM st)
    WHERE (tag = '' OR tag = 'br') AND (cur IN ('h1', 'p', 'li') OR (tag = '' AND was <> '' AND was NOT LIKE '/%' AND was <> 'br' AND will LIKE '/%'))
), bl AS (
    SELECT doc_id, block, kind, min(ul) AS ul, list({{'t': t, 'b': bold}} ORDER BY pos) AS rs FROM ru GROUP BY doc_id, block, kind
), tr AS (
    SELECT doc_id, block, kind, ul, list_filter(list_transform(rs, lambda r, i: {{'t': CASE WHEN i = 1 AND i = len(rs) THEN trim(r.t, ' ' || chr(10)) WHEN i = 1 THEN ltrim(r.t, ' ' || chr(10))
           WHEN i = len(rs) THEN rtrim(r.t, ' ' || chr(10)) ELSE r.t END, 'b': r.b}}), lambda r: r.t <> '') AS rs FROM bl
), nb AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS ord, kind, rs, array_to_string(list_transform(rs, lambda r: r.t), '') AS shown,
           CASE WHEN kind = 'li' THEN row_number() OVER (PARTITION BY doc_id, ul, kind ORDER BY block) END AS idx, lag(kind) OVER d AS was, lead(kind) OVER d AS will
    FROM tr WHERE len(rs) > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY block)
)
"""
_SQL_ESCAPED = "replace(replace(replace(replace(r.t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(_SQL_BLOCKS + """
SELECT doc_id, ord, CASE kind WHEN 'h1' THEN 'h' ELSE kind END AS type, CASE kind WHEN 'h1' THEN 1 END AS level, CASE kind WHEN 'li' THEN false END AS ordered, idx,
       CASE kind WHEN 'li' THEN 0 END AS depth, shown, len(rs) AS n_runs FROM nb
""")
def html_blocks(spark, sf_dir):
    b = blocks.html_blocks(table(spark, sf_dir, "pages"))
    return b.select("doc_id", "ord", "type", "level", "ordered", "idx", "depth", blocks.runs_text(F.col("runs")).alias("shown"), F.size("runs").alias("n_runs"))


@query(_SQL_BLOCKS + """
SELECT doc_id, string_agg(CASE kind WHEN 'h1' THEN '# ' || shown ELSE CASE kind WHEN 'li' THEN '- ' ELSE '' END || array_to_string(list_transform(rs, lambda r:
       CASE WHEN r.b AND trim(r.t, ' ' || chr(10)) <> '' THEN '**' || replace(r.t, chr(10), '  ' || chr(10)) || '**' ELSE replace(r.t, chr(10), '  ' || chr(10)) END), '') END,
       chr(10) || chr(10) ORDER BY ord) || chr(10) AS content
FROM nb GROUP BY doc_id
""")
def html_to_markdown(spark, sf_dir):
    return blocks.render_markdown(blocks.html_blocks(table(spark, sf_dir, "pages")))


@query(_SQL_BLOCKS + "SELECT doc_id, string_agg(CASE kind WHEN 'li' THEN '• ' ELSE '' END || shown, chr(10) || chr(10) ORDER BY ord) || chr(10) AS content FROM nb GROUP BY doc_id")
def html_to_text(spark, sf_dir):
    return blocks.render_text(blocks.html_blocks(table(spark, sf_dir, "pages")))


@query(_SQL_BLOCKS + rf"""
SELECT doc_id, string_agg(CASE WHEN kind = 'li' AND was IS DISTINCT FROM 'li' THEN '<ul>' || chr(10) ELSE '' END || '<' || kind || '>' || array_to_string(list_transform(rs, lambda r:
       CASE WHEN r.b THEN '<strong>' || replace({_SQL_ESCAPED}, chr(10), '<br>') || '</strong>' ELSE replace({_SQL_ESCAPED}, chr(10), '<br>') END), '') || '</' || kind || '>'
       || CASE WHEN kind = 'li' AND will IS DISTINCT FROM 'li' THEN chr(10) || '</ul>' ELSE '' END, chr(10) ORDER BY ord) AS content
FROM nb GROUP BY doc_id
""")
def html_to_html(spark, sf_dir):
    return blocks.render_html(blocks.html_blocks(table(spark, sf_dir, "pages")))


# ---- texts


def _sql_private(name: str, id_col: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {id_col}, '{k}' AS pattern, len(h) AS n_hits, h[1] AS first_hit FROM (SELECT {id_col}, regexp_extract_all(text, '{p}') AS h FROM {name}) WHERE len(h) > 0"
        for k, p in audit.PRIVATE.items()
    )


@query(_sql_private("documents", "doc_id"))
def privacy_pattern_hits(spark, sf_dir):
    return audit.private_hits(table(spark, sf_dir, "documents"), "doc_id")


@query(_sql_private("conversations", "conv_id"))
def privacy_in_conversations(spark, sf_dir):
    return audit.private_hits(table(spark, sf_dir, "conversations"), "conv_id")


def _conversation_texts(spark, sf_dir) -> DataFrame:
    """Each conversation as one document, its turns set apart by blank lines."""
    turns = table(spark, sf_dir, "conversations")
    return cells.gathered(turns, ["conv_id"], "turn", F.col("text"), "\n\n").select(F.col("conv_id").alias("doc_id"), F.col("content").alias("text"))


_SQL_TALKS = "SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"
_SQL_PARTS = rf"""
SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{WS}*\n'), lambda p: regexp_replace(replace(p, chr(12), ''), '^{WS}+|{WS}+$', '', 'g')), lambda p: p <> '') AS ps
FROM ({_SQL_TALKS})
"""


@query(f"SELECT doc_id, i - 1 AS ord, ps[i] AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM ({_SQL_PARTS}))")
def paragraphs(spark, sf_dir):
    return blocks.paragraphs(_conversation_texts(spark, sf_dir))


@query(f"SELECT doc_id, len(ps) AS n, CAST(list_sum(list_transform(ps, lambda p: length(p))) AS BIGINT) AS chars, list_max(list_transform(ps, lambda p: length(p))) AS longest FROM ({_SQL_PARTS}) WHERE len(ps) > 0")
def paragraph_stats(spark, sf_dir):
    p = blocks.paragraphs(_conversation_texts(spark, sf_dir))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


@query(f"SELECT doc_id, array_to_string(ps, chr(10) || chr(10)) || chr(10) AS content FROM ({_SQL_PARTS}) WHERE len(ps) > 0")
def text_render(spark, sf_dir):
    return blocks.render_text(blocks.text_blocks(_conversation_texts(spark, sf_dir)))


@query(rf"""
SELECT doc_id, array_to_string(list_transform(ps, lambda p: '<p>' || replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '<br>') || '</p>'), chr(10)) AS content
FROM ({_SQL_PARTS}) WHERE len(ps) > 0
""")
def html_render(spark, sf_dir):
    return blocks.render_html(blocks.text_blocks(_conversation_texts(spark, sf_dir)))


@query(f"SELECT doc_id, array_to_string(list_transform(ps, lambda p: replace(p, chr(10), '  ' || chr(10))), chr(10) || chr(10)) || chr(10) AS content FROM ({_SQL_PARTS}) WHERE len(ps) > 0")
def markdown_render(spark, sf_dir):
    return blocks.render_markdown(blocks.text_blocks(_conversation_texts(spark, sf_dir)))


_SQL_LINES = r"""
SELECT doc_id, i AS ord, 1000 - 14 * i - CASE WHEN i % 9 = 8 THEN 30 ELSE 0 END + CASE WHEN i % 23 = 22 THEN 500 ELSE 0 END AS y, 14 AS h,
       ls[i + 1] || CASE WHEN i % 5 = 3 THEN 'x-' ELSE '' END AS text
FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
"""


@query(rf"""
WITH l AS (SELECT *, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS t FROM ({_SQL_LINES})),
g AS (SELECT *, lag(t) OVER w AS before, lag(y) OVER w - y AS gap FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
s AS (SELECT *, coalesce(before = '' OR gap > h * 1.7 OR gap < 0, true) AS starts FROM g),
p AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS para FROM s),
x AS (
  SELECT doc_id, para, string_agg(CASE WHEN starts THEN t WHEN regexp_matches(before, '(?i)[а-яёa-z]-$') AND regexp_matches(t, '^[а-яёa-z]') THEN chr(1) || t ELSE ' ' || t END, '' ORDER BY ord) AS text
  FROM p WHERE t <> '' GROUP BY doc_id, para)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY para) AS para, replace(text, '-' || chr(1), '') AS text FROM x
""")
def reflow_lines(spark, sf_dir):
    """Lines of documents, placed as on a page with gaps, column jumps and hyphens, to paragraphs."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    i = F.col("ord")
    y = F.lit(1000) - i * 14 - F.when(i % 9 == 8, 30).otherwise(0) + F.when(i % 23 == 22, 500).otherwise(0)
    return blocks.reflow(line.select("doc_id", "ord", y.alias("y"), F.lit(14).alias("h"), F.concat("text", F.when(i % 5 == 3, "x-").otherwise("")).alias("text")))


@query("SELECT doc_id, substr(sha1(text), 1, 8) AS print FROM documents")
def content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("print"))


_SQL_CRC_TABLE = "(SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n)))"


def _sql_crc(blob: str, table: str = "t") -> str:
    """CRC-32 of bytes, one after the other."""
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


@query(f"SELECT doc_id, {_sql_crc('encode(text)')} AS crc32 FROM documents, {_SQL_CRC_TABLE}")
def crc32_of_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@query(f"""
SELECT source, n_parts, CAST(strlen(whole) AS BIGINT) AS n_bytes, {_sql_crc('encode(whole)')} AS crc32
FROM (SELECT source, count(*) AS n_parts, string_agg(text, '' ORDER BY doc_id) AS whole FROM documents GROUP BY source), {_SQL_CRC_TABLE}
""")
def crc32_of_sources(spark, sf_dir):
    """Documents as the parts of one file a source: its checksum, without putting it together."""
    return checksums.crc32_combined(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text")


def _sql_little(n: str, n_bytes: int) -> str:
    digits = f"right(printf('%016X', CAST({n} AS BIGINT)), {2 * n_bytes})"
    return "(" + " || ".join(f"substr({digits}, {2 * k + 1}, 2)" for k in range(n_bytes - 1, -1, -1)) + ")"


_ZIP_MOST = 1 << 17
_SQL_ZIP_COMMON = " || ".join(("'0008'", "'00000000'", "'2128'", _sql_little("crc", 4), _sql_little("n", 4), _sql_little("n", 4), _sql_little("strlen(name)", 2), "'0000'"))


@query(f"""
WITH f AS (SELECT source, doc_id, 'd' || doc_id || '.txt' AS name, text, CAST(strlen(text) AS BIGINT) AS n, {_sql_crc('encode(text)')} AS crc FROM documents, {_SQL_CRC_TABLE}),
c AS (SELECT *, n + 2 * strlen(name) + 76 AS cost FROM f),
v AS (SELECT *, coalesce(sum(cost) OVER w, 0) // {(_ZIP_MOST - 22) // 2} + 2 * coalesce(sum((cost > {(_ZIP_MOST - 22) // 2})::INT) OVER w, 0) + (cost > {(_ZIP_MOST - 22) // 2})::INT AS volume
      FROM c WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, coalesce(sum(30 + strlen(name) + n) OVER (PARTITION BY source, volume ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM v),
p AS (SELECT source, volume, doc_id, '504B0304' || '1400' || {_SQL_ZIP_COMMON} || hex(encode(name)) || hex(encode(text)) AS head,
             '504B0102' || '1400' || '1400' || {_SQL_ZIP_COMMON} || repeat('00', 10) || {_sql_little('begins', 4)} || hex(encode(name)) AS entry FROM a),
g AS (SELECT source, volume, count(*) AS n_files, string_agg(head, '' ORDER BY doc_id) AS heads, string_agg(entry, '' ORDER BY doc_id) AS entries FROM p GROUP BY source, volume)
SELECT source, CAST(volume AS BIGINT) AS volume, n_files, CAST((length(heads) + length(entries)) // 2 + 22 AS BIGINT) AS n_bytes,
       sha1(unhex(heads || entries || '504B0506' || '00000000' || {_sql_little('n_files', 2)} || {_sql_little('n_files', 2)} || {_sql_little('length(entries) // 2', 4)} || {_sql_little('length(heads) // 2', 4)} || '0000')) AS print
FROM g
""")
def zip_volumes(spark, sf_dir):
    """Documents of each source in archives of at most 128 KiB, and fingerprints of the archives."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    packed = checksums.zip_volumes(d, ["source"], "doc_id", "name", "text", _ZIP_MOST)
    return packed.select("source", "volume", "n_files", "n_bytes", F.sha1("content").alias("print"))


_SQL_SIZE = """CASE WHEN b < 1024 THEN b || ' Б'
  WHEN b < 10240 THEN ((b * 20 + 1024) // 2048) // 10 || ',' || ((b * 20 + 1024) // 2048) % 10 || ' КБ'
  WHEN b < 1048576 THEN (b * 2 + 1024) // 2048 || ' КБ'
  ELSE ((b * 20 + 1048576) // 2097152) // 10 || ',' || ((b * 20 + 1048576) // 2097152) % 10 || ' МБ' END"""


@query(f"""
SELECT doc_id, {_SQL_SIZE.replace('b ', 'n ').replace('(b', '(n')} AS shown, CAST(floor((n / greatest(n_chars, 1) - 1) * 100 + 0.5) AS BIGINT) AS change,
       CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'байт' WHEN n % 10 BETWEEN 2 AND 4 AND (n % 100 < 10 OR n % 100 >= 20) THEN 'байта' ELSE 'байтов' END AS word
FROM (SELECT doc_id, n_chars, strlen(text) * 97 AS n FROM documents)
""")
def human_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.octet_length("text") * 97).cast("long").alias("n"))
    n = F.col("n")
    return d.select(
        "doc_id", T.human_size(n).alias("shown"), T.percent_change(n, F.greatest("n_chars", F.lit(1))).alias("change"), T.plural(n, "байт", "байта", "байтов").alias("word")
    )


_SPECS = ("1-3, 5, 8-", "", "4–6;2", "9-7", "x", "-", "3", "1 - 2", "2-4,3-5")


@query(f"""
WITH s AS (SELECT unnest({list(_SPECS)!r}) AS spec), d AS (SELECT doc_id, n_chars % 12 AS total FROM documents),
p AS (SELECT doc_id, spec, total, list_filter(regexp_split_to_array(spec, '[,;\\s]+'), lambda x: x <> '') AS parts FROM d, s),
b AS (SELECT *, CASE WHEN len(parts) = 0 THEN ['-'] ELSE parts END AS ps FROM p WHERE len(list_filter(parts, lambda x: NOT regexp_matches(x, '^(\\d*[-–]\\d*|\\d+)$'))) = 0),
e AS (SELECT doc_id, spec, total, unnest(ps) AS q FROM b),
r AS (SELECT DISTINCT doc_id, spec, unnest(range(
    greatest(1, CASE WHEN regexp_matches(q, '^\\d+$') THEN q::BIGINT WHEN regexp_extract(q, '^(\\d*)', 1) = '' THEN 1 ELSE regexp_extract(q, '^(\\d*)', 1)::BIGINT END),
    least(total, CASE WHEN regexp_matches(q, '^\\d+$') THEN q::BIGINT WHEN regexp_extract(q, '(\\d*)$', 1) = '' THEN total ELSE regexp_extract(q, '(\\d*)$', 1)::BIGINT END) + 1)) AS page FROM e)
SELECT doc_id, spec, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM r GROUP BY doc_id, spec
""")
def page_range_expand(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 12).alias("total"), F.explode(F.array(*map(F.lit, _SPECS))).alias("spec"))
    pages = d.select("doc_id", "spec", T.page_range(F.col("spec"), F.col("total")).alias("p")).where("p IS NOT NULL")
    return pages.select("doc_id", "spec", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


@query("""
WITH f AS (SELECT doc_id, source, lang || (n_chars % 5) || '.TXT' AS name FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, lower(name) ORDER BY doc_id) AS k FROM f)
SELECT doc_id, source, name, CASE WHEN k = 1 THEN name ELSE regexp_extract(name, '^(.+?)(\\.[^.]*)$', 1) || ' (' || k || ')' || regexp_extract(name, '(\\.[^.]*)$', 1) END AS unique_name FROM n
""")
def unique_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("lang", (F.col("n_chars") % 5).cast("string"), F.lit(".TXT")).alias("name"))
    return relations.unique_names(d, "source", "doc_id", "name")


@query("""
SELECT doc_id, source, name, size,
  CAST(coalesce(sum(30 + strlen(name) + size) OVER w, 0) AS BIGINT) AS local_at, CAST(coalesce(sum(46 + strlen(name)) OVER w, 0) AS BIGINT) AS central_at
FROM (SELECT doc_id, source, 'é' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size FROM documents)
WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def zip_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.concat(F.lit("é"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.octet_length("text").cast("long").alias("size")
    )
    return relations.zip_layout(d, "source", "doc_id", "name", "size")


# ---- tables


@query("""
SELECT c_custkey, c_custkey || ';"Customer ""' || c_name || repeat('"', 3) || ';' || c_nationkey || ';' || c_mktsegment || ',x' AS line FROM customer
""")
def csv_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit('Customer "'), "c_name", F.lit('"'))
    return c.select("c_custkey", cells.csv_line([F.col("c_custkey"), name, F.col("c_nationkey"), F.concat("c_mktsegment", F.lit(",x"))]).alias("line"))


@query("SELECT source, doc_id, CAST(3 AS INT) AS n_cells, len(string_split(text, chr(10))) AS n_lines, sha1(text) AS print FROM documents")
def csv_records(spark, sf_dir):
    """Documents as lines of one CSV file a source, and the records found in them again."""
    d = table(spark, sf_dir, "documents")
    line = cells.csv_line([F.col("doc_id"), F.lit('a;"b"'), F.col("text")])
    lines = d.select(F.col("source"), "doc_id", F.posexplode(F.split(line, "\n")).alias("k", "line"))
    found = cells.csv_records(lines.select("source", (F.col("doc_id") * (1 << 30) + F.col("k")).alias("at"), "line"), ["source"], "at", 1000 << 30)  # a thousand documents
    c = found.withColumn("cells", cells.csv_values(F.col("record"), ";"))
    return c.select("source", F.get("cells", F.lit(0)).cast("long").alias("doc_id"), F.size("cells").alias("n_cells"), "n_lines", F.sha1(F.get("cells", F.lit(2))).alias("print"))


@query("""
SELECT p_partkey, '{"key": "' || p_partkey || '", "name": "' || replace(p_name, '"', '\\"') || '", "brand": "' || p_brand || '"}' AS row FROM part
""")
def json_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", cells.json_row({"key": F.col("p_partkey"), "name": F.col("p_name"), "brand": F.col("p_brand")}).alias("row"))


@query("""
SELECT r_name, c_custkey // 1000 AS part, '<table>' || string_agg('<tr><td>' || c_custkey || '</td><td>' || c_name || '</td></tr>', '' ORDER BY c_custkey) || '</table>' AS content
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def html_table(spark, sf_dir):
    rows = _customers_by_region(spark, sf_dir)
    return cells.gathered(rows, ["r_name", "part"], "c_custkey", cells.html_row([F.col("c_custkey"), F.col("c_name")]), "", "<table>", "</table>")


@query("""
SELECT r_name, c_custkey // 1000 AS part, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' |', chr(10) ORDER BY c_custkey) AS content
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def markdown_table(spark, sf_dir):
    rows = _customers_by_region(spark, sf_dir)
    head = "| key | name |\n| --- | --- |\n"
    return cells.gathered(rows, ["r_name", "part"], "c_custkey", cells.markdown_row([F.col("c_custkey"), F.col("c_name")]), "\n", head)


def _customers_by_region(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "r_name", cells.part(F.col("c_custkey")).alias("part"), "c_custkey", "c_name"
    )


_SQL_LINE = "CASE p_partkey % 4 WHEN 0 THEN p_name || ';' || p_brand || ';' || p_size WHEN 1 THEN p_name || ',' || p_brand WHEN 2 THEN p_name || chr(9) || p_brand || ',' ELSE p_name || ';' || p_brand || ',' END"


@query(f"""
SELECT p_partkey, CASE WHEN len(l) - len(replace(l, ';', '')) > len(l) - len(replace(l, ',', '')) THEN ';' WHEN contains(l, chr(9)) THEN chr(9) ELSE ',' END AS sep
FROM (SELECT p_partkey, {_SQL_LINE} AS l FROM part)
""")
def delimiter_sniff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    line = (
        F.when(k == 0, F.concat_ws(";", "p_name", "p_brand", F.col("p_size").cast("string"))).when(k == 1, F.concat_ws(",", "p_name", "p_brand"))
        .when(k == 2, F.concat("p_name", F.lit("\t"), "p_brand", F.lit(","))).otherwise(F.concat("p_name", F.lit(";"), "p_brand", F.lit(",")))
    )
    return p.select("p_partkey", cells.delimiter(line).alias("sep"))


@query("""
SELECT event_id, i - 1 AS pos, ks[i] AS key, json_extract_string(props, '$."' || ks[i] || '"') AS value
FROM (SELECT event_id, props, ks, unnest(range(1, len(ks) + 1)) AS i FROM (SELECT event_id, props, json_keys(props) AS ks FROM events))
""")
def json_field_order(spark, sf_dir):
    return cells.json_fields(table(spark, sf_dir, "events"), "event_id", "props")


_SQL_FILES = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '%PDF-1.7 ' || text WHEN 1 THEN 'PK' || chr(3) || chr(4) || ' word/ ' || text WHEN 2 THEN 'PK' || chr(3) || chr(4) || ' xl/ ' || text
    WHEN 3 THEN 'PK ' || text ELSE text END AS body,
  CASE doc_id % 11 WHEN 0 THEN 'a.log' WHEN 1 THEN 'b.MD' WHEN 2 THEN 'c.htm' WHEN 3 THEN 'd.tsv' WHEN 4 THEN 'e.json' WHEN 5 THEN 'noext' WHEN 6 THEN 'f.ods' ELSE 'g.txt' END AS name FROM documents
"""
_SQL_KIND = """
SELECT doc_id, CASE WHEN starts_with(body, '%PDF') THEN 'pdf'
  WHEN starts_with(body, 'PK') THEN CASE WHEN name LIKE '%.ods' THEN 'ods' WHEN contains(body[1:60000], 'word/') THEN 'docx' WHEN contains(body[1:60000], 'xl/') THEN 'xlsx' END
  WHEN name LIKE '%.log' OR name LIKE '%.txt' THEN 'txt' WHEN name LIKE '%.MD' THEN 'md' WHEN name LIKE '%.htm' THEN 'html' WHEN name LIKE '%.tsv' THEN 'csv' WHEN name LIKE '%.json' THEN 'json' END AS kind
FROM (""" + _SQL_FILES + ")"


def _kinds(spark, sf_dir) -> DataFrame:
    """Documents as files with some headers and names of other kinds."""
    k, m = F.col("doc_id") % 7, F.col("doc_id") % 11
    pk = "PK\x03\x04"
    body = (
        F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "text")).when(k == 1, F.concat(F.lit(pk + " word/ "), "text"))
        .when(k == 2, F.concat(F.lit(pk + " xl/ "), "text")).when(k == 3, F.concat(F.lit("PK "), "text")).otherwise(F.col("text"))
    )
    names = ("a.log", "b.MD", "c.htm", "d.tsv", "e.json", "noext", "f.ods")
    name = F.coalesce(*(F.when(m == i, F.lit(n)) for i, n in enumerate(names)), F.lit("g.txt"))
    return table(spark, sf_dir, "documents").select("doc_id", detect.document_kind(body.cast("binary"), name).alias("kind"))


@query(_SQL_KIND)
def kind_detect(spark, sf_dir):
    return _kinds(spark, sf_dir)


_SQL_ABLE = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{t}' AS target" for k, ts in D.CAPABILITY.items() for t in ts)


@query(f"""
SELECT doc_id, d.kind, d.target, CASE WHEN d.kind IS NULL THEN 'unknown kind' WHEN a.kind IS NULL THEN 'no such conversion' END AS error,
       CASE WHEN a.kind IS NULL THEN 'error' ELSE 'ready' END AS status
FROM (SELECT doc_id, kind, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' ELSE 'md' END AS target FROM ({_SQL_KIND})) d
LEFT JOIN ({_SQL_ABLE}) a ON a.kind = d.kind AND a.target = d.target
""")
def capability_check(spark, sf_dir):
    target = F.when(F.col("doc_id") % 3 == 0, "pdf").when(F.col("doc_id") % 3 == 1, "html").otherwise("md")
    return detect.gate(_kinds(spark, sf_dir).withColumn("target", target)).select("doc_id", "kind", "target", "error", "status")


_MODES = ("none", "percent", "width", "height", "fit", "exact", "cover", "pad")
_SQL_W = "CAST(p_size * 37 AS DOUBLE)"


@query(f"""
WITH s AS (SELECT p_partkey, {_SQL_W} AS w, CAST(p_size * 11 + 3 AS DOUBLE) AS h, CAST(p_partkey % 700 AS DOUBLE) AS pw, CAST(p_partkey % 300 + 1 AS DOUBLE) AS ph, CAST(p_partkey % 250 AS DOUBLE) AS pc,
  unnest({list(_MODES)!r}) AS mode FROM part),
r AS (SELECT *, CASE mode WHEN 'percent' THEN w * pc / 100 WHEN 'width' THEN pw WHEN 'height' THEN w * ph / h WHEN 'fit' THEN w * least(pw / w, ph / h) WHEN 'none' THEN w ELSE pw END AS rw,
  CASE mode WHEN 'percent' THEN h * pc / 100 WHEN 'width' THEN h * pw / w WHEN 'height' THEN ph WHEN 'fit' THEN h * least(pw / w, ph / h) WHEN 'none' THEN h ELSE ph END AS rh FROM s)
SELECT p_partkey, mode, CAST(least(16384, greatest(1, floor(CASE WHEN rw = 0 THEN w ELSE rw END + 0.5))) AS INT) AS width,
  CAST(least(16384, greatest(1, floor(CASE WHEN rh = 0 THEN h ELSE rh END + 0.5))) AS INT) AS height FROM r
""")
def compute_size_modes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, _MODES))).alias("mode"))
    k = F.col("p_partkey")
    size = T.fitted_size(F.col("p_size") * 37, F.col("p_size") * 11 + 3, F.col("mode"), k % 700, k % 300 + 1, k % 250)
    return p.select("p_partkey", "mode", size.alias("s")).select("p_partkey", "mode", "s.width", "s.height")


def _sql_rules() -> str:
    checks = []
    for rule, formats, min_w, min_h, max_w, max_h, rw, rh, most in D.RULES:
        parts = [f"CASE WHEN NOT list_contains(string_split('{formats}', ','), format) THEN 'format ' || format END"]
        for op, word, side, limit in (("<", "width below", "width", min_w), ("<", "height below", "height", min_h), (">", "width above", "width", max_w), (">", "height above", "height", max_h)):
            if limit is not None:
                parts.append(f"CASE WHEN {side} {op} {limit} THEN '{word} {limit}' END")
        parts.append(f"CASE WHEN abs(width * {rh} - height * {rw}) * 100 > height * {rh} THEN 'ratio is not {rw}:{rh}' END")
        if most is not None:
            parts.append(f"CASE WHEN n_bytes > {most} THEN 'weight above {most // 1000} КБ' END")
        checks.append(f"SELECT image_id, '{rule}' AS rule, array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ', ') AS reasons FROM i")
    return " UNION ALL ".join(checks)


@query(f"""
WITH i AS (SELECT p_partkey AS image_id, CASE p_partkey % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'gif' END AS format, p_size * 30 AS width, p_size * 40 + p_partkey % 5 AS height,
  CAST(p_partkey * 977 AS BIGINT) AS n_bytes FROM part)
SELECT image_id, rule, reasons, reasons = '' AS ok FROM ({_sql_rules()})
""")
def requirement_check(spark, sf_dir):
    k = F.col("p_partkey")
    images = table(spark, sf_dir, "part").select(
        k.alias("image_id"), F.when(k % 3 == 0, "jpeg").when(k % 3 == 1, "png").otherwise("gif").alias("format"),
        (F.col("p_size") * 30).alias("width"), (F.col("p_size") * 40 + k % 5).alias("height"), (k * 977).alias("n_bytes"),
    )
    return relations.requirement_check(images, spark)


# ---- pixels: line items as the pixels of orders


def _pixels(spark, sf_dir) -> DataFrame:
    v, k = (F.col("l_extendedprice") * 100).cast("long"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("image_id"), (v % 256).cast("int").alias("r"), (k % 256).cast("int").alias("g"),
        ((v + k) % 256).cast("int").alias("b"), F.when(k % 9 == 0, 0).otherwise(255).alias("a"),
    )


_SQL_PIXELS = """SELECT l_orderkey % 50 AS image_id, CAST(v % 256 AS INT) AS r, CAST(k % 256 AS INT) AS g, CAST((v + k) % 256 AS INT) AS b, CASE WHEN k % 9 = 0 THEN 0 ELSE 255 END AS a
FROM (SELECT l_orderkey, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS v, l_partkey AS k FROM lineitem)"""
_SQL_HIST = f"SELECT image_id, ((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS color, count(*) AS n FROM ({_SQL_PIXELS}) WHERE a >= 128 GROUP BY ALL"
_SQL_RGB = ", ".join(f"((((color >> {s}) & 31) << 3) | (((color >> {s}) & 31) >> 2)) AS {c}" for c, s in (("r", 10), ("g", 5), ("b", 0)))


@query(_SQL_HIST)
def rgb_histogram(spark, sf_dir):
    return pixels.histogram(_pixels(spark, sf_dir))


@query(f"""
SELECT image_id, color // 4096 AS box, {', '.join(f'CAST(floor(sum({c} * n) / sum(n) + 0.5) AS INT) AS {c}' for c in 'rgb')}, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT *, {_SQL_RGB} FROM ({_SQL_HIST})) GROUP BY image_id, color // 4096
""")
def palette_means(spark, sf_dir):
    hist = pixels.histogram(_pixels(spark, sf_dir))
    return pixels.palette(hist.withColumn("box", F.floor(F.col("color") / 4096).cast("int")))


_SQL_CUT = f"""
WITH RECURSIVE s AS (
    SELECT 1 AS boxes, image_id, '' AS box, color::BIGINT AS pos, color, n FROM ({_SQL_HIST})
    UNION ALL
    SELECT boxes + 1, image_id, box || CASE WHEN NOT chosen THEN '' WHEN r > least(cut, n_colors - 1) THEN '1' ELSE '0' END, CASE WHEN chosen THEN r ELSE pos END, color, n
    FROM (SELECT *, sum((low * 2 < pop)::INT) OVER (PARTITION BY image_id, box) AS cut FROM (
        SELECT *, row_number() OVER (PARTITION BY image_id, box ORDER BY v, pos) AS r,
               coalesce(sum(n) OVER (PARTITION BY image_id, box ORDER BY v, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low
        FROM (SELECT *, score > 0 AND box = first_value(box) OVER (PARTITION BY image_id ORDER BY score DESC, box) AS chosen,
                     CASE WHEN r_span >= g_span AND r_span >= b_span THEN color >> 10 WHEN g_span >= b_span THEN (color >> 5) & 31 ELSE color & 31 END AS v
              FROM (SELECT *, greatest(r_span, g_span, b_span) * sqrt(pop) AS score FROM (
                  SELECT *, max(color >> 10) OVER b - min(color >> 10) OVER b AS r_span, max((color >> 5) & 31) OVER b - min((color >> 5) & 31) OVER b AS g_span,
                         max(color & 31) OVER b - min(color & 31) OVER b AS b_span, sum(n) OVER b AS pop, count(*) OVER b AS n_colors
                  FROM s WHERE boxes < 15 WINDOW b AS (PARTITION BY image_id, box))))))
)
"""


@query(_SQL_CUT + f"""
SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY box) AS idx, r, g, b, n FROM (
    SELECT image_id, box, {', '.join(f'CAST(floor(sum({c} * n) / sum(n) + 0.5) AS INT) AS {c}' for c in 'rgb')}, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT *, {_SQL_RGB} FROM s WHERE boxes = 15) GROUP BY image_id, box)
""")
def median_cut_palette(spark, sf_dir):
    """Sixteen colours an image, the first of them for its transparent pixels."""
    return pixels.median_cut(_pixels(spark, sf_dir), 16)


_SQL_ENTRIES = "SELECT p_partkey AS idx, p_size * 5 AS pr, p_partkey * 29 % 256 AS pg, p_partkey * 53 % 256 AS pb FROM part WHERE p_partkey <= 64"


@query(f"""
SELECT image_id, color, arg_min(idx, d * 1000 + idx) AS idx, CAST(min(d) AS BIGINT) AS distance
FROM (SELECT image_id, color, idx, 2 * (r - pr) * (r - pr) + 4 * (g - pg) * (g - pg) + 3 * (b - pb) * (b - pb) AS d FROM (SELECT *, {_SQL_RGB} FROM ({_SQL_HIST})), ({_SQL_ENTRIES}))
GROUP BY image_id, color
""")
def nearest_palette(spark, sf_dir):
    k = F.col("p_partkey")
    entries = table(spark, sf_dir, "part").where(k <= 64).select(k.alias("idx"), (F.col("p_size") * 5).alias("pr"), (k * 29 % 256).alias("pg"), (k * 53 % 256).alias("pb"))
    return pixels.nearest(pixels.histogram(_pixels(spark, sf_dir)), entries)


@query(f"SELECT image_id, (r * 299 + g * 587 + b * 114 + 500) // 1000 AS luma, count(*) AS n, CAST(sum((a * r + (255 - a) * 200) * 2 // 510 + CASE WHEN (a * r + (255 - a) * 200) * 2 % 510 >= 255 THEN 1 ELSE 0 END) AS BIGINT) AS flat FROM ({_SQL_PIXELS}) GROUP BY ALL")
def luma(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    y = pixels.luma(F.col("r"), F.col("g"), F.col("b"))
    return p.groupBy("image_id", y.alias("luma")).agg(F.count(F.lit(1)).alias("n"), F.sum(pixels.flattened(F.col("r"), F.col("a"), F.lit(200))).alias("flat"))


# ---- lookups and totals


def _parts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.array(k + 3, k * 2, k - 1, k + 100_000_000).alias("related"))


_SQL_RELATED = "SELECT p_partkey, i - 1 AS pos, rel[i] AS related FROM (SELECT p_partkey, rel, unnest(range(1, 5)) AS i FROM (SELECT p_partkey, [p_partkey + 3, p_partkey * 2, p_partkey - 1, p_partkey + 100000000] AS rel FROM part)) WHERE rel[i] IN (SELECT p_partkey FROM part)"


@query(_SQL_RELATED)
def related_items(spark, sf_dir):
    return relations.related_items(_parts(spark, sf_dir), "p_partkey", "related")


@query(f"""
WITH rel AS ({_SQL_RELATED}), one AS (SELECT * FROM rel WHERE pos = 1),
every AS (SELECT p_partkey, 0 AS tier, pos AS key, related FROM one
  UNION ALL SELECT a.p_partkey, 1, b.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
  WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.p_partkey = a.p_partkey AND o.related = b.p_partkey))
SELECT p_partkey, place, related FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, key) AS place FROM every) WHERE place <= 4
""")
def related_fill_top4(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    related = relations.related_items(parts, "p_partkey", "related").where("pos = 1")
    return relations.filled_related(parts, related, "p_partkey", "p_brand")


@query("SELECT n_name, count(s_suppkey) AS n_members, CAST(min(s_suppkey) AS BIGINT) AS first_member FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def group_members(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n_members"), F.min("s_suppkey").alias("first_member"))


_SQL_FORMATS = " UNION ALL ".join(f"SELECT '{i}' AS id, '{label}' AS label, {str(ok).lower()} AS supported" for i, label, *_, ok in D.FORMATS)


@query(f"""
SELECT event_id, coalesce(label, '—') AS label, coalesce(supported, false) AS supported
FROM (SELECT event_id, ['png', 'webp', 'heic', 'gif'][event_id % 4 + 1] AS id FROM events) LEFT JOIN ({_SQL_FORMATS}) USING (id)
""")
def reference_left_join(spark, sf_dir):
    ids = F.array(*map(F.lit, ("png", "webp", "heic", "gif")))
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(ids, (F.col("event_id") % 4 + 1).cast("int")).alias("id"))
    return e.join(F.broadcast(D.formats(spark)), "id", "left").select("event_id", F.coalesce("label", F.lit("—")).alias("label"), F.coalesce("supported", F.lit(False)).alias("supported"))


_SQL_DONE = "event_type IN ('purchase', 'click')"


@query(f"""
SELECT user_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS total, CAST(sum(CASE WHEN {_SQL_DONE} THEN s ELSE 0 END) AS BIGINT) AS total_done, bool_and({_SQL_DONE}) AS all_done, bool_or({_SQL_DONE}) AS any_done
FROM (SELECT user_id, event_type, CAST(strlen(props) AS BIGINT) AS s FROM events) GROUP BY user_id
""")
def queue_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.octet_length("props").cast("long").alias("s"))
    return relations.totals(e, ["user_id"], "s", F.col("event_type").isin("purchase", "click"))


# ---- files made of rows, and read back


def _images(spark, sf_dir) -> DataFrame:
    """Texts as images eight pixels wide, four bytes of text a pixel."""
    size = F.floor(F.octet_length("text") / 32).cast("int")
    d = table(spark, sf_dir, "documents").where("octet_length(text) >= 32")
    return d.select("doc_id", F.lit(8).alias("width"), size.alias("height"), F.substring(F.col("text").cast("binary"), F.lit(1), size * 32).alias("rgba"))


_ROUND = {"png": "PNG", "tga": "TGA"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{fmt}' AS fmt, '{label}' AS label, 'done' AS status, true AS same FROM documents WHERE strlen(text) >= 32" for fmt, label in _ROUND.items()))
def image_roundtrip(spark, sf_dir):
    """Lossless formats: written, detected by content, read, and compared byte by byte."""
    out = None
    for fmt in _ROUND:
        written = images.encode(_images(spark, sf_dir), fmt).drop("status", "error")
        files = written.withColumn("label", detect.image_label(F.col("content"), F.lit(f"x.{fmt}"))).withColumnsRenamed({"width": "w", "height": "h", "rgba": "before"})
        got = images.decode(files).select("doc_id", F.lit(fmt).alias("fmt"), "label", "status", ((F.col("rgba") == F.col("before")) & (F.col("w") == F.col("width"))).alias("same"))
        out = got if out is None else out.unionByName(got)
    return out


def _sql_scaled(to_w: str, to_h: str) -> str:
    """Pixels (doc_id, tw, th, y, x, r, g, b, a) of the images of _images at another size."""
    bits = ", ".join(f"(p >> {s}) & 255 AS {c}" for c, s in zip("rgba", (24, 16, 8, 0)))
    sums = ", ".join(f"CAST(sum(wy * wx * a * {c}) AS BIGINT) AS s{c}" for c in "rgb")
    return f"""
SELECT doc_id, tw, th, y, x, {', '.join(f'CASE WHEN sa = 0 THEN 0 ELSE (2 * s{c} + sa) // (2 * sa) END AS {c}' for c in 'rgb')}, (2 * sa + w * h) // (2 * w * h) AS a FROM (
    SELECT doc_id, tw, th, w, h, ty AS y, tx AS x, {sums}, CAST(sum(wy * wx * a) AS BIGINT) AS sa
    FROM (SELECT *, least((y + 1) * th, (ty + 1) * h) - greatest(y * th, ty * h) AS wy, least((x + 1) * tw, (tx + 1) * w) - greatest(x * tw, tx * w) AS wx
          FROM (SELECT *, unnest(range(x * tw // w, ((x + 1) * tw - 1) // w + 1)) AS tx
                FROM (SELECT *, unnest(range(y * th // h, ((y + 1) * th - 1) // h + 1)) AS ty
                      FROM (SELECT doc_id, w, h, tw, th, (i - 1) // w AS y, (i - 1) % w AS x, {bits}
                            FROM (SELECT *, CAST('0x' || ps[i] AS BIGINT) AS p FROM (SELECT *, unnest(range(1, w * h + 1)) AS i
                                  FROM (SELECT *, {to_w} AS tw, {to_h} AS th FROM (SELECT doc_id, 8::BIGINT AS w, CAST(strlen(text) // 32 AS BIGINT) AS h,
                                        regexp_extract_all(hex(encode(text)), '.{{8}}') AS ps FROM documents WHERE strlen(text) >= 32))))))))
    GROUP BY doc_id, tw, th, w, h, ty, tx)
"""


_SQL_FIT = ("greatest(1, CAST(floor(8 * least(4 / 8, 16 / h) + 0.5) AS BIGINT))", "greatest(1, CAST(floor(h * least(4 / 8, 16 / h) + 0.5) AS BIGINT))")


@query(f"""
SELECT doc_id, CAST(tw AS INT) AS width, CAST(th AS INT) AS height,
       sha1(unhex(hex('P6' || chr(10) || tw || ' ' || th || chr(10) || '255' || chr(10)) || string_agg({' || '.join(f"printf('%02X', (2 * (a * {c} + (255 - a) * 255) + 255) // 510)" for c in 'rgb')}, '' ORDER BY y, x))) AS print
FROM ({_sql_scaled(*_SQL_FIT)}) GROUP BY doc_id, tw, th
""")
def image_thumbnails(spark, sf_dir):
    """Images fitted into 4 x 16 pixels and written as PPM: size and fingerprint."""
    size = T.fitted_size(F.col("width"), F.col("height"), F.lit("fit"), F.lit(4), F.lit(16), F.lit(100))
    small = resample.scaled(resample.pixel_rows(_images(spark, sf_dir), "doc_id"), size["width"], size["height"])
    return resample.ppm(small).select(F.col("image_id").alias("doc_id"), "width", "height", F.sha1("content").alias("print"))


_SQL_WITHIN = ("CASE WHEN h <= 8 THEN 6 ELSE greatest(1, (2 * 8 * 6 + h) // (2 * h)) END", "CASE WHEN h <= 8 THEN greatest(1, (2 * h * 6 + 8) // 16) ELSE 6 END")


@query(f"""
WITH s AS (SELECT doc_id, y + (6 - th) // 2 AS y, x + (6 - tw) // 2 AS x, r, g, b, a FROM ({_sql_scaled(*_SQL_WITHIN)}))
SELECT i.doc_id, CAST(k % 6 AS INT) AS y, CAST(k // 6 AS INT) AS x, {', '.join(f'CAST(coalesce(s.{c}, 0) AS INT) AS {c}' for c in 'rgba')}
FROM (SELECT doc_id, unnest(range(36)) AS k FROM documents WHERE strlen(text) >= 32) i LEFT JOIN s ON s.doc_id = i.doc_id AND s.y = 5 - k // 6 AND s.x = k % 6
""")
def image_squares(spark, sf_dir):
    """Images in the middle of transparent squares of six pixels, turned clockwise by a quarter."""
    square = resample.fitted(resample.pixel_rows(_images(spark, sf_dir), "doc_id"), 6, 6)
    return resample.turned(square, 1).select(F.col("image_id").alias("doc_id"), "y", "x", *"rgba")


@query("""
SELECT source, doc_id // 1000 AS volume, 'd' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, sha1(text) AS print FROM documents
""")
def zip_roundtrip(spark, sf_dir):
    """Documents packed by source and listed again."""
    d = table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("pos"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("unique_name"), F.col("text").cast("binary").alias("content")
    )
    packed = archive.pack_zip(d, ["source"]).withColumn("file_id", F.xxhash64("source", "volume"))
    listed = archive.unzip(packed.select("file_id", "content")).select("file_id", "name", "size", F.sha1("content").alias("print"))
    return listed.join(packed.select("file_id", "source", "volume"), "file_id").select("source", "volume", "name", "size", "print")


@query(f"SELECT doc_id, i - 1 AS ord, ps[i] AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM ({_SQL_PARTS}))")
def docx_roundtrip(spark, sf_dir):
    """Conversations as DOCX, and their paragraphs read back."""
    written = archive.write_docx(blocks.text_blocks(_conversation_texts(spark, sf_dir)))
    return archive.docx_paragraphs(written, "doc_id").select("doc_id", "ord", "text")


@query("""
SELECT CAST(n_nationkey + 100 * (c_custkey // 1000) AS BIGINT) AS file_id, CAST(row_number() OVER (PARTITION BY n_nationkey, c_custkey // 1000 ORDER BY c_custkey) - 1 AS INT) AS row_ord,
       c_custkey || '|' || c_name || '|' || c_mktsegment AS cells FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def xlsx_roundtrip(spark, sf_dir):
    """Customers as workbooks by nation and thousand, and their rows read back."""
    c = table(spark, sf_dir, "customer")
    cells_ = c.select((F.col("c_nationkey") + 100 * cells.part(F.col("c_custkey"))).alias("file_id"), F.col("c_custkey").alias("row_ord"), F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("cells"))
    back = archive.xlsx_cells(archive.write_xlsx(cells_))
    return back.select("file_id", "row_ord", F.array_join("cells", "|").alias("cells"))


# ---- conversion between kinds


def _marked(spark, sf_dir) -> DataFrame:
    """Documents as Markdown: the first line a heading, lines of some places items, bold or in a fence."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    i = F.col("i")
    shown = F.when(i == 0, F.concat(F.lit("# "), "t")).when(i % 4 == 1, F.concat(F.lit("- "), "t")).when(i % 4 == 2, F.concat(F.lit("**"), F.replace("t", F.lit("*"), F.lit("")), F.lit("**"))).otherwise(F.col("t"))
    return cells.gathered(line, ["doc_id"], "i", shown, "\n\n").withColumnRenamed("content", "text")


@query()
def markdown_blocks(spark, sf_dir):
    b = markdown.markdown_blocks(_marked(spark, sf_dir))
    return b.select("doc_id", "ord", "type", "level", blocks.runs_text(F.col("runs")).alias("shown"), F.size("runs").alias("n_runs"))


@query()
def convert_to_text(spark, sf_dir):
    """Documents as text, Markdown and HTML files, all turned into HTML; others are refused by the gate."""
    k = F.col("doc_id") % 4
    name = F.concat(F.col("doc_id").cast("string"), F.when(k == 0, ".txt").when(k == 1, ".md").when(k == 2, ".htm").otherwise(".bin"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), name.alias("name"), F.col("text").cast("binary").alias("content"))
    out = convert.convert(files, "html")
    return out.select("file_id", "out_name", "status", "error", F.sha1("content").alias("print"))


@query("""
SELECT event_id AS file_id, 0 AS row_ord, i - 1 AS pos, ks[i] AS key, coalesce(json_extract_string(props, '$."' || ks[i] || '"'), '') AS value
FROM (SELECT event_id, props, ks, unnest(range(1, len(ks) + 1)) AS i FROM (SELECT event_id, props, json_keys(props) AS ks FROM events))
""")
def json_table(spark, sf_dir):
    return convert.json_table(table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.col("props").alias("text")))


@query(r"""
SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, CAST(len(h) AS INT) AS n_meta, array_to_string(h, ',') AS held
FROM (SELECT page_id, html, list_filter(['description', 'og:title', 'og:image', 'robots'], lambda p: regexp_matches(html, '<meta (?:name|property)="' || p || '" content="([^"]*)"')) AS h FROM pages)
""")
def head_tags(spark, sf_dir):
    return audit.head_tags(table(spark, sf_dir, "pages"))


@query(rf"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(n) AS BIGINT) AS longest FROM (
  SELECT doc_id, line, CAST(sum(length(t)) AS BIGINT) AS n FROM (SELECT doc_id, (i // 3) AS line, ws[i + 1] AS t
    FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ws FROM documents))) GROUP BY ALL) GROUP BY doc_id
""")
def item_lines(spark, sf_dir):
    """Lines of documents as placed items, three to a line of the page: lines and the longest."""
    item = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    i = F.col("ord")
    placed = item.select("doc_id", "ord", (F.lit(5000) - F.floor(i / 3) * 20 - i % 3).alias("y"), F.lit(14).alias("h"), "text", F.lit(False).alias("ends"))
    lines = blocks.lines_of_items(placed)
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("text")).cast("long").alias("longest"))


# ---- lines and pages


def _sql_wrapped(text: str, limit: str, face: tuple[int, ...], beyond: int) -> str:
    """SQL for the lines of a text without words longer than a line: a fold over its words, stretch by stretch."""
    char = f"list_sum(list_transform(string_split(w, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN {list(face)}[unicode(c) - 31] ELSE {beyond} END))::BIGINT"
    words = f"list_transform(regexp_extract_all(s, ' *[^ ]+'), lambda x: {{'g': regexp_extract(x, '^ *'), 't': ltrim(x), 'w': {char.replace('w,', 'ltrim(x),')}}})"
    fits = f"a.w + {face[0]} * length(x.g) + x.w <= {limit}"
    fold = f"""list_reduce({words}, lambda a, x: {{'g': '', 't': a.t || CASE WHEN {fits} THEN x.g ELSE chr(10) END || x.t,
        'w': CASE WHEN {fits} THEN a.w + {face[0]} * length(x.g) + x.w ELSE x.w END}}).t"""
    one = f"CASE WHEN trim(s) <> '' THEN string_split({fold}, chr(10)) WHEN i < len(string_split({text}, chr(10))) THEN [''] ELSE [] END"
    return f"flatten(list_transform(string_split({text}, chr(10)), lambda s, i: {one}))"


_A4_LINE = int((595.28 - 112) / 11 * 1000)


@query(f"SELECT doc_id, i - 1 AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {_sql_wrapped('text', _A4_LINE, layout.PLAIN, 556)} AS ls FROM documents))")
def line_wrap(spark, sf_dir):
    """Documents in lines as wide as an A4 page at 11 points."""
    lines = layout.wrapped(F.col("text"), layout.limit(layout.PAGES["a4"][0] - 2 * layout.MARGIN, 11.0))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("line", "text"))


_SQL_ITEMS = f"""
    SELECT doc_id, ord, page_breaks, lv, size, ls, n FROM (
        SELECT doc_id, 3 * i + 1 AS ord, (i + 1) // 4 AS page_breaks, 1 + i % 6 AS lv, round([1.9, 1.5, 1.25, 1.1, 1.0, 1.0][1 + i % 6] * 11, 3) AS size,
               {_sql_wrapped('role', 'floor(483280 / size * 1 + 0.000001)', layout.BOLD, 611)} AS ls, len(ls) AS n FROM t
        UNION ALL
        SELECT doc_id, 3 * i + 2, (i + 1) // 4, 0, 11, {_sql_wrapped('text', _A4_LINE, layout.PLAIN, 556)} AS ls, len(ls) FROM t)
"""


@query(f"""
WITH RECURSIVE t AS (
    SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, role, text FROM conversations
), b AS ({_SQL_ITEMS}), l AS (
    SELECT doc_id, ord, k - 1 AS line, ls[k] AS text, page_breaks, (size * 1000)::BIGINT AS size,
           CASE WHEN lv > 0 THEN round(size * 1300) ELSE 15950 END::BIGINT AS height,
           CASE WHEN lv > 0 AND k = 1 THEN round(size * 2400) WHEN lv > 0 THEN round(size * 1300) ELSE 15950 END::BIGINT AS need,
           CASE WHEN lv > 0 AND k = 1 THEN round(size * 600) ELSE 0 END::BIGINT AS before,
           CASE WHEN k < n THEN 0 WHEN lv > 0 THEN round(size * 350) ELSE 7700 END::BIGINT AS after
    FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM b)
), o AS (
    SELECT *, row_number() OVER w AS nth, coalesce(lag(page_breaks) OVER w, 0) AS was, coalesce(lag(after) OVER w, 0) AS gap FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord, line)
), sim AS (
    SELECT doc_id, nth, 1 + page_breaks AS page, before AS y, before + height AS below FROM o WHERE nth = 1
    UNION ALL
    SELECT doc_id, nth, page + breaks + (pos + need > 729890)::INT, CASE WHEN pos + need > 729890 THEN 0 ELSE pos END,
           CASE WHEN pos + need > 729890 THEN 0 ELSE pos END + height
    FROM (SELECT o.doc_id, o.nth, s.page, o.page_breaks - o.was AS breaks, o.need, o.height,
                 CASE WHEN o.page_breaks > o.was THEN o.before ELSE s.below + o.gap + o.before END AS pos
          FROM sim s JOIN o ON o.doc_id = s.doc_id AND o.nth = s.nth + 1)
)
SELECT o.doc_id, sim.page, o.ord, o.line, 56.0::DOUBLE AS x, (785890 - sim.y - o.size) / 1000 AS y, o.text FROM o JOIN sim USING (doc_id, nth)
""")
def page_layout(spark, sf_dir):
    """Conversations as pages: roles are headings of several levels, texts paragraphs, and every fourth turn begins a page."""
    turns = table(spark, sf_dir, "conversations")
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    t = turns.select(F.col("conv_id").alias("doc_id"), i.alias("i"), "role", "text")

    def block(kind: str, text: str, ord_: int):
        run = F.struct(F.col(text).alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
        return F.struct((F.col("i") * 3 + ord_).alias("ord"), F.lit(kind).alias("type"), (F.col("i") % 6 + 1).alias("level"), F.array(run).alias("runs"))

    blocks_ = F.concat(F.when(F.col("i") % 4 == 3, F.array(block("pagebreak", "role", 0))).otherwise(F.array()), F.array(block("h", "role", 1), block("p", "text", 2)))
    b = t.select("doc_id", F.explode(blocks_).alias("b")).select("doc_id", "b.*")
    b = b.selectExpr("*", "CAST(NULL AS BOOLEAN) AS ordered", "CAST(NULL AS INT) AS idx", "CAST(NULL AS INT) AS depth", "CAST(NULL AS ARRAY<ARRAY<STRING>>) AS rows", "CAST(NULL AS STRING) AS text")
    return layout.layout(b).drop("part")
