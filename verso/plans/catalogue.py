"""The registered queries: each applies an operator to whole test tables, with the equal DuckDB SQL beside it where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verso.cluster import shared_dir, ship
from verso.functions import chunks, html, replies, text, voices
from verso.operators import entities, jobs, select, state, timeline
from verso.plans import book, speech
from verso.plans.backend import OfflineBackend
from verso.sources import epub, files, generator, sound
from verso.sources.tables import page_items, script_lines, state_rows, table
from verso.streaming import events as event_plans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Pieces of DuckDB SQL.
STRIP = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
COUNT = lambda x: rf"CASE WHEN {STRIP(x)} = '' THEN 0 ELSE len(regexp_split_to_array({STRIP(x)}, '[\s\p{{Z}}]+')) END"
VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return STRIP(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _heading(n: int) -> str:
    found = _plain(rf"regexp_extract({VISIBLE}, '(?is)<h{n}\b[^>]*>(.*?)</h{n}>', 1)")
    return f"(SELECT CASE WHEN x <> '' AND length(x) < 200 THEN x END FROM (SELECT {found} AS x))"


TITLE = f"coalesce({_heading(1)}, {_heading(2)}, {_heading(3)})"
BOOK = "regexp_extract(url, '://([^/]+)', 1)"
LINES = "(SELECT conv_id AS chapter, turn AS line_no, role AS speaker, text FROM conversations)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        @wraps(f)
        def shipped(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        QUERIES[f.__name__] = shipped
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- content and chapters


@query(f"SELECT doc_id, length({STRIP('text')})::INT AS n, length({STRIP('text')}) >= 500 AS is_substantial FROM documents")
def substantial_docs(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(text.strip(t)).alias("n"), select.is_substantial(t).alias("is_substantial"))


@query(
    rf"""WITH t AS (SELECT page_id, {TITLE} AS title FROM pages),
    s AS (SELECT page_id, regexp_replace({STRIP(r"regexp_replace(lower(strip_accents(title)), '[^a-z0-9\s]', '', 'g')")}, '\s+', '_', 'g') AS slug FROM t)
    SELECT page_id, slug, printf('%02d-%s.txt', page_id::INT, substr(slug, 1, 40)) AS file_name FROM s"""
)
def normalize_slug(spark, d):
    rows = table(spark, d, "pages").select("page_id", text.normalize_name(html.heading_title(F.col("html"))).alias("slug"))
    return rows.select("page_id", "slug", text.chapter_file_name(F.col("page_id").cast("int"), F.col("slug")).alias("file_name"))


@query(
    rf"""SELECT page_id, len(b)::INT AS n_blocks, array_to_string(b, chr(10) || chr(10)) AS text FROM (
    SELECT page_id, list_filter(list_transform(string_split(regexp_replace({VISIBLE}, '(?i)</?(?:p|h[1-6]|div|blockquote)\b[^>]*>', chr(30), 'g'), chr(30)), lambda x: {_plain("x")}), lambda x: x <> '') AS b FROM pages)"""
)
def html_blocks_regex(spark, d):
    rows = table(spark, d, "pages").select("page_id", html.html_blocks(F.col("html")).alias("b"))
    return rows.select("page_id", F.size("b").alias("n_blocks"), F.array_join("b", "\n\n").alias("text"))


_ENDS = "ul|ol|dl|table|pre|form|hr|article|section|nav|header|footer|main|aside|fieldset|address"
_OPENED = rf"regexp_replace(regexp_replace({VISIBLE}, '(?i)<(?:p|h[1-6]|div|blockquote)\b[^>]*>', chr(30), 'g'), '(?i)</(?:p|h[1-6]|div|blockquote)\s*>|<(?:{_ENDS})\b[^>]*>', chr(31), 'g')"


def _read(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
        x = f"replace({x}, '{a}', '{b}')"
    return STRIP(f"regexp_replace({x}, '&amp;?', '&', 'g')")


_BLOCK = f"array_to_string(list_filter(list_transform(regexp_split_to_array(split_part(x, chr(31), 1), '<[^>]*>'), lambda y: {_read('y')}), lambda y: y <> ''), ' ')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_OPENED}, chr(30))[2:], lambda x: {_BLOCK}), lambda x: x <> ''), chr(10) || chr(10)) AS text, {TITLE} AS title FROM pages")
def html_to_text_dom(spark, d):
    rows = table(spark, d, "pages").select("page_id", html.read_page("html").alias("x"), html.heading_title(F.col("html")).alias("title"))
    return rows.select("page_id", "x.text", "title")


SLUG = lambda x: rf"regexp_replace({STRIP(rf"regexp_replace(lower(strip_accents({x})), '[^a-z0-9\s]', '', 'g')")}, '\s+', '_', 'g')"


@query(
    rf"""WITH i AS (SELECT {BOOK} AS book, page_id AS pos, url AS filename, array_to_string(list_filter(list_transform(string_split(regexp_replace({VISIBLE}, '(?i)</?(?:p|h[1-6]|div|blockquote)\b[^>]*>', chr(30), 'g'), chr(30)), lambda x: {_plain("x")}), lambda x: x <> ''), chr(10) || chr(10)) AS text, {TITLE} AS t FROM pages),
    c AS (SELECT *, NOT regexp_matches(lower(substr(text, 1, 1000)), 'licen[sc]e|copyright|all rights reserved') AS ok FROM i WHERE length({STRIP("text")}) >= 500),
    r AS (SELECT *, min(CASE WHEN ok THEN pos END) OVER w AS a, max(CASE WHEN ok THEN pos END) OVER w AS b FROM c WINDOW w AS (PARTITION BY book)),
    n AS (SELECT *, (row_number() OVER (PARTITION BY book ORDER BY pos))::INT AS number FROM r WHERE pos BETWEEN a AND b),
    s AS (SELECT *, coalesce(t, 'Chapter ' || number) AS title FROM n)
    SELECT book, number, title, printf('%02d-%s.txt', number, substr({SLUG("title")}, 1, 40)) AS file_name, filename, length(text)::INT AS n_chars FROM s"""
)
def chapters_of_pages(spark, d):
    return book.chapters_of_pages(spark, d)


@query(f"SELECT page_id, coalesce({TITLE}, 'Chapter ' || page_id) AS title FROM pages")
def chapter_title(spark, d):
    return table(spark, d, "pages").select("page_id", select.title_or_number(html.heading_title(F.col("html")), F.col("page_id")).alias("title"))


@query(
    rf"""WITH c AS (SELECT source, doc_id, NOT regexp_matches(lower(substr(text, 1, 1000)), 'licen[sc]e|copyright|all rights reserved') AS ok FROM documents WHERE length({STRIP("text")}) >= 500),
    r AS (SELECT *, min(CASE WHEN ok THEN doc_id END) OVER w AS a, max(CASE WHEN ok THEN doc_id END) OVER w AS b FROM c WINDOW w AS (PARTITION BY source))
    SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS number FROM r WHERE doc_id BETWEEN a AND b"""
)
def trim_content_range(spark, d):
    docs = table(spark, d, "documents").where(select.is_substantial(F.col("text"))).select("source", "doc_id", select.looks_like_content(F.col("text")).alias("ok"))
    return select.numbered(select.content_range(docs, F.col("ok"), "source", "doc_id"), "source", "doc_id").select("source", "doc_id", "number")


@query(
    f"""WITH t AS (SELECT {BOOK} AS book, page_id, {TITLE} AS t FROM pages),
    n AS (SELECT *, count(*) OVER (PARTITION BY book, t) AS n, row_number() OVER (PARTITION BY book, t ORDER BY page_id) AS i FROM t)
    SELECT book, page_id, CASE WHEN n > 1 THEN concat_ws(' ', t, i::VARCHAR) ELSE t END AS title FROM n"""
)
def number_duplicate_titles(spark, d):
    rows = page_items(spark, d).select("book", F.col("pos").alias("page_id"), html.heading_title(F.col("html")).alias("title"))
    return select.number_duplicate_titles(rows, "book", "page_id").select("book", "page_id", "title")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i <= 3")
def first_n_chapters(spark, d):
    return select.first_chapters(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i = 3")
def nth_chapter(spark, d):
    return select.nth_chapter(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 2)


@query(
    f"""WITH c AS (SELECT source, doc_id, ({COUNT("text")})::INT AS n FROM documents)
    SELECT source, doc_id, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) WHERE b < 2000"""
)
def word_target(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", text.word_count(F.col("text")).alias("n"))
    return select.until_words(rows, "source", "doc_id", "n", 2000)


_COVERS = [
    (1, 0, "image", "img1", "OEBPS/front_cover.jpg", "image/jpeg"), (1, 1, "image", "cover", "OEBPS/a.png", "image/png"),
    (2, 0, "image", "x", "pics/MyCover.gif", "image/gif"), (2, 1, "image", "y", "pics/other.png", "image/png"),
    (3, 0, "file", None, "cover.png", None), (3, 1, "file", None, "cover.jpeg", None), (3, 2, "cover", "c", "c.png", "image/png"),
    (4, 0, "image", "z", "pics/none.png", "image/png"), (5, 0, "cover", "c", "c.png", "image/png"), (5, 1, "image", "cover-image", "d.jpg", None),
]


@query(
    f"""WITH v(book, pos, kind, item_id, name, media_type) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in _COVERS)}),
    r AS (SELECT *, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS e, lower(regexp_extract(name, '([^/]*?)(?:\\.[^./]*)?$', 1)) AS stem FROM v),
    k AS (SELECT *, CASE WHEN kind = 'file' THEN CASE e WHEN 'jpeg' THEN 1 WHEN 'jpg' THEN 2 WHEN 'png' THEN 3 END WHEN kind = 'cover' THEN 4 WHEN item_id = 'cover' THEN 5
        WHEN item_id = 'cover-image' THEN 6 WHEN kind = 'image' AND contains(stem, 'cover') THEN 7 END AS rank,
        CASE WHEN kind = 'file' THEN e WHEN contains(coalesce(media_type, ''), 'png') THEN 'png' ELSE 'jpeg' END AS extension FROM r)
    SELECT book, item_id, name, extension FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY rank, pos) AS i FROM k WHERE rank IS NOT NULL) WHERE i = 1"""
)
def cover_pick(spark, d):
    return select.pick_cover(spark.createDataFrame(_COVERS, "book int, pos int, kind string, item_id string, name string, media_type string"), "book")


# ---- text


@query(
    rf"""SELECT doc_id, (i - 1)::INT AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…—])[\s\p{{Z}}]+', '\1' || chr(31), 'g'), chr(31)), lambda x: {STRIP("x")}), lambda x: x <> '') AS l FROM documents))"""
)
def split_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    rf"""WITH s AS (SELECT chapter, line_no, text, list_transform(string_split(regexp_replace(text, '([.!?])[\s\p{{Z}}]+', '\1' || chr(31), 'g'), chr(31)),
        lambda x: {{'done': []::VARCHAR[], 'line': x, 'n': ({COUNT("x")})::INT}}) AS l, {COUNT("text")} AS total FROM {LINES}),
    f AS (SELECT chapter, line_no, text, total, list_reduce(l, lambda a, x: CASE WHEN a.n + x.n > 35 THEN {{'done': list_append(a.done, a.line), 'line': x.line, 'n': x.n}}
        ELSE {{'done': a.done, 'line': a.line || ' ' || x.line, 'n': a.n + x.n}} END) AS r FROM s),
    p AS (SELECT chapter, line_no, CASE WHEN total <= 35 THEN [text] ELSE list_append(r.done, r.line) END AS ps FROM f),
    u AS (SELECT chapter, line_no, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS piece_no FROM p)
    SELECT chapter, line_no, piece_no::INT AS piece_no, piece, (row_number() OVER (PARTITION BY chapter ORDER BY line_no, piece_no) - 1)::INT AS sub_idx,
        printf('%05d.wav', (row_number() OVER (PARTITION BY chapter ORDER BY line_no, piece_no) - 1)::INT) AS out_key FROM u"""
)
def split_long_text(spark, d):
    rows = jobs.line_pieces(script_lines(spark, d), "chapter", "line_no")
    return rows.select("chapter", "line_no", "piece_no", "piece", "sub_idx", jobs.out_key(F.col("sub_idx")).alias("out_key"))


_BREAK = lambda mark: rf"length(regexp_extract(w, '^((?s).*{mark})', 1))"


@query(
    rf"""WITH RECURSIVE r AS (
        SELECT doc_id, text, 0 AS lo, 0 AS hi, -1 AS chunk_no FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, text, lo, CASE WHEN lo + 4000 >= length(text) THEN length(text) WHEN a > 0 THEN lo + 2000 + a WHEN b > 0 THEN lo + 2000 + b WHEN c > 0 THEN lo + 2000 + c ELSE lo + 4000 END, chunk_no
        FROM (SELECT *, {_BREAK(chr(92) + "n" + chr(92) + "n")} AS a, {_BREAK(chr(92) + ". ")} AS b, {_BREAK(" ")} AS c FROM (
            SELECT doc_id, text, hi AS lo, chunk_no + 1 AS chunk_no, substr(text, hi + 2001, 2000) AS w FROM r WHERE hi < length(text))))
    SELECT doc_id, chunk_no::INT AS chunk_no, substr(text, lo + 1, hi - lo) AS chunk FROM r WHERE chunk_no >= 0"""
)
def chunk_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks.chunk_text(F.col("text"))).alias("chunk_no", "chunk"))


@query(f"SELECT source, count(*)::BIGINT AS n_docs, sum({COUNT('text')})::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source")
def word_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(text.word_count(F.col("text"))).alias("n_words"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(f"SELECT conv_id, turn, {STRIP('text')} AS answer FROM conversations")
def strip_think(spark, d):
    noisy = F.concat(F.lit("<Think>about\n"), "role", F.lit("</think>\n"), "text", F.lit(" <think>again</THINK>"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_think(noisy).alias("answer"))


@query(
    """SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
    regexp_replace(text, '([\\\\=;#])', '\\\\\\1', 'g') AS metadata, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview, text AS unquoted FROM conversations"""
)
def escapes_and_previews(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", text.escape_html(t).alias("html"), text.escape_metadata(t).alias("metadata"), text.preview(t).alias("preview"), text.strip_quotes(F.concat(F.lit("  \"'"), t, F.lit("'\" "))).alias("unquoted"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Unknown' WHEN n_nationkey % 4 = 1 THEN n_name || ' the First' ELSE n_name END AS title,
    CASE WHEN n_nationkey % 4 IN (0, 2) THEN 'Unknown' ELSE n_name || ' by and by' END AS author, least(5 * n_nationkey, 60)::INT AS wait FROM nation""")
def intro_fields(spark, d):
    k, by = F.col("n_nationkey") % 4, F.concat(F.lit(" by "), "n_name", F.lit(" by and by, narrated by someone"))
    intro = F.when(k == 0, F.lit("")).when(k == 1, F.concat("n_name", F.lit(" the First"), by)).when(k == 2, F.col("n_name")).otherwise(F.concat("n_name", by))
    rows = table(spark, d, "nation").withColumn("intro", intro)
    title, author = text.intro_fields(F.col("intro"))
    return rows.select("n_nationkey", title.alias("title"), author.alias("author"), text.backoff_seconds(F.col("n_nationkey")).alias("wait"))


# ---- model replies


@query("SELECT conv_id, turn, role AS char_id, text AS name, text AS details FROM conversations")
def fence_extract(spark, d):
    entry = F.struct(F.create_map("role", F.struct(F.col("text").alias("name"), F.col("text").alias("details"))).alias("characters"))
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(entry), F.lit("\n```\n"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(replies.parse_characters(reply)).alias("char_id", "c"))
    return rows.select("conv_id", "turn", "char_id", "c.name", "c.details")


@query("SELECT conv_id, turn, (i % 3)::INT AS kind, CASE WHEN i % 3 = 2 THEN 'narrator' ELSE role END AS speaker, text FROM (SELECT *, turn AS i FROM conversations)")
def jsonl_parse(spark, d):
    by_id, by_name = (F.to_json(F.struct(F.col("role").alias(k), "text")) for k in ("speaker_id", "speaker"))
    line = F.when(F.col("turn") % 3 == 0, by_id).when(F.col("turn") % 3 == 1, by_name).otherwise(F.to_json(F.create_map(F.lit("narrator"), "text")))
    reply = F.concat(F.lit("```jsonl\nsome words\n{'single': 'quotes'}\n{broken\n"), line, F.lit("\n```"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3).cast("int").alias("kind"), F.explode(replies.parse_script(reply)).alias("x"))
    return rows.select("conv_id", "turn", "kind", "x.speaker", "x.text")


# ---- characters

_ENTITIES = "(SELECT conv_id, role AS char_id, min_by(upper(role) || turn, turn) AS name, string_agg(text, ' ' ORDER BY turn) AS bio, min(turn) AS first_pos FROM conversations GROUP BY 1, 2)"


def _characters(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("role").alias("char_id"), F.col("turn").alias("pos"), F.concat(F.upper("role"), F.col("turn").cast("string")).alias("name"), F.col("text").alias("details"))
    return entities.merge_characters(rows, ["conv_id"])


@query(f"SELECT * FROM {_ENTITIES}")
def merge_entities(spark, d):
    return _characters(spark, d)


@query(
    f"""WITH e AS {_ENTITIES}, c AS (SELECT *, CASE WHEN char_id = 'user' AND EXISTS (SELECT 1 FROM e x WHERE x.conv_id = e.conv_id AND x.char_id = 'assistant') AND conv_id % 2 = 0 THEN 'assistant' ELSE char_id END AS k FROM e),
    r AS (SELECT conv_id, k, max_by(name, (length(name), -first_pos)) AS name, list_reduce(list(bio ORDER BY first_pos, bio), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || ' ' || b END) AS bio, min(first_pos) AS first_pos FROM c GROUP BY 1, 2)
    SELECT conv_id, k AS char_id, name, bio, first_pos FROM r"""
)
def dedup_fold(spark, d):
    chars = _characters(spark, d)
    # A later group of one's own overrides the first one in every other conversation; a group of strangers does nothing.
    given = [(0, 0, "user"), (0, 1, "assistant"), (0, 2, "a_stranger_with_a_long_id"), (1, 0, "user"), (2, 0, "stranger")]
    groups = chars.select("conv_id").distinct().select("conv_id", F.explode(F.array(*(F.struct(F.lit(g).alias("group_no"), F.lit(m).alias("member_no"), F.lit(c).alias("char_id")) for g, m, c in given))).alias("x")).select("conv_id", "x.*")
    groups = groups.where("group_no <> 1 OR conv_id % 2 = 1")
    return entities.fold_aliases(chars, entities.alias_map(groups, chars, ["conv_id"]), ["conv_id"])


_ALIASES = [("NATION_1", "NATION_2"), ("NATION_3", "NATION_2"), ("NATION_9", "NOBODY")]


@query(
    f"""WITH c AS (SELECT n_regionkey AS book, n_name AS char_id, 'bio of ' || n_name AS bio FROM nation), a(alias, canonical) AS (VALUES {", ".join(map(str, _ALIASES))}),
    b AS (SELECT x.book, a.alias, a.canonical, x.bio FROM c x JOIN a ON x.char_id = a.alias JOIN c y ON y.book = x.book AND y.char_id = a.canonical),
    m AS (SELECT book, canonical, string_agg(bio, ' ' ORDER BY alias) AS more FROM b GROUP BY 1, 2)
    SELECT c.book, c.char_id, concat_ws(' ', c.bio, m.more) AS bio FROM c LEFT JOIN m ON m.book = c.book AND m.canonical = c.char_id
    WHERE c.char_id <> 'NATION_4' AND NOT EXISTS (SELECT 1 FROM b WHERE b.book = c.book AND b.alias = c.char_id)"""
)
def alias_post_process(spark, d):
    chars = table(spark, d, "nation").select(F.col("n_regionkey").alias("book"), F.col("n_name").alias("char_id"), F.concat(F.lit("bio of "), "n_name").alias("bio"))
    return entities.apply_known_aliases(chars, spark.createDataFrame(_ALIASES, "alias string, canonical string"), ["NATION_4"], ["book"])


@query(
    """WITH c AS (SELECT n_regionkey AS book, CASE WHEN n_nationkey % 2 = 0 THEN 'the_' ELSE '' END || lower(n_name) AS id, n_nationkey AS pos FROM nation
        UNION ALL SELECT n_regionkey, lower(n_name), n_nationkey + 100 FROM nation)
    SELECT x.book, x.id AS a, y.id AS b FROM c x JOIN c y ON x.book = y.book AND x.pos < y.pos
    AND (regexp_replace(x.id, '^the_', '') = regexp_replace(y.id, '^the_', '') OR contains(x.id, y.id) OR contains(y.id, x.id))"""
)
def dup_detector(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_regionkey").alias("book"), F.lower("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    first = nation.select("book", F.concat(F.when(F.col("k") % 2 == 0, "the_").otherwise(""), "name").alias("char_id"), F.col("k").alias("first_pos"))
    return entities.duplicate_pairs(first.unionByName(nation.select("book", F.col("name").alias("char_id"), (F.col("k") + 100).alias("first_pos"))), ["book"])


@query(f"SELECT * FROM {_ENTITIES} WHERE char_id <> 'user' UNION ALL SELECT DISTINCT conv_id, 'narrator', 'Narrator', 'voice of the book', -1 FROM conversations UNION ALL SELECT DISTINCT conv_id, 'user', 'User', 'overwritten', 0 FROM conversations")
def narrator_upsert(spark, d):
    chars = _characters(spark, d)
    new = chars.select("conv_id").distinct().select("conv_id", F.explode(F.array(*(F.struct(F.lit(a).alias("char_id"), F.lit(b).alias("name"), F.lit(c).alias("bio"), F.lit(p).cast("long").alias("first_pos")) for a, b, c, p in (("narrator", "Narrator", "voice of the book", -1), ("user", "User", "overwritten", 0))))).alias("x")).select("conv_id", "x.*")
    return entities.upsert(chars, new, ["conv_id", "char_id"])


@query("SELECT DISTINCT conv_id, role AS speaker FROM conversations")
def distinct_speakers(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.explode(F.map_keys(F.create_map("role", "text"))).alias("speaker")).distinct()


# ---- voices

_SPECS = ["af_heart", " af_sky*0.7 + bm_george*0.3", "", None, "zz_none", "af_heart*1+nobody", "bf_emma* 2 ", "jm_kumo+jf_alpha"]
_CLEAN = ["af_heart", "af_sky*0.7+bm_george*0.3", "am_adam", "am_adam", "am_adam", "am_adam", "bf_emma*2", "jm_kumo+jf_alpha"]


@query("SELECT i::INT AS i, s AS spec FROM (VALUES " + ", ".join(f"({i}, {s!r})" for i, s in enumerate(_CLEAN)) + ") x(i, s)")
def sanitize_voice(spark, d):
    return spark.createDataFrame(list(enumerate(_SPECS)), "i int, s string").select("i", voices.sanitize_voice(F.col("s"), F.lit("am_adam")).alias("spec"))


@query("SELECT p_partkey, round(greatest(0.7::DOUBLE, least(1.3::DOUBLE, coalesce(CASE WHEN p_size % 7 > 0 THEN p_size / 30.0::DOUBLE END, 1.0::DOUBLE))), 3) AS speed FROM part")
def clamp_speed(spark, d):
    return table(spark, d, "part").select("p_partkey", voices.clamp_speed(F.when(F.col("p_size") % 7 > 0, (F.col("p_size") / F.lit(30.0)).cast("string")).otherwise("fast")).alias("speed"))


@query(
    "SELECT i::INT AS pos, v AS voice, coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in voices.LANGUAGES.items()) + "}[substr(v, 1, 1)], 'English') || CASE WHEN substr(v, 2, 1) = 'f' THEN ' female' ELSE ' male' END AS description, substr(v, 1, 1) IN ('a', 'b') AS is_english FROM (VALUES "
    + ", ".join(f"({i}, '{v}')" for i, v in enumerate(voices.ALL_VOICES)) + ") x(i, v)"
)
def describe_voice(spark, d):
    return voices.voice_catalog(spark)


@query(
    "SELECT string_agg('- ' || v || ': ' || coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in voices.LANGUAGES.items()) + "}[substr(v, 1, 1)], 'English') || CASE WHEN substr(v, 2, 1) = 'f' THEN ' female' ELSE ' male' END, chr(10) ORDER BY i) AS text FROM (VALUES "
    + ", ".join(f"({i}, '{v}')" for i, v in enumerate(voices.ALL_VOICES)) + ") x(i, v)"
)
def catalog_text(spark, d):
    return voices.catalog_text(voices.voice_catalog(spark))


@query(f"SELECT chapter, line_no, CASE WHEN speaker = 'user' THEN speaker ELSE 'narrator' END AS speaker FROM {LINES}")
def speaker_fallback(spark, d):
    return jobs.with_known_speakers(script_lines(spark, d), spark.createDataFrame([("user",), ("narrator",)], "speaker string")).select("chapter", "line_no", "speaker")


@query(f"SELECT chapter, line_no, speaker, CASE WHEN speaker = 'user' THEN 'am_adam' ELSE 'bm_george' END AS voice, CASE WHEN speaker = 'user' THEN 1.0 ELSE 0.95 END::DOUBLE AS speed FROM {LINES}")
def voice_lookup_default(spark, d):
    entries = spark.createDataFrame([("user", "am_adam", None), ("user", "bm_lewis", 1.2), ("narrator", "bm_george", 0.95)], "speaker string, voice string, speed double")
    return jobs.with_voices(script_lines(spark, d), entries).select("chapter", "line_no", "speaker", "voice", "speed")


# ---- jobs and timelines


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 100)")
def pending_jobs(spark, d):
    outputs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("size"))
    return jobs.pending(table(spark, d, "orders").select("o_orderkey"), outputs, ["o_orderkey"])


@query(f"SELECT chapter, line_no, (i // 40)::BIGINT AS batch_no, (i % 40)::BIGINT AS batch_pos FROM (SELECT chapter, line_no, row_number() OVER (ORDER BY chapter, line_no) - 1 AS i FROM {LINES})")
def batch_assign(spark, d):
    return jobs.batched(script_lines(spark, d), "chapter", ["line_no"]).select("chapter", "line_no", "batch_no", "batch_pos")


@query(f"SELECT book, chapter, line_no, (i // 40)::BIGINT AS batch_no, (i % 40)::BIGINT AS batch_pos FROM (SELECT book, chapter, line_no, row_number() OVER (ORDER BY book, chapter, line_no) - 1 AS i FROM (SELECT *, chapter % 10 AS book FROM {LINES}))")
def batch_assign_books(spark, d):
    rows = script_lines(spark, d).withColumn("book", F.col("chapter") % 10)
    return jobs.batched(rows, "chapter", ["line_no"], book="book").select("book", "chapter", "line_no", "batch_no", "batch_pos")


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"SELECT l_orderkey, l_linenumber, s AS start_sample, s + n AS end_sample FROM (SELECT l_orderkey, l_linenumber, n, coalesce(sum(n + 1200) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (SELECT *, (l_quantity * 240)::BIGINT AS n FROM lineitem))")
def slice_offsets(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", *_ORDER, (F.col("l_quantity") * 240).cast("long").alias("n"))
    return jobs.slice_offsets(items, "l_orderkey", _ORDER, "n", 1200).select("l_orderkey", "l_linenumber", "start_sample", "end_sample")


@query(f"SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1)::INT AS pos, l_linenumber AS item, (l_quantity * 240)::BIGINT AS samples FROM lineitem")
def item_samples(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, (F.col("l_quantity") * 240).cast("long").alias("n")))).alias("x"))
    return jobs.item_samples(rows.select("l_orderkey", F.col("x.l_linenumber").alias("items"), F.col("x.n").alias("item_samples")))


@query("SELECT p_partkey, hex(substr(p_name, (p_size % 3) * 2 + 1, 6)) AS frames FROM part")
def frame_slices(spark, d):
    return table(spark, d, "part").select("p_partkey", F.hex(jobs.frame_slice(F.encode("p_name", "UTF-8"), F.col("p_size") % 3, F.lit(3), 2)).alias("frames"))


@query(f"SELECT speaker, n_jobs, first_pos, (row_number() OVER (ORDER BY n_jobs DESC, first_pos, speaker))::INT AS rank FROM (SELECT speaker, count(*)::BIGINT AS n_jobs, min(chapter * 1000 + line_no) AS first_pos FROM {LINES} GROUP BY 1)")
def group_largest_first(spark, d):
    return jobs.groups_largest_first(script_lines(spark, d).withColumn("at", F.col("chapter") * 1000 + F.col("line_no")), "at")


@query("SELECT conv_id, turn, text, 'af_heart' AS voice, 1.0::DOUBLE AS speed FROM conversations")
def request_items(spark, d):
    item = jobs.request_item(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", item.alias("x")).select("conv_id", "turn", "x.*")


_CHAPTERS = f"""(SELECT chapter % 10 AS book, chapter, 'Part ' || chapter || '; a=b' AS title, (sum({COUNT("text")}) * 400)::BIGINT AS duration_ms,
    CASE WHEN chapter % 3 > 0 THEN 800 + chapter END::BIGINT AS announce_ms, CASE WHEN chapter % 10 > 0 THEN 850 END::BIGINT AS chime_ms FROM {LINES} GROUP BY chapter)"""
_TIMELINE = f"""(SELECT *, s AS start_ms, s + p + duration_ms AS end_ms FROM (SELECT *, coalesce(sum(p + duration_ms + 3000) OVER (PARTITION BY book ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
    FROM (SELECT *, CASE WHEN chime_ms IS NOT NULL AND announce_ms IS NOT NULL THEN chime_ms + 500 + announce_ms + 1000 ELSE 0 END AS p FROM {_CHAPTERS})))"""


def _chapters(spark, d):
    rows = script_lines(spark, d).groupBy("chapter").agg((F.sum(text.word_count(F.col("text"))) * 400).alias("duration_ms"))
    c = F.col("chapter")
    return rows.select((c % 10).alias("book"), "chapter", F.concat(F.lit("Part "), c.cast("string"), F.lit("; a=b")).alias("title"), "duration_ms", F.when(c % 3 > 0, c + 800).alias("announce_ms"), F.when(c % 10 > 0, F.lit(850).cast("long")).alias("chime_ms"))


@query(f"SELECT book, chapter, title, start_ms, end_ms FROM {_TIMELINE}")
def chapter_timeline(spark, d):
    return timeline.timeline(_chapters(spark, d), ["book"], "chapter").select("book", "chapter", "title", "start_ms", "end_ms")


@query(f"SELECT chapter, s AS start_ms, s + duration_ms AS end_ms FROM (SELECT *, coalesce(sum(duration_ms + 1000) OVER (PARTITION BY book ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM {_CHAPTERS})")
def simple_timeline(spark, d):
    return timeline.simple_timeline(_chapters(spark, d), ["book"], "chapter").select("chapter", "start_ms", "end_ms")


@query(
    f"""SELECT book, ';FFMETADATA1' || chr(10) || string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title='
    || regexp_replace(title, '([\\\\=;#])', '\\\\\\1', 'g') || chr(10), '' ORDER BY chapter) AS metadata FROM {_TIMELINE} GROUP BY book"""
)
def ffmetadata(spark, d):
    return timeline.metadata_file(timeline.timeline(_chapters(spark, d), ["book"], "chapter"), ["book"], "chapter")


@query(
    f"""WITH c AS {_CHAPTERS},
    q AS (SELECT chapter, CASE WHEN chime_ms IS NOT NULL AND announce_ms IS NOT NULL THEN [{{'kind': 'chime', 'ms': chime_ms}}, {{'kind': 'gap', 'ms': 500}}, {{'kind': 'announce', 'ms': announce_ms}}, {{'kind': 'gap', 'ms': 1000}}] ELSE [] END
        || [{{'kind': 'chapter', 'ms': duration_ms}}, {{'kind': 'gap', 'ms': 3000}}] AS l FROM c)
    SELECT chapter, (i - 1)::INT AS k, l[i].kind AS kind, l[i].ms::BIGINT AS ms FROM (SELECT chapter, l, unnest(range(1, len(l) + 1)) AS i FROM q)"""
)
def interleave(spark, d):
    return timeline.interleaved(_chapters(spark, d), "chapter").select("chapter", "k", "kind", "ms")


@query(
    """WITH n AS (SELECT n_regionkey AS book, CASE WHEN n_nationkey % 5 = 0 THEN '00-intro' WHEN n_nationkey % 7 = 3 THEN printf('%02d-intro', n_nationkey) WHEN n_nationkey % 5 = 1 THEN printf('%02d-', n_nationkey) || lower(n_name) || '.announce'
        WHEN n_nationkey % 11 = 2 THEN 'chime' ELSE printf('%02d-', n_nationkey) || lower(n_name) END AS stem, n_nationkey AS k, n_name FROM nation),
    m AS (SELECT *, NOT (stem LIKE '%.announce' OR stem = 'chime') AS is_audio, stem LIKE '%-intro' AS is_intro FROM n)
    SELECT book, k AS n_nationkey, stem, is_audio, is_intro, CASE WHEN is_audio AND NOT is_intro AND k % 3 > 0 THEN 'The Book. Nation ' || k || '.' END AS line FROM m"""
)
def announcements(spark, d):
    k, name = F.col("n_nationkey"), F.concat(F.format_string("%02d-", "n_nationkey"), F.lower("n_name"))
    stem = F.when(k % 5 == 0, "00-intro").when(k % 7 == 3, F.format_string("%02d-intro", "n_nationkey")).when(k % 5 == 1, F.concat(name, F.lit(".announce"))).when(k % 11 == 2, "chime").otherwise(name)
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("book"), "n_nationkey", F.lit("The Book").alias("title"), stem.alias("stem"))
    lines = timeline.missing_announcements(rows, rows.where("n_nationkey % 3 = 0"), ["book"]).select("book", "stem", F.col("text").alias("line"))
    return rows.join(lines, ["book", "stem"], "left").select("book", "n_nationkey", "stem", timeline.is_chapter_audio(F.col("stem")).alias("is_audio"), timeline.is_intro(F.col("stem")).alias("is_intro"), "line")


# ---- plans


@query("SELECT book, number, title, file_name, filename FROM (" + SQL["chapters_of_pages"] + ")")
def chapters_by_model(spark, d):
    items = page_items(spark, d).select("book", "pos", "filename", F.explode(F.array(html.page_parts(F.col("html")))).alias("x")).select("book", "pos", "filename", "x.text", "x.title")
    return book.chapters_by_model(items, OfflineBackend()).drop("text")


_SPOKEN = f"(SELECT chapter % 10 AS book, chapter * 100 + line_no AS number, 'Part ' || line_no AS title, CASE WHEN line_no = 0 THEN ' ' ELSE speaker || ' said \"' || text || '\" and “left”' END AS text FROM {LINES})"


def _spoken(spark, d):
    said = F.when(F.col("line_no") == 0, " ").otherwise(F.concat("speaker", F.lit(' said "'), "text", F.lit('" and “left”')))
    return script_lines(spark, d).select((F.col("chapter") % 10).alias("book"), (F.col("chapter") * 100 + F.col("line_no")).alias("number"), F.concat(F.lit("Part "), F.col("line_no").cast("string")).alias("title"), said.alias("text"))


_SCRIPT = rf"""(WITH p AS (SELECT book, number, unnest(l) AS part, generate_subscripts(l, 1) AS k, text FROM (SELECT *, regexp_split_to_array(text, '["“”]') AS l FROM {_SPOKEN})),
    q AS (SELECT book, number, k, CASE WHEN k % 2 = 0 THEN 'speech' ELSE 'narrator' END AS speaker, {STRIP("part")} AS text FROM p WHERE {STRIP("part")} <> ''),
    n AS (SELECT book, number, 1 AS k, 'narrator' AS speaker, text FROM {_SPOKEN} x WHERE length(text) > 0 AND NOT EXISTS (SELECT 1 FROM q WHERE q.number = x.number)),
    u AS (SELECT * FROM q UNION ALL SELECT * FROM n UNION ALL SELECT book, number, 0, 'narrator', title FROM {_SPOKEN})
    SELECT book, number, (row_number() OVER (PARTITION BY book, number ORDER BY k) - 1)::INT AS line_no, speaker, text FROM u)"""


@query(f"SELECT * FROM {_SCRIPT}")
def script_by_model(spark, d):
    """Chapters of under 4,000 characters, so one chunk each; a blank one gets no line from the model in all its attempts."""
    return book.script(_spoken(spark, d).where("length(text) < 4000"), OfflineBackend())


@query(
    f"SELECT book, number, (row_number() OVER (PARTITION BY book, number ORDER BY line_no) - 1)::INT AS sub_idx, printf('%05d.wav', (row_number() OVER (PARTITION BY book, number ORDER BY line_no) - 1)::INT) AS out_key, CASE WHEN book % 2 = 0 AND speaker = 'speech' THEN 'speech' ELSE 'narrator' END AS speaker, CASE WHEN book % 2 = 0 AND speaker = 'speech' THEN 'am_adam' WHEN book % 3 = 0 THEN 'bm_george' ELSE 'af_heart' END AS voice, CASE WHEN book % 2 = 0 AND speaker = 'speech' THEN 1.0 WHEN book % 3 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS speed, text FROM {_SCRIPT} WHERE {COUNT('text')} <= 35 QUALIFY sub_idx <> 1"
)
def plan_of_jobs(spark, d):
    """Lines of 35 words at most, so one piece each; some books have voices for speech, some for the narrator, some none; the second job of each chapter is finished."""
    lines = book.script(_spoken(spark, d), OfflineBackend()).where(text.word_count(F.col("text")) <= 35)
    books = lines.select("book").distinct()
    some = books.where("book % 2 = 0").selectExpr("book", "'speech' AS speaker", "'am_adam' AS voice", "CAST(NULL AS DOUBLE) AS speed")
    narrators = books.where("book % 3 = 0").selectExpr("book", "'narrator' AS speaker", "'bm_george' AS voice", "0.9D AS speed")
    finished = lines.select("book", "number").distinct().selectExpr("book", "number", "'00001.wav' AS out_key", "5000 AS size")
    return book.plan_jobs(lines, some.unionByName(narrators), finished)


@query("SELECT n_nationkey, n_name AS name, 'of ' || n_regionkey AS bio FROM nation")
def strict_objects(spark, d):
    entry = F.to_json(F.struct(F.col("n_name").alias("name"), F.concat(F.lit("of "), F.col("n_regionkey").cast("string")).alias("bio")))
    reply = F.concat(F.lit("So:\n```json\n"), entry, F.lit("\n```"))
    return table(spark, d, "nation").select("n_nationkey", replies.parse_strict(reply, "struct<name:string,bio:string>").alias("x")).select("n_nationkey", "x.*")


# ---- sources and sinks, each written and read back


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/verso-out-{uuid.uuid4().hex}"


_TENTH = f"(SELECT chapter % 10 AS book, chapter, line_no, speaker, text FROM {LINES})"


def _tenths(spark, d):
    return script_lines(spark, d).withColumn("book", F.col("chapter") % 10)


@query(
    rf"""WITH s AS (SELECT book, chapter, line_no, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…—])[\s\p{{Z}}]+', '\1' || chr(31), 'g'), chr(31)), lambda x: {STRIP("x")}), lambda x: x <> '') AS l FROM {_TENTH})),
    n AS (SELECT *, (row_number() OVER (PARTITION BY book, chapter ORDER BY line_no, k) - 1)::INT AS idx FROM s)
    SELECT book, chapter AS number, 'Part ' || chapter AS title, idx, text, 'af_heart' AS voice, 0.9::DOUBLE AS speed, printf('.lines_%03d/%05d.wav', chapter, idx) AS line_file, printf('%03d.wav', chapter) AS chapter_file FROM n"""
)
def plan_chapters(spark, d):
    rows = _tenths(spark, d).select("book", F.col("chapter").alias("number"), F.concat(F.lit("Part "), F.col("chapter").cast("string")).alias("title"), "line_no", "text")
    return book.plan_chapters(rows, "line_no", "af_heart", 0.9)


@query(
    f"""WITH RECURSIVE l AS (SELECT chapter, line_no, {COUNT("text")} AS n, row_number() OVER (PARTITION BY chapter ORDER BY line_no) AS i FROM {LINES}),
    r AS (SELECT chapter, line_no, i, n AS total, 1 AS part FROM l WHERE i = 1
        UNION ALL SELECT l.chapter, l.line_no, l.i, CASE WHEN r.total >= 60 THEN 0 ELSE r.total END + l.n, r.part + CASE WHEN r.total >= 60 THEN 1 ELSE 0 END FROM r JOIN l ON l.chapter = r.chapter AND l.i = r.i + 1)
    SELECT chapter AS conv_id, line_no, part::INT AS part FROM r"""
)
def chapters_by_words(spark, d):
    rows = script_lines(spark, d).select(F.col("chapter").alias("conv_id"), "line_no", text.word_count(F.col("text")).alias("n"))
    return select.chapters_by_words(rows, "conv_id", "line_no", "n", 60).withColumnRenamed("chapter", "part")


_CAST = [(1, "anna"), (1, "anna_berg"), (1, "the_miller"), (1, "bo"), (2, "miller"), (2, "the_miller"), (2, "mask"), (2, "crowd")]
_FOLDED = [(1, "bo", "bio of bo"), (1, "anna_berg", "bio of anna bio of anna_berg"), (1, "the_miller", "bio of the_miller"), (2, "the_miller", "bio of miller bio of the_miller bio of mask")]


@query("SELECT b AS book, c AS char_id, t AS bio FROM (VALUES " + ", ".join(map(str, _FOLDED)) + ") x(b, c, t)")
def characters_folded(spark, d):
    rows = spark.createDataFrame([(b, c, i) for i, (b, c) in enumerate(_CAST)], "book int, char_id string, first_pos int")
    rows = rows.select("book", "char_id", F.col("char_id").alias("name"), F.concat(F.lit("bio of "), "char_id").alias("bio"), "first_pos")
    known = spark.createDataFrame([("mask", "the_miller")], "alias string, canonical string")
    return entities.apply_known_aliases(book.fold_by_model(rows, OfflineBackend()), known, ["crowd"], ["book"]).select("book", "char_id", "bio")


@query(f"SELECT DISTINCT book, speaker AS char_id, 'The voice of ' || speaker || ': speaks in ' || book AS description FROM {_TENTH}")
def voice_descriptions(spark, d):
    cast = _tenths(spark, d).select("book", F.col("speaker").alias("char_id")).distinct().withColumn("bio", F.concat(F.lit("speaks in "), F.col("book").cast("string")))
    return book.voice_descriptions(cast, OfflineBackend())


@query(
    f"""WITH c AS (SELECT DISTINCT book, speaker AS k FROM {_TENTH} UNION SELECT DISTINCT book, 'narrator' FROM {_TENTH})
    SELECT book, k AS speaker, CASE WHEN k = 'narrator' THEN 'bm_george' ELSE 'af_heart' END AS voice, 1.0::DOUBLE AS speed FROM c"""
)
def voice_map(spark, d):
    rows = _tenths(spark, d)
    cast = rows.select("book", F.col("speaker").alias("char_id")).union(rows.select("book", F.lit("narrator"))).distinct().withColumn("bio", F.lit("x"))
    return book.voice_map(cast, OfflineBackend())


@query(
    f"""WITH p AS (SELECT book, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY line_no) AS i, {STRIP("text")} AS t FROM {_TENTH}),
    c AS (SELECT book, chapter, row_number() OVER (PARTITION BY book ORDER BY chapter) AS n, 'Part <' || chapter || '>' AS title, string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> '') AS body FROM p GROUP BY book, chapter)
    SELECT 'Tale ' || book AS book, n::INT AS pos, printf('OEBPS/chapter_%02d.xhtml', n) AS filename, title || coalesce(chr(10) || chr(10) || body, '') AS text, title FROM c WHERE length(title || coalesce(chr(10) || chr(10) || body, '')) >= 500"""
)
def epub_round_trip(spark, d):
    rows = _tenths(spark, d).groupBy("book", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("paragraphs"))
    name, title = F.concat(F.lit("Tale "), F.col("book").cast("string")), F.concat(F.lit("Part <"), F.col("chapter").cast("string"), F.lit(">"))
    made = epub.epub_files(rows.select(name.alias("book"), name.alias("title"), F.lit("A. Writer").alias("author"), F.col("chapter").alias("number"), title.alias("chapter_title"), "paragraphs"))
    return epub.candidates(epub.epub_items(made))


@query("SELECT DISTINCT 'Tale ' || conv_id % 10 AS book, 'Tale ' || conv_id % 10 || ' & Co' AS title, 'A. <Writer>' AS author FROM conversations")
def epub_metadata(spark, d):
    rows = _tenths(spark, d).select(F.concat(F.lit("Tale "), F.col("book").cast("string")).alias("book"), F.col("chapter").alias("number")).distinct()
    rows = rows.select("book", F.concat("book", F.lit(" & Co")).alias("title"), F.lit("A. <Writer>").alias("author"), "number", F.lit("x").alias("chapter_title"), F.array(F.lit("y")).alias("paragraphs"))
    return epub.metadata(epub.epub_items(epub.epub_files(rows)))


@query(f"SELECT book::VARCHAR AS book, printf('%02d-x.txt', chapter) AS file_name, replace(string_agg(text, chr(10) ORDER BY line_no), chr(13), '') AS text FROM {_TENTH} GROUP BY book, chapter")
def chapter_files(spark, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    rows = _tenths(spark, d).groupBy("book", "chapter").agg(F.replace(F.array_join(lines, "\n"), F.lit("\r"), F.lit("")).alias("text"))
    rows = rows.select("book", F.format_string("%02d-x.txt", "chapter").alias("file_name"), "text")
    path, some = _folder(spark), F.col("book") < 5
    files.write_chapters(rows.where(some), path)
    files.write_chapters(rows.withColumn("text", F.when(some, "overwritten").otherwise(F.col("text"))), path)
    return files.read_texts(spark, path)


@query(f"SELECT book::VARCHAR AS book, printf('%d.jsonl', chapter) AS file_name, (row_number() OVER (PARTITION BY chapter ORDER BY line_no) - 1)::INT AS line_no, speaker, text FROM {_TENTH}")
def script_files(spark, d):
    path = _folder(spark)
    files.write_scripts(_tenths(spark, d).withColumn("file_name", F.format_string("%d.jsonl", "chapter")), path)
    rows = files.read_texts(spark, path)
    lines = rows.select("book", "file_name", F.posexplode(files.script_lines_of(F.col("text"))).alias("line_no", "x"))
    return lines.select("book", "file_name", "line_no", "x.speaker", "x.text")


@query("SELECT n_regionkey::VARCHAR AS book, n_name AS char_id, lower(n_name) AS name, 'bio \"of\" ' || n_name AS bio FROM nation")
def json_files(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("book"), F.col("n_name").alias("char_id"), F.lower("n_name").alias("name"), F.concat(F.lit('bio "of" '), "n_name").alias("bio"))
    path = _folder(spark)
    files.write_documents(files.json_document(rows, ["book"], "char_id", ["name", "bio"]), path, "characters.json")
    read = files.read_texts(spark, path).select("book", F.explode(F.from_json("text", "map<string,struct<name:string,bio:string>>")).alias("char_id", "x"))
    return read.select("book", "char_id", "x.name", "x.bio")


@query("SELECT event_type AS step, event_id::VARCHAR AS detail FROM events UNION ALL SELECT DISTINCT event_type, 'complete' FROM events WHERE event_type < 'm'")
def state_log(spark, d):
    path, rows = _folder(spark), table(spark, d, "events")
    for r in rows.select("event_type").distinct().collect():  # one of five steps
        state.mark_items(rows.where(F.col("event_type") == r[0]).select(F.col("event_id").alias("item")), path, r[0])
        if r[0] < "m":
            state.mark_complete(spark, path, r[0])
    return state.read_state(spark, path).select("step", "detail")


@query(f"SELECT conv_id, sum({COUNT('text')} * 100)::BIGINT AS samples, sum({COUNT('text')} * 100)::DOUBLE / 24000 AS seconds FROM conversations GROUP BY 1")
def joined_sounds(spark, d):
    n = text.word_count(F.col("text")) * 100
    pieces = table(spark, d, "conversations").select("conv_id", "turn", sound.with_header(F.unhex(F.repeat(F.lit("0100"), n))).alias("data"))
    joined = sound.joined_wavs(pieces, ["conv_id"], "turn", resample=True)
    return joined.select("conv_id", ((F.octet_length("data") - 44) / 2).cast("long").alias("samples"), sound.wav_seconds("data").alias("seconds"))


# ---- state

_STATE = "(SELECT user_id AS book, event_type AS step, CASE WHEN json_extract_string(props, '$.k') = '0' THEN 'complete' ELSE 'item ' || json_extract_string(props, '$.k') END AS detail FROM events)"


@query(f"SELECT book, step, coalesce(bool_or(detail = 'complete'), FALSE) AS is_complete FROM {_STATE} GROUP BY 1, 2")
def step_complete(spark, d):
    return state.completed_steps(state_rows(spark, d), ["book"])


@query(f"SELECT DISTINCT book, step, detail FROM {_STATE} WHERE detail IS DISTINCT FROM 'complete'")
def completed_items(spark, d):
    return state.completed_items(state_rows(spark, d), ["book"])


@query(generator.sql(20, 7))
def generate_text(spark, d):
    return generator.generated_book(spark, 20, 7)


# ---- extensions: not of the reference


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*)::BIGINT AS n, sum((value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def ext_tumbling_windows(spark, d):
    return event_plans.tumbling(table(spark, d, "events"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hour THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""
)
def ext_session_windows(spark, d):
    return event_plans.sessions(table(spark, d, "events"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts <= e.ts) AS signup_ts FROM events e WHERE e.event_type = 'purchase'")
def ext_asof_signup(spark, d):
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    rows = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase")).withColumn("signup_ts", F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w))
    return rows.where("event_type = 'purchase'").select("event_id", "signup_ts")
