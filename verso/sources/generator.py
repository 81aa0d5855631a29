"""Seeded generated books: weighted words, sentences, paragraphs and chapters, as Spark rows. A draw is a whole number from a hash of its place, so any part can be made by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Word forms, sentence ends, sentence lengths and breaks inside sentences, with their weights; sizes of a book.
FORMS = [("Jeff", 70), ("jeff", 18), ("JEFF", 6), ("Jeff", 6)]
ENDINGS = [(".", 30), ("!", 14), ("?", 12), ("...", 8), ("?!", 5), ("!!", 4), ("—", 3), ("!?", 3), (".", 20), ("?!?", 2), ("…", 4)]
LENGTHS = [(1, 4), (2, 9), (3, 11), (4, 11), (5, 9), (6, 6), (7, 4), (8, 3), (10, 2), (12, 1)]
BREAKS = [(",", 14), (" —", 6), ("...", 4), ("", 76)]
WORDS_PER_PAGE, SENTENCES_PER_PARAGRAPH, CHAPTERS = 300, (3, 8), 12


def _draw(*place: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 that depends on the place alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in place))), 1, 8), 16, 10).cast("long")


def _weighted(draw: Column, pairs: list[tuple]) -> Column:
    upto, out, at = 0, None, F.pmod(draw, F.lit(sum(w for _, w in pairs)))
    for value, w in pairs:
        upto += w
        out = F.when(at < upto, F.lit(value)) if out is None else out.when(at < upto, F.lit(value))
    return out


def sentence(*place: Column) -> Column:
    def of(n: Column) -> Column:
        def word(i: Column) -> Column:
            form = _weighted(_draw(*place, i, F.lit("w")), FORMS)
            form = F.when((i == 0) & (form == "jeff"), F.lit("Jeff")).otherwise(form)
            return F.concat(form, F.when(i < n - 1, _weighted(_draw(*place, i, F.lit("b")), BREAKS)).otherwise(""))

        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")

    body = F.element_at(F.transform(F.array(_weighted(_draw(*place, F.lit("n")), LENGTHS)), of), 1)
    return F.concat(body, _weighted(_draw(*place, F.lit("e")), ENDINGS))


def sizes(pages: int) -> tuple[int, int, int, int]:
    """Words of a book and of a chapter, and bounds of its chapters and of a chapter's paragraphs."""
    target = pages * WORDS_PER_PAGE
    own = max(WORDS_PER_PAGE, target // CHAPTERS)
    return target, own, -(-target // own), -(-own // SENTENCES_PER_PARAGRAPH[0])


def generated_book(spark: SparkSession, pages: int, seed: int) -> DataFrame:
    """(chapter, paragraph, text, words) of a book of pages * WORDS_PER_PAGE words, the last paragraph included.

    A paragraph has 3 to 8 sentences. A chapter ends with the paragraph that reaches its words, the book with the one that
    reaches the target. Paragraphs are drawn by themselves; running words need a window per chapter and one over the chapters.
    """
    target, own, chapters, most = sizes(pages)
    low, high = SENTENCES_PER_PARAGRAPH
    c, p, s = F.col("chapter"), F.col("paragraph"), F.lit(seed)
    rows = spark.range(chapters * most).select((F.col("id") / most).cast("int").alias("chapter"), (F.col("id") % most).cast("int").alias("paragraph"))
    n = F.pmod(_draw(s, c, p, F.lit("s")), F.lit(high - low + 1)) + low
    rows = rows.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: sentence(s, c, p, i)), " "))
    rows = rows.withColumn("words", F.size(F.split("text", " ")))
    before = W.partitionBy("chapter").orderBy("paragraph").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).where(F.col("before") < own)
    totals = rows.groupBy("chapter").agg(F.sum("words").alias("total"))
    earlier = totals.select("chapter", F.coalesce(F.sum("total").over(W.orderBy("chapter").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # a row per chapter
    return rows.join(earlier, "chapter").where(F.col("earlier") + F.col("before") < target).select((c + 1).alias("chapter"), (p + 1).alias("paragraph"), "text", "words")


def _sql_weighted(draw: str, pairs: list[tuple]) -> str:
    upto, cases = 0, []
    for value, w in pairs:
        upto += w
        cases.append(f"WHEN {draw} % {sum(x for _, x in pairs)} < {upto} THEN {value!r}")
    return f"CASE {' '.join(cases)} END"


def sql(pages: int, seed: int) -> str:
    """DuckDB SQL for generated_book()."""
    target, own, chapters, most = sizes(pages)
    low, high = SENTENCES_PER_PARAGRAPH
    draw = lambda *place: f"('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(place)})), 1, 8))::BIGINT"
    n = _sql_weighted(draw("c", "p", "i", "'n'"), LENGTHS)
    form = _sql_weighted(draw("c", "p", "i", "k", "'w'"), FORMS)
    word = f"(CASE WHEN k = 0 AND {form} = 'jeff' THEN 'Jeff' ELSE {form} END) || (CASE WHEN k < n - 1 THEN {_sql_weighted(draw('c', 'p', 'i', 'k', chr(39) + 'b' + chr(39)), BREAKS)} ELSE '' END)"
    return f"""
    WITH a AS (SELECT c, p, {low} + {draw("c", "p", "'s'")} % {high - low + 1} AS s FROM range({chapters}) x(c), range({most}) y(p)),
    b AS (SELECT c, p, i, {n} AS n, {_sql_weighted(draw("c", "p", "i", "'e'"), ENDINGS)} AS ending FROM (SELECT c, p, unnest(range(s)) AS i FROM a)),
    w AS (SELECT c, p, i, ending, k, {word} AS word FROM (SELECT c, p, i, n, ending, unnest(range(n)) AS k FROM b)),
    t AS (SELECT c, p, i, string_agg(word, ' ' ORDER BY k) || any_value(ending) AS sentence FROM w GROUP BY c, p, i),
    q AS (SELECT c, p, string_agg(sentence, ' ' ORDER BY i) AS text FROM t GROUP BY c, p),
    r AS (SELECT *, len(string_split(text, ' ')) AS words FROM q),
    u AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
    v AS (SELECT * FROM u WHERE before < {own}),
    e AS (SELECT c, coalesce(sum(total) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM (SELECT c, sum(words) AS total FROM v GROUP BY c))
    SELECT (c + 1)::INT AS chapter, (p + 1)::INT AS paragraph, text, words::INT AS words FROM v JOIN e USING (c) WHERE earlier + before < {target}"""
