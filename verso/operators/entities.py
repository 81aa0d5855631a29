"""Characters: ordered merge, alias groups, duplicates. Tables have a key of the book (any columns) and a character id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.functions.text import normalize_for_comparison


def merge_characters(rows: DataFrame, book: list[str], char_id: str = "char_id", pos: str = "pos", name: str = "name", details: str = "details") -> DataFrame:
    """One row per character: the first name, all details joined by a blank in order, the first position."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(details).alias("d"))))
    return rows.groupBy(*book, char_id).agg(
        F.min_by(name, pos).alias("name"), F.array_join(F.transform(ordered, lambda x: x["d"]), " ").alias("bio"), F.min(pos).alias("first_pos"),
    )


def alias_map(groups: DataFrame, characters: DataFrame, book: list[str]) -> DataFrame:
    """groups: book, group_no, member_no, char_id. Maps each known member to its group's longest known id (the first on a tie).

    A later group overrides an earlier one; the map has one step and isn't transitive.
    """
    known = groups.join(characters.select(*book, "char_id").distinct(), [*book, "char_id"], "left_semi")
    best = known.groupBy(*book, "group_no").agg(F.max_by("char_id", F.struct(F.length("char_id"), -F.col("member_no"))).alias("canonical"))
    return known.join(best, [*book, "group_no"]).groupBy(*book, "char_id").agg(F.max_by("canonical", "group_no").alias("canonical"))


def fold_aliases(characters: DataFrame, aliases: DataFrame, book: list[str]) -> DataFrame:
    """Characters under their canonical ids: the longest name (the earliest on a tie), and each biography that the text so far doesn't hold."""
    rows = characters.join(aliases, [*book, "char_id"], "left").withColumn("char_id", F.coalesce("canonical", "char_id"))
    bios = F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "bio"))), lambda x: x["bio"])
    folded = F.aggregate(F.slice(bios, 2, F.greatest(F.size(bios), F.lit(1))), F.get(bios, 0), lambda acc, b: F.when(F.contains(acc, b), acc).otherwise(F.concat_ws(" ", acc, b)))
    return rows.groupBy(*book, "char_id").agg(F.max_by("name", F.struct(F.length("name"), -F.col("first_pos"))).alias("name"), folded.alias("bio"), F.min("first_pos").alias("first_pos"))


def apply_known_aliases(characters: DataFrame, aliases: DataFrame, invalid: list[str], book: list[str]) -> DataFrame:
    """aliases: (alias, canonical). Where both exist the alias' biography goes to the canonical row and the alias goes; then ids in `invalid` go."""
    ids = characters.select(*book, F.col("char_id"))
    both = ids.join(aliases, ids["char_id"] == aliases["alias"]).drop("char_id")
    both = both.join(ids.withColumnRenamed("char_id", "canonical"), [*book, "canonical"])
    extra = both.join(characters.select(*book, F.col("char_id").alias("alias"), "bio"), [*book, "alias"])
    extra = extra.groupBy(*book, "canonical").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alias", "bio"))), lambda x: x["bio"]), " ").alias("more"))
    kept = characters.join(both.select(*book, F.col("alias").alias("char_id")), [*book, "char_id"], "left_anti").where(~F.col("char_id").isin(invalid) if invalid else F.lit(True))
    kept = kept.join(extra.withColumnRenamed("canonical", "char_id"), [*book, "char_id"], "left")
    return kept.withColumn("bio", F.concat_ws(" ", "bio", "more")).drop("more")


def duplicate_pairs(characters: DataFrame, book: list[str]) -> DataFrame:
    """Pairs (a, b), a before b, of a book whose comparable ids are equal, or of which one id holds the other (narrator aside)."""
    rows = characters.select(*book, "char_id", F.col("first_pos").alias("pos"), normalize_for_comparison(F.col("char_id")).alias("norm"))
    left = rows.select(*book, F.col("char_id").alias("a"), F.col("pos").alias("pos_a"), F.col("norm").alias("norm_a"))
    right = rows.select(*book, F.col("char_id").alias("b"), F.col("pos").alias("pos_b"), F.col("norm").alias("norm_b"))
    inside = (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))) & (F.col("a") != "narrator") & (F.col("b") != "narrator")
    return left.join(right, book).where((F.struct("pos_a", "a") < F.struct("pos_b", "b")) & ((F.col("norm_a") == F.col("norm_b")) | inside)).select(*book, "a", "b")


def upsert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """rows with those of `new` in place of rows of equal keys."""
    return rows.join(new.select(*key), key, "left_anti").unionByName(new)
