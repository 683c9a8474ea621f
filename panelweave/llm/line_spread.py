"""Lines that spread over many sites, found with one HyperLogLog sketch per line hash.

Every line with a word counts (``min_words`` raises that floor); blank lines stay. Its
spread is the number of distinct sites it occurs on. Sketches of sites are merged by
aggregation; lines whose estimate is near the threshold get an exact distinct count, so the decision
is exact. A line on ``min_sites`` sites or more is boilerplate: it is removed from
every document but the one with the smallest id that has it, so no passage leaves
the corpus altogether.

Lines are compared whole, by 64-bit hash. NULL texts stay NULL, a NULL site is no
site, rows without an id never hold the remaining copy, repeated ids are treated
alike. Extra columns are kept; names that start with ``_line`` are reserved. All of
it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.storage import materialize
from panelweave.llm.rule_cascade import words

MIN_SITES = 10
MIN_WORDS = 1
# log2 of the sketch's registers; the relative error is about 1.04 / sqrt(2**12).
SKETCH_BITS = 12
ERRORS = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def counted(line: Column, min_words: int) -> Column:
    if min_words <= 1:
        return line.rlike(r"[^ \t\n\x0B\f\r]")
    return F.size(words(line)) >= min_words


def _row_without_id(id_col: str, text: str) -> Column:
    """Tells rows without an id apart, NULL for all others."""
    return F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.col(f"`{text}`")))


def _occurrences(docs: DataFrame, id_col: str, site: str, text: str, min_words: int) -> DataFrame:
    """``(_line, _line_site, _line_id, _line_row)`` of every line that counts."""
    exploded = docs.select(
        F.col(f"`{id_col}`").alias("_line_id"),
        _row_without_id(id_col, text).alias("_line_row"),
        F.col(f"`{site}`").alias("_line_site"),
        F.explode(F.split(f"`{text}`", "\n")).alias("_line_text"),
    )
    return exploded.where(counted(F.col("_line_text"), min_words)).select(
        line_hash(F.col("_line_text")).alias("_line"), "_line_site", "_line_id", "_line_row"
    )


def spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    site: str = "source",
    text: str = "text",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``(_line, _line_keeper)``: hashes of boilerplate lines and the id that keeps each.

    One shuffle carries a sketch per line and task; a hot line is merged before it
    moves. Only lines near the threshold are read again for the exact count.
    """
    occurrences = _occurrences(docs, id_col, site, text, min_words)
    near_low, near_high = min_sites * (1 - ERRORS) - 1, min_sites * (1 + ERRORS) + 1
    sketched = occurrences.groupBy("_line").agg(
        F.hll_sketch_estimate(
            F.hll_sketch_agg(F.col("_line_site").cast("string"), F.lit(SKETCH_BITS))
        ).alias("_line_sites"),
        F.min("_line_id").alias("_line_keeper"),
    )
    candidates = materialize(sketched.where(F.col("_line_sites") >= near_low), "line-spread")
    sure = candidates.where(F.col("_line_sites") > near_high).select("_line", "_line_keeper")
    near = candidates.where(F.col("_line_sites") <= near_high).select("_line", "_line_keeper")
    exact = (
        occurrences.join(near.select("_line"), "_line", "left_semi")
        .groupBy("_line")
        .agg(F.count_distinct("_line_site").alias("_line_sites"))
        .where(F.col("_line_sites") >= min_sites)
    )
    return sure.unionByName(near.join(exact.select("_line"), "_line", "left_semi"))


def remove_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    site: str = "source",
    text: str = "text",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """All rows, boilerplate lines taken out of ``text``; adds ``n_lines`` and ``n_removed``.

    The lines to remove are gathered by document id (rows without one by their text),
    at most the boilerplate lines that occur under it, and joined back; texts move only if that side is too
    large to broadcast.
    """
    found = materialize(
        spread_lines(docs, id_col, site, text, min_sites, min_words), "boilerplate-lines"
    )
    affected = (
        _occurrences(docs, id_col, site, text, min_words)
        .join(found, "_line")
        .where(~F.col("_line_id").eqNullSafe(F.col("_line_keeper")))
        .groupBy("_line_id", "_line_row")
        .agg(F.collect_set("_line").alias("_line_bad"))
    )
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_line_id")) & _row_without_id(id_col, text).eqNullSafe(
        F.col("_line_row")
    )
    joined = docs.join(affected, same, "left")
    parts = F.split(f"`{text}`", "\n")
    # Lines that stay, found once; NULL where nothing is to go.
    staying = F.when(
        F.col("_line_bad").isNotNull() & F.col(f"`{text}`").isNotNull(),
        F.filter(
            parts,
            lambda line: ~(
                F.array_contains(F.col("_line_bad"), line_hash(line)) & counted(line, min_words)
            ),
        ),
    )
    joined = joined.withColumn("_line_staying", staying)
    staying = F.col("_line_staying")
    kept = F.coalesce(F.array_join(staying, "\n"), F.col(f"`{text}`"))
    removed = F.size(parts) - F.size(staying)
    return joined.select(
        *[
            (kept if name == text else F.col(f"`{name}`")).alias(name)
            for name in docs.columns
        ],
        F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(staying.isNull(), 0)
        .otherwise(removed)
        .cast("long")
        .alias("n_removed"),
    )


def drop_boilerplate(docs: DataFrame, **settings) -> DataFrame:
    """:func:`remove_spread_lines` without its counts; rows left without any word go.

    Such a row consisted of boilerplate alone, and each of its lines still stands
    in another document. Rows that had no word to begin with stay.
    """
    text = settings.get("text", "text")
    cleaned = remove_spread_lines(docs, **settings)
    emptied = (F.col("n_removed") > 0) & (F.size(words(F.col(f"`{text}`"))) == 0)
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(
        *[f"`{name}`" for name in docs.columns]
    )
