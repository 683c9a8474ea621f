"""URL verdicts: host and path rules first, boosted trees on lexical features for the rest.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path goes on to ``?``, ``#`` or the end. A NULL URL or one without
``://`` has an empty host and path. A rule ``host/path`` fits its host and all its
subdomains where the path starts with the rule's path; the longest rule wins.

The trees learn from labelled URLs: a table with ``url`` and ``verdict``. Where the
caller has none, the URLs that a rule decides are the labelled ones. Without both
verdicts among them, every URL gets the only verdict there is, or ``allow``. Extra
columns are kept; names that start with ``_url`` are reserved. All of it is
DataFrame and Spark ML code.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.storage import materialize
from panelweave.llm.rule_cascade import let

ALLOW, BLOCK = "allow", "block"
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))
# Rows the trees are fitted on at most: the first by hash of the URL.
MAX_TRAIN_ROWS = 10_000


def url_part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", group), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(url_part(url, 1), ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    return url_part(url, 2)


def rule_of(
    host_col: Column, path_col: Column, rules: tuple[tuple[str, str], ...] = RULES
) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else NULL."""
    fitting = F.when(F.lit(False), F.lit(None))
    for rule, verdict in sorted(rules, key=lambda item: -len(item[0])):
        domain, _, below = rule.partition("/")
        fits = ((host_col == domain) | F.endswith(host_col, F.lit("." + domain))) & F.startswith(
            path_col, F.lit("/" + below)
        )
        fitting = fitting.when(
            fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        )
    return fitting.cast("struct<rule:string,verdict:string>")


def share(text: Column, characters: str) -> Column:
    """Part of ``text`` made of ``characters``; 0 for an empty text."""
    left = F.length(F.translate(text, characters, ""))
    return F.coalesce(F.try_divide(F.length(text) - left, F.length(text)), F.lit(0.0))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def entropy(text: Column) -> Column:
    """Bits per character of the text's character distribution; 0 for an empty text."""

    def bits(characters: Column) -> Column:
        total = F.size(characters).cast("double")
        return F.aggregate(
            F.array_distinct(characters),
            F.lit(0.0),
            lambda so_far, one: so_far
            - let(
                F.size(F.filter(characters, lambda other: other == one)) / total,
                lambda part: part * F.log2(part),
            ),
        )

    characters = F.filter(F.split(text, ""), lambda one: one != "")
    return let(
        characters, lambda found: F.when(F.size(found) == 0, F.lit(0.0)).otherwise(bits(found))
    )


DIGITS = "0123456789"


def lexical_features(url: Column, host_col: Column, path_col: Column) -> dict[str, Column]:
    """Numbers that depend on the URL's text alone."""
    text = F.coalesce(url, F.lit(""))
    return {
        "url_length": F.length(text),
        "host_length": F.length(host_col),
        "path_length": F.length(path_col),
        "host_depth": count_of(host_col, r"\."),
        "path_depth": count_of(path_col, "/"),
        "digit_ratio": share(text, DIGITS),
        "host_digit_ratio": share(host_col, DIGITS),
        "hyphens": count_of(host_col, "-"),
        "host_entropy": entropy(host_col),
        "path_entropy": entropy(path_col),
        "parameters": count_of(text, r"[?&][^=&#]*="),
        "escapes": count_of(text, "%[0-9A-Fa-f]{2}"),
        "secure": F.startswith(F.lower(text), F.lit("https://")).cast("int"),
        "suffix_length": F.length(suffix(host_col)),
    }


def suffix(host_col: Column) -> Column:
    """What follows the last dot of the host, the whole host without one."""
    return F.substring_index(host_col, ".", -1)


def _featured(urls: DataFrame, url: str, statistics: DataFrame | None) -> DataFrame:
    parts = urls.withColumns({"_url_host": host(F.col(url)), "_url_path": path(F.col(url))})
    features = lexical_features(F.col(url), F.col("_url_host"), F.col("_url_path"))
    parts = parts.withColumns(
        {f"_url_{name}": made.cast("double") for name, made in features.items()}
    ).withColumn("_url_suffix", suffix(F.col("_url_host")))
    if statistics is None:
        return parts
    # No hint: a table of any size, broadcast while it is small, else shuffled.
    return parts.join(statistics, "_url_suffix", "left").withColumns(
        {
            "_url_suffix_blocked": F.coalesce("_url_suffix_blocked", F.lit(0.5)),
            "_url_suffix_rows": F.coalesce("_url_suffix_rows", F.lit(0.0)),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Blocked share (add-one smoothed) and log count of labelled URLs, for every suffix."""
    return labelled.groupBy(suffix(host(F.col("_url"))).alias("_url_suffix")).agg(
        ((F.sum("_url_label") + 1) / (F.count(F.lit(1)) + 2)).alias("_url_suffix_blocked"),
        F.log1p(F.count(F.lit(1))).alias("_url_suffix_rows"),
    )


def predictors(frame: DataFrame) -> list[str]:
    numbers = [name for name, kind in frame.dtypes if name.startswith("_url_") and kind == "double"]
    return sorted(set(numbers) - {"_url_label"})


def fit_trees(labelled: DataFrame, statistics: DataFrame) -> tuple[GBTClassificationModel | None, str]:
    """Trees from ``(_url, _url_label)``; the verdict to give everywhere if there are none."""
    kinds = {row[0] for row in labelled.select("_url_label").distinct().collect()}
    if len(kinds) < 2:
        return None, BLOCK if kinds == {1.0} else ALLOW
    sample = labelled.orderBy(F.xxhash64("_url"), "_url").limit(MAX_TRAIN_ROWS)
    rows = _featured(sample, "_url", statistics)
    assembler = VectorAssembler(inputCols=predictors(rows), outputCol="_url_features")
    rows = assembler.transform(rows).select("_url_features", "_url_label").persist()
    try:
        trees = GBTClassifier(
            featuresCol="_url_features", labelCol="_url_label", maxIter=15, maxDepth=4, seed=7
        ).fit(rows)
    finally:
        rows.unpersist()
    return trees.setPredictionCol("_url_blocked"), ALLOW


def judge_urls(
    urls: DataFrame,
    url: str = "url",
    labels: DataFrame | None = None,
    rules: tuple[tuple[str, str], ...] = RULES,
) -> DataFrame:
    """Every row with ``host``, ``path``, ``rule`` and ``verdict``.

    The verdict is the rule's, else the trees'. Result columns replace columns of
    the same name.
    """
    if labels is None:
        decided = urls.select(F.col(f"`{url}`").alias("_url")).withColumn(
            "_url_verdict", rule_of(host(F.col("_url")), path(F.col("_url")), rules)["verdict"]
        )
    else:
        decided = labels.select(F.col("url").alias("_url"), F.col("verdict").alias("_url_verdict"))
    labelled = decided.where(F.col("_url_verdict").isNotNull()).select(
        "_url", (F.col("_url_verdict") == BLOCK).cast("double").alias("_url_label")
    )
    statistics = materialize(suffix_statistics(labelled), "url-suffixes")
    trees, only = fit_trees(labelled, statistics)

    results = ("host", "path", "rule", "verdict")
    kept = [F.col(f"`{name}`") for name in urls.columns if name not in results]
    rows = _featured(urls.withColumn("_url", F.col(f"`{url}`")), "_url", statistics)
    if trees is None:
        judged = rows.withColumn("_url_judged", F.lit(only))
    else:
        assembler = VectorAssembler(inputCols=predictors(rows), outputCol="_url_features")
        scored = trees.transform(assembler.transform(rows))
        judged = scored.withColumn(
            "_url_judged", F.when(F.col("_url_blocked") == 1.0, BLOCK).otherwise(ALLOW)
        )
    ruled = judged.withColumn("_url_ruled", rule_of(F.col("_url_host"), F.col("_url_path"), rules))
    return ruled.select(
        *kept,
        F.col("_url_host").alias("host"),
        F.col("_url_path").alias("path"),
        F.col("_url_ruled.rule").alias("rule"),
        F.coalesce("_url_ruled.verdict", "_url_judged").alias("verdict"),
    )
