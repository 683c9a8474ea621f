"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Counts of a text (words are runs of ``[^\\x20\\x09-\\x0D]``): ``n_words``,
``word_chars`` (code points in words), ``n_symbols`` (characters of
``[#*$%&|<>]``), ``n_lines`` (lines with a word), ``n_dup_lines`` (those equal to
an earlier one), ``n_upper`` (A-Z), ``n_repeat_words`` (words inside 8-word windows
that occur at least twice, the first one included).

A rule rejects when its expression is true. The verdict is "no rule rejects" in
any order; the order only decides which rules are evaluated. Each count, and each
list of words or lines behind it, is computed once a row, when the first rule asks for
it. NULL and empty texts have no words and are rejected. Extra columns are kept; a
column whose name starts with ``_rule`` is reserved. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.expressions import named

# The characters counted as symbols, and the words of a window.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    """The text cut at every space and 0x09-0x0D: words, and empty pieces between."""
    return F.split(text, r"[ \t\n\x0B\f\r]")


def filled(found: Column) -> Column:
    return F.filter(found, lambda piece: piece != "")


def words(text: Column) -> Column:
    return filled(pieces(text))


def word_chars(text: Column, found: Column) -> Column:
    return (F.length(text) - (F.size(found) - 1)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long")


def n_upper(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))


def count(found: Column) -> Column:
    return F.size(found).cast("long")


def n_dup_lines(found: Column) -> Column:
    return (F.size(found) - F.size(F.array_distinct(found))).cast("long")


def n_repeat_words(found: Column) -> Column:
    """Words covered by windows of eight words that occur twice or more in the text.

    Windows are compared by 64-bit keys. Texts without a repeated window, nearly
    all, stop after one pass through a hash set; only the rest sort their windows.
    """

    def covered(windows: Column) -> Column:
        placed = F.transform(windows, lambda key, at: F.struct(key.alias("key"), at.alias("at")))

        def places(ordered: Column) -> Column:
            def repeated(item: Column, at: Column) -> Column:
                before = F.get(ordered, at - 1)["key"]
                after = F.get(ordered, at + 1)["key"]
                same = F.coalesce(before == item["key"], F.lit(False)) | F.coalesce(
                    after == item["key"], F.lit(False)
                )
                return F.when(same, item["at"])

            return F.array_sort(F.filter(F.transform(ordered, repeated), lambda at: at.isNotNull()))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            let(F.array_sort(placed), places),
            start,
            lambda so_far, at: F.struct(
                (so_far["n"] + F.least(F.lit(WINDOW), at - so_far["last"])).alias("n"),
                at.alias("last"),
            ),
            lambda done: done["n"],
        )

    def windows(keys: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(keys) - WINDOW + 1),
            lambda at: F.xxhash64(F.slice(keys, at, WINDOW)),
        )

    def counted(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(
            covered(keys)
        )

    word_keys = F.transform(found, lambda word: F.xxhash64(word))
    return (
        F.when(F.size(found) < WINDOW, F.lit(0))
        .otherwise(let(word_keys, lambda keys: let(windows(keys), counted)))
        .cast("long")
    )


#: Every value that rules ask for, with the values it is made of; ``text`` is given.
VALUES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "pieces": (("text",), pieces),
    "words": (("pieces",), filled),
    "lines": (("text",), lines),
    "n_words": (("words",), count),
    "word_chars": (("text", "pieces"), word_chars),
    "n_symbols": (("text",), n_symbols),
    "n_lines": (("lines",), count),
    "n_dup_lines": (("lines",), n_dup_lines),
    "n_upper": (("text",), n_upper),
    "n_repeat_words": (("words",), n_repeat_words),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


def with_values(
    names: tuple[str, ...], known: dict[str, Column], body: Callable[[dict[str, Column]], Column]
) -> Column:
    """``body`` of the known values and ``names``, each missing one computed once, here."""
    for name in names:
        if name in known:
            continue
        needs, make = VALUES[name]
        if all(need in known for need in needs):
            value = make(*[known[need] for need in needs])
            return let(value, lambda found: with_values(names, known | {name: found}, body))
        return with_values(needs, known, lambda more: with_values(names, more, body))
    return body(known)


Rule = tuple[tuple[str, ...], Callable[..., Column]]

BASE_RULES: dict[str, Rule] = {
    "too_short": (("n_words",), lambda words: words < 20),
    "repeats": (("n_repeat_words", "n_words"), lambda repeat, words: 100 * repeat > 30 * words),
}
RULES: dict[str, Rule] = BASE_RULES | {
    "symbols": (("n_symbols", "n_words"), lambda symbols, words: 100 * symbols > 15 * words),
    "dup_lines": (("n_dup_lines", "n_lines"), lambda dup, lines: 100 * dup > 50 * lines),
    "word_length": (
        ("word_chars", "n_words"),
        lambda chars, words: (chars < 2 * words) | (chars > 20 * words),
    ),
    "shouting": (("n_upper", "word_chars"), lambda upper, chars: 100 * upper > 40 * chars),
}


def rejects(rule: Rule, counts: Callable[[str], Column]) -> Column:
    names, test = rule
    return test(*[counts(name) for name in names])


def passes(order: list[str], rules: dict[str, Rule], known: dict[str, Column]) -> Column:
    """True where no rule rejects; after the first that does, nothing more is computed."""
    if not order:
        return F.lit(True)
    rule = rules[order[0]]
    return with_values(
        rule[0],
        known,
        lambda more: F.when(rejects(rule, more.get), F.lit(False)).otherwise(
            passes(order[1:], rules, more)
        ),
    )


def _text(text: str) -> Column:
    return F.coalesce(named(text), F.lit(""))


def _sample(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` rows by a hash of all their columns, wherever they lie.

    Each task keeps its share, so as little as the sample itself moves. Equal rows are
    in or out together; beyond twice the number the rest is left.
    """
    n = docs.count()
    hashed = [
        named(field.name)
        for field in docs.schema.fields
        if isinstance(field.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType))
    ]
    chosen = docs.where(F.pmod(F.xxhash64(*hashed), F.lit(max(n, 1))) < rows)
    return chosen.select(_text(text).alias("text")).limit(2 * rows)


def cascade_order(
    rejected: list[tuple[bool, ...]], seconds: dict[str, float], rules: dict[str, Rule]
) -> list[str]:
    """Greedily, the rule that rejects most of the rows left per second it adds.

    ``rejected`` has a row per sampled text and a flag per rule. A rule adds the time of
    the values that no earlier rule has computed; times count by powers of two, so that
    noise does not change the order. Ties keep the given order.
    """

    def behind(names: tuple[str, ...]) -> set[str]:
        found = set(names) - {"text"}
        for name in list(found):
            found |= behind(VALUES[name][0])
        return found

    place = {name: at for at, name in enumerate(rules)}
    left, order, computed, rows = list(rules), [], set(), rejected
    while left:

        def worth(name: str) -> float:
            fresh = behind(rules[name][0]) - computed
            price = max(sum(seconds[one] for one in fresh), 1e-4)
            return sum(row[place[name]] for row in rows) / 2.0 ** round(math.log2(price))

        best = max(left, key=worth)
        rows = [row for row in rows if not row[place[best]]]
        computed |= behind(rules[best][0])
        order.append(best)
        left.remove(best)
    return order


def rule_order(
    docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = 1000
) -> list[str]:
    """Rule names for :func:`keep_good`, from a sample of about ``sample_rows`` rows.

    The sample only orders the rules, it never decides a row. A value's time is the
    least of three runs over the sample, less that of the values it is made of. An
    empty table keeps the given order.
    """
    sample = _sample(docs, text, sample_rows).persist()
    try:
        known = {"text": F.col("text")}
        flags = [
            with_values(rule[0], known, lambda more, rule=rule: rejects(rule, more.get)).alias(name)
            for name, rule in rules.items()
        ]
        rejected = [tuple(row) for row in sample.select(*flags).collect()]
        if not rejected:
            return list(rules)

        def timed(value: Column) -> float:
            start = time.perf_counter()
            sample.agg(F.max(F.xxhash64(value))).collect()
            return time.perf_counter() - start

        def least(value: Column) -> float:
            return min(timed(value) for _ in range(3))

        total = {"text": least(F.length("text"))}
        seconds = {}
        for name, (needs, _) in VALUES.items():
            total[name] = least(with_values((name,), known, lambda more, name=name: more[name]))
            seconds[name] = max(total[name] - max(total[need] for need in needs), 0.0)
    finally:
        sample.unpersist()
    return cascade_order(rejected, seconds, rules)


def keep_good(
    docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = 1000
) -> DataFrame:
    """The rows that no rule rejects, columns as they are.

    Rules run in the order of :func:`rule_order`; one that rejects ends the row, so
    later counts are never taken for it.
    """
    order = rule_order(docs, text, rules, sample_rows)
    return docs.where(let(_text(text), lambda given: passes(order, rules, {"text": given})))


def judge(
    docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = 1000
) -> DataFrame:
    """Every row with its counts, ``base_failed`` and ``kept``.

    ``kept`` takes the rules in the order of :func:`rule_order` over the counts.
    """
    order = rule_order(docs, text, rules, sample_rows)

    def gather(more: dict[str, Column]) -> Column:
        return F.struct(*[more[name].alias(name) for name in COUNTS])

    counts = let(_text(text), lambda given: with_values(COUNTS, {"text": given}, gather))
    counted = docs.withColumn("_rule_counts", counts)
    counted = counted.withColumns({name: F.col("_rule_counts")[name] for name in COUNTS})
    base = F.lit(False)
    for rule in BASE_RULES.values():
        base = base | rejects(rule, F.col)
    kept = passes(order, rules, {name: F.col(name) for name in COUNTS})
    return counted.withColumns({"base_failed": base, "kept": ~base & kept}).drop("_rule_counts")
