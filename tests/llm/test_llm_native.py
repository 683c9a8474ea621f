"""Rule cascade, line spread and URL trees on awkward rows."""

from llm_fixtures import LONG, ODD, docs, none
from pyspark.sql import functions as F

from panelweave.llm import line_spread, rule_cascade, url_filter


def test_counts_of_awkward_texts(spark):
    rows = {
        (r["doc_id"], r["text"]): r for r in rule_cascade.judge(docs(spark)).collect()
    }
    assert len(rows) == len(ODD) + 2
    for (_, text), row in rows.items():
        found = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
        assert row["n_words"] == len(found)
        assert row["word_chars"] == sum(map(len, found))
        windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
        twice = [i for i, w in enumerate(windows) if windows.count(w) > 1] if len(found) < 500 else None
        if twice is not None:
            assert row["n_repeat_words"] == len({j for i in twice for j in range(i, i + 8)})
        kept = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")]
        assert row["n_dup_lines"] == len(kept) - len(set(kept))
        assert row["rank"] == "r" and row["component.id"] == "c"
    assert rows[8, LONG]["n_words"] == 60_000


def test_cascade_is_the_verdict_in_any_order(spark):
    table = docs(spark)
    judged = rule_cascade.judge(table).where("kept").select("doc_id", "text")
    kept = rule_cascade.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted(
        map(tuple, judged.collect()), key=str
    )
    few = dict(list(rule_cascade.RULES.items())[::-1])
    assert rule_cascade.keep_good(table, rules=few).count() == kept.count()


def test_order_is_greedy_by_rejections_per_added_time():
    rules = {name: rule_cascade.RULES[name] for name in ("too_short", "repeats", "symbols", "shouting")}
    seconds = dict.fromkeys(rule_cascade.VALUES, 0.001)
    seconds |= {"pieces": 0.064, "n_repeat_words": 0.512, "n_upper": 0.004}
    #            short  repeats symbols shouting
    rejected = [(True, True, False, False)] * 8 + [(False, True, False, True)] * 2 + [(False, False, True, False)]
    # Shouting: 2 / 0.068; short: 8 / 0.064; then repeats has 2 left but is dear, symbols come cheap.
    order = rule_cascade.cascade_order(rejected, seconds, rules)
    assert order == ["too_short", "symbols", "shouting", "repeats"]
    assert rule_cascade.cascade_order([], seconds, rules) == list(rules)


def test_order_does_not_hang_on_file_order(spark):
    rows = [(i, "*** " * 30 if i % 2 else "plain words of no fault at all " * 8) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    picked = rule_cascade._sample(table, "text", 400)
    again = rule_cascade._sample(table.repartition(7), "text", 400)
    assert sorted(picked.collect()) == sorted(again.collect())
    assert 100 < picked.where("text like '***%'").count() < 300


def test_short_circuit_saves_work(spark):
    """Rejected rows never pay for the counts of later rules."""
    import time

    table = spark.createDataFrame(
        [(i, f"SHOUT{i} WORDS " * 200) for i in range(400)], "doc_id long, text string"
    ).persist()
    table.count()

    def least(make):
        runs = []
        for _ in range(3):
            frame = make()
            start = time.perf_counter()
            frame.agg(F.count("*")).collect()
            runs.append(time.perf_counter() - start)
        return min(runs)

    judged = least(lambda: rule_cascade.judge(table).where("kept and n_repeat_words >= 0 and n_dup_lines >= 0"))
    assert least(lambda: rule_cascade.keep_good(table)) < 0.5 * judged
    table.unpersist()


def test_order_prefers_rejections_per_cost(spark):
    table = spark.createDataFrame([(i, "*** " * 30) for i in range(20)], "doc_id long, text string")
    order = rule_cascade.rule_order(table)
    assert set(order[:2]) == {"symbols", "repeats"} or "symbols" in order[:3]
    assert set(order) == set(rule_cascade.RULES)


def test_empty_tables(spark):
    empty = none(spark)
    assert rule_cascade.judge(empty).count() == 0
    assert rule_cascade.keep_good(empty).count() == 0
    assert line_spread.remove_spread_lines(empty).count() == 0
    urls = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(urls).count() == 0


def spread_by_hand(rows, sites, least=3):
    where, keeper = {}, {}
    for doc_id, source, text in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if len([w for w in line.split(" ") if w]) >= least:
                where.setdefault(line, set()).add(source)
                if doc_id is not None:
                    keeper[line] = min(doc_id, keeper.get(line, doc_id))
    bad = {line for line, found in where.items() if len(found - {None}) >= sites}
    return bad, keeper


def test_lines_near_and_far_from_the_threshold(spark):
    rows = []
    for n_sites in (1, 2, 8, 9, 10, 11, 12, 40, 300):
        rows += [
            (1000 * n_sites + i, f"site{i}", f"own words number {n_sites} {i}\nspread over {n_sites} sites")
            for i in range(n_sites)
        ]
    rows += [(None, "site1", "spread over 40 sites"), (5, None, "spread over 9 sites"), (7, "z", None)]
    rows += [(8, "z", ""), (40_000, "site0", "spread over 40 sites"), (9, "q", "two words")] * 2
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    bad, keeper = spread_by_hand(rows, 10)
    assert len(bad) == 5
    found = line_spread.remove_spread_lines(table).collect()
    assert len(found) == len(rows)
    wanted = []
    for doc_id, source, text in rows:
        if text is None:
            wanted.append((doc_id, source, None))
            continue
        kept = [l for l in text.split("\n") if l not in bad or doc_id == keeper[l]]
        wanted.append((doc_id, source, "\n".join(kept)))
    assert sorted([tuple(r)[:3] for r in found], key=str) == sorted(wanted, key=str)
    dropped = line_spread.drop_boilerplate(table)
    assert dropped.columns == table.columns
    assert dropped.where("text = 'spread over 40 sites'").count() == 2  # both rows of the keeper
    assert dropped.where(F.col("doc_id").isNull()).count() == 0
    assert dropped.where("doc_id in (7, 8)").count() == 3


def test_short_lines_count(spark):
    rows = [(i, f"site{i}", f"Read more\nLes.\n\nown {i}\n \t") for i in range(12)]
    rows += [(20 + i, f"site{i}", "Log in") for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r["doc_id"]: r for r in line_spread.remove_spread_lines(table).collect()}
    assert found[0]["text"] == rows[0][2] and found[0]["n_removed"] == 0
    for i in range(1, 12):
        assert found[i]["text"] == f"\nown {i}\n \t"
        assert found[i]["n_lines"] == 5 and found[i]["n_removed"] == 2
    assert all(found[20 + i]["text"] == "Log in" for i in range(9))


def test_rows_without_ids_are_told_apart(spark):
    rows = [(None, f"site{i}", f"own {i}\nshared by all") for i in range(12)] + [(7, "site1", "shared by all\nseven")]
    rows += [(None, "site3", "own 3\nshared by all")]
    found = line_spread.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    texts = sorted(r["text"] for r in found.collect() if r["doc_id"] is None)
    assert texts == sorted([f"own {i}" for i in range(12)] + ["own 3"])
    assert found.where("doc_id = 7").first()["text"] == "shared by all\nseven"


def test_awkward_lines_stay(spark):
    table = docs(spark)
    found = line_spread.remove_spread_lines(table)
    assert found.where("n_removed > 0").count() == 0
    assert found.count() == table.count()


def test_urls(spark):
    urls = [
        (1, "https://A.Example.NET/en/x?q=/y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        (3, "http://notexample.com/de/1", "notexample.com", "/de/1", None, None),
        (4, "http://m.example.com/de/1#t", "m.example.com", "/de/1", "example.com/de/", "block"),
        (5, "http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        (6, "http://x.org/fr", "x.org", "/fr", None, None),
        (7, "http://x.net", "x.net", "", None, None),
        (8, "no scheme.net/", "", "", None, None),
        (9, None, "", "", None, None),
        (10, "", "", "", None, None),
        (11, "a://b.net/?x=http://c.org/fr/", "b.net", "/", "net/", "block"),
        (12, "http://x.net?/a", "x.net", "", None, None),
        (13, "http://h.net/" + "9" * 30_000, "h.net", "/" + "9" * 30_000, "net/", "block"),
        (1, "https://A.Example.NET/en/x?q=/y", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ]
    table = spark.createDataFrame(
        [(i, url, "clash", "x") for i, url, *_ in urls],
        "page_id long, url string, host string, `a.b` string",
    )
    judged = url_filter.judge_urls(table)
    assert set(judged.columns) == {"page_id", "url", "a.b", "host", "path", "rule", "verdict"}
    found = sorted(judged.collect(), key=lambda r: (r["page_id"], r["url"] or ""))
    for row, (i, url, host, path, rule, verdict) in zip(found, sorted(urls, key=lambda u: (u[0], u[1] or ""))):
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    bad = [(f"http://win{i}.casino{i % 7}77.top/x{i}?a={i}&b={i}&c=1", "block") for i in range(120)]
    good = [(f"https://www.paper.org/news/story-{'abc'[i % 3]}{i}", "allow") for i in range(120)]
    labels = spark.createDataFrame(bad[:80] + good[:80], "url string, verdict string")
    held = spark.createDataFrame(bad[80:] + good[80:], "url string, wanted string")
    judged = url_filter.judge_urls(held, labels=labels, rules=())
    assert judged.where("verdict = wanted").count() >= 76


def test_every_labelled_suffix_counts(spark):
    """More suffixes than any bound that a table of them once had, each with its own verdict."""
    rows = [(f"http://h{i}.s{s}/p", "block" if s % 2 else "allow") for s in range(1500) for i in range(3)]
    labels = spark.createDataFrame(rows, "url string, verdict string")
    labelled = labels.select(F.col("url").alias("_url"), (F.col("verdict") == "block").cast("double").alias("_url_label"))
    assert url_filter.suffix_statistics(labelled).count() == 1500
    held = spark.createDataFrame(
        [(f"http://new.s{s}/q", "block" if s % 2 else "allow") for s in range(1500)], "url string, wanted string"
    )
    judged = url_filter.judge_urls(held, labels=labels, rules=())
    assert judged.where("verdict = wanted").count() > 1400


def test_one_kind_of_label(spark):
    table = spark.createDataFrame([(1, "http://a.net/"), (2, "http://a.com/")], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge_urls(table).collect()} == {"block"}


def test_lexical_features(spark):
    row = spark.createDataFrame([("http://ab.cc/1?x=1&y=2",)], "url string").select(
        *[
            value.cast("double").alias(name)
            for name, value in url_filter.lexical_features(
                F.col("url"), url_filter.host(F.col("url")), url_filter.path(F.col("url"))
            ).items()
        ]
    ).first()
    assert row["parameters"] == 2 and row["host_depth"] == 1 and row["url_length"] == 22
    assert abs(row["host_entropy"] - 1.9219280948873623) < 1e-12
    assert row["digit_ratio"] == 3 / 22
