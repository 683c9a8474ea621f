"""One registered query per operator, over its whole table, with SQL checks where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.storage import scratch_path
from panelweave.llm import (
    adaptive_scan,
    bbit_minhash,
    ftrl_quality,
    kneser_ney,
    line_spread,
    piece_sampling,
    pivot_clusters,
    recurrent_lm,
    rule_cascade,
    soft_mixing,
    token_store,
    turn_repair,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_url_trees")
def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


LINES_CHECK = f"""
WITH lines AS (
  SELECT doc_id, source, pos, line,
         len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) >= {line_spread.MIN_WORDS} AS counted
  FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents
  )
), spread AS (
  SELECT line, min(doc_id) AS keeper
  FROM lines WHERE counted
  GROUP BY line HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}
), marked AS (
  SELECT l.*, coalesce(l.counted AND s.line IS NOT NULL AND l.doc_id <> s.keeper, false) AS gone
  FROM lines l LEFT JOIN spread s USING (line)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
"""


@query("op7_line_spread", LINES_CHECK)
def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_spread.remove_spread_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5")
    )


RULES_CHECK = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM parts WHERE len(words) >= 8
), keyed AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS key FROM windows
), repeated AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM keyed) WHERE n >= 2
), covered AS (
  SELECT doc_id, sum(least(8, i - coalesce(before, -8)))::BIGINT AS n_repeat_words
  FROM repeated GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(lines)::BIGINT AS n_lines,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         100 * n_symbols > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines
           OR word_chars < 2 * n_words OR word_chars > 20 * n_words
           OR 100 * n_upper > 40 * word_chars AS rule_failed
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rule_failed AS kept
FROM judged
"""


@query("op9_rule_cascade", RULES_CHECK)
def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_cascade.judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op1_token_store")
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "token-store")
    token_store.write_store(
        docs,
        path,
        public_tokenizers.path("word_bpe_49k.json"),
        end_id=2,
        lower=True,
        special=("<|",),
    )
    return token_store.read_store(spark, path)


@query("op5_piece_sampling")
def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_sampling.encode_sampled(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_recurrent_lm")
def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_soft_mixing")
def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = soft_mixing.mix_rates(docs, table(spark, sf_dir, "labels"))
    names = list(soft_mixing.DOMAINS)
    return rated.select(
        "doc_id",
        F.col("_mix_words").alias("n_words"),
        *[F.col("_mix_posterior")[d].alias(f"p_{name}") for d, name in enumerate(names)],
        F.col("_mix_rate").alias("rate"),
        F.col("_mix_copies").alias("copies"),
    )


@query("op6_ftrl_quality")
def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = ftrl_quality.remainder(F.col("doc_id")) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    weights = ftrl_quality.fit_quality(docs, labels)
    scored = ftrl_quality.score_quality(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op8_bbit_minhash")
def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bbit_minhash.near_duplicates(docs, size=2, percent=80).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@query("op10_adaptive_scan")
def op10_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return adaptive_scan.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0)


# crc32 of the text that names a row, its faults, and the cheapest edits by dynamic programming.
TURNS_CHECK = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([n::UBIGINT], range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS r(n)
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), dice AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT],
      list_transform(string_split(name, ''), lambda c: ord(c)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS dice
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role,
         CASE dice WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dice, range(CASE dice WHEN 3 THEN 2 ELSE 1 END) WHERE dice <> 0
), ordered AS (
  SELECT *, row_number() OVER w AS pos,
         lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS step
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                 WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 't' ELSE '.' END AS fault
  FROM ordered
), sizes AS (
  SELECT conv_id, count(*) AS n FROM faults GROUP BY conv_id
), states(due, given, next) AS (
  VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)
), inserts(due, added, audit, lines, next) AS (
  SELECT due, 0, '', []::VARCHAR[], due FROM states
  UNION ALL SELECT due, 3, 'I', [given || ':'], next FROM states
  UNION ALL SELECT a.due, 6, 'II', [a.given || ':', b.given || ':'], b.next FROM states a JOIN states b ON b.due = a.next
), walk AS (
  SELECT conv_id, 1 AS pos, 0 AS due, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM sizes
  UNION ALL
  SELECT conv_id, pos, due, best.cost, best.audit, best.lines FROM (
    SELECT conv_id, pos + 1 AS pos, due, min({cost: cost, audit: audit, lines: lines}) AS best
    FROM (
      SELECT w.conv_id, w.pos, w.audit || i.audit || e.edit AS audit,
             w.cost + i.added + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
               + CASE WHEN e.edit <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END AS cost,
             CASE e.edit WHEN 'D' THEN list_concat(w.lines, i.lines)
                         WHEN 'K' THEN list_append(list_concat(w.lines, i.lines), f.role || ':' || f.text)
                         ELSE list_append(list_concat(w.lines, i.lines), s.given || ':' || f.text) END AS lines,
             CASE WHEN e.edit = 'D' THEN i.next WHEN e.edit = 'K' AND f.role[1] = 's' THEN 1 ELSE s.next END AS due
      FROM walk w
      JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos
      JOIN inserts i ON i.due = w.due
      JOIN states s ON s.due = i.next
      JOIN (VALUES ('D'), ('K'), ('R')) AS e(edit) ON
        CASE e.edit WHEN 'D' THEN true WHEN 'R' THEN f.fault NOT IN ('b', 'd')
             ELSE f.fault NOT IN ('b', 'd') AND (f.role[1] = s.given[1] OR (i.next = 0 AND f.role[1] = 's')) END
    ) GROUP BY conv_id, pos, due
  )
), ends AS (
  SELECT conv_id, min({cost: w.cost + i.added, audit: w.audit || i.audit, lines: list_concat(w.lines, i.lines)}) AS best
  FROM walk w JOIN sizes z USING (conv_id) JOIN inserts i ON i.due = w.due
  WHERE w.pos = z.n + 1 AND i.next IN (0, 3) GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank,
       coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
       coalesce(e.best.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_turn_repair", TURNS_CHECK)
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = turn_repair.prepared(turns, "conv_id", "turn", "role", "text")
    repaired = turn_repair.repair(turn_repair.damage(rows), every=rows)
    return repaired.summaries()


def _clusters_check() -> str:
    """The rounds written out one after another."""
    size, scale = pivot_clusters.COMPONENTS, pivot_clusters.SCALE
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY hash, x) - 1)::INTEGER AS cluster, x AS c
  FROM (SELECT x, sha256('{pivot_clusters.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS hash FROM kept)
  QUALIFY cluster < {pivot_clusters.CLUSTERS}
)"""
    ]
    for number in range(pivot_clusters.ROUNDS + 1):
        steps.append(
            f"""a{number} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x,
         min({{distance: list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, cluster: cluster}}) AS best
  FROM kept, c{number} GROUP BY row
)"""
        )
        if number < pivot_clusters.ROUNDS:
            steps.append(
                f"""c{number + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, o.c) AS c FROM c{number} o LEFT JOIN (
    SELECT cluster, list(floored ORDER BY place) AS c FROM (
      SELECT cluster, place, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floored
      FROM (SELECT best.cluster AS cluster, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{number})
      GROUP BY cluster, place) GROUP BY cluster) m USING (cluster)
)"""
            )
    last = pivot_clusters.ROUNDS
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT vec_id, best.cluster AS cluster, best.distance AS distance,
       (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
       (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c{last}.cluster = best.cluster
"""
    )


@query("op13_pivot_clusters", _clusters_check())
def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    members, centroids = pivot_clusters.cluster_vectors(vectors)
    digests = centroids.select(
        F.col("cluster").alias("of"),
        "cluster_inertia",
        "inertia",
        pivot_clusters.centroid_digest(F.col("components")).alias("centroid_sha256"),
    )
    # One row per centroid, CLUSTERS at most.
    return members.join(F.broadcast(digests), F.col("cluster") == F.col("of")).drop("of")


@query("op11_kneser_ney")
def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = ftrl_quality.remainder(F.col("doc_id"), 5) == 0
    judge = kneser_ney.fit_judge(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = kneser_ney.score_toxicity(docs, judge)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
