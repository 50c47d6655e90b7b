"""Host-level quality rules, in DataFrame functions only.

Each text is counted once (rule counters, written as a narrow table). Failures of the base rule are summed by host, hosts' rates are
shrunk towards an empirical beta prior (moments of the hosts' rates), and hosts whose shrunk rate is over MOST_FAILING lose all
their documents: a host of few documents is judged mostly by the prior, a large one by its own rate. Sums combine before the
shuffle, so a hot host is one row a task; only rejected hosts are joined back.

Rows: a null text has no words and fails; a null source is a host of its own, the empty name; repeated rows count each; a
null doc_id is kept as it is. With one host, or equal rates, the prior has no spread and every host has the mean rate.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_FAILING = 0.5


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def counters(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of docs' text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*carry, text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: _without(x, SPACES) != "")
    words = F.filter(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), lambda w: w != "")
    base = base.withColumn("lines", lines).withColumn("words", words)
    n = F.size("words")
    base = base.select(
        *carry,
        n.cast("long").alias("n_words"),
        F.char_length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, words[i + 1], words[i + 2]))").alias("windows"),
    )
    # positions of windows in hash order: equal neighbours occur twice or more
    ranked = base.withColumn("ranked", F.expr("if(size(array_distinct(windows)) < size(windows), sort_array(transform(windows, (h, i) -> struct(h, i))), null)"))
    again = "filter(ranked, (x, j) -> (j > 0 and ranked[greatest(j - 1, 0)].h = x.h) or (j < size(ranked) - 1 and ranked[least(j + 1, size(ranked) - 1)].h = x.h))"
    covered = F.expr(f"coalesce(size(array_distinct(flatten(transform({again}, x -> array(x.i, x.i + 1, x.i + 2))))), 0)")
    return ranked.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("ranked").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n, failed, rate): rate shrunk to the beta prior whose mean and variance are those of the hosts' rates."""
    hosts = stored(judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    own = F.col("failed") / F.col("n")
    mean, spread = hosts.agg(F.avg(own), F.var_pop(own)).first()
    mean, spread = mean or 0.0, spread or 0.0
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else -1.0
    if spread > 0:
        rate = (F.col("failed") + F.lit(max(0.0, mean * weight))) / (F.col("n") + F.lit(max(0.0, weight)))
    else:
        rate = F.lit(mean)
    return hosts.withColumn("rate", rate)


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs."""
    named = docs.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    judged = stored(counters(named, ["doc_id", "host"]).withColumn("base_failed", failed), "counters")
    rejected = host_rates(judged).where(F.col("rate") > MOST_FAILING).select("host", F.lit(True).alias("rejected"))
    out = judged.join(rejected, "host", "left")
    kept = ~F.col("base_failed") & F.col("rejected").isNull()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), tri AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), c AS (
  SELECT w.r, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.r = w.r
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), hosts AS (
  SELECT host, count(*) AS n, sum(base_failed::INT) AS failed FROM j GROUP BY host
), prior AS (
  SELECT avg(failed / n) AS mean, var_pop(failed / n) AS spread FROM hosts
), weighed AS (
  SELECT mean, spread, CASE WHEN spread > 0 THEN greatest(mean * (1 - mean) / spread - 1, 0) END AS weight FROM prior
), rates AS (
  SELECT host, CASE WHEN spread > 0 THEN (failed + mean * weight) / (n + weight) ELSE mean END AS rate FROM hosts, weighed
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept
FROM j JOIN rates USING (host)
"""
