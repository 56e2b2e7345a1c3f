"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed to cells (source, language, topic).  The cells' weights are raked: scaled to
the target of each source, then of each language, then of each topic, and again, for ROUNDS at least and until
all margins are within TOLERANCE of their targets.  Targets are given as shares, or are tempered present shares.  A document is kept with the probability that turns its cell's tokens into the cell's raked
weight: a common rate times weight over present share.  The rate is the largest, up to RATE, for which no
probability is above 1, so none is cut and the expected margins are the raked ones.  Chance comes from a
hash of the doc_id, so a rerun keeps the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

DIMENSIONS = ("source", "lang", "topic")
#: Targets: a value's share is its present share to this power, normalised; below 1, large values give way.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS = 12
#: Largest distance of a margin from its target that is left, and rounds after which raking ends all the same: targets may contradict each other where cells are empty.
TOLERANCE, MOST_ROUNDS = 1e-6, 300
#: The share of tokens that is kept, if no cell would have to give more than it has.
RATE = 0.6
#: What a topic is known by, first match first; others are prose.
TOPICS = (("licence", r"[Ll]icen[cs]e"), ("contact", r"@[a-z]|\+[0-9]"), ("table", r"\|"))


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(text.isNull(), "prose").otherwise(out)


def _keyed(docs: DataFrame, keep: list) -> DataFrame:
    return docs.select(
        *keep, F.coalesce("source", F.lit("")).alias("_llm_source"), F.coalesce("lang", F.lit("")).alias("_llm_lang"),
        topic(F.col("text")).alias("_llm_topic"), F.size(words(F.col("text"))).cast("long").alias("_llm_tokens"),
    )


def rake(cells: DataFrame, temper: dict[str, float] | None = None, rounds: int = ROUNDS, at_once: int = 3, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with a weight whose margins are the targets.

    targets has, for each dimension that it names, a table (that dimension, share): shares are normalised over the values that have
    tokens, and values without a share get weight 0.  Other dimensions have tempered present shares.  Weights sum to 1 over all cells.
    Cells without tokens keep weight 0.
    """
    temper, targets = temper or TEMPER, targets or {}
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        values = cells.groupBy(d).agg(F.sum("tokens").alias("t")).where("t > 0")
        if d in targets:
            given = targets[d].where("share > 0").groupBy(F.coalesce(d, F.lit("")).alias(d)).agg(F.sum("share").cast("double").alias("share"))
            values = values.join(given, d).withColumn("t", F.col("share")).drop("share")
        else:
            values = values.withColumn("t", F.pow(F.col("t").cast("double"), F.lit(temper[d])))
        values = values.withColumn(f"target_{d}", F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(0)))).drop("t")
        now = now.join(values, d, "left")
    # a value without a target gives nothing
    now = now.withColumns({f"target_{d}": F.coalesce(f"target_{d}", F.lit(0.0)) for d in DIMENSIONS})
    for k in range(max(rounds, MOST_ROUNDS)):
        for d in DIMENSIONS:
            total = F.sum("weight").over(Window.partitionBy(d))
            now = now.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"target_{d}") / total).otherwise(0.0))
        if k % at_once == at_once - 1 or k == rounds - 1:
            now = written(now, "raked")
            if k >= rounds - 1 and _distance(now) <= tolerance:
                break
    return now.drop(*(f"target_{d}" for d in DIMENSIONS))


def _distance(cells: DataFrame) -> float:
    """The largest distance of a margin from its target."""
    far = [cells.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"target_{d}")).alias("far")).select("far") for d in DIMENSIONS]
    return far[0].union(far[1]).union(far[2]).agg(F.max("far")).first()[0] or 0.0


def _sampled(rows: DataFrame, rate: float, **how) -> DataFrame:
    """rows, as _keyed gives them, with _llm_weight, _llm_p and _llm_kept; rows must be cheap to read twice."""
    names = {f"_llm_{d}": d for d in DIMENSIONS}
    cells = rows.groupBy(*(F.col(a).alias(b) for a, b in names.items())).agg(F.sum("_llm_tokens").alias("tokens"))
    raked = rake(written(cells, "cells"), **how)
    steep = F.max(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    everything = raked.agg(F.sum("tokens").alias("all_tokens"), steep.alias("steep"), F.lit(1).alias("one"))  # one row, on a constant key
    scale = F.least(F.lit(rate) * F.col("all_tokens"), 1 / F.col("steep"))
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), scale * F.col("weight") / F.col("tokens"))).otherwise(1.0)
    cell = raked.withColumn("one", F.lit(1)).join(F.broadcast(everything), "one").select(
        *(F.col(b).alias(f"{a}_c") for a, b in names.items()), F.col("weight").alias("_llm_weight"), F.round(p, 9).alias("_llm_p")
    )
    found = rows.join(written(cell, "probabilities"), [F.col(a) == F.col(f"{a}_c") for a in names]).drop(*(f"{a}_c" for a in names))
    return found.withColumn("_llm_kept", chance(F.col("doc_id")) < F.col("_llm_p"))


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) that the doc_id alone decides; that of an empty string for null."""
    head = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**32))


def mix(docs: DataFrame, rate: float = RATE, **how) -> DataFrame:
    """One row per row of docs (doc_id, text, source, lang): its cell, tokens, weight, probability and sampled.

    The expected tokens of every source, language and topic are in proportion to its target (how: what rake() takes).
    Tokens are words at ASCII white space.  A null source or lang is the empty string's; a null text is prose of
    no tokens and is kept, as are all cells without tokens.  Rows of one doc_id share their fate in a cell;
    no rows give none; other columns are not read.
    """
    rows = written(_keyed(docs, ["doc_id"]), "keyed")
    return _sampled(rows, rate, **how).select(
        "doc_id", F.col("_llm_source").alias("source"), F.col("_llm_lang").alias("lang"), F.col("_llm_topic").alias("topic"),
        F.col("_llm_tokens").alias("n_tokens"), F.round("_llm_weight", 9).alias("cell_weight"), F.col("_llm_p").alias("probability"), F.col("_llm_kept").alias("sampled"),
    )


def sample_mix(docs: DataFrame, rate: float = RATE, **how) -> DataFrame:
    """The rows of docs that mix() samples, with the columns of docs and no others."""
    parts = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("_llm_row"))
    return _sampled(_keyed(parts, ["doc_id", "_llm_row"]), rate, **how).where("_llm_kept").select("_llm_row.*")


def mix_sql(rate: float = RATE, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL."""
    case = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    steps, last = [], "cells"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"r{k}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN s > 0 THEN weight * target_{d} / s ELSE 0 END AS weight) FROM (SELECT * EXCLUDE (s), sum(weight) OVER (PARTITION BY {d}) AS s FROM {last}))")
            last = name
    targets = ", ".join(
        f"t_{d} AS (SELECT {d}, pow(t, {TEMPER[d]}) / sum(pow(t, {TEMPER[d]})) OVER () AS target_{d} FROM (SELECT {d}, sum(tokens)::DOUBLE AS t FROM counts GROUP BY {d}) WHERE t > 0)"
        for d in DIMENSIONS
    )
    return f"""
    WITH keyed AS (
      SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {case} AS topic,
             len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
    counts AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM keyed GROUP BY ALL),
    {targets},
    cells AS (
      SELECT *, tokens AS weight, 0::DOUBLE AS s FROM counts {" ".join(f"LEFT JOIN t_{d} USING ({d})" for d in DIMENSIONS)}),
    {", ".join(steps)},
    chances AS (
      SELECT source, lang, topic, weight,
             CASE WHEN tokens > 0 THEN round(least(1.0, least({rate} * sum(tokens) OVER (), 1 / max(CASE WHEN tokens > 0 THEN weight / tokens END) OVER ()) * weight / tokens), 9)
                  ELSE 1.0 END AS probability FROM {last})
    SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS cell_weight, probability,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < probability) AS sampled
    FROM keyed JOIN chances USING (source, lang, topic)"""
