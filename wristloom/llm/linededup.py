"""Line dedup: drop lines that many documents share, with DataFrame functions only.

Lines are exploded to (hash of the key, document), without their text; a two-step aggregation counts the
distinct documents of each hash, so a line that a third of all documents hold is summed map-side.  The
hashes over the threshold are joined back to the exploded lines, which gives each document the positions
it loses; texts are read again, joined to those positions, and put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, lower_ascii, written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def _hashes(text: Column, least_chars: int) -> Column:
    """An array of (h1, h2, pos) for the lines whose keys are long enough: 128 bits of two independent hashes."""
    keyed = F.transform(_lines(text), lambda x, i: F.struct(_key(x).alias("k"), i.alias("pos")))
    long = F.filter(keyed, lambda x: F.char_length(x.k) >= least_chars)
    return F.transform(long, lambda x: F.struct(F.xxhash64(x.k).alias("h1"), F.xxhash64(F.lit(1), x.k).alias("h2"), x.pos.alias("pos")))


def _cut(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """docs with _llm_lines (all of them) and _llm_drop (positions to drop, null for none)."""
    # rows of one doc_id may have several texts: positions belong to a text
    own = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_llm_text")
    exploded = docs.where("doc_id IS NOT NULL").select("doc_id", own, F.explode(_hashes(F.col("text"), least_chars)).alias("x"))
    rows = exploded.select("doc_id", "_llm_text", "x.*")
    per_doc = rows.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    common = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs)
    common = written(common.select("h1", "h2", "keeper"), "common-lines")
    hit = rows.join(common, ["h1", "h2"]).where("doc_id <> keeper")
    drops = written(hit.groupBy("doc_id", "_llm_text").agg(F.collect_set("pos").alias("_llm_drop")), "dropped-lines")
    drops = drops.withColumnRenamed("doc_id", "_llm_doc")
    wide = docs.select("*", own)
    # one strategy at every size: the positions grow with the documents, so they are never broadcast
    joined = wide.join(drops.withColumnRenamed("_llm_text", "_llm_of").hint("merge"), (F.col("doc_id") == F.col("_llm_doc")) & (F.col("_llm_text") == F.col("_llm_of")), "left")
    return joined.drop("_llm_text", "_llm_doc", "_llm_of").withColumn("_llm_lines", _lines(F.col("text")))


def _kept_text() -> Column:
    lines = F.col("_llm_lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_llm_drop"))
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_lines, n_dropped, kept_sha256.

    A key of at least least_chars code points in at least least_docs documents loses all its lines but those
    of the largest doc_id that holds it.  A null or empty text is one empty line.  Rows that share a doc_id are
    one document; rows without one are left as they are and count for no key.  Other columns are not read.
    """
    cut = _cut(docs.select("doc_id", "text"), least_chars, least_docs)
    n = F.coalesce(F.size("_llm_drop"), F.lit(0))
    n = F.when(F.col("_llm_drop").isNull(), 0).otherwise(n)
    text = F.when(n == 0, F.coalesce("text", F.lit(""))).otherwise(_kept_text())
    return cut.select("doc_id", F.size("_llm_lines").cast("long").alias("n_lines"), n.cast("long").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))


def without_common_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """docs with the lines dropped from text, and n_chars, if there is one, counted anew; texts that lose nothing stay."""
    cut = _cut(docs, least_chars, least_docs)
    changed = F.col("_llm_drop").isNotNull()
    out = cut.withColumn("text", F.when(changed, _kept_text()).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def line_dedup_sql(least_chars: int = 40, least_docs: int = 5) -> str:
    """The same in DuckDB SQL."""
    trim = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
    keyed AS (
      SELECT *, translate(trim(line, {trim}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    common AS (
      SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {least_chars} GROUP BY k HAVING count(DISTINCT doc_id) >= {least_docs}),
    marked AS (SELECT keyed.*, (keeper IS NOT NULL AND keeper <> doc_id) AS gone FROM keyed LEFT JOIN common USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""
