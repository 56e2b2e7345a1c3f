"""Quality rules: fixed base rules, and thresholds that adapt to each language and source.

Only DataFrame functions.  Text statistics are computed per row; no text is shuffled.  The thresholds come
from mergeable quantile sketches: counts of values in log-linear buckets (the top eight bits of a value; its
relative error is below 1/128), one sketch per language, source and statistic.  Merging two sketches is
adding their counts, so they are built with map-side partial sums, and the sketches of a language or of
all rows are sums of those of its sources.  They hold whole data and no sample, and the same rows give the
same thresholds in any order.

A small group knows little of its own: to its sketch is added that of its language, scaled to PRIOR documents, and to the
language's, before, that of all rows.  So limits move smoothly from the language's to the group's as the group grows.

A document fails where a statistic lies more than so many interquartile ranges of its group beyond the group's quartile.
Few words scatter more: in a document shorter than the group's median the room grows with the square root of
that ratio, as a mean's error does.  No fixed number enters a threshold but these multiples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

#: rule: (statistic, direction, multiple of the interquartile range)
RULES = {
    "marks": ("marks", "above", 6),  # what is no letter, per 1000 characters of words
    "symbols": ("symbols", "above", 8),  # signs of markup and code, per 1000 characters of words
    "long_words": ("mean", "above", 5),  # 100 * mean word length
    "short_words": ("mean", "below", 3),
}
#: What is sketched: the statistics of RULES, and the words of a document.
SKETCHED = ("marks", "symbols", "mean", "n_words")
#: Those that have limits on their values.
JUDGED = ("marks", "symbols", "mean")
#: A group's limits: quartiles as bucket edges, the range between them from edge to edge, and the median of words.
LIMITS = (*(f"{s}_{c}" for s in JUDGED for c in ("q1", "q3", "range")), "median_words")
#: Documents that a language's sketch counts for in that of each of its sources, and that of all rows in a language's.
PRIOR = 200
#: Bits of a value that its bucket keeps.
BITS = 8
WINDOW = 5


def repeated_words(w: Column) -> Column:
    """Words that lie in five-word windows found twice or more in the array.

    Windows are compared by hash first: all different means none repeats.  Only where two are equal are the
    windows themselves sorted and compared.
    """
    n = F.size(w)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def _covered(w: Column) -> Column:
    """The number of words in repeated windows, from the windows in sorted order."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    grams = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + k) for k in range(WINDOW))).alias("g"), i.alias("i"))))
    return F.transform(
        F.array(grams),
        lambda g: F.transform(
            F.array(F.array_sort(F.transform(F.filter(starts, lambda k: (F.get(g, k).g == F.get(g, k - 1).g) | (F.get(g, k).g == F.get(g, k + 1).g)), lambda k: F.get(g, k).i))),
            lambda at: F.when(F.size(at) == 0, 0).otherwise(
                F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), lambda sum_, k: sum_ + F.when(k + 1 < F.size(at), F.least(F.lit(WINDOW), F.get(at, k + 1) - F.get(at, k))).otherwise(WINDOW))
            ),
        )[0],
    )[0]


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and a struct q of statistics of the whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    wide = docs.select(*keep, words(F.col("text")).alias("_llm_w"), lines.alias("_llm_l"), (F.size(F.split(text, r"[#*$%&|<>]")) - 1).alias("_llm_s"))
    w = F.col("_llm_w")
    wide = wide.withColumn("_llm_r", repeated_words(w)).withColumn("_llm_j", F.array_join(w, ""))
    dup = F.size("_llm_l") - F.size(F.array_distinct("_llm_l"))
    q = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length("_llm_j").cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_llm_j", r"\P{L}+", "")).cast("long").alias("letters"),
        F.col("_llm_s").cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        F.when(F.col("_llm_r"), _covered(w)).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    return wide.select(*keep, q.alias("_llm_q"))


def base_failed(q: str = "_llm_q") -> Column:
    n, r = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def _values(q: str = "_llm_q") -> dict[str, Column]:
    """Whole-number values of what is sketched."""
    return {
        "marks": F.expr(f"1000 * ({q}.word_chars - {q}.letters) div greatest({q}.word_chars, 1)"),
        "symbols": F.expr(f"1000 * {q}.n_symbols div greatest({q}.word_chars, 1)"),
        "mean": F.expr(f"100 * {q}.word_chars div greatest({q}.n_words, 1)"),
        "n_words": F.col(f"{q}.n_words"),
    }


def _width(v: Column) -> Column:
    """The width of v's bucket: 1, and twice as much for every bit above BITS."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.char_length(F.bin(v)) - BITS, F.lit(0)))


def _bucket(v: Column) -> Column:
    """The lower edge of v's bucket."""
    return v - v % _width(v)


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, stat, bucket, n): one mergeable sketch per lang, source and statistic; nulls count as ''."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), _bucket(v).alias("bucket")) for k, v in _values().items())))
    rows = stats.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), pairs.alias("p"))
    return rows.groupBy("lang", "source", "p.stat", "p.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source) and LIMITS, from sketches that are filled up with `prior` documents of the level above.

    Counts are whole numbers, scaled so that no division is needed: those of all rows as they are; of a language by the number of
    all rows; and of a source by the total of its language.
    """
    fine = written(sketch, "sketches")
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")
    # at most some 128 buckets for each power of two
    every = fine.groupBy("stat", "bucket").agg(whole(F.sum("n")).alias("n_all")).withColumn("docs", whole(F.sum("n_all").over(Window.partitionBy("stat"))))
    in_lang = fine.groupBy("lang", "stat", "bucket").agg(F.sum("n").alias("n"))
    langs = fine.groupBy("lang", "stat").agg(whole(F.sum("n")).alias("n_lang"))
    lang = langs.join(F.broadcast(every), "stat").join(in_lang, ["lang", "stat", "bucket"], "left")
    own = whole(F.coalesce("n", F.lit(0)))
    lang = lang.select("lang", "stat", "bucket", (own * F.col("docs") + prior * F.col("n_all")).cast("decimal(38,0)").alias("l"), ((F.col("n_lang") + prior) * F.col("docs")).cast("decimal(38,0)").alias("l_total"))
    groups = fine.groupBy("lang", "source", "stat").agg(whole(F.sum("n")).alias("n_group"))
    cells = groups.join(lang, ["lang", "stat"]).join(fine, ["lang", "source", "stat", "bucket"], "left")
    cells = cells.withColumns({"g": (own * F.col("l_total") + prior * F.col("l")).cast("decimal(38,0)"), "total": ((F.col("n_group") + prior) * F.col("l_total")).cast("decimal(38,0)")})
    by = Window.partitionBy("lang", "source", "stat").orderBy("bucket")
    run = cells.withColumn("upto", whole(F.sum("g").over(by)))
    part = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bucket")))
    cuts = run.groupBy("lang", "source", "stat").agg(part(25).alias("q1"), part(50).alias("q2"), part(75).alias("q3"))
    cuts = cuts.withColumn("range", F.col("q3") + _width(F.col("q3")) - F.col("q1"))
    of = lambda stat, c: F.max(F.when(F.col("stat") == stat, F.col(c)))
    limits = [of(s, c).alias(f"{s}_{c}") for s in JUDGED for c in ("q1", "q3", "range")] + [of("n_words", "q2").alias("median_words")]
    return cuts.groupBy("lang", "source").agg(*limits)


def _passes(value: str, n_words: str, rule: str, limit: str = "") -> str:
    """Whether a value passes a rule, in SQL for both engines; limit stands before the names of LIMITS."""
    stat, side, times = RULES[rule]
    beyond = f"({value} - {limit}{stat}_q3)" if side == "above" else f"({limit}{stat}_q1 - {value})"
    d, room, usual = f"cast({beyond} as double)", f"cast({times} * {limit}{stat}_range as double)", f"cast(greatest({limit}median_words, 1) as double)"
    return f"({beyond} <= 0 OR {d} * {d} * least(cast({n_words} as double), {usual}) <= {room} * {room} * {usual})"


def judged(stats: DataFrame) -> DataFrame:
    """stats and a boolean _llm_kept; stats must be a written table, as it is read twice.

    The limits are a row per language and source; they are broadcast where Spark finds them small, and else joined with
    skewed groups split.
    """
    limits = written(thresholds(sketches(stats)), "thresholds")
    limits = limits.select(*(F.col(c).alias(f"_llm_{c}") for c in ("lang", "source", *LIMITS)))
    rows = stats.join(limits, [F.coalesce("lang", F.lit("")) == F.col("_llm_lang"), F.coalesce("source", F.lit("")) == F.col("_llm_source")])
    for k, v in _values().items():
        rows = rows.withColumn(f"_llm_v_{k}", v)
    ok = ~base_failed()
    for rule, (stat, _, _) in RULES.items():
        ok = ok & F.expr(_passes(f"_llm_v_{stat}", "_llm_v_n_words", rule, "_llm_"))
    return rows.withColumn("_llm_kept", ok).drop(*(f"_llm_{c}" for c in ("lang", "source", *LIMITS)), *(f"_llm_v_{k}" for k in SKETCHED))


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): statistics, base_failed and kept.

    A null or empty text has no words and fails the base rules.  A null lang or source is a group of its own,
    shared with the empty string.  Repeated rows count each time and get the same verdict; a null doc_id stays
    null; no rows give none; other columns are not read.
    """
    stats = written(statistics(docs.select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"]), "statistics")
    q = [F.col(f"_llm_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(stats).select("doc_id", *q, base_failed().alias("base_failed"), F.col("_llm_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs and no others."""
    own = F.struct("*").alias("_llm_row")
    parts = docs.select(own, "text", "lang", "source")
    stats = written(statistics(parts, ["_llm_row", "lang", "source"]), "rows-with-statistics")
    return judged(stats).where("_llm_kept").select("_llm_row.*")


def quality_sql(prior: int = PRIOR) -> str:
    """The same in DuckDB SQL."""
    space = r"[\x20\x09-\x0D]"
    width = lambda v: f"(1::BIGINT << greatest(length(bin({v})) - {BITS}, 0))"
    of = lambda stat, c: f"max({c}) FILTER (WHERE stat = '{stat}')"
    limits = ", ".join([f"{of(s, c)} AS {s}_{c}" for s in JUDGED for c in ("q1", "q3", "range")] + [f"{of('n_words', 'q2')} AS median_words"])
    fine = " AND ".join(_passes(f"v_{stat}", "n_words", rule) for rule, (stat, _, _) in RULES.items())
    return f"""
    WITH cut AS (
      SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w FROM documents),
    parts AS (
      SELECT *, row_number() OVER () AS rid, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(array_to_string(w, ''), '\\P{{L}}+', '', 'g'))::BIGINT AS letters,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM cut),
    windows AS (
      SELECT rid, unnest(list_transform(range(1, n_words - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g, unnest(range(1, n_words - 3)) AS i
      FROM parts WHERE n_words >= 5),
    twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    covered AS (SELECT rid, count(DISTINCT i + k) AS r FROM twice, range(0, 5) AS o(k) GROUP BY rid),
    stats AS (
      SELECT p.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words FROM parts p LEFT JOIN covered USING (rid)),
    vals AS (
      SELECT *, 1000 * (word_chars - letters) // greatest(word_chars, 1) AS v_marks, 1000 * n_symbols // greatest(word_chars, 1) AS v_symbols, 100 * word_chars // greatest(n_words, 1) AS v_mean, n_words AS v_n_words,
             (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM stats),
    long AS ({" UNION ALL ".join(f"SELECT lang, source, '{s}' AS stat, v_{s} AS v FROM vals" for s in SKETCHED)}),
    sketch AS (SELECT lang, source, stat, v - v % {width("v")} AS bucket, count(*) AS n FROM long GROUP BY ALL),
    every AS (SELECT stat, bucket, sum(n)::HUGEINT AS n_all, (SELECT sum(n) FROM sketch WHERE stat = '{SKETCHED[0]}')::HUGEINT AS docs FROM sketch GROUP BY stat, bucket),
    langs AS (SELECT lang, sum(n)::HUGEINT AS n_lang FROM sketch WHERE stat = '{SKETCHED[0]}' GROUP BY lang),
    in_lang AS (SELECT lang, stat, bucket, sum(n)::HUGEINT AS n FROM sketch GROUP BY ALL),
    filled AS (
      SELECT lang, stat, bucket, coalesce(n, 0) * docs + {prior} * n_all AS l, (n_lang + {prior}) * docs AS l_total
      FROM langs CROSS JOIN every LEFT JOIN in_lang USING (lang, stat, bucket)),
    groups AS (SELECT lang, source, sum(n)::HUGEINT AS n_group FROM sketch WHERE stat = '{SKETCHED[0]}' GROUP BY ALL),
    cells AS (
      SELECT lang, source, stat, bucket, coalesce(n, 0)::HUGEINT * l_total + {prior} * l AS g, (n_group + {prior}) * l_total AS total
      FROM groups JOIN filled USING (lang) LEFT JOIN sketch USING (lang, source, stat, bucket)),
    run AS (SELECT *, sum(g) OVER (PARTITION BY lang, source, stat ORDER BY bucket) AS upto FROM cells),
    cuts AS (
      SELECT *, q3 + {width("q3")} - q1 AS range FROM (
        SELECT lang, source, stat, min(bucket) FILTER (WHERE 100 * upto >= 25 * total) AS q1, min(bucket) FILTER (WHERE 100 * upto >= 50 * total) AS q2,
               min(bucket) FILTER (WHERE 100 * upto >= 75 * total) AS q3 FROM run GROUP BY ALL)),
    lim AS (SELECT lang, source, {limits} FROM cuts GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {fine}) AS kept
    FROM vals JOIN lim USING (lang, source)"""
