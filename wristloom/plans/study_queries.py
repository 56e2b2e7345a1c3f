"""Queries on study-level tables: files, summaries, repairs and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import impute, study
from .tables import table, tidy

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


GOOD = "(event_id % 3 <> 0)"
SIDES = f"""known AS (SELECT user_id, ts, max(value) AS value FROM events WHERE {GOOD} GROUP BY ALL),
sides AS (SELECT e.event_id, e.user_id, a.value AS previous, b.value AS next FROM (SELECT * FROM events WHERE NOT {GOOD}) e
  ASOF LEFT JOIN known a ON e.user_id = a.user_id AND e.ts > a.ts ASOF LEFT JOIN known b ON e.user_id = b.user_id AND e.ts < b.ts)"""


@query(f"WITH {SIDES} SELECT event_id, user_id, round(previous, 9) AS previous, round(next, 9) AS next FROM sides")
def asof_prev_next(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    known = e.where(GOOD).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return study.neighbours_asof(e.where(f"NOT {GOOD}").select("event_id", "user_id", "ts"), known, "user_id", "ts", "value").select("event_id", "user_id", "previous", "next")


@query(f"WITH {SIDES} SELECT event_id, user_id, round(coalesce(previous, next), 9) AS borrowed FROM sides WHERE coalesce(previous, next) IS NOT NULL")
def calibration_repair(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return study.repaired(e, F.expr(GOOD), "user_id", "ts", "value").select("event_id", "user_id", "borrowed")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def unprocessed_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return study.unprocessed(table(spark, sf_dir, "customer"), done, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_test_split(spark, sf_dir):
    test = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(test, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT d.doc_id, lang, source, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents d LEFT JOIN labels USING (doc_id)""")
def left_join_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_nationkey::BIGINT AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""SELECT o_custkey, count(*) AS n, NULL::VARCHAR AS note FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL
UNION ALL SELECT c_custkey, NULL, c_name FROM customer WHERE c_acctbal < 0""")
def replace_rows(spark, sf_dir):
    old = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    new = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("note"))
    return study.replaced_rows(old, new, "o_custkey")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, CASE WHEN l_quantity > 10 THEN l_tax END AS tax FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, round(coalesce(tax, avg(tax) OVER (PARTITION BY l_suppkey)), 9) AS tax FROM t""")
def device_mean_fill(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("tax"))
    return impute.group_mean_fill(t, "l_suppkey", ["tax"])


@query("""WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), v AS (SELECT least(floor((value - a) / (b - a) * 50), 49)::BIGINT AS bin, a, b FROM events, e WHERE value IS NOT NULL)
SELECT bin, round(any_value(a) + bin * ((any_value(b) - any_value(a)) / 50), 9) AS low, round(any_value(a) + (bin + 1) * ((any_value(b) - any_value(a)) / 50), 9) AS high, count(*) AS n FROM v GROUP BY bin""")
def histogram_50(spark, sf_dir):
    return study.histogram(table(spark, sf_dir, "events"), "value")


@query("""SELECT page_id, split_part(list_extract(string_split(url, '/'), -1), '.', 1) AS participant, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, url LIKE '%/en/%' OR url LIKE '%/fr/%' AS picked FROM pages""")
def path_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.participant_id(F.col("url")).alias("participant"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.col("url").rlike("/en/|/fr/").alias("picked"))


@query("""WITH d AS (SELECT event_id, (event_id % 90) || ['h', 'm', 'd', 's', '', 'x'][event_id % 6 + 1] AS text FROM events)
SELECT event_id, text, round(CASE WHEN event_id % 6 = 5 THEN NULL ELSE (event_id % 90) * [1, 1 / 60.0::DOUBLE, 24, 1 / 3600.0::DOUBLE, 1, 1][event_id % 6 + 1] END, 9) AS hours, event_id % 4 IN (0, 2) AS flag FROM d""")
def duration_parse(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, ("h", "m", "d", "s", "", "x"))), (F.col("event_id") % 6).cast("int"))
    flag = F.get(F.array(*map(F.lit, ("Yes", "no", "T", "0"))), (F.col("event_id") % 4).cast("int"))
    d = table(spark, sf_dir, "events").select("event_id", F.concat((F.col("event_id") % 90).cast("string"), unit).alias("text"), flag.alias("f"))
    return d.select("event_id", "text", tx.duration_hours(F.col("text")).alias("hours"), tx.truth(F.col("f")).alias("flag"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_linenumber || ' ' || l_orderkey || ' ' || l_suppkey AS packed, l_orderkey::DOUBLE AS second FROM lineitem""")
def pack_coefs(spark, sf_dir):
    cell = tx.packed(F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("packed"))
    return li.withColumn("second", tx.unpacked(F.col("packed"))[1])


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, event_type AS kind FROM events""")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"), F.from_json(F.to_json(F.struct(F.col("event_type").alias("t"))), "t string")["t"].alias("kind"))


@query("""SELECT list_extract(string_split(url, '/'), -1) AS name, count(*) AS n FROM pages GROUP BY ALL HAVING count(*) > 1""")
def duplicate_basenames(spark, sf_dir):
    return study.duplicate_names(table(spark, sf_dir, "pages"), "url")


@query("""SELECT event_id AS name, runs, failed, mean_seconds FROM events, (
  SELECT count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value) FILTER (WHERE event_type <> 'error'), 9) AS mean_seconds FROM events)
  WHERE event_type = 'error'""")
def batch_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"), F.col("event_id").alias("name"))
    return study.failed_runs(e).withColumn("mean_seconds", F.round("mean_seconds", 9))


@query("""SELECT 'process ''' || url || ''' --outputFolder ''/out/' || split_part(list_extract(string_split(url, '/'), -1), '.', 1) || '/''' || CASE WHEN page_id % 2 = 0 THEN ' --timeShift ' || page_id ELSE '' END AS command FROM pages""")
def command_lines(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return study.commands(p, "url", "process", "/out", {"timeShift": F.when(F.col("page_id") % 2 == 0, F.col("page_id"))})


@query("""SELECT o_orderpriority, sum((o_orderstatus = 'F')::INT)::BIGINT AS f, sum((o_orderstatus = 'O')::INT)::BIGINT AS o, sum((o_orderstatus = 'P')::INT)::BIGINT AS p FROM orders GROUP BY o_orderpriority""")
def summed_confusions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", *((F.col("o_orderstatus") == s).cast("int").alias(s.lower()) for s in "FOP"))
    return study.summed_confusions(o, "o_orderpriority", ["f", "o", "p"], ["3-MEDIUM", "1-URGENT"])


@query("""SELECT event_type, count(*) AS n, format('{:.2f} ({:.2f})', avg(value), stddev_samp(value)) AS mean_sd,
  format('{:.2f} ({:.2f} - {:.2f})', avg(value), avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*))) AS mean_ci FROM events GROUP BY event_type""")
def formatted_means(spark, sf_dir):
    m, s, n = F.avg("value"), F.stddev_samp("value"), F.count("*")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(n.alias("n"), tx.mean_sd(m, s).alias("mean_sd"), tx.mean_ci(m, s, n).alias("mean_ci"))


@query("""SELECT DISTINCT user_id FROM events ORDER BY user_id""")
def distinct_participants(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct().orderBy("user_id")


@query("""SELECT o_custkey, arg_max(o_orderkey, [epoch_us(o_orderdate), o_orderkey]) AS last_order, arg_min(o_orderkey, [epoch_us(o_orderdate), o_orderkey]) AS first_order FROM orders GROUP BY o_custkey""")
def head_and_tail(spark, sf_dir):
    by = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("last_order"), F.min_by("o_orderkey", by).alias("first_order"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '+0000 [UTC]' AS text, date_trunc('millisecond', ts) AS instant FROM events""")
def zoned_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", tx.zoned_text(F.col("ts").cast("timestamp"), "UTC").alias("text"))
    return e.withColumn("instant", tx.zoned_instant(F.col("text")).cast("timestamp_ntz"))
