"""Queries on epochs, wear and summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as table_functions
from ..operators import circadian, epochs as ep, impute, labels, runs, summarise
from .tables import EPOCHS, PERIOD, epochs, table, tidy

DAY = 86400
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ANCHORED = f"""cut AS (
  SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // {DAY * 1_000_000} AS epoch, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events)"""


@query(f"""WITH {ANCHORED}
SELECT user_id, epoch, t0 + to_days(epoch::INT) AS epoch_start, count(value) AS n, round(avg(value), 9) AS mean, round(min(value), 9) AS low,
  round(max(value), 9) AS high, round(max(value) - min(value), 9) AS range, round(stddev_pop(value), 9) AS std, round(stddev_samp(value), 9) AS std_r
FROM cut GROUP BY user_id, epoch, t0 HAVING count(value) > 1""")
def epoch_aggregate(spark, sf_dir):
    return ep.epoch_statistics(table(spark, sf_dir, "events"), "user_id", "ts", "value", DAY, least=1)


@query(f"""WITH {ANCHORED}, last AS (SELECT user_id, max(epoch) AS open FROM cut GROUP BY user_id)
SELECT user_id, epoch, t0 + to_days(epoch::INT) AS epoch_start, count(value) AS n, round(sum(value), 9) AS total
FROM cut JOIN last USING (user_id) WHERE epoch < open GROUP BY user_id, epoch, t0""")
def epoch_anchored(spark, sf_dir):
    e = ep.epoch_statistics(table(spark, sf_dir, "events"), "user_id", "ts", "value", DAY, drop_open=True)
    return e.select("user_id", "epoch", "epoch_start", "n", (F.col("mean") * F.col("n")).alias("total"))


@query("""WITH f AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE seen IS NULL OR ts >= seen) AS n_kept FROM f GROUP BY user_id""")
def late_samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kept = ep.in_order(e, "user_id", "ts", "event_id").groupBy("user_id").agg(F.count("*").alias("n_kept"))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).join(kept, "user_id")


@query("""SELECT event_id, user_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-20 18:00:00'""")
def time_slice(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts BETWEEN TIMESTAMP_NTZ '2024-01-05 06:00:00' AND TIMESTAMP_NTZ '2024-01-20 18:00:00'").select("event_id", "user_id", "ts", "value")


@query("""SELECT user_id, event_type, count(*) AS n, round(quantile_cont(value, 0), 9) AS p0, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.5), 9) AS p50,
  round(quantile_cont(value, 0.75), 9) AS p75, round(quantile_cont(value, 1), 9) AS p100 FROM events GROUP BY user_id, event_type""")
def epoch_percentiles(spark, sf_dir):
    q = F.percentile("value", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    got = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), q.alias("q"))
    return got.select("user_id", "event_type", "n", *(F.col("q")[k].alias(f"p{p}") for k, p in enumerate((0, 25, 50, 75, 100))))


@query(f"""WITH {EPOCHS}, g AS (SELECT user_id, epoch_us(time) / 1e6 - epoch_us(lag(time) OVER (PARTITION BY user_id ORDER BY time)) / 1e6 AS gap FROM epochs)
SELECT user_id, count(*) FILTER (WHERE gap > {PERIOD}) AS interrupts_num, round(coalesce(sum(gap) FILTER (WHERE gap > {PERIOD}), 0) / 60, 9) AS interrupt_mins FROM g GROUP BY user_id""")
def interrupts(spark, sf_dir):
    return ep.interrupts(epochs(spark, sf_dir), "user_id", "time", PERIOD)


GRID = f"""ends AS (SELECT user_id, min(time) AS a, max(time) AS b FROM epochs GROUP BY user_id),
grid AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL {PERIOD} SECOND)) AS time FROM ends),
full_ AS (SELECT grid.user_id, grid.time, acc, n, (acc IS NULL OR n IS NULL) AS missing FROM grid LEFT JOIN epochs USING (user_id, time))"""


@query(f"WITH {EPOCHS}, {GRID} SELECT user_id, time, round(acc, 9) AS acc, n, missing FROM full_")
def regrid_asfreq(spark, sf_dir):
    return ep.regrid(epochs(spark, sf_dir), "user_id", "time", PERIOD)


STILL = "coalesce(acc < 250, false)"
RUNS = f"""marked AS (SELECT *, {STILL} AS still, CASE WHEN lag({STILL}) OVER w IS NOT DISTINCT FROM {STILL} AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM full_ WINDOW w AS (PARTITION BY user_id ORDER BY time)),
runs AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY time) AS run FROM marked)"""


@query(f"""WITH {EPOCHS}, {GRID}, {RUNS} SELECT user_id, run::BIGINT AS run, min(time) AS bout_start, max(time) AS bout_end, count(*) AS n_epochs FROM runs WHERE still GROUP BY user_id, run""")
def stationary_runs(spark, sf_dir):
    full = ep.regrid(epochs(spark, sf_dir), "user_id", "time", PERIOD)
    found = runs.runs(full.withColumn("still", runs.stationary(["acc"], 250)), "user_id", "time", F.col("still"))
    return found.where("still").groupBy("user_id", "run").agg(F.min("time").alias("bout_start"), F.max("time").alias("bout_end"), F.count("*").alias("n_epochs"))


@query(f"""WITH {EPOCHS}, {GRID}, {RUNS} SELECT user_id, min(time) AS bout_start, max(time) AS bout_end, count(*) AS n_epochs FROM runs WHERE still
GROUP BY user_id, run HAVING epoch_us(max(time)) - epoch_us(min(time)) > {6 * 3600 * 1000000}""")
def nonwear_bouts(spark, sf_dir):
    full = ep.regrid(epochs(spark, sf_dir), "user_id", "time", PERIOD)
    return runs.nonwear_bouts(full, "user_id", "time", runs.stationary(["acc"], 250), 6 * 60)


MASKED = f"""spans AS (SELECT *, still AND epoch_us(max(time) OVER (PARTITION BY user_id, run)) - epoch_us(min(time) OVER (PARTITION BY user_id, run)) > {6 * 3600 * 1000000} AS gone FROM runs),
masked AS (SELECT user_id, time, CASE WHEN NOT (missing OR gone) THEN acc END AS acc, CASE WHEN NOT (missing OR gone) THEN n END AS n, missing OR gone AS missing FROM spans)"""


def _masked(spark, sf_dir):
    full = ep.regrid(epochs(spark, sf_dir), "user_id", "time", PERIOD)
    return runs.mask_nonwear(full, "user_id", "time", runs.stationary(["acc"], 250), 6 * 60)


@query(f"WITH {EPOCHS}, {GRID}, {RUNS}, {MASKED} SELECT user_id, time, round(acc, 9) AS acc, n, missing FROM masked")
def nonwear_mask(spark, sf_dir):
    return _masked(spark, sf_dir)


@query(f"""WITH {EPOCHS}, {GRID}, {RUNS}, {MASKED}, h AS (SELECT user_id, hour(time) AS h, count(*) AS c, count(*) FILTER (WHERE missing) AS gone FROM masked GROUP BY ALL)
SELECT user_id, round((sum(c - gone) * {PERIOD / DAY})::DOUBLE, 9) AS wear_days, round((sum(gone) * {PERIOD / DAY})::DOUBLE, 9) AS nonwear_days,
  (sum(c - gone) * {PERIOD / DAY} >= 3 AND NOT bool_or(c = gone))::INT::BIGINT AS good_wear FROM h GROUP BY user_id""")
def wear_time(spark, sf_dir):
    return runs.wear_time(_masked(spark, sf_dir), "user_id", "time", PERIOD)


IMPUTED = """s1 AS (SELECT *, coalesce(acc, avg(acc) OVER (PARTITION BY user_id, isodow(time), hour(time), minute(time))) AS a1 FROM full_),
s2 AS (SELECT *, coalesce(a1, avg(a1) OVER (PARTITION BY user_id, isodow(time) >= 6, hour(time), minute(time))) AS a2 FROM s1),
imputed AS (SELECT user_id, time, coalesce(a2, avg(a2) OVER (PARTITION BY user_id, hour(time), minute(time))) AS acc FROM s2)"""


def _imputed(spark, sf_dir):
    full = ep.regrid(epochs(spark, sf_dir), "user_id", "time", PERIOD).select("user_id", "time", "acc")
    return impute.impute(full, "user_id", "time", ["acc"])


@query(f"WITH {EPOCHS}, {GRID}, {IMPUTED} SELECT user_id, time, round(acc, 9) AS acc FROM imputed")
def impute_cascade(spark, sf_dir):
    return _imputed(spark, sf_dir)


CUBE = """cube_ AS (SELECT user_id, isodow(time) - 1 AS weekday, hour(time) AS hour, avg(acc) AS acc FROM imputed GROUP BY ALL)"""


@query(f"WITH {EPOCHS}, {GRID}, {IMPUTED}, {CUBE} SELECT user_id, weekday, hour, round(acc, 9) AS acc FROM cube_")
def weekday_hour_cube(spark, sf_dir):
    return summarise.weekday_hour_cube(_imputed(spark, sf_dir), "user_id", "time", ["acc"])


MEANS = """named AS (
  SELECT user_id, acc, unnest(['acc-week-avg', 'acc-' || ['mon','tue','wed','thu','fri','sat','sun'][weekday + 1] || '-avg', 'acc-hourOfDay-' || hour || '-avg',
    'acc-' || CASE WHEN weekday >= 5 THEN 'weekend' ELSE 'weekday' END || '-avg', 'acc-hourOf' || CASE WHEN weekday >= 5 THEN 'Weekend' ELSE 'Weekday' END || '-' || hour || '-avg']) AS metric FROM cube_)"""


@query(f"WITH {EPOCHS}, {GRID}, {IMPUTED}, {CUBE}, {MEANS} SELECT user_id, metric, round(avg(acc), 9) AS value FROM named GROUP BY user_id, metric")
def mean_of_means(spark, sf_dir):
    cube = summarise.weekday_hour_cube(_imputed(spark, sf_dir), "user_id", "time", ["acc"])
    return summarise.mean_of_means(cube, "user_id", "acc")


@query(f"""WITH {EPOCHS}, {GRID}, {IMPUTED}, {CUBE}, {MEANS}, m AS (SELECT user_id, metric, avg(acc) AS value FROM named GROUP BY ALL)
SELECT user_id, round(max(value) FILTER (WHERE metric = 'acc-week-avg'), 9) AS "acc-week-avg", round(max(value) FILTER (WHERE metric = 'acc-weekday-avg'), 9) AS "acc-weekday-avg",
  round(max(value) FILTER (WHERE metric = 'acc-weekend-avg'), 9) AS "acc-weekend-avg" FROM m GROUP BY user_id""")
def short_summary(spark, sf_dir):
    return summarise.wide(mean_of_means(spark, sf_dir), "user_id", ["acc-week-avg", "acc-weekday-avg", "acc-weekend-avg"])


@query(f"WITH {EPOCHS} SELECT user_id, round(avg(acc), 9) AS acc_avg, round(stddev_samp(acc), 9) AS acc_sd, round(avg(n), 9) AS n_avg, round(stddev_samp(n), 9) AS n_sd FROM epochs GROUP BY user_id")
def overall_stats(spark, sf_dir):
    return summarise.overall(epochs(spark, sf_dir), "user_id", ["acc", "n"])


@query(f"""WITH {EPOCHS}, {GRID}, l AS (SELECT user_id, hour(time) AS h, minute(time) AS m, acc, unnest({list(summarise.ECDF_LEVELS)}) AS level FROM full_),
p AS (SELECT user_id, level, h, m, avg(CASE WHEN acc IS NOT NULL THEN (acc <= level)::INT END) AS p FROM l GROUP BY ALL)
SELECT user_id, level::BIGINT AS level, round(avg(p), 9) AS ecdf FROM p GROUP BY user_id, level""")
def ecdf_levels(spark, sf_dir):
    return summarise.ecdf(ep.regrid(epochs(spark, sf_dir), "user_id", "time", PERIOD), "user_id", "time", "acc")


@query("""SELECT event_id, user_id, CASE WHEN value IS NOT NULL THEN (value <= 100)::INT::DOUBLE END AS "CpSB", (value > 100 AND value <= 250)::INT::DOUBLE AS "CpLPA", (value > 250 AND value <= 400)::INT::DOUBLE AS "CpMPA",
  (value > 400)::INT::DOUBLE AS "CpVPA", (value > 250)::INT::DOUBLE AS "CpMVPA" FROM events""")
def cutpoint_intensity(spark, sf_dir):
    cuts = labels.cut_point_columns(F.col("value"), {"lpa": 100, "mpa": 250, "vpa": 400})
    return table(spark, sf_dir, "events").select("event_id", "user_id", *(v.alias(k) for k, v in cuts.items()))


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, sum((event_type = 'click')::INT) AS c, sum((event_type = 'view')::INT) AS v FROM events GROUP BY ALL)
SELECT user_id, day, round(c * 21600 / 3600.0::DOUBLE, 9) AS click_hours, round(v * 21600 / 3600.0::DOUBLE, 9) AS view_hours, dense_rank() OVER (PARTITION BY user_id ORDER BY day) - 1 AS day_number FROM d""")
def onehot_daily_hours(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hot = e.select("user_id", "ts", *(v.alias(k) for k, v in labels.one_hot(F.col("event_type"), ["click", "view"]).items()))
    return summarise.daily_hours(hot, "user_id", "ts", ["click", "view"], PERIOD)


@query(f"""WITH {EPOCHS}, {GRID}, d AS (SELECT *, count(*) FILTER (WHERE NOT missing) OVER (PARTITION BY user_id, time::DATE) * {PERIOD} / 3600 AS hours FROM full_)
SELECT user_id, time, CASE WHEN hours >= 12 THEN round(acc, 9) END AS acc, hours >= 12 AS included FROM d""")
def min_wear_days(spark, sf_dir):
    full = ep.regrid(epochs(spark, sf_dir), "user_id", "time", PERIOD)
    return summarise.exclude_days(full, "user_id", "time", ["acc"], ~F.col("missing"), PERIOD, 12).select("user_id", "time", "acc", "included")


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m), s AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS size FROM r)
SELECT event_id, user_id, CASE WHEN event_type = 'view' AND size < 2 THEN 'other' ELSE event_type END AS event_type FROM s""")
def short_streak_relabel(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return runs.relabel_short_streaks(e, "user_id", "event_id", "event_type", "view", "other", 2)


@query("""SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events""")
def rolling_minute_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", summarise.rolling_mean(e, "user_id", "ts", "value", DAY).alias("rolling"))


@query("""WITH w AS (SELECT event_id, user_id, value, median(value) OVER o AS median, count(*) OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT event_id, user_id, round(value, 9) AS value, round(median, 9) AS median FROM w WHERE n = 5""")
def rolling_median(spark, sf_dir):
    return summarise.rolling_median(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value", 5)


NEAREST = f"""ends AS (SELECT user_id, date_trunc('day', min(time)) AS a, CASE WHEN date_trunc('day', max(time)) = max(time) THEN max(time) ELSE date_trunc('day', max(time)) + INTERVAL 1 DAY END AS b FROM epochs GROUP BY user_id),
grid AS (SELECT user_id, unnest(generate_series(a, b - INTERVAL {PERIOD // 2} SECOND, INTERVAL {PERIOD // 2} SECOND)) AS time FROM ends),
pairs AS (SELECT grid.user_id, grid.time, arg_min(acc, [abs(epoch_us(grid.time) - epoch_us(epochs.time)), epoch_us(epochs.time)]) AS acc FROM grid JOIN epochs ON grid.user_id = epochs.user_id
  AND epochs.time BETWEEN grid.time - INTERVAL {PERIOD} SECOND AND grid.time + INTERVAL {PERIOD} SECOND GROUP BY ALL)"""


@query(f"WITH {EPOCHS}, {NEAREST} SELECT grid.user_id, grid.time, round(acc, 9) AS acc FROM grid LEFT JOIN pairs USING (user_id, time)")
def nearest_regrid(spark, sf_dir):
    return ep.nearest_regrid(epochs(spark, sf_dir).drop("n"), "user_id", "time", PERIOD // 2, PERIOD)


def _points(spark, sf_dir):
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = F.sequence(F.date_trunc("day", "a").cast("timestamp_ntz"), F.col("b") + F.expr("interval 1 day"), F.expr("interval 12 hours"))
    return ends.select("user_id", F.explode(days).alias("ts"))


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))


POINTS = """one AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL),
points AS (SELECT user_id, unnest(generate_series(date_trunc('day', min(ts)), max(ts) + INTERVAL 1 DAY, INTERVAL 12 HOUR)) AS t FROM events GROUP BY user_id),
sides AS (SELECT p.user_id, p.t, a.ts AS ta, a.value AS va, b.ts AS tb, b.value AS vb FROM points p ASOF LEFT JOIN one a ON p.user_id = a.user_id AND p.t >= a.ts ASOF LEFT JOIN one b ON p.user_id = b.user_id AND p.t <= b.ts)"""


@query(f"""WITH {POINTS} SELECT user_id, t AS ts, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va
  ELSE va + (vb - va) * (epoch_us(t) - epoch_us(ta)) / (epoch_us(tb) - epoch_us(ta)) END, 9) AS value FROM sides""")
def linear_resample(spark, sf_dir):
    return ep.interpolate(_samples(spark, sf_dir), _points(spark, sf_dir), "user_id", "ts", "value")


@query(f"""WITH {POINTS} SELECT user_id, t AS ts, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR epoch_us(t) - epoch_us(ta) <= epoch_us(tb) - epoch_us(t) THEN va ELSE vb END, 9) AS value FROM sides""")
def nearest_resample(spark, sf_dir):
    return ep.interpolate(_samples(spark, sf_dir), _points(spark, sf_dir), "user_id", "ts", "value", nearest=True)


#: Five days: a recording's month is cut into chunks that a task each may hold.
CHUNK_MICROS = 5.0 * DAY * 1_000_000


@query(SQL["linear_resample"])
def linear_resample_chunks(spark, sf_dir):
    """The same over recordings cut into chunks, with neighbours carried from chunk to chunk."""
    return ep.interpolate(_samples(spark, sf_dir), _points(spark, sf_dir), "user_id", "ts", "value", width=CHUNK_MICROS)


@query(SQL["nearest_resample"])
def nearest_resample_chunks(spark, sf_dir):
    return ep.interpolate(_samples(spark, sf_dir), _points(spark, sf_dir), "user_id", "ts", "value", nearest=True, width=CHUNK_MICROS)


@query(SQL["late_samples"])
def late_samples_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kept = ep.in_order(e, "user_id", "ts", "event_id", width=10_000.0).groupBy("user_id").agg(F.count("*").alias("n_kept"))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).join(kept, "user_id")


@query(SQL["epoch_aggregate"])
def epoch_table_function(spark, sf_dir):
    """Epochs in SQL: the table function over partitioned, ordered rows."""
    table_functions.register(spark)
    table(spark, sf_dir, "events").select("user_id", "ts", "value").createOrReplaceTempView("epoch_table_function_input")
    return spark.sql(f"SELECT * FROM epochs(TABLE(epoch_table_function_input), 'user_id', 'ts', 'value', {DAY}, 1)")


SERIES = "series AS (SELECT user_id, acc AS s, row_number() OVER (PARTITION BY user_id ORDER BY time) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM known)"
KNOWN = "known AS (SELECT user_id, time, coalesce(acc, 0) AS acc FROM imputed)"


def _known(spark, sf_dir):
    return _imputed(spark, sf_dir).fillna(0.0, ["acc"])


@query(f"""WITH {EPOCHS}, {GRID}, {IMPUTED}, {KNOWN}, {SERIES}, w AS (SELECT *, -2 * pi() * (n * {PERIOD / DAY}) * t / n AS a FROM series)
SELECT user_id, round(pow(sum(s * cos(a) / n), 2) + pow(sum(s * sin(a) / n), 2), 4) AS psd FROM w GROUP BY user_id""")
def psd_daily(spark, sf_dir):
    return tidy(circadian.daily_power(_known(spark, sf_dir), "user_id", "time", F.col("acc"), PERIOD), 4)


@query()
def dominant_frequency(spark, sf_dir):
    return circadian.dominant_frequency(_known(spark, sf_dir), "user_id", "time", F.col("acc"), PERIOD)


@query(f"""WITH {EPOCHS}, {GRID}, {IMPUTED}, {KNOWN}, f AS (SELECT *, min(time) OVER (PARTITION BY user_id) AS a, max(time) OVER (PARTITION BY user_id) AS b FROM known),
d AS (SELECT user_id, time, acc, (epoch_us(time) - epoch_us(a)) // 86400000000 AS day, (epoch_us(b) - epoch_us(a)) // 86400000000 AS days FROM f),
w AS (SELECT *, sum(acc) OVER o AS two, row_number() OVER (PARTITION BY user_id, day ORDER BY time) AS r, count(*) OVER (PARTITION BY user_id, day) AS size FROM d WHERE day < days WINDOW o AS (PARTITION BY user_id, day ORDER BY time ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
m AS (SELECT user_id, day, max(two) FILTER (WHERE r <= size - 2) / 2 AS m, min(acc) FILTER (WHERE r <= size - 1) AS l FROM w GROUP BY ALL), o AS (SELECT user_id, avg(m) AS m10, avg(l) AS l5 FROM m GROUP BY user_id)
SELECT user_id, round(m10, 9) AS m10, round(l5, 9) AS l5, round((m10 - l5) / (m10 + l5), 9) AS relative_amplitude FROM o""")
def m10l5(spark, sf_dir):
    # epochs count as five hours each here: windows of two and one of them
    return circadian.m10_l5(_known(spark, sf_dir), "user_id", "time", "acc", 18000)


@query("""WITH h AS (SELECT user_id, date_trunc('day', ts) AS day, sum((event_type = 'view')::INT)::DOUBLE AS view, sum((event_type = 'click')::INT)::DOUBLE AS click, sum((event_type = 'error')::INT)::DOUBLE AS error FROM events GROUP BY ALL)
SELECT user_id, day, CASE WHEN view > error AND view >= click THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal FROM h""")
def sleep_signal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = ["error", "view", "click"]
    h = e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(*(F.sum((F.col("event_type") == k).cast("double")).alias(k) for k in kinds))
    return h.select("user_id", "day", circadian.sleep_signal(kinds, "view").alias("signal"))


@query("""SELECT event_id, user_id, ts FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events) WHERE ts < t0 + INTERVAL 7 DAY""")
def first_n_days(spark, sf_dir):
    first = ep.anchored(table(spark, sf_dir, "events"), "user_id", "ts", 7 * DAY).where("epoch = 0")
    return first.select("event_id", "user_id", "ts")


@query("""SELECT user_id, sum(value > 450)::BIGINT AS clips, count(*) AS total_reads, sign(0)::BIGINT AS dst_crossover FROM events GROUP BY user_id""")
def quality_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.lit(1).alias("rawSamples"), (F.col("value") > 450).cast("int").alias("clipsBeforeCalibr"), F.lit(0).alias("clipsAfterCalibr"))
    return summarise.quality(e, "user_id", "ts", "Europe/London").select("user_id", F.col("clips_before").alias("clips"), "total_reads", "dst_crossover")
