"""Queries on samples, signals and spectra, each with its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx, vectors as vx
from ..operators import calibration, signal
from .tables import AXES, axes, table, tidy

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VM = "sqrt(x * x + y * y + z * z)"


@query(f"""WITH {AXES} SELECT device, count(*) AS n, round(avg({VM} - 1), 9) AS enmo, round(avg(greatest({VM} - 1, 0)), 9) AS enmo_trunc, round(avg(abs({VM} - 1)), 9) AS enmo_abs FROM samples GROUP BY device""")
def enmo_stats(spark, sf_dir):
    e = vx.enmo(F.col("x"), F.col("y"), F.col("z"))
    return axes(spark, sf_dir).groupBy("device").agg(F.count("*").alias("n"), F.avg(e).alias("enmo"), F.avg(vx.truncated(e)).alias("enmo_trunc"), F.avg(F.abs(e)).alias("enmo_abs"))


@query(f"""WITH {AXES} SELECT device, round(covar_pop(x, y) * count(*) / (count(*) + 1), 9) AS xy_cov, round(covar_pop(x, z) * count(*) / (count(*) + 1), 9) AS xz_cov,
  round(covar_pop(y, z) * count(*) / (count(*) + 1), 9) AS yz_cov, round(corr(x, y), 9) AS xy_corr, round(corr(x, z), 9) AS xz_corr, round(corr(y, z), 9) AS yz_corr FROM samples GROUP BY device""")
def pairwise_cov_corr(spark, sf_dir):
    n = F.count("*")
    cov = [(F.covar_pop(a, b) * n / (n + 1)).alias(f"{a}{b}_cov") for a, b in (("x", "y"), ("x", "z"), ("y", "z"))]
    cor = [F.corr(a, b).alias(f"{a}{b}_corr") for a, b in (("x", "y"), ("x", "z"), ("y", "z"))]
    return axes(spark, sf_dir).groupBy("device").agg(*cov, *cor)


@query("""WITH l AS (SELECT user_id, value, lag(value, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, round(corr(value, before), 9) AS autocorr FROM l GROUP BY user_id""")
def lag_autocorr(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lagged = e.select("user_id", "value", F.lag("value", 3).over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"))
    return lagged.groupBy("user_id").agg(F.corr("value", "before").alias("autocorr"))


@query(f"""WITH {AXES} SELECT device, round(avg(atan2(y, z)), 9) AS roll, round(avg(atan2(z, x)), 9) AS pitch, round(avg(atan2(y, x)), 9) AS yaw, round(stddev_samp(atan2(y, z)), 9) AS roll_sd,
  round(stddev_samp(atan2(z, x)), 9) AS pitch_sd, round(stddev_samp(atan2(y, x)), 9) AS yaw_sd, round(avg(degrees(atan(z / (x * x + y * y)))) FILTER (WHERE x * x + y * y > 0), 9) AS arm FROM samples GROUP BY device""")
def angle_stats(spark, sf_dir):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    found = {"roll": F.atan2(y, z), "pitch": F.atan2(z, x), "yaw": F.atan2(y, x)}
    arm = F.avg(F.when(x * x + y * y > 0, vx.angle_degrees(x, y, z))).alias("arm")
    return axes(spark, sf_dir).groupBy("device").agg(*(F.avg(v).alias(k) for k, v in found.items()), *(F.stddev_samp(v).alias(f"{k}_sd") for k, v in found.items()), arm)


@query("""WITH m AS (SELECT user_id, value, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(abs(value - m)) / any_value(n), 9) AS "MAD", round(sum(pow(abs(value - m), 1.5)) / pow(any_value(n), 1.5), 9) AS "MPD",
  round(sum(pow((value - m) / (s + 1e-8), 3)) * any_value(n) / ((any_value(n) - 1) * (any_value(n) - 2)), 9) AS skew,
  round(sum(pow((value - m) / (s + 1e-8), 4)) * any_value(n) * (any_value(n) + 1) / (any_value(n) - 1) / (any_value(n) - 2) / (any_value(n) - 3) / (any_value(n) - 4)
    - 3 * pow(any_value(n) - 1, 2) / ((any_value(n) - 2) * (any_value(n) - 3)), 9) AS kurt FROM m GROUP BY user_id HAVING any_value(n) > 4""")
def mad_mpd_skew_kurt(spark, sf_dir):
    by = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") - F.avg("value").over(by)).alias("d"), F.stddev_pop("value").over(by).alias("s"), F.count("*").over(by).cast("double").alias("n"))
    u = F.col("d") / (F.col("s") + 1e-8)
    sums = e.groupBy("user_id", "n").agg(F.sum(F.abs("d")).alias("a"), F.sum(F.pow(F.abs("d"), F.lit(1.5))).alias("b"), F.sum(F.pow(u, F.lit(3))).alias("c"), F.sum(F.pow(u, F.lit(4))).alias("e"))
    n = F.col("n")
    kurt = F.col("e") * n * (n + 1) / (n - 1) / (n - 2) / (n - 3) / (n - 4) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return sums.where("n > 4").select("user_id", (F.col("a") / n).alias("MAD"), (F.col("b") / F.pow(n, F.lit(1.5))).alias("MPD"), (F.col("c") * n / ((n - 1) * (n - 2))).alias("skew"), kurt.alias("kurt"))


@query(f"""WITH {AXES}, c AS (SELECT *, 0.012 + x * 0.985 AS xc, -0.018 + y * 1.022 AS yc, 0.015 + z * 0.994 AS zc FROM samples),
f AS (SELECT *, greatest(abs(x), abs(y), abs(z)) >= 0.98 AS before FROM c)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, before AS clip_before, greatest(abs(xc), abs(yc), abs(zc)) > 0.98 AND NOT before AS clip_after,
  round(CASE WHEN before AND abs(x) >= 0.98 THEN sign(x) * 0.98 ELSE greatest(least(xc, 0.98), -0.98) END, 9) AS x_fixed FROM f""")
def clip_and_calibrate(spark, sf_dir):
    s = axes(spark, sf_dir)
    raw, none = (F.col("x"), F.col("y"), F.col("z")), F.lit(0.0)
    fixed = tuple(vx.calibrated(v, none, F.lit(o), F.lit(m), none) for v, o, m in zip(raw, (0.012, -0.018, 0.015), (0.985, 1.022, 0.994), strict=True))
    before, after = vx.clip_flags(raw, fixed, 0.98)
    return s.select("l_orderkey", "l_linenumber", before.alias("clip_before"), after.alias("clip_after"), vx.clamped(raw[0], fixed[0], before, 0.98).alias("x_fixed"))


@query(f"""WITH {AXES}, s AS (SELECT device, l_orderkey // 1000 AS epoch, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(z) AS sz, avg(x) AS mx, count(*) AS n FROM samples GROUP BY ALL)
SELECT device, epoch, n, (sx = 0 AND abs(mx) > 1.5)::INT::BIGINT * n AS stuck, (sx < 0.5 AND sy < 0.3 AND sz < 0.25) AS still FROM s""")
def stuck_and_still(spark, sf_dir):
    # deviations of exactly a limit are common here, so values are added in the table's order
    row = F.struct("_metadata.file_path", "_metadata.row_index", "x", "y", "z")
    g = axes(spark, sf_dir).groupBy("device", F.expr("l_orderkey div 1000").alias("epoch")).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.avg("x").alias("mx"), F.count("*").alias("n"))
    g = g.select("*", *(vx.running_deviation(F.col(f"rows.{a}")).alias(f"s{a}") for a in "xyz"))
    still = (F.col("sx") < 0.5) & (F.col("sy") < 0.3) & (F.col("sz") < 0.25)
    return g.select("device", "epoch", "n", (((F.col("sx") == 0) & (F.abs("mx") > 1.5)).cast("long") * F.col("n")).alias("stuck"), still.alias("still"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
e AS (SELECT user_id, r, 0.1 * value AS g FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, 0.9 * e.g + 0.1 * o.value FROM e JOIN o ON o.user_id = e.user_id AND o.r = e.r + 1)
SELECT user_id, round(avg(g), 9) AS gravity FROM e WHERE r >= 5 GROUP BY user_id""")
def ewma_gravity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    # the average is a filter of one pole
    smooth = signal.filtered(e, "user_id", "event_id", "value", np.array([0.1, 0.0]), np.array([1.0, -0.9]))
    return smooth.where("place >= 5").groupBy("user_id").agg(F.avg("filtered").alias("gravity"))


B, A = signal.butterworth(4, 20.0, 100.0)


def _number(v: float) -> str:
    return f"({float(v)!r}::DOUBLE)"


_STEP = " + ".join([f"{_number(B[0])} * o.value"] + [f"{_number(B[k])} * f.x{k} - {_number(A[k])} * f.y{k}" for k in range(1, 5)])


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS r, 0::DOUBLE AS x1, 0::DOUBLE AS x2, 0::DOUBLE AS x3, 0::DOUBLE AS x4, 0::DOUBLE AS y1, 0::DOUBLE AS y2, 0::DOUBLE AS y3, 0::DOUBLE AS y4 FROM o WHERE r = 1
  UNION ALL SELECT o.user_id, o.event_id, o.r, o.value, f.x1, f.x2, f.x3, {_STEP}, f.y1, f.y2, f.y3 FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, event_id, round(y1, 9) AS filtered FROM f WHERE r > 0""")
def butterworth_lowpass(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return signal.filtered(e, "user_id", "event_id", "value", B, A).select("user_id", "event_id", "filtered")


def _vectors(spark, sf_dir):
    """embeddings as signals of 64 samples at 16 Hz."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def _with(value, f):
    """f of a value that is computed once, as a lambda's variable: expressions in lambdas are not shared otherwise."""
    return F.transform(F.array(value), f)[0]


def _spectrum(spark, sf_dir):
    """vec_id, k, f and power of the Hann-windowed signal without its mean: sums within each row, no shuffle."""
    s = _vectors(spark, sf_dir).withColumn("n", F.size("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, v: a + v) / F.size("v")
    window = _with(mean, lambda m: vx.hann(F.transform("v", lambda v: v - m)))
    places = F.sequence(F.lit(0), F.col("n") - 1)

    def part(w, k, wave):
        return F.aggregate(places, F.lit(0.0), lambda a, t: a + F.get(w, t) * wave(2 * math.pi * k * t / F.col("n")))

    bins = F.sequence(F.lit(0), F.expr("n div 2 - 1").cast("int"))
    p = _with(window, lambda w: F.transform(bins, lambda k: (part(w, k, F.cos) ** 2 + part(w, k, F.sin) ** 2) / (F.col("n") * F.col("n"))))
    return s.select("vec_id", "n", F.posexplode(p).alias("k", "p")).select("vec_id", "k", (F.col("k") * 16.0 / F.col("n")).alias("f"), "p", "n")


SPECTRUM = """s AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, n, list_avg(v) AS m, unnest(v) AS x, unnest(range(n)) AS t FROM s),
w AS (SELECT vec_id, n, t, (x - m) * (0.5 - 0.5 * cos(2 * pi() * t / (n - 1))) AS x FROM u),
g AS (SELECT vec_id, k, n, sum(x * cos(2 * pi() * k * t / n)) AS re, sum(x * sin(2 * pi() * k * t / n)) AS im FROM w, range(0, 32) AS b(k) GROUP BY ALL),
spectrum AS (SELECT vec_id, k, k * 16.0 / n AS f, (re * re + im * im) / (n * n) AS p, n FROM g)"""


@query(f"WITH {SPECTRUM} SELECT vec_id, k, round(f, 9) AS f, round(p * 1000, 9) AS p FROM spectrum")
def dft_power(spark, sf_dir):
    return _spectrum(spark, sf_dir).select("vec_id", "k", "f", (F.col("p") * 1000).alias("p"))


@query(f"""WITH {SPECTRUM}, t AS (SELECT *, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-8) AS share FROM spectrum)
SELECT vec_id, round(sum(-share * ln(share + 1e-8)) FILTER (WHERE share > 0) / ln(count(*)), 9) AS entropy, round(ln(sum(p) + 1e-8), 9) AS total_power FROM t GROUP BY vec_id""")
def spectral_entropy(spark, sf_dir):
    p = _spectrum(spark, sf_dir).withColumn("share", F.col("p") / (F.sum("p").over(Window.partitionBy("vec_id")) + 1e-8))
    one = F.when(F.col("share") > 0, -F.col("share") * F.log(F.col("share") + 1e-8))
    return p.groupBy("vec_id").agg((F.sum(one) / F.log(F.count("*").cast("double"))).alias("entropy"), F.log(F.sum("p") + 1e-8).alias("total_power"))


@query(f"""WITH {SPECTRUM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 12) DESC, k) AS place FROM spectrum WHERE f >= 0.3 AND f <= 15)
SELECT vec_id, round(max(f) FILTER (WHERE place = 1), 9) AS f1, round(max(f) FILTER (WHERE place = 2), 9) AS f2, round(ln(max(p) FILTER (WHERE place = 1) + 1e-8), 4) AS p1 FROM r GROUP BY vec_id""")
def topk_power(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.round("p", 12)), "k"))
    r = _spectrum(spark, sf_dir).where("f >= 0.3 AND f <= 15").withColumn("place", rank).where("place <= 2")
    return r.groupBy("vec_id").agg(F.max(F.when(F.col("place") == 1, F.col("f"))).alias("f1"), F.max(F.when(F.col("place") == 2, F.col("f"))).alias("f2"), F.round(F.log(F.max(F.when(F.col("place") == 1, F.col("p"))) + 1e-8), 4).alias("p1"))


@query(f"""WITH {SPECTRUM} SELECT vec_id, arg_max(k, [round(p, 12), -k])::BIGINT AS k_max FROM spectrum WHERE k > 0 GROUP BY vec_id""")
def dominant_bin(spark, sf_dir):
    return _spectrum(spark, sf_dir).where("k > 0").groupBy("vec_id").agg(F.max_by("k", F.struct(F.round("p", 12), -F.col("k"))).alias("k_max"))


@query("""WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS t FROM embeddings), b AS (SELECT vec_id, t // 16 AS block, avg(x) AS m FROM s GROUP BY ALL),
d AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY vec_id ORDER BY block)) AS d FROM b) SELECT vec_id, round(avg(m), 9) AS block_mean, round(avg(d), 9) AS block_change FROM d GROUP BY vec_id""")
def block_means(spark, sf_dir):
    s = _vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("t", "x"))
    b = s.groupBy("vec_id", F.expr("t div 16").alias("block")).agg(F.avg("x").alias("m"))
    d = b.withColumn("d", F.abs(F.col("m") - F.lag("m").over(Window.partitionBy("vec_id").orderBy("block"))))
    return d.groupBy("vec_id").agg(F.avg("m").alias("block_mean"), F.avg("d").alias("block_change"))


@query("""WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS t FROM embeddings),
w AS (SELECT vec_id, s // 8 AS win, x * (0.5 - 0.5 * cos(2 * pi() * (t - s) / 15)) AS x, t - s AS i FROM s, range(0, 49, 8) AS r(s) WHERE t >= s AND t < s + 16),
g AS (SELECT vec_id, win, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 16)), 2) + pow(sum(x * sin(2 * pi() * k * i / 16)), 2)) AS mag FROM w, range(0, 8) AS b(k) GROUP BY ALL)
SELECT vec_id, k, round(ln(avg(mag) / 16 + 1e-8), 4) AS welch FROM g GROUP BY vec_id, k""")
def welch_bins(spark, sf_dir):
    s = _vectors(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(8))).alias("s"), "v")
    w = s.select("vec_id", "s", F.posexplode(vx.hann(F.slice("v", F.col("s") + 1, 16))).alias("i", "x"), F.expr("sequence(0, 7)").alias("ks")).select("vec_id", "s", "i", "x", F.explode("ks").alias("k"))
    a = 2 * math.pi * F.col("k") * F.col("i") / 16
    g = w.groupBy("vec_id", "s", "k").agg(F.sqrt(F.sum(F.col("x") * F.cos(a)) ** 2 + F.sum(F.col("x") * F.sin(a)) ** 2).alias("mag"))
    return g.groupBy("vec_id", "k").agg(F.round(F.log(F.avg("mag") / 16 + 1e-8), 4).alias("welch"))


@query("""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM p)
SELECT vec_id, round(x / l, 9) AS ux, round(y / l, 9) AS uy, round(z / l, 9) AS uz, round(abs(l - 1), 9) AS error FROM n WHERE l > 1e-8""")
def unit_vectors(spark, sf_dir):
    v = [F.col("embedding")[k].cast("double") for k in range(3)]
    length = vx.magnitude(*v)
    u = vx.unit(*v)
    return table(spark, sf_dir, "embeddings").where(length > 1e-8).select("vec_id", *(c.alias(n) for c, n in zip(u, ("ux", "uy", "uz"), strict=True)), F.abs(length - 1).alias("error"))


@query("""WITH n AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), e AS (SELECT *, abs(sqrt(x * x + y * y + z * z) - 1) AS e FROM n)
SELECT label::BIGINT AS label, count(*) AS n, round(avg(e), 9) AS error, round(quantile_cont(e, 0.995), 9) AS q995,
  (count(*) >= 50 AND max(x) >= 0.1 AND max(y) >= 0.1 AND max(z) >= 0.1 AND min(x) <= -0.1 AND min(y) <= -0.1 AND min(z) <= -0.1) AS covered FROM e GROUP BY label""")
def calibration_error(spark, sf_dir):
    x, y, z = (F.col("embedding")[k].cast("double") for k in range(3))
    e = F.abs(vx.magnitude(x, y, z) - 1)
    cover = F.count("*") >= 50
    for v in (x, y, z):
        cover = cover & (F.max(v) >= 0.1) & (F.min(v) <= -0.1)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg(e).alias("error"), F.percentile(e, F.lit(0.995)).alias("q995"), cover.alias("covered"))


@query()
def sphere_calibration(spark, sf_dir):
    """Unit vectors out of the embeddings, distorted by a known error, calibrated per label."""
    p = table(spark, sf_dir, "embeddings").select("label", *((F.col("embedding")[k].cast("double")).alias(a) for k, a in enumerate("xyz")))
    p = p.where(vx.magnitude(F.col("x"), F.col("y"), F.col("z")) > 1e-6)
    u = vx.unit(F.col("x"), F.col("y"), F.col("z"))
    bent = [((c - o) / s).alias(n) for c, o, s, n in zip(u, (0.012, -0.018, 0.015), (0.985, 1.022, 0.994), ("xMean", "yMean", "zMean"), strict=True)]
    return calibration.calibrate(p.select("label", *bent), "label", temp=None, errors=None)


@query("""SELECT event_id, '01:30:00' AS shift, round(ceil(value * 1e6) / 1e6, 9) AS up6, round(value, 3) AS half3, (635887368000000000 + event_id * 10000 - 621355968000000000) // 10000 AS tick_ms,
  event_id * 1000 - 5400000 AS shifted FROM events""")
def device_times_and_rounding(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lit("01:30:00").alias("shift"), tx.rounded_up(F.col("value"), 6).alias("up6"), F.round("value", 3).alias("half3"), tx.ticks_millis(F.lit(635887368000000000) + i * 10000).alias("tick_ms"), tx.shifted_millis(i * 1000, F.lit("01:30:00")).alias("shifted"))


@query("""WITH r AS (SELECT event_id, event_id % 4096 AS raw, event_id % 65536 AS word FROM events)
SELECT event_id, (CASE WHEN raw > 2048 THEN raw - 4096 ELSE raw END)::BIGINT AS signed12, ((word >> 5) & 31)::BIGINT AS bits, round((word * 150 - 20500) / 1000, 9) AS temp, round((CASE WHEN word >= 32768 THEN word - 65536 ELSE word END) / 256, 9) AS g FROM r""")
def raw_decoding(spark, sf_dir):
    raw, word = F.col("event_id") % 4096, F.col("event_id") % 65536
    signed = F.conv(F.lpad(F.hex(raw), 3, "0"), 16, 10).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.when(signed > 2048, signed - 4096).otherwise(signed).alias("signed12"), F.shiftright(word, 5).bitwiseAND(F.lit(31)).alias("bits"), ((word * 150 - 20500) / 1000).alias("temp"), (F.when(word >= 32768, word - 65536).otherwise(word) / 256).alias("g"))


@query()
def epoch_features(spark, sf_dir):
    """events as one-axis samples at 100 per day, in epochs of a day's length each: all model features."""
    e = table(spark, sf_dir, "events")
    first = F.unix_micros(F.min("ts").over(Window.partitionBy("user_id")).cast("timestamp"))
    # 600 seconds stand for a day of events, so that an epoch holds a handful of samples
    t = F.timestamp_micros(F.expr("cast((unix_micros(cast(ts as timestamp)) - t0) / 8640 as bigint)")).cast("timestamp_ntz")
    s = e.withColumn("t0", first).select("user_id", t.alias("t"), (F.col("value") / 250).alias("x"), (F.col("event_id") % 7 / 7.0).alias("y"), F.lit(0.1).alias("z"), F.lit(20.0).alias("temp"), F.lit(False).alias("clip_before"), F.lit(False).alias("clip_after"))
    return signal.epoch_features(s, "user_id", period=120, rate=10, low_pass=4.0, least=10)
