"""Queries on labels, models and agreement, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, hmm, labels
from .tables import table, tidy

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


KINDS = ("click", "error", "purchase", "signup", "view")
#: Made-up class probabilities of an event: its value decides how they are shared out.
SHARES = {k: f"(1 + (event_id * {3 + 2 * j} + {j}) % 7 + CASE WHEN event_type = '{k}' THEN 5 ELSE 0 END)" for j, k in enumerate(KINDS)}
TOTAL = " + ".join(SHARES.values())


def _probabilities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", *(F.expr(f"cast({v} as double) / ({TOTAL})").alias(f"p_{k}") for k, v in SHARES.items()))


@query(f"""WITH p AS (SELECT event_type, {", ".join(f"{v}::DOUBLE / ({TOTAL}) AS p_{k}" for k, v in SHARES.items())} FROM events)
SELECT event_type, {", ".join(f"round(avg(p_{k}), 9) AS p_{k}" for k in KINDS)} FROM p GROUP BY event_type""")
def hmm_emission(spark, sf_dir):
    return hmm.emission(_probabilities(spark, sf_dir), "event_type", [f"p_{k}" for k in KINDS])


@query("""WITH s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY a, b)
SELECT a AS "from", b AS "to", n, round(n / sum(n) OVER (PARTITION BY a), 9) AS p FROM c""")
def hmm_transition(spark, sf_dir):
    return hmm.transitions(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), c AS (SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY a, b)
SELECT a AS "from", b AS "to", n, round(n / sum(n) OVER (PARTITION BY a), 9) AS p FROM c""")
def role_transitions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return hmm.transitions(turns, "conv_id", "turn", "role")


#: A fixed model, so that the path is a function of the rows alone.
MODEL = hmm.Hmm(list(KINDS), [0.2] * 5, [[0.6 if i == j else 0.1 for j in range(5)] for i in range(5)], [[0.52 if i == j else 0.12 for j in range(5)] for i in range(5)])


def _viterbi_sql() -> str:
    """Forward steps as a recursive query over (user, place), one column a state; the path by walking back."""
    log_e = "CASE WHEN o.s = {0} THEN ln(0.6::DOUBLE + 1e-16) ELSE ln(0.1::DOUBLE + 1e-16) END"
    stay, move = "ln(0.52::DOUBLE + 1e-16)", "ln(0.12::DOUBLE + 1e-16)"
    into = lambda j: [f"v{i} + {stay if i == j else move}" for i in range(5)]
    best = lambda j: "greatest(" + ", ".join(into(j)) + ")"
    back = lambda j: "CASE " + " ".join(f"WHEN {x} >= {best(j)} THEN {i}" for i, x in enumerate(into(j))) + " END"
    top = "greatest(v0, v1, v2, v3, v4)"
    first = "CASE " + " ".join(f"WHEN v{i} >= {top} THEN {i}" for i in range(5)) + " END"
    return f"""WITH RECURSIVE o AS (SELECT user_id, event_id, list_position({list(KINDS)}, event_type) - 1 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, r, {", ".join(f"ln(0.2::DOUBLE + 1e-16) + {log_e.format(j)} AS v{j}, 0 AS b{j}" for j in range(5))} FROM o WHERE r = 1
  UNION ALL SELECT o.user_id, o.r, {", ".join(f"{best(j)} + {log_e.format(j)}, {back(j)}" for j in range(5))} FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1),
path AS (SELECT f.user_id, f.r, {first} AS s FROM f JOIN o ON f.user_id = o.user_id AND f.r = o.r WHERE o.r = o.n
  UNION ALL SELECT f.user_id, f.r - 1, [f.b0, f.b1, f.b2, f.b3, f.b4][path.s + 1] FROM path JOIN f ON path.user_id = f.user_id AND path.r = f.r WHERE f.r > 1)
SELECT o.event_id, o.user_id, {list(KINDS)}[path.s + 1] AS smoothed FROM path JOIN o ON path.user_id = o.user_id AND path.r = o.r"""


@query(_viterbi_sql())
def viterbi(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return hmm.smooth(e, "user_id", "event_id", "event_type", MODEL).select("event_id", "user_id", "smoothed")


@query("""SELECT t.l AS y_true, p.l AS y_pred, count(v.doc_id) AS n FROM (SELECT DISTINCT quality::VARCHAR AS l FROM labels UNION SELECT DISTINCT toxic::VARCHAR FROM labels) t,
(SELECT DISTINCT quality::VARCHAR AS l FROM labels UNION SELECT DISTINCT toxic::VARCHAR FROM labels) p LEFT JOIN labels v ON v.quality::VARCHAR = t.l AND v.toxic::VARCHAR = p.l WHERE t.l IS NOT NULL AND p.l IS NOT NULL GROUP BY ALL""")
def confusion_matrix(spark, sf_dir):
    v = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("t"), F.col("toxic").cast("string").alias("p"))
    return labels.confusion(v, "t", "p")


@query("""WITH v AS (SELECT doc_id % 5 AS participant, quality AS t, toxic AS p FROM labels), a AS (SELECT participant, count(*) AS n, sum((t = p)::INT)::DOUBLE / count(*) AS acc FROM v GROUP BY ALL),
m AS (SELECT x.participant, sum(x.n * y.n) AS s FROM (SELECT participant, t, count(*) AS n FROM v GROUP BY ALL) x JOIN (SELECT participant, p, count(*) AS n FROM v GROUP BY ALL) y ON x.participant = y.participant AND x.t = y.p GROUP BY ALL),
e AS (SELECT a.participant, acc, coalesce(s, 0)::DOUBLE / (n * n) AS e FROM a LEFT JOIN m USING (participant))
SELECT participant, round(acc, 9) AS accuracy, round(CASE WHEN e < 1 THEN (acc - e) / (1 - e) END, 9) AS kappa FROM e""")
def kappa_accuracy(spark, sf_dir):
    v = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("participant"), F.col("quality").alias("t"), F.col("toxic").alias("p"))
    return labels.agreement(v, "participant", "t", "p")


REPORT = """c AS (SELECT t.l AS y_true, p.l AS y_pred, count(v.doc_id) AS n FROM (SELECT quality AS l FROM labels UNION SELECT toxic FROM labels) t, (SELECT quality AS l FROM labels UNION SELECT toxic FROM labels) p
  LEFT JOIN labels v ON v.quality = t.l AND v.toxic = p.l GROUP BY ALL),
r AS (SELECT y_true AS l, sum(n) FILTER (WHERE y_true = y_pred) AS hits, sum(n) AS support FROM c GROUP BY ALL), m AS (SELECT y_pred AS l, sum(n) AS made FROM c GROUP BY ALL),
report AS (SELECT l AS label, CASE WHEN made > 0 THEN hits / made ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, support FROM r JOIN m USING (l))"""


@query(f"""WITH {REPORT} SELECT label::BIGINT AS label, round(precision, 9) AS precision, round(recall, 9) AS recall, support::BIGINT AS support,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM report""")
def classification_report(spark, sf_dir):
    return labels.class_report(table(spark, sf_dir, "labels").select("quality", "toxic"), "quality", "toxic")


@query(f"""WITH {REPORT} SELECT round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 9) AS macro_f1 FROM report""")
def macro_f1(spark, sf_dir):
    return labels.macro_f1(table(spark, sf_dir, "labels").select("quality", "toxic"), "quality", "toxic")


@query("""WITH a AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(avg(m), 9) AS met FROM a GROUP BY event_type""")
def met_mean_of_means(spark, sf_dir):
    return labels.met_values(table(spark, sf_dir, "events"), "event_type", "user_id", "value")


_F1 = """s AS (SELECT doc_id % 5 AS fold, quality AS t, toxic AS p FROM labels),
l AS (SELECT fold, t AS l, (t = p)::INT AS hit, 1 AS support, 0 AS made FROM s WHERE t IS NOT NULL UNION ALL SELECT fold, p, 0, 0, 1 FROM s WHERE p IS NOT NULL),
f AS (SELECT fold, l, 2 * coalesce(sum(hit), 0)::DOUBLE / (sum(support) + sum(made)) AS f1, sum(support)::BIGINT AS support FROM l GROUP BY ALL),
folds AS (SELECT fold, avg(f1) AS macro_f1, sum(support)::BIGINT AS n FROM f GROUP BY fold)"""


def _folds(spark, sf_dir):
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("fold"), F.col("quality").alias("t"), F.col("toxic").alias("p"))


@query(f"WITH {_F1} SELECT fold, round(macro_f1, 9) AS macro_f1, n FROM folds")
def fold_scores(spark, sf_dir):
    return labels.fold_scores(_folds(spark, sf_dir), "fold", "t", "p")


@query(f"""WITH {_F1} SELECT round(avg(macro_f1), 9) AS cv_mean_score, round(quantile_cont(macro_f1, 0.25), 9) AS cv_25th_score, round(quantile_cont(macro_f1, 0.75), 9) AS cv_75th_score,
  count(*) AS folds FROM folds""")
def cross_validation(spark, sf_dir):
    return labels.cross_validation(_folds(spark, sf_dir), "fold", "t", "p")


METS = {"view": 1.2, "click": 2.5, "purchase": 3.8}


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 1.2::DOUBLE WHEN 'click' THEN 2.5::DOUBLE WHEN 'purchase' THEN 3.8::DOUBLE END AS "MET",
  CASE WHEN event_type = 'error' THEN CASE WHEN value > 400 THEN 'vigorous' WHEN value >= 100 THEN 'moderate' ELSE 'light' END ELSE event_type END AS label FROM events""")
def met_and_relabel(spark, sf_dir):
    e = labels.with_met(table(spark, sf_dir, "events"), "event_type", METS)
    return e.select("event_id", "MET", labels.split_other(F.col("event_type"), F.col("value"), "error", "light", "moderate", "vigorous").alias("label"))


@query("""SELECT vec_id, (label IS NOT NULL AND len(embedding) = 64 AND isfinite(list_sum(embedding))) AS usable FROM embeddings""")
def finite_features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("s", F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v))
    return e.select("vec_id", (F.col("label").isNotNull() & (F.size("embedding") == 64) & labels.finite(["s"])).alias("usable"))


COMPONENTS = [f"f{k}" for k in range(64)]


def _features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"), *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(COMPONENTS)))


@query()
def rf_predict(spark, sf_dir):
    """A balanced forest on part of the vectors, by id, predicts all of them."""
    v = _features(spark, sf_dir)
    model = forest.train(v.where("vec_id % 4 <> 0"), "label", COMPONENTS, trees=20, depth=6)
    return forest.predict(model, v, COMPONENTS).select("vec_id", "label", "prediction", F.array_max("probabilities").alias("top_probability"))


@query()
def rf_cross_predict(spark, sf_dir):
    v = _features(spark, sf_dir)
    return forest.cross_predict(v, "label", COMPONENTS, F.col("vec_id") % 3, k=3, trees=10, depth=5).select("vec_id", "label", "prediction")
