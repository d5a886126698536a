"""Evaluation of rule-based predictions on the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import joins
from .base import Tables, query

SCORED = """
s AS (
  SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, (d.n_chars % 101) / 100.0 AS confidence, CASE WHEN d.n_chars % 7 < 5 THEN 1 ELSE 0 END AS guess
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _scored(t: Tables) -> DataFrame:
    """Labels with a guess and a confidence from the text's length."""
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    return t.labels.join(docs, "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic", (F.pmod("n_chars", F.lit(101)) / 100.0).alias("confidence"), F.when(F.pmod("n_chars", F.lit(7)) < 5, 1).otherwise(0).alias("guess")
    )


#: The largest share of a policy's rows that may be wrong.
MOST_WRONG = 0.5


def _exact():
    return F.col("guess") == F.col("quality")


@query(f"""
WITH {SCORED},
p AS (SELECT lang, confidence, count(*) AS n, count(*) FILTER (guess <> quality) AS w FROM s GROUP BY lang, confidence),
t AS (SELECT lang, count(*) AS total FROM s GROUP BY lang),
c AS (SELECT lang, confidence, sum(n) OVER w AS accepted, sum(w) OVER w AS wrong FROM p WINDOW w AS (PARTITION BY lang ORDER BY confidence DESC))
SELECT lang, confidence::DOUBLE AS threshold, CAST(accepted AS BIGINT) AS accepted, round(accepted / total, 12) AS coverage, round(wrong / accepted, 12) AS risk FROM c JOIN t USING (lang)
""")
def risk_coverage(t: Tables) -> DataFrame:
    """W6."""
    return ev.risk_curve(_with_total(t), "confidence", _exact(), F.col("total"), ["lang"])


def _with_total(t: Tables) -> DataFrame:
    scored = _scored(t)
    return scored.join(F.broadcast(scored.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))), "lang")


@query(f"""
WITH {SCORED},
p AS (SELECT lang, confidence, count(*) AS n, count(*) FILTER (guess <> quality) AS w FROM s GROUP BY lang, confidence),
t AS (SELECT lang, count(*) AS total FROM s GROUP BY lang),
c AS (SELECT lang, confidence, sum(n) OVER w AS accepted, sum(w) OVER w AS wrong FROM p WINDOW w AS (PARTITION BY lang ORDER BY confidence DESC)),
k AS (SELECT lang, round(accepted / total, 12) AS coverage, round(wrong / accepted, 12) AS risk FROM c JOIN t USING (lang)),
a AS (SELECT *, (coverage - coalesce(lag(coverage) OVER (PARTITION BY lang ORDER BY coverage), 0)) * risk AS step FROM k)
SELECT lang, round(sum(step), 7) AS area, round(coalesce(max(coverage) FILTER (risk <= 0.001), 0), 9) AS coverage_at_0,
       round(coalesce(max(coverage) FILTER (risk <= 0.005), 0), 9) AS coverage_at_1, round(coalesce(max(coverage) FILTER (risk <= 0.01), 0), 9) AS coverage_at_2
FROM a GROUP BY lang
""")
def area_under_risk(t: Tables) -> DataFrame:
    """A20."""
    return ev.curve_summary(risk_coverage(t), ["lang"])


@query(f"""
WITH {SCORED},
b AS (SELECT CAST(least(floor(confidence * 10), 9) AS BIGINT) AS bin, count(*) AS n, sum(CAST(confidence AS DECIMAL(20,6))) AS c, count(*) FILTER (guess = quality) AS r FROM s GROUP BY 1)
SELECT i.bin, coalesce(n, 0) AS n, round(CAST(c AS DOUBLE) / n, 9) AS mean_confidence, round(r / n, 9) AS accuracy
FROM (SELECT unnest(range(10)) AS bin) i LEFT JOIN b ON b.bin = i.bin
""")
def calibration(t: Tables) -> DataFrame:
    """A18."""
    return ev.calibration(_scored(t), "confidence", _exact())


@query(f"""
WITH {SCORED},
b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, sum(CAST(confidence AS DECIMAL(20,6))) AS c, count(*) FILTER (guess = quality) AS r FROM s GROUP BY 1)
SELECT round(sum(n * abs(round(r / n, 9) - round(CAST(c AS DOUBLE) / n, 9))) / sum(n), 7) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b
""")
def calibration_error(t: Tables) -> DataFrame:
    """A18."""
    return ev.calibration_error(calibration(t))


@query(f"""
WITH {SCORED}
SELECT lang, round(avg((confidence - CASE WHEN guess = quality THEN 1 ELSE 0 END) * (confidence - CASE WHEN guess = quality THEN 1 ELSE 0 END)), 7) AS brier,
       round(avg(-ln(greatest(CASE WHEN guess = quality THEN confidence ELSE 1 - confidence END, 1e-15))), 7) AS log_loss
FROM s GROUP BY lang
""")
def brier_logloss(t: Tables) -> DataFrame:
    """A18."""
    return ev.probability_scores(_scored(t), ["lang"], "confidence", _exact())


@query(f"""
WITH {SCORED},
g AS (SELECT * FROM (VALUES ('0'), ('1'), ('2')) a(gold), (VALUES ('0'), ('1'), ('2')) b(predicted)),
c AS (SELECT CAST(quality AS VARCHAR) AS gold, CAST(guess AS VARCHAR) AS predicted, count(*) AS n FROM s GROUP BY ALL)
SELECT gold, predicted, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (gold, predicted)
""")
def confusion(t: Tables) -> DataFrame:
    """A third value that never occurs keeps its zero cells."""
    return ev.confusion(_scored(t), "quality", "guess", ("0", "1", "2"))


@query(f"""
WITH {SCORED},
v AS (SELECT unnest(['0', '1', '2']) AS value),
k AS (
  SELECT value, count(*) FILTER (CAST(quality AS VARCHAR) = value) AS support, count(*) FILTER (CAST(guess AS VARCHAR) = value) AS claimed,
         count(*) FILTER (CAST(quality AS VARCHAR) = value AND guess = quality) AS hits
  FROM v, s GROUP BY value)
SELECT value, round(CASE WHEN claimed > 0 THEN hits / claimed ELSE 0 END, 9) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 9) AS recall,
       round(CASE WHEN claimed + support > 0 THEN 2 * hits / (claimed + support) ELSE 0 END, 9) AS f1, support FROM k
""")
def precision_recall(t: Tables) -> DataFrame:
    """A17."""
    return ev.precision_recall(confusion(t))


ROLES = ("quality", "toxic", "merchant", "date")


def _slots(t: Tables) -> tuple[DataFrame, DataFrame]:
    scored = _scored(t)
    stack = lambda df, q, x: df.select("doc_id", "source", F.explode(F.array(F.struct(F.lit("quality").alias("role"), q.cast("string").alias("value")), F.struct(F.lit("toxic").alias("role"), x.cast("string").alias("value")))).alias("s")).select("doc_id", "source", "s.*")
    gold = stack(scored, F.col("quality"), F.when(F.col("doc_id") % 3 > 0, F.col("toxic"))).filter("value is not null")
    found = stack(scored, F.col("guess"), F.when(F.col("doc_id") % 4 > 0, F.lit(0))).filter("value is not null")
    return gold, found


SLOTS = f"""
{SCORED},
g AS (SELECT doc_id, source, 'quality' AS role, CAST(quality AS VARCHAR) AS value FROM s UNION ALL SELECT doc_id, source, 'toxic', CAST(toxic AS VARCHAR) FROM s WHERE doc_id % 3 > 0),
p AS (SELECT doc_id, source, 'quality' AS role, CAST(guess AS VARCHAR) AS value FROM s UNION ALL SELECT doc_id, source, 'toxic', '0' FROM s WHERE doc_id % 4 > 0)"""


@query(f"""
WITH {SLOTS},
j AS (SELECT coalesce(g.role, p.role) AS role, g.value AS gv, p.value AS pv FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.role = p.role),
c AS (SELECT role, count(gv) AS eligible, count(*) FILTER (gv = pv) AS exact, count(*) FILTER (gv IS NOT NULL AND pv IS NULL) AS omitted,
             count(*) FILTER (pv IS NOT NULL AND (gv IS NULL OR gv <> pv)) AS hallucinated FROM j GROUP BY role),
n AS (SELECT count(*) AS n FROM s)
SELECT r.role, coalesce(eligible, 0) AS eligible, coalesce(exact, 0) AS exact, coalesce(omitted, 0) AS omitted, coalesce(hallucinated, 0) AS hallucinated,
       round(CASE WHEN coalesce(eligible, 0) > 0 THEN exact / eligible ELSE 0 END, 9) AS exact_rate, round(coalesce(hallucinated, 0) / n, 9) AS hallucination_rate
FROM (SELECT unnest(['quality', 'toxic', 'merchant', 'date']) AS role) r LEFT JOIN c ON c.role = r.role, n
""")
def field_metrics(t: Tables) -> DataFrame:
    """A16."""
    gold, found = _slots(t)
    n = _scored(t).count()
    return ev.field_metrics(gold, found, ["doc_id"], ROLES, F.lit(n))


@query(f"""
WITH {SCORED}, m AS (SELECT source, avg(CASE WHEN guess = quality THEN 1.0 ELSE 0.0 END) AS rate FROM s GROUP BY source)
SELECT count(*) AS n_groups, round(avg(rate), 9) AS macro_rate FROM m
""")
def document_macro(t: Tables) -> DataFrame:
    """Mean of the sources' exact rates."""
    rates = _scored(t).groupBy("source").agg(F.avg(_exact().cast("double")).alias("rate"))
    return rates.agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("rate"), 9).alias("macro_rate"))


@query("""
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type
""")
def nearest_rank_latency(t: Tables) -> DataFrame:
    """A21."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return t.events.groupBy("event_type").agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {SCORED},
u AS (SELECT source, avg(CASE WHEN guess = quality THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) AS effect FROM s GROUP BY source),
k AS (SELECT row_number() OVER (ORDER BY source) - 1 AS place, CAST(effect AS DECIMAL(20,6)) AS effect FROM u),
n AS (SELECT count(*) AS n FROM k),
d AS (SELECT x.sample, CAST('0x' || substr(md5('seed:' || x.sample || ':' || k.place), 1, 8) AS BIGINT) % n.n AS place FROM k, n, (SELECT unnest(range(200)) AS sample) x),
m AS (SELECT d.sample, CAST(sum(k.effect) AS DOUBLE) / count(*) AS mean FROM d JOIN k ON k.place = d.place GROUP BY d.sample)
SELECT round(quantile_disc(mean, 0.025), 9) AS low, round(quantile_disc(mean, 0.975), 9) AS high, count(*) AS samples FROM m
""")
def bootstrap_interval(t: Tables) -> DataFrame:
    """Sources drawn with replacement by hashes that both engines share."""
    effects = _scored(t).groupBy("source").agg((F.avg(_exact().cast("double")) - F.avg((F.col("toxic") == 0).cast("double"))).alias("effect"))
    # one row per source; the place is a rank over them
    placed = effects.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("source")).cast("long") - 1)
    return ev.bootstrap(placed, "source", "effect", 200, "seed")


@query("""
SELECT p_brand, p_partkey FROM part a WHERE NOT EXISTS (
  SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))
""")
def pareto_front(t: Tables) -> DataFrame:
    """Large and cheap parts of a brand, in one sorted pass."""
    return joins.pareto_front(t.part.select("p_brand", "p_partkey", "p_size", "p_retailprice"), ["p_brand"], "p_partkey", ["p_size"], ["p_retailprice"]).select("p_brand", "p_partkey")


@query("""
WITH v AS (
  SELECT s.s_nationkey, s.s_suppkey, s.s_acctbal, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM supplier s JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT s_nationkey, s_suppkey FROM v a WHERE NOT EXISTS (
  SELECT 1 FROM v b WHERE b.s_nationkey = a.s_nationkey AND b.n >= a.n AND b.q >= a.q AND b.s_acctbal >= a.s_acctbal AND (b.n > a.n OR b.q > a.q OR b.s_acctbal > a.s_acctbal))
""")
def pareto_front_three(t: Tables) -> DataFrame:
    """J20 on three axes."""
    figures = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    v = t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal").join(figures, "s_suppkey")
    return joins.pareto_front(v, ["s_nationkey"], "s_suppkey", ["n", "q", "s_acctbal"]).select("s_nationkey", "s_suppkey")


@query(f"""
WITH {SLOTS},
j AS (SELECT coalesce(g.role, p.role) AS role, g.value AS gv, p.value AS pv FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.role = p.role)
SELECT role, count(*) AS slots, count(*) FILTER (gv = pv) AS agreed, round(count(*) FILTER (gv = pv) / count(*), 9) AS rate, count(*) FILTER (gv = pv) / count(*) >= 0.9 AS passes FROM j GROUP BY role
""")
def reviewer_agreement(t: Tables) -> DataFrame:
    """Two reviewers' slots and the gate on their rate."""
    a, b = _slots(t)
    return ev.agreement(a, b, ["doc_id"]).withColumn("passes", F.col("agreed") / F.col("slots") >= 0.9)


@query(f"""
WITH {SCORED},
e AS (SELECT unnest(['none', 'ambiguity', 'row_type', 'false_accept', 'value']) AS category),
k AS (SELECT CASE WHEN confidence = 0.5 THEN 'ambiguity' WHEN guess <> quality AND confidence >= 0.9 THEN 'false_accept' WHEN guess <> quality THEN 'row_type' WHEN toxic = 1 AND confidence < 0.2 THEN 'value' ELSE 'none' END AS category,
             CASE WHEN confidence = 0.5 THEN 1 ELSE 0 END + CASE WHEN guess <> quality THEN 1 ELSE 0 END + CASE WHEN toxic = 1 AND confidence < 0.2 THEN 1 ELSE 0 END AS n FROM s)
SELECT e.category, count(k.category) AS n_primary, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_all FROM e LEFT JOIN k ON k.category = e.category GROUP BY e.category
""")
def error_taxonomy(t: Tables) -> DataFrame:
    """The first category in precedence is primary; zero counts stay."""
    wrong, sure = F.col("guess") != F.col("quality"), F.col("confidence") >= 0.9
    value = (F.col("toxic") == 1) & (F.col("confidence") < 0.2)
    found = F.array_compact(
        F.array(F.when(F.col("confidence") == 0.5, "ambiguity"), F.when(wrong & sure, "false_accept"), F.when(wrong & ~sure, "row_type"), F.when(value, "value"))
    )
    judged = _scored(t).select(F.coalesce(F.get(found, F.lit(0)), F.lit("none")).alias("category"), F.size(found).alias("n"))
    every = t.spark.createDataFrame([(c,) for c in ("none", "ambiguity", "row_type", "false_accept", "value")], "category string")
    counted = judged.groupBy("category").agg(F.count(F.lit(1)).alias("p"), F.sum("n").alias("a"))
    return F.broadcast(every).join(counted, "category", "left").select("category", F.coalesce("p", F.lit(0)).alias("n_primary"), F.coalesce("a", F.lit(0)).alias("n_all"))


@query(f"""
WITH {SCORED},
a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ACCEPT' ELSE 'REJECT' END AS d1, CASE WHEN doc_id % 5 > 0 THEN confidence END AS c1, doc_id % 7 > 0 AS v1,
             CASE WHEN guess = 1 THEN 'ACCEPT' ELSE 'ABSTAIN' END AS d2, 1 - confidence AS c2, quality = 1 AS v2 FROM s),
k AS (SELECT *, d1 = 'ACCEPT' AND coalesce(c1 >= 0.4, false) AND v1 AS t1, d1 = 'ACCEPT' AND (c1 IS NULL OR (c1 >= 0.4 AND NOT v1)) AS s1,
             d2 = 'ACCEPT' AND c2 >= 0.3 AND v2 AS t2, d2 = 'ACCEPT' AND c2 >= 0.3 AND NOT v2 AS s2 FROM a)
SELECT doc_id, CASE WHEN t1 THEN 'baseline' WHEN s1 THEN 'abstain' WHEN t2 THEN 'ocr' WHEN s2 THEN 'abstain' ELSE 'none' END AS arm,
       CASE WHEN t1 THEN 'accepted' WHEN s1 THEN CASE WHEN c1 IS NULL THEN 'baseline_without_confidence' ELSE 'baseline_not_grounded' END
            WHEN t2 THEN 'accepted' WHEN s2 THEN 'ocr_not_grounded' ELSE 'no_arm_accepted' END AS reason
FROM k
""")
def cascade_decide(t: Tables) -> DataFrame:
    """K21."""
    id_ = F.col("doc_id")
    arms = _scored(t).select(
        "doc_id",
        F.when(id_ % 2 == 0, "ACCEPT").otherwise("REJECT").alias("baseline_decision"),
        F.when(id_ % 5 > 0, F.col("confidence")).alias("baseline_confidence"),
        (id_ % 7 > 0).alias("baseline_valid"),
        F.when(F.col("guess") == 1, "ACCEPT").otherwise("ABSTAIN").alias("ocr_decision"),
        (1 - F.col("confidence")).alias("ocr_confidence"),
        (F.col("quality") == 1).alias("ocr_valid"),
    )
    return ev.cascade(arms, [("baseline", 0.4), ("ocr", 0.3)]).select("doc_id", "arm", "reason")


@query(f"""
WITH {SCORED},
p AS (SELECT source, count(*) FILTER (guess = quality) AS exact, count(*) FILTER (guess <> quality) AS errors, count(*) FILTER (toxic = 1) AS omissions, CAST(sum(doc_id) AS BIGINT) AS latency FROM s GROUP BY source)
SELECT source, exact, errors FROM p WHERE errors <= 20 ORDER BY exact DESC, errors, omissions, latency, source LIMIT 1
""")
def policy_choice(t: Tables) -> DataFrame:
    """The best candidate by a tuple of criteria, of those within the caps."""
    wrong = F.col("guess") != F.col("quality")
    p = _scored(t).groupBy("source").agg(F.count_if(~wrong).alias("exact"), F.count_if(wrong).alias("errors"), F.count_if(F.col("toxic") == 1).alias("omissions"), F.sum("doc_id").alias("latency"))
    return ev.choose_policy(p, "source", F.col("errors") <= MOST_WRONG * (F.col("exact") + F.col("errors")), [F.desc("exact"), "errors", "omissions", "latency"]).select("source", "exact", "errors")


@query(f"""
WITH {SCORED},
m AS (SELECT source, count(*) AS n, avg(CASE WHEN guess = quality THEN 1.0 ELSE 0.0 END) AS rate, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) AS base FROM s GROUP BY source)
SELECT source, CASE WHEN n < 5 THEN 'insufficient_data' WHEN rate > base THEN 'recommend' WHEN rate = base THEN 'tie' ELSE 'no_change' END AS verdict FROM m
""")
def recommendation(t: Tables) -> DataFrame:
    """A change only with enough rows and an effect above the baseline."""
    m = _scored(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(_exact().cast("double")).alias("rate"), F.avg((F.col("toxic") == 0).cast("double")).alias("base"))
    return m.select("source", F.when(F.col("n") < 5, "insufficient_data").when(F.col("rate") > F.col("base"), "recommend").when(F.col("rate") == F.col("base"), "tie").otherwise("no_change").alias("verdict"))
