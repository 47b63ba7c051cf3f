"""Queries on priority, decision memory and its read views."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostelry.functions.hashing import fingerprint, set_fingerprint
from hostelry.operators import decisions as op
from hostelry.operators.snapshots import newest
from hostelry.plans import views
from hostelry.plans.registry import query
from hostelry.plans.views import DECISIONS_SQL

SIGNALS_SQL = f"""{DECISIONS_SQL},
    signals AS (SELECT as_of, decision_type, CAST(identity AS VARCHAR) AS target, run_sequence, CAST(run_sequence * 37 % 5000 AS DECIMAL(20,6)) / 100 AS one,
            CAST(run_sequence * 91 % 900 AS DECIMAL(20,6)) / 100 AS two, CAST(run_sequence % 75 AS INTEGER) AS days, CAST(50 + run_sequence % 50 AS INTEGER) AS confidence,
            'f' || (run_sequence % 10007) AS fingerprint FROM runs WHERE status = 'TRIGGERED')"""


def progress_sql(value: str, threshold: float, saturation: float) -> str:
    v, t, s = f"CAST({value} AS DECIMAL(20,6))", f"{threshold:.2f}", f"{saturation - threshold:.2f}"
    low = f"round(CAST({v} AS DOUBLE) * 50 / {t}::DOUBLE, 6)"
    high = f"round(50 + (CAST({v} AS DOUBLE) - {t}::DOUBLE) * 50 / {s}::DOUBLE, 6)"
    return f"CAST(CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= {saturation} THEN 100 WHEN {v} <= {threshold} THEN {low} ELSE {high} END AS DECIMAL(20,6))"


IMPACT_SQL = "CASE decision_type {} END".format(
    " ".join(f"WHEN '{k}' THEN {how}({progress_sql('one', *a)}, {progress_sql('two', *b)})" for k, (a, b, how) in op.IMPACT.items())
)
LADDER_SQL = "CASE {} ELSE {} END"
URGENCY_SQL = LADDER_SQL.format(" ".join(f"WHEN days <= {d} THEN {u}" for d, u in op.FORWARD), 20)
SINCE_SQL = LADDER_SQL.format(" ".join(f"WHEN days <= {d} THEN {u}" for d, u in op.SINCE), 10)
ACTION_SQL = "CASE decision_type {} END".format(" ".join(f"WHEN '{k}' THEN {v}" for k, v in op.ACTIONABILITY.items()))
PLACE_SQL = "CASE decision_type {} END".format(" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(op.TIE_ORDER)))
SCORED_SQL = f"""{SIGNALS_SQL},
    parts AS (SELECT *, {IMPACT_SQL} AS impact, CASE WHEN decision_type = 'COST_CPOR_ANOMALY' THEN {SINCE_SQL} ELSE {URGENCY_SQL} END AS urgency,
        {ACTION_SQL} AS actionability FROM signals),
    scored AS (SELECT *, CAST(impact * 0.40 + urgency * 0.25 + confidence * 0.20 + actionability * 0.15 AS DECIMAL(20,8)) AS score FROM parts),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, impact DESC, urgency DESC, confidence DESC, actionability DESC, {PLACE_SQL}, target, fingerprint) AS rank FROM scored)"""


def signals(spark, sf_dir):
    key = F.col("run_sequence")
    hundredth = lambda c: (c.cast("decimal(20,6)") / 100).cast("decimal(20,6)")
    return views.runs(spark, sf_dir).where("status = 'TRIGGERED'").select(
        "as_of",
        "decision_type",
        F.col("identity").cast("string").alias("target"),
        "run_sequence",
        hundredth(key * 37 % 5000).alias("one"),
        hundredth(key * 91 % 900).alias("two"),
        (key % 75).cast("int").alias("days"),
        (50 + key % 50).cast("int").alias("confidence"),
        F.concat(F.lit("f"), (key % 10007).cast("string")).alias("fingerprint"),
    )


def scored(spark, sf_dir):
    kind = F.col("decision_type")
    urgency = F.when(kind == "COST_CPOR_ANOMALY", op.cost_urgency(F.col("days"))).otherwise(op.forward_urgency(F.col("days")))
    rows = signals(spark, sf_dir).withColumns(
        {
            "impact": op.impact(kind, F.col("one"), F.col("two")),
            "urgency": urgency,
            "actionability": op.by_type(kind, {k: F.lit(v) for k, v in op.ACTIONABILITY.items()}),
        }
    )
    return rows.withColumn("score", op.priority(F.col("impact"), F.col("urgency"), F.col("confidence"), F.col("actionability")))


@query(f"WITH {SCORED_SQL} SELECT run_sequence, decision_type, CAST(round(impact * 100) AS BIGINT) AS impact_h, urgency, actionability FROM scored")
def impact_urgency(spark, sf_dir):
    return scored(spark, sf_dir).select("run_sequence", "decision_type", F.round(F.col("impact") * 100).cast("long").alias("impact_h"), "urgency", "actionability")


@query(f"WITH {SCORED_SQL} SELECT as_of, run_sequence, decision_type, target, rank, CAST(round(score * 100) AS BIGINT) AS score_h FROM ranked")
def priority_rank(spark, sf_dir):
    rows = op.ranked(scored(spark, sf_dir), ["as_of"])
    return rows.select("as_of", "run_sequence", "decision_type", "target", "rank", F.round(F.col("score") * 100).cast("long").alias("score_h"))


@query(f"""WITH {SIGNALS_SQL}, coarse AS (SELECT as_of, decision_type, target, 'f' || (run_sequence % 3) AS fingerprint FROM signals)
    SELECT as_of, decision_type, target, min(fingerprint) AS fingerprint, count(*) - 1 AS duplicates, count(DISTINCT fingerprint) > 1 AS conflict FROM coarse GROUP BY ALL""")
def dedupe_conflicts(spark, sf_dir):
    coarse = signals(spark, sf_dir).withColumn("fingerprint", F.concat(F.lit("f"), (F.col("run_sequence") % 3).cast("string")))
    return op.deduplicated(coarse, ["as_of", "decision_type", "target"])


STEPS_SQL = f"""{DECISIONS_SQL},
    marked AS (SELECT *, coalesce(bool_or(status = 'TRIGGERED') OVER w, false) AS ever,
            last_value(CASE WHEN status IN ('TRIGGERED', 'CLEAR') THEN status END IGNORE NULLS) OVER w = 'TRIGGERED' AS is_open
        FROM runs WINDOW w AS (PARTITION BY identity ORDER BY run_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    steps AS (SELECT *, CASE WHEN NOT ever AND status = 'TRIGGERED' THEN 'OPENED' WHEN NOT ever THEN NULL WHEN is_open AND status = 'TRIGGERED' THEN 'OBSERVED'
        WHEN is_open AND status = 'CLEAR' THEN 'RESOLVED' WHEN status = 'TRIGGERED' THEN 'REOPENED' ELSE 'NO_STATE_CHANGE' END AS transition FROM marked)"""


@query(f"WITH {STEPS_SQL} SELECT identity, run_sequence, as_of, status, transition FROM steps")
def lifecycle_transitions(spark, sf_dir):
    return op.transitions(views.runs(spark, sf_dir)).select("identity", "run_sequence", "as_of", "status", "transition")


STATES_SQL = f"""{STEPS_SQL},
    seen AS (SELECT * FROM steps WHERE transition IS NOT NULL),
    folded AS (SELECT identity,
        CASE WHEN arg_max(transition, run_sequence) FILTER (transition <> 'NO_STATE_CHANGE') = 'RESOLVED' THEN 'RESOLVED' ELSE 'OPEN' END AS state,
        min(as_of) AS first_seen, max(as_of) FILTER (status = 'TRIGGERED') AS last_seen, max(as_of) AS last_evaluated,
        arg_max(as_of, run_sequence) FILTER (transition = 'RESOLVED') AS last_resolved, count(*) FILTER (transition IN ('OPENED', 'REOPENED')) AS episodes,
        count(*) FILTER (status = 'TRIGGERED') AS triggered FROM seen GROUP BY ALL),
    memory AS (SELECT * EXCLUDE (last_resolved), CASE WHEN state = 'RESOLVED' THEN last_resolved END AS resolved FROM folded)"""


def memory(spark, sf_dir):
    return op.states(op.transitions(views.runs(spark, sf_dir)))


@query(f"WITH {STATES_SQL} SELECT * FROM memory")
def decision_state(spark, sf_dir):
    return memory(spark, sf_dir)


@query(f"WITH {DECISIONS_SQL} SELECT identity, run_sequence, as_of, status, decision_type FROM runs QUALIFY row_number() OVER (PARTITION BY identity ORDER BY as_of DESC, run_sequence DESC) = 1")
def latest_observation(spark, sf_dir):
    rows = views.runs(spark, sf_dir).drop("value")
    return newest(rows, ["identity"], F.col("as_of").desc(), F.col("run_sequence").desc())


@query(f"""WITH {SCORED_SQL}, last_day AS (SELECT max(as_of) AS d FROM runs), {STATES_SQL.removeprefix(DECISIONS_SQL).lstrip().removeprefix(',')}
    SELECT rank, r.decision_type, target, state, episodes FROM ranked r JOIN memory m ON m.identity = CAST(r.target AS BIGINT) WHERE as_of = (SELECT d FROM last_day)""")
def feed(spark, sf_dir):
    """What the latest day of runs raised, by rank, with what is remembered of each."""
    rows = op.ranked(scored(spark, sf_dir), ["as_of"])
    today = rows.join(F.broadcast(views.runs(spark, sf_dir).agg(F.max("as_of").alias("as_of"))), "as_of")
    kept = memory(spark, sf_dir).select(F.col("identity").cast("string").alias("target"), "state", "episodes")
    return today.join(kept, "target").select("rank", "decision_type", "target", "state", "episodes")


@query(f"""WITH {STATES_SQL} SELECT identity, last_seen, episodes FROM memory WHERE last_seen < DATE '2024-01-28' OR (last_seen = DATE '2024-01-28' AND episodes < 20)
    OR (last_seen = DATE '2024-01-28' AND episodes = 20 AND identity > 50) ORDER BY last_seen DESC, episodes DESC, identity LIMIT 20""")
def keyset_page(spark, sf_dir):
    """The page after a cursor, newest first, then by episodes, then by identity."""
    fields = [(F.col("last_seen"), True, "2024-01-28"), (F.col("episodes"), True, 20), (F.col("identity"), False, 50)]
    rows = memory(spark, sf_dir).where(op.seek(fields)).select("identity", "last_seen", "episodes")
    return rows.orderBy(F.col("last_seen").desc(), F.col("episodes").desc(), "identity").limit(20)


@query(f"WITH {DECISIONS_SQL} SELECT as_of, decision_type, status, count(*) AS n FROM runs GROUP BY ALL")
def status_tallies(spark, sf_dir):
    return views.runs(spark, sf_dir).groupBy("as_of", "decision_type", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {STEPS_SQL} SELECT identity, count(*) FILTER (as_of < last_as_of) AS late FROM
    (SELECT *, max(as_of) OVER (PARTITION BY identity ORDER BY run_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_as_of FROM steps) GROUP BY ALL""")
def out_of_order_runs(spark, sf_dir):
    """Runs for a day before one already evaluated: errors to be refused before any write."""
    by = op.Window.partitionBy("identity").orderBy("run_sequence").rowsBetween(op.Window.unboundedPreceding, -1)
    rows = views.runs(spark, sf_dir).withColumn("last_as_of", F.max("as_of").over(by))
    return rows.groupBy("identity").agg(F.count_if(F.col("as_of") < F.col("last_as_of")).alias("late"))


@query(f"""WITH {DECISIONS_SQL}, last_of_day AS (SELECT identity, as_of, arg_max(run_sequence % 3, run_sequence) AS import_id FROM runs GROUP BY ALL)
    SELECT identity, as_of, import_id, import_id IS DISTINCT FROM lag(import_id) OVER (PARTITION BY identity ORDER BY as_of) AS is_new FROM last_of_day""")
def observation_freshness(spark, sf_dir):
    """A day is new if its last run read another import than the day before it."""
    days = views.runs(spark, sf_dir).groupBy("identity", "as_of").agg(F.max_by(F.col("run_sequence") % 3, "run_sequence").alias("import_id"))
    before = F.lag("import_id").over(op.Window.partitionBy("identity").orderBy("as_of"))
    return days.withColumn("is_new", ~F.col("import_id").eqNullSafe(before))


@query(f"""WITH {DECISIONS_SQL}, f AS (SELECT as_of, sha256('as_of=10:' || as_of || '|identity=' || length(CAST(identity AS VARCHAR)) || ':' || identity
        || '|status=' || length(status) || ':' || status) AS fp FROM runs)
    SELECT as_of, sha256(count(fp) || ':' || sum(CAST('0x' || substr(fp, 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(fp, 16, 15) AS BIGINT))) AS fingerprint, count(*) AS n FROM f GROUP BY ALL""")
def run_fingerprint(spark, sf_dir):
    own = fingerprint(as_of=F.col("as_of"), identity=F.col("identity"), status=F.col("status"))
    rows = views.runs(spark, sf_dir).select("as_of", own.alias("fp"))
    return rows.groupBy("as_of").agg(set_fingerprint(F.col("fp")).alias("fingerprint"), F.count("*").alias("n"))


ADVICE = {
    "REV_PICKUP_LOW": "REVIEW_RATE",
    "REV_OCCUPANCY_RISK": "OPEN_OFFER",
    "REV_OTA_DEPENDENCY": "PUSH_DIRECT",
    "COST_CPOR_ANOMALY": "CHECK_INVOICES",
    "LABOR_OVERSTAFFING": "REVIEW_SHIFTS",
}


@query("WITH {}, l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY identity ORDER BY as_of DESC, run_sequence DESC) = 1) SELECT l.identity, CASE WHEN state = 'RESOLVED' THEN 'NONE' WHEN l.status <> 'TRIGGERED' THEN 'WAIT' ELSE CASE l.decision_type {} END END AS action FROM l JOIN memory m ON m.identity = l.identity".format(
    STATES_SQL, " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ADVICE.items())
))
def recommendation_status(spark, sf_dir):
    last = newest(views.runs(spark, sf_dir), ["identity"], F.col("as_of").desc(), F.col("run_sequence").desc())
    rows = last.join(memory(spark, sf_dir).select("identity", "state"), "identity")
    advice = op.by_type(F.col("decision_type"), {k: F.lit(v) for k, v in ADVICE.items()})
    action = F.when(F.col("state") == "RESOLVED", "NONE").when(F.col("status") != "TRIGGERED", "WAIT").otherwise(advice)
    return rows.select("identity", action.alias("action"))
