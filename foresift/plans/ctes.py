"""Cross-check SQL building blocks: the same inputs as `plans.inputs`, written in DuckDB SQL."""
from __future__ import annotations

from foresift.functions.scores import LEVELS
from foresift.functions.normal import z_values
from foresift.sources.tables import EVENT_LEADS, EVENT_UNIT, ORDER_STEP, PRICE_UNIT, TEST_START

N = len(LEVELS)


# ---- text helpers -----------------------------------------------------------------------------------------------------
def crps(q: str = "q", y: str = "obs") -> str:
    return "2.0*(" + "+".join(f"greatest({t}*({y}-{q}[{i + 1}]),({t}-1.0)*({y}-{q}[{i + 1}]))"
                              for i, t in enumerate(LEVELS)) + f")/{N}.0"


def upper_crps(q: str = "q", y: str = "obs") -> str:
    return "2.0*(" + "+".join(f"greatest({t}*({y}-{q}[{i}]),({t}-1.0)*({y}-{q}[{i}]))"
                              for i, t in ((8, 0.8), (9, 0.9))) + ")/2.0"


def cover(q: str = "q", y: str = "obs") -> str:
    return f"CASE WHEN {y} BETWEEN {q}[1] AND {q}[{N}] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def width(q: str = "q") -> str:
    return f"({q}[{N}]-{q}[1])"


def rank(q: str = "q", y: str = "obs") -> str:
    return f"len(list_filter({q}, lambda x: x < {y}))"


def bundle(q: str = "q", y: str = "obs") -> str:
    return (f"count({y}) AS n, avg({crps(q, y)}) AS crps, avg({upper_crps(q, y)}) AS upper_crps, "
            f"avg({cover(q, y)}) AS coverage_80pct, avg({width(q)}) AS interval_width")


def errors(q: str = "q", y: str = "obs") -> str:
    e = f"({q}[5]-{y})"
    return f"avg({e}) AS bias, avg(abs({e})) AS mae, sqrt(avg({e}*{e})) AS rmse"


def gaussian(mu: str, sigma: str) -> str:
    return "[" + ", ".join(f"{mu} + ({sigma})*CAST({z!r} AS DOUBLE)" for z in z_values(LEVELS)) + "]"


def hash_int(*parts: str) -> str:
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


def season(month: str) -> str:
    return (f"CASE WHEN {month} IN (12,1,2) THEN 'DJF' WHEN {month} IN (3,4,5) THEN 'MAM' "
            f"WHEN {month} IN (6,7,8) THEN 'JJA' ELSE 'SON' END")


def list_quantiles(values: str) -> str:
    return "[" + ", ".join(f"list_aggregate({values}, 'quantile_cont', {t})" for t in LEVELS) + "]"


ISSUE = "valid_time - to_hours(CAST(step_hours AS BIGINT))"
BUCKET = ("CASE WHEN step_hours BETWEEN 0 AND 24 THEN '0-24h' WHEN step_hours BETWEEN 30 AND 72 THEN '24-72h' "
          "WHEN step_hours BETWEEN 78 AND 120 THEN '72-120h' END")
HALF_OPEN = ("CASE WHEN step_hours >= 0 AND step_hours <= 24 THEN '0-24h' WHEN step_hours > 24 AND step_hours <= 72 "
             "THEN '24-72h' WHEN step_hours > 72 AND step_hours <= 120 THEN '72-120h' END")
LIST_LEVELS = "[" + ", ".join(str(t) for t in LEVELS) + "]"
LEAD_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in EVENT_LEADS.items()) + " END"

CTES: dict[str, str] = {
    # archive members, instances, cases, training and test panels
    "am": f"""SELECT l_suppkey AS station_id, year(l_shipdate) AS year_idx, month(l_shipdate) AS time_idx,
        date_trunc('month', l_shipdate)::TIMESTAMP AS issue_time, (((l_linenumber-1)%3)*6)::DOUBLE AS step_hours,
        date_trunc('month', l_shipdate)::TIMESTAMP + to_hours(((l_linenumber-1)%3)*6) AS valid_time,
        l_extendedprice/{PRICE_UNIT}::DOUBLE AS f,
        CASE WHEN l_returnflag <> 'R' THEN l_extendedprice*(1-l_discount)*(1+l_tax)/{PRICE_UNIT}::DOUBLE END AS net,
        (l_orderkey*8+l_linenumber)*{ORDER_STEP} + l_partkey%{ORDER_STEP} AS ord, l_linenumber AS line FROM lineitem""",
    "ac": """SELECT station_id, year_idx, time_idx, issue_time, step_hours, valid_time, avg(f) AS ens_mean,
        var_samp(f) AS ens_var, count(*) AS n_members, arg_min(net, ord) FILTER (net IS NOT NULL) AS t2m_obs,
        quantile_cont(f, """ + LIST_LEVELS + """) AS raw_q FROM am GROUP BY ALL""",
    "ai": "SELECT * FROM ac WHERE ens_var IS NOT NULL AND t2m_obs IS NOT NULL",
    "cases": f"""SELECT year_idx, time_idx, max(valid_time) AS last_valid, min(valid_time)::DATE AS case_date FROM am
        GROUP BY ALL HAVING max(valid_time) < TIMESTAMP '{TEST_START}'""",
    "train": """SELECT a.*, c.case_date FROM ai a JOIN cases c USING (year_idx, time_idx)""",
    "test": f"SELECT * FROM ai WHERE issue_time >= TIMESTAMP '{TEST_START}'",
    "lam": "SELECT sqrt(avg((t2m_obs-ens_mean)*(t2m_obs-ens_mean))/avg(ens_var)) AS lam FROM train",
    "clim": f"SELECT quantile_cont(t2m_obs, {LIST_LEVELS}) AS q FROM train",
    "preds": f"""SELECT 'raw_ensemble' AS method, station_id, valid_time, step_hours, t2m_obs AS obs, raw_q AS q FROM test
        UNION ALL SELECT 'gaussian_ensemble', station_id, valid_time, step_hours, t2m_obs,
          {gaussian('ens_mean', 'sqrt(ens_var)')} FROM test
        UNION ALL SELECT 'inflation_fixed', station_id, valid_time, step_hours, t2m_obs,
          {gaussian('ens_mean', '1.5*sqrt(ens_var)')} FROM test
        UNION ALL SELECT 'inflation_fitted', station_id, valid_time, step_hours, t2m_obs,
          {gaussian('ens_mean', 'lam*sqrt(ens_var)')} FROM test, lam
        UNION ALL SELECT 'climatology', station_id, valid_time, step_hours, t2m_obs, clim.q FROM test, clim""",
    "pl": f"""SELECT *, {crps()} AS c, {ISSUE} AS issue_time FROM preds""",
    # operational stream: members, instances, observed series, freshest covariate
    "em": f"""SELECT CAST(floor(user_id/10) AS BIGINT) AS station_id, date_trunc('day', ts)::TIMESTAMP AS issue_time,
        {LEAD_CASE} AS step_hours, value/{EVENT_UNIT}::DOUBLE AS f, event_id,
        date_trunc('day', ts)::TIMESTAMP + to_hours(CAST({LEAD_CASE} AS BIGINT)) AS valid_time FROM events""",
    "ec": """SELECT station_id, issue_time, step_hours, valid_time, avg(f) AS ens_mean, var_samp(f) AS ens_var,
        count(*) AS n_members, arg_min(f, event_id) AS t2m_obs FROM em GROUP BY ALL""",
    "ei": "SELECT * FROM ec WHERE ens_var IS NOT NULL",
    "oser": """SELECT station_id, valid_time, arg_min(t2m_obs, step_hours) AS y,
        row_number() OVER (PARTITION BY station_id ORDER BY valid_time) AS rn FROM ei GROUP BY station_id, valid_time""",
    "fresh": """SELECT station_id, valid_time, best.m AS x, best.s AS x_sd, freshest_step FROM (
        SELECT station_id, valid_time, arg_min({'m': m, 's': s}, step_hours) AS best, min(step_hours) AS freshest_step
        FROM (SELECT station_id, valid_time, step_hours, avg(f) AS m, stddev_samp(f) AS s FROM em GROUP BY ALL)
        GROUP BY ALL)""",
    "hist": """SELECT o.station_id, list(y ORDER BY rn) AS ys, list(x ORDER BY rn) AS xs, list(x_sd ORDER BY rn) AS sds
        FROM oser o LEFT JOIN fresh f USING (station_id, valid_time) GROUP BY o.station_id""",
    "iss": """SELECT i.station_id, i.issue_time, count(o.rn) AS idx FROM (SELECT DISTINCT station_id, issue_time FROM ei) i
        LEFT JOIN oser o ON o.station_id = i.station_id AND o.valid_time < i.issue_time GROUP BY ALL""",
    "fut": """SELECT station_id, issue_time, list(step_hours ORDER BY step_hours) AS steps,
        list(ens_mean ORDER BY step_hours) AS means, list(sqrt(ens_var) ORDER BY step_hours) AS sds,
        list(t2m_obs ORDER BY step_hours) AS obs FROM ei GROUP BY ALL""",
    "ser": f"""SELECT CAST(floor(user_id/5) AS BIGINT) AS series_id,
        date_trunc('day', ts)::TIMESTAMP + to_hours(CAST(floor(hour(ts)/6)*6 AS BIGINT)) AS ts,
        avg(value/{EVENT_UNIT}::DOUBLE) AS value FROM events GROUP BY ALL""",
    "stn": """SELECT s_suppkey AS station_id, s_name AS station_name, 40.0::DOUBLE + s_nationkey*0.7::DOUBLE AS lat,
        5.0::DOUBLE + s_nationkey*0.4::DOUBLE AS lon, s_acctbal/7.3::DOUBLE AS alt FROM supplier""",
}


def jobs(length: int, gap: int = 0) -> str:
    """Context jobs of one length as a sub-select: station, issue, context, past, leads."""
    lo = f"idx-{gap + length - 1}"
    return f"""SELECT i.station_id, i.issue_time, h.ys[{lo}:idx-{gap}] AS context, h.xs[{lo}:idx] AS past,
        h.sds[{lo}:idx] AS past_sd, f.steps, f.means, f.sds, f.obs
        FROM iss i JOIN hist h USING (station_id) JOIN fut f USING (station_id, issue_time)
        WHERE idx >= {length + gap} AND len(list_filter(h.xs[{lo}:idx], lambda x: x IS NULL)) = 0"""


def run_rows(length: int, gap: int = 0) -> str:
    """Predictions of the context climatology from one job set, one row per lead."""
    where = ("" if not gap else " WHERE steps = list_transform(range(len(steps)), lambda i: (i*6)::DOUBLE)")
    return f"""SELECT station_id, issue_time, issue_time + to_hours(CAST(unnest(steps) AS BIGINT)) AS valid_time,
        unnest(steps) AS step_hours, unnest(obs) AS obs, {list_quantiles('context')} AS q,
        list_transform({LIST_LEVELS}, lambda t: context[{length}]) AS qp FROM ({jobs(length, gap)}){where}"""


CONTEXTS = (4, 8, 16)
CTES["runs"] = " UNION ALL ".join(
    f"SELECT 'context_climatology' AS model, {c} AS context_steps, station_id, valid_time, step_hours, obs, q "
    f"FROM ({run_rows(c)}) UNION ALL "
    f"SELECT 'persistence', {c}, station_id, valid_time, step_hours, obs, qp FROM ({run_rows(c)})" for c in CONTEXTS)
CTES["gapruns"] = (f"SELECT 'context_climatology' AS model, 'nogap' AS variant, station_id, valid_time, step_hours, obs, q "
                   f"FROM ({run_rows(8)}) UNION ALL SELECT 'context_climatology', 'gap4', station_id, valid_time, "
                   f"step_hours, obs, q FROM ({run_rows(8, 4)})")


def lead_matched_rows(window: int) -> str:
    """Lead-matched instances of one window on the operational stream."""
    return f"""SELECT t.station_id, t.step_hours, t.day, t.k, list(c.y ORDER BY c.day) FILTER (c.day <= t.day - t.k) AS context,
        list(c.x ORDER BY c.day) AS covariate, any_value(t.y) AS obs
        FROM dly t JOIN dly c ON c.station_id = t.station_id AND c.step_hours = t.step_hours
          AND c.day BETWEEN t.day - t.k - {window} + 1 AND t.day
        WHERE t.y IS NOT NULL GROUP BY ALL
        HAVING count(c.x) = {window} + t.k AND count(*) FILTER (c.day <= t.day - t.k AND c.y IS NOT NULL) = {window}"""


CTES["dly"] = """SELECT station_id, step_hours, datediff('day', DATE '1970-01-01', issue_time::DATE) AS day,
    CAST(floor(step_hours/24) AS BIGINT) + 1 AS k, t2m_obs AS y, ens_mean AS x, sqrt(ens_var) AS x_sd FROM ei"""
CTES["lm5"] = lead_matched_rows(5)
CTES["lm10"] = lead_matched_rows(10)
