"""The views of ``sources.views`` as SQL, for the queries' SQL."""

from .sqlparts import ar, corr

VIEWS = {
    "bars": "SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (sum(l_quantity) * 100) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2",
    "bench": "SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (sum(l_quantity) * 100) AS close FROM lineitem GROUP BY 1",
    "mbars": "SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2",
    "mbench": "SELECT CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS bclose FROM bench GROUP BY 1",
    "sectors": "SELECT s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "mp0": "SELECT *, " + ", ".join(f"close / lag(close, {k}) OVER w - 1 AS mom_{k}m" for k in (1, 3, 6, 12)) + " FROM mbars WINDOW w AS (PARTITION BY ticker ORDER BY month)",
    "mpanel": "SELECT mp0.*, CASE WHEN count(mom_1m) OVER w = 6 THEN round(stddev_samp(mom_1m) OVER w, 8) END AS vol_6m, close * volume / 21.0 AS adv, sector FROM mp0 LEFT JOIN sectors USING (ticker) WINDOW w AS (PARTITION BY ticker ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
    "ev0": "SELECT *, lead(close, 1) OVER w AS c1, lead(bclose, 1) OVER w AS b1, lead(close, 3) OVER w AS c3, lead(bclose, 3) OVER w AS b3 FROM mpanel JOIN mbench USING (month) WINDOW w AS (PARTITION BY ticker ORDER BY month)",
    "ev": "SELECT * FROM (SELECT month AS as_of_date, ticker, sector, 20 AS horizon, 'f' || CAST(year(month) AS VARCHAR) AS fold_id, mom_12m AS score, c1 / close - b1 / bclose AS excess_return, adv, vol_6m, mom_1m FROM ev0 UNION ALL SELECT month, ticker, sector, 60, 'f' || CAST(year(month) AS VARCHAR), mom_12m, c3 / close - b3 / bclose, adv, vol_6m, mom_1m FROM ev0) WHERE score IS NOT NULL AND excess_return IS NOT NULL",
    "ls0": "SELECT *, (rank() OVER (PARTITION BY as_of_date, horizon ORDER BY score) + (count(*) OVER (PARTITION BY as_of_date, horizon, score) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of_date, horizon) AS rank_score, (rank() OVER (PARTITION BY as_of_date, horizon ORDER BY excess_return) + (count(*) OVER (PARTITION BY as_of_date, horizon, excess_return) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of_date, horizon) AS rank_actual FROM ev",
    "ls1": "SELECT *, round(abs(rank_actual - rank_score), 8) AS rank_loss FROM ls0",
    "ls2": "SELECT *, round(avg(rank_loss) OVER (PARTITION BY ticker, horizon ORDER BY as_of_date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 8) AS g_pred, round(quantile_cont(rank_loss, 0.1) OVER (PARTITION BY as_of_date, horizon), 8) AS a_value FROM ls1",
    "ls": "SELECT *, round(greatest(g_pred - a_value, 0.0), 8) AS ehat_raw FROM ls2 WHERE g_pred IS NOT NULL",
    "market": "SELECT *, close / lag(close, 1) OVER (ORDER BY date) - 1 AS ret FROM bench",
    "q0": "SELECT l_suppkey AS ticker, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE) / 10000 AS income, sum(l_quantity) AS equity FROM lineitem GROUP BY 1, 2",
    "st0": "SELECT ticker, period_end, period_end + 45 AS filing_date, period_end + 45 AS observed_at, field, value FROM (UNPIVOT q0 ON revenue, income, equity INTO NAME field VALUE value)",
    "statements": "SELECT * FROM st0 UNION ALL SELECT ticker, period_end, filing_date, observed_at + 30, field, value * 1.5 FROM st0 WHERE field = 'revenue'",
    "pe": "SELECT event_id, user_id AS ticker, event_type, CAST(ts AS DATE) AS event_date, ts AS observed_at, props AS payload, value FROM events",
    "fl": "SELECT as_of_date, ticker, horizon, p1 / p0 - b1.close / b0.close AS excess_return, exit_date FROM (SELECT date AS as_of_date, ticker, 20 AS horizon, close AS p0, lead(close, 20) OVER w AS p1, lead(date, 20) OVER w AS exit_date FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date) UNION ALL SELECT date, ticker, 60, close, lead(close, 60) OVER w, lead(date, 60) OVER w FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) x JOIN bench b0 ON b0.date = as_of_date JOIN bench b1 ON b1.date = exit_date",
    "cal": "SELECT date AS session, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS session_idx FROM (SELECT DISTINCT date FROM bench)",
    "ic": f"SELECT as_of_date, horizon, {corr('x', 'y')} AS rank_ic, count(*) AS n FROM (SELECT *, {ar('score', 'as_of_date, horizon')} AS x, {ar('excess_return', 'as_of_date, horizon')} AS y FROM ev) GROUP BY 1, 2",
}
NEEDS = {"fl": ["bars", "bench"], "cal": ["bench"], "ic": ["ev"], "mbars": ["bars"], "mbench": ["bench"], "mp0": ["mbars"], "mpanel": ["mp0", "sectors"], "ev0": ["mpanel", "mbench"], "ev": ["ev0"], "ls0": ["ev"], "ls1": ["ls0"], "ls2": ["ls1"], "ls": ["ls2"], "market": ["bench"], "st0": ["q0"], "statements": ["st0"]}


def sql(body: str, *views: str, **more: str) -> str:
    """``WITH`` the views (and what they need) and ``more``, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
