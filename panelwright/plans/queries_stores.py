"""Queries: stores written and read again, upserts, as-of reads, labels by calendar, predicates, scalar columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audits, events, labels, learn, pit, portfolio, universe
from ..sources import stores
from .registry import Views, query, rounded
from .sqlviews import sql

NY = "CAST((({d} + INTERVAL 16 HOUR)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS TIMESTAMP)"


def ny(date: str) -> str:
    """Market close of a date, in SQL."""
    return NY.format(d=date)


def at_ny(date: str, minutes: int) -> str:
    return f"CAST((({date} + INTERVAL {minutes} MINUTE)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS TIMESTAMP)"


def plain_time(c):
    return F.col(c).cast("timestamp_ntz") if isinstance(c, str) else c.cast("timestamp_ntz")


# Stores --------------------------------------------------------------------------------------


@query("feature_store_months", sql("SELECT ticker, month AS date, round(mom_1m, 6) AS mom_1m, round(adv, 6) AS adv FROM mpanel WHERE month BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND sector IN ('ASIA', 'EUROPE', 'AFRICA')", "mpanel"))
def feature_store_months(v: Views):
    path = v.folder("features")
    stores.write_features(v.mpanel.drop("date").withColumnRenamed("month", "date"), path)
    d = stores.scan(v.spark, path, ["ticker", "date", "mom_1m", "adv"], "date", "1993-01-01", "1997-12-31", {"sector": ["ASIA", "EUROPE", "AFRICA"]})
    return d.select("ticker", "date", F.round("mom_1m", 6).alias("mom_1m"), F.round("adv", 6).alias("adv"))


@query("label_store_matured", sql("SELECT as_of_date, ticker, horizon, round(excess_return, 6) AS excess_return, exit_date FROM fl WHERE as_of_date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND horizon = 20 AND exit_date <= DATE '1997-06-30'", "fl"))
def label_store_matured(v):
    path = v.folder("labels")
    stores.write_labels(v.labels, path)
    d = stores.query_labels(stores.scan(v.spark, path), None, "1993-01-01", "1997-12-31", [20], "1997-06-30")
    return rounded(d.select("as_of_date", "ticker", "horizon", "excess_return", "exit_date"))


@query("mature_labels", sql("SELECT horizon, count(*) AS n_known, count(*) FILTER (exit_date <= as_of_date + 45) AS n_known_in_45 FROM fl WHERE exit_date <= DATE '1996-12-31' GROUP BY 1", "fl"))
def mature_labels(v):
    d = labels.mature_labels(v.labels, S.close_utc(F.lit("1996-12-31").cast("date")))
    return d.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_known"), F.count_if(labels.mature_at_close("label_matured_at", F.date_add("as_of_date", 45))).alias("n_known_in_45"))


REGIME = "SELECT month AS date, bclose / lag(bclose) OVER (ORDER BY month) - 1 AS market_return FROM mbench"


def month_regime(v):
    w = Window.orderBy("month")  # a row a month
    return v.mbench.select(F.col("month").alias("date"), (F.col("bclose") / F.lag("bclose").over(w) - 1).alias("market_return"))


def month_features(v):
    return v.mpanel.select(F.col("month").alias("date"), "ticker", "mom_1m", "adv")


def month_labels(v):
    return v.ev.select("as_of_date", "ticker", "horizon", "excess_return", S.close_utc(F.date_add("as_of_date", F.col("horizon") * 2)).alias("label_matured_at"))


@query("panel_with_labels_and_regime", sql("SELECT p.month AS date, p.ticker, round(mom_1m, 6) AS mom_1m, round(a.excess_return, 6) AS excess_return_20d, round(b.excess_return, 6) AS excess_return_60d, round(market_return, 6) AS market_return FROM mpanel p JOIN ev a ON a.ticker = p.ticker AND a.as_of_date = p.month AND a.horizon = 20 JOIN ev b ON b.ticker = p.ticker AND b.as_of_date = p.month AND b.horizon = 60 LEFT JOIN rg ON rg.date = p.month".replace("SELECT p.month AS date, p.ticker, round(mom_1m", "SELECT p.month AS date, p.ticker, round(p.mom_1m"), "mpanel", "ev", "mbench", rg=REGIME))
def panel_with_labels_and_regime(v):
    d = stores.load_panel(month_features(v), month_labels(v), month_regime(v), [20, 60])
    return rounded(d.select("date", "ticker", "mom_1m", "excess_return_20d", "excess_return_60d", "market_return"))


@query("modeling_rows", sql("SELECT p.month AS date, p.ticker, round(p.mom_1m, 6) AS mom_1m, round(a.excess_return, 6) AS excess_return, round(market_return, 6) AS market_return FROM mpanel p LEFT JOIN ev a ON a.ticker = p.ticker AND a.as_of_date = p.month AND a.horizon = 20 LEFT JOIN rg ON rg.date = p.month", "mpanel", "ev", "mbench", rg=REGIME))
def modeling_rows(v):
    return rounded(stores.modeling_table(month_features(v), month_labels(v), month_regime(v), 20).select("date", "ticker", "mom_1m", "excess_return", "market_return"))


@query("price_upsert", sql("SELECT ticker, date, CASE WHEN date >= DATE '1996-01-01' THEN close * 2 ELSE close END AS close FROM bars", "bars"))
def price_upsert(v):
    old = v.bars.withColumn("observed_at", S.close_utc("date"))
    again = old.where("date >= DATE '1996-01-01'")
    new = again.withColumn("close", F.col("close") * 3).unionByName(again.withColumns({"close": F.col("close") * 2, "observed_at": F.col("observed_at") + F.expr("INTERVAL 1 HOUR")}))
    return stores.upsert_prices(old, new).select("ticker", "date", "close")


@query("statement_ingest", sql("SELECT ticker, period_end, field, round(CASE WHEN field = 'income' THEN value + 1 ELSE value END, 2) AS value FROM (UNPIVOT q0 ON revenue, income, equity INTO NAME field VALUE value)", "q0"))
def statement_ingest(v):
    wide = v.statements.where("observed_at = filing_date").groupBy("ticker", "period_end", "observed_at").pivot("field", ["revenue", "income", "equity"]).agg(F.max("value"))
    ids = ["ticker", "period_end"]
    first = stores.ingest_statements(wide, [*ids, "observed_at"], ["revenue", "income", "equity"])
    later = wide.select(*ids, F.date_add("observed_at", 9).alias("observed_at"), (F.col("income") + 1).alias("income"))
    d = pit.upsert(first, stores.ingest_statements(later, [*ids, "observed_at"], ["income"]), [*ids, "field"])
    return d.select(*ids, "field", F.round("value", 2).alias("value"))


@query("statement_history", sql("SELECT ticker, period_end, field, observed_at, value FROM statements", "statements"))
def statement_history(v):
    """Statements ingested on top of what is there: each moment of observation keeps its row."""
    rows = v.statements.select("ticker", "period_end", "field", "observed_at", "value")
    base = rows.where("field = 'equity'")
    wide = rows.where("field <> 'equity'").groupBy("ticker", "period_end", "observed_at").pivot("field", ["revenue", "income"]).agg(F.max("value"))
    d = stores.ingest_statements(wide, ["ticker", "period_end", "observed_at"], ["revenue", "income"], base)
    return d.select("ticker", "period_end", "field", "observed_at", "value")


@query("snapshot_upsert", sql(f"SELECT ticker, month AS date, round(adv, 6) AS adv, {ny('date')} AS observed_at FROM mpanel".replace(ny("date"), ny("mpanel.month")), "mpanel"))
def snapshot_upsert(v):
    new = month_features(v).select("date", "ticker", "adv").withColumn("observed_at", F.lit(None).cast("timestamp"))
    old = new.where("date < DATE '1996-01-01'").withColumns({"adv": F.lit(0.0), "observed_at": S.close_utc("date")})
    d = stores.upsert_with_close(old, new, ["ticker", "date"])
    return d.select("ticker", "date", F.round("adv", 6).alias("adv"), plain_time("observed_at").alias("observed_at"))


@query("event_upsert", sql("SELECT event_id, ticker, event_date, CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS value FROM pe", "pe"))
def event_upsert(v):
    e = v.events.select("event_id", "ticker", "event_date", "observed_at", "value")
    again = e.where("event_id % 2 = 0").withColumns({"value": F.col("value") + 1, "observed_at": F.col("observed_at") + F.expr("INTERVAL 1 DAY")})
    return stores.upsert_events(e, again).select("event_id", "ticker", "event_date", "value")


@query("residual_replace", sql("SELECT sub_model_id, fold_id, count(*) AS n, round(avg(loss), 6) AS mean_loss FROM (SELECT 'h' || horizon AS sub_model_id, fold_id, CASE WHEN horizon = 20 THEN abs(excess_return - score / 2) ELSE abs(excess_return - score) END AS loss FROM ev) GROUP BY 1, 2", "ev"))
def residual_replace(v):
    rows = v.ev.select(F.lit("e1").alias("expert_id"), F.concat(F.lit("h"), "horizon").alias("sub_model_id"), "fold_id", "as_of_date", "ticker", F.col("score").alias("prediction"), F.col("excess_return").alias("actual"))
    old = rows.withColumn("loss", F.abs(F.col("actual") - F.col("prediction")))
    path = v.folder("residuals")
    stores.replace_residuals(old, rows.where("sub_model_id = 'h20'").withColumn("prediction", F.col("prediction") / 2)).write.parquet(path)
    d = stores.scan(v.spark, path, ["sub_model_id", "fold_id", "loss"], where={"expert_id": ["e1"]})
    return rounded(d.groupBy("sub_model_id", "fold_id").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss")))


def text_store(v):
    """Documents as texts of tickers: a third of them is not scored."""
    d = v.table("documents").select(F.concat(F.lit("t"), "doc_id").alias("record_id"), (F.col("doc_id") % 50).alias("ticker"), "source", "text", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("event_date"), (F.col("doc_id") % 3 == 0).alias("scored"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 10 / 10.0).alias("sentiment_score"))
    return d


TX = "SELECT 't' || doc_id AS record_id, doc_id % 50 AS ticker, source, doc_id, DATE '1996-01-01' + CAST(doc_id % 700 AS INTEGER) AS event_date, doc_id % 3 = 0 AS scored, CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 / 10.0::DOUBLE END AS sentiment_score FROM documents"


@query("text_store_scores", sql("SELECT record_id, scored OR doc_id % 5 = 0 AS scored, CASE WHEN doc_id % 5 = 0 THEN 0.75::DOUBLE ELSE sentiment_score END AS sentiment_score FROM tx", tx=TX))
def text_store_scores(v):
    """Insert without repeats, then one bulk update of scores."""
    t = text_store(v)
    d = pit.insert_missing(t.where("ticker < 30"), t.where("ticker >= 20").unionByName(t.where("ticker >= 40")), ["record_id"])
    scores = v.table("documents").where("doc_id % 5 = 0").select(F.concat(F.lit("t"), "doc_id").alias("record_id"), F.lit(0.75).alias("score"))
    return pit.apply_scores(d, scores).select("record_id", "scored", "sentiment_score")


@query("text_scan", sql("SELECT record_id, ticker, event_date FROM tx WHERE source = 'src0' AND event_date BETWEEN DATE '1996-03-01' AND DATE '1997-09-30' AND scored", tx=TX))
def text_scan(v):
    return stores.query_texts(text_store(v), None, "src0", "1996-03-01", "1997-09-30", True).select("record_id", "ticker", "event_date")


@query("unscored_texts", sql("SELECT record_id, 'flag' AS kind FROM tx WHERE NOT scored UNION ALL SELECT record_id, 'no score row' FROM tx WHERE doc_id % 5 <> 0", tx=TX))
def unscored_texts(v):
    t = text_store(v)
    scores = t.where("CAST(substring(record_id, 2) AS BIGINT) % 5 = 0").select("record_id")
    return learn.unscored(t).select("record_id", F.lit("flag").alias("kind")).unionByName(learn.unscored(t, scores).select("record_id", F.lit("no score row").alias("kind")))


@query("adjusted_bars", "SELECT ticker, date, CASE WHEN ticker % 2 = 0 THEN p / 2 ELSE p END AS close, q AS volume FROM (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS p, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_quantity DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1")
def adjusted_bars(v):
    raw = v.table("lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("close"), F.col("l_quantity").alias("volume"))
    raw = raw.withColumn("adj_close", F.when(F.col("ticker") % 2 == 0, F.col("close") / 2))
    return stores.adjusted_bars(raw).select("ticker", "date", "close", "volume")


@query("metrics_store", sql("SELECT as_of_date, horizon, round(rank_ic, 6) AS rank_ic, n FROM ic", "ic"))
def metrics_store(v):
    """Metrics written as Parquet and CSV; read from the CSV by its schema."""
    from ..operators.evaluate import rank_ic

    path = v.folder("metrics")
    stores.write_metrics({"daily": rounded(rank_ic(v.ev))}, path)
    return stores.scan_csv(v.spark, f"{path}/daily.csv", "as_of_date date, horizon int, rank_ic double, n long")


RANKED = "SELECT as_of_date, horizon, ticker, score, excess_return, rank, 100.0::DOUBLE * (n - rank) / greatest(n - 1, 1) AS percentile FROM (SELECT *, CAST(row_number() OVER (PARTITION BY as_of_date, horizon ORDER BY score DESC, ticker) AS INTEGER) AS rank, count(*) OVER (PARTITION BY as_of_date, horizon) AS n FROM ev)"
CATEGORY = "CASE WHEN percentile >= 90 THEN 'top_buy' WHEN percentile >= 70 THEN 'buy' WHEN percentile <= 10 THEN 'strong_avoid' WHEN percentile <= 30 THEN 'avoid' ELSE 'neutral' END"


@query("ranking_export", sql(f"SELECT as_of_date, horizon, ticker, rank, {CATEGORY} AS category, round(percentile, 6) AS percentile FROM rk", "ev", rk=RANKED))
def ranking_export(v):
    path = v.folder("ranking")
    stores.write_ranking(portfolio.rankings(v.ev, ["as_of_date", "horizon"]), path, nested=False)
    d = stores.scan_csv(v.spark, path, "as_of_date date, horizon int, rank int, ticker long, score double, percentile double, category string")
    return rounded(d.select("as_of_date", "horizon", "ticker", "rank", "category", "percentile"))


@query("ranking_export_nested", sql("SELECT as_of_date, horizon, count(*) AS n, min(ticker) FILTER (rank = 1) AS first FROM rk GROUP BY 1, 2", "ev", rk=RANKED))
def ranking_export_nested(v):
    path = v.folder("ranking")
    stores.write_ranking(portfolio.rankings(v.ev, ["as_of_date", "horizon"]), path, nested=True)
    d = v.spark.read.schema("as_of_date date, horizon int, ranking array<struct<rank: int, ticker: long, score: double, category: string>>").json(path)
    return d.select("as_of_date", "horizon", F.size("ranking").cast("long").alias("n"), F.col("ranking")[0]["ticker"].alias("first"))


@query("store_metadata", "SELECT 'n_lineitem' AS key, CAST(count(*) AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 'last_day', CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) FROM lineitem")
def store_metadata(v):
    row = v.table("lineitem").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").cast("date").alias("last")).first()
    path = v.folder("metadata")
    stores.write_metadata(v.spark, {"n_lineitem": str(row["n"]), "last_day": str(row["last"])}, path)
    return stores.scan(v.spark, path, ["key", "value"])


@query("enriched_rows", sql("SELECT e.as_of_date, e.ticker, e.horizon, round(p.vol_6m, 6) AS vol_6m, round(p.mom_3m, 6) AS mom_3m, round(market_return, 6) AS market_return FROM ev e LEFT JOIN mpanel p ON p.ticker = e.ticker AND p.month = e.as_of_date LEFT JOIN rg ON rg.date = e.as_of_date", "ev", "mpanel", "mbench", rg=REGIME))
def enriched_rows(v):
    context = v.mpanel.select(F.col("month").alias("as_of_date"), "ticker", "vol_6m", "mom_3m")
    d = stores.enrich(v.ev.withColumn("vol_6m", F.lit(-1.0)), context, ["as_of_date", "ticker"])
    d = stores.enrich(d, month_regime(v).withColumnRenamed("date", "as_of_date"), ["as_of_date"])
    return rounded(d.select("as_of_date", "ticker", "horizon", "vol_6m", "mom_3m", "market_return"))


@query("bars_replaced_by_ticker", sql("SELECT ticker, count(*) AS n, CAST(sum(volume) AS DOUBLE) AS volume FROM bars WHERE ticker % 4 <> 0 OR date >= DATE '1995-01-01' GROUP BY 1", "bars"))
def bars_replaced_by_ticker(v):
    new = v.bars.where("ticker % 4 = 0 AND date >= DATE '1995-01-01'")
    return pit.replace_groups(v.bars, new, ["ticker"]).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


def identifiers(v):
    return v.table("supplier").select(F.col("s_suppkey").alias("ticker"), F.concat(F.lit("S"), "s_suppkey").alias("stable_id"), F.lit("1990-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_active"))


@query("delisting_close_out", "SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1996-05-31' END AS valid_to, s_suppkey % 4 <> 0 AS is_active FROM supplier")
def delisting_close_out(v):
    gone = identifiers(v).where("ticker % 4 = 0").select("stable_id", F.lit("1996-05-31").cast("date").alias("delisting_date"))
    return pit.close_delisted(identifiers(v), gone).select("ticker", "valid_to", "is_active")


@query("active_tickers", "SELECT as_of, s_suppkey AS ticker FROM supplier, (VALUES (DATE '1996-05-31'), (DATE '1996-06-30')) t(as_of) WHERE s_suppkey % 4 <> 0")
def active_tickers(v):
    gone = identifiers(v).where("ticker % 4 = 0").select("stable_id", F.lit("1996-05-31").cast("date").alias("delisting_date"))
    return pit.active_at(pit.close_delisted(identifiers(v), gone), v.dates("1996-05-31", "1996-06-30"))


@query("facts_flattened", sql("SELECT ticker, field AS concept, CASE WHEN field = 'equity' THEN 'shares' ELSE 'USD' END AS unit, period_end, value, observed_at FROM statements", "statements"))
def facts_flattened(v):
    """Statements nested as filings carry them (taxonomy, concept, unit, facts), and flattened again."""
    fact = F.struct(F.col("period_end").alias("end"), F.col("value").alias("val"), F.col("observed_at").alias("filed"), F.lit("10-Q").alias("form"))
    units = v.statements.groupBy("ticker", "field").agg(F.collect_list(fact).alias("facts")).withColumn("units", F.create_map(F.when(F.col("field") == "equity", "shares").otherwise("USD"), F.col("facts")))
    nested = units.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("field", "units"))).alias("concepts")).select("ticker", F.create_map(F.lit("us-gaap"), F.col("concepts")).alias("facts"))
    d = pit.flatten_facts(nested)
    return d.select("ticker", "concept", "unit", "period_end", "value", "observed_at")


@query("filings_flattened", sql("SELECT ticker, filing_date, CAST(filing_date AS TIMESTAMP) + INTERVAL 17 HOUR AS observed_at, form FROM (SELECT DISTINCT ticker, filing_date, CASE WHEN month(period_end) = 12 THEN '10-K' ELSE '10-Q' END AS form FROM st0) WHERE form = '10-K'", "st0"))
def filings_flattened(v):
    one = v.statements.where("observed_at = filing_date").select("ticker", "filing_date", F.when(F.month("period_end") == 12, "10-K").otherwise("10-Q").alias("form")).distinct()
    one = one.withColumn("accepted", F.concat(F.col("filing_date").cast("string"), F.lit(" 17:00:00")))
    index = one.groupBy("ticker").agg(F.collect_list(F.struct("filing_date", "form", "accepted")).alias("x")).select("ticker", *[F.col(f"x.{c}").alias(c) for c in ("filing_date", "form", "accepted")])
    d = pit.flatten_filings(index, ["filing_date", "form", "accepted"], forms=["10-K"])
    return d.select("ticker", "filing_date", plain_time("observed_at").alias("observed_at"), "form")


@query("event_scan", sql(f"SELECT event_id, ticker, event_date FROM pe WHERE event_type IN (SELECT DISTINCT event_type FROM pe ORDER BY 1 LIMIT 2) AND observed_at <= {ny('DATE {0}')} AND event_date >= CAST({{0}} AS DATE) - 20".replace("{0}", "'2024-01-20'"), "pe"))
def event_scan(v):
    kinds = sorted(r[0] for r in v.events.select("event_type").distinct().collect())[:2]  # a handful of types
    return events.event_scan(v.events, None, kinds, "2024-01-20", 20).select("event_id", "ticker", "event_date")


EX = "SELECT ticker, date, close / lag(close) OVER w - b / lag(b) OVER w AS x FROM (SELECT bars.*, bench.close AS b FROM bars JOIN bench USING (date)) WINDOW w AS (PARTITION BY ticker ORDER BY date)"
ASOF3 = "(VALUES (DATE '1995-06-30'), (DATE '1996-06-30'), (DATE '1997-03-31')) t(as_of)"


@query("excess_windows", sql(f"SELECT as_of, ticker, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY as_of, ticker ORDER BY date DESC) AS k FROM ex JOIN {ASOF3} ON date <= as_of WHERE x IS NOT NULL) WHERE k <= 60 GROUP BY 1, 2 HAVING count(*) = 60", "bars", "bench", ex=EX))
def excess_windows(v):
    d = learn.excess_windows(v.bars, v.bench, v.dates("1995-06-30", "1996-06-30", "1997-03-31"), 60)
    return rounded(learn.forecast(d, name="mean").select("as_of", "ticker", F.size("values").cast("long").alias("n"), "mean"))


@query("window_coverage", sql(f"SELECT as_of, count(*) AS n_total, count(*) FILTER (n = 250) AS n_valid, round(count(*) FILTER (n = 250) / CAST(count(*) AS DOUBLE), 6) AS valid_share FROM (SELECT as_of, ticker, least(count(*), 250) AS n FROM bars JOIN {ASOF3} ON date <= as_of GROUP BY 1, 2) GROUP BY 1", "bars"))
def window_coverage(v):
    return rounded(learn.window_coverage(learn.lookback_windows(v.bars, v.dates("1995-06-30", "1996-06-30", "1997-03-31"), 250, strict=False), 250))


@query("partitions_replaced", sql("SELECT sector, count(*) AS n, round(sum(adv), 2) AS adv FROM (SELECT sector, CASE WHEN sector = 'ASIA' THEN adv * 2 ELSE adv END AS adv FROM mpanel WHERE sector IS NOT NULL) GROUP BY 1", "mpanel"))
def partitions_replaced(v):
    """Only the partition that is written again is replaced."""
    path = v.folder("by-sector")
    d = v.mpanel.where("sector IS NOT NULL").select("ticker", "month", "adv", "sector")
    stores.write_partitions(d, path, ["sector"])
    stores.write_partitions(d.where("sector = 'ASIA'").withColumn("adv", F.col("adv") * 2), path, ["sector"])
    return stores.scan(v.spark, path).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("adv"), 2).alias("adv"))


# Labels ----------------------------------------------------------------------------------------

DIV = "SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) + 14 AS date, round(avg(close) * 0.01, 6) AS dividend FROM bars GROUP BY 1, 2"


def dividends(v):
    d = v.bars.groupBy("ticker", F.date_add(F.trunc("date", "quarter"), 14).alias("date")).agg(F.round(F.avg("close") * 0.01, 6).alias("dividend"))
    return d


TR = "SELECT a.date AS as_of_date, a.ticker, 20 AS horizon, a.close AS p0, e.close AS p1, b0.close AS b0, b1.close AS b1, c1.session AS exit_date, coalesce((SELECT sum(dividend) FROM dv WHERE dv.ticker = a.ticker AND dv.date > a.date AND dv.date <= c1.session), 0) AS cash FROM bars a JOIN cal c0 ON c0.session = a.date JOIN cal c1 ON c1.session_idx = c0.session_idx + 20 JOIN bars e ON e.ticker = a.ticker AND e.date = c1.session JOIN bench b0 ON b0.date = a.date JOIN bench b1 ON b1.date = c1.session"


@query("total_return_labels", sql("SELECT as_of_date, ticker, exit_date, round(cash / p0, 6) AS dividend_yield, round(p1 / p0 - 1 + cash / p0, 6) AS stock_return, round(b1 / b0 - 1, 6) AS benchmark_return, round(p1 / p0 - 1 + cash / p0 - (b1 / b0 - 1), 6) AS excess_return FROM tr", "bars", "bench", "cal", dv=DIV, tr=TR))
def total_return_labels(v):
    d = labels.total_return_labels(v.bars, v.bench, dividends(v), v.calendar, [20])
    return rounded(d.select("as_of_date", "ticker", "exit_date", "dividend_yield", "stock_return", "benchmark_return", "excess_return"))


@query("label_composition", sql("SELECT horizon, count(*) AS n, round(avg((cash > 1e-6)::INT), 6) AS dividend_share, round(avg(cash / p0), 6) AS mean_yield, 0.0::DOUBLE AS fallback_rate FROM tr GROUP BY 1", "bars", "bench", "cal", dv=DIV, tr=TR))
def label_composition(v):
    d = labels.total_return_labels(v.bars, v.bench, dividends(v), v.calendar, [20])
    return rounded(labels.label_composition(d.withColumn("dividend_yield", F.round("dividend_yield", 9))))


FOLDS = "SELECT printf('fold_%02d', row_number() OVER (ORDER BY c)) AS fold_id, DATE '1992-01-01' AS train_start, CAST(c - 131 AS DATE) AS train_end, c AS val_start, CAST(coalesce(lead(c) OVER (ORDER BY c), c + INTERVAL 3 MONTH) AS DATE) AS val_end FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1998-01-01', INTERVAL 3 MONTH)) AS DATE) AS c)"
INFOLD = "SELECT f.fold_id, fl.*, train_end, CASE WHEN as_of_date >= train_start AND as_of_date < train_end THEN 'train' ELSE 'val' END AS part FROM fl JOIN f ON (as_of_date >= train_start AND as_of_date < train_end) OR (as_of_date >= val_start AND as_of_date < val_end)"
PURGE = "CASE WHEN part = 'train' THEN as_of_date + (floor(horizon * 365 / 252.0)::INT + 1) > train_end ELSE as_of_date - (floor(horizon * 365 / 252.0)::INT + 1) < train_end END"


def quarter_folds(v):
    return labels.make_folds(labels.period_starts(v.spark, "1996-01-01", "1998-01-01", 3), "1992-01-01", 3, 90)


@query("fold_rows_matured", sql(f"SELECT fold_id, part, horizon, count(*) AS n, max(exit_date) FILTER (part = 'train') AS last_exit FROM g WHERE NOT ({PURGE}) AND (part = 'val' OR exit_date <= train_end - 1) GROUP BY 1, 2, 3", "fl", f=FOLDS, g=INFOLD))
def fold_rows_matured(v):
    d = labels.fold_rows(v.labels, quarter_folds(v))
    return d.groupBy("fold_id", "part", "horizon").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("part") == "train", F.col("exit_date"))).alias("last_exit"))


@query("purged_anti_join", sql(f"SELECT fold_id, part, count(*) AS n FROM g WHERE NOT ({PURGE}) GROUP BY 1, 2", "fl", f=FOLDS, g=INFOLD))
def purged_anti_join(v):
    d = labels.assign_folds(v.labels, quarter_folds(v))
    keys = ["fold_id", "part", "as_of_date", "ticker", "horizon"]
    return labels.without(d, d.where(labels.purged("as_of_date", "horizon", "train_end", "part")), keys).groupBy("fold_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query("observed_folds", sql("SELECT printf('fold_%02d', row_number() OVER (ORDER BY p)) AS fold_id, train_start, train_end, val_start, val_end FROM (SELECT p, s AS val_start, lead(s) OVER (ORDER BY p) AS val_end, min(s) OVER () AS train_start, CAST(s - 1 AS DATE) AS train_end FROM (SELECT date_trunc('quarter', session) AS p, min(session) AS s FROM cal GROUP BY 1)) WHERE val_end IS NOT NULL AND train_end > train_start", "cal"))
def observed_folds(v):
    return labels.observed_folds(v.calendar)


@query("sampling_grid", sql("SELECT s_suppkey AS ticker, session FROM supplier, cal WHERE isodow(session) = 5", "cal"))
def sampling_grid(v):
    return labels.sampling_grid(v.calendar, v.sectors.select("ticker"), 6)


@query("sessions_between", sql("SELECT as_of_date, ticker, horizon, b.session_idx - a.session_idx AS n_sessions FROM fl JOIN cal a ON a.session = as_of_date JOIN cal b ON b.session = exit_date", "fl", "cal"))
def sessions_between(v):
    return labels.sessions_between(v.labels, v.calendar, "as_of_date", "exit_date").select("as_of_date", "ticker", "horizon", "n_sessions")


@query("optional_columns", sql("SELECT ticker, month, CAST(NULL AS DOUBLE) AS short_interest, round(adv, 6) AS adv FROM mpanel", "mpanel"))
def optional_columns(v):
    return labels.optional_columns(v.mpanel, {"adv": "double", "short_interest": "double"}).select("ticker", "month", "short_interest", F.round("adv", 6).alias("adv"))


# Point in time ---------------------------------------------------------------------------------


@query("visible_events", sql(f"SELECT ticker, month, count(*) AS n, max(observed_at) AS last_seen FROM (SELECT DISTINCT ticker, DATE '2024-01-05' + CAST(7 * k AS INTEGER) AS month FROM pe, generate_series(0, 3) g(k)) p JOIN (SELECT event_id, ticker, event_date, observed_at FROM pe) e USING (ticker) WHERE observed_at <= {ny('p.month')} AND event_date > month - 14 AND event_date <= month GROUP BY 1, 2", "pe"))
def visible_events(v):
    weeks = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.date_add(F.lit("2024-01-05").cast("date"), k * 7))).alias("month")
    panel = v.events.select("ticker").distinct().select("ticker", weeks)
    d = events.visible_events(panel, v.events, date="month", lookback=14)
    return d.groupBy("ticker", "month").agg(F.count(F.lit(1)).alias("n"), F.max(plain_time("observed_at")).alias("last_seen"))


@query("terminal_prices", sql("SELECT ticker AS stable_id, arg_max(value, observed_at) AS terminal_price FROM pe GROUP BY 1", "pe"))
def terminal_prices(v):
    d = v.events.select(F.col("ticker").alias("stable_id"), F.lit("delisting").alias("event_type"), F.col("observed_at").alias("event_date"), F.col("value").alias("terminal_price"))
    return pit.terminal_price(d)


@query("identifier_histories", "SELECT 'S' || s_suppkey AS stable_id, CASE WHEN k = 0 THEN s_name ELSE 'NEW-' || s_name END AS ticker, CASE WHEN k = 0 THEN DATE '1990-01-01' ELSE DATE '1996-07-01' END AS valid_from, CASE WHEN k = 0 AND s_suppkey % 3 = 0 THEN DATE '1996-06-30' END AS valid_to FROM supplier, (VALUES (0), (1)) g(k) WHERE k = 0 OR s_suppkey % 3 = 0")
def identifier_histories(v):
    dim = identifiers(v).drop("ticker").join(v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("stable_id"), F.col("s_name").alias("ticker")), "stable_id")
    changes = dim.where("CAST(substring(stable_id, 2) AS BIGINT) % 3 = 0").select("stable_id", F.concat(F.lit("NEW-"), "ticker").alias("new_ticker"), F.lit("1996-07-01").cast("date").alias("change_date"))
    return pit.identifier_history(pit.apply_ticker_changes(dim, changes)).select("stable_id", "ticker", "valid_from", "valid_to")


@query("first_filing_after", sql("SELECT ticker, period_end, filing_date, form FROM (SELECT p.ticker, p.period_end, f.filing_date, f.form, row_number() OVER (PARTITION BY p.ticker, p.period_end ORDER BY CASE WHEN form = '8-K' THEN 0 ELSE 1 END, f.filing_date, form) AS k FROM (SELECT DISTINCT ticker, period_end FROM q0) p JOIN (SELECT ticker, period_end + 45 AS filing_date, '10-Q' AS form FROM q0 UNION ALL SELECT ticker, period_end + 50, '8-K' FROM q0 WHERE ticker % 2 = 0) f ON f.ticker = p.ticker AND f.filing_date >= p.period_end AND f.filing_date - p.period_end <= 60) WHERE k = 1", "q0"))
def first_filing_after(v):
    periods = v.statements.select("ticker", "period_end").distinct()
    filings = periods.select("ticker", F.date_add("period_end", 45).alias("filing_date"), F.lit("10-Q").alias("form")).unionByName(periods.where("ticker % 2 = 0").select("ticker", F.date_add("period_end", 50).alias("filing_date"), F.lit("8-K").alias("form")))
    return pit.first_after(periods, filings).select("ticker", "period_end", "filing_date", "form")


@query("universe_replay", sql(f"SELECT as_of, ticker, position FROM (SELECT as_of, ticker, CAST(row_number() OVER (PARTITION BY as_of ORDER BY cap DESC, ticker) AS INTEGER) AS position FROM (SELECT as_of, ticker, arg_max(close, date) AS cap FROM bars JOIN {ASOF3} ON date <= as_of GROUP BY 1, 2 HAVING count(*) >= 20)) WHERE position <= 50", "bars"))
def universe_replay(v):
    return pit.replay_universe(v.bars.withColumn("money", F.col("close") * F.col("volume")), v.dates("1995-06-30", "1996-06-30", "1997-03-31"), "close", n=50).select("as_of", "ticker", "position")


# Predicates and classes --------------------------------------------------------------------------


@query("listing_predicates", "SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 AS common, c_custkey % 3 <> 0 OR DATE '1990-01-01' + CAST(c_custkey % 3000 AS INTEGER) > DATE '1995-01-01' AS active, c_custkey % 3 = 0 AND DATE '1990-01-01' + CAST(c_custkey % 3000 AS INTEGER) >= DATE '1992-01-01' AND DATE '1990-01-01' + CAST(c_custkey % 3000 AS INTEGER) < DATE '1994-01-01' AS gone FROM customer")
def listing_predicates(v):
    d = v.table("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "cs").otherwise("ETF").alias("type"), F.lit("STOCKS").alias("market"), F.when(F.col("c_nationkey") % 2 == 0, "US").otherwise("global").alias("locale"), F.when(F.col("c_custkey") % 3 == 0, F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int"))).alias("delisted"))
    day = lambda x: F.lit(x).cast("date")
    return d.select("id", universe.common_stock().alias("common"), universe.active_as_of("delisted", day("1995-01-01")).alias("active"), F.coalesce(universe.delisted_between("delisted", day("1992-01-01"), day("1994-01-01")), F.lit(False)).alias("gone"))


@query("category_rows", sql("SELECT ticker, count(*) AS n FROM bars WHERE ticker IN (SELECT ticker FROM sectors WHERE sector IN ('ASIA', 'EUROPE') OR ticker % 10 = 0) GROUP BY 1", "bars", "sectors"))
def category_rows(v):
    kinds = v.sectors.select("ticker", F.col("sector").alias("category")).unionByName(v.sectors.where("ticker % 10 = 0").select("ticker", F.lit("tens").alias("category")))
    return universe.in_categories(v.bars, kinds, ["ASIA", "EUROPE", "tens"]).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("category_members", sql("SELECT DISTINCT ticker FROM sectors WHERE sector IN ('ASIA', 'EUROPE')", "sectors"))
def category_members(v):
    return universe.category_members(v.sectors.select("ticker", F.col("sector").alias("category")), ["ASIA", "EUROPE"])


@query("ranked_universe", sql("SELECT month, ticker, reason FROM (SELECT month, ticker, CASE WHEN reason = '' AND row_number() OVER (PARTITION BY month, reason ORDER BY coalesce(volume, 0) DESC, ticker) > 40 THEN 'rank' ELSE reason END AS reason FROM (SELECT month, ticker, volume, CASE WHEN close < 1400 THEN 'price' WHEN adv < 5000 THEN 'adv' WHEN volume < 60 THEN 'market_cap' ELSE '' END AS reason FROM mpanel))", "mpanel"))
def ranked_universe(v):
    d = universe.ranked_cascade(v.mpanel, ["month"], 40, cap="volume", least_adv=5000, least_price=1400, least_cap=60)
    return d.select("month", "ticker", F.coalesce("exclusion_reason", F.lit("")).alias("reason"))


@query("universe_turnover", sql("SELECT round(avg((a + r) / CAST(n + b AS DOUBLE)), 6) AS mean_turnover, count(*) AS n_changes FROM (SELECT m, count(i) AS n, count(w) AS b, count(*) FILTER (w IS NULL) AS a, count(*) FILTER (i IS NULL) AS r FROM (SELECT coalesce(x.month, y.nxt) AS m, x.ticker AS i, y.ticker AS w FROM mbars x FULL JOIN (SELECT mbars.ticker, nxt FROM mbars JOIN md USING (month) WHERE nxt IS NOT NULL) y ON x.month = y.nxt AND x.ticker = y.ticker) GROUP BY 1) WHERE b > 0", "mbars", md="SELECT month, lead(month) OVER (ORDER BY month) AS nxt FROM (SELECT DISTINCT month FROM mbars)"))
def universe_turnover(v):
    return rounded(universe.universe_turnover(v.mbars, "month", "ticker"))


MK = "SELECT date, close, ret, close / lag(close, 21) OVER w - 1 AS r21, avg(close) OVER (ORDER BY date ROWS 49 PRECEDING) AS m50, avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) AS m200, row_number() OVER w % 101 AS pct FROM market WINDOW w AS (ORDER BY date)"


@query(
    "market_classes",
    sql(
        "SELECT date, CASE WHEN pct <= 33 THEN 'low' WHEN pct < 67 THEN 'mid' ELSE 'high' END AS vix, CASE WHEN r21 IS NULL THEN 'unknown' WHEN r21 > 0 THEN 'bull' ELSE 'bear' END AS market, CASE WHEN pct < 15 THEN 'low' WHEN pct < 25 THEN 'normal' WHEN pct < 35 THEN 'elevated' ELSE 'high' END AS level, CASE WHEN pct < 25 THEN 0 WHEN pct < 75 THEN 1 WHEN pct < 90 THEN 2 ELSE 3 END AS grade, CASE WHEN close > m200 AND m50 > m200 AND r21 > 0 THEN 'bull' WHEN close < m200 AND m50 < m200 AND r21 < 0 THEN 'bear' ELSE 'neutral' END AS trend, CASE WHEN close > m200 AND m50 > m200 AND r21 > 0 THEN 1 WHEN close < m200 AND m50 < m200 AND r21 < 0 THEN -1 ELSE 0 END AS code, CASE WHEN r21 > 0.02 AND pct / 200.0 < 0.20 THEN 1 WHEN r21 < -0.02 OR pct / 200.0 > 0.30 THEN -1 ELSE 0 END AS by_return, "
        + "CASE WHEN pct >= 90 THEN 'top_buy' WHEN pct >= 70 THEN 'buy' WHEN pct <= 10 THEN 'strong_avoid' WHEN pct <= 30 THEN 'avoid' ELSE 'neutral' END AS category, CASE WHEN pct >= 70 THEN 'high' WHEN pct >= 40 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN ret > 0.02 THEN 'bullish' WHEN ret < -0.02 THEN 'bearish' ELSE 'neutral' END AS direction, pct >= 20 AS trusted, CASE WHEN pct >= 20 AND ret > 0 THEN 'correct_active' WHEN pct >= 20 THEN 'false_active' WHEN ret > 0 THEN 'false_abstain' ELSE 'correct_abstain' END AS verdict, round(1 - 0.5 / (1 + exp(-(pct - 67) / 10.0)), 6) AS calm FROM mk",
        "market",
        mk=MK,
    ),
)
def market_classes(v):
    w = Window.orderBy("date")  # a row a day
    d = v.market.withColumns({"r21": F.col("close") / F.lag("close", 21).over(w) - 1, "m50": F.avg("close").over(w.rowsBetween(-49, 0)), "m200": F.avg("close").over(w.rowsBetween(-199, 0)), "pct": (F.row_number().over(w) % 101).cast("double")})
    trend = S.market_regime_trend("close", "m50", "m200", "r21")
    return rounded(d.select("date", S.vix_bucket("pct").alias("vix"), S.market_bucket("r21").alias("market"), S.vix_level_regime("pct").alias("level"), S.vix_percentile_regime("pct").alias("grade"), trend.alias("trend"), S.regime_code(trend).alias("code"), S.market_regime_return("r21", F.col("pct") / 200.0).alias("by_return"), S.rank_category("pct").alias("category"), S.confidence_bucket(F.col("pct") / 100).alias("confidence"), S.signal_direction("ret").alias("direction"), S.trusted(F.col("pct") / 100).alias("trusted"), S.gate_verdict(S.trusted(F.col("pct") / 100), "ret").alias("verdict"), S.calm_weight("pct").alias("calm")))


@query("period_tags", sql("SELECT period, count(*) AS n FROM (SELECT 'ALL' AS period FROM bench UNION ALL SELECT CASE WHEN date < DATE '1997-01-01' THEN 'DEV' ELSE 'FINAL' END FROM bench UNION ALL SELECT 'CRISIS' FROM bench WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30') GROUP BY 1", "bench"))
def period_tags(v):
    return portfolio.by_period(v.bench, "date", "1997-01-01", ("1995-01-01", "1995-06-30")).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


# Scalar columns ----------------------------------------------------------------------------------

DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders"
NEXT = "(d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)"


@query("observation_times", sql(f"SELECT d, {at_ny(NEXT, 570)} AS next_open, {at_ny('d', 570)} AS before_open, {at_ny('d', 965)} AS after_close, {ny('CAST(d + 45 AS DATE)')} AS by_default, {ny('CAST(d + 10 AS DATE)')} AS short_interest, {at_ny('CAST(d + 1 AS DATE)', 570)} AS etf_flow, {ny('d')} AS holdings FROM days", days=DAYS))
def observation_times(v):
    d = v.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    none = F.lit(None).cast("date")
    cols = {"next_open": S.next_open_utc("d"), "before_open": S.observed_from_report("d", F.lit("BMO")), "after_close": S.observed_from_report("d", F.lit("amc")), "by_default": S.observed_or_default(none, "d"), "short_interest": S.publication_time(F.lit("short_interest"), "d"), "etf_flow": S.publication_time(F.lit("etf_flow"), "d"), "holdings": S.publication_time(F.lit("holdings"), "d")}
    return d.select("d", *[plain_time(c).alias(n) for n, c in cols.items()])


@query("event_timing", "SELECT timing, count(*) AS n FROM (SELECT CASE WHEN h < 9 THEN 'bmo' WHEN h >= 16 THEN 'amc' ELSE 'during' END AS timing FROM (SELECT hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS h FROM events)) GROUP BY 1")
def event_timing(v):
    return v.events.select(S.event_timing("observed_at").alias("timing")).groupBy("timing").agg(F.count(F.lit(1)).alias("n"))


@query("day_counts", "SELECT p_size, CAST(floor(p_size * 365 / 252.0) AS INTEGER) + 1 AS calendar, CAST(floor(p_size * 252 / 365.0) AS INTEGER) AS trading FROM (SELECT DISTINCT p_size FROM part)")
def day_counts(v):
    return v.table("part").select("p_size").distinct().select("p_size", S.calendar_days("p_size").alias("calendar"), S.trading_days("p_size").alias("trading"))


@query(
    "order_costs",
    "SELECT l_orderkey, l_linenumber, round(20 + least(500.0, 10 * sqrt(s)), 6) AS cost_bps, round(s, 6) AS participation, round(0.01 - (20 + least(500.0, 10 * sqrt(s))) / 10000, 8) AS net, 0.01 - (20 + least(500.0, 10 * sqrt(s))) / 10000 > 0 AS survives, round((l_discount - l_tax) / nullif(l_tax, 0) * 100, 6) AS surprise, round(l_tax / nullif(l_discount, 0), 6) AS ratio, round(l_discount / l_quantity * 100, 6) AS move_pct, l_linenumber % 2 = 0 AND l_quantity > 10 AS opened, l_linenumber % 2 = 1 AND l_quantity <= 10 AS closed, abs(l_extendedprice / 2 / (l_extendedprice / 2 + l_tax) - 1) <= 0.01 AS adjusted FROM (SELECT *, CASE WHEN l_extendedprice < 1000 THEN 1.0 ELSE least(l_quantity * 100 / l_extendedprice, 1.0) END AS s FROM lineitem)",
)
def order_costs(v):
    d = v.table("lineitem").withColumns({"value": F.col("l_quantity") * 100, "before": F.col("l_linenumber") % 2, "now": F.when(F.col("l_quantity") > 10, 1).otherwise(0)})
    cost = S.trade_cost_bps("value", "l_extendedprice", F.lit(10.0))
    return d.select("l_orderkey", "l_linenumber", F.round(cost, 6).alias("cost_bps"), F.round(S.participation("value", "l_extendedprice"), 6).alias("participation"), F.round(S.net_return(F.lit(0.01), cost), 8).alias("net"), S.survives(F.lit(0.01), cost).alias("survives"), F.round(S.surprise_pct("l_discount", "l_tax"), 6).alias("surprise"), F.round(S.safe_divide("l_tax", "l_discount"), 6).alias("ratio"), F.round(S.expected_move_pct("l_discount", "l_quantity"), 6).alias("move_pct"), S.new_position("before", "now").alias("opened"), S.closed_position("before", "now").alias("closed"), S.adjustment_holds("l_extendedprice", F.col("l_extendedprice") / 2 + F.col("l_tax"), F.lit(2.0)).alias("adjusted"))


@query("fund_flows", "SELECT o_orderkey, round((o_totalprice - c_acctbal) / nullif(c_acctbal, 0) * 100, 4) AS flow_pct FROM orders JOIN customer ON o_custkey = c_custkey")
def fund_flows(v):
    d = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return d.select("o_orderkey", F.round(S.flow_pct(F.col("o_totalprice") - F.col("c_acctbal"), "c_acctbal"), 4).alias("flow_pct"))


@query("identifier_choice", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CIK:' || c_custkey WHEN c_custkey % 3 = 1 THEN 'FIGI:' || c_name ELSE 'TICKER:' || c_mktsegment END AS stable_id, 'model-' || greatest(1990, least(1996, 1990 + c_custkey % 12 - 1)) AS vintage FROM customer")
def identifier_choice(v):
    d = v.table("customer").withColumns({"cik": F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")), "figi": F.when(F.col("c_custkey") % 3 == 1, F.col("c_name"))})
    return d.select("c_custkey", S.stable_id("cik", "figi", "c_mktsegment").alias("stable_id"), S.model_vintage(F.make_date(1990 + (F.col("c_custkey") % 12).cast("int"), F.lit(6), F.lit(1)), 1990, 1996).alias("vintage"))


@query("distribution_ratios", "SELECT vec_id, round(p75 - p25, 6) AS iqr, round((p95 - p50) / nullif(p50 - p5, 0), 5) AS upside_ratio, round(-p5, 6) AS var95, round(m / nullif(s, 0), 6) AS risk_adjusted, round(first, 6) AS first, round(last, 6) AS last, round(total, 6) AS total, round(trimmed, 6) AS trimmed FROM (SELECT vec_id, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95, avg(x) AS m, stddev_pop(x) AS s, arg_min(x, i) AS first, arg_max(x, i) AS last, sum(x) AS total, avg(x) FILTER (k > floor(n * 0.1::DOUBLE) AND k <= n - floor(n * 0.1::DOUBLE)) AS trimmed FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)) GROUP BY 1)")
def distribution_ratios(v):
    d = v.table("embeddings").withColumn("a", F.col("embedding").cast("array<double>")).withColumn("d", S.sample_distribution("a"))
    f = S.distribution_fields("d")
    return d.select("vec_id", *[F.round(f[n], 5 if n == "upside_ratio" else 6).alias(n) for n in ("iqr", "upside_ratio", "var95", "risk_adjusted")], *[F.round(S.sample_step("a", k), 6).alias(n) for k, n in (("first", "first"), ("last", "last"), ("sum", "total"), ("trimmed", "trimmed"))])


@query("outperform_probability", sql("SELECT ticker, month, mom_3m IS NOT NULL AND vol_6m IS NOT NULL AS known, CASE WHEN vol_6m > 0 THEN CASE WHEN mom_3m / vol_6m > 0 THEN 'above' WHEN mom_3m / vol_6m < 0 THEN 'below' ELSE 'half' END END AS side FROM mpanel", "mpanel"))
def outperform_probability(v):
    p = F.round(S.prob_outperform("mom_3m", "vol_6m"), 9)
    return v.mpanel.select("ticker", "month", p.isNotNull().alias("known"), F.when(p > 0.5, "above").when(p < 0.5, "below").when(p == 0.5, "half").alias("side"))


@query("text_columns", "SELECT doc_id, text IS NOT NULL AND length(trim(text, ' ')) >= 10 AS valid, length(substr(text, 1, 400)) AS n_short FROM documents")
def text_columns(v):
    return v.table("documents").select("doc_id", S.valid_text("text").alias("valid"), F.length(S.truncated("text")).cast("long").alias("n_short"))


@query("item_sections", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') || ' outlook' ELSE text END AS section FROM documents")
def item_sections(v):
    filing = F.concat(F.lit("Item 1. Business here ITEM 7. "), F.coalesce("source", F.lit("")), F.lit(" outlook Item 7A. Market risk"))
    return v.table("documents").select("doc_id", S.item_section(F.when(F.col("doc_id") % 2 == 0, filing).otherwise(F.col("text")), "7").alias("section"))


@query("content_hashes", "SELECT n_nationkey % 5 AS k, count(*) AS n, TRUE AS same FROM nation GROUP BY 1")
def content_hashes(v):
    """The hash of a group's rows does not depend on their order or on how they are dealt."""
    n = v.table("nation").withColumn("k", F.col("n_nationkey") % 5)
    one = lambda d, h: d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), S.content_hash("n_nationkey", "n_name").alias(h))
    return one(n, "a").join(one(n.orderBy(F.desc("n_name")).repartition(3), "b").drop("n"), "k").select("k", "n", (F.col("a") == F.col("b")).alias("same"))


@query("feed_event_rows", sql(f"SELECT event_id, ticker, event_date, {ny('event_date')} AS observed_at, json_extract_string(p, '$.score')::DOUBLE AS score FROM (SELECT ticker || '_sentiment_' || event_date AS event_id, ticker, event_date, json_object('score', round(avg(value), 9)) AS p FROM pe GROUP BY ticker, event_date)", "pe"))
def feed_event_rows(v):
    rows = v.events.groupBy("ticker", F.col("event_date").alias("published")).agg(F.round(F.avg("value"), 9).alias("score"))
    d = events.feed_events(rows, "sentiment")
    return d.select("event_id", "ticker", "event_date", plain_time("observed_at").alias("observed_at"), S.payload_number("payload", "score").alias("score"))


@query("earnings_surprises", "SELECT l_orderkey, l_linenumber, round((l_discount - l_tax) / nullif(l_tax, 0) * 100, 6) AS surprise FROM lineitem")
def earnings_surprises(v):
    rows = v.table("lineitem").withColumns({"eps_actual": F.col("l_discount"), "eps_estimate": F.col("l_tax")})
    return events.earnings_surprise(rows).select("l_orderkey", "l_linenumber", F.round("surprise", 6).alias("surprise"))


# Audits ------------------------------------------------------------------------------------------


@query("usage_violations", sql("SELECT violation, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'no_observation_time' WHEN event_id % 5 = 0 THEN 'used_before_observed' WHEN event_id % 3 = 0 THEN 'observed_before_event' END AS violation FROM pe) WHERE violation IS NOT NULL GROUP BY 1", "pe"))
def usage_violations(v):
    hour = F.expr("INTERVAL 1 HOUR")
    records = v.events.select(F.col("event_id").alias("record_id"), F.when(F.col("event_id") % 7 != 0, F.col("observed_at")).alias("observed_at"), F.when(F.col("event_id") % 3 == 0, F.date_add("event_date", 1)).otherwise(F.col("event_date")).alias("event_date"))
    usage = v.events.select(F.col("event_id").alias("record_id"), F.when(F.col("event_id") % 5 == 0, F.col("observed_at") - hour).otherwise(F.col("observed_at") + hour).alias("used_at"))
    return audits.violation_summary(audits.usage_violations(records, usage))


@query("early_observations", sql(f"SELECT 'filing' AS kind, count(*) AS n FROM statements WHERE observed_at < filing_date + 1 UNION ALL SELECT 'price', count(*) FROM pe WHERE observed_at < {ny('event_date')} UNION ALL SELECT 'feature', count(*) FROM pe WHERE observed_at > {ny('event_date')}", "statements", "pe"))
def early_observations(v):
    n = lambda d, k: d.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(audits.filing_lag(v.statements), "filing").unionByName(n(audits.early_prices(v.events, "event_date"), "price")).unionByName(n(audits.future_features(v.events, "observed_at", "event_date"), "feature"))


@query("premature_labels", sql("SELECT horizon, count(*) AS n, min(as_of_date) AS first FROM fl WHERE exit_date > DATE '1998-06-30' GROUP BY 1", "fl"))
def premature_labels(v):
    d = audits.premature_labels(v.labels, S.close_utc(F.lit("1998-06-30").cast("date")))
    return d.select("horizon", "n", F.col("example.as_of_date").alias("first"))


@query("drifting_attribute", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def drifting_attribute(v):
    return audits.drifting_attribute(v.table("lineitem"), "l_suppkey", "l_returnflag")


@query("price_consistency", sql("SELECT ticker, date, round(ratio, 6) AS ratio FROM (SELECT *, abs(ratio / lag(ratio) OVER w - 1) AS jump FROM (SELECT ticker, date, close / (close / CASE WHEN date < DATE '1995-01-01' THEN 2.0 WHEN ticker % 9 = 0 THEN 30.0 ELSE 1.0 END) AS ratio FROM bars) WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE ratio > 25 OR ratio < 1 / 25.0 OR jump > 0.1", "bars"))
def price_consistency(v):
    factor = F.when(F.col("date") < F.lit("1995-01-01").cast("date"), 2.0).when(F.col("ticker") % 9 == 0, 30.0).otherwise(1.0)
    d = audits.price_consistency(v.bars.withColumn("adjusted", F.col("close") / factor), "close", "adjusted", "ticker", "date")
    return rounded(d.select("ticker", "date", "ratio"))


@query("missing_entities", "SELECT p_partkey AS ticker FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)")
def missing_entities(v):
    return audits.missing_entities(v.table("part").select(F.col("p_partkey").alias("ticker")), v.table("lineitem").where("l_returnflag = 'R' AND l_quantity > 30").select(F.col("l_partkey").alias("ticker")))


@query("identical_patterns", "SELECT n AS n_changes, count(*) AS n_entities, min(k) AS first_entity FROM (SELECT k, count(*) AS n, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS p FROM (SELECT k, d, x - lag(x) OVER (PARTITION BY k ORDER BY d) AS m FROM (SELECT l_suppkey % 40 AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, CASE WHEN l_suppkey % 2 = 0 THEN year(l_shipdate) ELSE month(l_shipdate) END AS x FROM lineitem GROUP BY ALL)) WHERE abs(m) > 0 GROUP BY 1) GROUP BY n, p HAVING count(*) > 1")
def identical_patterns(v):
    d = v.table("lineitem").select((F.col("l_suppkey") % 40).alias("k"), F.trunc("l_shipdate", "month").alias("d"), F.when(F.col("l_suppkey") % 2 == 0, F.year("l_shipdate")).otherwise(F.month("l_shipdate")).alias("x")).distinct()
    return audits.identical_patterns(d, "x", "k", "d")


@query("forecast_checks", sql("SELECT issue, count(*) AS n FROM (SELECT CASE WHEN c1 IS NULL THEN 'no_forecast' WHEN ticker % 5 = 0 AND c1 <> close * 1.25 THEN 'score_differs' WHEN c1 = close THEN 'naive_forecast' END AS issue FROM ev0) WHERE issue IS NOT NULL GROUP BY 1", "ev0"))
def forecast_checks(v):
    w = Window.partitionBy("ticker").orderBy("month")
    d = v.mbars.withColumn("forecast", F.lead("close").over(w)).withColumn("score", F.when(F.col("ticker") % 5 == 0, 0.25).otherwise(F.col("forecast") / F.col("close") - 1))
    return audits.forecast_checks(d, "forecast", "close", "score", 1e-12).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("store_stats", sql("SELECT count(*) AS n, count(DISTINCT ticker) AS n_entities, min(date) AS first, max(date) AS last FROM bars", "bars"))
def store_stats(v):
    return audits.store_stats(v.bars, "ticker", "date")
