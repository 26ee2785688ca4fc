"""Registered queries over time: books and equity at every event, and books kept in synchrony with snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import book, fills
from ..operators.ordered import previous
from ..streaming import depth
from .catalogue import FOLD_SQL, query
from .tape import fills as fill_rows
from .tape import levels, tape

PATH_SQL = """e AS (SELECT r.symbol, r.ns, r.seq, x.side, x.tick, arg_max(x.lots, (x.ns, x.seq)) AS lots FROM l r JOIN l x ON x.symbol = r.symbol AND (x.ns, x.seq) <= (r.ns, r.seq) GROUP BY ALL),
path AS (SELECT symbol, ns, seq, (max(tick) FILTER (side = 'bid' AND lots > 0))::BIGINT AS best_bid, (min(tick) FILTER (side = 'ask' AND lots > 0))::BIGINT AS best_ask,
  coalesce(sum(lots) FILTER (side = 'bid'), 0)::BIGINT AS bid_lots, coalesce(sum(lots) FILTER (side = 'ask'), 0)::BIGINT AS ask_lots, count(*) FILTER (lots > 0) AS levels FROM e GROUP BY symbol, ns, seq)"""


@query(f"WITH {PATH_SQL} SELECT symbol, seq, best_bid, best_ask, (best_bid + best_ask) / 2.0::DOUBLE AS mid, bid_lots, ask_lots, levels FROM path")
def book_path(spark: SparkSession, sf: str) -> DataFrame:
    """The book after every update."""
    return book.path(levels(spark, sf)).select("symbol", "seq", "best_bid", "best_ask", "mid", "bid_lots", "ask_lots", "levels")


STATES_SQL = FOLD_SQL[: FOLD_SQL.index("z AS (")] + (
    "g AS (SELECT symbol, r, unnest(range(1, len(r) + 1)) AS i FROM c), z AS (SELECT symbol, i, list_reduce(list_prepend({'lots': 0::BIGINT, 'cost': 0::BIGINT, 'realized': 0::BIGINT, 'tick': 0::BIGINT}, r[1:i]),"
    + FOLD_SQL[FOLD_SQL.index("lambda s, x") : FOLD_SQL.rindex(" AS v FROM c)")]
    + " AS v FROM g), n AS (SELECT symbol, ns, seq, row_number() OVER (PARTITION BY symbol ORDER BY ns, seq) AS i FROM f), s AS (SELECT n.symbol, n.ns, n.seq, z.v FROM n JOIN z ON n.symbol = z.symbol AND n.i = z.i)"
)


@query(f"WITH {STATES_SQL} SELECT symbol, seq, v.lots AS position, v.cost AS cost, v.realized AS realized FROM s")
def position_path(spark: SparkSession, sf: str) -> DataFrame:
    """Position, cost and realized gain after every fill."""
    return fills.position_path(fill_rows(spark, sf)).select("symbol", "seq", "position", "cost", "realized")


EQUITY_PATH_SQL = f"""{PATH_SQL}, {STATES_SQL},
q AS (SELECT m.symbol, m.ns, m.seq, (best_bid + best_ask) / 2.0::DOUBLE * 100 AS mid, arg_max(s.v, (s.ns, s.seq)) AS v FROM path m LEFT JOIN s ON s.symbol = m.symbol AND s.ns <= m.ns GROUP BY ALL),
u AS (SELECT *, coalesce(v.lots, 0) AS position, coalesce(v.cost, 0) AS cost, coalesce(v.realized, 0) AS realized FROM q),
y AS (SELECT *, realized + CASE WHEN position = 0 THEN 0.0::DOUBLE ELSE position * mid - cost END AS equity FROM u),
w AS (SELECT *, max(greatest(equity, 0.0::DOUBLE)) OVER (PARTITION BY symbol ORDER BY ns, seq) AS peak FROM y)"""


def _equity(spark: SparkSession, sf: str) -> DataFrame:
    marks = book.path(levels(spark, sf)).select("symbol", "ns", "seq", (F.col("mid") * 100).alias("mid"))
    return fills.equity_path(fills.position_path(fill_rows(spark, sf)), marks)


@query(f"WITH {EQUITY_PATH_SQL} SELECT symbol, seq, position, realized, equity, peak, peak - equity AS drawdown FROM w")
def equity_path(spark: SparkSession, sf: str) -> DataFrame:
    """Equity at every change of the book, marked at the mid of that time."""
    return _equity(spark, sf).select("symbol", "seq", "position", "realized", "equity", "peak", "drawdown")


@query(f"WITH {EQUITY_PATH_SQL} SELECT symbol, max(peak) AS peak, arg_max(equity, (ns, seq)) AS final, max(peak - equity) AS max_drawdown FROM w WHERE equity IS NOT NULL GROUP BY symbol")
def marked_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    """Largest drop of the marked equity below its running peak."""
    return fills.drawdown(_equity(spark, sf).where("equity IS NOT NULL"), "equity")


#: Sign-ups are snapshots, views and clicks updates, errors ids that never came; ticks of 0 make a batch invalid.
SYNC_SQL = """o AS (SELECT symbol, seq, kind, k, tick, coalesce(lag(seq) OVER p, 0) AS p, lag(kind) OVER p AS was, count(*) FILTER (kind = 'signup') OVER p AS seg FROM t WHERE kind IN ('signup', 'view', 'click', 'error') WINDOW p AS (PARTITION BY symbol ORDER BY seq)),
d AS (SELECT *, count(*) FILTER (kind = 'error') OVER g AS errors, count(*) FILTER (kind IN ('view', 'click')) OVER g AS nth FROM o WINDOW g AS (PARTITION BY symbol, seg ORDER BY seq)),
b AS (SELECT *, CASE WHEN kind IN ('signup', 'error') OR seg = 0 THEN 0 WHEN errors > 0 OR k % 37 = 5 THEN 1 ELSE 0 END AS bad FROM d),
n AS (SELECT *, sum(bad) OVER (PARTITION BY symbol, seg ORDER BY seq) AS bads FROM b),
r AS (SELECT *, CASE WHEN kind = 'signup' THEN '' WHEN seg = 0 OR bads > bad THEN 'no_snapshot' WHEN bad = 0 THEN '' WHEN errors = 0 THEN 'invalid_book_update' WHEN nth = 1 THEN 'no_bridge' ELSE 'gap' END AS reason FROM n WHERE kind <> 'error'),
v AS (SELECT symbol, seg, seq, 'bid' AS side, 1 + k % 20 AS tick, 1 + k % 3 AS lots FROM r WHERE kind = 'signup' UNION ALL SELECT symbol, seg, seq, 'ask', 21 + k % 40, 1 + k % 2 FROM r WHERE kind = 'signup'
  UNION ALL SELECT symbol, seg, seq, CASE WHEN tick < 2000 THEN 'bid' ELSE 'ask' END, tick // 100 + 1, k % 4 FROM r WHERE kind <> 'signup' AND reason = ''),
x AS (SELECT r.symbol, r.seq, v.side, v.tick, arg_max(v.lots, v.seq) AS lots FROM r JOIN v ON v.symbol = r.symbol AND v.seg = r.seg AND v.seq <= r.seq WHERE r.reason = '' GROUP BY ALL),
y AS (SELECT symbol, seq, (max(tick) FILTER (side = 'bid' AND lots > 0))::BIGINT AS best_bid, (min(tick) FILTER (side = 'ask' AND lots > 0))::BIGINT AS best_ask, count(*) FILTER (lots > 0) AS n_levels FROM x GROUP BY symbol, seq),
h AS (SELECT v.*, lag(lots) OVER (PARTITION BY symbol, seg, side, tick ORDER BY seq) AS had FROM v),
z AS (SELECT symbol, seq, count(*) FILTER (lots <> coalesce(had, 0)) AS n_changes FROM h GROUP BY symbol, seq)"""


@query(f"""WITH {SYNC_SQL}
SELECT r.symbol::VARCHAR AS symbol, r.seq, (sum(CASE WHEN reason IN ('gap', 'no_bridge', 'invalid_book_update') THEN 1 ELSE 0 END) OVER (PARTITION BY r.symbol ORDER BY r.seq))::BIGINT AS epoch,
  reason = '' AND kind <> 'signup' AS synced, reason = '' AS applied, reason, y.best_bid, y.best_ask, coalesce(y.n_levels, 0) AS n_levels, coalesce(z.n_changes, 0) AS n_changes
FROM r LEFT JOIN y ON y.symbol = r.symbol AND y.seq = r.seq LEFT JOIN z ON z.symbol = r.symbol AND z.seq = r.seq""")
def depth_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Books between snapshots, gaps and invalid batches: the stream's synchronizer over a table."""
    t = tape(spark, sf).where("kind IN ('signup', 'view', 'click', 'error')")
    rows = previous(t, ["symbol"], F.floor(F.col("seq") / 1_000_000), ["seq"], {"p": F.col("seq")}).where("kind <> 'error'")
    level = lambda side, tick, lots: F.struct(side.alias("side"), tick.cast("long").alias("tick"), lots.cast("long").alias("lots"))
    k, before, shot = F.col("k"), F.coalesce("p", F.lit(0)), F.col("kind") == "signup"
    own = F.array(level(F.when(F.col("tick") < 2000, "bid").otherwise("ask"), F.when(k % 37 == 5, 0).otherwise(F.floor(F.col("tick") / 100) + 1), k % 4))
    whole = F.array(level(F.lit("bid"), 1 + k % 20, 1 + k % 3), level(F.lit("ask"), 21 + k % 40, 1 + k % 2))
    updates = rows.select("symbol", "seq", F.when(shot, "snapshot").otherwise("depth").alias("kind"), before.alias("first_id"), F.col("seq").alias("last_id"), before.alias("previous_id"), F.when(shot, whole).otherwise(own).alias("levels"))
    return depth.synchronize_table(updates).select("symbol", "seq", "epoch", "synced", "applied", "reason", "best_bid", "best_ask", "n_levels", F.size("changes").cast("long").alias("n_changes"))
