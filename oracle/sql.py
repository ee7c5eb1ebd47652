"""The registered queries as plain SQL for another engine.

Written from the meaning of each result, not from the Spark plans: prices by
``row_number``, launch fan-out by spelled-out joins, medians and ranks built in.
"""

from __future__ import annotations

WINDOW_START = "TIMESTAMP '2024-01-16'"
NOW = "TIMESTAMP '2024-04-15'"
TREND_START = "TIMESTAMP '2024-02-15'"


def rd(expression: str, digits: int = 4) -> str:
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def exact(expression: str) -> str:
    """Order-independent sum of doubles."""
    return f"CAST(SUM(CAST({expression} AS DECIMAL(28,10))) AS DOUBLE)"


def mean(expression: str) -> str:
    return f"({exact(expression)} / COUNT(*))"


def reach(pct: int) -> str:
    return f"COUNT(*) FILTER (return_pct >= {pct})"


def hours(start: str, end: str) -> str:
    return f"date_sub('hour', {start}, {end})"


# Labels are spelled out here, so that a wrong one in the library shows.


def tier(value: str) -> str:
    return f"""(CASE WHEN {value} >= 10000 THEN '100x+ (10000%+)' WHEN {value} >= 5000 THEN '50-99x (5000-9999%)'
      WHEN {value} >= 2000 THEN '20-49x (2000-4999%)' WHEN {value} >= 1000 THEN '10-19x (1000-1999%)'
      ELSE 'Under 10x' END)"""


def band(value: str) -> str:
    return f"""(CASE WHEN {value} >= 10000 THEN '10000%+ (100x)' WHEN {value} >= 5000 THEN '5000-9999% (50-99x)'
      WHEN {value} >= 2000 THEN '2000-4999% (20-49x)' WHEN {value} >= 1000 THEN '1000-1999% (10-19x)'
      ELSE '<1000%' END)"""


def kind(value: str) -> str:
    return f"""(CASE WHEN {value} >= 10 THEN 'Serial Moonshotter (10+)' WHEN {value} >= 5 THEN 'Frequent Moonshotter (5-9)'
      WHEN {value} >= 3 THEN 'Regular Moonshotter (3-4)' WHEN {value} >= 2 THEN 'Occasional Moonshotter (2)'
      ELSE 'One-Hit Wonder (1)' END)"""


def size(value: str) -> str:
    return f"""(CASE WHEN {value} >= 100 THEN 'Whale (100+ SOL)' WHEN {value} >= 10 THEN 'Big Fish (10-100 SOL)'
      WHEN {value} >= 1 THEN 'Regular (1-10 SOL)' ELSE 'Small Fish (<1 SOL)' END)"""


def entry(value: str) -> str:
    return f"""(CASE WHEN {value} <= 1 THEN 'Lightning Fast (<1h)' WHEN {value} <= 6 THEN 'Very Early (1-6h)'
      WHEN {value} <= 24 THEN 'Early (6-24h)' WHEN {value} <= 168 THEN 'Within Week (1-7d)'
      ELSE 'Late Entry (>7d)' END)"""


def hold(value: str) -> str:
    return f"""(CASE WHEN {value} <= 1 THEN 'Scalp (<1h)' WHEN {value} <= 24 THEN 'Day Trade (1-24h)'
      WHEN {value} <= 168 THEN 'Swing (1-7d)' WHEN {value} <= 720 THEN 'Position (1-4w)'
      ELSE 'Long Hold (>4w)' END)"""


def compose(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + final.strip()


# --- inputs -------------------------------------------------------------------

FILLS_PLAIN = """
fills AS (
  SELECT CAST(l_partkey AS VARCHAR) AS token, CAST(l_suppkey AS VARCHAR) AS wallet,
         l_linestatus = 'O' AS buying, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS paid, l_extendedprice / l_quantity AS price,
         concat(l_orderkey, '-', l_linenumber) AS tx, l_shipdate AS ts,
         l_orderkey * 8 + l_linenumber AS pos
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2002-01-01')"""

FILLS_HOURLY = f"""
fills AS (
  SELECT * FROM (SELECT CAST(l_partkey AS VARCHAR) AS token, CAST(l_suppkey AS VARCHAR) AS wallet,
         l_linestatus = 'O' AS buying, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.001 AS DECIMAL(18,5)) AS paid,
         l_extendedprice / l_quantity / 1000 AS price,
         concat(l_orderkey, '-', l_linenumber) AS tx,
         TIMESTAMP '2024-01-01' + to_hours(CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS INTEGER))
           + to_minutes(CAST(l_orderkey % 60 AS INTEGER)) AS ts,
         l_orderkey * 8 + l_linenumber AS pos
  FROM lineitem) WHERE ts <= {NOW})"""

PARTS = f"""
parts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS token, TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INTEGER)) AS born,
         p_brand AS brand, p_type AS ptype,
         CASE p_type WHEN 'ECONOMY' THEN 'pump.fun' WHEN 'LARGE' THEN 'letsbonk' WHEN 'MEDIUM' THEN 'bags' END AS pad
  FROM part)"""

# every launch row of the narrow form
NARROW = f"""
rows_ AS (
  SELECT token, born AS launch_time, brand AS creator, pad FROM parts
  UNION ALL SELECT token, born + INTERVAL 240 HOUR, brand, pad FROM parts WHERE ptype = 'LARGE'
  UNION ALL SELECT token, born, brand, pad FROM parts WHERE brand = 'Brand#1'),
born_rows AS (
  SELECT * FROM rows_ WHERE pad IS NOT NULL AND launch_time >= {WINDOW_START} AND launch_time <= {NOW})"""

# every launch row of the wide form, by the outer join it is defined with
WIDE = f"""
activity AS (
  SELECT 'a' || token AS tx, born AS moment, token AS mint, brand AS owner, pad FROM parts
  UNION ALL SELECT 'b' || token, born + INTERVAL 36 HOUR, token, brand, pad FROM parts WHERE ptype = 'LARGE'
  UNION ALL SELECT 'c' || token, born, token, 'co-' || brand, pad FROM parts WHERE brand = 'Brand#1'
  UNION ALL SELECT 'd' || token, born, NULL, brand, pad FROM parts WHERE brand = 'Brand#2'),
calls AS (
  SELECT 'a' || token AS tx, born AS moment, 'fallback' AS caller FROM parts WHERE ptype IN ('STANDARD', 'LARGE')
  UNION ALL SELECT 'a' || token, born, 'fallback' FROM parts WHERE ptype = 'STANDARD'
  UNION ALL SELECT 'a' || token, born, 'vote' FROM parts WHERE ptype = 'ECONOMY'),
born_rows AS (
  SELECT DISTINCT mint AS token, activity.moment AS launch_time, owner AS creator,
         coalesce(pad, CASE WHEN caller = 'fallback' THEN 'pump.fun' END) AS pad
  FROM activity LEFT JOIN calls USING (tx, moment)
  WHERE (pad IS NOT NULL OR caller = 'fallback') AND mint IS NOT NULL AND activity.moment >= {WINDOW_START}
    AND activity.moment <= {NOW})"""

ONE_LAUNCH = """
born AS (
  SELECT token, launch_time, creator, pad FROM born_rows
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY launch_time, pad, creator) = 1)"""


def newest(source: str) -> str:
    return f"""
quotes AS (
  SELECT token, price FROM {source}
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY ts DESC, pos DESC) = 1)"""


def held(source: str, keys: str, minimum: str, copies: str = "1") -> str:
    """Position sums of a source, one row per key."""
    return f"""
held AS (
  SELECT {keys},
         coalesce(SUM(paid * {copies}) FILTER (buying), 0) AS invested,
         coalesce(SUM(qty * {copies}) FILTER (buying), 0) AS tokens_bought,
         coalesce(SUM(paid * {copies}) FILTER (NOT buying), 0) AS received,
         coalesce(SUM(qty * {copies}) FILTER (NOT buying), 0) AS tokens_sold,
         SUM((CASE WHEN buying THEN qty ELSE -qty END) * {copies}) AS balance,
         MIN(ts) AS first_trade, MAX(ts) AS last_trade, CAST(SUM({copies}) AS BIGINT) AS trade_count
  FROM {source} GROUP BY {keys} HAVING coalesce(SUM(paid * {copies}) FILTER (buying), 0) {minimum})"""


EVALUATED = f"""
priced AS (
  SELECT held.*, price AS latest_price,
         CAST(received - invested AS DOUBLE) AS realized,
         CAST(balance AS DOUBLE) * coalesce(price, 0) AS unrealized
  FROM held LEFT JOIN quotes USING (token)),
book AS (
  SELECT *, realized + unrealized AS total_pnl,
         (realized + unrealized) / CAST(invested AS DOUBLE) * 100 AS return_pct,
         {hours('launch_time', 'first_trade')} AS entry_hours,
         {hours('first_trade', 'last_trade')} AS hold_hours
  FROM priced)"""

USD_BOOK = (
    FILLS_PLAIN,
    """
seen AS (
  SELECT token, MIN(ts) AS launch_time, MAX(ts) AS last_seen FROM fills GROUP BY token HAVING COUNT(*) >= 10)""",
    newest("fills"),
    """
own AS (SELECT fills.*, launch_time, CAST(NULL AS VARCHAR) AS pad FROM fills JOIN seen USING (token) WHERE qty <> 0 AND paid > 0)""",
    held("own", "pad, token, launch_time, wallet", ">= 50"),
    EVALUATED,
)

SIDED_BOOK = (
    FILLS_HOURLY,
    PARTS,
    NARROW,
    ONE_LAUNCH,
    newest("fills"),
    """
own AS (
  SELECT fills.*, launch_time, pad FROM fills JOIN born USING (token)
  WHERE ts >= launch_time AND qty > 0 AND paid > 0)""",
    held("own", "pad, token, launch_time, wallet", ">= 0.05"),
    EVALUATED,
)

SIDED_EVENT = (
    FILLS_HOURLY,
    PARTS,
    NARROW,
    newest("fills"),
    """
own AS (
  SELECT fills.*, launch_time, pad FROM fills JOIN born_rows USING (token)
  WHERE ts >= launch_time AND qty > 0 AND paid > 0)""",
    held("own", "pad, token, launch_time, wallet", ">= 0.05"),
    EVALUATED,
)

MAIN_BOOK = (
    FILLS_HOURLY,
    PARTS,
    WIDE,
    ONE_LAUNCH,
    f"""
own AS (
  SELECT fills.*, launch_time, pad FROM fills JOIN born USING (token)
  WHERE ts >= launch_time AND ts <= {NOW} AND qty <> 0)""",
    newest("own"),
    held("own", "pad, token, launch_time, wallet", "> 0"),
    EVALUATED,
    "good AS (SELECT * FROM book WHERE invested >= 0.1)",
)

MAIN_EVENT = (
    FILLS_HOURLY,
    PARTS,
    WIDE,
    f"""
copied AS (
  SELECT fills.* FROM fills JOIN born_rows USING (token)
  WHERE ts >= launch_time AND ts <= {NOW} AND qty <> 0)""",
    newest("copied"),
    "own AS (SELECT copied.*, launch_time, pad FROM copied JOIN born_rows USING (token))",
    held("own", "pad, token, launch_time, wallet", "> 0"),
    EVALUATED,
)

POSITION_COLUMNS = f"""
  pad AS launchpad_name, token, launch_time, wallet, {rd('invested', 6)} AS invested,
  {rd('tokens_bought', 6)} AS tokens_bought, {rd('received', 6)} AS received, {rd('tokens_sold', 6)} AS tokens_sold,
  {rd('balance', 6)} AS balance, first_trade, last_trade, trade_count, {rd('latest_price')} AS latest_price"""

RETURN_COLUMNS = f"""{POSITION_COLUMNS},
  {rd('realized')} AS realized, {rd('unrealized')} AS unrealized, {rd('total_pnl')} AS total_pnl,
  {rd('return_pct')} AS return_pct, entry_hours, hold_hours"""

LAUNCH_COLUMNS = "token, launch_time, creator, pad AS launchpad_name"
WEEK = "date_trunc('week', launch_time)"

ORACLE: dict[str, str] = {}

# --- launches, tokens, trades, prices ------------------------------------------

ORACLE["launches_narrow"] = compose(PARTS, NARROW, ONE_LAUNCH, final=f"SELECT {LAUNCH_COLUMNS} FROM born")
ORACLE["launches_narrow_event"] = compose(PARTS, NARROW, final=f"SELECT {LAUNCH_COLUMNS} FROM born_rows")
ORACLE["launches_wide"] = compose(PARTS, WIDE, ONE_LAUNCH, final=f"SELECT {LAUNCH_COLUMNS} FROM born")
ORACLE["launches_wide_event"] = compose(PARTS, WIDE, final=f"SELECT {LAUNCH_COLUMNS} FROM born_rows")

ORACLE["recent_tokens"] = compose(
    FILLS_PLAIN,
    final="""
SELECT token AS token_mint_address, MIN(ts) AS first_seen, MAX(ts) AS last_seen
FROM fills GROUP BY token HAVING COUNT(*) >= 10""",
)

ORACLE["trades_normalized"] = compose(
    *MAIN_BOOK[:5],
    final=f"""
SELECT token AS token_mint_address, wallet AS trader_wallet, ts AS block_time,
       CASE WHEN buying THEN 'buy' ELSE 'sell' END AS instruction_name,
       {rd('qty', 6)} AS token_amount, {rd('paid', 6)} AS sol_amount, {rd('price')} AS price_per_token, tx AS tx_id,
       row_number() OVER (PARTITION BY wallet, token
         ORDER BY ts, tx, CASE WHEN buying THEN 'buy' ELSE 'sell' END, qty, paid, price) AS trade_sequence
FROM own""",
)

_MISFIT = "COUNT(*) FILTER ({0} IS NOT NULL AND TRY_CAST({0} AS DECIMAL(38,18)) IS NULL)"
ORACLE["trade_rejects"] = f"""
SELECT {_MISFIT.format('l_quantity')} AS token_amount, {_MISFIT.format('l_extendedprice')} AS usd_amount,
       COUNT(*) FILTER (NOT isfinite(l_extendedprice / l_quantity)) AS token_price,
       COUNT(*) FILTER (l_shipdate IS NOT NULL AND TRY_CAST(l_shipdate AS TIMESTAMP) IS NULL) AS block_time,
       CAST(0 AS BIGINT) AS blockchain, CAST(0 AS BIGINT) AS token_address, CAST(0 AS BIGINT) AS trader,
       CAST(0 AS BIGINT) AS tx_id, CAST(0 AS BIGINT) AS trade_index
FROM lineitem"""

PRICE = f"SELECT token, {rd('price')} AS latest_price FROM quotes"
ORACLE["latest_price_sided"] = compose(FILLS_HOURLY, newest("fills"), final=PRICE)
ORACLE["latest_price_usd"] = compose(FILLS_PLAIN, newest("fills"), final=PRICE)
ORACLE["latest_price_normalized"] = compose(*MAIN_BOOK[:6], final=PRICE)

TRADERS = """
crowd AS (SELECT token, COUNT(DISTINCT wallet) AS all_traders FROM fills GROUP BY token)"""
ORACLE["token_traders"] = compose(
    *SIDED_BOOK[:4], TRADERS, final="SELECT token, all_traders FROM crowd WHERE token IN (SELECT token FROM born)"
)

# --- positions, returns, moonshots ----------------------------------------------

for name, chain in {
    "usd": USD_BOOK,
    "sided": SIDED_BOOK,
    "sided_event": SIDED_EVENT,
    "normalized": MAIN_BOOK,
    "normalized_event": MAIN_EVENT,
}.items():
    ORACLE[f"positions_{name}"] = compose(*chain, final=f"SELECT {POSITION_COLUMNS} FROM book")

ORACLE["position_returns_usd"] = compose(*USD_BOOK, final=f"SELECT {RETURN_COLUMNS} FROM book")
ORACLE["position_returns_sided"] = compose(*SIDED_BOOK, final=f"SELECT {RETURN_COLUMNS} FROM book")
ORACLE["position_returns_normalized"] = compose(*MAIN_BOOK, final=f"SELECT {RETURN_COLUMNS} FROM good")

ORACLE["moonshots_sided"] = compose(
    *SIDED_BOOK,
    final=f"""
SELECT pad AS launchpad_name, wallet AS trader_wallet, token AS token_mint_address,
       {rd('invested', 4)} AS sol_invested, {rd('received', 4)} AS sol_received,
       {rd('balance', 2)} AS tokens_remaining, {rd('total_pnl', 4)} AS profit_sol,
       {rd('return_pct', 2)} AS return_percentage, trade_count,
       CAST(hold_hours AS DOUBLE) AS hold_hours, CAST(entry_hours AS DOUBLE) AS hours_after_launch,
       launch_time, first_trade, last_trade, {tier('return_pct')} AS moonshot_category,
       {rd('return_pct / 100', 1)} AS profit_multiple,
       {entry('entry_hours')} AS entry_timing, {hold('hold_hours')} AS hold_strategy
FROM book WHERE return_pct >= 1000
ORDER BY return_pct DESC, profit_sol DESC, token, wallet, launch_time, pad LIMIT 500""",
)

LINKS = f"concat('https://solscan.io/account/', wallet) AS wallet_link, concat('https://solscan.io/token/', token) AS token_link"

ORACLE["moonshots_main"] = compose(
    *MAIN_BOOK,
    final=f"""
SELECT pad AS launchpad_name, wallet AS trader_wallet, token AS token_mint_address,
       {rd('invested')} AS total_sol_invested, {rd('received')} AS total_sol_received,
       {rd('balance')} AS current_token_balance, {rd('total_pnl')} AS total_pnl_sol,
       {rd('return_pct', 2)} AS return_pct, trade_count AS total_trades,
       CAST(hold_hours AS DOUBLE) AS duration_hours, first_trade AS first_trade_time,
       last_trade AS last_trade_time, launch_time, {band('good.return_pct')} AS moonshot_tier,
       entry_hours AS hours_after_launch, {LINKS}
FROM good WHERE good.return_pct >= 1000
ORDER BY good.return_pct DESC, total_pnl DESC, token, wallet, launch_time, pad LIMIT 1000""",
)

ORACLE["moonshots_usd"] = compose(
    *USD_BOOK,
    final=f"""
SELECT wallet AS trader_wallet, token AS token_mint_address, {rd('invested', 2)} AS invested_usd,
       {rd('received', 2)} AS received_usd, {rd('total_pnl', 2)} AS profit_usd,
       {rd('book.return_pct', 2)} AS return_pct, {rd('balance', 0)} AS tokens_remaining,
       {rd('unrealized', 2)} AS unrealized_value_usd, trade_count AS total_trades,
       CAST(entry_hours AS DOUBLE) AS hours_after_launch, CAST(book.hold_hours AS DOUBLE) AS hold_hours,
       launch_time, first_trade AS first_trade_time, last_trade AS last_trade_time,
       {tier('book.return_pct')} AS moonshot_tier, {rd('book.return_pct / 100', 1)} AS profit_multiple,
       {entry('entry_hours')} AS entry_timing, {hold('book.hold_hours')} AS hold_strategy, {LINKS}
FROM book WHERE book.return_pct >= 1000
ORDER BY book.return_pct DESC, profit_usd DESC, token, wallet LIMIT 1000""",
)

# --- roll-ups ---------------------------------------------------------------------

ORACLE["wallet_moonshots"] = compose(
    *SIDED_BOOK,
    f"""
per_wallet AS (
  SELECT wallet, pad, COUNT(*) AS n, {reach(10000)} AS n100, {reach(5000)} AS n50,
         CAST(SUM(invested) AS DOUBLE) AS put_in, {exact('total_pnl')} AS profit, {mean('return_pct')} AS avg_return,
         MAX(return_pct) AS best, AVG(entry_hours) AS avg_entry, AVG(hold_hours) AS avg_hold,
         MAX(last_trade) AS latest, MIN(first_trade) AS earliest
  FROM book WHERE return_pct >= 1000 GROUP BY wallet, pad)""",
    final=f"""
SELECT wallet AS trader_wallet, pad AS launchpad_name, n AS moonshot_count, n100 AS ultra_moonshots_100x,
       n50 AS super_moonshots_50x, {rd('put_in')} AS total_moonshot_investment, {rd('profit')} AS total_moonshot_profit,
       {rd('avg_return')} AS avg_moonshot_return, {rd('best')} AS best_moonshot_return,
       {rd('avg_entry')} AS avg_entry_timing, {rd('avg_hold')} AS avg_hold_time,
       latest AS latest_moonshot_trade, earliest AS first_moonshot_trade, {kind('n')} AS wallet_type,
       {rd('profit / put_in', 2)} AS overall_roi_multiple,
       rank() OVER (ORDER BY profit DESC) AS profit_rank, rank() OVER (ORDER BY n DESC) AS frequency_rank,
       rank() OVER (ORDER BY best DESC) AS peak_performance_rank
FROM per_wallet""",
)

ORACLE["token_moonshots"] = compose(
    *SIDED_BOOK,
    TRADERS,
    f"""
per_token AS (
  SELECT pad, token, launch_time, COUNT(*) AS n, {reach(10000)} AS n100, {reach(5000)} AS n50,
         CAST(SUM(invested) AS DOUBLE) AS put_in, {exact('total_pnl')} AS profit, {mean('return_pct')} AS avg_return,
         MAX(return_pct) AS best, AVG(entry_hours) AS avg_entry, MIN(entry_hours) AS fastest,
         quantile_cont(entry_hours, 0.5) AS mid_entry
  FROM book WHERE return_pct >= 1000 GROUP BY pad, token, launch_time HAVING COUNT(*) >= 3)""",
    final=f"""
SELECT pad AS launchpad_name, token AS token_mint_address, launch_time, n AS total_moonshot_traders,
       n100 AS traders_100x_plus, n50 AS traders_50x_plus, {rd('put_in')} AS total_investment_volume,
       {rd('profit')} AS total_profits_created, {rd('avg_return')} AS avg_trader_return,
       {rd('best')} AS highest_individual_return, {rd('avg_entry')} AS avg_entry_delay, fastest AS fastest_entry,
       {rd('mid_entry')} AS median_entry_delay, {rd('n * 100.0 / CAST(all_traders AS DOUBLE)')} AS moonshot_trader_percentage
FROM per_token JOIN crowd USING (token)""",
)

ORACLE["repeat_winners"] = compose(
    *USD_BOOK,
    f"""
per_wallet AS (
  SELECT wallet, COUNT(*) AS n, CAST(SUM(invested) AS DOUBLE) AS put_in, {exact('total_pnl')} AS profit,
         {mean('return_pct')} AS avg_return, MAX(return_pct) AS best,
         MIN(first_trade) AS earliest, MAX(last_trade) AS latest
  FROM book WHERE return_pct >= 1000 GROUP BY wallet HAVING COUNT(*) >= 2)""",
    final=f"""
SELECT wallet AS trader_wallet, n AS moonshot_count, {rd('put_in', 2)} AS total_invested_usd,
       {rd('profit', 2)} AS total_profit_usd, {rd('avg_return', 2)} AS avg_return_pct, {rd('best', 2)} AS best_return_pct,
       {kind('n')} AS trader_type, earliest AS first_moonshot, latest AS latest_moonshot
FROM per_wallet""",
)


def _summary(condition: str) -> str:
    return f"""
per_wallet AS (
  SELECT wallet, pad, COUNT(DISTINCT token) AS tokens, COUNT(*) AS n, CAST(SUM(invested) AS DOUBLE) AS put_in,
         {exact('total_pnl')} AS profit, {mean('return_pct')} AS avg_return, MAX(return_pct) AS best,
         MIN(return_pct) AS worst, COUNT(*) FILTER (return_pct > 0) * 100.0::DOUBLE / COUNT(*) AS wins,
         {reach(1000)} AS shots, AVG(hold_hours) AS avg_hold, AVG(entry_hours) AS avg_entry
  FROM good WHERE {condition} GROUP BY wallet, pad HAVING {reach(1000)} >= 1)"""


_SUMMARY_FINAL = f"""
SELECT wallet AS trader_wallet, pad AS launchpad_name, tokens AS tokens_traded, n AS total_trades,
       {rd('put_in')} AS total_invested, {rd('profit')} AS total_profit_sol, {rd('avg_return')} AS avg_return_pct,
       {rd('best')} AS best_return_pct, {rd('worst')} AS worst_return_pct, {rd('wins')} AS win_rate_pct,
       shots AS moonshot_count, {rd('avg_hold')} AS avg_hold_time_hours, {rd('avg_entry')} AS avg_entry_timing_hours,
       rank() OVER (ORDER BY profit DESC) AS profit_rank, rank() OVER (ORDER BY shots DESC) AS moonshot_rank,
       rank() OVER (ORDER BY wins DESC) AS consistency_rank
FROM per_wallet"""

ORACLE["wallet_summary"] = compose(*MAIN_BOOK, _summary("return_pct >= 100"), final=_SUMMARY_FINAL)
ORACLE["wallet_win_rate"] = compose(*MAIN_BOOK, _summary("TRUE"), final=_SUMMARY_FINAL)

ORACLE["launchpad_comparison"] = compose(
    *MAIN_BOOK,
    f"""
per_pad AS (
  SELECT pad, COUNT(DISTINCT token) AS tokens, COUNT(DISTINCT wallet) AS wallets, COUNT(*) AS n,
         {reach(1000)} AS shots, {reach(1000)} * 100.0::DOUBLE / COUNT(*) AS rate, CAST(SUM(invested) AS DOUBLE) AS put_in,
         {exact('total_pnl')} AS profit, {mean('return_pct')} AS avg_return,
         quantile_cont(return_pct, 0.5) AS mid_return, MAX(return_pct) AS best, MAX(total_pnl) AS biggest
  FROM good GROUP BY pad)""",
    final=f"""
SELECT pad AS launchpad_name, tokens AS total_tokens_launched, wallets AS unique_traders, n AS total_trades,
       shots AS moonshot_trades, {rd('rate')} AS moonshot_rate_pct, {rd('put_in')} AS total_volume_invested,
       {rd('profit')} AS total_profits_generated, {rd('avg_return')} AS avg_return_pct,
       {rd('mid_return')} AS median_return_pct, {rd('best')} AS highest_return_pct, {rd('biggest')} AS biggest_profit_sol,
       rank() OVER (ORDER BY rate DESC) AS moonshot_rate_rank, rank() OVER (ORDER BY avg_return DESC) AS avg_return_rank,
       rank() OVER (ORDER BY profit DESC) AS total_profit_rank
FROM per_pad""",
)

_SUCCESS = """WHEN n10000 >= 5 THEN 'Ultra Success' WHEN n5000 >= 10 THEN 'High Success'
       WHEN n1000 >= 20 THEN 'Good Success' WHEN n1000 >= 5 THEN 'Moderate Success'"""
_PER_TOKEN = f"""
per_token AS (
  SELECT pad, token, launch_time, COUNT(DISTINCT wallet) AS wallets, COUNT(*) AS n,
         CAST(SUM(invested) AS DOUBLE) AS put_in, {exact('total_pnl')} AS profit, {mean('return_pct')} AS avg_return,
         MAX(return_pct) AS best, {reach(1000)} AS n1000, {reach(5000)} AS n5000, {reach(10000)} AS n10000,
         MIN(entry_hours) AS fastest, AVG(entry_hours) AS avg_entry, AVG(hold_hours) AS avg_hold
  FROM good WHERE return_pct >= 100 GROUP BY pad, token, launch_time HAVING COUNT(DISTINCT wallet) >= 5)"""

ORACLE["token_success"] = compose(
    *MAIN_BOOK,
    _PER_TOKEN,
    final=f"""
SELECT pad AS launchpad_name, token AS token_mint_address, launch_time, wallets AS unique_traders, n AS total_trades,
       {rd('put_in')} AS total_investment_volume, {rd('profit')} AS total_profits, {rd('avg_return')} AS avg_trader_return,
       {rd('best')} AS best_trader_return, n1000 AS traders_with_1000plus, n5000 AS traders_with_5000plus,
       n10000 AS traders_with_10000plus, fastest AS fastest_entry_hours, {rd('avg_entry')} AS avg_entry_timing_hours,
       {rd('avg_hold')} AS avg_hold_duration_hours,
       {', '.join(f"{rd(f'n{p} * 100.0::DOUBLE / wallets')} AS pct_traders_{p}plus" for p in (1000, 5000, 10000))},
       CASE {_SUCCESS} ELSE 'Low Success' END AS token_success_tier
FROM per_token""",
)

ORACLE["weekly_trends"] = compose(
    *MAIN_BOOK,
    final=f"""
SELECT pad AS launchpad_name, CAST({WEEK} AS TIMESTAMP) AS launch_week, COUNT(DISTINCT token) AS tokens_launched,
       COUNT(DISTINCT wallet) AS unique_successful_traders, {reach(1000)} AS moonshot_trades,
       {rd(exact('total_pnl'))} AS weekly_profits, {rd(mean('return_pct'))} AS avg_weekly_return,
       {rd('AVG(entry_hours)')} AS avg_entry_delay_hours,
       {rd('quantile_cont(entry_hours, 0.5)')} AS median_entry_delay_hours,
       {rd('AVG(hold_hours)')} AS avg_hold_time_hours, {rd('quantile_cont(hold_hours, 0.5)')} AS median_hold_time_hours
FROM good WHERE return_pct >= 1000 AND launch_time >= {TREND_START} GROUP BY pad, {WEEK}""",
)

ORACLE["trader_categories"] = compose(
    *MAIN_BOOK,
    final=f"""
SELECT pad AS launchpad_name, {size('invested')} AS trader_category, COUNT(*) AS trade_count,
       COUNT(DISTINCT wallet) AS unique_traders, {rd('CAST(SUM(invested) AS DOUBLE) / COUNT(*)')} AS avg_investment,
       {rd(mean('total_pnl'))} AS avg_profit, {rd(mean('return_pct'))} AS avg_return_pct,
       {reach(5000)} AS ultra_success_count, {rd(f'{reach(5000)} * 100.0::DOUBLE / COUNT(*)')} AS ultra_success_rate,
       {rd('AVG(entry_hours)')} AS avg_entry_timing, {rd('AVG(hold_hours)')} AS avg_hold_time,
       {rd('AVG(trade_count)')} AS avg_trades_per_token
FROM good WHERE return_pct >= 1000 GROUP BY ALL""",
)

# --- dashboard ----------------------------------------------------------------------

ORACLE["category_by_tier"] = compose(
    *MAIN_BOOK,
    final=f"""
SELECT {size('invested')} AS trader_category, {band('return_pct')} AS moonshot_tier, COUNT(*) AS trade_count
FROM good WHERE return_pct >= 1000 GROUP BY ALL""",
)

for name, alias, expression in (
    ("entry_window_stats", "entry_timing", entry("entry_hours")),
    ("hold_window_stats", "hold_strategy", hold("hold_hours")),
):
    ORACLE[name] = compose(
        *MAIN_BOOK,
        final=f"""
SELECT pad AS launchpad_name, {expression} AS {alias}, COUNT(*) AS positions, COUNT(DISTINCT wallet) AS unique_traders,
       {reach(1000)} AS moonshot_trades, {rd(f'{reach(1000)} * 100.0::DOUBLE / COUNT(*)')} AS moonshot_rate_pct,
       {rd(mean('return_pct'))} AS avg_return_pct, {rd(exact('total_pnl'))} AS total_profit
FROM good GROUP BY ALL""",
    )

ORACLE["launch_frequency"] = compose(
    PARTS,
    WIDE,
    ONE_LAUNCH,
    final=f"""
SELECT pad AS launchpad_name, CAST({WEEK} AS TIMESTAMP) AS launch_week, COUNT(DISTINCT token) AS tokens_launched
FROM born GROUP BY ALL""",
)

ORACLE["launchpad_volume"] = compose(
    *SIDED_BOOK[:6],
    final=f"""
SELECT pad AS launchpad_name, COUNT(DISTINCT token) AS tokens_traded, COUNT(*) AS trade_count,
       {rd('coalesce(SUM(paid) FILTER (buying), 0)')} AS buy_volume,
       {rd('coalesce(SUM(paid) FILTER (NOT buying), 0)')} AS sell_volume, {rd('SUM(paid)')} AS total_volume
FROM own GROUP BY pad""",
)

ORACLE["launch_to_first_trade"] = compose(
    *SIDED_BOOK[:6],
    final=f"""
SELECT born.pad AS launchpad_name, born.token AS token_mint_address, born.launch_time, MIN(own.ts) AS first_trade,
       {hours('born.launch_time', 'MIN(own.ts)')} AS hours_to_first_trade
FROM born LEFT JOIN own ON born.token = own.token GROUP BY born.pad, born.token, born.launch_time""",
)

ORACLE["top_wallets"] = compose(
    *MAIN_BOOK,
    _summary("return_pct >= 100"),
    final=f"""
SELECT wallet AS trader_wallet, pad AS launchpad_name, shots AS moonshot_count, {rd('put_in')} AS total_invested,
       {rd('profit')} AS total_profit_sol
FROM per_wallet ORDER BY profit DESC, wallet, pad LIMIT 10""",
)

ORACLE["filter_positions"] = compose(
    *MAIN_BOOK,
    final=f"""
SELECT {RETURN_COLUMNS} FROM good
WHERE pad IN ('pump.fun', 'bags') AND good.return_pct >= 500 AND first_trade BETWEEN TIMESTAMP '2024-01-20'
  AND TIMESTAMP '2024-04-01' AND good.invested >= 10 AND good.invested < 100""",
)

ORACLE["drill_wallet"] = compose(
    *MAIN_BOOK,
    _summary("return_pct >= 100"),
    final=f"""
SELECT {RETURN_COLUMNS} FROM good
WHERE wallet = (SELECT wallet FROM per_wallet ORDER BY profit DESC, wallet, pad LIMIT 1)""",
)

ORACLE["drill_token"] = compose(
    *MAIN_BOOK,
    _PER_TOKEN,
    final=f"""
SELECT token, wallet, CASE WHEN buying THEN 'buy' ELSE 'sell' END AS side, {rd('qty', 6)} AS quantity,
       {rd('paid', 6)} AS amount, {rd('price')} AS price, tx AS tx_id, ts AS block_time
FROM fills WHERE token = (SELECT token FROM per_token ORDER BY n1000 DESC, profit DESC, token, launch_time LIMIT 1)""",
)

ORACLE["drill_launchpad"] = compose(
    *MAIN_BOOK,
    f"rates AS (SELECT pad, {reach(1000)} * 1.0::DOUBLE / COUNT(*) AS rate FROM good GROUP BY pad)",
    final=f"""
SELECT {RETURN_COLUMNS} FROM good WHERE pad IN (SELECT pad FROM rates WHERE rate = (SELECT MAX(rate) FROM rates))""",
)

ORACLE["export_csv"] = compose(
    *MAIN_BOOK,
    _summary("return_pct >= 100"),
    final=f"""
SELECT wallet AS trader_wallet, pad AS launchpad_name, {rd('profit')} AS total_profit_sol, shots AS moonshot_count,
       rank() OVER (ORDER BY profit DESC) AS profit_rank
FROM per_wallet""",
)

# --- incremental ------------------------------------------------------------------------

FILLS_EVENTS = """
fills AS (
  SELECT CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS token,
         CAST(user_id AS VARCHAR) AS wallet, event_type = 'purchase' AS buying,
         CAST(event_id % 7 + 1 AS DECIMAL(18,2)) AS qty, CAST(value AS DECIMAL(18,2)) AS paid,
         value / (event_id % 7 + 1) AS price, ts, event_id AS pos,
         CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts) / 10.0) AS INTEGER) AS delivery
  FROM events WHERE event_type IN ('purchase', 'click'))"""

EVENT_BOOK = (
    FILLS_EVENTS,
    "seen AS (SELECT token, MIN(ts) AS launch_time FROM fills GROUP BY token HAVING COUNT(*) >= 10)",
    newest("fills"),
    """
own AS (SELECT fills.*, launch_time, CAST(NULL AS VARCHAR) AS pad FROM fills JOIN seen USING (token) WHERE paid > 0)""",
    held("own", "pad, token, launch_time, wallet", ">= 10"),
    EVALUATED,
)
ORACLE["stream_positions"] = compose(*EVENT_BOOK, final=f"SELECT {RETURN_COLUMNS} FROM book")

# the book as it stood after each delivery
DELIVERED = (
    FILLS_EVENTS,
    """
known AS (
  SELECT fills.* EXCLUDE (delivery), d.delivery FROM fills
  JOIN (SELECT DISTINCT delivery FROM fills) d ON fills.delivery <= d.delivery)""",
    "seen AS (SELECT delivery, token FROM known GROUP BY delivery, token HAVING COUNT(*) >= 10)",
    """
quotes AS (
  SELECT delivery, token, price FROM known
  QUALIFY row_number() OVER (PARTITION BY delivery, token ORDER BY ts DESC, pos DESC) = 1)""",
    "own AS (SELECT known.* FROM known JOIN seen USING (delivery, token) WHERE paid > 0)",
    held("own", "delivery, token, wallet", ">= 10"),
    """
book AS (
  SELECT held.*, CAST(received - invested AS DOUBLE) + CAST(balance AS DOUBLE) * coalesce(price, 0) AS total_pnl,
         (CAST(received - invested AS DOUBLE) + CAST(balance AS DOUBLE) * coalesce(price, 0))
           / CAST(invested AS DOUBLE) * 100 AS return_pct
  FROM held JOIN quotes USING (delivery, token))""",
    "shots AS (SELECT * FROM book WHERE return_pct >= 200)",
)
ORACLE["stream_alerts"] = compose(
    *DELIVERED,
    "crowds AS (SELECT delivery, token, COUNT(*) AS n FROM shots GROUP BY delivery, token HAVING COUNT(*) >= 3)",
    final=f"""
SELECT 'moonshot' AS kind, token, wallet, {rd('return_pct')} AS return_pct, CAST(1 AS BIGINT) AS traders,
       delivery AS batch
FROM shots WHERE NOT EXISTS (
  SELECT 1 FROM shots old WHERE old.token = shots.token AND old.wallet = shots.wallet
    AND old.delivery = shots.delivery - 1)
UNION ALL
SELECT 'token', token, NULL, NULL, n, delivery FROM crowds
WHERE NOT EXISTS (SELECT 1 FROM crowds old WHERE old.token = crowds.token AND old.delivery = crowds.delivery - 1)""",
)

HOURS = """
hours AS (SELECT token, date_trunc('hour', ts) AS hour, COUNT(*) AS n FROM fills GROUP BY ALL),
spikes AS (
  SELECT token, hour, n, coalesce(SUM(n) OVER (PARTITION BY token ORDER BY hour
           RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING), 0) / 24.0::DOUBLE AS usual
  FROM hours)"""
SPIKES = f"SELECT token, hour, n AS trades, {rd('usual')} AS usual_trades FROM spikes WHERE n >= 3 AND usual > 0 AND n > 3 * usual"
ORACLE["activity_spikes"] = compose(FILLS_EVENTS, HOURS, final=SPIKES)
ORACLE["stream_spikes"] = compose(FILLS_EVENTS, HOURS, final=SPIKES)
