"""The logical tables as SQL over the star schema. Each entry: name -> (needed tables, query)."""

from plumbline.config import GUARANTEE_FLAGS

_RAW_PRICE = (
    "CAST(CAST(p_retailprice AS DECIMAL(12,2)) + CAST(day(l_shipdate) AS DECIMAL(12,4)) * 0.01"
    " + CAST(l_partkey % 97 AS DECIMAL(12,4)) * 0.0013 AS DECIMAL(12,4))"
)


def _rate(day: str) -> str:
    return f"CAST(1.25 + CAST(day({day}) AS DECIMAL(6,4)) * 0.001 AS DECIMAL(8,4))"


_COMPANY = "CASE WHEN l_partkey % 37 = 0 THEN 'OTH' WHEN l_linestatus = 'O' THEN 'MAX' ELSE 'CGF' END"


def _february(day: str, number: int) -> str:
    return f"(month({day}) = 2 AND day({day}) = {number})"


_FLAGS = ",\n".join(f"CASE WHEN h NOT BETWEEN 81 AND 86 THEN h = {45 + i} END AS {name}" for i, name in enumerate(GUARANTEE_FLAGS))

_TARGET_COLUMNS = f"""
    account || CASE WHEN h = 80 THEN '-X' ELSE '' END AS policy_number, company AS manufacturing_company_code, extract_date, fund_code,
    CASE WHEN h BETWEEN 75 AND 79 THEN CAST(0 AS DECIMAL(12,4)) ELSE t_units END AS number_of_units,
    t_price AS unit_value, dealer_code,
    CASE WHEN h BETWEEN 30 AND 34 THEN NULL WHEN h BETWEEN 70 AND 74 THEN plan_sk + 1 ELSE plan_sk END
        AS plan_identifier_sk,
    CASE WHEN h BETWEEN 35 AND 37 THEN 0 WHEN h BETWEEN 38 AND 39 THEN NULL ELSE fund_sk END AS fund_sk,
    CASE WHEN h BETWEEN 40 AND 42 THEN 0 WHEN h BETWEEN 43 AND 44 THEN NULL ELSE date_sk END AS extract_date_sk,
    CASE WHEN h BETWEEN 60 AND 64 THEN NOT monthly ELSE monthly END AS monthly_extract_indicator,
    CASE WHEN h BETWEEN 65 AND 69 THEN NOT weekly ELSE weekly END AS weekly_extract_indicator,
    {_FLAGS}
"""

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "base": (
        (),
        f"""
        SELECT *, last_day(extract_date) = extract_date AS monthly, dayofweek(extract_date) = 5 AS weekly,
               CASE WHEN month(extract_date) IN (3, 6, 9) THEN fault ELSE 999 END AS h,
               CASE WHEN foreign_fund THEN CAST(raw_price * rate AS DECIMAL(12,4)) ELSE raw_price END AS price
        FROM (
            SELECT CAST(o_custkey AS VARCHAR) AS account, {_COMPANY} AS company,
                   CAST(l_partkey AS VARCHAR) AS fund_code, l_partkey,
                   CAST(l_shipdate + INTERVAL 24 YEAR AS DATE) AS extract_date,
                   CAST(l_suppkey AS VARCHAR) AS dealer_code,
                   CAST(CAST(l_quantity AS DECIMAL(12,4)) * CASE WHEN {_february("l_shipdate", 29)} THEN -1
                                                 WHEN {_february("l_shipdate", 28)} THEN 0 ELSE 1 END
                        AS DECIMAL(12,4)) AS units,
                   {_RAW_PRICE} AS raw_price, {_rate("l_shipdate")} AS rate,
                   l_partkey % 5 = 0 AS foreign_fund,
                   l_partkey % 7 + 1 AS plan_sk, l_partkey + 1 AS fund_sk,
                   CAST(year(l_shipdate) * 1000 + month(l_shipdate) AS BIGINT) AS date_sk,
                   (l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 1000 AS fault
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        )
        """,
    ),
    "r": (
        ("base",),
        """
        SELECT account AS contract_policy_number, fund_code, company AS fund_management_company_code, extract_date,
               units AS number_of_units, price AS canadian_unit_price,
               CAST(price * units + CASE WHEN h = 997 THEN 1 ELSE 0 END AS DECIMAL(18,8)) AS market_value,
               dealer_code, CASE WHEN h = 996 THEN NULL ELSE plan_sk END AS plan_identifier_sk,
               CASE WHEN h = 998 THEN NULL ELSE monthly END AS monthly_extract_indicator,
               CASE WHEN h = 995 THEN NULL ELSE weekly END AS weekly_extract_indicator
        FROM base
        """,
    ),
    "faulty": (
        ("base",),
        f"""
        SELECT *, CAST(round(t_price * t_units, 2) AS DECIMAL(18,2)) AS t_value
        FROM (
            SELECT *,
                   CAST(price + CASE WHEN h BETWEEN 5 AND 14 THEN 0.05 WHEN month(extract_date) = 12 OR {_february("extract_date", 29)}
                                     THEN 0.50 ELSE 0.00 END AS DECIMAL(12,4)) AS t_price,
                   CAST(units + CASE WHEN h BETWEEN 15 AND 24 THEN 1 ELSE 0 END AS DECIMAL(12,4)) AS t_units
            FROM base
        )
        """,
    ),
    "t_all": (
        ("faulty",),
        f"""
        SELECT 'SYS_A' AS source_system, {_TARGET_COLUMNS},
               CAST(CASE WHEN h BETWEEN 25 AND 29 THEN -t_value ELSE t_value END AS DECIMAL(18,2)) AS market_value
        FROM faulty WHERE h >= 5
        UNION ALL
        SELECT 'SYS_B', {_TARGET_COLUMNS}, CAST(0 AS DECIMAL(18,2))
        FROM faulty WHERE l_partkey % 50 = 0
        """,
    ),
    "t": (("t_all",), "SELECT * FROM t_all WHERE source_system = 'SYS_A'"),
    "fund_price": (
        (),
        f"""
        SELECT CAST(l_partkey AS VARCHAR) AS fund_code, {_COMPANY} AS management_company_code,
               CAST(l_shipdate + INTERVAL 24 YEAR AS DATE) AS fund_price_date, {_RAW_PRICE} AS fund_price,
               CASE WHEN l_partkey % 5 = 0 THEN 'U' ELSE 'C' END AS fund_price_currency
        FROM (SELECT DISTINCT l_partkey, l_linestatus, l_shipdate FROM lineitem
              WHERE (l_partkey + day(l_shipdate)) % 53 <> 0)
        JOIN part ON l_partkey = p_partkey
        """,
    ),
    "fx": (
        (),
        f"""
        SELECT CAST(d + INTERVAL 24 YEAR AS DATE) AS currency_exchange_date, {_rate("d")} AS currency_exchange_rate
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
        """,
    ),
    "daily": (
        ("base",),
        """
        SELECT account AS account_id, company AS management_company_code, fund_code, units AS shares_owned_amount,
               extract_date AS effective_date,
               CAST(CASE WHEN month(extract_date) IN (3, 6, 9) THEN extract_date + INTERVAL 30 DAY
                         ELSE extract_date END AS DATE) AS end_date
        FROM base WHERE NOT monthly
        """,
    ),
    "month_file": (
        ("base",),
        """
        SELECT account AS account_id, company AS management_company_code, fund_code,
               CASE WHEN l_partkey % 29 = 0 THEN '?' ELSE '' END || strftime(extract_date, '%y%m%d') AS file_date, units AS shares_owned_amount
        FROM base WHERE monthly
        """,
    ),
    "account": (
        (),
        """
        SELECT CAST(c_custkey AS VARCHAR) AS account_id, code AS management_company_code,
               CAST(c_nationkey + step AS VARCHAR) AS dealer_code,
               CASE WHEN step = 0 THEN DATE '2000-01-01' ELSE DATE '2022-06-30' END AS effective_date,
               CASE WHEN step = 0 THEN DATE '2022-06-30' ELSE DATE '2099-12-31' END AS end_date
        FROM customer, (VALUES ('MAX'), ('CGF')) c(code), (VALUES (0), (1)) s(step)
        WHERE c_custkey % 20 <> 0
        """,
    ),
    "priced": (
        ("fund_price", "fx"),
        """
        SELECT fund_price.*, currency_exchange_rate,
               CASE WHEN fund_price_currency = 'U' THEN coalesce(fund_price * currency_exchange_rate, 0)
                    ELSE coalesce(fund_price, 0) END AS cad_price
        FROM fund_price LEFT JOIN fx ON fund_price_date = currency_exchange_date
        """,
    ),
    "source": (
        ("priced", "month_file", "daily"),
        """
        SELECT m.account_id, m.management_company_code, m.fund_code, p.fund_price_date AS extract_date,
               m.shares_owned_amount AS shares, p.fund_price AS raw_price, p.fund_price_currency,
               p.currency_exchange_rate, p.cad_price, m.shares_owned_amount * p.cad_price AS source_market_value,
               'MONTHLY' AS source_path, TRUE AS is_monthly
        FROM month_file m JOIN priced p
          ON m.fund_code = p.fund_code AND m.management_company_code = p.management_company_code
         AND CAST(try_strptime(m.file_date, '%y%m%d') AS DATE) = p.fund_price_date
        UNION ALL
        SELECT d.account_id, d.management_company_code, d.fund_code, p.fund_price_date, d.shares_owned_amount,
               p.fund_price, p.fund_price_currency, p.currency_exchange_rate, p.cad_price,
               d.shares_owned_amount * p.cad_price, 'DAILY', FALSE
        FROM daily d JOIN priced p
          ON d.fund_code = p.fund_code AND d.management_company_code = p.management_company_code
         AND p.fund_price_date BETWEEN d.effective_date AND d.end_date
        WHERE d.management_company_code IN ('MAX', 'CGF')
        """,
    ),
    "source_dealer": (
        ("source", "account"),
        """
        SELECT s.*, a.dealer_code
        FROM source s LEFT JOIN account a
          ON s.account_id = a.account_id AND s.management_company_code = a.management_company_code
         AND s.extract_date BETWEEN a.effective_date AND a.end_date
        """,
    ),
    "trx": (
        (),
        f"""
        SELECT o_custkey AS investor_id, o_custkey * 10 + (l_orderkey + leg) % 3 AS account_id, {_COMPANY} AS company,
               CASE WHEN leg > 0 AND (l_orderkey + l_linenumber) % 80 = 0 THEN l_partkey + 1 ELSE l_partkey END
                   AS fund_code,
               CAST(l_shipdate + INTERVAL 24 YEAR AS DATE) AS trade_date,
               l_orderkey AS order_id, l_linenumber AS line_number, leg,
               CASE WHEN (l_orderkey + l_linenumber) % 97 = 5 THEN 'X' ELSE l_returnflag END AS trx_code,
               CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CASE WHEN leg > 0 THEN -1 ELSE 1 END AS unit_factor,
               CASE WHEN l_returnflag = 'A' THEN 'IN' ELSE 'OUT' END AS direction,
               CAST(l_quantity AS DECIMAL(18,4)) AS units,
               CAST(CAST((cents * 100 + n // 2) // n
                         + CASE WHEN (l_orderkey + l_linenumber) % 200 = 7 THEN 100 ELSE 0 END AS DECIMAL(14,0))
                    * 0.0001 AS DECIMAL(18,4)) AS price,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
               CAST(CASE WHEN l_partkey % 101 = 0 THEN -1 ELSE l_partkey % 25 END AS INTEGER) AS status_code
        FROM (
            SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents,
                   CAST(l_quantity AS BIGINT) AS n
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        ), (VALUES (0), (1), (2)) v(leg)
        WHERE leg = 0 OR (leg = 1 AND (l_orderkey + l_linenumber) % 40 = 0)
           OR (leg = 2 AND (l_orderkey + l_linenumber) % 120 = 0)
        """,
    ),
    "status": (
        (),
        """
        SELECT CAST(n_nationkey AS INTEGER) AS status_code, left(n_name, 5) AS status_mnemonic,
               lower(n_name) AS status_description,
               CASE WHEN n_regionkey % 2 = 0 THEN 'Y' ELSE 'N' END AS allows_order_entry
        FROM nation
        """,
    ),
    "trx_type": (
        (),
        """
        SELECT DISTINCT l_returnflag AS trx_code, 'type ' || lower(l_returnflag) AS trx_description,
               CASE WHEN l_returnflag = 'R' THEN 'O' ELSE 'I' END AS flow_code,
               CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS INTEGER) AS type_factor
        FROM lineitem
        """,
    ),
    "near_month_end": (
        ("trx",),
        """
        SELECT trx.*, last_day(trade_date) AS month_end, 'PRE' AS window_side
        FROM trx WHERE date_diff('day', trade_date, last_day(trade_date)) <= 10
        UNION ALL
        SELECT trx.*, CAST(date_trunc('month', trade_date) - INTERVAL 1 DAY AS DATE), 'POST'
        FROM trx WHERE day(trade_date) <= 10
        """,
    ),
    "ranked": (
        ("near_month_end",),
        """
        SELECT *, CAST(dense_rank() OVER (PARTITION BY month_end, window_side
                                          ORDER BY abs(date_diff('day', month_end, trade_date))) AS INTEGER)
                      AS biz_day_rank
        FROM near_month_end
        """,
    ),
    "balance": (
        ("trx",),
        """
        SELECT *, CAST(close_balance - units * unit_factor AS DECIMAL(28,4)) AS open_balance
        FROM (
            SELECT *, CAST(sum(units * unit_factor) OVER (
                       PARTITION BY account_id, fund_code
                       ORDER BY trade_date, order_id, line_number, leg, gross, units, unit_factor
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(28,4)) AS close_balance
            FROM trx
        )
        """,
    ),
    "booked": (
        ("balance",),
        """
        SELECT * REPLACE (CAST(close_balance + CASE WHEN (order_id + line_number) % 500 = 3 THEN 0.01 ELSE 0 END
                               AS DECIMAL(28,4)) AS close_balance)
        FROM balance
        """,
    ),
}


def query(text: str, *needed: str) -> str:
    """``text`` with the logical tables it needs put in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in TABLES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    parts = ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in order)
    return f"WITH {parts}\n{text}" if order else text
