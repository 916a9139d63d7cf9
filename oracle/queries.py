"""Expected results, one SQL text per registered query."""

from oracle.tables import query
from plumbline.config import GUARANTEE_FLAGS

_T_KEYS = "t.policy_number, t.manufacturing_company_code, t.extract_date"
_MATCH = (
    "t.policy_number = r.contract_policy_number AND t.manufacturing_company_code = r.fund_management_company_code"
    " AND t.extract_date = r.extract_date"
)
_FUND = " AND t.fund_code = r.fund_code"
_EXPECTED = "CAST(round(r.canadian_unit_price * r.number_of_units, 2) AS DECIMAL(18,2))"
_WINDOW = "BETWEEN DATE '2020-09-01' AND DATE '2021-03-31'"
_LIMIT = 30000


def _on_target(columns: str, condition: str) -> str:
    return query(f"SELECT {_T_KEYS}, {columns} FROM t WHERE {condition}", "t")


def _on_records(columns: str, condition: str, match: str = _MATCH, keys: str = _T_KEYS) -> str:
    return query(f"SELECT {keys}, {columns} FROM t JOIN r ON {match} WHERE {condition}", "t", "r")


def _value_check(match: str = _MATCH, keys: str = _T_KEYS, extra: str = "") -> str:
    return _on_records(
        f"r.number_of_units AS ref_units, r.canadian_unit_price AS ref_price, {_EXPECTED} AS expected_mv,"
        f" t.market_value AS tgt_mv, abs(t.market_value - {_EXPECTED}) AS variance",
        f"abs(t.market_value - {_EXPECTED}) > 0.01{extra}",
        match,
        keys,
    )


def _pct(a: str, b: str, digits: int, signed: bool = False) -> str:
    top = f"({a} - {b})" if signed else f"abs({a} - {b})"
    return f"round(CAST({top} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * 100, {digits}) + CAST(0 AS DOUBLE)"


def _totals(t_group: str, r_group: str, names: list[str]) -> str:
    on = " AND ".join(f"a.k{i} = b.k{i}" for i in range(len(names)))
    keys = ", ".join(f"a.k{i} AS {n}" for i, n in enumerate(names))
    t_cols = ", ".join(f"{c} AS k{i}" for i, c in enumerate(t_group.split(", ")))
    r_cols = ", ".join(f"{c} AS k{i}" for i, c in enumerate(r_group.split(", ")))
    return query(
        f"""
        SELECT {keys}, CAST(a.v AS DECIMAL(28,2)) AS tgt_total, CAST(b.v AS DECIMAL(28,2)) AS ref_total,
               CAST(abs(a.v - b.v) AS DECIMAL(28,2)) AS variance, {_pct("a.v", "b.v", 6)} AS pct_variance
        FROM (SELECT {t_cols}, sum(market_value) AS v FROM t GROUP BY ALL) a
        JOIN (SELECT {r_cols}, sum({_EXPECTED}) AS v FROM r GROUP BY ALL) b ON {on}
        WHERE CAST(abs(a.v - b.v) AS DOUBLE) / nullif(CAST(b.v AS DOUBLE), 0) > 0.0001
        """,
        "t", "r",
    )


# --- variance reports -----------------------------------------------------------------------

_RATIO = "abs(CAST(tv - sv AS DOUBLE) / nullif(CAST(sv AS DOUBLE), 0))"
_VPCT = _pct("tv", "sv", 6, signed=True)


def _ladder(gap: str, last: str = "MISMATCH") -> str:
    return f"CASE WHEN {gap} <= 0.0001 THEN 'MATCH' WHEN {gap} <= 0.001 THEN 'INVESTIGATE' ELSE '{last}' END"


def _money(value: str, digits: int = 2) -> str:
    return f"CAST(round({value}, {digits}) AS DECIMAL(28,{digits}))"


_A_PAIRS = f"""
    SELECT strftime(r.extract_date, '%Y-%m') AS report_month, r.fund_management_company_code AS company,
           r.fund_code, r.dealer_code, r.monthly_extract_indicator AS is_monthly,
           r.contract_policy_number AS s_account, t.policy_number AS t_account,
           r.canadian_unit_price * r.number_of_units AS s_value, r.number_of_units AS s_units,
           r.canadian_unit_price AS s_price, CAST(NULL AS VARCHAR) AS currency,
           t.market_value AS t_value, t.number_of_units AS t_units, t.unit_value AS t_price, t.dealer_code AS t_dealer
    FROM r LEFT JOIN t ON {_MATCH}
"""


def _b_pairs(source: str = "source", flag: bool = False, fund: bool = False) -> str:
    return f"""
    SELECT strftime(s.extract_date, '%Y-%m') AS report_month, s.management_company_code AS company, s.fund_code,
           {"s.dealer_code" if source == "source_dealer" else "CAST(NULL AS VARCHAR)"} AS dealer_code, s.is_monthly,
           s.account_id AS s_account, t.policy_number AS t_account,
           s.source_market_value AS s_value, s.shares AS s_units, s.cad_price AS s_price,
           s.fund_price_currency AS currency,
           t.market_value AS t_value, t.number_of_units AS t_units, t.unit_value AS t_price, t.dealer_code AS t_dealer
    FROM {source} s LEFT JOIN t
      ON t.policy_number = s.account_id AND t.manufacturing_company_code = s.management_company_code
     AND t.extract_date = s.extract_date
     {"AND t.monthly_extract_indicator = s.is_monthly" if flag else ""}
     {"AND t.fund_code = s.fund_code" if fund else ""}
    """


def _report(pairs: str, group: str, columns: str, *needed: str, where: str = "") -> str:
    return query(
        f"""
        SELECT {columns} FROM (
            SELECT {group}, count(DISTINCT s_account) AS sa, count(*) AS sn, sum(s_value) AS sv, sum(s_units) AS su,
                   max(s_price) AS sp, count(DISTINCT t_account) AS ta, count(t_account) AS tn, sum(t_value) AS tv,
                   sum(t_units) AS tu, max(t_price) AS tp, max(currency) AS cur, max(t_dealer) AS td
            FROM ({pairs} {where}) GROUP BY {group}
        )
        """,
        *needed,
    )


def _sides(target: str, rows: bool = True) -> str:
    s = "sa AS source_account_count, " + ("sn AS source_row_count, " if rows else "")
    t = f"ta AS {target}_account_count, " + (f"tn AS {target}_row_count, " if rows else "")
    return f"{s}{_money('sv')} AS source_mv, {t}{_money('tv')} AS {target}_mv"


_VARIANCE = f"{_money('tv - sv')} AS variance_amt, {_VPCT} AS variance_pct"


def _a(group: str, labels: str, ladder: str = _RATIO, pairs: str = _A_PAIRS, where: str = "") -> str:
    columns = f"{labels}, {_sides('target')}, {_VARIANCE}, {_ladder(ladder)} AS status"
    return _report(pairs, group, columns, "t", "r", where=where)


def _a4(ladder: str) -> str:
    return _report(
        _A_PAIRS,
        "report_month, company, fund_code",
        f"""report_month, company AS management_company, fund_code, {_sides("target", rows=False)},
        {_money("su", 4)} AS source_total_units, {_money("tu", 4)} AS target_total_units,
        {_money("sp", 4)} AS source_canadian_unit_price, {_money("tp", 4)} AS target_unit_value, {_VARIANCE},
        {_money("tp - sp", 4)} AS unit_price_diff,
        CASE WHEN abs(round(tp - sp, 4)) > 0.01 THEN 'PRICE MISMATCH'
             WHEN abs(round(su, 4) - round(tu, 4)) > 0.01 THEN 'UNITS MISMATCH' ELSE {_ladder(ladder)} END AS status""",
        "t", "r",
    )


_UNITS_B = f"{_money('su')} AS source_total_units, {_money('tu')} AS dest_total_units"


def _b(group: str, labels: str, extra: str = "", pairs: str | None = None, where: str = "", *needed: str) -> str:
    columns = f"{labels}, {_sides('dest')}, {extra}{_VARIANCE}, {_ladder(_RATIO)} AS status"
    return _report(pairs or _b_pairs(), group, columns, *(needed or ("t", "source")), where=where)


_REPORTS: dict[str, str] = {
    "a1": _a("report_month", "report_month"),
    "a2": _a("report_month, company", "report_month, company AS management_company"),
    "a3": _a("report_month, dealer_code", "report_month, dealer_code", f"abs({_VPCT})"),
    "a3_ratio": _a("report_month, dealer_code", "report_month, dealer_code"),
    "a4": _a4(f"abs({_VPCT})"),
    "a4_ratio": _a4(_RATIO),
    "a5": _report(
        _A_PAIRS,
        "report_month, is_monthly",
        f"""report_month, CASE WHEN is_monthly THEN 'Monthly File' ELSE 'Daily File' END AS extract_type,
        {_sides("target")}, {_VARIANCE}, {_money("su")} AS source_total_units, {_money("tu")} AS target_total_units,
        {_money("tu - su", 4)} AS units_variance, {_ladder(_RATIO)} AS status""",
        "t", "r",
    ),
    "b1": _b("report_month", "report_month", f"{_UNITS_B}, "),
    "b2": _b("report_month, company", "report_month, company AS management_company_code"),
    "b3": _report(
        _b_pairs(),
        "report_month, company, fund_code",
        f"""report_month, company AS management_company_code, fund_code, cur AS currency_flag,
        {_sides("dest", rows=False)}, {_money("su", 4)} AS source_total_units, {_money("tu", 4)} AS dest_total_units,
        {_money("sp", 6)} AS source_cad_price, {_money("tp", 6)} AS dest_unit_value,
        {_money("tp - sp", 6)} AS price_diff, {_money("tu - su", 4)} AS units_diff,
        {_money("tv - sv")} AS mv_variance_amt, {_VPCT} AS mv_variance_pct,
        CASE WHEN abs(tp - sp) > 0.01 THEN 'PRICE MISMATCH' WHEN abs(tu - su) > 0.01 THEN 'UNITS MISMATCH'
             ELSE {_ladder(_RATIO, "MV MISMATCH")} END AS status""",
        "t", "source",
    ),
    "b4": _b(
        "report_month, dealer_code",
        "report_month, dealer_code AS source_dealer_code, td AS dest_dealer_code",
        "", _b_pairs("source_dealer"), "", "t", "source_dealer",
    ),
    "b5": _b(
        "report_month, is_monthly",
        """report_month, CASE WHEN is_monthly THEN 'Monthly File (fund_position_monthly)'
                              ELSE 'Daily File  (fund_position_daily)' END AS source_path""",
        f"{_UNITS_B}, {_money('tu - su', 4)} AS units_variance, ",
        _b_pairs(flag=True),
    ),
}

_A1_KEY_GRAIN = f"""
    SELECT strftime(r.extract_date, '%Y-%m') AS report_month, r.account AS s_account, t.account AS t_account,
           r.v AS s_value, t.v AS t_value, r.n AS s_n, t.n AS t_n
    FROM (SELECT contract_policy_number AS account, fund_management_company_code AS company, extract_date,
                 sum(canadian_unit_price * number_of_units) AS v, count(*) AS n FROM r GROUP BY ALL) r
    LEFT JOIN (SELECT policy_number AS account, manufacturing_company_code AS company, extract_date,
                      sum(market_value) AS v, count(*) AS n FROM t GROUP BY ALL) t
    USING (account, company, extract_date)
"""


# --- suite ----------------------------------------------------------------------------------


def _counts(checks: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name[:2].upper()}-{name[2:]}' AS test_id, (SELECT count(*) FROM ({text})) AS row_count"
        for name, text in checks.items()
    )


_META = [
    ("MV-01", "Target holds rows", "Row Count & Coverage", "has_rows"),
    ("MV-02", "Reference holds rows", "Row Count & Coverage", "has_rows"),
    ("MV-03", "Row counts agree per day", "Row Count & Coverage", "zero_rows"),
    ("MV-04", "Reference value is price times units", "Market Value Formula", "zero_rows"),
    ("MV-05", "Target value is reference price times units", "Market Value Formula", "zero_rows"),
    ("MV-06", "Target unit value is reference price", "Market Value Formula", "zero_rows"),
    ("MV-07", "Units agree", "Market Value Formula", "zero_rows"),
    ("MV-08", "Total value agrees per day", "Dimensional Breakdown", "zero_rows"),
    ("MV-09", "Total value agrees per day and company", "Dimensional Breakdown", "zero_rows"),
    ("MV-10", "Total value agrees per day and dealer", "Dimensional Breakdown", "zero_rows"),
    ("MV-11", "Every target row has a plan", "Dimensional Breakdown", "zero_rows"),
    ("MV-12", "Monthly flag agrees", "Indicator Flags", "zero_rows"),
    ("MV-13", "Weekly flag agrees", "Indicator Flags", "zero_rows"),
    ("MV-14", "No guarantee flag is set", "Indicator Flags", "zero_rows"),
    ("MV-15", "Plan key agrees", "Plan & Product Matching", "zero_rows"),
    ("MV-16", "Fund key is resolved", "Plan & Product Matching", "zero_rows"),
    ("MV-17", "Date key is resolved", "Plan & Product Matching", "zero_rows"),
    ("MV-18", "No negative value", "Edge Cases", "zero_rows"),
    ("MV-19", "No units, no value", "Edge Cases", "zero_rows"),
    ("MV-20", "High-value rows reach the target", "Edge Cases", "zero_rows"),
]


def _stored_value(limit: str) -> str:
    return query(
        f"""
        SELECT contract_policy_number, fund_code, fund_management_company_code, extract_date, number_of_units,
               canadian_unit_price, market_value AS stored_mv, {_EXPECTED} AS calculated_mv,
               CAST(abs(market_value - canadian_unit_price * number_of_units) AS DECIMAL(28,8)) AS variance
        FROM r WHERE abs(market_value - canadian_unit_price * number_of_units) > 0.01
        ORDER BY variance DESC, contract_policy_number, fund_code, fund_management_company_code, extract_date,
                 number_of_units, canadian_unit_price, stored_mv, calculated_mv
        {limit}
        """,
        "r",
    )


def _missing(window: str = "") -> str:
    return query(
        f"""
        SELECT r.contract_policy_number, r.fund_management_company_code, r.extract_date, {_EXPECTED} AS expected_mv
        FROM r WHERE {_EXPECTED} > {_LIMIT} {window} AND NOT EXISTS (SELECT 1 FROM t WHERE {_MATCH})
        """,
        "t", "r",
    )


_CHECKS: dict[str, str] = {
    "mv01": query("SELECT 1 AS present FROM t LIMIT 1", "t"),
    "mv02": query("SELECT 1 AS present FROM r LIMIT 1", "r"),
    "mv03": query(
        f"""
        SELECT a.extract_date, a.n AS tgt_rows, b.n AS ref_rows, abs(a.n - b.n) AS row_diff,
               {_pct("a.n", "b.n", 4)} AS pct_diff
        FROM (SELECT extract_date, count(*) AS n FROM t GROUP BY 1) a
        JOIN (SELECT extract_date, count(*) AS n FROM r GROUP BY 1) b USING (extract_date)
        WHERE CAST(abs(a.n - b.n) AS DOUBLE) / nullif(b.n, 0) > 0.01
        """,
        "t", "r",
    ),
    "mv04": _stored_value("LIMIT 25"),
    "mv05": _value_check(),
    "mv06": _on_records(
        "t.unit_value AS tgt_unit_value, r.canadian_unit_price AS ref_price,"
        " abs(t.unit_value - r.canadian_unit_price) AS variance",
        "abs(t.unit_value - r.canadian_unit_price) > 0.01",
    ),
    "mv07": _on_records(
        "t.number_of_units AS tgt_units, r.number_of_units AS ref_units,"
        " abs(t.number_of_units - r.number_of_units) AS diff",
        "abs(t.number_of_units - r.number_of_units) > 0.01",
    ),
    "mv08": _totals("extract_date", "extract_date", ["extract_date"]),
    "mv09": _totals(
        "extract_date, manufacturing_company_code",
        "extract_date, fund_management_company_code",
        ["extract_date", "manufacturing_company_code"],
    ),
    "mv10": _totals("extract_date, dealer_code", "extract_date, dealer_code", ["extract_date", "dealer_code"]),
    "mv11": _on_target("plan_identifier_sk", "plan_identifier_sk IS NULL"),
    "mv12": _on_records(
        "t.monthly_extract_indicator AS tgt_monthly, r.monthly_extract_indicator AS ref_monthly",
        "t.monthly_extract_indicator <> r.monthly_extract_indicator",
    ),
    "mv13": _on_records(
        "t.weekly_extract_indicator AS tgt_weekly, r.weekly_extract_indicator AS ref_weekly",
        "t.weekly_extract_indicator <> r.weekly_extract_indicator",
    ),
    "mv14": _on_target(", ".join(GUARANTEE_FLAGS), " OR ".join(GUARANTEE_FLAGS)),
    "mv15": _on_records(
        "t.plan_identifier_sk AS tgt_plan_sk, r.plan_identifier_sk AS ref_plan_sk",
        "t.plan_identifier_sk <> r.plan_identifier_sk OR t.plan_identifier_sk IS NULL",
    ),
    "mv16": _on_target("fund_sk", "fund_sk = 0 OR fund_sk IS NULL"),
    "mv17": _on_target("extract_date_sk", "extract_date_sk = 0 OR extract_date_sk IS NULL"),
    "mv18": _on_target("number_of_units, unit_value, market_value", "market_value < 0"),
    "mv19": _on_target("number_of_units, unit_value, market_value", "number_of_units = 0 AND market_value <> 0"),
    "mv20": _missing(),
}


def _suite_results() -> str:
    meta = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in _META)
    counts = _counts(_CHECKS | {"mv04": _stored_value("")})
    return f"""
        SELECT test_id, test_name, category, pass_when,
               CASE WHEN (pass_when = 'has_rows') = (row_count > 0) THEN 'PASS' ELSE 'FAIL' END AS status,
               CAST(row_count AS DECIMAL(38,0)) AS row_count
        FROM ({counts}) JOIN (VALUES {meta}) m(test_id, test_name, category, pass_when) USING (test_id)
    """


def _suite_summary() -> str:
    return f"""
        SELECT total, passed, failed, errored, round(passed * 100.0 / total, 1) AS pass_rate,
               CASE WHEN failed = 0 THEN 'ALL TESTS PASSED'
                    ELSE CAST(failed AS VARCHAR) || ' TEST(S) FAILED' END AS verdict
        FROM (SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed,
                     count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'ERROR') AS errored
              FROM ({_suite_results()}))
    """


# How the values of a sample stand in its JSON text: with quotes or without.
_KEY_KINDS = {"policy_number": True, "manufacturing_company_code": True, "extract_date": True}
_REF_KEY_KINDS = {"contract_policy_number": True, "fund_management_company_code": True, "extract_date": True}
_TOTAL_KINDS = {"tgt_total": False, "ref_total": False, "variance": False, "pct_variance": 6}
_SAMPLE_KINDS: dict[str, dict[str, bool | int]] = {
    "mv03": {"extract_date": True, "tgt_rows": False, "ref_rows": False, "row_diff": False, "pct_diff": 6},
    "mv04": {
        "contract_policy_number": True, "fund_code": True, "fund_management_company_code": True, "extract_date": True,
        "number_of_units": False, "canadian_unit_price": False, "stored_mv": False, "calculated_mv": False,
        "variance": False,
    },
    "mv05": _KEY_KINDS
    | {"ref_units": False, "ref_price": False, "expected_mv": False, "tgt_mv": False, "variance": False},
    "mv06": _KEY_KINDS | {"tgt_unit_value": False, "ref_price": False, "variance": False},
    "mv07": _KEY_KINDS | {"tgt_units": False, "ref_units": False, "diff": False},
    "mv08": {"extract_date": True} | _TOTAL_KINDS,
    "mv09": {"extract_date": True, "manufacturing_company_code": True} | _TOTAL_KINDS,
    "mv10": {"extract_date": True, "dealer_code": True} | _TOTAL_KINDS,
    "mv11": _KEY_KINDS | {"plan_identifier_sk": False},
    "mv12": _KEY_KINDS | {"tgt_monthly": False, "ref_monthly": False},
    "mv13": _KEY_KINDS | {"tgt_weekly": False, "ref_weekly": False},
    "mv14": _KEY_KINDS | dict.fromkeys(GUARANTEE_FLAGS, False),
    "mv15": _KEY_KINDS | {"tgt_plan_sk": False, "ref_plan_sk": False},
    "mv16": _KEY_KINDS | {"fund_sk": False},
    "mv17": _KEY_KINDS | {"extract_date_sk": False},
    "mv18": _KEY_KINDS | {"number_of_units": False, "unit_value": False, "market_value": False},
    "mv19": _KEY_KINDS | {"number_of_units": False, "unit_value": False, "market_value": False},
    "mv20": _REF_KEY_KINDS | {"expected_mv": False},
}


def _json_text(kinds: dict[str, bool | int]) -> str:
    def value(name: str, kind: bool | int) -> str:
        if kind is True:
            return f"""coalesce('"' || CAST({name} AS VARCHAR) || '"', 'null')"""
        if kind is False:
            return f"coalesce(CAST({name} AS VARCHAR), 'null')"
        return f"coalesce(CAST(CAST({name} AS DECIMAL(18,{kind})) AS VARCHAR), 'null')"

    cells = " || ',' || ".join(f"""'"{n}":' || {value(n, k)}""" for n, k in kinds.items())
    return f"'{{' || {cells} || '}}'"


def _suite_samples(limit: int) -> str:
    texts = _CHECKS | {"mv04": _stored_value("")}
    parts = "\nUNION ALL\n".join(
        f"SELECT 'MV-{name[2:]}' AS test_id, {_json_text(kinds)} AS sample FROM ({texts[name]})"
        for name, kinds in _SAMPLE_KINDS.items()
    )
    return f"""
        SELECT test_id, sample FROM ({parts})
        QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY sample) <= {limit}
    """


def _suite_grid() -> str:
    return f"""
        SELECT test_id, category, substring(test_name, 1, 44) AS test_name, status,
               CAST(CAST(row_count AS DECIMAL(38,0)) AS VARCHAR) AS rows_or_value
        FROM ({_suite_results()})
    """


_RUNNER = (
    ("X-01", "has_rows", "SELECT l_orderkey FROM runner_lineitem WHERE l_quantity > 30", None),
    ("X-02", "has_rows", "SELECT l_orderkey FROM runner_lineitem WHERE l_quantity < 0", None),
    ("X-03", "zero_rows", "SELECT l_orderkey FROM runner_lineitem WHERE l_discount > 1", None),
    ("X-04", "zero_rows", "SELECT l_orderkey FROM runner_lineitem WHERE l_quantity = 7", None),
    (
        "X-05", "within_pct",
        "SELECT max(l_discount) AS d FROM runner_lineitem GROUP BY l_linestatus ORDER BY d", "d",
    ),
    (
        "X-06", "within_pct",
        "SELECT max(l_quantity) AS q FROM runner_lineitem GROUP BY l_returnflag ORDER BY q", "q",
    ),
    ("X-07", "zero_rows", "SELECT nothing FROM runner_lineitem", None),
)


def _runner_results() -> str:
    """Status by the rules as the reports' text states them; the counts are those of the same conditions."""
    rows = []
    for test_id, rule, text, value in _RUNNER:
        plain = text.replace("runner_lineitem", "lineitem")
        broken = "nothing" in text
        count = "0" if broken else f"(SELECT count(*) FROM ({plain}))"
        metric = f"(SELECT CAST(min({value}) AS DOUBLE) FROM ({plain}))" if value else "CAST(NULL AS DOUBLE)"
        good = {"has_rows": f"{count} > 0", "zero_rows": f"{count} = 0", "within_pct": f"{metric} <= 0.5"}[rule]
        status = "'ERROR'" if broken else f"CASE WHEN {good} THEN 'PASS' ELSE 'FAIL' END"
        rows.append((test_id, rule, status, count, metric, broken, f"'{text}'"))
    negative = query("SELECT count(*) FROM t_all WHERE market_value < 0", "t_all")
    rows.append(
        ("X-08", "zero_rows", f"CASE WHEN ({negative}) = 0 THEN 'PASS' ELSE 'FAIL' END", f"({negative})",
         "CAST(NULL AS DOUBLE)", False, "CAST(NULL AS VARCHAR)")
    )
    return "\nUNION ALL\n".join(
        f"SELECT '{i}' AS test_id, 'name {i}' AS test_name, 'Own' AS category, 'about {i}' AS description,"
        f" 'runner' AS validates, '{rule}' AS pass_when, {status} AS status, CAST({count} AS BIGINT) AS row_count,"
        f" {metric} AS metric_value, {broken} AS has_error, {broken} AS has_traceback, {text} AS sql_query"
        for i, rule, status, count, metric, broken, text in rows
    )


def _runner_problems() -> str:
    lines = "SELECT l_linenumber FROM runner_lineitem WHERE l_linenumber = {}"
    none = "SELECT l_discount FROM runner_lineitem WHERE l_quantity < 0"
    null = "SELECT max(l_discount) AS d FROM runner_lineitem WHERE l_quantity < 0"
    failed = "\nUNION ALL ".join(
        f"""
        SELECT '{i}' AS test_id, 'name {i}' AS test_name, 'FAIL' AS status, n AS row_count, FALSE AS has_error,
               '{lines.format(k)}' AS sql_query, '{{"l_linenumber":{k}}}' AS sample
        FROM (SELECT count(*) AS n FROM lineitem WHERE l_linenumber = {k}), range(5) WHERE range < n
        """
        for i, k in (("Y-01", 1), ("Y-05", 2))
    )
    return f"""
        {failed}
        UNION ALL SELECT 'Y-02', 'name Y-02', 'ERROR', 0, TRUE, '{none}', NULL
        UNION ALL SELECT 'Y-03', 'name Y-03', 'FAIL', 1, FALSE, '{null}', NULL
    """


def _run_changes() -> str:
    return f"""
        SELECT test_id, status AS before_status, row_count AS before_count,
               CASE WHEN test_id = 'MV-20' THEN NULL WHEN test_id = 'MV-05' THEN 'PASS' ELSE status END AS after_status,
               CAST(CASE test_id WHEN 'MV-20' THEN NULL WHEN 'MV-05' THEN 0 WHEN 'MV-06' THEN row_count + 1
                                 ELSE row_count END AS DECIMAL(38,0)) AS after_count,
               CASE WHEN test_id = 'MV-20' THEN 'GONE' WHEN test_id = 'MV-05' AND status <> 'PASS' THEN 'FIXED'
                    WHEN test_id = 'MV-06' THEN 'MOVED' ELSE 'SAME' END AS change
        FROM ({_suite_results()})
    """


def _extract_lines() -> str:
    return """
        SELECT order_id % 40 AS kind, account_id, trade_date, units, trx_code,
               concat_ws(chr(9), CAST(account_id AS VARCHAR),
                         CASE WHEN order_id % 40 = 1 THEN '2020-13-01' ELSE CAST(trade_date AS VARCHAR) END,
                         CASE order_id % 40 WHEN 2 THEN 'NULL' WHEN 3 THEN 'n/a' ELSE CAST(units AS VARCHAR) END,
                         CASE order_id % 40 WHEN 4 THEN trx_code || chr(9) || 'x' WHEN 5 THEN NULL ELSE trx_code END) AS line
        FROM trx
    """


def _unpriced() -> str:
    priced = "p.fund_code = m.fund_code AND p.management_company_code = m.management_company_code"
    return query(
        f"""
        SELECT source_path, management_company_code, reason, count(*) AS positions
        FROM (
            SELECT 'MONTHLY' AS source_path, management_company_code,
                   CASE WHEN try_strptime(file_date, '%y%m%d') IS NULL THEN 'UNREADABLE DATE' ELSE 'NO PRICE' END AS reason
            FROM month_file m WHERE NOT EXISTS (
                SELECT 1 FROM fund_price p
                WHERE {priced} AND p.fund_price_date = CAST(try_strptime(m.file_date, '%y%m%d') AS DATE))
            UNION ALL
            SELECT 'DAILY', management_company_code, 'NO PRICE'
            FROM daily m WHERE management_company_code IN ('MAX', 'CGF') AND NOT EXISTS (
                SELECT 1 FROM fund_price p
                WHERE {priced} AND p.fund_price_date BETWEEN m.effective_date AND m.end_date)
        ) GROUP BY ALL
        """,
        "month_file", "daily", "fund_price",
    )


def _unpriced_days(window: str = "") -> str:
    """Each day of a daily position on which some fund has a price, but its own has none."""
    priced = "p.fund_code = m.fund_code AND p.management_company_code = m.management_company_code"
    prices = f"(SELECT * FROM fund_price WHERE fund_price_date {window})" if window else "fund_price"
    month = "CAST(try_strptime(m.file_date, '%y%m%d') AS DATE)"
    inside = f"AND ({month} {window} OR {month} IS NULL)" if window else ""
    return query(
        f"""
        SELECT source_path, management_company_code, reason, count(*) AS positions, CAST(sum(lost) AS BIGINT) AS position_days
        FROM (
            SELECT 'MONTHLY' AS source_path, management_company_code,
                   CASE WHEN {month} IS NULL THEN 'UNREADABLE DATE' ELSE 'NO PRICE' END AS reason, 1 AS lost
            FROM month_file m WHERE NOT EXISTS (
                SELECT 1 FROM fund_price p WHERE {priced} AND p.fund_price_date = {month}) {inside}
            UNION ALL
            SELECT 'DAILY', m.management_company_code, 'NO PRICE', count(*)
            FROM (SELECT row_number() OVER () AS position, * FROM daily WHERE management_company_code IN ('MAX', 'CGF')) m
            JOIN (SELECT DISTINCT fund_price_date AS d FROM {prices}) ON d BETWEEN effective_date AND end_date
            LEFT JOIN (SELECT DISTINCT fund_code, management_company_code, fund_price_date FROM {prices}) p
              ON {priced} AND p.fund_price_date = d
            WHERE p.fund_code IS NULL
            GROUP BY position, m.management_company_code
        ) GROUP BY ALL
        """,
        "month_file", "daily", "fund_price",
    )


def _lost_days() -> str:
    return query(
        """
        SELECT account_id, m.management_company_code, m.fund_code, effective_date, end_date, count(*) AS lost_days
        FROM (SELECT row_number() OVER () AS position, * FROM daily WHERE management_company_code IN ('MAX', 'CGF')) m
        JOIN (SELECT DISTINCT fund_price_date AS d FROM fund_price) ON d BETWEEN effective_date AND end_date
        LEFT JOIN (SELECT DISTINCT fund_code, management_company_code, fund_price_date FROM fund_price) p
          ON p.fund_code = m.fund_code AND p.management_company_code = m.management_company_code AND p.fund_price_date = d
        WHERE p.fund_code IS NULL
        GROUP BY position, account_id, m.management_company_code, m.fund_code, effective_date, end_date
        """,
        "daily", "fund_price",
    )


def _report_results() -> str:
    gaps = (
        ("SRC-M", "Monthly positions without a price", "MONTHLY", "NO PRICE"),
        ("SRC-U", "Monthly positions with an unreadable date", "MONTHLY", "UNREADABLE DATE"),
        ("SRC-D", "Days of daily positions without a price", "DAILY", "NO PRICE"),
    )
    lost = "\nUNION ALL\n".join(
        f"SELECT '{i}', '{name}', 'Source', 'zero_rows', coalesce(sum(position_days), 0) = 0, coalesce(sum(position_days), 0)"
        f" FROM ({_unpriced_days()}) WHERE source_path = '{path}' AND reason = '{reason}'"
        for i, name, path, reason in gaps
    )
    return f"""
        SELECT test_id, test_name, category, pass_when, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status,
               CAST(row_count AS DECIMAL(38,0)) AS row_count
        FROM (SELECT report_id AS test_id, 'Variance report ' || report_id AS test_name, 'Variance' AS category,
                     'within_limit' AS pass_when, passed, report_rows - rows_within AS row_count
              FROM ({_verdict()})
              UNION ALL {lost})
    """


def _balance_of(rows: str) -> str:
    return f"""
        SELECT {_TRX_ID}, CAST(close_balance - units * unit_factor AS DECIMAL(28,4)) AS open_balance, close_balance
        FROM (SELECT *, CAST(sum(units * unit_factor) OVER (
                         PARTITION BY account_id, fund_code
                         ORDER BY trade_date, order_id, line_number, leg, gross, units, unit_factor
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(28,4)) AS close_balance
              FROM ({rows}))
    """


def _unmatched_of(rows: str) -> str:
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in ("investor_id", "gross", "trade_date"))
    shown = ", ".join(f"a.{c}" for c in (*_TRX_ID.split(", "), "gross", "unit_factor"))
    return f"""
        SELECT {shown}
        FROM (SELECT *, row_number() OVER (PARTITION BY investor_id, gross, trade_date, unit_factor
                                           ORDER BY order_id, line_number, leg, account_id, fund_code) AS place
              FROM ({rows})) a
        LEFT JOIN (SELECT investor_id, gross, trade_date, unit_factor, count(*) AS n FROM ({rows}) GROUP BY ALL) b
          ON {same} AND a.unit_factor = -b.unit_factor
        WHERE place > coalesce(n, 0)
    """


def _totals_safe(text: str) -> str:
    """The gap without regard to the sign of the reference total."""
    plain = "CAST(abs(a.v - b.v) AS DOUBLE) / nullif(CAST(b.v AS DOUBLE), 0)"
    return text.replace(plain, f"abs({plain})")


def _verdict() -> str:
    parts = []
    for name in ("a1", "a2", "a3", "a4", "a5", "b1", "b2", "b3", "b4", "b5"):
        pct = "mv_variance_pct" if name == "b3" else "variance_pct"
        within = f"coalesce(abs({pct}) <= 0.01, FALSE)"
        parts.append(
            f"SELECT '{name.upper()}' AS report_id, count(*) AS report_rows, count(*) FILTER ({within}) AS rows_within,"
            f" bool_and({within}) AS passed FROM ({_REPORTS[name]})"
        )
    return "\nUNION ALL\n".join(parts)


# --- source rebuild and transactions --------------------------------------------------------

_SOURCE_COLUMNS = """
    account_id, management_company_code, fund_code, extract_date, shares, raw_price, fund_price_currency,
    currency_exchange_rate, CAST(cad_price AS DECIMAL(21,8)) AS cad_price,
    CAST(source_market_value AS DECIMAL(34,12)) AS source_market_value, source_path
"""

_TRX_ID = "account_id, fund_code, company, trade_date, order_id, line_number, leg"

_TRANSFERS = """
    SELECT investor_id, gross, trade_date,
           count(*) FILTER (unit_factor < 0) AS out_legs, count(*) FILTER (unit_factor > 0) AS in_legs,
           min(fund_code) FILTER (unit_factor < 0) AS of, max(fund_code) FILTER (unit_factor < 0) AS ol,
           min(fund_code) FILTER (unit_factor > 0) AS if, max(fund_code) FILTER (unit_factor > 0) AS il
    FROM trx GROUP BY ALL
"""

_OTHERS: dict[str, str] = {
    "mv11_grouped": query(
        """
        SELECT plan_identifier_sk, extract_date, count(*) AS record_count,
               CAST(sum(market_value) AS DECIMAL(28,2)) AS total_mv,
               CAST(sum(number_of_units) AS DECIMAL(28,4)) AS total_units,
               CAST(sum(unit_value) AS DOUBLE) / count(unit_value) AS avg_unit_price
        FROM t WHERE plan_identifier_sk IS NULL GROUP BY plan_identifier_sk, extract_date
        """,
        "t",
    ),
    "mv05_fund_grain": _value_check(_MATCH + _FUND, _T_KEYS + ", t.fund_code"),
    "mv05_window": _value_check(extra=f" AND r.extract_date {_WINDOW}"),
    "mv08_safe": query(
        f"""
        SELECT extract_date, CAST(a.v AS DECIMAL(28,2)) AS tgt_total, CAST(b.v AS DECIMAL(28,2)) AS ref_total,
               CAST(abs(a.v - b.v) AS DECIMAL(28,2)) AS variance,
               abs({_pct("a.v", "b.v", 6, signed=True)}) AS pct_variance
        FROM (SELECT extract_date, sum(market_value) AS v FROM t GROUP BY 1) a
        JOIN (SELECT extract_date, sum({_EXPECTED}) AS v FROM r GROUP BY 1) b USING (extract_date)
        WHERE abs(CAST(a.v - b.v AS DOUBLE) / nullif(CAST(b.v AS DOUBLE), 0)) > 0.0001
        """,
        "t", "r",
    ),
    "mv12_null_safe": _on_records(
        "t.monthly_extract_indicator AS tgt_monthly, r.monthly_extract_indicator AS ref_monthly",
        "t.monthly_extract_indicator IS DISTINCT FROM r.monthly_extract_indicator",
    ),
    "mv04_top5": _stored_value("LIMIT 5"),
    "mv09_safe": _totals_safe(_CHECKS["mv09"]),
    "mv10_safe": _totals_safe(_CHECKS["mv10"]),
    "mv13_null_safe": _on_records(
        "t.weekly_extract_indicator AS tgt_weekly, r.weekly_extract_indicator AS ref_weekly",
        "t.weekly_extract_indicator IS DISTINCT FROM r.weekly_extract_indicator",
    ),
    "mv15_null_safe": _on_records(
        "t.plan_identifier_sk AS tgt_plan_sk, r.plan_identifier_sk AS ref_plan_sk",
        "t.plan_identifier_sk IS DISTINCT FROM r.plan_identifier_sk",
    ),
    "suite_samples": _suite_samples(3),
    "suite_grid": _suite_grid(),
    "runner_results": _runner_results(),
    "unpriced_positions": _unpriced(),
    "runner_problems": _runner_problems(),
    "run_changes": _run_changes(),
    "extract_accepted": query(
        "SELECT account_id, trade_date, CASE WHEN kind <> 2 THEN units END AS units, trx_code"
        f" FROM ({_extract_lines()}) WHERE kind NOT IN (1, 3, 4, 5)",
        "trx",
    ),
    "extract_rejected": query(
        "SELECT line, CASE kind WHEN 1 THEN 'trade_date' WHEN 3 THEN 'units' WHEN 4 THEN 'too many cells'"
        f" ELSE 'too few cells' END AS reasons FROM ({_extract_lines()}) WHERE kind IN (1, 3, 4, 5)",
        "trx",
    ),
    "unpriced_days": _unpriced_days(),
    "unpriced_days_window": _unpriced_days(_WINDOW),
    "suite2_results": _report_results(),
    "lost_days": _lost_days(),
    "running_balance_hot": query(
        _balance_of(
            "SELECT * REPLACE (CASE WHEN order_id % 3 = 0 THEN 7 ELSE account_id END AS account_id,"
            " CASE WHEN order_id % 3 = 0 THEN 7 ELSE fund_code END AS fund_code) FROM trx"
        ),
        "trx",
    ),
    "transfer_unmatched_hot": query(
        _unmatched_of(
            "SELECT * REPLACE (CASE WHEN order_id % 3 = 0 THEN NULL ELSE investor_id END AS investor_id,"
            " CAST(CASE WHEN order_id % 3 = 0 THEN 0 ELSE gross END AS DECIMAL(18,2)) AS gross,"
            " CASE WHEN order_id % 3 = 0 THEN DATE '2021-01-04' ELSE trade_date END AS trade_date) FROM trx"
        ),
        "trx",
    ),
    "mv20_window": _missing(f"AND r.extract_date {_WINDOW}"),
    "target_only_keys": query(
        f"SELECT {_T_KEYS}, count(*) AS target_rows FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_MATCH})"
        " GROUP BY ALL",
        "t", "r",
    ),
    "reference_only_keys": query(
        "SELECT r.contract_policy_number AS policy_number,"
        " r.fund_management_company_code AS manufacturing_company_code, r.extract_date, count(*) AS reference_rows"
        f" FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE {_MATCH}) GROUP BY ALL",
        "t", "r",
    ),
    "a1_fund_grain": _a("report_month", "report_month", pairs=_A_PAIRS + _FUND),
    "a1_window": _a("report_month", "report_month", where=f"WHERE r.extract_date {_WINDOW}"),
    "a1_key_grain": query(
        f"""
        SELECT report_month, sa AS source_account_count, sn AS source_row_count, {_money("sv")} AS source_mv,
               ta AS target_account_count, tn AS target_row_count, {_money("tv")} AS target_mv, {_VARIANCE},
               {_ladder(_RATIO)} AS status
        FROM (SELECT report_month, count(DISTINCT s_account) AS sa, CAST(sum(s_n) AS BIGINT) AS sn,
                     sum(s_value) AS sv, count(DISTINCT t_account) AS ta, CAST(sum(t_n) AS BIGINT) AS tn,
                     sum(t_value) AS tv
              FROM ({_A1_KEY_GRAIN}) GROUP BY 1)
        """,
        "t", "r",
    ),
    "b1_fund_grain": _b("report_month", "report_month", f"{_UNITS_B}, ", _b_pairs(fund=True)),
    "b1_window": _b("report_month", "report_month", f"{_UNITS_B}, ", None, f"WHERE s.extract_date {_WINDOW}"),
    "source_monthly": query(f"SELECT {_SOURCE_COLUMNS} FROM source WHERE is_monthly", "source"),
    "source_daily": query(f"SELECT {_SOURCE_COLUMNS} FROM source WHERE NOT is_monthly", "source"),
    "source_priced_fx": query(
        """
        SELECT fund_code, management_company_code, fund_price_date, fund_price AS raw_price, fund_price_currency,
               currency_exchange_rate, CAST(cad_price AS DECIMAL(21,8)) AS cad_price
        FROM priced
        """,
        "priced",
    ),
    "source_with_dealer": query(f"SELECT {_SOURCE_COLUMNS}, dealer_code FROM source_dealer", "source_dealer"),
    "suite_results": _suite_results(),
    "suite_summary": _suite_summary(),
    "suite2_verdict": _verdict(),
    "month_end_window": query(f"SELECT {_TRX_ID}, month_end, window_side FROM near_month_end", "near_month_end"),
    "biz_day_rank": query(f"SELECT {_TRX_ID}, month_end, window_side, biz_day_rank FROM ranked", "ranked"),
    "signed_gross": query(
        f"""
        SELECT {_TRX_ID}, direction, gross,
               CAST(CASE WHEN direction = 'IN' THEN gross ELSE -gross END AS DECIMAL(18,2)) AS signed_gross
        FROM trx
        """,
        "trx",
    ),
    "fund_status": query(
        f"SELECT {_TRX_ID}, status_code, status_mnemonic, status_description, allows_order_entry"
        " FROM trx LEFT JOIN status USING (status_code)",
        "trx", "status",
    ),
    "trx_typed": query(
        f"SELECT {_TRX_ID}, trx_code, trx_description, flow_code, type_factor FROM trx JOIN trx_type USING (trx_code)",
        "trx", "trx_type",
    ),
    "month_end_report": query(
        f"""
        SELECT {_TRX_ID}, month_end, window_side, biz_day_rank, status_code, status_mnemonic, status_description,
               allows_order_entry, trx_code, direction, gross,
               CAST(CASE WHEN direction = 'IN' THEN gross ELSE -gross END AS DECIMAL(18,2)) AS signed_gross,
               units, price
        FROM ranked LEFT JOIN status USING (status_code)
        """,
        "ranked", "status",
    ),
    "month_end_totals": query(
        """
        SELECT month_end, window_side, fund_code, count(*) AS trx_count,
               CAST(sum(CASE WHEN direction = 'IN' THEN gross ELSE -gross END) AS DECIMAL(28,2)) AS signed_gross
        FROM near_month_end GROUP BY month_end, window_side, fund_code
        """,
        "near_month_end",
    ),
    "running_balance": query(f"SELECT {_TRX_ID}, units, unit_factor, open_balance, close_balance FROM balance", "balance"),
    "balance_rollforward": query(
        f"""
        SELECT {_TRX_ID}, units, unit_factor, open_balance, close_balance,
               CAST(open_balance + units * unit_factor - close_balance AS DECIMAL(28,4)) AS gap
        FROM booked WHERE abs(open_balance + units * unit_factor - close_balance) > 0.0011
        """,
        "booked",
    ),
    "direction_check": query(
        f"""
        SELECT {_TRX_ID}, direction, open_balance, close_balance,
               CASE WHEN close_balance > open_balance THEN 'IN' WHEN close_balance < open_balance THEN 'OUT' END
                   AS balance_direction
        FROM balance
        WHERE (direction = 'OUT' AND close_balance > open_balance) OR (direction = 'IN' AND close_balance < open_balance)
        """,
        "balance",
    ),
    "gross_check": query(
        f"""
        SELECT {_TRX_ID}, gross, units, price, CAST(abs(gross - price * units) AS DECIMAL(28,8)) AS variance
        FROM trx WHERE abs(gross - price * units) > 0.01
        """,
        "trx",
    ),
    "transfer_pairs": query(
        f"""
        SELECT investor_id, gross, trade_date, out_legs, in_legs, least(out_legs, in_legs) AS matched_legs,
               of <> if OR ol <> il AS cross_fund
        FROM ({_TRANSFERS}) WHERE out_legs > 0 AND in_legs > 0
        """,
        "trx",
    ),
    "transfer_unmatched": query(
        f"""
        SELECT {_TRX_ID}, gross, unit_factor
        FROM (
            SELECT *, row_number() OVER (PARTITION BY investor_id, gross, trade_date, unit_factor
                                         ORDER BY order_id, line_number, leg, account_id, fund_code) AS place
            FROM trx
        ) a
        WHERE place > (SELECT count(*) FROM trx b WHERE a.investor_id = b.investor_id AND a.gross = b.gross
                                                  AND a.trade_date = b.trade_date AND a.unit_factor = -b.unit_factor)
        """,
        "trx",
    ),
    "trx_untyped": query(
        """
        SELECT trx_code, count(*) AS trx_count FROM trx WHERE trx_code NOT IN (SELECT trx_code FROM trx_type) GROUP BY 1
        """,
        "trx", "trx_type",
    ),
}

ORACLE_SQL: dict[str, str] = _CHECKS | _REPORTS | _OTHERS
