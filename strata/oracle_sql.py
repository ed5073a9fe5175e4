"""Independent DuckDB SQL for every verifiable query.

Each query is written again in plain SQL over the driver's tables, as CTEs that restate the RAW
adapter rules, the CDL builders and the operator semantics. ``sql(final, *ctes)`` prefixes the
CTEs a query needs (with their dependencies, in order). Output columns are rendered like
``strata.functions.portable``: decimals and dates as text, timestamps as fixed-format text.
"""

from __future__ import annotations

from .plans.cdl import DEFAULT_RUN_TS
from .sources import schemas as S
from .sources.testdata import STATIC_LOAD_TS

RUN_TS = f"TIMESTAMP '{DEFAULT_RUN_TS:%Y-%m-%d %H:%M:%S}'"
STATIC_TS = f"TIMESTAMP '{STATIC_LOAD_TS:%Y-%m-%d %H:%M:%S}'"


def fp(x: str) -> str:
    return (f"cast(cast(cast(('0x' || substr(md5({x}), 1, 16)) as ubigint) as hugeint) "
            f"- 9223372036854775808 as bigint)")


def pkey(toy: str = "TOY_NO", dash: str = "DASH_CODE") -> str:
    return fp(f"({toy} || '-' || {dash})")


def ckey(d: str) -> str:
    return fp(f"(cast(year({d}) as varchar) || cast({d} as varchar))")


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def text(x: str) -> str:
    return f"cast({x} as varchar)"


def dec(x: str, p: int = 38, s: int = 9) -> str:
    return f"cast(cast({x} as decimal({p},{s})) as varchar)"


REGION_CCY = ("case {k} when 0 then 'ZAR' when 1 then 'USD' when 2 then 'JPY' when 3 then 'EUR' "
              "when 4 then 'AED' else 'USD' end")

CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTE[name] = (body, deps)


def sql(final: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS (\n{CTE[n][0]}\n)" for n in order) + "\n" + final


def _cols(schema, skip=()) -> list[str]:
    return [f.name for f in schema.fields if f.name not in skip]


def dedup_order(schema, keys: list[str], first: str = "RAW_LOAD_DATE DESC NULLS LAST",
                used=("RAW_LOAD_DATE",)) -> str:
    tail = [f"{c} ASC NULLS FIRST" for c in _cols(schema, ("CDL_LOAD_DATE",))
            if c not in keys and c not in used and not c.startswith("KEY_")]
    return ", ".join([first] + tail)


# ---------------------------------------------------------------- RAW adapters
cte("raw_company", f"""
SELECT printf('N%02d', n_nationkey) COMPANY_CODE, 'Company ' || n_name COMPANY_NAME, r_name REGION,
       {REGION_CCY.format(k='n_regionkey')} CURRENCY_CODE, substr(r_name, 1, 4) GEOGRAPHIC_SECURITY_CODE,
       n_name COUNTRY, 'ACTIVE' STATUS, {STATIC_TS} LOAD_DATE
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")

cte("raw_customer", f"""
SELECT printf('CUST%09d', c_custkey) CUSTOMER_CODE, c_name CUSTOMER_NAME, c_mktsegment CUSTOMER_TYPE,
       'ACTIVE' STATUS, cast(floor(c_acctbal) as bigint) CREDIT_LIMIT,
       case c_custkey % 3 when 0 then 'NET30' when 1 then 'NET60' else 'NET90' end PAYMENT_TERMS,
       {STATIC_TS} LOAD_DATE
FROM customer""")

cte("raw_product", f"""
SELECT printf('P%08d', p_partkey) TOY_NO, cast(p_size % 6 as varchar) DASH_CODE, p_name PRODUCT_NAME,
       p_type CATEGORY, p_brand BRAND, case when p_size > 45 then 'DISCONTINUED' else 'ACTIVE' end STATUS,
       make_date(1994, cast(p_partkey % 12 + 1 as integer), 1) LAUNCH_DATE,
       cast(p_size * 0.1 as decimal(38,9)) WEIGHT_KG, {STATIC_TS} LOAD_DATE
FROM part""")

cte("ol_joined", """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_shipdate,
       o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, c_custkey, c_nationkey, p_partkey, p_size,
       n_regionkey,
       cast(round(l_discount * 100) as bigint) disc,
       cast(round(p_retailprice * 100) as bigint) list_cents,
       cast(floor((cast(round(p_retailprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint))
                   + 50) / 100) as bigint) sell_cents,
       cast(l_quantity as bigint) qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey""")

_OL_SELECT = f"""
SELECT 'ORD-' || cast(o_orderkey as varchar) ORDER_ID, cast(l_linenumber as bigint) ORDER_LINE_NO,
       cast(o_orderdate as date) TRANSACTION_DATE, printf('N%02d', c_nationkey) COMPANY_CODE,
       case substr(o_orderpriority, 1, 1) when '1' then '100' when '2' then '200' when '3' then '300'
            else '400' end SELLING_METHOD_CODE,
       printf('CUST%09d', c_custkey) CUSTOMER_CODE, printf('P%08d', p_partkey) TOY_NO,
       cast(p_size % 6 as varchar) DASH_CODE,
       case when l_linestatus = 'F' then 'INVOICED' else 'SHIPPED' end ORDER_STATUS,
       case o_orderstatus when 'F' then 'STANDARD' when 'O' then 'RUSH' else 'BACKORDER' end ORDER_TYPE,
       qty ORDER_QTY,
       cast(list_cents * 0.01 as decimal(38,9)) LIST_PRICE,
       cast(sell_cents * 0.01 as decimal(38,9)) SELLING_PRICE,
       disc DISCOUNT_PCT,
       cast(qty * sell_cents * 0.01 as decimal(38,9)) ORDER_VALUE,
       cast(qty * list_cents * 0.01 as decimal(38,9)) ORDER_LIST_VALUE,
       {REGION_CCY.format(k='n_regionkey')} CURRENCY_CODE,
       cast(l_shipdate as timestamp) LOAD_DATE"""

cte("raw_order_line", _OL_SELECT + "\nFROM ol_joined", "ol_joined")

cte("raw_return", f"""
SELECT 'RET-' || cast(o_orderkey as varchar) RETURN_ID, ORDER_ID, ORDER_LINE_NO,
       cast(l_shipdate as date) + 30 RETURN_DATE, COMPANY_CODE, TOY_NO, DASH_CODE,
       -greatest(1, cast(floor(ORDER_QTY / 4) as bigint)) RETURN_QTY,
       cast(cast(-greatest(1, cast(floor(ORDER_QTY / 4) as bigint)) * SELLING_PRICE as decimal(18,2))
            as decimal(38,9)) RETURN_VALUE,
       case l_partkey % 4 when 0 then 'DEFECTIVE' when 1 then 'WRONG_ITEM' when 2 then 'CUSTOMER_CHANGE'
            else 'DAMAGED_SHIPPING' end RETURN_REASON,
       CURRENCY_CODE, cast(cast(l_shipdate as date) + 30 as timestamp) LOAD_DATE
FROM ({_OL_SELECT}, o_orderkey, l_shipdate, l_partkey FROM ol_joined WHERE l_returnflag = 'R') r""", "ol_joined")

cte("order_years", """
SELECT unnest(range(y0, y1 + 1)) yr, y0 FROM (
  SELECT cast(year(min(o_orderdate)) as bigint) y0, cast(year(max(o_orderdate)) as bigint) y1 FROM orders)""")


def _yearly(type_col: str, value_col: str, types: list[tuple[str, int]]) -> str:
    vals = ", ".join(f"('{t}', {p})" for t, p in types)
    return f"""
SELECT printf('P%08d', p_partkey) TOY_NO, cast(p_size % 6 as varchar) DASH_CODE, t.typ {type_col},
       cast(cast(floor((cast(round(p_retailprice * 100) as bigint) * t.pct * (100 + 2 * (y.yr - y.y0)) + 5000)
                       / 10000) as bigint) * 0.01 as decimal(38,9)) {value_col},
       'USD' CURRENCY_CODE, make_date(cast(y.yr as integer), 1, 1) EFFECTIVE_DATE,
       make_date(cast(y.yr as integer), 12, 31) EXPIRY_DATE, {STATIC_TS} LOAD_DATE
FROM part CROSS JOIN order_years y CROSS JOIN (VALUES {vals}) t(typ, pct)"""


cte("raw_price", _yearly("PRICE_TYPE", "PRICE", [("LIST", 100), ("EST_INVOICE", 80)]), "order_years")
cte("raw_cost", _yearly("COST_TYPE", "COST", [("EX-FACTORY", 40), ("WORLDWIDE", 50)]), "order_years")

cte("monthly_lines", """
SELECT TOY_NO, DASH_CODE, COMPANY_CODE, SELLING_METHOD_CODE, CURRENCY_CODE,
       cast(date_trunc('month', TRANSACTION_DATE) as date) AS MONTH, sum(ORDER_QTY) QTY
FROM raw_order_line GROUP BY ALL""", "raw_order_line")

cte("raw_demand_forecast", f"""
SELECT concat_ws('-', 'DF', TOY_NO, DASH_CODE, COMPANY_CODE, SELLING_METHOD_CODE, strftime(MONTH, '%Y%m'))
         FORECAST_ID,
       MONTH - 1 AS_OF_DATE, MONTH FORECAST_DATE, COMPANY_CODE, SELLING_METHOD_CODE, TOY_NO, DASH_CODE,
       cast(floor(QTY * 110 / 100) as bigint) DEMAND_PLAN_QTY,
       cast(floor(QTY * 105 / 100) as bigint) DEMAND_PLAN_DRAFT_QTY,
       'G' LINE_OF_BUSINESS_CODE, CURRENCY_CODE, {STATIC_TS} LOAD_DATE
FROM monthly_lines""", "monthly_lines")

cte("raw_sales_forecast", f"""
SELECT concat_ws('-', 'SF', TOY_NO, DASH_CODE, COMPANY_CODE, SELLING_METHOD_CODE, strftime(FMONTH, '%Y%m'))
         FORECAST_ID,
       FMONTH - 1 AS_OF_DATE, FMONTH FORECAST_DATE, COMPANY_CODE, SELLING_METHOD_CODE, TOY_NO, DASH_CODE,
       cast(floor(QTY * 90 / 100) as bigint) SALES_FORECAST_QTY,
       cast(floor(QTY * 85 / 100) as bigint) SALES_FORECAST_STAGED_QTY,
       CURRENCY_CODE, {STATIC_TS} LOAD_DATE
FROM (SELECT *, cast(MONTH + INTERVAL 1 MONTH as date) FMONTH FROM monthly_lines) m""", "monthly_lines")


# ---------------------------------------------------------------- CDL builders (first load: insert all)
def _cdl(name: str, raw: str, schema, keys: dict[str, str], merge_keys: list[str], where: str = "",
         stamp: str | None = RUN_TS, extra_deps: tuple = ()) -> None:
    proj = []
    for f in schema.fields:
        if f.name == "CDL_LOAD_DATE":
            continue
        if f.name in keys:
            proj.append(f"{keys[f.name]} {f.name}")
        elif f.name == "RAW_LOAD_DATE":
            proj.append("LOAD_DATE RAW_LOAD_DATE")
        else:
            proj.append(f.name)
    cols = ", ".join(_cols(schema, ("CDL_LOAD_DATE",)))
    stamp_sql = f", {stamp} CDL_LOAD_DATE" if stamp else ""
    body = f"""
SELECT {cols}{stamp_sql} FROM (
  SELECT *, row_number() OVER (PARTITION BY {', '.join(merge_keys)}
                               ORDER BY {dedup_order(schema, merge_keys)}) _rn
  FROM (SELECT {', '.join(proj)} FROM {raw} {where}) s) d
WHERE _rn = 1"""
    cte(name, body, raw, *extra_deps)


_cdl("cdl_dim_company", "raw_company", S.CDL_DIM_COMPANY, {"KEY_COMPANY": fp("COMPANY_CODE")}, ["KEY_COMPANY"])
_cdl("cdl_dim_customer", "raw_customer", S.CDL_DIM_CUSTOMER, {"KEY_CUSTOMER": fp("CUSTOMER_CODE")},
     ["KEY_CUSTOMER"])
_cdl("cdl_dim_product", "raw_product", S.CDL_DIM_PRODUCT, {"KEY_PRODUCT": pkey()}, ["KEY_PRODUCT"])
_cdl("cdl_fact_product_price", "raw_price", S.CDL_FACT_PRODUCT_PRICE, {"KEY_PRODUCT": pkey()},
     ["KEY_PRODUCT", "PRICE_TYPE", "EFFECTIVE_DATE"])
_cdl("cdl_fact_product_cost", "raw_cost", S.CDL_FACT_PRODUCT_COST, {"KEY_PRODUCT": pkey()},
     ["KEY_PRODUCT", "COST_TYPE", "EFFECTIVE_DATE"])
SALES_KEYS = {"KEY_PRODUCT": pkey(), "KEY_COMPANY": fp("COMPANY_CODE"), "KEY_CUSTOMER": fp("CUSTOMER_CODE"),
              "KEY_SELLING_METHOD": fp("SELLING_METHOD_CODE"), "KEY_CALENDAR": ckey("TRANSACTION_DATE")}
_cdl("cdl_fact_sales", "raw_order_line", S.CDL_FACT_SALES, SALES_KEYS, ["ORDER_ID", "ORDER_LINE_NO"])
RETURN_KEYS = {"KEY_PRODUCT": pkey(), "KEY_COMPANY": fp("COMPANY_CODE"), "KEY_CALENDAR": ckey("RETURN_DATE")}
_cdl("cdl_fact_returns", "raw_return", S.CDL_FACT_RETURNS, RETURN_KEYS, ["RETURN_ID", "ORDER_LINE_NO"])
FC_KEYS = {"KEY_PRODUCT": pkey(), "KEY_COMPANY": fp("COMPANY_CODE"), "KEY_SELLING_METHOD": fp("SELLING_METHOD_CODE")}
_cdl("cdl_fact_demand_forecast", "raw_demand_forecast", S.CDL_FACT_DEMAND_FORECAST, FC_KEYS, ["FORECAST_ID"])
_cdl("cdl_fact_sales_forecast", "raw_sales_forecast", S.CDL_FACT_SALES_FORECAST, FC_KEYS, ["FORECAST_ID"])

cte("cdl_dim_selling_method", f"""
SELECT {fp('SELLING_METHOD_CODE')} KEY_SELLING_METHOD, SELLING_METHOD_CODE, SELLING_METHOD_NAME,
       {RUN_TS} CDL_LOAD_DATE
FROM (SELECT DISTINCT SELLING_METHOD_CODE FROM raw_order_line WHERE SELLING_METHOD_CODE IS NOT NULL) o
FULL OUTER JOIN (VALUES ('100', 'Wholesale'), ('200', 'Direct-to-Consumer'), ('300', 'E-Commerce'),
                        ('400', 'Marketplace')) m(SELLING_METHOD_CODE, SELLING_METHOD_NAME)
USING (SELLING_METHOD_CODE)""", "raw_order_line")

cte("calendar_bounds", """
SELECT (SELECT min(TRANSACTION_DATE) FROM raw_order_line) d0,
       greatest((SELECT max(TRANSACTION_DATE) FROM raw_order_line), (SELECT max(RETURN_DATE) FROM raw_return)) d1""",
    "raw_order_line", "raw_return")

cte("cdl_dim_calendar", f"""
SELECT {ckey('d')} KEY_CALENDAR, d CALENDAR_DATE, cast(year(d) as bigint) AS YEAR, cast(month(d) as bigint) AS MONTH,
       cast(quarter(d) as bigint) AS QUARTER, cast(weekofyear(d) as bigint) WEEK_OF_YEAR,
       cast(dayofweek(d) + 1 as bigint) DAY_OF_WEEK, dayofweek(d) IN (0, 6) IS_WEEKEND, {RUN_TS} CDL_LOAD_DATE
FROM (SELECT cast(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) as date) d FROM calendar_bounds) c""",
    "calendar_bounds")


def render(schema, alias: str = "") -> str:
    """SELECT list rendering every column of ``schema`` like ``portable`` does."""
    from pyspark.sql import types as T
    out = []
    for f in schema.fields:
        x, t = f'{alias}"{f.name}"', f.dataType
        if isinstance(t, T.DecimalType):
            out.append(f'{dec(x, t.precision, t.scale)} AS "{f.name}"')
        elif isinstance(t, T.DateType):
            out.append(f'{text(x)} AS "{f.name}"')
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            out.append(f'{ts_text(x)} AS "{f.name}"')
        elif isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
            out.append(f'cast({x} as bigint) AS "{f.name}"')
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            out.append(f'cast({x} as double) AS "{f.name}"')
        else:
            out.append(f'{x} AS "{f.name}"')
    return ", ".join(out)


def merge_sql(target: str, source: str, schema, keys: list[str], update_cols: list[str],
              stamp_col: str | None, run_ts_sql: str, null_safe: bool = False) -> str:
    """MERGE (matched: update ``update_cols`` + stamp; not matched: insert) as a FULL OUTER JOIN."""
    eq = " AND ".join((f"t.{k} IS NOT DISTINCT FROM s.{k}" if null_safe else f"t.{k} = s.{k}") for k in keys)
    out = []
    for f in schema.fields:
        c = f.name
        if c == stamp_col:
            out.append(f"case when s._sp then {run_ts_sql} else t.{c} end {c}")
        elif c in update_cols:
            out.append(f"case when s._sp then s.{c} else t.{c} end {c}")
        else:
            out.append(f"case when t._tp then t.{c} else s.{c} end {c}")
    return (f"SELECT {', '.join(out)} FROM (SELECT *, true _tp FROM {target}) t "
            f"FULL OUTER JOIN (SELECT *, true _sp FROM {source}) s ON {eq}")
