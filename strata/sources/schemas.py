"""Declared schemas of every persistent table: RAW, CDL, marts, ADMIN block, ops logs.

Schemas are declared, never inferred on load. NUMERIC is decimal(38,9) at rest; money that is
computed by the engine uses decimal(18,2) (see ``MONEY``).
"""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = T.DecimalType(38, 9)
MONEY = T.DecimalType(18, 2)
S, L, D, TS, B, DBL = (T.StringType(), T.LongType(), T.DateType(), T.TimestampType(),
                       T.BooleanType(), T.DoubleType())


def _schema(*fields: tuple, not_null: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in not_null) for n, t in fields])


# ---------------------------------------------------------------- RAW layer
RAW_COMPANY = _schema(("COMPANY_CODE", S), ("COMPANY_NAME", S), ("REGION", S), ("CURRENCY_CODE", S),
                      ("GEOGRAPHIC_SECURITY_CODE", S), ("COUNTRY", S), ("STATUS", S), ("LOAD_DATE", TS),
                      not_null=("COMPANY_CODE",))
RAW_CUSTOMER = _schema(("CUSTOMER_CODE", S), ("CUSTOMER_NAME", S), ("CUSTOMER_TYPE", S), ("STATUS", S),
                       ("CREDIT_LIMIT", L), ("PAYMENT_TERMS", S), ("LOAD_DATE", TS),
                       not_null=("CUSTOMER_CODE",))
RAW_PRODUCT = _schema(("TOY_NO", S), ("DASH_CODE", S), ("PRODUCT_NAME", S), ("CATEGORY", S), ("BRAND", S),
                      ("STATUS", S), ("LAUNCH_DATE", D), ("WEIGHT_KG", NUMERIC), ("LOAD_DATE", TS),
                      not_null=("TOY_NO", "DASH_CODE"))
RAW_PRICE = _schema(("TOY_NO", S), ("DASH_CODE", S), ("PRICE_TYPE", S), ("PRICE", NUMERIC), ("CURRENCY_CODE", S),
                    ("EFFECTIVE_DATE", D), ("EXPIRY_DATE", D), ("LOAD_DATE", TS),
                    not_null=("TOY_NO", "DASH_CODE", "PRICE_TYPE"))
RAW_COST = _schema(("TOY_NO", S), ("DASH_CODE", S), ("COST_TYPE", S), ("COST", NUMERIC), ("CURRENCY_CODE", S),
                   ("EFFECTIVE_DATE", D), ("EXPIRY_DATE", D), ("LOAD_DATE", TS),
                   not_null=("TOY_NO", "DASH_CODE", "COST_TYPE"))
RAW_ORDER_LINE = _schema(
    ("ORDER_ID", S), ("ORDER_LINE_NO", L), ("TRANSACTION_DATE", D), ("COMPANY_CODE", S),
    ("SELLING_METHOD_CODE", S), ("CUSTOMER_CODE", S), ("TOY_NO", S), ("DASH_CODE", S), ("ORDER_STATUS", S),
    ("ORDER_TYPE", S), ("ORDER_QTY", L), ("LIST_PRICE", NUMERIC), ("SELLING_PRICE", NUMERIC),
    ("DISCOUNT_PCT", L), ("ORDER_VALUE", NUMERIC), ("ORDER_LIST_VALUE", NUMERIC), ("CURRENCY_CODE", S),
    ("LOAD_DATE", TS), not_null=("ORDER_ID", "ORDER_LINE_NO"))
RAW_RETURN = _schema(
    ("RETURN_ID", S), ("ORDER_ID", S), ("ORDER_LINE_NO", L), ("RETURN_DATE", D), ("COMPANY_CODE", S),
    ("TOY_NO", S), ("DASH_CODE", S), ("RETURN_QTY", L), ("RETURN_VALUE", NUMERIC), ("RETURN_REASON", S),
    ("CURRENCY_CODE", S), ("LOAD_DATE", TS), not_null=("RETURN_ID",))
RAW_DEMAND_FORECAST = _schema(
    ("FORECAST_ID", S), ("AS_OF_DATE", D), ("FORECAST_DATE", D), ("COMPANY_CODE", S),
    ("SELLING_METHOD_CODE", S), ("TOY_NO", S), ("DASH_CODE", S), ("DEMAND_PLAN_QTY", L),
    ("DEMAND_PLAN_DRAFT_QTY", L), ("LINE_OF_BUSINESS_CODE", S), ("CURRENCY_CODE", S), ("LOAD_DATE", TS),
    not_null=("FORECAST_ID",))
RAW_SALES_FORECAST = _schema(
    ("FORECAST_ID", S), ("AS_OF_DATE", D), ("FORECAST_DATE", D), ("COMPANY_CODE", S),
    ("SELLING_METHOD_CODE", S), ("TOY_NO", S), ("DASH_CODE", S), ("SALES_FORECAST_QTY", L),
    ("SALES_FORECAST_STAGED_QTY", L), ("CURRENCY_CODE", S), ("LOAD_DATE", TS), not_null=("FORECAST_ID",))

RAW = {
    "raw_company": RAW_COMPANY, "raw_customer": RAW_CUSTOMER, "raw_product": RAW_PRODUCT,
    "raw_price": RAW_PRICE, "raw_cost": RAW_COST, "raw_order_line": RAW_ORDER_LINE, "raw_return": RAW_RETURN,
    "raw_demand_forecast": RAW_DEMAND_FORECAST, "raw_sales_forecast": RAW_SALES_FORECAST,
}


# ---------------------------------------------------------------- CDL layer
def _cdl(keys: list[str], raw: T.StructType, raw_stamp: bool = True) -> T.StructType:
    fields = [T.StructField(k, L, i != 0 or len(keys) > 1) for i, k in enumerate(keys)]
    fields += [f for f in raw.fields if f.name != "LOAD_DATE"]
    if raw_stamp:
        fields.append(T.StructField("RAW_LOAD_DATE", TS, True))
    fields.append(T.StructField("CDL_LOAD_DATE", TS, True))
    return T.StructType(fields)


CDL_DIM_COMPANY = _cdl(["KEY_COMPANY"], RAW_COMPANY)
CDL_DIM_CUSTOMER = _cdl(["KEY_CUSTOMER"], RAW_CUSTOMER)
CDL_DIM_PRODUCT = _cdl(["KEY_PRODUCT"], RAW_PRODUCT)
CDL_DIM_SELLING_METHOD = _schema(("KEY_SELLING_METHOD", L), ("SELLING_METHOD_CODE", S),
                                 ("SELLING_METHOD_NAME", S), ("CDL_LOAD_DATE", TS),
                                 not_null=("KEY_SELLING_METHOD",))
CDL_DIM_CALENDAR = _schema(("KEY_CALENDAR", L), ("CALENDAR_DATE", D), ("YEAR", L), ("MONTH", L), ("QUARTER", L),
                           ("WEEK_OF_YEAR", L), ("DAY_OF_WEEK", L), ("IS_WEEKEND", B), ("CDL_LOAD_DATE", TS),
                           not_null=("KEY_CALENDAR",))
CDL_FACT_SALES = _cdl(["KEY_PRODUCT", "KEY_COMPANY", "KEY_CUSTOMER", "KEY_SELLING_METHOD", "KEY_CALENDAR"],
                      RAW_ORDER_LINE)
CDL_FACT_RETURNS = _cdl(["KEY_PRODUCT", "KEY_COMPANY", "KEY_CALENDAR"], RAW_RETURN)
CDL_FACT_PRODUCT_PRICE = _cdl(["KEY_PRODUCT"], RAW_PRICE)
CDL_FACT_PRODUCT_COST = _cdl(["KEY_PRODUCT"], RAW_COST)
CDL_FACT_DEMAND_FORECAST = _cdl(["KEY_PRODUCT", "KEY_COMPANY", "KEY_SELLING_METHOD"], RAW_DEMAND_FORECAST)
CDL_FACT_SALES_FORECAST = _cdl(["KEY_PRODUCT", "KEY_COMPANY", "KEY_SELLING_METHOD"], RAW_SALES_FORECAST)

CDL = {
    "cdl_dim_company": CDL_DIM_COMPANY, "cdl_dim_customer": CDL_DIM_CUSTOMER, "cdl_dim_product": CDL_DIM_PRODUCT,
    "cdl_dim_selling_method": CDL_DIM_SELLING_METHOD, "cdl_dim_calendar": CDL_DIM_CALENDAR,
    "cdl_fact_sales": CDL_FACT_SALES, "cdl_fact_returns": CDL_FACT_RETURNS,
    "cdl_fact_product_price": CDL_FACT_PRODUCT_PRICE, "cdl_fact_product_cost": CDL_FACT_PRODUCT_COST,
    "cdl_fact_demand_forecast": CDL_FACT_DEMAND_FORECAST, "cdl_fact_sales_forecast": CDL_FACT_SALES_FORECAST,
}

# ---------------------------------------------------------------- ADMIN block and marts
# The eleven audit columns every mart carries, in declared order.
ADMIN = _schema(
    ("ADMIN_PROCESS_ID", S), ("ADMIN_COMPOSITEKEY_HASH", L), ("ADMIN_SCHEDULER_TYPE", S), ("ADMIN_ROW_HASH", L),
    ("ADMIN_LOAD_DATE", TS), ("ADMIN_ISDELETED", B), ("ADMIN_ISERROR", B), ("ADMIN_LAST_MODIFIED_DATE", TS),
    ("ADMIN_DML_OPERATION_FLAG", S), ("ADMIN_RECORD_STATUS", S), ("ADMIN_SOURCE_SYSTEM", S))
ADMIN_COLUMNS = [f.name for f in ADMIN.fields]

FACT_SALES_SUMMARY = _schema(
    ("KEY_CALENDAR", L), ("KEY_PRODUCT", L), ("KEY_COMPANY", L), ("KEY_CUSTOMER", L), ("KEY_SELLING_METHOD", L),
    ("TRANSACTION_DATE", D), ("TRANSACTION_YEAR", L), ("TRANSACTION_MONTH", L), ("COMPANY_CODE", S),
    ("COMPANY_NAME", S), ("SELLING_METHOD_CODE", S), ("TOY_NO", S), ("PRODUCT_NAME", S), ("CATEGORY", S),
    ("BRAND", S), ("CUSTOMER_CODE", S), ("CURRENCY_CODE", S), ("TOTAL_ORDER_QTY", L),
    ("TOTAL_ORDER_VALUE", NUMERIC), ("TOTAL_LIST_VALUE", NUMERIC), ("AVG_SELLING_PRICE", NUMERIC),
    ("AVG_DISCOUNT_PCT", NUMERIC), ("ORDER_COUNT", L))
FACT_PRODUCT_PROFITABILITY = _schema(
    ("KEY_PRODUCT", L), ("KEY_COMPANY", L), ("TOY_NO", S), ("DASH_CODE", S), ("PRODUCT_NAME", S),
    ("CATEGORY", S), ("BRAND", S), ("COMPANY_CODE", S), ("CURRENCY_CODE", S), ("TOTAL_SALES_QTY", L),
    ("TOTAL_SALES_VALUE", NUMERIC), ("TOTAL_LIST_VALUE", NUMERIC), ("TOTAL_RETURN_QTY", L),
    ("TOTAL_RETURN_VALUE", NUMERIC), ("NET_SALES_QTY", L), ("NET_SALES_VALUE", NUMERIC),
    ("CURRENT_LIST_PRICE", NUMERIC), ("CURRENT_UNIT_COST", NUMERIC), ("GROSS_MARGIN", NUMERIC),
    ("GROSS_MARGIN_PCT", NUMERIC), ("RETURN_RATE_PCT", NUMERIC))
FACT_DEMAND_VS_SALES = _schema(
    ("KEY_PRODUCT", L), ("KEY_COMPANY", L), ("KEY_SELLING_METHOD", L), ("AS_OF_DATE", D), ("FORECAST_DATE", D),
    ("FORECAST_YEAR", L), ("FORECAST_MONTH", L), ("TOY_NO", S), ("PRODUCT_NAME", S), ("CATEGORY", S),
    ("BRAND", S), ("COMPANY_CODE", S), ("COMPANY_NAME", S), ("SELLING_METHOD_CODE", S), ("CURRENCY_CODE", S),
    ("DEMAND_PLAN_QTY", L), ("DEMAND_PLAN_DRAFT_QTY", L), ("SALES_FORECAST_QTY", L),
    ("SALES_FORECAST_STAGED_QTY", L), ("ACTUAL_SALES_QTY", L), ("ACTUAL_SALES_VALUE", NUMERIC),
    ("DEMAND_VS_ACTUAL_VARIANCE", L), ("FORECAST_VS_ACTUAL_VARIANCE", L), ("DEMAND_ACCURACY_PCT", NUMERIC),
    ("FORECAST_ACCURACY_PCT", NUMERIC))

MARTS = {"fact_sales_summary": FACT_SALES_SUMMARY, "fact_product_profitability": FACT_PRODUCT_PROFITABILITY,
         "fact_demand_vs_sales": FACT_DEMAND_VS_SALES}


def with_admin(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + list(ADMIN.fields))


# ---------------------------------------------------------------- operational logs
PIPELINE_RUNS = _schema(("run_id", S), ("run_timestamp", TS), ("step", S), ("table_name", S), ("status", S),
                        ("rows_affected", L), ("duration_seconds", DBL), ("error_message", S),
                        ("created_at", TS), not_null=("run_id", "run_timestamp", "step", "status"))
PIPELINE_ARTIFACTS = _schema(
    ("artifact_id", S), ("filename", S), ("target_table", S), ("yaml_content", S), ("version", L), ("status", S),
    ("error_message", S), ("test_definitions", S), ("test_results", S), ("attempt_number", L),
    ("created_at", TS), ("updated_at", TS), not_null=("artifact_id", "filename", "version", "status"))
PIPELINE_LESSONS = _schema(("id", S), ("context", S), ("error_message", S), ("fix_description", S),
                           ("error_category", S), ("created_at", TS),
                           not_null=("id", "context", "error_message"))
#: The run log of the refreshes: the pipeline_runs record and the rows of each change class.
REFRESH_LOG = T.StructType([*PIPELINE_RUNS.fields, *_schema(("rows_inserted", L), ("rows_updated", L), ("rows_unchanged", L)).fields])
OPS = {"pipeline_runs": PIPELINE_RUNS, "pipeline_artifacts": PIPELINE_ARTIFACTS,
       "pipeline_lessons": PIPELINE_LESSONS}
