"""The conformed tables built from the RAW adapters (first load: MERGE into an empty target)."""

from __future__ import annotations

from .. import oracle_sql as O
from ..registry import register
from ..sources import schemas as S

_IDS = {"cdl_dim_company": "c1", "cdl_dim_customer": "c2", "cdl_dim_product": "c3",
        "cdl_dim_selling_method": "c4", "cdl_dim_calendar": "c5", "cdl_fact_product_price": "c6",
        "cdl_fact_product_cost": "c7", "cdl_fact_sales": "c8", "cdl_fact_returns": "c9",
        "cdl_fact_demand_forecast": "c10", "cdl_fact_sales_forecast": "c11"}


def _make(table: str):
    def q(ctx):
        return ctx.cdl[table]
    q.__doc__ = f"{_IDS[table].upper()}: {table}"
    return q


for _table, _id in _IDS.items():
    register(f"{_id}_{_table}", O.sql(f"SELECT {O.render(S.CDL[_table])} FROM {_table}", _table))(_make(_table))
