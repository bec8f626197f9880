"""Schemas of source and result tables, and fitting a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SOURCES = {
    "zhique_contact": "id long, related_company string, industry string, sales_region string, attribute string, contact_name string, mobile string, email string, department string, position string, etl_time timestamp_ntz",
    "zhique_behavior": "id long, behavior_id long, contact_name string, mobile_phone string, behavior_type string, behavior_name string, behavior_time timestamp_ntz, etl_time timestamp_ntz",
    "crm_contact": "id long, contact_name string, customer_name string, mobile string, email string, department string, position string, purchase_role string, industry string, sales_region string, attribute string, sales_name string, etl_time timestamp_ntz",
    "crm_opportunity": "id long, customer_name string, opp_name string, is_funnel string, forecast_type string, customer_stage string, amount_10k decimal(20,4), order_amount_10k decimal(20,4), is_active int, create_date date, etl_time timestamp_ntz",
    "crm_lead": "lead_code string, company string, person string, phone string, obtained date, source_class string, source_kind string, activity string",
    "crm_opportunity_data": "opp_code string, customer string, owner string, opp_name string, created date, origin string",
    "marketing_lead": "id long, final_company_name string, customer_company string, opp_customer_name string, customer_name string, contact_phone string, email string, lead_function string, etl_time timestamp_ntz",
    "linkflow_contacts": "id long, contact_id long, name string, mobile_phone string, email string, title string, department string",
    "linkflow_events": "id long, contact_id long, event_id long, extra_id long, event_name string, event_date_ms long",
    "tianrun_session": "id long, customer_name string, visitor_name string, visitor_mobile_phone string, visitor_email string, contact_type_name string, receive_type_name string, close_reason_name string, start_time_sec long, total_duration long",
    "key_customer": "id long, key_customer_name string, customer_name string, industry_category string, department_level3 string, attribute string",
}
_TABLES = {
    "customer_360": "customer_name string, industry string, region string, owner_name string, attribute string, purchase_stage string, forecast_type string, role_coverage string, interaction_count_30d int, interaction_count_total int, contact_count int, mobile_count int, active_opp_count int, active_opp_amount decimal(22,2), funnel_opp_count int, won_amount decimal(22,2), last_interaction_time timestamp_ntz, last_interaction_channel string, latest_channel string, top_channels array<string>, source_tables array<string>, data_coverage struct<has_crm: boolean, has_opp: boolean, has_contacts: boolean, has_interactions: boolean>, intent_score int, intent_level string",
    "contact_360": "customer_name string, contact_name string, mobile string, email string, department string, position string, purchase_role string, role_category string, interaction_count int, interaction_count_30d int, last_interaction_time timestamp_ntz, activity_level string, source_tables array<string>, linkflow_contact_id long",
}


class _Parsed(dict):
    """Schemas by name, parsed when first asked for: parsing needs a session."""

    def __init__(self, texts: dict[str, str]):
        super().__init__()
        self.texts = texts

    def __missing__(self, name: str) -> StructType:
        self[name] = StructType.fromDDL(self.texts[name])
        return self[name]


SOURCES, TABLES = _Parsed(_SOURCES), _Parsed(_TABLES)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of schema, in its order and types; those that df lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
