"""One customer whatever the case, accents and width of its name."""

import datetime

from tidewater.plans import etl
from tidewater.sources.names import spellings
from tidewater.sources.roles import as_of
from tidewater.sources.shared import stored

VISIT = "id long, behavior_id long, contact_name string, mobile_phone string, behavior_type string, behavior_name string, behavior_time timestamp_ntz"


def visit(i, mobile):
    return (i, i, "Ann", mobile, "点击邮件链接", "x", datetime.datetime(2024, 1, 29))


def sources(spark, *visits):
    return {
        "zhique_contact": spark.createDataFrame([(1, "Acmé", "Ann", "1"), (2, "Straße AG", "Bob", "2")], "id long, related_company string, contact_name string, mobile string"),
        "crm_contact": spark.createDataFrame([(1, "Ann", "ＡＣＭＥ", "1", "food"), (2, "Cid", "acme", "3", "food"), (3, "Dan", "STRASSE ag", "4", "steel"), (4, "Eve", "acme ", "5", "other")], "id long, contact_name string, customer_name string, mobile string, industry string"),
        "key_customer": spark.createDataFrame([(1, "ACME", "Kim", "KEY", "North")], "id long, key_customer_name string, customer_name string, industry_category string, department_level3 string"),
        "crm_lead": spark.createDataFrame([("L1", "  ÂCME", "Fay", "7", datetime.date(2024, 1, 30))], "lead_code string, company string, person string, phone string, obtained date"),
        "zhique_behavior": spark.createDataFrame(list(visits), VISIT),
    }


def test_spellings(spark):
    t = sources(spark)
    got = {r.name: r.spelling for r in spellings(t).collect()}
    assert got == {"ＡＣＭＥ": "Acmé", "acme": "Acmé", "ACME": "Acmé", "ÂCME": "Acmé", "STRASSE ag": "Straße AG"}
    known = spark.createDataFrame([("aCMe",), (None,), ("",)], "customer_name string")
    assert {r.name: r.spelling for r in spellings(t, known).collect()} == dict.fromkeys(["ＡＣＭＥ", "acme", "ACME", "ÂCME", "Acmé"], "aCMe") | {"STRASSE ag": "Straße AG"}


def test_a_load_has_one_customer_for_all_spellings(spark):
    out = etl.run_full(sources(spark, visit(1, "1")), as_of(), spark)
    rows = {r.customer_name: r for r in out["customer_360"].collect()}
    assert set(rows) == {"Acmé", "Straße AG"}
    acme = rows["Acmé"]
    assert (acme.owner_name, acme.contact_count, acme.interaction_count_total) == ("Kim", 2, 2)  # key customer, CRM, a visit and a lead
    assert rows["Straße AG"].industry == "steel"
    assert {(r.customer_name, r.contact_name) for r in out["contact_mapping"].collect()} == {("Acmé", "Ann"), ("Acmé", "Cid"), ("Straße AG", "Bob"), ("Straße AG", "Dan")}
    assert {r.customer_name for r in out["interaction_detail"].collect()} == {"Acmé"}


def test_a_batch_keeps_the_spelling_that_is_there(spark):
    """What comes later under another spelling goes to the customer that is there, by a load of the batch as by a full one."""
    first = sources(spark, visit(1, "1"))
    before = {n: stored(df, n) for n, df in etl.run_full(first, as_of(), spark).items()}
    more = spark.createDataFrame([(9, "Gus", "àcmè", "9", "food")], "id long, contact_name string, customer_name string, mobile string, industry string")
    t = first | {"crm_contact": first["crm_contact"].unionByName(more)}
    full = etl.run_full(t, as_of(), spark)["customer_360"]
    part = etl.run_incremental(before, {"crm_contact": more}, t, as_of(), spark)["customer_360"]
    assert sorted(map(str, part.collect())) == sorted(map(str, full.collect()))
    assert part.filter("customer_name = 'Acmé'").first().contact_count == 3
