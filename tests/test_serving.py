"""Hand-checked pages, details, exports, campaign and incremental helpers."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import dedup, merge
from tidewater.plans import campaign, etl, search, serving, sync
from tidewater.sources import files
from tidewater.sources.roles import as_of
from tidewater.sources.schemas import TABLES, conform
from tidewater.sources.shared import stored

C = F.col
NOW = datetime.datetime(2024, 1, 30, 12)


@pytest.fixture(scope="module")
def small(spark):
    """Two customers, their interactions, contacts and opportunities."""
    kind = "customer_name string, industry string, region string, owner_name string, attribute string, purchase_stage string, forecast_type string, interaction_count_30d int, interaction_count_total int, contact_count int, mobile_count int, active_opp_count int, active_opp_amount double, funnel_opp_count int, won_amount double, last_interaction_channel string, intent_score int, intent_level string"
    c = spark.createDataFrame([("Acme", "food", "山东", "Kim", "H", "阶段2 x", None, 4, 9, 2, 1, 1, 50.0, 2, 0.0, "web", 40, "中"), ("Beta", "steel", None, "Lee", None, "阶段6", "A", None, 0, None, 0, 0, 0.0, 0, 10.0, None, 5, "无")], kind)
    c = conform(c, TABLES["customer_360"]).withColumn("campaign_tag", F.when(C("customer_name") == "Acme", "ICT"))
    rows = [("Acme", "Ann", "1", "web", "click_x", "page", NOW, 1, 1), ("Acme", "Ann", "1", "web", "view", "page", NOW - datetime.timedelta(days=40), 0, 2), ("Acme", "Ann", "1", "email", "view", "news", NOW, 0, 3), ("Acme", None, "2", "event", "view", "fair", NOW, 1, 4)]
    d = spark.createDataFrame(rows, "customer_name string, contact_name string, mobile string, channel string, behavior_type string, content string, event_time timestamp_ntz, is_high_value int, source_id long").withColumn("source_table", F.lit("x"))
    k = spark.createDataFrame([("Acme", "Ann", "1", "a@x", "决策者", 3, 2, "low"), ("Acme", None, "2", None, None, 1, 1, "low")], "customer_name string, contact_name string, mobile string, email string, role_category string, interaction_count int, interaction_count_30d int, activity_level string")
    return c, d, conform(k, TABLES["contact_360"])


def test_details(spark, small):
    c, d, k = small
    assert [r.source_id for r in serving.timeline(d, "Acme", 3).collect()] == [1, 3, 4]
    s = serving.statistics(c).first()
    assert (s.customers, s.interaction_count_30d, s.contact_count, s.funnel_opp_count) == (2, 4, 2, 2)
    assert serving.statistics_by_name(c, "Acm").first().customer_name == "Acme" and serving.statistics_by_name(c, "zz").count() == 0
    crm = spark.createDataFrame([("Acme", NOW, 7), ("Acme", NOW - datetime.timedelta(days=1), 3)], "customer_name string, last_visit_time timestamp_ntz, not_visit_days int")
    one = serving.customer_detail(c, d, crm, "Acme", as_of()).first()
    assert (one.live_30d, one.last_visit, one.days_unvisited) == (3, NOW, 3)
    got = {r.mobile: (r.preferred_channel, r.high_value, r.customer_stage) for r in serving.contacts_of(k, k.limit(0), d, c, "Acme").collect()}
    assert got == {"1": ("web", 1, "阶段2 x"), "2": ("event", 1, "阶段2 x")}
    spare = serving.contacts_of(k.limit(0), k, d, c, "Acme")
    assert spare.count() == 2
    opps = spark.createDataFrame([(1, "Acme", datetime.date(2024, 1, 1)), (2, "Acme", None), (3, "Acme", datetime.date(2024, 1, 2)), (4, "Beta", None)], "id long, customer_name string, create_date date")
    assert [r.id for r in serving.opportunities_of(opps, "Acme").collect()] == [3, 1, 2]
    texts = {r.contact_name: (r.high_value_count, r.recommend_way[:4], r.reason) for r in serving.priority_texts(k, c, d, as_of()).collect()}
    assert texts["Ann"][:2] == (1, "先电话或") and "价值确认阶段" in texts["Ann"][2] and texts[None][0] == 1


def test_key_accounts_and_pages(spark, small):
    c, d, _ = small
    accounts = spark.createDataFrame([("1", "Beta", NOW), ("2", "New", NOW), ("0", "Acme", NOW - datetime.timedelta(days=1))], "code string, name string, time timestamp_ntz")
    total, page = serving.key_accounts(accounts, c, d, serving.CustomerFilter(), as_of())
    assert total.first().total == 2 and [(r.customer_name, r.matched) for r in page.collect()] == [("Beta", True), ("New", False)]
    assert [merge.clamped_page(41, n, 20) for n in (0, 1, 3, 9)] == [1, 1, 3, 3] and merge.clamped_page(0, 4, 20) == 1
    x = spark.createDataFrame([(i, i + 1, float(i), "need_review" if i % 2 else "rejected") for i in range(6)], "a int, b int, match_score double, status string")
    assert [r.a for r in dedup.review_page(x, "need_review", 1, 2).collect()] == [5, 3]
    dates = spark.createDataFrame([(" 2024-01-05 ",), ("nan",), ("",), (None,), ("soon",)], "d string").select(text.clean_date(C("d"))).collect()
    assert [r[0] for r in dates] == [datetime.date(2024, 1, 5), None, None, None, None]


def test_campaign(small):
    c, d, _ = small
    page = campaign.followup(c)
    assert [(r.customer_name, r.stage) for r in page.collect()] == [("Acme", "阶段2 x"), ("Beta", "阶段6")]
    assert {r.stage: r.customers for r in campaign.by_stage(page).collect()} == {"阶段2 x": ["Acme"], "阶段6": ["Beta"]}
    options = {(r.option, r.value) for r in campaign.filter_options(c, d).collect()}
    assert {("campaign", "ICT"), ("industry", "food"), ("channel", "web"), ("start", "2023-12-21"), ("end", "2024-01-30")} <= options
    parts = campaign.bootstrap(c, d, "ICT")
    assert set(parts) == {"options", "kpis", "overview", "content", "signals"} and set(campaign.bootstrap(c, d, with_content=False)) == {"options", "kpis", "overview"}
    assert parts["kpis"].first().total_customers == 1 and parts["content"].count() > 0 and "ICT" in {r.tag for r in parts["signals"].collect()}


def test_exports_round_trip(spark, small, tmp_path):
    c, d, k = small
    files.write_export(files.export_frame(c), f"{tmp_path}/x")
    back = files.read_csv(spark, f"{tmp_path}/x", [("客户名称", "customer_name", "string"), ("意向分", "score", "int"), ("nothing", "none", "string")])
    assert sorted(map(tuple, back.collect())) == [("Acme", 40, None), ("Beta", 5, None)]
    frames = {"customer_360": c, "contact_360": k, "interaction_detail": d, "contact_mapping": k.withColumn("source_table", F.lit("crm"))}
    for name, rows in frames.items():
        out = files.export_table(rows, name, [C(rows.columns[0])])
        assert out.count() == rows.count() and out.columns == [head for _, head, _ in files.EXPORTS[name]]
    assert files.sampled(d, "source_id", 2).count() == 2 and files.sampled(d, "source_id").count() == 4


def test_batches_and_changes(spark, small):
    c, d, _ = small
    stamped = sync.stamped(d, 5)
    assert [tuple(r) for r in sync.batch_counts({"a": stamped, "b": stamped}, 5).collect()] == [("x", 8)] and sync.batch_counts({"a": stamped}, 6).count() == 0
    names = c.select("customer_name")
    assert sync.anything_new(d, d.limit(0), names, names) and not sync.anything_new(d.limit(0), d.limit(0), names, names)
    assert sync.anything_new(d.limit(0), d.limit(0), spark.createDataFrame([("New",)], "customer_name string"), names)
    x = spark.createDataFrame([("A", NOW), ("B", NOW), ("C", NOW - datetime.timedelta(days=9))], "name string, updated_at timestamp_ntz")
    since = lambda day: F.lit(day).cast("timestamp_ntz")
    assert [dedup.changed(x, s).count() for s in (None, since("2024-01-29"), since("2024-02-01"))] == [3, 2, 3]
    index = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    assert search.got(index, "id", 2).first().name == "b" and search.got(index, "id", 9).count() == 0
    part = spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string")
    assert sorted(map(tuple, search.updated(index, part, "id").collect())) == [(1, "a", 1), (2, "B", 2), (3, "C", None)]


def test_incremental_contacts_and_untouched_rows(spark):
    """A batch for one customer leaves the rows of others as they are, even where a full load would give others."""
    zhique = spark.createDataFrame([(1, "Acme", "Ann", "1"), (2, "Beta", "Bob", "2")], "id long, related_company string, contact_name string, mobile string")
    crm = spark.createDataFrame([(1, "Ann", "Acme", "1"), (2, "Bob", "Beta", "2")], "id long, contact_name string, customer_name string, mobile string")
    visit = lambda i, m: (i, i, "Ann" if m == "1" else "Bob", m, "点击邮件链接", "x", NOW)
    kind = "id long, behavior_id long, contact_name string, mobile_phone string, behavior_type string, behavior_name string, behavior_time timestamp_ntz"
    first, more = spark.createDataFrame([visit(1, "1"), visit(2, "2")], kind), spark.createDataFrame([visit(3, "1")], kind)
    t = {"zhique_contact": zhique, "crm_contact": crm, "zhique_behavior": first}
    before = {n: stored(df, n) for n, df in etl.run_full(t, as_of(), spark).items()}
    marked = before | {"customer_360": before["customer_360"].withColumn("region", F.lit("old"))}
    new = t | {"zhique_behavior": first.unionByName(more)}
    assert [r.customer_name for r in etl.affected(before, {"zhique_behavior": more}, new, spark).collect()] == ["Acme"]
    out = etl.run_incremental(marked, {"zhique_behavior": more}, new, as_of(), spark)
    assert {r.customer_name: (r.interaction_count_total, r.region) for r in out["customer_360"].collect()} == {"Acme": (2, None), "Beta": (1, "old")}
    assert {r.contact_name: r.interaction_count for r in out["contact_360"].collect()} == {"Ann": 2, "Bob": 1}
