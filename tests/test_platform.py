"""Hand-checked fixtures of scores, names, loads, stores and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scoring, text
from tidewater.operators import dedup, merge
from tidewater.operators import predicates as p
from tidewater.plans import etl, search, serving, sync
from tidewater.sources.roles import as_of, load_tables

C = F.col


def values(spark, rows, kind, *cols):
    return [r[0] if len(cols) == 1 else tuple(r) for r in spark.createDataFrame(rows, kind).select(*cols).collect()]


def test_normalised_names(spark):
    pairs = {
        "华为技术有限公司": "华为", "华为投资控股有限公司": "华为", "腾讯科技（深圳）有限公司": "腾讯 深圳", "腾讯云计算（北京）有限责任公司": "腾讯云计算 北京", "Acme Tech Co., Ltd.": "acme",
        "ACME technologies Inc": "acme", "上海电气集团": "上海电气", "有限公司": "", "café noir": "café noir",
    }
    assert values(spark, [(k,) for k in pairs] + [(None,)], "n string", text.normalize_name(C("n"))) == [*pairs.values(), ""]


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("腾讯 深圳", "腾讯云计算 北京", 19.75), ("blue river foods", "blue river food", 91.77), ("northwind traders", "southwind trading", 36.89), ("", "acme", 0.0), ("alpha beta", "beta alpha", 52.0), ("红星美凯龙家居", "红星美凯龙", 60.71), ("café noir", "cafe noir", 59.89), ("x", "x", 100.0)],
)
def test_name_score(spark, a, b, score):
    both = values(spark, [(a, b)], "a string, b string", scoring.name_score(C("a"), C("b")), scoring.name_score(C("b"), C("a")))[0]
    assert both[0] == pytest.approx(score, abs=0.011)
    assert both[0] == pytest.approx(both[1], abs=0.011)


def test_triage(spark):
    cases = [(100.0, 0, 47.5, "need_review"), (100.0, 3, 79.0, "need_review"), (100.0, 4, 89.5, "auto_merged"), (70.0, 0, 33.25, None), (74.0, 0, 35.15, "need_review"), (0.0, 5, 52.5, "need_review")]
    final = scoring.final_score(C("rule"), scoring.evidence_score(C("shared")))
    got = values(spark, [c[:2] for c in cases], "rule double, shared int", final, scoring.triage(final))
    assert [g[1] for g in got] == [c[3] for c in cases]
    assert [g[0] for g in got] == pytest.approx([c[2] for c in cases], abs=0.011)
    assert values(spark, [(85.0,), (35.0,)], "x double", scoring.triage(C("x"))) == ["need_review", None]


def test_intent(spark):
    cases = [(0, 0, 0, 0, 0, "无"), (0, 5, 2, 2, 26, "低"), (3, 3, 0, 3, 16, "中"), (10, 10, 1, 1, 43, "高"), (10, 10, 0, 1, 23, "中"), (60, 90, 1, 9, 100, "高")]
    got = values(spark, [c[:4] for c in cases], "n30 int, total int, opp int, contacts int", scoring.intent_score(C("n30"), C("opp"), C("contacts")), scoring.intent_level(C("n30"), C("total"), C("opp")))
    assert got == [c[4:] for c in cases]


def test_contact_score(spark):
    rows = [("决策者", 4, 4, 5, "1", "e", "高", "高"), (None, 0, 0, None, None, None, None, "none")]
    parts = scoring.contact_parts(C("role"), C("n"), C("most"), C("days"), C("m"), C("e"), F.lit(None).cast("string"), F.lit(None).cast("string"), C("i"))
    got = values(spark, rows, "role string, n int, most int, days int, m string, e string, i string, a string", scoring.contact_score(parts, C("a")))
    assert got == pytest.approx([97.25, 11.0], abs=0.1)


def test_scalars(spark):
    assert values(spark, [(" 邮件 ",), ("官网",), ("直播/活动",), ("",), (None,), ("foo",)], "c string", text.normalize_channel(C("c"))) == ["email", "web", "event", text.NO_CHANNEL, text.NO_CHANNEL, "other"]
    assert values(spark, [("山东",), ("山东区域",), ("",), (None,), ("大客户部",)], "c string", text.normalize_region(C("c"))) == ["山东", "山东", None, None, "其他"]
    assert values(spark, [("13233412980.0",), (" 138 0000 1111 ",), (None,)], "c string", text.clean_phone(C("c"))) == ["13233412980", "13800001111", None]
    assert values(spark, [("是",), ("Y",), ("0",), ("x",)], "c string", text.clean_flag(C("c"))) == [1, 1, 0, None]
    assert values(spark, [("a", "b")], "a string, b string", text.content_hash_id(C("a"), C("b"))) == [938760983661274987]
    assert values(spark, [("拍板者",), ("评估者",), ("经理",), (None,)], "c string", text.role_category(C("c"))) == ["决策者", "技术评估者", "未知", "未知"]
    assert values(spark, [("ＡＢＣ（é",)], "c string", text.collation_key(C("c"))) == ["abc(e"]


def test_words_roles_and_reasons(spark):
    words = ["QQ群", "Email", " E-MAIL ", "我的IM", "官网访问", "fax", "会"]
    assert values(spark, [(w,) for w in words], "c string", text.channel_of_words(C("c"))) == ["wechat", "email", "email", "wechat", "web", "fax", "event"]
    roles = ["拍板人", "决策层", "技术把关", "评估者", "采购", "推动者", "其他", None]
    assert values(spark, [(r,) for r in roles], "c string", text.key_role(C("c"))) == ["拍板者", "决策者", "评估者", "评估者", "采购推动者", "采购推动者", None, None]
    rows = [(["拍板者", "技术"], "部分"), ([], "全"), (["其他", None], "全"), (["决策"], "全"), (None, None)]
    got = values(spark, rows, "a array<string>, k string", text.missing_roles(F.coalesce(C("a"), F.array().cast("array<string>")), C("k")))
    assert got == [["决策者", "采购推动者"], [], [], ["拍板者", "评估者", "采购推动者"], ["拍板者", "决策者", "评估者", "采购推动者"]]
    reasons = [None, "", "预算和价格", "评价不高", "输给友商", "联系人离职", "代理", "废标", "太慢"]
    want = ["—", "—", "预算不足", "价格竞争", "竞品影响", "关键人缺失", "渠道问题", "流标 / 废标", "其他"]
    assert values(spark, [(r,) for r in reasons], "c string", text.loss_reason(C("c"))) == want
    won = [(None, None, None, None), (1.0, None, None, None), (None, 100.0, None, None), (0.0, 30.0, "赢单", None), (None, None, "", "成交"), (None, None, "谈判", "成交")]
    got = values(spark, won, "a double, r double, s string, f string", text.is_won(C("a"), C("r"), C("s"), C("f")))
    assert got == [False, True, True, True, True, False]


def test_hashed_vectors_plainly(spark):
    import math

    import xxhash

    names = ["blue river", "é腾讯", "a", ""]
    for name, got in zip(names, values(spark, [(n,) for n in names], "n string", dedup.hashed_vector(C("n"))), strict=True):
        v = [0.0] * 64
        for k in (2, 3, 4):
            for i in range(len(name) - k + 1):
                h = xxhash.xxh64_intdigest(name[i : i + k].encode(), 42)
                v[(h - (1 << 64) if h >> 63 else h) % 64] += 1
        norm = math.sqrt(sum(x * x for x in v))
        assert got == pytest.approx([x / norm if norm else 0.0 for x in v])


def test_key_customers_and_coverage(spark):
    """A key customer is matched by its own name and brings its owner; coverage is of the row before that."""
    t = {
        "zhique_contact": spark.createDataFrame([(1, "Acme", "Ann", "1"), (2, "Beta", "Bob", "2")], "id long, related_company string, contact_name string, mobile string"),
        "crm_contact": spark.createDataFrame([(1, "Cid", "Acme", "3", "food", "S1")], "id long, contact_name string, customer_name string, mobile string, industry string, sales_name string"),
        "key_customer": spark.createDataFrame([(1, "Acme", None, "KEY", None), (2, "Beta", "Kim", "KEY", "North"), (3, "New", "Lee", "KEY", "South"), (4, "", "Nobody", "KEY", "x")], "id long, key_customer_name string, customer_name string, industry_category string, department_level3 string"),
        "marketing_lead": spark.createDataFrame([(1, "Acme", "Dan", "9", "Head of IT")], "id long, final_company_name string, customer_name string, contact_phone string, lead_function string"),
        "tianrun_session": spark.createDataFrame([(1, "网页", "Guest", "7"), (2, "", "Guest", "7")], "id long, customer_name string, visitor_name string, visitor_mobile_phone string"),
    }
    out = etl.run_full(t, as_of(), spark)
    rows = {r.customer_name: r for r in out["customer_360"].collect()}
    assert {k: (r.owner_name, r.industry, r.region) for k, r in rows.items()} == {"Acme": ("S1", "KEY", None), "Beta": ("Kim", "KEY", "North"), "New": ("Lee", "KEY", "South")}
    assert tuple(rows["Acme"].data_coverage) == (True, False, True, False) and tuple(rows["Beta"].data_coverage) == (False, False, False, False) and rows["New"].data_coverage is None
    mapping = {(r.customer_name, r.contact_name): (r.mobile, r.position) for r in out["contact_mapping"].collect()}
    assert mapping["Acme", "Dan"] == ("9", "Head of IT") and mapping["网页", "Guest"] == (None, None) and ("", "Guest") not in mapping


def test_first_wins_and_upsert(spark):
    kind = "k string, m string, v string"
    a, b = spark.createDataFrame([("Acme", "1", "zhique")], kind), spark.createDataFrame([("Acme", "1", "crm"), ("Acme", None, "x"), ("Acme", None, "y")], kind)
    assert sorted(merge.first_wins([a, b], ["k", "m"], ["v"]).collect(), key=str) == sorted([("Acme", "1", "zhique"), ("Acme", None, "x"), ("Acme", None, "y")], key=str)
    new = spark.createDataFrame([("Acme", "1", "e2"), ("New", "2", None)], kind)
    once = merge.upsert(a, new, ["k", "m"], ["v"])
    assert sorted(once.collect(), key=str) == [("Acme", "1", "e2"), ("New", "2", None)]
    assert sorted(merge.upsert(once, new, ["k", "m"], ["v"]).collect(), key=str) == sorted(once.collect(), key=str)


def test_marks(spark):
    rows = spark.createDataFrame([(9,), (10,), (11,)], "id long")
    assert [r.id for r in sync.past(rows, sync.Mark("id", "id"), 10).collect()] == [11]
    assert sync.past(rows, sync.Mark("id", "id"), None).count() == 3
    assert sync.advance(rows, sync.Mark("id", "id")).first().mark == "11"


def test_store_publishes_only_valid_versions(spark, tmp_path):
    store = sync.Store(spark, f"file://{tmp_path}/store")
    good, empty = spark.range(3).selectExpr("cast(id as string) customer_name"), spark.createDataFrame([], "customer_name string")
    assert store.publish("v1", {"customer_360": good}, etl.validate, {"e": 5})
    assert not store.publish("v2", {"customer_360": empty}, etl.validate)
    assert store.state()["current"] == "v1" and store.read("customer_360").count() == 3
    assert store.publish("v3", {"customer_360": good.limit(2)})
    store.go_back()
    assert store.read("customer_360").count() == 3 and store.state()["marks"] == {"e": 5}
    store.log("r1", status="success", rows=3)
    assert store.history().count() == 1


def test_role_coverage_and_null_safe_contacts(spark):
    t = {
        "zhique_contact": spark.createDataFrame([(1, "Acme Ltd", "Ann", None, "a@x")], "id long, related_company string, contact_name string, mobile string, email string"),
        "crm_contact": spark.createDataFrame([(1, "Bob", "Acme Ltd", "1", "拍板者"), (2, "Cid", "Acme Ltd", "2", "评估者"), (3, "Dan", "Acme Ltd", "3", "使用者")], "id long, contact_name string, customer_name string, mobile string, purchase_role string"),
        "crm_opportunity_data": spark.createDataFrame([("o", "Acme Ltd", "Ann", "deal", datetime.date(2024, 1, 30), None)], "opp_code string, customer string, owner string, opp_name string, created date, origin string"),
    }
    out = etl.run_full(t, as_of(), spark)
    c = out["customer_360"].first()
    assert (c.role_coverage, c.interaction_count_30d, c.contact_count) == ("全", 1, 3)
    ann = out["contact_360"].filter("contact_name = 'Ann'").first()
    assert (ann.mobile, ann.interaction_count, ann.activity_level) == (None, 1, "low")


def test_empty_sources(spark):
    out = etl.run_full({}, as_of(), spark)
    assert out["customer_360"].count() == 0 and out["contact_360"].count() == 0
    assert not etl.validate(out).filter("valid").count()


def test_filters(spark):
    rows = spark.createDataFrame([("Acme One", "北京", "H"), ("Beta", None, None), ("Gamma", "北京区域", "N")], "customer_name string, region string, attribute string")
    assert rows.filter(p.region_is(C("region"), "北京")).count() == 2
    assert rows.filter(p.region_is(C("region"), "其他")).count() == 1
    assert rows.filter(p.both(p.attribute_is(C("attribute"), "non_heavy"))).count() == 2
    assert rows.filter(p.name_is(C("customer_name"), "Acme One")).count() == 1 and rows.filter(p.name_is(C("customer_name"), "eta")).count() == 1
    assert p.date_window(C("x"), "nothing", None) == []
    asked = [({"content": "x"}, ""), ({"channel": "web"}, ""), ({"is_high_value": 1}, ""), ({"mobile": "1"}, ""), ({"role_category": "x"}, ""), ({"email": "x", "customer_id": 1}, ""), ({"position": "x"}, "Interaction_Count 多少")]
    asked += [({}, "张先生的手机"), ({}, "最近的直播"), ({}, "李总"), ({}, "哪些客户")]
    tables = ["interaction_detail"] * 3 + ["contact_mapping"] * 2 + ["contact_360"] * 3 + ["interaction_detail", "contact_360", "customer_360"]
    assert [p.table_for(*a) for a in asked] == tables
    times = spark.sql("SELECT CAST(t AS TIMESTAMP_NTZ) AS t FROM VALUES ('2024-01-30 12:00:00'), ('2024-01-31 10:00:00'), ('2024-01-31 13:00:00'), ('2024-02-01 00:00:00') AS v(t)")
    assert [times.filter(p.both(p.text_window(C("t"), s, e))).count() for s, e in ((None, "2024-01-31"), ("2024-01-31", "2024-01-31 12:30:00"), ("2024-01-31 11:00:00", None), (None, "soon"))] == [3, 1, 2, 0]


def test_search(spark):
    docs = spark.createDataFrame([(1, "华为 技术 Alpha", 5), (2, "beta", None), (3, "alpha", 7)], "id int, name string, n int")
    total, hits = search.search(docs, {"query": {"bool": {"should": [{"match": {"name": "alpha"}}, {"term": {"id": 2}}], "must_not": [{"range": {"n": {"gt": 6}}}]}}, "sort": [{"n": "desc"}], "size": 5})
    assert total.first().total == 2 and [r.id for r in hits.collect()] == [1, 2]
    assert docs.filter(search.compiled({"match": {"name": "华为"}})).count() == 1


def test_review(spark):
    c = spark.createDataFrame([(1, 2, 91.0, "need_review"), (3, 4, 50.0, "need_review")], "a int, b int, match_score double, status string")
    assert [r.status for r in dedup.rescan(c).orderBy("a").collect()] == ["auto_merged", "need_review"]
    d = spark.createDataFrame([(3, 4, False)], "a int, b int, approved boolean")
    assert [r.status for r in dedup.decide(c, d).orderBy("a").collect()] == ["need_review", "rejected"]
    assert values(spark, [("Acme", "Acme Ltd", False, True)], "a string, b string, x boolean, y boolean", dedup.primary(C("a"), C("b"), C("x"), C("y"))) == ["Acme Ltd"]


def test_duplicates_of_all_companies(spark):
    """Equal and similar names are candidates wherever the companies are; others are not, nor are known pairs."""
    companies = spark.createDataFrame([(1, "Blue River Foods Ltd", "DE", "food"), (2, "blue river foods", "FR", "retail"), (3, "Blue River Food", "JP", "food"), (4, "Quantum Xylo", "DE", "food"), (5, None, "DE", "food")], "id int, name string, nation string, industry string")
    contacts = spark.createDataFrame([(c, "phone", str(v)) for c in (1, 3, 4) for v in range(5)], "company int, kind string, value string")
    got = {(r.a, r.b): (r.similarity, r.shared, r.status) for r in dedup.run(companies, contacts, None).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)}
    assert got[1, 2] == (0.98, 0, "need_review") and got[1, 3][1:] == (5, "auto_merged") and 0.7 <= got[2, 3][0] < 1
    known = spark.createDataFrame([(2, 1)], "a int, b int")
    assert {(r.a, r.b) for r in dedup.run(companies, contacts, known).collect()} == {(1, 3), (2, 3)}


def test_pairs_of_vectors_like_brute_force(spark):
    """Block by block all pairs are found; by random projections at least nine in ten, and none that are not."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24))
    v = np.concatenate([centres + rng.standard_normal((40, 24)) * s for s in (0.2, 0.4, 0.6, 0.8)] + [np.zeros((1, 24))])
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    want = {(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(u[i] @ u.T >= 0.7) if i < j}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    for block in (2000, 17):
        got = {(r.a, r.b): r.similarity for r in dedup.similar_pairs(df, 0.7, block).collect()}
        assert set(got) == want and all(s == pytest.approx(u[a] @ u[b]) for (a, b), s in got.items())
        near = {(r.a, r.b) for r in dedup.nearest_pairs(df, 0.7, block=block).collect()}
        assert near <= want and len(near) >= 0.95 * len(want)
        three = {(r.a, r["rank"]): r.b for r in dedup.neighbours(df, 3, block).collect()}
        assert all([three[i, k] for k in (1, 2, 3)] == [int(j) for j in sorted(range(len(v)), key=lambda j: (-round(u[i] @ u[j], 9), j)) if j != i][:3] for i in range(0, 160, 7))
    assert dedup.nearest_pairs(df.limit(0), 0.7).count() == 0 and dedup.similar_pairs(df.limit(0), 0.7).count() == 0


def test_serving_pages(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    out = etl.run_full(t, as_of(), spark)
    total, page = serving.customer_list(out["customer_360"], out["interaction_detail"], serving.CustomerFilter(size=5, interaction_min=1), as_of())
    rows = page.collect()
    assert len(rows) == min(5, total.first().total) and [r.intent_score for r in rows] == sorted((r.intent_score for r in rows), reverse=True)
    top = serving.priority_contacts(out["contact_360"], as_of(), 1)
    assert top.count() == out["contact_360"].select("customer_name").distinct().count()


def test_stream_reads_what_is_new_once(spark, sf_dir, tmp_path):
    from tidewater.streaming import events

    src, sink, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.filter("event_id % 2 = 0").write.parquet(src)
    run = lambda: events.available_now(spark, src, e.schema, lambda s: s.select("event_id"), sink, mark)
    run()
    e.filter("event_id % 2 = 1").write.mode("append").parquet(src)
    run()
    run()
    got = spark.read.parquet(sink)
    assert got.count() == e.count() == got.distinct().count()
