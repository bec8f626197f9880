"""Names, phones, channels, regions, roles and other texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------
#: Removed anywhere in a company name, in this order.
CHINESE_TERMS = (
    "有限公司", "股份有限公司", "有限责任公司", "集团", "控股", "科技", "技术", "实业", "投资", "贸易", "发展", "实业", "股份", "责任", "公司",
    "集团有限公司", "控股集团", "科技有限公司", "技术有限公司", "实业有限公司", "投资有限公司", "贸易有限公司", "发展有限公司",
)
#: Removed as whole words.
ENGLISH_TERMS = (
    "co", "inc", "ltd", "llc", "corp", "corporation", "company", "limited", "gmbh", "sa", "ag", "group", "holdings", "holding",
    "technologies", "tech", "systems", "solutions", "international", "intl",
)
#: Regions in business order; the last stands for all others.
REGIONS = (
    "广东", "天津", "黑吉", "山东", "浙江", "上海", "湖南", "河南", "安徽", "福建", "湖北", "广西", "辽宁", "深圳",
    "甘青宁", "北京", "贵州", "川藏", "蒙晋", "陕西", "河北", "江苏", "云南", "江西", "重庆", "新疆", "其他",
)
OTHER_REGION = "其他"
REGION_SUFFIX = "区域"
#: Channel codes in business order with the stored values that mean them.
CHANNELS = {"email": ("email", "邮件"), "web": ("web", "官网"), "event": ("event", "直播/活动"), "wechat": ("wechat", "微信")}
OTHER_CHANNEL = "other"
NO_CHANNEL = "无渠道/未触达"
ROLES = {"拍板者": "决策者", "决策者": "决策者", "评估者": "技术评估者", "使用者": "使用者", "其他": "其他", "未知": "未知"}
UNKNOWN_ROLE = "未知"
BEHAVIOUR_CHANNELS = {
    "打开邮件": "email", "点击邮件链接": "email", "报名会议": "event", "参会": "event", "观看直播": "event",
    "下载资料": "web", "单页面表单提交": "web", "访问落地页": "web",
}
SESSION_CHANNELS = {"网页": "web", "企微客服": "wechat", "百度营销": "web"}
#: What users call a channel, in order of the search, which tells upper and lower case apart.
CHANNEL_WORDS = {
    "email": ("email", "邮件", "邮箱", "e-mail", "e_mail", "E-mail", "Email", "EMAIL", "E-MAIL"),
    "web": ("web", "官网", "网站", "网页", "WEB", "Web", "线上官网", "网页端", "互联网", "website"),
    "wechat": ("wechat", "微信", "qq", "QQ", "钉钉", "im", "IM", "聊天", "社交", "即时通讯", "企微", "企业微信", "WeChat"),
    "event": ("event", "活动", "线下", "展会", "沙龙", "研讨会", "会议", "峰会", "路演", "培训会", "线下活动"),
}
#: Roles of a buying centre, each with what its texts contain; asked in this order.
KEY_ROLES = {"拍板者": ("拍板",), "决策者": ("决策",), "评估者": ("评估", "技术"), "采购推动者": ("采购", "推动")}
ALL_ROLES = "全"
#: Why an opportunity was lost, by the first pattern that its reason contains; no reason, and any other one.
LOSS_REASONS = (("预算", "预算不足"), ("价|报价|价格", "价格竞争"), ("竞品|友商|竞争", "竞品影响"), ("关键|联系人|决策", "关键人缺失"), ("渠道|代理", "渠道问题"), ("流标|废标|招标", "流标 / 废标"))
NO_REASON, OTHER_REASON = "—", "其他"
#: Stages that mean that an opportunity was won.
WON = ("成交", "赢单", "100%")
COLLOQUIAL = (
    ("帮我找", "查找"), ("帮我看", "查询"), ("帮我看看", "查询"), ("我想找", "查找"), ("我要找", "查找"), ("有没有", "是否存在"),
    ("有哪些", "列出"), ("是多少", "的数值"), ("怎么样", "的情况"), ("如何", "怎样"), ("为啥", "为什么"), ("咋", "怎么"),
)
PRONOUNS = ("它", "他们", "这些", "那些", "这个", "那个")
OPENED = "打开|浏览|触达|PAGE_VIEW"
CLICKED = "点击|下载|提交|咨询|报名|留资|click_"
STAGE_LABELS = {
    "阶段0：未接触上客户": "未接触", "阶段1：接触上客户，初步交流；": "问题识别", "阶段2：正式交流，价值认可": "解决方案探索", "阶段3：测试/入围，愿意尝试": "解决方案探索",
    "阶段4：拿到门票，进入招投标": "需求构建", "阶段5：已中标，等待采购": "需求构建", "阶段6：完成采购，实现进入": "已完成",
}
FORECAST_LABELS = {
    "线索": "问题识别", "机会-": "问题识别", "机会": "问题识别", "机会+": "解决方案探索", "可能-": "解决方案探索", "可能": "需求构建", "可能+": "需求构建", "优势": "需求构建", "确保": "需求构建",
}
CHANNEL_LABELS = {"email": "邮件", "web": "官网", "event": "直播/活动", "wechat": "微信"}
STAGE_TEXTS = (
    ("阶段1", "问题识别", "初步接触阶段"), ("阶段2", None, "价值确认阶段"), ("阶段3", "解决方案探索", "方案评估阶段"),
    ("阶段4", None, "招投标准备阶段"), ("阶段5", "需求构建", "采购确认阶段"), ("阶段6", "已完成", "采购落地阶段"),
)
# ---------------------------------------------------------------------------------------------------------


def filled(c: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def is_filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def collation_key(c: Column) -> Column:
    """A binary key that is equal where the texts differ only by case, common accents or full width, so joins and
    groups on it keep hash operators. Loads follow the whole collation by sources.names."""
    full = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    half = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F))
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"
    return F.translate(F.lower(F.translate(c, full, half)), accents, plain)


def normalize_name(name: Column) -> Column:
    """A company name without punctuation, legal forms and common terms; empty for null."""
    out = F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"(?U)[^\w\s一-鿿]", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    for term in CHINESE_TERMS:
        out = F.replace(out, F.lit(term), F.lit(""))
    out = F.regexp_replace(out, rf"(?U)\b(?:{'|'.join(ENGLISH_TERMS)})\b", "")  # whole words, so no term makes another one
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def pick(c: Column, values: dict[str, str], default: Column | str | None) -> Column:
    """The value of values for c, or default."""
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(F.lit(default) if isinstance(default, str) or default is None else default)


def normalize_channel(c: Column) -> Column:
    """The channel code of a stored value."""
    t = filled(c)
    out = F.when(t.isNull(), NO_CHANNEL)
    for code, names in CHANNELS.items():
        out = out.when(t.isin(*names), code)
    return out.otherwise(OTHER_CHANNEL)


def channel_of_words(c: Column) -> Column:
    """The channel code of a user's word for it: the lower-case word, else, of the word as it stands, the first word of the
    list that contains it or that it contains, else the word itself."""
    low = F.lower(F.trim(c))
    exact = loose = None
    for code, words in CHANNEL_WORDS.items():
        exact = F.when(low.isin(*words), code) if exact is None else exact.when(low.isin(*words), code)
        near = reduce(lambda a, b: a | b, [c.contains(w) | F.lit(w).contains(c) for w in words])
        loose = F.when(near, code) if loose is None else loose.when(near, code)
    return F.coalesce(exact, loose, c)


def normalize_region(c: Column) -> Column:
    """The region option of a stored value: the option with or without the suffix, else the others; null if empty."""
    t = filled(c)
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    for r in REGIONS[:-1]:
        out = out.when(t.isin(r, r + REGION_SUFFIX), r)
    return out.otherwise(OTHER_REGION)


def role_category(c: Column) -> Column:
    return pick(c, ROLES, UNKNOWN_ROLE)


def clean_phone(c: Column) -> Column:
    """Digits of a phone without white space; a number that was read as a decimal loses its fraction."""
    t = F.regexp_replace(F.trim(c), r"\s+", "")
    return F.nullif(F.regexp_replace(t, r"^(\d+)\.0+$", "$1"), F.lit(""))


def clean_int(c: Column) -> Column:
    return c.try_cast("double").try_cast("int")


def clean_decimal(c: Column) -> Column:
    return c.try_cast("double")


def clean_flag(c: Column) -> Column:
    """1 for yes, 0 for no, else the number it is or null."""
    t = F.trim(c)
    return F.when(t.isin("是", "Y", "y", "1"), 1).when(t.isin("否", "N", "n", "0"), 0).otherwise(t.try_cast("int"))


def clean_date(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.lower(t).isin("nan", ""), None).otherwise(t.try_cast("date"))


def content_hash_id(*cols: Column) -> Column:
    """A stable id of a row's content: the first 60 bits of the MD5 of its values joined by `|`, nulls skipped."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def from_jsonish(c: Column) -> Column:
    """The items of a bracketed, quoted, comma-separated list; empty for null, `null` and `[]`."""
    inner = F.regexp_replace(F.trim(c), r"^\[+|\]+$", "")
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.trim(c), F.lit("")).isin("", "null", "[]"), none).otherwise(F.filter(items, lambda x: x != ""))


def customer_tags(campaign: Column, attribute: Column, industry: Column, stage: Column, products: Column, sources: Column) -> Column:
    """Campaign, attribute, industry, stage, at most two products and one source; empty ones left out."""
    first = F.array(campaign, F.concat(F.nullif(attribute, F.lit("")), F.lit("层")), industry, stage)
    return F.filter(F.concat(first, F.slice(products, 1, 2), F.slice(sources, 1, 1)), lambda x: x.isNotNull() & (x != ""))


def followup_basis(last_time: Column, last_channel: Column, open_amount: Column, total: Column) -> Column:
    """Why to follow up: the last channel, else open amounts, else old interactions, else none."""
    channel = F.coalesce(F.nullif(last_channel, F.lit("")), F.lit("未知渠道"))
    return (
        F.when(last_time.isNotNull(), F.concat(F.lit("最近通过"), channel, F.lit("互动，建议结合内容兴趣跟进。")))
        .when(open_amount != 0, "存在在途商机金额，建议补充关键角色触达。")
        .when(total != 0, "已有历史互动，建议按最近主题继续推进。")
        .otherwise("暂无互动记录，建议先补充触达。")
    )


def stage_text(stage: Column) -> Column:
    """A stage in words for a conversation."""
    s = F.coalesce(stage, F.lit(""))
    out = None
    for code, name, words in STAGE_TEXTS:
        hit = s.contains(code) | (s == name if name else F.lit(False))
        out = F.when(hit, words) if out is None else out.when(hit, words)
    return out.when(s.isin("", "当前阶段"), "当前推进阶段").otherwise(s)


def stage_label(stage: Column) -> Column:
    """The short name of a stage of the pipeline; others stay."""
    return pick(stage, STAGE_LABELS, stage)


def forecast_label(forecast: Column) -> Column:
    """The stage that a forecast stands for; others stay."""
    return pick(forecast, FORECAST_LABELS, forecast)


def first_meaningful(*cols: Column, default: str) -> Column:
    return F.coalesce(*[filled(c) for c in cols], F.lit(default))


def preprocess_question(text: Column, previous: Column) -> Column:
    """A question with single blanks, without odd characters, in formal words; a leading pronoun refers to the
    previous question."""
    out = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    out = F.regexp_replace(out, r"(?U)[^\w\s一-鿿，。！？、；：\"'（）]", "")
    for said, meant in COLLOQUIAL:
        out = F.replace(out, F.lit(said), F.lit(meant))
    pattern = f"^({'|'.join(PRONOUNS)})\\s*"
    rest = F.regexp_replace(out, f"^({'|'.join(PRONOUNS)})", "")
    return F.when(previous.isNotNull() & out.rlike(pattern), F.concat(previous, F.lit("的"), F.regexp_extract(out, pattern, 1), rest)).otherwise(out)


def opened(behaviour: Column, content: Column) -> Column:
    return F.concat_ws(" ", behaviour, content).rlike(f"(?i){OPENED}")


def clicked(behaviour: Column, content: Column) -> Column:
    return F.concat_ws(" ", behaviour, content).rlike(f"(?i){CLICKED}")


def key_role(role: Column) -> Column:
    """The buying-centre role that a role text names, if any."""
    out = None
    for name, words in KEY_ROLES.items():
        hit = reduce(lambda a, b: a | b, [role.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def missing_roles(texts: Column, key_roles: Column) -> Column:
    """Of an array of role texts, the buying-centre roles that none names; none is missing where no text names one and
    the customer's own coverage says that all are there."""
    covered = F.array_compact(F.array_distinct(F.transform(texts, key_role)))
    every = F.array(*map(F.lit, KEY_ROLES))
    all_there = (F.size(covered) == 0) & F.coalesce(key_roles == ALL_ROLES, F.lit(False))
    return F.when(all_there, F.array().cast("array<string>")).otherwise(F.array_except(every, covered))


def loss_reason(reason: Column) -> Column:
    """The class of the reason why an opportunity was lost."""
    out = F.when(filled(reason).isNull(), NO_REASON)
    for pattern, name in LOSS_REASONS:
        out = out.when(reason.rlike(pattern), name)
    return out.otherwise(OTHER_REASON)


def is_won(order_amount: Column, win_rate: Column, *stages: Column) -> Column:
    """An order amount, a win rate of 100, or a label of success in the first of the stages that is not empty."""
    label = F.coalesce(*[F.nullif(s, F.lit("")) for s in stages], win_rate.cast("string"), F.lit(""))
    return (F.coalesce(order_amount, F.lit(0)) > 0) | (F.coalesce(win_rate, F.lit(0)) >= 100) | label.isin(*WON)


def number_in_stage(stage: Column) -> Column:
    """The number of a stage for sorting; null for stages without one, which come behind."""
    return F.nullif(F.regexp_extract(stage, r"阶段(\d+)", 1), F.lit("")).cast("int")
