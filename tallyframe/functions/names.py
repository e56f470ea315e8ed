"""Rules that read only a column's name."""

from __future__ import annotations

import re

# ---- fixed values: name hints that decide a column's kind -------------------------------------
STRICT_ID_HINTS = (
    "编号", "工号", "订单号", "流水号", "客户号", "用户号", "销售工号", "客户id", "用户id", "销售id",
    "customer_id", "user_id", "employee_id", "order_id",
)
STRICT_MEASURE_HINTS = (
    "金额", "价格", "单价", "数量", "人数", "比例", "比率", "成本", "利润", "收入", "销量",
    "amount", "price", "quantity", "count", "rate", "revenue", "cost", "profit",
)
WIDE_ID_HINTS = (
    "id", "编号", "编码", "工号", "订单号", "单号", "流水号", "客户号", "用户号", "销售工号",
    "customer_id", "user_id", "employee_id", "order_id",
)
WIDE_MEASURE_HINTS = (
    "销售额", "数量", "金额", "单价", "成本", "利润", "折扣", "收入", "价格",
    "amount", "price", "quantity", "revenue", "cost", "profit", "成交金额", "客单价",
)
IQR_ID_HINTS = (
    "id", "工号", "编号", "编码", "代码", "单号", "订单号", "客户号", "用户id", "手机号", "phone", "mobile", "tel",
)
DATE_NAME_HINTS = ("date", "time", "日期", "时间")
DETECT_DATE_NAME_HINTS = DATE_NAME_HINTS + ("年月",)
MAP_DATE_HINTS = ("date", "time", "日期", "时间", "成交日期", "订单日期", "创建时间", "支付时间")
MAP_AMOUNT_HINTS = (
    "amount", "gmv", "revenue", "sales", "price", "fee", "cost", "金额", "销售额", "成交金额", "实付金额", "客单价",
    "价格", "费用", "成本",
)
MAP_QUANTITY_HINTS = ("count", "qty", "quantity", "num", "数量", "人数", "客户数", "订单数", "成交客户数")
MAP_ID_HINTS = ("id", "编号", "工号", "订单号", "用户号", "客户号", "商品号")
MAP_PRODUCT_HINTS = ("product", "sku", "商品", "产品", "品类", "类别")
MAP_REGION_HINTS = ("region", "province", "city", "area", "地区", "区域", "省份", "城市")
MAP_PERSON_HINTS = ("sales", "staff", "employee", "person", "销售", "员工", "人员", "顾问")
QUANTITY_WORDS_ZH = (
    "数量", "人数", "客户数", "订单数", "件数", "销量", "次数", "访问数", "库存数", "成交数", "交易数", "投诉数", "退款数",
)
QUANTITY_WORDS_EN = {
    "count", "quantity", "qty", "units", "volume", "visits", "customers", "orders", "transactions",
}
RATE_WORDS_ZH = (
    "转化率", "退款率", "占比", "比例", "增长率", "百分比", "客单价", "单价", "均价", "平均", "人均",
)
RATE_WORDS_EN = {"percentage", "percent", "pct", "ratio", "rate", "share", "average", "avg", "mean", "price"}
ID_WORDS_ZH = ("工号", "编号", "编码")
ID_WORDS_EN = {"id", "code", "key"}
TIME_WORDS_ZH = ("年", "年份", "月", "月份", "季度", "星期", "周几", "日期")
TIME_WORDS_EN = {"year", "month", "quarter", "weekday", "week_day", "date"}
UNIT_PRICE_NAMES = (
    "客单价", "单价", "均价", "平均订单金额", "aov", "average order value", "unit price", "average price",
)
TIME_PART_NAMES = {
    "year": ("年", "年份", "year"),
    "month": ("月", "月份", "month"),
    "quarter": ("季度", "quarter"),
    "weekday": ("星期", "周几", "weekday", "week_day"),
}
ORDER_COUNT_WORDS = ("订单", "order")
CUSTOMER_COUNT_WORDS = ("客户", "用户", "customer", "user")
STAFF_COUNT_WORDS = ("销售", "员工", "人员", "staff", "employee", "salesperson", "sales_id")
# ---- end of fixed values ----------------------------------------------------------------------


def has_hint(name: str, hints) -> bool:
    low = str(name).strip().lower()
    return any(h in low for h in hints)


def is_strict_id_name(name: str) -> bool:
    low = str(name).strip().lower()
    return low == "id" or low.endswith("_id") or has_hint(low, STRICT_ID_HINTS)


def is_unnamed(name: str) -> bool:
    return str(name).strip().lower().startswith("unnamed:")


def squeeze(name: str) -> str:
    """Letters and digits only, for comparing column names."""
    return re.sub(r"[^0-9a-z一-鿿]+", "", str(name).strip().lower())


def word_set(name: str) -> set[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", str(name))
    return set(re.findall(r"[a-z0-9]+", spaced.casefold()))


def _joined(name: str) -> str:
    return re.sub(r"[\s_\-]+", "", str(name).strip().casefold())


def is_unit_price(name: str) -> bool:
    return any(_joined(name).endswith(_joined(known)) for known in UNIT_PRICE_NAMES)


def is_additive_quantity(name: str) -> bool:
    """Says a quantity and nothing that makes a sum meaningless (rate, price, id, time part)."""
    joined, words = _joined(name), word_set(name)
    blocked = has_hint(joined, RATE_WORDS_ZH + ID_WORDS_ZH) or words & (RATE_WORDS_EN | ID_WORDS_EN)
    wanted = has_hint(joined, QUANTITY_WORDS_ZH) or words & QUANTITY_WORDS_EN
    only_time = joined in TIME_WORDS_ZH or (words and words <= TIME_WORDS_EN)
    return bool(joined and wanted and not blocked and not only_time)


def time_part_of(name: str) -> str | None:
    """year / month / quarter / weekday when the name is, or ends in, such a word."""
    low = re.sub(r"_+", "_", re.sub(r"[\s\-]", "_", str(name).strip().lower()))
    best = None
    for part, words in TIME_PART_NAMES.items():
        for word in words:
            ascii_word = word.isascii()
            hit = low == word or low.endswith(f"_{word}" if ascii_word else word)
            if hit and (best is None or len(word) > best[1]):
                best = (part, len(word))
    return best[0] if best else None


def count_metric_name(field: str) -> str:
    if has_hint(field, ORDER_COUNT_WORDS):
        return "order_count"
    if has_hint(field, CUSTOMER_COUNT_WORDS):
        return "customer_count"
    if has_hint(field, STAFF_COUNT_WORDS):
        return "staff_count"
    return f"{field}_distinct"


def table_suffix(table: str) -> str:
    return re.sub(r"[^0-9a-zA-Z一-鿿]+", "_", str(table)).strip("_") or "right"
