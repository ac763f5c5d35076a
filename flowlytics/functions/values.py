"""Value normalisation: words, numbers, signs, hashes and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a purchase, a redemption and a success.
PURCHASE_WORDS = [
    "purchase", "buy", "subscribe", "sub", "inflow", "in",
    "申购", "购买", "申请", "买入", "申",
]
REDEMPTION_WORDS = ["redemption", "redeem", "sell", "outflow", "out", "赎回", "卖出", "赎"]
SUCCESS_WORDS = [
    "success", "succeeded", "successful", "ok", "1", "done",
    "成功", "确认成功", "已确认", "完成",
]

# Code names used in behaviour tokens.
DIRECTION_NAMES = {0: "PUR", 1: "RED"}
RISK_NAMES = {1: "R1", 2: "R2", 3: "R3", 4: "R4", 5: "R5"}
TYPE_NAMES = {0: "MM", 1: "BOND", 2: "EQUITY", 3: "MIX", 4: "FIXEDPLUS", 5: "OTHER"}
CHANNEL_NAMES = {0: "APP", 1: "WEB", 2: "BR", 3: "3RD"}

# Fund-name patterns with product type and risk level, first match wins.
FUND_NAME_RULES = [
    ("货币|现金|钱包", 0, 1),
    ("债|信用|利率", 1, 2),
    ("红利|价值| Berk", 4, 4),
    ("混合|灵活|配置|平衡", 3, 4),
    ("50ETF|300|500|800|1000|宽基|综合|A50|创业|科创|上证|深证|中证", 2, 4),
    ("芯片|半导体|新能源|光伏|电池|医药|医疗|生科|军工|国防|消费|食品|白酒"
     "|科技|计算机|电子|人工智能|AI|机器人|5G|通信|传媒|游戏|金融|券商|银行"
     "|地产|基建|有色|煤炭|钢铁|化工|环保|光伏|车|制造|机械|电力", 2, 5),
    ("黄金|白银|原油|商品|资源的|豆粕|有色", 5, 5),
    ("美国|纳斯达克|纳指|标普|日经|德国|法国|恒生|港股|海外|跨境|QDII", 6, 5),
]
FUND_NAME_FALLBACK = (2, 4)

# Yearly base yield by risk level.
BASE_YIELD = {1: 0.022, 2: 0.030, 3: 0.050, 4: 0.080, 5: 0.120}
FLAT_BASE_YIELD = 0.03

MAX_GAP_SECONDS = 30 * 86400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_direction(raw: Column | str) -> Column:
    """Words or numbers to 0 purchase / 1 redemption, -1 for anything else, null kept."""
    text = F.trim(_col(raw).cast("string"))
    word = F.lower(text)
    number = text.try_cast("double").try_cast("int")
    return (
        F.when(text.isNull(), F.lit(None).cast("int"))
        .when(word.isin(PURCHASE_WORDS), 0)
        .when(word.isin(REDEMPTION_WORDS), 1)
        .when(number.isin(0, 1), number)
        .otherwise(-1)
    )


def success_word(raw: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(raw).cast("string"))).isin(SUCCESS_WORDS), F.lit(False))


def success_number(raw: Column | str) -> Column:
    """Numeric reading of a status: whole part equal to 1."""
    number = F.trim(_col(raw).cast("string")).try_cast("double")
    return F.coalesce(number.try_cast("int") == 1, F.lit(False))


def to_number(raw: Column | str, default: float | None = None) -> Column:
    """Dirty text to double; what does not parse becomes null or the default."""
    number = F.trim(_col(raw).cast("string")).try_cast("double")
    number = F.when(F.isnan(number), None).otherwise(number)
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def direction_from_quantity(quantity: Column | str) -> Column:
    return F.when(_col(quantity) >= 0, 0).otherwise(1)


def direction_from_prices(open_: Column | str, close: Column | str) -> Column:
    """A day that does not close below its open counts as inflow; an unknown price does not."""
    return F.when(_col(close) >= _col(open_), 0).otherwise(1)


def direction_from_net(net: Column | str) -> Column:
    return F.when(_col(net) < 0, 1).otherwise(0)


def status_from_prefix(identifier: Column | str, prefix: str = "C") -> Column:
    return F.when(_col(identifier).cast("string").startswith(prefix), 0).otherwise(1)


def intraday_yield(open_: Column | str, close: Column | str) -> Column:
    o = _col(open_)
    return F.when(o > 0, (_col(close) - o) / o)


def log_amount(amount: Column | str, digits: int | None = 9) -> Column:
    """log1p of the amount floored at zero, rounded so bucket edges do not hang on the last ulp."""
    value = F.log1p(F.greatest(_col(amount).cast("double"), F.lit(0.0)))
    return value if digits is None else F.round(value, digits)


def winsorise(col: Column | str, lo=None, hi=None) -> Column:
    """Clamp to [lo, hi]; null stays null (least/greatest alone would skip it)."""
    c = _col(col)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def hash_bucket(key: Column | str, n: int, salt: str = "") -> Column:
    """Stable salted bucket: leading 32 bits of md5('salt:key') modulo n."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), _col(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n).cast("int")


def placeholder_yield(key: Column | str, risk: Column | str | None = None) -> Column:
    """Base yield of the risk level (or the flat base) plus a stable per-key offset."""
    shift = (hash_bucket(key, 200, "y") - 100) / F.lit(2000.0)
    if risk is None:
        return F.lit(FLAT_BASE_YIELD) + shift
    return lookup(_col(risk), BASE_YIELD) + shift


def lookup(code: Column, table: Mapping) -> Column:
    """Literal code table; unknown codes give null."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), code)


def label_of(code: Column | str, names: Mapping[int, str], unknown: str = "UNK") -> Column:
    return F.coalesce(lookup(_col(code).cast("int"), names), F.lit(unknown))


def classify(
    name: Column | str,
    rules: Sequence[tuple[str, int, int]] = FUND_NAME_RULES,
    fallback: tuple[int, int] = FUND_NAME_FALLBACK,
) -> Column:
    """First matching pattern gives struct(type, risk)."""
    def pair(t: int, r: int) -> Column:
        return F.struct(F.lit(t).alias("type"), F.lit(r).alias("risk"))

    out = None
    for pattern, type_id, risk in rules:
        hit = _col(name).rlike(pattern)
        out = F.when(hit, pair(type_id, risk)) if out is None else out.when(hit, pair(type_id, risk))
    return pair(*fallback) if out is None else out.otherwise(pair(*fallback))


def investor_kind(main_net: Column | str) -> Column:
    """1 where the main-force net inflow is positive, else 0 (unknown counts as 0)."""
    return F.when(to_number(main_net) > 0, 1).otherwise(0)


def is_six_digits(code: Column | str) -> Column:
    return _col(code).rlike(r"^\d{6}$")


def share(condition: Column) -> Column:
    """Aggregate: part of the rows for which the condition holds (null counts as no)."""
    return F.avg(F.when(condition, 1).otherwise(0))


def mean(col: Column | str) -> Column:
    """Aggregate mean as exact sum over count, so decimal input keeps its digits."""
    return F.sum(_col(col)).cast("double") / F.count(_col(col))
