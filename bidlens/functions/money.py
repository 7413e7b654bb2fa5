"""Money, in yuan: Chinese numerals, units and plausibility, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.text import WHITE

#: Chinese digits and units (fixed values).
DIGITS = {"零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"拾": 10, "佰": 100, "仟": 1000, "十": 10, "百": 100, "千": 1000}
NUMERALS = "[壹贰叁肆伍陆柒捌玖拾佰仟万亿零]"


def cn_yuan(c: Column) -> Column:
    """The value of a Chinese numeral, null for none or zero.

    A fold over the characters: ``num`` is the open digit, ``part`` the section below 万 or 亿,
    ``total`` what is closed.
    """
    digits = F.create_map(*(F.lit(x) for kv in DIGITS.items() for x in kv))
    units = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    chars = F.filter(F.split(F.regexp_replace(c, "[元整人民币]", ""), ""), lambda x: x != "")

    def state(total: Column, part: Column, num: Column) -> Column:
        return F.struct(total.cast("decimal(30,0)").alias("total"), part.cast("decimal(30,0)").alias("part"), num.cast("bigint").alias("num"))

    def step(acc: Column, ch: Column) -> Column:
        total, part, num = acc["total"], acc["part"], acc["num"]
        digit, unit = digits[ch], units[ch]
        close = F.when(ch == "万", F.lit(10_000)).when(ch == "亿", F.lit(100_000_000))
        open_digit = F.when((num == 0) & (unit == 10), F.lit(1)).otherwise(num)
        return (
            F.when(digit.isNotNull(), state(total, part, digit))
            .when(unit.isNotNull(), state(total, part + open_digit * unit, F.lit(0)))
            .when(close.isNotNull(), state(total + (part + num) * close, F.lit(0), F.lit(0)))
            .otherwise(acc)
        )

    value = F.aggregate(chars, state(F.lit(0), F.lit(0), F.lit(0)), step, lambda a: (a["total"] + a["part"] + a["num"]).cast("decimal(20,2)"))
    return F.when(value > 0, value)


def amount(value: Column, match: Column) -> Column:
    """struct(value, unit, normalized) of a captured amount inside its whole match; null where there is no amount."""
    numeral = F.regexp_replace(value, r"[^一-鿿元整]", "")
    shown = F.when(F.substring(numeral, -1, 1).isin("元", "整"), numeral).otherwise(F.concat(numeral, F.lit("元")))
    wan = (match.contains("万") & match.contains("元")) | match.rlike(r"(?U)\d[\d,.]+\s*万")
    unit = F.when(wan, F.lit("万元")).otherwise(F.lit("元"))
    number = F.regexp_extract(F.regexp_replace(value, "[,，]", ""), r"(\d+(?:\.\d{1,6})?)", 1)
    yuan = number.try_cast("decimal(30,6)") * F.when(wan, F.lit(10_000)).otherwise(F.lit(1))
    typed = lambda v, u, n: F.struct(v.alias("value"), u.alias("unit"), n.cast("decimal(20,2)").cast("string").alias("normalized"))
    return F.when(value.rlike(NUMERALS), F.when(F.length(numeral) >= 3, typed(shown, F.lit("元"), cn_yuan(numeral)))).otherwise(F.when(number != "", typed(F.concat(number, unit), unit, yuan)))


_NUMERALS, _NOT_NUMERAL, _YUAN = re.compile(NUMERALS), re.compile("[^一-鿿元整]"), str.maketrans("", "", "元整人民币")
_WAN, _NUMBER = re.compile(rf"\d[\d,.]+[{WHITE}]*万"), re.compile(r"([0-9]+)(?:\.([0-9]{1,6}))?")


def fold_yuan(numeral: str) -> int | None:
    """``cn_yuan`` of one text."""
    total = part = num = 0
    for ch in numeral.translate(_YUAN):
        if ch in DIGITS:
            num = DIGITS[ch]
        elif ch in UNITS:
            part, num = part + (1 if num == 0 and UNITS[ch] == 10 else num) * UNITS[ch], 0
        elif ch in "万亿":
            total, part, num = total + (part + num) * (10_000 if ch == "万" else 100_000_000), 0, 0
    value = total + part + num
    return value if 0 < value < 10**18 else None


def amount_of(value: str, match: str) -> tuple[str, str, str | None] | None:
    """``amount`` of one text: value, unit, normalized. Sums of more than 18 digits have no normalized value."""
    if _NUMERALS.search(value):
        numeral = _NOT_NUMERAL.sub("", value)
        if len(numeral) < 3:
            return None
        yuan = fold_yuan(numeral)
        return numeral if numeral[-1] in "元整" else numeral + "元", "元", None if yuan is None else f"{yuan}.00"
    m = _NUMBER.search(value.replace(",", "").replace("，", ""))
    if not m:
        return None
    wan = "万" in match and ("元" in match or _WAN.search(match) is not None)
    unit = "万元" if wan else "元"
    cents, rest = divmod(int(m[1].lstrip("0")[:25] + (m[2] or "").ljust(6, "0")) * (10_000 if wan else 1), 10_000)
    cents += rest >= 5_000
    return m[0] + unit, unit, f"{cents // 100}.{cents % 100:02d}" if cents < 10**20 else None


def parsed(value: Column, normalized: Column) -> Column:
    """The amount of a candidate: its normalised value, else its digits (times 10000 beside 万)."""
    digits = F.regexp_replace(value, r"[^\d.]", "").try_cast("double")
    return F.coalesce(normalized.try_cast("double"), F.when(value.contains("万"), digits * 10_000).otherwise(digits))


def plausible_amount(yuan: Column) -> Column:
    return yuan.between(1.0, 1e10)


def plausible_deposit(yuan: Column) -> Column:
    return yuan.between(1e3, 1e9)


def amount_score(yuan: Column) -> Column:
    return F.when(yuan.between(1_000, 1_000_000_000), 1.0).when(yuan.between(100, 10_000_000_000), 0.8).otherwise(0.3)


def deposit_score(yuan: Column) -> Column:
    return F.when(yuan.between(1_000, 10_000_000), 1.0).when(yuan.between(100, 100_000_000), 0.8).otherwise(0.3)
