"""Numerals, number classes and page selections as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
_DIGITS = dict(zip("零〇一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True)) | dict(zip("壹贰叁肆伍陆柒捌玖", range(1, 10), strict=True))
_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def is_roman(c: Column) -> Column:
    return (F.length(c) > 0) & F.upper(c).rlike(ROMAN)


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral: a smaller sign before a larger one counts down."""
    v = _map(_ROMAN)
    signs = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: v[x])
    turned = F.reverse(signs)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    fold = lambda a, x: F.struct(F.when(x < a["top"], a["sum"] - x).otherwise(a["sum"] + x).alias("sum"), F.greatest(a["top"], x).alias("top"))
    return F.aggregate(turned, start, fold, lambda a: a["sum"])


def chinese_value(c: Column) -> Column:
    """Value of a Chinese numeral below ten thousand, or of plain digits in a row; null for others."""
    d, u = _map(_DIGITS), _map(_UNITS)
    signs = F.filter(F.split(c, ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"), F.lit(False).alias("unit"), F.lit(True).alias("ok"), F.lit(0).alias("row"))
    def fold(a, x):
        digit, unit = d[x], u[x]
        return F.struct(
            F.when(unit.isNotNull(), a["sum"] + unit * F.when((a["digit"] == 0) & ~a["unit"], 1).otherwise(a["digit"])).otherwise(a["sum"]).alias("sum"),
            F.when(unit.isNotNull(), 0).otherwise(F.coalesce(digit, F.lit(0))).alias("digit"),
            (a["unit"] | unit.isNotNull()).alias("unit"),
            (a["ok"] & (digit.isNotNull() | unit.isNotNull())).alias("ok"),
            F.when(digit.isNotNull(), a["row"] * 10 + digit).otherwise(a["row"]).alias("row"),
        )
    return F.aggregate(signs, start, fold, lambda a: F.when(a["ok"] & (F.size(signs) > 0), F.when(a["unit"], a["sum"] + a["digit"]).otherwise(a["row"])))


def alpha_value(c: Column) -> Column:
    """a is 1, z 26, aa 27; letters that differ give -1."""
    low = F.lower(c)
    same = F.length(F.replace(low, F.substring(low, 1, 1), F.lit(""))) == 0
    return F.when(~low.rlike("^[a-z]+$"), None).when(same, F.ascii(low) - 96 + 26 * (F.length(low) - 1)).otherwise(-1)


def symbol_value(c: Column) -> Column:
    """Circled and bracketed numbers 1..20."""
    code = F.ascii(c)
    return F.when(code.between(0x2460, 0x2473), code - 0x2460 + 1).when(code.between(0x2474, 0x2487), code - 0x2474 + 1)


def section_number(c: Column) -> Column:
    """(text, parts, level, value) of a heading's leading dotted number, null without one."""
    text = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)*)", 1)
    parts = F.split(text, r"\.")
    return F.when(text != "", F.struct(text.alias("text"), parts.alias("parts"), F.size(parts).alias("level"), F.element_at(parts, -1).cast("int").alias("value")))


def dotted_level(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1


CELL_TYPES: list[tuple[str, str]] = [
    ("percent", r"^[-+]?\d+(\.\d+)?%$"),
    ("decimal2", r"^[-+]?(\d{1,3}(,\d{3})+|\d+)\.\d{2}$"),
    ("decimal1", r"^[-+]?(\d{1,3}(,\d{3})+|\d+)\.\d$"),
    ("decimal", r"^[-+]?(\d{1,3}(,\d{3})+|\d+)\.\d+$"),
    ("grouped", r"^[-+]?\d{1,3}(,\d{3})+$"),
    ("date", r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"),
    ("month", r"^\d{4}[-/.]\d{1,2}$"),
    ("year", r"^(19|20)\d{2}$"),
    ("integer", r"^[-+]?\d+$"),
    ("dash", r"^[-–—]+$"),
]

NUMBER_STYLES: list[tuple[str, str, int]] = [
    ("chapter", r"^(?i)(chapter|part|section)\s+\w+", 0),
    ("cn_chapter", "^第[一二三四五六七八九十百零0-9]+[章节篇]", 0),
    ("cn_comma", "^[一二三四五六七八九十]+、", 1),
    ("cn_paren", "^[(（][一二三四五六七八九十]+[)）]", 2),
    ("dotted4", r"^\d+\.\d+\.\d+\.\d+", 6),
    ("dotted3", r"^\d+\.\d+\.\d+", 5),
    ("dotted2", r"^\d+\.\d+", 4),
    ("arabic", r"^\d+[.、]?(\s|$)", 3),
    ("paren", r"^[(（]\d+[)）]", 4),
    ("half_paren", r"^\d+[)）]", 5),
    ("circled", "^[①-⑳]", 6),
    ("roman", r"^[IVXLC]+[.、]", 1),
    ("alpha", r"^[A-Za-z][.)]", 6),
]


def style_rank(key: Column) -> Column:
    return F.coalesce(_map({k: r for k, _, r in NUMBER_STYLES})[key], F.lit(10))


def page_numbers(c: Column) -> Column:
    """Sorted distinct pages of a selection such as ``1-3,5``."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    lo = lambda p: F.split(p, "-")[0].cast("int")
    ranges = F.transform(parts, lambda p: F.sequence(lo(p), F.coalesce(F.get(F.split(p, "-"), F.lit(1)).cast("int"), lo(p))))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def priority(pages: Column, tiers: Sequence[tuple[int, int]] = ((500, 3), (100, 2), (20, 1))) -> Column:
    """The first tier whose least number of pages is reached, else 0."""
    out = F.lit(0)
    for least, tier in sorted(tiers):
        out = F.when(pages >= least, tier).otherwise(out)
    return out


#: English Metric Units in one of each.
EMU = {"emu": 1, "twip": 635, "half_point": 6350, "px": 9525, "pt": 12700, "mm": 36000, "cm": 360000, "inch": 914400}


def convert_length(c: Column, unit: str, to: str) -> Column:
    return c * (EMU[unit] / EMU[to])


_CN = "〇一二三四五六七八九十零百千"
#: Families of section numbers, and the level of each; fixed values. A chapter's key has its unit.
NUMBER_FAMILIES: list[tuple[str, str]] = [
    ("number.dotted", r"\d+(?:\.\d+)+\.?"),
    ("number、", r"\d+、"),
    ("number.", r"\d+\."),
    ("chinese、", f"[{_CN}]+、"),
    ("chinese.", rf"[{_CN}]+\."),
    ("paren.number", r"\([0-9]+\)"),
    ("paren.chinese", rf"\([{_CN}]+\)"),
    ("paren.alpha", r"\([A-Za-z]\)"),
    ("circled.number", "[\u2460-\u2473]"),
    ("paren.circled.number", "[\u2474-\u2487]"),
    ("roman.", r"(?i:I{1,3}|IV|VI{0,3}|IX|XI{0,3}|XIV|XV|XVI{0,3}|XIX|XX)[.、]"),
    ("alpha.", r"[A-Za-z][.、]"),
]
FAMILY_LEVELS = {
    "第#篇": 1, "第#部分": 1, "第#章节": 1, "第#章": 1, "第#部": 1, "第#节": 2, "第#条": 2, "第#款": 2, "第#项": 2, "chinese、": 2, "chinese.": 2, "roman.": 2,
    "paren.chinese": 3, "number.dotted": 4, "number.": 4, "number、": 4, "paren.number": 5, "circled.number": 5, "paren.circled.number": 5, "alpha.": 6, "paren.alpha": 6,
}
CHAPTER = f"^第[0-9{_CN}]+(部分|章节|章|节|篇|部|条|款|项)$"


def number_family(number: Column) -> Column:
    """The family that a heading's number belongs to; a number of none is a family of its own. (NUM-13)

    ``number`` is half-width and without white space.
    """
    out = number
    for name, pattern in reversed(NUMBER_FAMILIES):
        out = F.when(number.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    unit = F.regexp_extract(number, CHAPTER, 1)
    return F.when(unit != "", F.concat(F.lit("第#"), unit)).otherwise(out)


def family_level(family: Column) -> Column:
    """Level of a family: 1 for chapters to 6 for letters, 10 for others; 0 without a number. (NUM-14)"""
    return F.when(family.isNull(), 0).otherwise(F.coalesce(_map(FAMILY_LEVELS)[family], F.lit(10)))


def korean_value(c: Column) -> Column:
    """Value of a Korean numeral up to 19; 0 for others. (NUM-03)"""
    digits = _map({k: i for i, k in enumerate("일이삼사오육칠팔구십", 1)})
    t = F.trim(c)
    rest = F.coalesce(digits[F.substring(t, F.lit(2), F.length(t))], F.lit(0))
    return F.coalesce(digits[t], F.when(t.startswith("십"), 10 + rest).otherwise(0))


#: Rules of numbers that begin a text, in order: name, pattern with the number as its first group, how it is read.
NUMBER_RULES: list[tuple[str, str, str]] = [
    ("chapter", f"^第([{_CN}]+)[章节篇条款项]", "chinese"),
    ("chapter_number", "^第([0-9]+)[章节篇条款项]", "number"),
    ("dotted", r"^((?:[0-9]+\.)+[0-9]+)", "last"),
    ("number", r"^([0-9]+)[.、)]", "number"),
    ("chinese", f"^([{_CN}]+)[、.]", "chinese"),
    ("bracketed", r"^[(（]([0-9]+)[)）]", "number"),
    ("bracketed_chinese", f"^[(（]([{_CN}]+)[)）]", "chinese"),
    ("circled", "^([\u2460-\u2487])", "symbol"),
    ("alpha", r"^([A-Za-z])[.)]", "alpha"),
]


def number_prefix(c: Column, rules: Sequence[tuple[str, str, str]] = tuple(NUMBER_RULES)) -> Column:
    """(prefix, value, rule) of the first rule that fits the beginning of a text, else null. (NUM-05)"""
    read = {"chinese": chinese_value, "number": lambda x: x.cast("int"), "last": lambda x: F.element_at(F.split(x, r"\."), -1).cast("int"), "symbol": symbol_value, "alpha": alpha_value}
    out = F.lit(None)
    for name, pattern, kind in reversed(rules):
        found = F.struct(F.regexp_extract(c, pattern, 0).alias("prefix"), read[kind](F.regexp_extract(c, pattern, 1)).cast("int").alias("value"), F.lit(name).alias("rule"))
        out = F.when(c.rlike(pattern), found).otherwise(out)
    return out


def as_roman(c: Column) -> Column:
    """Value of a number whose last part may be read as a Roman numeral, else null. (NUM-25)"""
    last = F.element_at(F.split(c, r"\."), -1)
    return F.when(is_roman(last), roman_value(last))


def setting(c: Column, kind: str, default) -> Column:
    """A text as a value of a type; the default where it is null or can't be read. (NUM-19)"""
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))
