"""Text normalisation, Markdown escapes and ordered pattern sets as column expressions.

Java's classes are ASCII; where Unicode white space is meant, patterns begin with ``(?U)``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: Headings that a paragraph never joins, and lines that are a sentence of their own.
CHAPTER_LINE = r"^(\(?[0-9]+[.)、]|[（(][一二三四五六七八九十]+[)）]|[A-Z][A-Z ]{3,40}$)"
SENTENCE_LINE = "^[^。！？!?]{1,40}[。！？!?]$"
ESCAPED = r"([\\`*_{}\[\]#+\-.!|>~])"
_ROMAN = {chr(0x2160 + i): s for i, s in enumerate("I II III IV V VI VII VIII IX X XI XII L C D M".split())} | {chr(0x2170 + i): s.lower() for i, s in enumerate("I II III IV V VI VII VIII IX X XI XII L C D M".split())}


def half_width(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def full_width(c: Column) -> Column:
    return F.translate(c, HALF, FULL)


def canonical(c: Column) -> Column:
    """Half-width and without white space: what patterns run on."""
    return F.regexp_replace(half_width(c), r"(?U)\s+", "")


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def unify_dashes(c: Column) -> Column:
    return F.regexp_replace(c, "[‐-―−－﹣]", "-")


def ascii_roman(c: Column) -> Column:
    """Roman numeral characters as letters."""
    table = F.create_map(*[F.lit(x) for kv in _ROMAN.items() for x in kv])
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(table[x], x)), "")


def content_length(c: Column) -> Column:
    """Number of characters that aren't white space."""
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def md_escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, r"\\$1")


_UNESCAPE = [
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"~~([^~\n]+)~~", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"!\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"\\([\\`*_{}\[\]#+\-.!|>~])", "$1"),
]


def md_unescape(c: Column) -> Column:
    """Plain text of Markdown: headings, bold, italic, strike, code, links, images, escapes, in that order."""
    for pattern, to in _UNESCAPE:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_math(c: Column) -> Column:
    """Take LaTeX delimiters off a text that is one formula."""
    t = F.trim(c)
    inner = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"(?s)^\$\$(.*)\$\$$", r"(?s)^\$(.*)\$$", r"(?s)^\\\[(.*)\\\]$", r"(?s)^\\\((.*)\\\)$")]
    return F.trim(F.coalesce(*inner, t))


def valid_char(c: Column) -> Column:
    """Neither the replacement character nor private use."""
    return ~c.rlike("[\\x{E000}-\\x{F8FF}\\x{FFFD}]")


def first_match(c: Column, patterns: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Name of the first pattern, in order, that is found."""
    out = F.lit(otherwise)
    for name, pattern in reversed(patterns):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def any_match(c: Column, patterns: Sequence[str], whole: bool = False) -> Column:
    """Whether the joined alternation is found, or matches the whole text."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return c.rlike(f"^(?:{joined})$" if whole else joined)


def truncate_middle(c: Column, limit: int, mark: str = "\n...\n") -> Column:
    """Over the limit: its first two thirds, a mark, and its last third."""
    head, tail = limit * 2 // 3, limit - limit * 2 // 3
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(tail))))


def colon_index(c: Column) -> Column:
    """1-based place of the first half- or full-width colon, null for none."""
    return F.least(F.nullif(F.instr(c, ":"), F.lit(0)), F.nullif(F.instr(c, "："), F.lit(0)))


def key_value(c: Column) -> Column:
    """(key, value) around the first colon; null where the key isn't short and plain."""
    at = colon_index(c)
    key = F.trim(F.substring(c, F.lit(1), at - 1))
    ok = (F.length(key) > 0) & (F.length(key) <= 24) & ~key.rlike("[,;。，；]")
    return F.when(ok, F.struct(key.alias("key"), F.trim(F.substring(c, at + 1, F.length(c))).alias("value")))


def shortest_period(c: Column) -> Column:
    """The shortest string that a text repeats, else null. Java patterns have back-references."""
    return F.nullif(F.regexp_extract(c, r"(?s)^(.+?)\1+$", 1), F.lit(""))


def collapse_repeats(c: Column, least: int = 10, times: int = 10) -> Column:
    """Keep one of a unit of at least ``least`` characters that follows itself ``times`` times."""
    return F.regexp_replace(c, rf"(?s)(.{{{least},}}?)\1{{{times - 1},}}", "$1")


def strip_page_ref(c: Column) -> Column:
    """A contents line without its page number."""
    return F.regexp_replace(c, r"(?U)[\s.…·]*[\(\[]?\d+[\)\]]?\s*$", "")


def strip_number(c: Column) -> Column:
    """A heading without its number."""
    return F.regexp_replace(c, r"(?U)^\s*(\d+(\.\d+)*[.、)]?|[\(（]\w{1,3}[\)）])\s*", "")


def format_size(c: Column) -> Column:
    """Bytes with a unit."""
    n = c.cast("double")
    out = F.concat(F.format_number(n / 1024**3, 1), F.lit(" GB"))
    for power, unit in ((2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.format_number(n / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def collapse_ctc(ids: Column, blank: int = 0) -> Column:
    """Greedy decoding: drop repeats, then blanks."""
    return F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(ids, i - 1))))


def _unreliable(c: Column) -> Column:
    """Whether a character is punctuation, a symbol, a control or private character."""
    return c.rlike(r"^[\p{P}\p{S}\p{C}]")


def _tolerant_score(a: Column, b: Column) -> Column:
    """92 or 90 for titles that agree but for their first character, else 0."""
    tail = lambda c: F.substring(c, F.lit(2), F.length(c))
    return (
        F.when((a == "") | (b == "") | (a == b), 0)
        .when((F.length(a) > 1) & (tail(a) == b), F.when((F.length(b) >= 4) | _unreliable(a), 92).otherwise(0))
        .when((F.length(b) > 1) & (tail(b) == a), F.when((F.length(a) >= 4) | _unreliable(b), 92).otherwise(0))
        .when((F.length(a) == F.length(b)) & (F.length(a) > 1) & (tail(a) == tail(b)) & ((F.length(a) >= 5) | _unreliable(a) | _unreliable(b)), 90)
        .otherwise(0)
    )


def title_forms(c: Column) -> Column:
    """A title as it is compared: without white space and width (plain), and without its number, too (bare)."""
    return F.struct(canonical(c).alias("plain"), canonical(strip_number(c)).alias("bare"))


def title_score(text: Column, target: Column) -> Column:
    """How well a text is a title, of their ``title_forms``: equal 100; equal without numbers 95; but for the
    first character 92 or 90; one begins with the other 85, without numbers 80; else 0. (STR-37)"""
    s, t, s2, t2 = text["plain"], target["plain"], text["bare"], target["bare"]
    begun = lambda a, b: a.startswith(b) | b.startswith(a)
    return F.coalesce(
        F.when((s == "") | (t == ""), 0).when(s == t, 100).when((s2 == t2) & (t2 != ""), 95),
        F.nullif(_tolerant_score(s, t), F.lit(0)),
        F.when((t2 != "") & (_tolerant_score(s2, t2) > 0), 90),
        F.when(begun(s, t), 85).when((t2 != "") & (s2 != "") & begun(s2, t2), 80).otherwise(0),
    )


def field_line(c: Column, lines: Column, labels: Sequence[str] = ()) -> Column:
    """Whether a text of at most two lines looks like ``label: value``. (PRJ-15)"""
    t = F.trim(c)
    at = colon_index(t)
    label, value = F.trim(F.substring(t, F.lit(1), at - 1)), F.trim(F.substring(t, at + 1, F.length(t)))
    bare = F.replace(F.replace(label, F.lit(" "), F.lit("")), F.lit("\u3000"), F.lit(""))
    plain = (F.length(bare) <= 12) & bare.rlike("^[\u4e00-\u9fffA-Za-z0-9（）()_-]+$")
    ok = (F.length(t) <= 120) & (lines <= 2) & (label != "") & (value != "") & (plain | bare.isin(*labels) if labels else plain)
    return F.coalesce(ok, F.lit(False))


def title_start(c: Column, centred: Column, pattern: str = CHAPTER_LINE) -> Column:
    """Whether a short text begins like a heading, or is one centred line; a blank one does, too. (PRJ-16)"""
    t = F.trim(c)
    listed = t.rlike("^(第|[一二三四五六七八九十]、)")
    return F.when(t == "", True).when(F.length(t) > 60, False).otherwise(listed | t.rlike(pattern) | centred)


def merge_vetoed(a: Column, b: Column, a_lines: Column, b_lines: Column, a_centred: Column, b_centred: Column, sentence: str = SENTENCE_LINE) -> Column:
    """Whether two texts can't be one paragraph: a line of its own, a field, or a heading is among them. (PRJ-14)"""
    own = a.rlike(sentence) | b.rlike(sentence)
    return own | field_line(a, a_lines) | field_line(b, b_lines) | title_start(a, a_centred) | title_start(b, b_centred)


def contents_heading(c: Column) -> Column:
    """A heading of contents as it is compared: without white space, colons and dashes, in lower case. (STR-20)"""
    return F.lower(F.regexp_replace(c, "(?U)[\\s:：\\-－–—−_]+", ""))


def compatible(c: Column) -> Column:
    """Characters of the compatibility blocks (superscripts, enclosed and wide forms) as plain ones. (STR-22)"""
    singles = {chr(i): unicodedata.normalize("NFKC", chr(i)) for block in (range(0xB2, 0xBB), range(0x2070, 0x208F), range(0x3000, 0x3001), range(0xFF01, 0xFF5F)) for i in block}
    singles = {k: v for k, v in singles.items() if len(v) == 1 and v != k}
    return F.translate(c, "".join(singles), "".join(singles.values()))


def split_captions(c: Column, start: str = r"(?:Table|Figure|表|图)\s*\d+") -> Column:
    """Array of the captions that one line holds; a line with fewer than two stays as it is. (STR-31)"""
    parts = F.filter(F.split(c, rf"(?={start})"), lambda x: F.trim(x) != "")
    return F.when(F.size(F.regexp_extract_all(c, F.lit(f"({start})"), F.lit(1))) > 1, F.transform(parts, lambda x: F.trim(x))).otherwise(F.array(c))


def find_all(c: Column, pattern: str) -> Column:
    """Array of (start, text) of the matches, which don't overlap; start counts from 0. (STR-09, STR-10)"""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    # the place after the last match, and where matches start; the text is searched from that place, not cut
    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    def step(a, m):
        start = F.when(m == "", a["at"]).otherwise(F.call_function("locate", m, c, a["at"]))
        return F.transform(F.array(start), lambda s: F.struct((s + F.length(m)).alias("at"), F.array_append(a["out"], s - 1).alias("out")))[0]
    starts = F.aggregate(found, empty, step, lambda a: a["out"])
    return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), m.alias("text")))


def positions(c: Column) -> Column:
    """0-based places in a text of the characters that ``canonical`` keeps: its i-th character comes
    from the i-th place, so ranges of the one can be read in the other."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    marked = F.transform(chars, lambda x, i: F.when(x.rlike(r"(?U)^\s$"), -1).otherwise(i))
    return F.filter(marked, lambda i: i >= 0)


def original_range(places: Column, start: Column, end: Column) -> Column:
    """(start, end) in the text of a range of its canonical form; null for an empty one."""
    ok = (start < end) & (end <= F.size(places))
    return F.when(ok, F.struct(F.get(places, start).alias("start"), (F.get(places, end - 1) + 1).alias("end")))


def _ligature_map() -> dict[str, str]:
    """Typographic characters that stand for several, by their compatibility decomposition."""
    return {c: unicodedata.normalize("NFKC", c) for c in [*map(chr, range(0xFB00, 0xFB07)), "…", "‼"]}


def expand_ligatures(c: Column) -> Column:
    """Typographic ligatures as the letters that they join."""
    for one, many in _ligature_map().items():
        c = F.replace(c, F.lit(one), F.lit(many))
    return c


def to_ligature(c: Column) -> Column:
    """The character that stands for a whole string, null for none."""
    turned = {v: k for k, v in reversed(_ligature_map().items())}
    return F.create_map(*[F.lit(x) for kv in turned.items() for x in kv])[c]


def is_ligature(c: Column) -> Column:
    return c.isin(*_ligature_map())


def split_dotted(c: Column) -> Column:
    """Parts of a dotted path; quotes keep dots."""
    parts = F.regexp_extract_all(c, F.lit(r"""\s*("[^"]*"|'[^']*'|[^.]+)\s*(\.|$)"""), F.lit(1))
    return F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"""^\s*["']|["']\s*$""", "")))


def dominant_color(colors: Column) -> Column:
    """The most common value of an array, the smallest of equals."""
    counted = F.transform(F.array_distinct(colors), lambda x: F.struct(F.size(F.filter(colors, lambda y: y == x)).alias("n"), x.alias("v")))
    top = F.array_max(F.transform(counted, lambda s: s["n"]))
    return F.array_min(F.transform(F.filter(counted, lambda s: s["n"] == top), lambda s: s["v"]))


def md_mark(c: Column, mark: str) -> Column:
    """A text between marks (such as **); white space at its ends stays outside, a blank text as it is.
    A space follows marks that end in punctuation."""
    head, tail = F.regexp_extract(c, r"(?U)^(\s*)", 1), F.regexp_extract(c, r"(?U)(\s*)$", 1)
    core = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    gap = F.when(core.rlike(r"\p{Punct}$") & (tail == ""), " ").otherwise("")
    return F.when(core == "", c).otherwise(F.concat(head, F.lit(mark), core, F.lit(mark), gap, tail))
