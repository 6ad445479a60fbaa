"""Queries over texts and their lines, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import numbers as num
from foliant.functions import text as tx
from foliant.operators import quality, sequence, tree
from foliant.plans.shared import LINES, documents, lines, md5, with_sql
from foliant.runtime import ship, table
from foliant.sources import adapters

PATTERNS = [("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("mail", r"[a-z0-9.]+@[a-z0-9.]+"), ("list", r"^[0-9]+\."), ("table", r" \| "), ("loud", r"^[A-Z!, .]+$"), ("sentence", r"\.$")]
KEYWORDS = {"License": 3, "Copyright": 3, "password": 2, "token": 2, "http": 1, "the": 1, "und": 1, "est": 1}
_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in PATTERNS) + " ELSE 'other' END"
_WS = r"[ \t\n\r\f\x0b\x1c-\x1f\x85\xa0\x{2028}\x{2029}\x{3000}\x{2000}-\x{200a}\x{202f}\x{205f}\x{1680}]+"
_FULL = "".join(f"'||chr({c})||'" for c in [*range(0xFF01, 0xFF5F), 0x3000])
_HALF = "".join(("''" if c == 0x27 else chr(c)) for c in [*range(0x21, 0x7F), 0x20])
_ESC = r"([\\`*_{}\[\]#+\-.!|>~])"
_MD = rf"array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), lambda x: regexp_replace(x, '{_ESC}', '\\\1', 'g')), chr(10) || chr(10))"
_LEN = f"length(regexp_replace(text, '{_WS}', '', 'g'))"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, length(md) AS n_chars, md5(md) AS digest FROM (SELECT doc_id, {_MD} AS md FROM documents)")
def md_documents(s, d):
    shown = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    md = F.array_join(F.transform(shown, tx.md_escape), "\n\n")
    return documents(s, d).select("doc_id", md.alias("md")).select("doc_id", F.length("md").cast("long").alias("n_chars"), md5("md"))


_PAGES = f"pages_q AS (SELECT doc_id, page_no, count(*) AS objects, CAST(sum({_LEN}) AS BIGINT) AS chars, count(*) FILTER (WHERE {_LEN} > 0) AS texts FROM lines GROUP BY doc_id, page_no)"
_DOCS = "docs_q AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE chars = 0) AS empty_pages, CAST(sum(objects) AS BIGINT) AS objects, CAST(sum(chars) AS BIGINT) AS chars, round(sum(chars) / count(*), 2) AS avg_chars FROM pages_q GROUP BY doc_id)"


@query(with_sql(LINES, _PAGES) + "SELECT *, chars = 0 AS empty FROM pages_q")
def page_quality(s, d):
    return quality.page_quality(lines(s, d))


@query(with_sql(LINES, _PAGES, _DOCS) + "SELECT * FROM docs_q")
def doc_quality(s, d):
    return quality.document_quality(quality.page_quality(lines(s, d)))


@query(with_sql(LINES, _PAGES, _DOCS) + """SELECT doc_id, 'empty_pages' AS symptom FROM docs_q WHERE empty_pages / pages >= 0.3 UNION ALL SELECT doc_id, 'few_chars' FROM docs_q WHERE avg_chars < 80
UNION ALL SELECT doc_id, 'no_objects' FROM docs_q WHERE objects = 0 UNION ALL SELECT doc_id, 'no_text' FROM docs_q WHERE chars < 200""")
def quality_symptoms(s, d):
    return quality.symptoms(quality.document_quality(quality.page_quality(lines(s, d))))


@query(f"SELECT doc_id, {_LEN.replace('text', chr(34) + 't' + chr(34))} AS content_len FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def content_len(s, d):
    return documents(s, d).select("doc_id", tx.content_length(F.coalesce("text", F.lit(""))).cast("long").alias("content_len"))


@query(with_sql(LINES) + "SELECT doc_id, CAST(sum(n) AS BIGINT) AS lines, max(n) AS most FROM (SELECT doc_id, text, count(*) AS n FROM lines WHERE text <> '' GROUP BY 1, 2) GROUP BY doc_id HAVING max(n) >= 3")
def repeated_line_docs(s, d):
    return quality.repeated_lines(lines(s, d))


@query("""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(ls) AS line FROM l) GROUP BY 1, 2),
t AS (SELECT doc_id, max({'n': n, 'line': line}) AS top FROM c GROUP BY 1)
SELECT doc_id, md5(CASE WHEN top.n >= 3 AND top.n >= 0.8 * len(ls) THEN top.line ELSE text END) AS digest FROM l LEFT JOIN t USING (doc_id)""")
def dominant_line_truncate(s, d):
    return documents(s, d).where("text is not null").select("doc_id", quality.dominant_line(F.col("text")).alias("t")).select("doc_id", md5("t"))


@query(f"SELECT doc_id, md5(regexp_replace(translate(coalesce(text, ''), '{_FULL}', '{_HALF}'), '{_WS}', '', 'g')) AS digest FROM documents")
def text_canonical(s, d):
    return documents(s, d).select("doc_id", tx.canonical(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", md5("t"))


@query(rf"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '{_ESC}', '\\\1', 'g')) AS digest FROM documents")
def md_escape(s, d):
    return documents(s, d).select("doc_id", tx.md_escape(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", md5("t"))


_MARKED = "'# **' || replace(text, '*', '') || '** [' || line_no || '](x)'"
_UN = _MARKED
for _p, _to in tx._UNESCAPE:
    _UN = f"regexp_replace({_UN}, '{_p}', '{_to.replace('$', chr(92))}', 'g')"


@query(with_sql(LINES) + f"SELECT doc_id, line_no, md5({_UN}) AS digest FROM lines")
def md_unescape(s, d):
    marked = F.concat(F.lit("# **"), F.replace("text", F.lit("*"), F.lit("")), F.lit("** ["), F.col("line_no").cast("string"), F.lit("](x)"))
    return lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), tx.md_unescape(marked).alias("t")).select("doc_id", "line_no", md5("t"))


@query(with_sql(LINES) + f"SELECT pattern, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {_CASE} AS pattern FROM lines) GROUP BY pattern")
def pattern_first_match(s, d):
    named = lines(s, d).select("doc_id", tx.first_match(F.col("text"), PATTERNS, "other").alias("pattern"))
    per = named.groupBy("pattern", "doc_id").agg(F.count("*").alias("n"))  # a hot pattern is summed by document first
    return per.groupBy("pattern").agg(F.sum("n").alias("lines"), F.count("*").alias("docs"))


@query(with_sql(LINES) + f"SELECT doc_id, count(DISTINCT p) = 1 AS alike FROM (SELECT doc_id, {_CASE} AS p FROM lines) GROUP BY doc_id")
def pattern_alike(s, d):
    p = lines(s, d).select("doc_id", tx.first_match(F.col("text"), PATTERNS, "other").alias("p"))
    return p.groupBy("doc_id").agg((F.min("p") == F.max("p")).alias("alike"))


@query("""SELECT n_nationkey AS id, array_to_string(list_sort(list_distinct(list_concat(range(n_nationkey, n_nationkey + n_regionkey + 1), [CAST(5 AS BIGINT)]))), ',') AS pages FROM nation""")
def page_selector(s, d):
    spec = F.concat_ws(",", F.concat_ws("-", "n_nationkey", F.col("n_nationkey") + F.col("n_regionkey")), F.lit("5"))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(num.page_numbers(spec), ",").alias("pages"))


@query(with_sql(LINES, "m AS (SELECT *, lag(text) OVER w AS pt, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w - lag(y0) OVER w AS ph, lag(page_no) OVER w AS pp FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))",
  r"sc AS (SELECT *, CASE WHEN pp = page_no THEN 0 WHEN pp + 1 = page_no THEN 2 END AS scene FROM m)",
  r"""scores AS (SELECT *, scene + (CASE WHEN px1 >= 0.9 * 3000 THEN 2 ELSE -3 END) + (CASE WHEN abs(px0 - x0) <= 5 THEN 2 ELSE 0 END) + (CASE WHEN ph = y1 - y0 THEN 1 ELSE 0 END)
  + (CASE WHEN regexp_matches(pt, '[.!?;:]$') THEN -2 ELSE 1 END) + (CASE WHEN regexp_matches(text, '^\s{2,}') THEN -2 ELSE 0 END) AS score FROM sc)""") + "SELECT doc_id, line_no, score FROM scores")  # fmt: skip
def paragraph_scores(s, d):
    return sequence.continuity(lines(s, d), 3000).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "score")


@query(SQL["paragraph_scores"].replace("SELECT doc_id, line_no, score FROM scores", """, j AS (SELECT *, coalesce(score >= CASE WHEN scene = 2 THEN 7 ELSE 6 END, false) AS joins FROM scores),
k AS (SELECT doc_id, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS chain FROM j)
SELECT doc_id, CAST(chain AS BIGINT) AS chain, count(*) AS lines FROM k GROUP BY 1, 2"""))
def paragraph_chains(s, d):
    scored = sequence.continuity(lines(s, d), 3000)
    return sequence.chains(scored, ["doc_id"], ["line_no"], F.col("joins")).groupBy("doc_id", "chain").agg(F.count("*").alias("lines"))


@query(with_sql(LINES, "b AS (SELECT *, lag(y0) OVER w - y1 > 1.5 * (lag(y1) OVER w - lag(y0) OVER w) AS n FROM lines WHERE length(text) > 40 WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y1 DESC, x0, line_no))",
  "k AS (SELECT doc_id, page_no, sum(CASE WHEN coalesce(n, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY y1 DESC, x0, line_no) AS block FROM b)") + "SELECT doc_id, page_no, CAST(block AS BIGINT) AS block, count(*) AS lines FROM k GROUP BY 1, 2, 3")
def line_blocks(s, d):
    long = lines(s, d).where(F.length("text") > 40)
    return sequence.line_blocks(long, ["doc_id", "page_no"]).groupBy("doc_id", "page_no", "block").agg(F.count("*").alias("lines"))


_SUM = " + ".join(f"max(CASE WHEN contains(text, '{k}') THEN {w} ELSE 0 END)" for k, w in KEYWORDS.items())


@query(with_sql(LINES) + f"SELECT doc_id, {_SUM} AS score FROM lines GROUP BY doc_id HAVING {_SUM} >= 4")
def keyword_score(s, d):
    return quality.keyword_scores(lines(s, d), KEYWORDS, 4)


_HITS = " + ".join(f"max(CASE WHEN regexp_matches(text, '{p}') THEN 1 ELSE 0 END)" for _, p in PATTERNS)


@query(with_sql(LINES) + f"SELECT doc_id, {_HITS} AS hits FROM lines GROUP BY doc_id HAVING {_HITS} >= 2")
def keyword_min_hits(s, d):
    return quality.keyword_hits(lines(s, d), [p for _, p in PATTERNS], 2)


@query(with_sql(LINES) + f"SELECT doc_id, line_no, {_CASE} AS rule FROM lines")
def rule_first_match(s, d):
    return lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), tx.first_match(F.col("text"), PATTERNS, "other").alias("rule"))


# headings: short lines; a level from the length of their first word
_HEADS = r"heads AS (SELECT doc_id, line_no AS seq, text AS title, 1 + length(regexp_extract(text, '^([A-Za-z]*)', 1)) % 4 AS level FROM lines WHERE length(text) BETWEEN 1 AND 60), ends AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY doc_id)"


def _heads(s, d):
    level = 1 + F.length(F.regexp_extract("text", "^([A-Za-z]*)", 1)) % 4
    all_lines = lines(s, d).withColumn("seq", F.col("line_no").cast("long"))
    return all_lines.where(F.length("text").between(1, 60)).select("doc_id", "seq", F.col("text").alias("title"), level.alias("level")), all_lines.groupBy("doc_id").agg(F.max("seq").alias("last"))


_RANGES = 'r AS (SELECT doc_id, seq AS start, coalesce(lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) - 1, last) AS "end" FROM heads JOIN ends USING (doc_id) WHERE level = 1)'


@query(with_sql(LINES, _HEADS, _RANGES) + "SELECT * FROM r")
def chapter_ranges(s, d):
    heads, ends = _heads(s, d)
    return tree.chapter_ranges(heads.where("level = 1"), ends)


@query(with_sql(LINES, _HEADS, _RANGES, 'q AS (SELECT * FROM r WHERE "end" > start)', 'g AS (SELECT doc_id, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS s, start - 1 AS e FROM q)')
  + """SELECT doc_id, start, "end", false AS filler FROM q UNION ALL SELECT doc_id, s, e, true FROM g WHERE s <= e
UNION ALL SELECT doc_id, coalesce(done, -1) + 1, last, true FROM ends LEFT JOIN (SELECT doc_id, max("end") AS done FROM q GROUP BY 1) USING (doc_id) WHERE coalesce(done, -1) + 1 <= last""")  # fmt: skip
def chapter_gap_fill(s, d):
    heads, ends = _heads(s, d)
    return tree.fill_gaps(tree.chapter_ranges(heads.where("level = 1"), ends).where("end > start"), ends)


@query(with_sql(LINES) + r"SELECT doc_id, line_no, length(n) - length(replace(n, '.', '')) + 1 AS level FROM (SELECT doc_id, line_no, regexp_extract(text, '([0-9]+(\.[0-9]+)*)', 1) AS n FROM lines) WHERE n <> ''")
def toc_levels(s, d):
    n = F.regexp_extract("text", r"([0-9]+(\.[0-9]+)*)", 1).alias("n")
    return lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), n).where("n != ''").select("doc_id", "line_no", num.dotted_level(F.col("n")).cast("long").alias("level"))


_PARENT = "p AS (SELECT h.doc_id, h.seq, (SELECT max(o.seq) FROM heads o WHERE o.doc_id = h.doc_id AND o.seq < h.seq AND o.level < h.level) AS parent FROM heads h)"


@query(with_sql(LINES, _HEADS, _PARENT) + "SELECT * FROM p")
def toc_parent(s, d):
    return tree.parents(_heads(s, d)[0], deepest=4).select("doc_id", "seq", "parent")


@query("WITH RECURSIVE " + with_sql(LINES, _HEADS, _PARENT)[5:] + ", t AS (SELECT doc_id, seq, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.seq, t.depth + 1 FROM p JOIN t ON p.doc_id = t.doc_id AND p.parent = t.seq) SELECT doc_id, seq, depth FROM t")
def tree_depth(s, d):
    nodes = tree.parents(_heads(s, d)[0], deepest=4)
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct("doc_id", F.col(c).alias("seq")))
    # levels are four, so two doublings reach every root
    found = tree.depths(nodes.select(key("seq").alias("node_id"), key("parent").alias("parent_id")))
    return found.select("node_id.doc_id", "node_id.seq", "depth")


@query(with_sql(LINES) + "SELECT doc_id, line_no, ntile(4) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM lines")
def balanced_split(s, d):
    return sequence.balanced_split(lines(s, d), ["doc_id"], ["line_no"], 4).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("part").cast("long").alias("part"))


@query(with_sql(LINES, "n AS (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i FROM lines)") + "SELECT doc_id, line_no FROM n WHERE n <= 8 OR i < 2 OR i >= n - 2 OR floor((i - 1) * 4 / (n - 4)) > floor((i - 2) * 4 / (n - 4))")
def sample_head_tail(s, d):
    return sequence.head_tail_sample(lines(s, d), ["doc_id"], ["line_no"], 8, 2, 2).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(with_sql(LINES, "v AS (SELECT doc_id, text, line_no, lag(length(text) > 80) OVER w AS p, row_number() OVER w AS n FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))",
  "k AS (SELECT doc_id, length(text) > 80 AS style, sum(CASE WHEN n = 1 OR p IS DISTINCT FROM (length(text) > 80) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM v)") + "SELECT doc_id, CAST(run AS BIGINT) AS run, count(*) AS lines, bool_and(style) AS style FROM k GROUP BY 1, 2")
def style_runs(s, d):
    wide = F.length("text") > 80
    return sequence.runs(lines(s, d), ["doc_id"], ["line_no"], wide).groupBy("doc_id", "run").agg(F.count("*").alias("lines"), F.bool_and(wide).alias("style"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 10 ELSE 5 END")
def admit_tasks(s, d):
    cap = F.when(F.col("event_type") == "click", 20).when(F.col("event_type") == "view", 10).otherwise(5)
    n = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id"))
    return table(s, d, "events").select("user_id", "event_type", "event_id", n.alias("n")).where(F.col("n") <= cap).drop("n")


@query("SELECT user_id, count(*) AS tasks, count(*) FILTER (WHERE gap > 1800) AS expired FROM (SELECT user_id, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts) AS gap FROM events) GROUP BY user_id")
def task_expiry(s, d):
    after = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.timestamp_diff("MICROSECOND", F.col("ts"), after) / 1e6
    return table(s, d, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("gap") > 1800).alias("expired"))


@query("SELECT o_orderkey AS id, CASE WHEN p >= 500 THEN 3 WHEN p >= 100 THEN 2 WHEN p >= 20 THEN 1 ELSE 0 END AS tier FROM (SELECT o_orderkey, o_orderkey % 700 AS p FROM orders)")
def priority_tier(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), num.priority(F.col("o_orderkey") % 700).alias("tier"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 3000 + 1 AS v FROM orders) SELECT id, v AS value FROM r""")
def roman_value(s, d):
    digits = lambda c, signs: F.element_at(F.array(*map(F.lit, signs)), c.cast("int") + 1)
    ones = ["", *"I II III IV V VI VII VIII IX".split()]
    swap = lambda a, b, c: [x.translate(str.maketrans("IVX", a + b + c)) for x in ones]
    v = F.col("o_orderkey") % 3000 + 1
    roman = F.concat(digits(F.floor(v / 1000), ["", "M", "MM", "MMM"]), digits(F.floor(v / 100) % 10, swap("C", "D", "M")), digits(F.floor(v / 10) % 10, swap("X", "L", "C")), digits(v % 10, ones))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), num.roman_value(roman).cast("long").alias("value"))


_CELLS = "CASE CAST(l_linenumber % 5 AS INTEGER) WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '%' WHEN 3 THEN CAST(CAST(l_partkey AS BIGINT) AS VARCHAR) || '.25' ELSE l_returnflag END"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in num.CELL_TYPES) + " ELSE 'text' END"


@query(f"SELECT type, count(*) AS n FROM (SELECT {_TYPE} AS type FROM (SELECT {_CELLS} AS t FROM lineitem)) GROUP BY type")
def cell_type_class(s, d):
    n, whole = F.col("l_linenumber") % 5, F.col("l_quantity").cast("long").cast("string")
    t = F.when(n == 0, whole).when(n == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).when(n == 2, F.concat(whole, F.lit("%"))).when(n == 3, F.concat(F.col("l_partkey").cast("long").cast("string"), F.lit(".25"))).otherwise(F.col("l_returnflag"))
    return table(s, d, "lineitem").select(tx.first_match(t, num.CELL_TYPES, "text").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def turn_sequence(s, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda x: x["role"]), ">").alias("roles"))


@query("SELECT doc_id, line_no, prev_id, next_id FROM (" + with_sql(LINES) + "SELECT doc_id, line_no, lag(line_no) OVER w AS prev_id, lead(line_no) OVER w AS next_id FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))")
def sibling_lines(s, d):
    rows = lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"))
    return sequence.siblings(rows, "doc_id", "line_no", "line_no")


@query(with_sql(LINES) + "SELECT doc_id, min(line_no) AS line_no, md5(text) AS digest FROM lines GROUP BY doc_id, text")
def distinct_lines(s, d):
    rows = lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")
    return sequence.distinct_in_order(rows, ["doc_id"], "text", "line_no").select("doc_id", "line_no", md5("text"))


@query(with_sql(LINES) + "SELECT doc_id, line_no, md5(CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 40) || '...' || right(text, 20) END) AS digest FROM lines")
def truncate_text(s, d):
    return lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), tx.truncate_middle(F.col("text"), 60, "...").alias("t")).select("doc_id", "line_no", md5("t"))


@query("SELECT window_start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)")
def event_windows(s, d):
    w = F.window("ts", "5 minutes")
    return table(s, d, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


@query()
def html_outline(s, d):
    ship(s)
    return adapters.html_nodes(table(s, d, "pages")).where(F.col("tag").isin("title", "h1", "h2", "h3", "a")).select("page_id", "seq", "tag", "depth", "text", "href")


@query("SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS n FROM pages")
def html_paragraphs(s, d):
    return table(s, d, "pages").select("page_id", F.floor((F.length("html") - F.length(F.replace("html", F.lit("<p>"), F.lit("")))) / 3).alias("n"))


@query("WITH RECURSIVE " + with_sql(LINES, _HEADS)[5:] + """, o AS (SELECT doc_id, seq, title, level AS l, CAST(level AS VARCHAR) AS style, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM heads),
r AS (SELECT doc_id, k, [style] AS stack FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, CASE WHEN list_contains(r.stack, o.style) THEN r.stack[:list_position(r.stack, o.style)] ELSE list_append(r.stack, o.style) END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
SELECT doc_id, seq, style, len(stack) AS level FROM r JOIN o USING (doc_id, k)""")
def infer_levels(s, d):
    ship(s)
    heads = _heads(s, d)[0].withColumn("style", F.col("level").cast("string"))
    return tree.infer_levels(heads.select("doc_id", "seq", "style"))
