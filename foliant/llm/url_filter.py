"""URL filter: rules on host and path, and boosted trees on lexical features for the rest.

The longest rule whose host is the url's or a parent of it and whose path begins the url's path
decides. Where none does, trees decide that were trained from labelled URLs: lengths, depth,
digit ratio, entropy, numbers of parameters, and how often the host's suffixes were blocked.
Suffixes are counted over all labelled URLs and joined to the rows; a URL that trees are fitted to
gets the shares of the other folds, so its own label doesn't count. The trees are fitted to at most
``SAMPLE_ROWS`` of them.

No table has labels of URLs. ``labelled`` takes the verdicts of rules where one fits; else a URL is one
to block if its host has a word of a seed list, as published block lists have them, and presumed
clean if not. ``held_out_auc`` tells how well trees fitted to some hosts judge URLs of others.

A null url, or one without ``://``, has an empty host and path, fits no rule and goes to the trees.
Repeated rows are each judged; columns other than page_id and url are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import bounded_sample
from foliant.llm.trees import Forest, fit
from foliant.runtime import join_dimension, materialize

#: Most labelled URLs that the trees are fitted to.
SAMPLE_ROWS = 20_000
#: Parts of the labelled URLs; shares of suffixes that a part gets come from the others.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Parts of host names that mark a URL as one to block when training labels are made.
BLOCKED_PARTS = ("spam", "pills", "casino", "ads-", "track", "porn", "xxx", "betting", "payday", "malware")

Rule = tuple[str, str]


def host(url: str | Column = "url") -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(c, _AFTER, 1), UPPER, LOWER), F.lit(""))


def path(url: str | Column = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url) if isinstance(url, str) else url, _AFTER, 2), F.lit(""))


def first_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, or null; rules are ``host/path``."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(v / n * np.log2(v / n) for v in Counter(s).values()) if n else 0.0


def features(url: str | None, last: float, last_two: float) -> list[float]:
    """Lexical features of one url, and the blocked shares of its host's last label and last two."""
    url = url or ""
    try:
        parts = urlsplit(url)
        name, where, query, rest = parts.netloc, parts.path, parts.query, parts.fragment
    except ValueError:
        name, where, query, rest = "", url, "", ""
    labels = [x for x in name.lower().split(".") if x]
    pieces = [x for x in where.split("/") if x]
    n = len(url) or 1
    return [
        len(url), len(name), len(where), len(query), len(labels), len(pieces), max(map(len, pieces), default=0), max(map(len, labels), default=0),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in name) / (len(name) or 1), sum(not c.isalnum() for c in url) / n,
        name.count("-"), _entropy(name), _entropy(where), len([x for x in query.split("&") if x]), query.count("="), float(bool(rest)), float(url.startswith("https")), float("." in where.rpartition("/")[2]),
        last, last_two,
    ]


def with_suffixes(rows: DataFrame) -> DataFrame:
    """Add ``last`` and ``last_two``: the last label and the last two labels of the url's host."""
    labels = F.filter(F.split(host(), r"\."), lambda x: x != "")
    tail = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)))
    return rows.withColumns({"last": tail(1), "last_two": tail(2)})


def _smoothed(blocked: Column, n: Column, mean: Column) -> Column:
    return (blocked + 5 * mean) / (n + 5)


def suffix_shares(labels: DataFrame) -> DataFrame:
    """suffix, fold, share: smoothed share of blocked urls by suffix, of all rows (url, label, last,
    last_two) for the fold -1, else of those that aren't in the fold; under '' the mean of all."""
    mean = labels.agg(F.avg("label")).first()[0]
    mean = F.lit(0.5 if mean is None else float(mean))
    each = labels.select("label", _fold().alias("fold"), F.explode(F.array_distinct(F.array("last", "last_two"))).alias("suffix")).where("suffix <> ''")
    per = materialize(each.groupBy("suffix", "fold").agg(F.sum("label").alias("b"), F.count("*").alias("n")))
    total = per.groupBy("suffix").agg(F.sum("b").alias("tb"), F.sum("n").alias("tn"))
    whole = total.select("suffix", F.lit(-1).alias("fold"), _smoothed(F.col("tb"), F.col("tn"), mean).alias("share"))
    rest = per.join(total, "suffix").select("suffix", "fold", _smoothed(F.col("tb") - F.col("b"), F.col("tn") - F.col("n"), mean).alias("share"))
    return whole.unionByName(rest).unionByName(labels.sparkSession.range(1).select(F.lit("").alias("suffix"), F.lit(-1).alias("fold"), mean.alias("share")))


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit(23), "url"), F.lit(FOLDS)).cast("int")


def with_shares(rows: DataFrame, shares: DataFrame, counted: bool = False) -> DataFrame:
    """Rows with ``last`` and ``last_two`` replaced by the shares of these suffixes, or by the mean.

    ``counted``: the rows are among those that were counted, and get the shares of the other folds.
    """
    mean = F.lit(shares.where("suffix = ''").first()["share"])
    rows = rows.withColumn("__fold", _fold() if counted else F.lit(-1))
    for name in ("last", "last_two"):
        own = shares.select(F.col("suffix").alias(name), F.col("fold").alias("__fold"), F.col("share").alias("__share")).where(F.col("__fold") >= 0 if counted else F.col("__fold") < 0)
        rows = join_dimension(rows, own if name == "last_two" else own.where(~F.col(name).contains(".")), [name, "__fold"], "left")
        rows = rows.withColumn(name, F.coalesce("__share", mean)).drop("__share")
    return rows.drop("__fold")


def labelled(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Distinct URLs with a label (1: block): by a rule, else by whether the host has a word of the seed list.
    A URL without a host has none."""
    h, verdicts = host(), dict(rules)
    rule = first_rule(rules, h, path())
    label = F.when(h != "", F.greatest(*(h.contains(part).cast("int") for part in BLOCKED_PARTS)))
    for r in verdicts:
        label = F.when(rule == r, int(verdicts[r] == "block")).otherwise(label)
    return pages.select("url", label.alias("label")).where("label is not null").distinct()


def train(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Forest, DataFrame]:
    """Trees fitted to rows (url, label), at most ``sample_rows`` of them, those with the smallest
    hashes; and the shares of suffixes over all rows."""
    rows = materialize(with_suffixes(labels.select("url", "label")))
    shares = materialize(suffix_shares(rows))
    sample = with_shares(bounded_sample(rows, sample_rows, ["url", "label"]), shares, True).toPandas().sort_values(["url", "label"])
    y = sample["label"].to_numpy(np.float64)
    x = np.array([features(*r) for r in sample[["url", "last", "last_two"]].itertuples(index=False)]) if len(y) else np.zeros((0, 1))
    return fit(x, y, trees=60, depth=3), shares


def held_out_auc(labels: DataFrame, folds: int = 5, fold: int = 0, sample_rows: int = SAMPLE_ROWS) -> float | None:
    """Area under the curve over the URLs of a fifth of the hosts, of trees fitted to the other hosts.

    Hosts are dealt by their last three labels. Null where the fold has no labels of both kinds.
    """
    site = F.concat_ws(".", F.slice(F.reverse(F.split(host(), r"\.")), 1, 3))
    rows = labels.withColumn("__out", F.pmod(F.xxhash64(site), F.lit(folds)) == fold)
    forest, shares = train(rows.where("not __out"), sample_rows)
    own = rows.where("__out").select(F.lit(0).cast("long").alias("page_id"), "url", F.col("label").cast("double").alias("label"))
    scored = judge(own, [], forest, shares, ["label"]).select("score", "label")
    # ranks by counts of each score, of which there are no more than leaves can be combined
    per = scored.groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n")).orderBy("score").toPandas()
    p, q = per["p"].to_numpy(float), (per["n"] - per["p"]).to_numpy(float)
    if not p.sum() or not q.sum():
        return None
    return float((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum()))


def judge(pages: DataFrame, rules: Sequence[Rule], forest: Forest, suffixes: DataFrame, keeps: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row, and the columns ``keeps``."""

    @F.arrow_udf("double")
    def blocked(url: pa.Array, last: pa.Array, last_two: pa.Array) -> pa.Array:
        if not len(url):
            return pa.array([], pa.float64())
        return pa.array(forest.score(np.array([features(*r) for r in zip(url.to_pylist(), last.to_pylist(), last_two.to_pylist(), strict=True)])))

    rule, verdict = F.col("rule"), F.lit(None).cast("string")
    for r, v in rules:
        verdict = F.when(rule == r, F.lit(v)).otherwise(verdict)
    read = with_shares(with_suffixes(pages.select("page_id", "url", *keeps)), suffixes)
    out = read.select("page_id", *keeps, host().alias("host"), path().alias("path"), blocked("url", "last", "last_two").alias("score"))
    out = out.withColumn("rule", first_rule(rules, F.col("host"), F.col("path")))
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score", *keeps)
