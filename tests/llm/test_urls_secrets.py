from __future__ import annotations

from collections import Counter

import pytest

from foliant.llm import queries, secrets, url_filter
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, edge_rows, with_nulls

RULES = queries.URL_RULES
URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/x", "https://m.example.org/es/?q", "http://example.org/en/12", "http://example.org/en/2", "https://notexample.org/es/", "ftp://org/", "http://a.com/de/", "http://com/fr/x", "http://a.com/fr", "x://a.com#/de/", "x://a.com?/de/", "http://b.org", "a://b://c.com/de/", "http://ÄÖ.com/de/", "http://[::1/x", "x" * 5000 + "://a.org/", "http://a.com/de/\nnext"]


def test_url_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op5_urls(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = brute.url_parts(pages[r.page_id])
        rule = brute.url_rule(host, path, RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == dict(RULES)[rule])


def test_url_edges(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, "http://a.com/de/", "h", "r")], "page_id long, url string, host string, rule string")
    forest, suffixes = url_filter.train(url_filter.labelled(pages, RULES))
    rows = url_filter.judge(pages, RULES, forest, suffixes).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = brute.url_parts(URLS[r.page_id] if r.page_id is not None else "http://a.com/de/")
        assert (r.host, r.path, r.rule) == (host, path, brute.url_rule(host, path, RULES))
    none = pages.limit(0)
    forest, suffixes = url_filter.train(url_filter.labelled(none, RULES))
    assert url_filter.judge(none, RULES, forest, suffixes).count() == 0


#: The contract's rules, written out: those of the query aren't held against themselves.
CONTRACT = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_rules_and_words_are_those_of_the_contract(spark):
    assert dict(RULES) == CONTRACT and len(RULES) == len(CONTRACT)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    forest, suffixes = url_filter.train(url_filter.labelled(pages, RULES))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, RULES, forest, suffixes).collect()}
    assert got[URLS.index("http://example.org/en/12")] == ("example.org/en/1", "block")
    assert got[URLS.index("http://example.org/en/2")] == ("org/", "allow")
    assert {r for r, _ in got.values() if r} == set(CONTRACT)
    assert all(v == CONTRACT[r] for r, v in got.values() if r)


def test_url_trees_learn(spark):
    rows = [(i, f"http://{'casino' if i % 2 else 'news'}{i}.example.com/{i}") for i in range(300)] + [(900, "http://casino-x9.example.com/5")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(u, int("casino" in u)) for i, u in rows if i < 300], "url string, label int")
    forest, suffixes = url_filter.train(labels)
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [], forest, suffixes).collect()}
    assert sum(got[i] == ("block" if i % 2 else "allow") for i in range(300)) > 280


def test_suffixes_are_counted_over_all_labels(spark):
    rows = [(f"http://h{i}.bad.test/{i}", 1) for i in range(40)] + [(f"http://h{i}.good.example/{i}", 0) for i in range(360)] + [("http://single/", 1)]
    _, shares = url_filter.train(spark.createDataFrame(rows, "url string, label int"), 4)
    got, mean = {r.suffix: r.share for r in shares.where('fold < 0').collect()}, 41 / 401
    want = {"": mean, "single": (1 + 5 * mean) / 6} | {k: (40 + 5 * mean) / 45 for k in ("test", "bad.test")} | {k: 5 * mean / 365 for k in ("example", "good.example")}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    pages = url_filter.with_suffixes(spark.createDataFrame([("http://x.BAD.test?q",), ("http://new.test:1/",), (None,)], "url string"))
    assert sorted(round(r.last_two, 9) for r in url_filter.with_shares(pages, shares).collect()) == sorted(round(x, 9) for x in (want["bad.test"], mean, mean))


def test_a_label_does_not_count_in_its_own_shares(spark):
    urls = [(f"http://h{i}.{'one' if i % 2 else 'two'}.test/", int(i % 3 == 0)) for i in range(40)]
    rows = url_filter.with_suffixes(spark.createDataFrame(urls, "url string, label int"))
    shares = url_filter.suffix_shares(rows)
    folds = {r.url: r.fold for r in rows.select("url", url_filter._fold().alias("fold")).collect()}
    got = {r.url: (r.last, r.last_two) for r in url_filter.with_shares(rows, shares, True).collect()}
    mean = sum(y for _, y in urls) / len(urls)
    for u, _ in urls:
        for k, end in enumerate((".test/", u.split(".", 1)[1])):
            others = [y for v, y in urls if v.endswith(end) and folds[v] != folds[u]]
            assert got[u][k] == pytest.approx((sum(others) + 5 * mean) / (len(others) + 5))


def test_verdicts_against_a_plain_walk_through_the_trees(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    forest, suffixes = url_filter.train(url_filter.labelled(pages, RULES))
    shares = {r.suffix: r.share for r in suffixes.where('fold < 0').collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_filter.judge(pages, RULES, forest, suffixes).collect():
        labels = [x for x in r.host.split(".") if x]
        x = url_filter.features(urls[r.page_id], shares.get(".".join(labels[-1:]), shares[""]), shares.get(".".join(labels[-2:]), shares[""]))
        assert abs(r.score - brute.walked(forest, x)) < 1e-9
        assert r.verdict == (dict(RULES)[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")


def test_trees_judge_hosts_they_have_not_seen(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    auc = url_filter.held_out_auc(url_filter.labelled(pages, RULES))
    assert auc is None or 0 <= auc <= 1
    rows = [(f"http://{'a-b-c-' if i % 3 == 0 else 'abc'}{i}.test/{i}", int(i % 3 == 0)) for i in range(600)]
    assert url_filter.held_out_auc(spark.createDataFrame(rows, "url string, label int")) > 0.9


def check_secrets(rows, texts):
    assert len(rows) == len(texts)
    want = Counter()
    for d, t in texts:
        base = brute.base_secrets(t)
        c = Counter(k for _, k, _ in base)
        want[(d, c["assign"], c["access"], c["hex"], ",".join(f"{k}:{a}:{b}" for a, k, b in base))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base) for r in rows) == want
    for r in rows:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_secret_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_secrets(secrets.scan(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert queries.op6_secrets(spark, sf_dir).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_spans_and_verdicts_of_a_whole_table(spark, sf_dir):
    """Against counting every value over all rows; planted tokens are bare, assigned, and within other tokens."""
    token = "Zx9Qw7Er5Ty3Ui1Op0As2Df4"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(90001, token, "a"), (90002, f"token={token}", "b"), (90003, f"secret: {token}.x", "c"), (90004, "Mn8Bv6Cx4Za2Lk0Jh9Gf7Ds5", None), (90005, None, None)]
    rows = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    got = {r.doc_id: (r.spans, r.verdicts) for r in rows}
    want = dict(zip([d for d, _, _ in docs], brute.secret_verdicts([(t, d, o) for d, t, o in docs]), strict=True))
    assert got == want
    assert got[90001] == ("", "token:0:24:copied") and got[90004][1] == "token:0:24:live"
    assert sum(s != "" for s, _ in got.values()) >= 3


SECRETS = ["PASSWORD = 'abcdef12' API_KEY:zzzzzz apikey=\"q/q=q.q-q\"", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A1" * 9, "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "0" * 23 + " " + "f" * 24, "token==abcdefg", "passwd \t= tabs123", "é password=ünï secret : \"0123456789abcdef0123456789abcdef\"", "secret=secret=secret123", "token: short"]


def test_secret_edges(spark):
    rows = with_nulls() + [(1000 + i, s, None, "s9", None, 1, "", 0.0, 1, 1) for i, s in enumerate(SECRETS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check_secrets(secrets.scan(docs).collect(), [(r[0], r[1]) for r in rows])
    assert secrets.scan(docs.limit(0)).count() == 0


def test_ownership_tells_examples_from_live_tokens(spark):
    example, live = "Zx9Qw7Er5Ty3Ui1Op0As2Df4", "Mn8Bv6Cx4Za2Lk0Jh9Gf7Ds5"
    rows = [(1, f"copied {example}", "a"), (2, f"copied {example}", "b"), (3, f"own {live} twice {live}", "a"), (4, f"again {live}", "a")]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] == got[2] == ""
    assert got[3] == "token:4:28,token:35:59" and got[4] == "token:6:30"


def test_copies_within_one_owner_and_of_base_kinds_are_examples(spark):
    spread, key, own = "Zx9Qw7Er5Ty3Ui1Op0As2Df4", "AKIA" + "B2" * 9, "Mn8Bv6Cx4Za2"
    many = [(i, f"copied {spread}", "a") for i in range(secrets.MOST_REPOSITORIES + 1)]
    rows = [*many, (100, key, "a"), (101, f"secret={key}", "b"), (102, f"password={own}", "a"), (103, f"api_key: {own} {own}", "a")]
    got = {r.doc_id: (r.base, r.spans, r.verdicts) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[r[0]] == ("", "", "token:7:31:copied") for r in many)
    assert got[100] == ("access:0:22", "access:0:22", "access:0:22:copied")
    assert got[101] == ("assign:0:29,access:7:29",) * 2 + ("assign:0:29:copied,access:7:29:copied",)
    assert got[102] == ("assign:0:21",) * 2 + ("assign:0:21:live",)
    assert got[103] == ("assign:0:21",) * 2 + ("assign:0:21:live",)


def test_edge_rows_have_a_secret(spark):
    got = {r.doc_id: r.n_assign for r in secrets.scan(spark.createDataFrame(edge_rows(), SCHEMA)).collect()}
    assert got[22] == 1
