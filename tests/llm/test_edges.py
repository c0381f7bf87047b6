"""Nulls, empty and long texts, repeats, empty tables and clashing names through every operator and stage."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from snaptide.llm import bloom_cascade, ecoc_lang, latent_decontam, line_dedup, page_diff, pareto_mix, quality_rules, secret_link, simhash_pivots


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, None), (None, "of which no document has a word quux " * 3), (3, ""), (4, "too short"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_quality_rules(odd, none):
    got = [(r.doc_id, r.keep, r.broken) for r in quality_rules.measured(odd).collect()]
    assert len(got) == 11 and sum(k for _, k, _ in got) == len(quality_rules.kept(odd).collect())
    assert {i: b for i, _, b in got if i in (2, 3, 4)} == {2: "n_chars|n_words", 3: "n_chars|n_words", 4: "n_words"}
    assert [k for i, k, _ in got if i == 1] == [True, True]
    assert "distinct_word_ratio" in dict((i, b) for i, _, b in got)[7]
    assert quality_rules.kept(odd).columns == odd.columns
    assert quality_rules.measured(none).count() == 0 and quality_rules.kept(none).count() == 0


def test_line_dedup(spark, odd, none):
    out = line_dedup.deduped(odd, least_pages=2, ratio=0.1)
    rows = {(r.doc_id, r.source): r for r in out.collect()}
    assert out.count() == 11 and rows[(2, "a")].text is None and rows[(2, "a")].n_chars is None
    assert rows[(1, "a")].n_dropped == 0 and rows[(1, "a")].text  # a text and its copies are one page
    assert rows[(4, None)].text == " \n\t\n "
    assert line_dedup.stage(odd).columns == odd.columns and line_dedup.stage(odd).count() == 11
    assert line_dedup.deduped(none).count() == 0
    # on a host of four pages a line of three goes, with a page that had no other; one of two stays
    texts = ["menu\none", " menu \ntwo\ntwice", "menu\n\n", "three\ntwice", "menu\none", "menu\none"]
    pages = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in enumerate(texts)], none.select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.stage(pages).collect()}
    assert got == {0: ("one", 3), 1: ("two\ntwice", 9), 3: ("three\ntwice", 11), 4: ("one", 3), 5: ("one", 3)}


def test_simhash(odd, none):
    rows = simhash_pivots.grouped(odd).collect()
    assert len(rows) == 11
    assert sorted(r.keep for r in rows if r.doc_id == 1) == [False, False]  # the row without id is a near copy and sorts first
    assert all(r.keep for r in rows if r.doc_id in (2, 3, 4))
    kept = simhash_pivots.kept(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.keep for r in rows)
    only = odd.filter("doc_id = 1")
    assert simhash_pivots.kept(only).count() == 1  # of repeated rows one stays
    assert simhash_pivots.grouped(none).count() == 0 and simhash_pivots.kept(none).count() == 0


def test_decontamination(odd, none, bench):
    assert latent_decontam.contaminated(odd, bench).count() == 0
    kept = latent_decontam.kept(odd, bench)
    assert kept.count() == 11 and kept.columns == odd.columns
    assert latent_decontam.contaminated(none, bench).count() == 0
    assert latent_decontam.kept(odd, bench.limit(0)).count() == 11


def test_mixing(odd, none):
    out = pareto_mix.mixed(odd)
    rows = out.collect()
    assert {r.source for r in rows} <= {"a", "b", "c", None} and len(rows) == 11
    assert sorted(out.columns) == sorted(odd.columns)
    assert pareto_mix.mixed(none).count() == 0
    assert pareto_mix.mixed(odd, weights={}).count() == 0
    only = pareto_mix.mixed(odd, weights={"c": 1.0}, total=9).collect()
    assert len(only) == 9 and {r.source for r in only} == {"c"}
    tiny = pareto_mix.mixed(odd, weights={"a": 1.0, "c": 1e-9, "b": 0.0}, total=1000)
    assert {r.source: r["count"] for r in tiny.groupBy("source").count().collect()} == {"a": 1000}
    assert pareto_mix.scaled({"a": 1.0, "c": 1e-9, None: 1e-20}) == [("a", 1 << 40), ("c", 1100), (None, 1)]
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            pareto_mix.scaled({"a": bad})


@pytest.mark.parametrize("most", [1, 3])
def test_mixing_gives_what_is_due(spark, most):
    """Exactly the due copies of every source, with rows that repeat and sizes of no sense; and none too often."""
    rng = random.Random(most)
    weights = {f"s{k}": rng.choice([0.1, 1.0, 1.0, 7.5]) for k in range(60)}
    rows = [(rng.randrange(rng.choice([1, 4, 50])), s, rng.choice([None, -5, -1, 0, 3, 3, 1000])) for s in weights for _ in range(rng.randrange(1, 14))]
    n = Counter(s for _, s, _ in rows)
    got, each = Counter(), Counter()
    for r in pareto_mix.mixed(spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint"), weights, 500, most_copies=most).collect():
        got[r.source] += 1
        each[r.source] = max(each[r.source], r.copy)
    assert got.total() == 500
    for s, w in weights.items():
        assert abs(got[s] - 500 * w / sum(weights.values())) < 1 and each[s] <= max(most, -(-got[s] // n[s]))


def test_mixing_cuts_ties(spark):
    """Six equal rows and one more, two copies due."""
    docs = spark.createDataFrame([(1, "a", 5)] * 6 + [(2, "a", 9)], "doc_id bigint, source string, n_chars bigint")
    for seed in "c":
        for total in (1, 2):
            assert pareto_mix.mixed(docs, {"a": 1.0}, total, seed=seed).count() == total


def test_language(odd, none):
    rows = {r.doc_id: r for r in ecoc_lang.identified(odd).collect()}
    assert len(rows) == 9 and rows[2].predicted is None and rows[2].ambiguous and rows[10].predicted is None
    assert ecoc_lang.identified(none).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(9, 1)).filter("lang is null")
    assert all(r.ambiguous for r in ecoc_lang.identified(unlabelled).collect())


def test_secrets(odd, none):
    rows = secret_link.linked(odd).collect()
    assert [(r.doc_id, r.secret_kind, r.part) for r in rows] == [(9, "secret", None)]
    assert secret_link.linked(none).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://A.example/x/1", "<p>one<p>two"), (2, "http://a.example/x/2", "<p>one<p>three"), (2, "http://a.example/x/2", "<p>one<p>three"), (3, None, "<p>alone"), (4, "nonsense", None), (None, "http://b.example", ""), (6, "https://www.c.example:80/p?q#f", "<p>" * 5000 + "long " * 50_000)]
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], "page_id bigint, url string, html string, host string, lines string, text string, blocked int")


def test_pages(pages):
    rows = page_diff.extracted(pages).collect()
    texts = [(r.page_id, r.text[:9]) for r in rows]
    assert texts == [(1, "two"), (2, "three"), (2, "three"), (3, "alone"), (4, ""), (None, ""), (6, "long long")]
    assert page_diff.extracted(pages.limit(0)).count() == 0


def test_url_filter(spark, pages):
    listing = spark.createDataFrame([("h:b.example",), ("h:b.example",), (None,), ("u:a.example/x/2",), ("h:elsewhere",)], "key string")
    rows = sorted((r.page_id or 0, r.host_listed, r.url_listed, r.blocked) for r in bloom_cascade.filtered(pages, listing).collect())
    assert rows == [(0, True, False, True), (1, False, False, False), (2, False, True, True), (2, False, True, True), (3, False, False, False), (4, False, False, False), (6, False, False, False)]
    assert bloom_cascade.filtered(pages.limit(0), listing.limit(0)).count() == 0
    assert not any(r.blocked for r in bloom_cascade.filtered(pages, listing.limit(0)).collect())


def test_stages_take_odd_rows_and_empty_tables(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (odd, none):
            out = stage(spark, table, sf)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == table.columns
            out.count()


def test_names_of_any_kind(spark, odd):
    """Columns with dots, back quotes, capitals and the operators' own inner names, through all stages."""
    names = ["a.b", "x`y", "c0", "c1", "__st_text", "__st_q", "__st_lines", "again", "id", "sig", "times", "left", "cut", "gone", "made", "tokens", "e", "u", "q", "of", "num", "most", "Bound", "h", "row", "is it?"]
    rows = [(*r[:5], *range(len(names))) for r in odd.collect()]
    table = spark.createDataFrame(rows, ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint"] + [f"`{n.replace('`', '``')}` int" for n in names]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, "/root/testdata/sf0.001")
        got = out.collect()
        assert out.columns == table.columns + ["copy"] * (name == "mix") and got
        assert {tuple(r)[5 : 5 + len(names)] for r in got} == {tuple(range(len(names)))}


@pytest.mark.parametrize("limit", ["checked_broadcast"])
def test_shuffled_joins(spark, monkeypatch, pages, limit):
    """What is joined where a side is too large to broadcast is the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    runs = [lambda: pareto_mix.mixed(docs).select("doc_id", "copy"), lambda: line_dedup.deduped(docs, ratio=0.01).select("doc_id", "n_dropped"), lambda: page_diff.extracted(pages).select("page_id", "text")]
    before = [sorted(map(str, run().collect())) for run in runs]
    for module in (pareto_mix, line_dedup, page_diff):
        monkeypatch.setattr(module, limit, lambda df, width: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [sorted(map(str, run().collect())) for run in runs] == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder(spark):
    """The session's setting is read, and never set; without it a folder of the machine serves, but on no cluster."""
    from types import SimpleNamespace

    from snaptide.llm.common import shared_dir

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(applicationId="none", master="local[4]"))
    assert shared_dir(unset).startswith("file:///") and shared_dir(unset) == shared_dir(unset)
    unset.sparkContext.master = "local-cluster[3,2,1000]"
    with pytest.raises(ValueError):
        shared_dir(unset)
    there = spark.conf.get("spark.checkpoint.dir", None)
    assert not there or shared_dir(spark).endswith(there.split(":")[-1].lstrip("/").rstrip("/"))
