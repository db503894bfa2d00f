"""Clashing columns, repeated rows, ties and very long inputs of the operators on pages, and very long texts in the pipeline."""

import collections

import pytest

from fieldloom.llm.url_filter import url_filter
from fieldloom.llm.warc_revisit import resolve_revisits

CLASH = "id long, canonical string, slice long, line string, full string, near string, carried string, of string, status string, refers_to long"
CAPTURE = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string"


def test_revisits_with_clashing_columns_repeated_rows_and_ties(spark):
    rows = [
        (1, "a.com/x", 10, "response", {"etag": "e1"}, "D1"), (2, "a.com/x", 10, "response", {"etag": "e2"}, "D2"), (3, "a.com/x", 10, "revisit", {"etag": "e2"}, None),
        (3, "a.com/x", 10, "revisit", {"etag": "e2"}, None), (4, "a.com/x", 11, "revisit", {"etag": "e1"}, None), (1, "b.com", 10, "response", None, None), (1, "b.com", 10, "response", None, None),
        (5, "b.com/", 12, "revisit", None, None), (6, "c.com/" + "y" * 100_000, 1, "response", {"etag": "z" * 50_000}, "D6"), (7, "c.com/" + "y" * 100_000, 2, "revisit", {"etag": "W/" + "z" * 50_000}, None), (None, "a.com/x", 9, "revisit", {}, None),
    ]
    extra = (9, "c", 9, "l", "f", "n", "c", "o", "s", 9)
    plain = spark.createDataFrame(rows, CAPTURE)
    wide = spark.createDataFrame([(*r, *extra) for r in rows], f"{CAPTURE}, {CLASH}")
    key = lambda df: collections.Counter((r.record_id, r.ts, r.status, r.refers_to, r.digest) for r in df.collect())
    want = collections.Counter({
        (1, 10, "full", None, "D1"): 1, (2, 10, "full", None, "D2"): 1, (3, 10, "resolved", 2, "D2"): 2, (4, 11, "mismatch", 2, None): 1, (1, 10, "full", None, None): 2,
        (5, 12, "mismatch", 1, None): 1, (6, 1, "full", None, "D6"): 1, (7, 2, "resolved", 6, "D6"): 1, (None, 9, "orphan", None, None): 1,
    })
    assert key(resolve_revisits(plain)) == want == key(resolve_revisits(wide.repartition(4))) == key(resolve_revisits(plain, slice_seconds=1))


def test_url_filter_with_clashing_columns_and_long_pages(spark):
    link = lambda *h: "".join(f'<a href="https://{x}/p">x</a>' for x in h)
    long = link("good.org") + "<p>word</p>" * 200_000 + link("b.net")
    rows = [(1, "http://a.org/x", long), (2, "http://b.net/es/1", ""), (3, "http://good.org/z", None), (4, "http://" + "h" * 50_000 + ".org/" + "p" * 50_000, ""), (2, "http://b.net/es/1", ""), (5, None, long)]
    extra = ("h", "p", "r", "v", 1, 0.5, 2, "s", "t", 0.1)
    names = "host string, path string, rule string, verdict string, id long, score double, node long, src string, dst string, rank double"
    wide = spark.createDataFrame([(*r, *extra) for r in rows], f"page_id long, url string, html string, {names}")
    key = lambda df: collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())
    got = key(url_filter(wide.repartition(3)))
    assert sum(got.values()) == 6
    assert got[2, "b.net", "/es/1", "net/es/", "block"] == 2 and (5, "", "", None, "allow") in got and any(k[0] == 4 and len(k[1]) == 50_004 and len(k[2]) == 50_001 for k in got)


def test_very_long_texts_go_through_every_stage(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = lambda seed, n: " ".join(f"w{seed}x{i * 7919 % 100_003}" for i in range(n))
    item = "Which river runs through the old town of the seven bridges in the north? It is the silver Alder river there."
    texts = [(1, words(1, 60_000)), (2, words(1, 60_000) + " tail"), (3, words(7, 40_000) + f" {item} " + words(9, 20_000)), (4, "x" * 400_000), (5, "short text of a few words that is clean"), (6, None), (7, words(13, 30_000))]
    spark.createDataFrame([(100 + i, 1, int(i % 2 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept == [{1, 2, 3, 4, 5, 6, 7}, {1, 3, 4, 5, 6, 7}, {1, 4, 5, 6, 7}]
    mixed = pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= kept[-1] and {len(r.text) for r in mixed.select("text").collect() if r.text} <= {len(t) for _, t in texts if t}
