"""Each stage of the pipeline on a small table, against a plain version of its decision, and edge cases of all of them."""

import collections
import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and benchmark; labelled texts are in the documents too."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


ITEM = "Which river runs through the old town of the seven bridges in the north? It is the silver Alder river there."
RNG = random.Random(1)


def own(i, n=40):
    return " ".join(f"q{i * 100 + k}" for k in range(n))


ROWS = [(i, f"{own(i)} " + ("you utter moron go" if i % 4 == 0 else f"thing{i % 29} goes on") + f" word{i % 13} ends") for i in range(200)]
ROWS += [(300, own(300)), (300, own(301)), (None, own(302)), (None, own(302)), (None, own(303) + " you utter moron go word3 ends"), (301, None), (302, ""), (303, own(304, 60)), (304, own(304, 60) + " tail"), (305, f"{own(305)} {ITEM.upper()} {own(306)}"), (300, f"{own(307)} {ITEM}")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 1, "clash") for i, t in rows], SCHEMA)


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_toxic_rows_go_and_others_under_their_id_stay(spark, folder):
    out = pipeline.clean_language(spark, table(spark, ROWS), folder)
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    assert rows_of(out) == collections.Counter((i, t) for i, t in ROWS if "moron" not in (t or ""))


def test_one_row_of_each_group_stays(spark, folder):
    rows = ROWS[200:]
    out = rows_of(pipeline.near_duplicates(spark, table(spark, rows), folder))
    want = collections.Counter()
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if not any(sets(t) and len(sets(t) & sets(u)) >= 0.8 * len(sets(t) | sets(u)) for _, u in want):
            want[(i, t)] = 1
    assert out == want and (304, own(304, 60) + " tail") not in out and (300, own(301)) in out


def test_leaks_go_and_others_under_their_id_stay(spark, folder):
    rows = ROWS[200:]
    assert rows_of(pipeline.decontaminated(spark, table(spark, rows), folder)) == collections.Counter((i, t) for i, t in rows if "alder river there" not in (t or "").lower())


def test_the_mixture_repeats_rows_and_their_ids_are_written(spark, folder):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = table(spark, ROWS[:40])
    out = pipeline.mixed(spark, docs, folder)
    got = rows_of(out)
    assert set(got) <= set(ROWS[:40]) and max(got.values()) <= 3 and out.columns == docs.columns
    total = sum(len(t.split()) for _, t in ROWS[:40])
    assert abs(sum(n * len(t.split()) for (_, t), n in got.items()) - total) < 0.1 * total
    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    ids = pipeline.token_ids(spark, out, folder).orderBy("start").collect()
    for r, (i, text) in zip(ids, sorted(got.elements())):
        n = len(t.encode(text, add_special_tokens=False).ids) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, n)
        start += n
    assert len(ids) == sum(got.values())


def test_empty_documents(spark, folder):
    for _, stage in pipeline.STAGES:
        assert stage(spark, table(spark, []), folder).count() == 0
