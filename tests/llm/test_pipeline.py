"""The pipeline's stages on the smallest driver tables against brute-force forms, each on its own input, and the whole of it."""

import os

import pytest
from test_operators import WORD, brute_groups, brute_hits

import corpus_pipeline

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def kept_by_brute_force(spark, rows):
    """What the join and decontamination leave of rows."""
    first = {d for d, _, least in brute_groups(rows, 5, 80) if d == least}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [r for r in rows if r[0] in first]
    return first, {d for d, n, hit, _ in brute_hits(left, items) if not (hit and 20 * hit >= n)}


def test_language_stage_drops_what_has_no_letter_and_little_else(spark, docs):
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == docs.columns
    kept = {d for d, _ in texts(out)}
    lettered = {d for d, t in texts(docs) if any(c.isalpha() for c in t or "")}
    assert kept <= lettered and len(kept) > 0.9 * len(lettered)


def test_join_stage_keeps_the_first_of_each_group(spark, docs):
    out = corpus_pipeline.deduplicated(spark, docs, SF)
    assert out.columns == docs.columns
    assert {d for d, _ in texts(out)} == kept_by_brute_force(spark, texts(docs))[0]


def test_join_stage_counts_a_repeated_id_once(spark, docs):
    out = corpus_pipeline.deduplicated(spark, docs.unionByName(docs.limit(7)), SF)
    ids = [d for d, _ in texts(out)]
    assert len(ids) == len(set(ids)) and set(ids) == kept_by_brute_force(spark, texts(docs))[0]


def test_join_stage_decides_per_row(spark):
    """Null ids and one id with two texts: what is in no group stays, and of each group one row does."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    near = text("a") + " more"
    rows = [("1", text("a")), (None, near), (None, text("b")), (None, text("c")), ("2", text("d")), ("2", text("e")), ("3", text("f")), ("2", text("f")), ("3", text("g"))]
    rows += [(None, text("h")), (None, text("h")), ("4", text("i")), ("4", text("i")), ("5", None), (None, ""), (None, None)]
    made = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id string, text string, lang string, source string, n_chars long")
    gone = [(None, near), ("3", text("f")), (None, text("h")), ("4", text("i"))]
    for x in gone:
        rows.remove(x)
    assert sorted(map(str, texts(corpus_pipeline.deduplicated(spark, made, SF)))) == sorted(map(str, rows))


def test_decontamination_stage_drops_by_the_share_of_hit_words(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, n, hit, _ in brute_hits(texts(docs), items) if not (hit and 20 * hit >= n)}
    assert {d for d, _ in texts(corpus_pipeline.cleared(spark, docs, SF))} == want


def test_whole_pipeline(spark, docs):
    judged = corpus_pipeline.classified(spark, corpus_pipeline.language(spark, docs, SF), SF)
    want = kept_by_brute_force(spark, texts(judged))[1]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == want
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    text = dict(texts(docs))
    by_doc = {}
    for r in sorted(got, key=lambda r: r["start"]):
        by_doc.setdefault(r["doc_id"], []).extend(r["ids"])
    assert all(ids == [*library.encode(text[d] or "", add_special_tokens=False).ids, 2] for d, ids in by_doc.items())


def test_stages_take_no_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_words_of_the_brute_force_are_the_contracts():
    assert WORD.findall("Über a-b 1".encode().lower()) == ["Über".encode(), b"a", b"b", b"1"]
