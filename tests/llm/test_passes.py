"""A benchmark of many passes: each ends before the next one begins."""

from studyplane.llm import decontaminate


def test_passes_are_written_one_after_the_other(spark, monkeypatch):
    r = [" ".join(f"w{(i * 31 + k * 7) % 500}" for k in range(20)) for i in range(40)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(r)] + [(100, None), (101, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(r)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.decontaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 400)
    out = decontaminate.decontaminated(docs, items)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(map(tuple, out.collect())) == whole and any(x[2] for x in whole)
