"""The pipeline, stage by stage, on a small corpus with planted cases."""

import numpy as np
import corpus_pipeline as P
from casewise.llm import queries


def test_names_and_sql():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeats", "secrets", "packing"]


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(900)]
    text = lambda n=120: " ".join(rng.choice(words, n))
    passage = " ".join(f"shared{k}" for k in range(60))
    data = [(i, text() + (" nasty vile" if i % 10 == 0 else ""), "en", "s", 1) for i in range(400)]
    data += [(1000, data[1][1], "en", "s", 1), (1001, data[2][1].replace(" ", " ", 1) + " tail", "en", "s", 1), (1002, text() + " " + passage + " " + text(), "en", "s", 1), (1003, text() + " " + passage + " " + text(), "en", "s", 1), (1004, text() + " password=0123456789abcdef01 " + text(), "en", "s", 1), (1005, None, "en", "s", 0), (1006, "", "en", "s", 0)]
    data += [(2000 + k, text() + f" card 4{k:015d} key AKIA{k:016d} " + text(), "en", "s", 1) for k in range(30)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf, docs, kept = f"file://{tmp_path}", None, {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, sf), name)
        assert docs.columns == P.COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
    toxic, near, cut, red = (kept[n] for n, _ in P.STAGES[:-1])
    assert sum(i in toxic for i in range(0, 400, 10)) <= 4 and sum(i in toxic for i in range(400) if i % 10) >= 355
    assert 1000 not in near and 1001 not in near and {1, 2, 1002, 1003, 1005, 1006} <= set(near)
    assert passage in cut[1002].text and "shared30" not in cut[1003].text and cut[1003].n_chars == len(cut[1003].text)
    assert "0123456789abcdef01" in cut[1004].text and "[SECRET]" in red[1004].text and "0123456789abcdef01" not in red[1004].text
    packed = P.pack(spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(red)


def test_near_duplicates_go_by_row(spark):
    base, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    near = base.replace("word30", "x")
    data = [(1, base), (5, base), (5, other), (7, other + " end"), (8, "few words"), (8, "few words"), (None, near), (None, "alone"), (None, "alone"), (9, None), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.drop_near_duplicates(spark, docs, "").collect()
    assert sorted([(r.doc_id, r.text) for r in out], key=str) == sorted([(1, base), (5, other), (8, "few words"), (None, "alone"), (9, None), (10, "")], key=str)


def test_stages_take_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
