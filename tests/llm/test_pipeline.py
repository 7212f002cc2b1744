import pytest

from strataloom.llm.queries import ORACLES, QUERIES
from tests.compare import duck, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(duck(small), ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet").select(*p.COLUMNS)
    docs = docs.unionByName(spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (None, "no identifier at all", "en", "s", 20)], docs.schema))
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = p.written(stage(spark, before, small), name)
        assert after.columns == p.COLUMNS and after.schema == docs.schema
        known = before.select("doc_id").distinct()
        assert after.join(known, after["doc_id"].eqNullSafe(known["doc_id"]), "left_anti").count() == 0
        if name != "mixing":
            assert after.where("doc_id in (90001, 90002) or doc_id is null").count() == 3
        before = after
    out = p.STAGES[-1][1](spark, before, small)
    assert out.count() == before.count() and out.select("shard", "slot").distinct().count() == out.count()
    none = docs.where("false")
    for _, stage in p.STAGES:
        assert stage(spark, none, small).count() == 0


def test_one_row_of_a_group_stays(spark):
    import corpus_pipeline as p

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "s", 48)] * 3 + [(2, text, "en", "t", 48), (3, "quite another text that has its own words", "en", "s", 41)] + [(None, "no identifier but words all the same", "en", "s", 36)] * 2
    docs = spark.createDataFrame(rows + [(3, "the same identifier over words of another kind", "en", "s", 46), (4, "", "en", "s", 0), (5, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in p.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [1, 3, 3, 4, 5, None]


def test_stages_with_long_texts_repeated_rows_and_other_columns(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, "
    clash = ["score", "predicted", "n_hit", "n_words", "items", "size", "taken", "copies", "shard", "slot", "cell", "set_id", "n", "component_id", "text_crc32", "row"]
    prose = " ".join(f"w{i}" for i in range(60))
    passage = " ".join(f"bench{i}" for i in range(20))
    rows = [(i, f"{prose} only{i} " + " ".join(f"{i}x{j}" for j in range(60)), "en", f"s{i % 3}", 9) for i in range(24)]
    rows += [(40, "long words " * 200_000 + "end", "en", "s0", 9), (41, passage, "en", "s1", 9), (42, rows[3][1], "en", "s2", 9), (43, None, None, None, None), (44, "", "", "", 0), (None, "no identifier but some words", "en", "s0", 9)]
    rows += [rows[5]] * 3
    docs = spark.createDataFrame([(*r, *clash) for r in rows], schema + ", ".join(f"{c} string" for c in clash))
    spark.createDataFrame([(1, passage), (None, "an item without name"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(24)] + [(None, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == p.COLUMNS and len(set(out.columns)) == len(out.columns)
        seen[name] = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    ids = sorted(r[0] if r[0] is not None else -1 for r in rows)
    assert {43, 44, 40, -1} <= set(seen["toxicity"]) and len([i for i in seen["toxicity"] if i == 5]) in (0, 4)
    assert seen["near_duplicates"] == sorted(set(ids) - {42})
    assert seen["decontamination"] == sorted(i for i in ids if i != 41)
    assert set(seen["mixing"]) <= set(ids) and 40 in seen["mixing"]
    assert seen["sharding"] == ids
