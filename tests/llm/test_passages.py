import pytest

from sitelens.llm import decontaminate

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean plain quarry ridge shore tarn upland vale weir yard".split()


@pytest.mark.parametrize("bound", [8 << 20, 0])
def test_part_of_an_item_and_slots(spark, bound):
    item = " ".join(f"{w}{x}" for x in ("a", "b", "c") for w in WORDS)
    table = "12 kg 400 g 7 ml Paris Oslo 31 cm 5 km 88 mm Rome 3 h 19 min 64 kg 2 t"
    items = spark.createDataFrame([(1, item), (2, "see " + table)], "item_id bigint, text string")
    docs = [(1, "before that " + " ".join(item.split()[20:48]) + " and after"), (2, "so see " + table), (3, "so see " + table.replace("1", "5").replace("4", "6")), (4, "before " + " ".join(item.split()[20:32]) + " after")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items, small_bytes=bound).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2)]
