from brute import awkward, by_text, contaminated, documents
from conftest import SMALL
from orrery.llm import decontam
from orrery.llm.catalogue import QUERIES

ITEMS = [("a", " ".join(f"w{i}" for i in range(20))), ("b", "ONE, two!"), ("c", None), ("d", "..."), (None, "three four"), ("e", "é à"), ("a", "rep eat rep eat")]


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = contaminated([(r.doc_id, r.text) for r in docs], [(str(r.item_id), r.text) for r in items])
    assert by_text(tuple(r) for r in QUERIES["op8_decontamination"](spark, SMALL).collect()) == by_text(want)


def test_awkward_rows_and_parts(spark):
    rows = awkward()
    docs, bench = documents(spark, rows), spark.createDataFrame(ITEMS, "item_id string, text string")
    want = by_text(x[:4] + x[5:] for x in contaminated([(r[0], r[1]) for r in rows], ITEMS))
    for chars in (decontam.TABLE_CHARS, 30):  # one broadcast table, and one for each few items
        out = decontam.decontaminate(docs, bench, table_chars=chars).collect()
        assert by_text((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), r.contaminated) for r in out) == want
    clean = decontam.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)


def test_empty_tables(spark):
    docs, bench = documents(spark, awkward()), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
