import duckdb
from brute import awkward, documents, words
from orrery.llm import quality
from orrery.llm.catalogue import QUERIES
from conftest import SMALL

EXTRA = [(60, "line\nline\n \nline\nother"), (61, "# a $$ b | <c> " * 10), (62, "THE OF AND SHOUT " * 8), (63, "x...\n- y…\n* z"), (64, "a b c d e f g h a b c d e f g h i a")]


def repeated(text):
    w = words(text)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i:i + 8]), []).append(i)
    return len({j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_awkward_rows(spark):
    rows = awkward(EXTRA)
    out = quality.judge(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for r in rows:
        if r[0] is not None:
            w = words(r[1])
            x = by_id[r[0]]
            assert (x.n_words, x.word_chars, x.n_repeat_words) == (len(w), sum(map(len, w)), repeated(r[1]))
            assert x.n_symbols == sum((r[1] or "").count(c) for c in "#*$%&|<>")
            lines = [n for n in (r[1] or "").split("\n") if words(n)]
            assert x.n_dup_lines == len(lines) - len(set(lines))
            assert x.base_failed == (len(w) < 20 or 100 * repeated(r[1]) > 30 * len(w))
            assert not (x.base_failed and x.kept)
    assert not by_id[61].kept and not by_id[62].kept


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    want = con.execute(quality.ORACLE)
    names = [c[0] for c in want.description]
    out = QUERIES["op5_quality_rules"](spark, SMALL)
    assert sorted(out.columns) == sorted(names)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(want.fetchall())


def test_labelled_texts(spark):
    out = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept OR base_failed").count() >= 0.99 * good.count()
    assert bad.where("NOT kept").count() >= 0.95 * bad.count()


def test_empty_table(spark):
    assert quality.judge(documents(spark, awkward()).limit(0)).count() == 0
