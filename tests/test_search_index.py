"""The saved index against the index that is made anew."""

from graphloom.operators import search
from graphloom.operators.search import SavedIndex

NODES = "id long, name string, fqn string, filePath string, summary string"


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_updates_equal_a_new_index(spark, tmp_path):
    words = ["order", "orders", "ordinal", "service", "zebra", "x9", "zz"]
    rows = [(i, f"{words[i % 7]}{words[(i * 3) % 5]} {words[(i + 2) % 7]}", f"com.{words[i % 5]}.X", None if i % 4 else "", "") for i in range(60)]
    index = SavedIndex(spark, str(tmp_path / "i"))
    for step in range(12):  # beyond the number of segments
        rows = [r if r[0] % 12 != step else (r[0], f"{words[step % 7]} new", None, r[3], f"order {step}") for r in rows if r[0] != step * 2 + 1]
        rows.append((100 + step, "zz order", None, None, None))
        n = spark.createDataFrame(rows, NODES)
        index = index.update(n)
        for q in ("ord", "ord ser", "ORDER, new", "zz", "z", "x9 com", "none", "", "order order"):
            assert _rows(index.search(q, 100)) == _rows(search.search(n, q, 100)), (step, q)
    assert len(index.live["segments"]) <= search.SEGMENTS
    version = index.version
    assert index.update(n).version == version, "nothing has changed"
    assert _rows(SavedIndex(spark, str(tmp_path / "i")).search("ord")) == _rows(search.search(n, "ord"))


def test_a_term_reads_its_range_and_no_text(spark, tmp_path):
    n = spark.createDataFrame([(i, f"t{i}", "f", "p", "s") for i in range(100)], NODES)
    index = SavedIndex(spark, str(tmp_path / "i")).update(n)
    plan = index.search("t9")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,t9)" in plan and "LessThan(token,t:)" in plan and "summary" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_empty_and_null(spark, tmp_path):
    index = SavedIndex(spark, str(tmp_path / "i")).update(spark.createDataFrame([], NODES))
    assert _rows(index.search("a")) == []
    n = spark.createDataFrame([(None, "a b", None, None, None), (1, None, None, None, None), (2, "a", "a", None, None)], NODES)
    index = index.update(n)
    assert sorted(_rows(index.search("a")), key=str) == [(2, 2), (None, 1)]
