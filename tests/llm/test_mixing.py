import re

import duckdb

from panelith.llm import mixing


def make(spark):
    rows = [(k, "w " * (k % 17), f"s{k % 5}" if k % 7 else None, 1) for k in range(3000)]
    rows += [(10_000 + k, "only few", "rare", 1) for k in range(5)] + [(20_000, None, "empty", 1), (20_001, "", "empty", 1), (None, "no id", "s1", 1), (7, "w w", "s2", 1), (7, "w w", "s2", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_against_sorting_in_sql(spark):
    rows, df = make(spark)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.execute("create table d as select cast(doc_id as bigint) as doc_id, text, source from documents")
    want = con.sql(mixing.ORACLE.replace("FROM documents", "FROM d")).fetchall()
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: (str(r[0]), *(round(float(x), 6) for x in r[1:]))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_targets_and_totals(spark):
    rows, df = make(spark)
    got = mixing.mix(df).collect()
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r["source"]: r["source_size"] for r in got} == size
    target = {r["source"]: r["target"] for r in got}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(target[s] <= 3 * size[s] + 1e-9 for s in size)
    for s in size:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 17
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_rows_are_repeated(spark):
    rows, df = make(spark)
    out = mixing.apply(df)
    assert out.columns == df.columns
    want = sum(r["times"] for r in mixing.mix(df).collect())
    assert out.count() == want
    assert mixing.apply(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_columns_of_any_name_come_back(spark):
    rows, df = make(spark)
    names = ["mix_h", "mix_n", "mix_times", "mix_s", "__h", "h", "takes"]
    for k, c in enumerate(names):
        df = df.withColumn(c, df["doc_id"] + k)
    out = mixing.apply(df)
    assert out.columns == df.columns
    for r in out.select("doc_id", *names).distinct().collect():
        assert [r[c] for c in names] == [None if r["doc_id"] is None else r["doc_id"] + k for k in range(len(names))]
