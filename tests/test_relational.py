"""Registered queries against DuckDB, and operators on small fixtures."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import arrays, checked, jsons, numbers, patterns, search, strings, times
from tessera.functions.sequences import Sequences
from tessera.operators import asof, constraints, dml, frames, policies, quantified, routines, rows, statistics
from tessera.plans import registry
from tessera.sources import files
from tessera.sources.tables import TABLES
from tessera.streaming import changes

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat().replace("T00:00:00", "")
    return v if isinstance(v, bool) else str(v)


def bag(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert bag(got.select(*columns).collect()) == bag(want.fetchall())


@pytest.fixture
def emp(spark):
    return spark.createDataFrame([(1, "A", 100), (2, "A", 200), (3, "A", 300), (4, "B", 100), (5, "B", 200), (6, "A", 200)], "id int, dept string, salary int")


def test_exclude(emp):
    got = {r.id: r.total for r in frames.excluding(emp, ["dept"], "salary", "salary", "GROUP").collect()}
    assert got == {1: 700, 2: 400, 3: 500, 4: 200, 5: 100, 6: 400}
    got = {r.id: r.total for r in frames.excluding(emp, ["dept"], "salary", "salary", "TIES").collect()}
    assert got[2] == got[6] == 600
    got = {r.id: r.best for r in frames.extreme_excluding_current(emp, ["dept"], "salary").collect()}
    assert got == {1: 300, 2: 300, 3: 200, 4: 200, 5: 100, 6: 300}


def test_groups_frame(emp):
    got = {r.id: r.s for r in frames.groups_frame(emp, ["dept"], F.col("salary"), Window.unboundedPreceding, 0, s=F.sum("salary")).collect()}
    assert got == {1: 100, 2: 500, 6: 500, 3: 800, 4: 100, 5: 300}


def test_quantified_nulls(spark):
    outer = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    inner = spark.createDataFrame([(1,), (None,)], "y int")
    values = lambda df: sorted(r.x for r in df.collect() if r.x is not None)
    assert values(quantified.compare_any(outer, "x", ">", inner, "y")) == [2]
    assert values(quantified.compare_all(outer, "x", ">=", inner, "y")) == []
    assert quantified.compare_all(outer, "x", ">", inner.limit(0), "y").count() == 3
    assert quantified.not_in(outer, "x", inner, "y").count() == 0
    assert values(quantified.not_in(outer, "x", inner.dropna(), "y")) == [2]
    assert quantified.not_in(outer, "x", inner.limit(0), "y").count() == 3


def test_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, None)], "id int, k int")
    assert sorted(r.id for r in rows.fetch_with_ties(df, 1, "k").collect()) == [1, 2]
    assert sorted(r.id for r in rows.fetch_with_ties(df, 1, "k", ascending=False).collect()) == [4]
    assert sorted(r.id for r in rows.fetch_with_ties(df, 2, "k", ascending=False).collect()) == [3, 4]
    assert rows.fetch_with_ties(df, 9, "k").count() == 4


def test_dml(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, val int")
    s = spark.createDataFrame([(2, 99), (4, 40)], "id int, val int")
    pairs = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert pairs(dml.insert(t, spark.createDataFrame([(7,)], "id int"), {"val": F.lit(5)})) == [(1, 10), (2, 20), (3, None), (7, 5)]
    assert pairs(dml.insert_or_nothing(t, s, ["id"])) == [(1, 10), (2, 20), (3, None), (4, 40)]
    assert pairs(dml.upsert(t, s, ["id"])) == [(1, 10), (2, 99), (3, None), (4, 40)]
    assert pairs(dml.upsert(t, s, ["id"], {"val": F.col("t.val") + F.col("excluded.val")})) == [(1, 10), (2, 119), (3, None), (4, 40)]
    with pytest.raises(dml.CardinalityError):
        dml.upsert(t, s.union(s), ["id"])
    assert pairs(dml.update(t, {"val": F.lit(0)}, F.col("val") > 10)) == [(1, 10), (2, 0), (3, None)]
    assert pairs(dml.update_from(t, s, {"id": "id"}, {"val": F.col("s.val")}, [F.col("val")])) == [(1, 10), (2, 99), (3, None)]
    assert pairs(dml.delete(t, F.col("val") > 10)) == [(1, 10), (3, None)]
    assert pairs(dml.delete_using(t, s, {"id": "id"})) == [(1, 10), (3, None)]
    assert pairs(dml.merge(t, s, {"id": "id"}, {"val": F.col("s.val") + 1}, {"id": F.col("s.id"), "val": F.col("s.val")})) == [(1, 10), (2, 100), (3, None), (4, 40)]
    assert pairs(dml.merge(t, s, {"id": "id"}, "delete")) == [(1, 10), (3, None)]
    with pytest.raises(dml.CardinalityError):
        dml.merge(t, s.union(s), {"id": "id"}, "delete")
    assert dml.truncate(t).count() == 0


def test_constraints_and_statistics(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b"), (None, "b")], "id int, tag string")
    assert [r.id for r in constraints.duplicate_keys(t, ["id"]).collect()] == [1]
    assert constraints.orphans(t, "id", spark.createDataFrame([(2,)], "k int"), "k").count() == 2
    assert constraints.failing(t, F.col("id") > 1).count() == 2
    assert constraints.nulls(t, "id").count() == 2
    assert statistics.column_statistics(t, "id").first().ndistinct == 1
    assert statistics.most_common(t, "tag", 1).first().frequency == 0.75
    assert statistics.dependency_degree(t, "id", "tag").first().degree == 0.5


def test_files(spark, tmp_path):
    t = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "id int, s string")
    files.into_outfile(t, f"file://{tmp_path}/out")
    assert sorted(files.load_data(spark, f"file://{tmp_path}/out", t.schema).collect()) == sorted(t.collect())
    assert files.large_objects(spark, f"file://{tmp_path}/out/*.csv").count() >= 1
    assert {r.column_name for r in files.information_schema_columns(spark, {"t": t}).collect()} == {"id", "s"}
    assert files.inherited(t, t.withColumn("more", F.lit(1))).count() == 4
    assert [r.part for r in files.partition_of(t, "range", "id", [2, 5]).orderBy("id").collect()] == [0, 1]
    assert [r.part for r in files.partition_of(t, "list", "id", [[7], [2]]).orderBy("id").collect()] == [-1, 1]


def test_sequences(spark):
    s = Sequences()
    s.create("a", 10, 5)
    with pytest.raises(LookupError):
        s.currval("a")
    assert (s.nextval("a"), s.currval("a"), s.lastval()) == (10, 10, 10)
    got = s.number(spark.range(100).withColumn("k", 100 - F.col("id")), "a", "n", "k").orderBy("k").collect()
    assert [r.n for r in got] == [15 + 5 * i for i in range(100)]
    assert s.nextval("a") == 515


def test_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(f"file://{tmp_path}/e")
    stream = changes.windowed(spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/e"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert bag(spark.table("w").collect()) == bag(changes.windowed(e).collect())
    feed = spark.createDataFrame([(1, True, "t", "insert"), (2, False, "t", "insert"), (3, True, "u", "delete")], "lsn long, committed boolean, table string, op string")
    assert [r.lsn for r in changes.peek(changes.published(feed), 1).collect()] == [3]
    assert changes.published(feed, ["t"]).count() == 1


def test_routines(spark):
    c = routines.Cursor(spark.range(10).orderBy("id"))
    assert ([r.id for r in c.fetch(2)], c.move(3), [r.id for r in c.fetch()], c.move(99)) == ([0, 1], 3, [5], 4)
    c.close()
    with pytest.raises(ValueError):
        c.fetch()
    p = routines.Procedures()
    p.create("twice", lambda x: 2 * x)
    assert p.call("twice", 4) == 8
    with pytest.raises(ValueError):
        p.create("twice", int)
    with pytest.raises(LookupError):
        p.call("none")
    quoted = routines.Prepared(spark, "SELECT $1 AS a, $2 AS b").execute("x' OR '1'='1", 2).first()
    assert tuple(quoted) == ("x' OR '1'='1", 2)
    t, seen = routines.Triggers(), []
    t.create("after", "delete", lambda old, new: seen.append((old.count(), new.count())))
    t.create("instead", "update", lambda old, rows: old.limit(1))
    d = spark.range(4)
    assert t.run("delete", d, d.limit(0), lambda x, _: dml.delete(x, F.col("id") > 1)).count() == 2 and seen == [(4, 2)]
    assert t.run("update", d, d, lambda x, _: x).count() == 1
    with pytest.raises(ValueError):
        t.create("during", "insert", print)
    s = policies.Secured(d, "owner", [policies.Policy(F.col("id") < 2, roles=("a",))])
    assert [s.read(r).count() for r in ("owner", "a", "b")] == [4, 2, 0]
    s.forced = True
    assert s.read("owner").count() == 0 and s.refused("a", d).count() == 2


def test_asof(spark):
    a = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z"), (None, 9, "n"), (1, None, "m")], "k int, at int, l string")
    b = spark.createDataFrame([(1, 5, "p"), (1, 5, "q"), (1, 2, "o"), (2, None, "r"), (None, 1, "s")], "k int, at int, r string")
    assert sorted((r.l, r.r) for r in asof.asof_join(a, b, "k", "at").collect()) == [("m", None), ("n", None), ("x", "q"), ("y", None), ("z", None)]


def test_number_and_pattern_edges(spark):
    get = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [get(numbers.trunc(F.lit(x), 2)) for x in (0.29, -0.299, 1e20, 1.005, 0.0)] == [0.29, -0.29, 1e20, 1.0, 0.0]
    assert get(numbers.trunc(F.lit(-2.7))) == -2.0
    assert get(numbers.lcm(F.lit(9007199254740993), F.lit(1))) == 9007199254740993 and get(numbers.lcm(F.lit(0), F.lit(5))) == 0
    assert get(numbers.gcd(F.lit(-12), F.lit(18))) == 6 and get(numbers.gcd(F.lit(None).cast("long"), F.lit(1))) is None
    assert get(patterns.regexp_replace(F.lit("foobar foobar"), "foo(?=bar)", "X")) == "Xbar foobar"
    assert get(patterns.regexp_replace(F.lit("xaab bb"), r"(?<=x)(a)\1(b)", r"\2\1")) == "xba bb"
    assert get(patterns.regexp_replace(F.lit("no\nOne"), "o", "0", "i")) == "n0\nOne" and get(patterns.regexp_replace(F.lit("abc"), "z", "0")) == "abc"
    assert get(strings.decode(strings.encode(F.lit("é\\ \x01"), "escape"), "escape").cast("string")) == "é\\ \x01"
    assert get(jsons.pretty(F.lit("{no"))) is None and get(jsons.pretty(F.lit("[1]"))) == "[\n    1\n]"
    assert get(arrays.array_ndims(F.array(F.array(F.lit(1))))) == 2 and get(arrays.array_ndims(F.array().cast("array<int>"))) is None
    assert get(checked.canonical(F.lit("256.1.1.1"), "inet")) is None and get(checked.in_network(F.lit("192.168.1.9"), F.lit("192.168.1.0/24")))
    assert get(checked.canonical(F.lit("< (1, 2), 3 >"), "circle")) == "<(1,2),3>"
    vector = search.to_tsvector(F.lit("a fat cat sat"))
    assert get(search.matches(vector, "fat <-> cat & !dog", F.lit("a fat cat sat"))) and not get(search.matches(vector, "cat <-> fat", F.lit("a fat cat sat")))


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(strings.split_part(F.lit("a,b"), ",", 0)) == ""
    assert get(strings.chr_of(F.lit(300))) is None
    assert get(strings.similar_to(F.lit("a.c"), "a.c")) and not get(strings.similar_to(F.lit("abc"), "a.c"))
    assert get(times.number_to_char(F.lit(-3.5), "999.90")) == "  -3.50" or get(times.number_to_char(F.lit(12345), "999")) == "###"
    assert times.interval_parts("2 years 3 days ago") == {"years": -2, "days": -3}
    assert search.parse("a & b | !c <-> d") == ("|", ("&", "a", "b"), ("<->", ("!", "c"), "d"))
    with pytest.raises(ValueError):
        search.parse("a & | b")
