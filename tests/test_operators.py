"""The DataFrame operators, sources and streams."""

import random
import time

import duckdb
import pytest

import __spark_entry__
from quillstone import Chunker, Options, chunk, register
from quillstone import functions as Q
from quillstone.markdown.blocks import parse
from quillstone.markdown.chunking import cap
from quillstone.markdown.nodes import Node, from_units, plain_text, units
from quillstone.markdown.sections import hierarchy, is_section
from quillstone.operators import blocks, greedy_groups, merge_intervals, section_paths, section_sizes
from quillstone.plans import queries as plans
from quillstone.sources import read_markdown, spread, write_chunks, write_jsonl
from quillstone.streaming import latest_versions, read_documents
from quillstone.streaming import write_chunks as stream_chunks
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOC = "lead\n\n# A\n\na text\n\n### C\n\nc text\n\n## B\n\nb\n\n***\n\nafter\n\n# D\n\nd"


def test_chunks_of_a_table(spark):
    df = spark.createDataFrame([(1, "# H\n\ntext", "x"), (2, None, "y"), (3, "", None), (4, " ", "z"), (1, "# H\n\ntext", "x")], "id long, body string, tag string")
    rows = chunk(df, "body", chunk_size=100).orderBy("id").collect()
    assert [(r.id, r.tag, r.chunk_index, r.text) for r in rows] == [(1, "x", 0, "# H\n\ntext")] * 2
    assert chunk(df.limit(0), "body", chunk_size=100).count() == 0
    with pytest.raises(ValueError):
        chunk(df.withColumn("chunk_index", F.lit(1)), "body", chunk_size=100)


def test_breadcrumbs_and_partitioning(spark):
    df = spark.createDataFrame([(i, DOC) for i in range(20)], "id long, text string")
    one = Chunker(Options(8)).transform(df.coalesce(1)).orderBy("id", "chunk_index").collect()
    many = Chunker(Options(8)).transform(df.repartition(7)).orderBy("id", "chunk_index").collect()
    assert one == many
    assert [("d", ["D"])] == [(r.text, [b.text for b in r.breadcrumbs]) for r in one if r.id == 3 and r.text.endswith("d")] or any(r.text == "# D\n\nd" for r in one)


def test_sql_function(spark):
    register(spark)
    rows = spark.sql("SELECT c.* FROM (SELECT 'One sentence here. Two sentences here.' AS t) d, LATERAL chunk(d.t, 20) c").collect()
    assert [r.text for r in rows] == ["One sentence here.", "Two sentences here."]


def test_section_paths_agree_with_the_tree(spark):
    docs = [DOC, "# A\n\n#### B\n\nx\n\n## C\n\n***\n\n***\n\ny\n\n## D\n\nz", "a\n\nb", "", "***\n\na\n\n# H"]
    table = blocks(spark.createDataFrame(list(enumerate(docs)), "id long, text string"))
    got = {(r.id, r.idx): (list(r.path), r.section) for r in section_paths(table, "id").collect()}
    for i, text in enumerate(docs):
        nodes = parse(text).children
        place = {id(n): k for k, n in enumerate(nodes)}

        def visit(section, above, top):
            if section.heading is not None:
                assert got[i, place[id(section.heading)]] == (above, top)
                above = [*above, place[id(section.heading)]]
            for c in section.children:
                if is_section(c):
                    visit(c, above, top)
                else:
                    assert got[i, place[id(c)]] == (above, top)

        for s in hierarchy(nodes):
            visit(s, [], place[id(s.heading or s.children[0])])


def test_section_sizes(spark):
    table = blocks(spark.createDataFrame([(0, DOC)], "id long, text string"))
    got = {r.plain: r.section_size for r in section_sizes(table, "id").collect()}
    assert got == {"A": 16, "C": 7, "B": 2, "D": 2}


def test_greedy_groups(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([3, 3, 3, 9, 1, 20, 1])], "k long, o int, s int")
    assert [r.group for r in greedy_groups(df, "k", "o", "s", 10).orderBy("o").collect()] == [0, 0, 0, 1, 1, 2, 3]


def test_merge_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5, 1, 0), (1, 4, 8, 9, 1), (1, 8, 9, 2, 2), (2, 0, 1, 1, 0)], "k long, a int, b int, p int, t int")
    assert sorted(map(tuple, merge_intervals(df, "k", "a", "b", "p", "t").collect())) == [(1, 0, 8, 9), (1, 8, 9, 2), (2, 0, 1, 1)]


def test_functions(spark):
    df = spark.createDataFrame([("a😀",), ("**b** c",), (None,), ("﻿ x  ",)], "t string")
    got = df.select(Q.raw_size(F.col("t")).alias("raw"), Q.content_size("t").alias("size"), Q.plain_text("t").alias("plain"), Q.normalise("t").alias("n"), Q.trim(F.col("t")).alias("trim")).collect()
    assert [r.raw for r in got] == [3, 7, 0, 5] and [r["size"] for r in got][:3] == [3, 3, 0]
    assert got[1].plain == "b c" and got[1].n == "**b** c\n" and got[3].trim == "x" and got[2].plain is None


@pytest.mark.parametrize("most", [1, 3, 7, 20])
def test_native_cap_is_the_cap(spark, most):
    rng = random.Random(most)
    texts = ["", "a", "aaa bbb  ccc\ndddddddddd e", " lead and trail ", "x" * 50, "a b c d e f g h i j", "  ", "aaaaaaaaaa   "]
    texts += ["".join(rng.choices(rng.choice(["ab  ", "a \n\u00a0", "a😀 ", "😀", "abcdefgh😀é "]), k=rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", Q.raw_cap(F.col("t"), most).alias("native"), Q.raw_cap_units("t", F.lit(most)).alias("units")).collect()
    for r in rows:
        assert r.native == r.units == [from_units(p) for p in cap(units(r.t), most)]
    assert df.select(Q.raw_cap(F.lit(None).cast("string"), most).alias("x")).first().x is None


def test_native_cap_takes_linear_time(spark):
    df = spark.createDataFrame([("word and other " * 100_000,)], "t string")
    began = time.time()
    assert df.select(F.size(Q.raw_cap(F.col("t"), 1000)).alias("n")).first().n > 1400 and time.time() - began < 10


def test_a_splitter_of_ones_own(spark):
    def shout(node, splitter):
        """Each block of a quote by itself, loudly."""
        return [Node("paragraph", [Node("text", value=plain_text(c).upper())]) for c in node.children]

    chunker = Chunker(Options(8), {"blockquote": shout})
    text = "> one two\n>\n> three\n\n> small"
    assert chunker.split_text(text) == ["ONE TWO", "THREE", "> small"]
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert [r.text for r in chunker.transform(df).collect()] == ["ONE TWO", "THREE", "> small"]
    words = lambda node, splitter: [Node("paragraph", [Node("text", value=w)]) for w in plain_text(node).split()]
    assert Chunker(Options(3), {"paragraph": words}).split_text("aa bb cc") == ["aa", "bb", "cc"]


def test_rules_in_sql(spark):
    register(spark)
    rows = spark.sql("""SELECT c.text FROM (SELECT '[a long link text](http://x) b' AS t) d, LATERAL chunk(d.t, 6, 1.0, NULL, '{"link": "allow-split"}') c""").collect()
    assert len(rows) > 2
    with pytest.raises(Exception, match="no such rules"):
        spark.sql("""SELECT c.text FROM (SELECT 'x' AS t) d, LATERAL chunk(d.t, 6, 1.0, NULL, '{"nothing": "allow-split"}') c""").collect()


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\n\ntext")
    docs = spread(read_markdown(spark, str(tmp_path / "in")))
    out = Chunker(Options(50)).transform(docs)
    write_chunks(out, str(tmp_path / "out"))
    write_jsonl(out, str(tmp_path / "json"))
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "# A\n\ntext"
    assert spark.read.json(str(tmp_path / "json")).first().text == "# A\n\ntext"


def test_stream_gives_what_batch_gives(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_documents(spark, str(tmp_path / "in"), docs.schema, files_per_trigger=1)
    stream_chunks(stream, Chunker(Options(100)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    rows = lambda df: sorted((r.item_id, r.chunk_index, r.text) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(Chunker(Options(100)).transform(docs))
    late = latest_versions(stream.withColumn("ts", F.current_timestamp()), "item_id", "ts", "1 hour")
    assert late.isStreaming


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = plans.QUERIES[name](spark, DATA)
    want = con.sql(plans.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    key = lambda rows: sorted(tuple(str(plain(v)) for v in r) for r in rows)
    assert key(tuple(r[c] for c in cols) for r in got.collect()) == key(want.select(*cols).fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "lang", "chunk_index", "text", "breadcrumbs"] and df.count() > 0
