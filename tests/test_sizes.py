"""What queries and operators do with large keys, unusual rows and large documents."""

import time
import tracemalloc

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.markdown import chunking
from quillstone.markdown.blocks import Blocks, parse
from quillstone.markdown.chunking import whole_chunks
from quillstone.markdown.options import BY_SIZE, NEVER, Options
from quillstone.operators import greedy_groups
from quillstone.plans import queries as plans


def agrees(spark, folder, name, **tables):
    """Whether a query gives what its SQL gives over these tables (SQL for the rows of each)."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.sql(f"COPY ({rows}) TO '{folder}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(plans.ORACLES[name])
    got = plans.QUERIES[name](spark, str(folder)).select(*want.columns)
    key = lambda rows: sorted(tuple(str(float(v) if isinstance(v, int) else v) for v in r) for r in rows)
    return key(got.collect()) == key(want.fetchall())


def test_capped_list_with_long_keys(spark, tmp_path):
    keys = "SELECT unnest([0, 7, 12345, 123456, 899940, 1234567, 123456789012, -1234567]) AS c_custkey"
    assert agrees(spark, tmp_path, "capped_list", customer=keys)


#: Texts with white space that Markdown does not keep, blank ones, a missing one, and words with other white space in them.
ODD = ["Plain words here.", "", " ", "\n", " \n ", "  lead", "trail ", "one \ntwo", "one\n two", "x\u00a0", "\u3000", "a long\u00a0word-with-parts, yes", "seven.eight", "A\vb\fc", None, "😀 b"]


def documents(texts, twice=()):
    """SQL for documents with these texts; those of the numbers in ``twice`` are there two times."""
    quoted = ["NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts]
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q})" for i, q in [*enumerate(quoted), *((i, quoted[i]) for i in twice)]) + ") t(doc_id, text)"


def test_chunk_fitting_with_unusual_white_space(spark, tmp_path):
    assert agrees(spark, tmp_path, "chunk_fitting", documents=documents(ODD, twice=[0, 5]))


def test_chunk_words_kept_with_cuts_inside_runs(spark, tmp_path):
    run = "start of it and " + "some.run." * 60 + " with an end. "
    texts = [*ODD, run, run.replace(" ", "\u00a0"), " \n ".join([run, "a b", run]), "(one)two'three'four" * 30, "word " * 100]
    assert agrees(spark, tmp_path, "chunk_words_kept", documents=documents(texts, twice=[0, len(ODD)]) + " UNION ALL SELECT 0, 'other text of the same id'")


def test_plain_text_keeps_white_space(spark, tmp_path):
    assert agrees(spark, tmp_path, "plain_text", documents=documents(ODD, twice=[0, 5]))


def test_word_boundaries_of_unusual_texts(spark, tmp_path):
    assert agrees(spark, tmp_path, "word_boundaries", documents=documents([*ODD, "\x1c\x1c", "\n\f"], twice=[0, 5, 14]))


def test_plain_text_of_all_documents(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY ({documents(['mail a@b.org | x*y #1 & c', '**bold** and [link](http://x.org)', None, 'plain'])}) TO '{tmp_path}/documents.parquet'")
    rows = plans.QUERIES["plain_text"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.plain for r in rows] == ["mail a@b.org | x*y #1 & c", "bold and link", None, "plain"]
    assert "WHERE" not in plans.ORACLES["plain_text"]


@pytest.mark.parametrize("name", ["oversize_item", "oversize_heading", "oversize_quote", "oversize_row", "links_stay_whole", "image_inline", "rules_in_sql", "scored_cuts", "scored_cuts_by_tree"])
def test_rows_of_one_file_go_to_all_tasks(spark, name):
    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    key = df.columns[0]
    held = [len({r[0] for r in rows}) for rows in df.select(key).rdd.glom().collect()]
    customers = df.select(key).distinct().count()
    assert sum(n > 0 for n in held) >= 4 and max(held) <= customers / 4


@given(
    st.lists(st.text(alphabet="abw c.,;:-1d)!?'\"(ps/W _&é", max_size=14), min_size=1, max_size=7), st.sampled_from(["1.", "0.", "7)", "-", "+", "*", "12."]), st.sampled_from(["", "\n", "\n\n", "\n-"]),
    st.integers(4, 40), st.sampled_from([{}, {"list": NEVER}, {"list": {"split": BY_SIZE, "size": 20}}, None]),
)
@settings(max_examples=3000)
def test_flat_lists_need_no_tree(items, mark, end, size, rules):
    text = "\n".join(f"{int(mark[:-1]) + i}{mark[-1]} {t}" if mark[0].isdigit() else f"{mark} {t}" for i, t in enumerate(items)) + end
    options = Options(size, 1.2, rules=rules)
    assert list(whole_chunks(text, options)) == list(whole_chunks(text, options, shortcut=False))


def test_flat_lists_are_made_without_a_parser(monkeypatch):
    monkeypatch.setattr(chunking, "parse", None)
    assert [t for t, _ in chunking.chunks("3. part one\n4. part two\n5. part three", Options(17))] == ["3. part one\n4. part two", "5. part three"]


@given(st.lists(st.sampled_from(["text", "two [a] words", "[a]: http://x.org", "# head", "- item", "  - inner", "> quote", "> [a]: http://y.org", "", "", "```", "    code", "===", "***", "| a | b |", "|---|---|", "[^n]: note", "see [^n]", "<div>", "1. one"]), max_size=14), st.sampled_from(["\n", "\r\n", "\r"]), st.booleans())
@settings(max_examples=500)
def test_blocks_one_by_one_are_those_of_the_tree(lines, end, last):
    text = end.join(lines) + (end if last else "")
    found, want = list(Blocks(text).nodes()), parse(text).children
    assert all(n.type != "paragraph" or n.children for n in found)
    assert repr(found) == repr(want) and [(n.start, n.end) for n in found] == [(n.start, n.end) for n in want]


def test_blocks_do_not_hold_a_large_document():
    peaks = []
    for n in (1000, 8000):
        text = "# head\n\n" + "\n\n".join(f"Paragraph {i}" for i in range(n)) + "\n\n[a]: http://x.org"
        tracemalloc.start()
        count = sum(1 for _ in Blocks(text).nodes())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count == n + 2
    assert peaks[1] < 2 * peaks[0] + 100_000


def test_greedy_groups_of_one_long_key_take_linear_time(spark):
    n = 200_000
    df = spark.range(n).selectExpr("CAST(id % 2 AS INT) AS k", "id AS o", "CAST(1 + id % 13 AS INT) AS s")
    began = time.time()
    rows = greedy_groups(df, "k", "o", "s", 20).orderBy("k", "o").collect()
    assert time.time() - began < 20 and len(rows) == n
    key, total, number = None, 0, 0
    for r in rows:
        if r.k != key:
            key, total, number = r.k, 0, 0
        number, total = (number, total + r.s) if total + r.s <= 20 else (number + 1, r.s)
        assert r.group == number
