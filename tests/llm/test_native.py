"""Licence scan, fingerprints and sharding."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm import fingerprints, licenses, sharding
from quillstone.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_plans_run_no_python(spark):
    for name in ("op4_licenses", "op5_fingerprints", "op8_sharding"):
        assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, DATA)))


# -- licences


def test_licences_are_found_however_written(spark):
    mit = "Copyright (c) 2020 Some One\n(c) 2021 Other\n© Third\n\n" + licenses.LICENSES["MIT"].replace(" ", "\n  ").upper()
    bsd = licenses.LICENSES["BSD-3-Clause"].replace("license", "licence").replace(",", " ,")
    rows = [(1, mit), (2, bsd), (3, licenses.LICENSES["MIT"] + " more"), (4, None), (5, ""), (6, "x\nreleased UNDER the mit licence\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(1, 7)] == ["MIT", "BSD-3-Clause", None, None, None, None]
    assert got[4].canonical_sha256 == got[5].canonical_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[6].notices == "CC-BY-NC-4.0,MIT" and got[1].notices == ""


def test_licences_agree_with_sql(spark, awkward):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(awkward.select("doc_id", "text")).toPandas()  # noqa: F841
    got = licenses.scan(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(awkward.where("doc_id is null or doc_id <> 6").select("doc_id", "text"))).collect()
    documents = documents[documents.text.isna() | ~documents.text.fillna("").str.contains("😀")]
    want = duckdb.sql(ORACLES["op4_licenses"]).fetchall()
    key = lambda rows: sorted(str(tuple(None if x != x else x for x in r)).replace(".0,", ",") for r in rows)
    assert key(map(tuple, got)) == key(want)


def test_licences_of_ones_own(spark):
    own = spark.createDataFrame([("House-1", "You may use this, freely."), ("House-0", "you may USE this - freely"), ("Void", " * "), (None, "some text"), ("Null", None)], "license string, text string")
    rows = [(1, "You may use\nthis freely!"), (2, licenses.LICENSES["MIT"]), (3, ""), (4, "some text"), (5, None)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), more=own).collect()}
    assert got == {1: "House-0", 2: "MIT", 3: None, 4: None, 5: None}


def test_notices_can_be_passed_over():
    assert all(re.search("licen", t, re.I) for t in licenses.NOTICES)


# -- fingerprints


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 30)  # several ranges
    got = {r.doc_id: r for r in fingerprints.compare(documents).collect()}
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    assert len(got) == len(rows)
    worst = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        a, b, c = shingles(text), shingles(edited), shingles(following)
        worst.append(abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1)))
        worst.append(abs(got[i].near_next - (len(a & c) / len(a | c) if a | c else 1)))
    assert sum(worst) / len(worst) < 0.04 and max(worst) < 0.25


def test_equal_texts_have_equal_fingerprints(spark, awkward):
    rows = fingerprints.compare(awkward).collect()
    assert len(rows) == 10
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].fingerprint == by_id[1][1].fingerprint == by_id[8][0].fingerprint
    assert by_id[2][0].fingerprint == by_id[3][0].fingerprint == "" and by_id[2][0].n_chars == 0
    assert len(by_id[5][0].fingerprint) == fingerprints.BINS * 2
    assert by_id[2][0].near_next == 1.0 or by_id[3][0].near_next == 1.0  # two texts without words follow each other
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = fingerprints.compare(awkward.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.compare(awkward.limit(0)).count() == 0


def test_next_row_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(fingerprints, "BOUNDS_BLOCK", 2)
    ids = [5, 1, 900, 17, 17, None, 42, 3, 1000000, None, -4]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "id long, t string")
    rows = fingerprints.with_next(df, "id", ["t"]).collect()
    assert sorted(r.t for r in rows) == sorted(f"t{k}" for k in range(len(ids)))
    assert sorted(r.next_t for r in rows) == sorted(f"t{k}" for k in range(len(ids)))
    order = {f"t{k}": (i is not None, i or 0) for k, i in enumerate(ids)}
    wrapped = [r for r in rows if order[r.next_t] > order[r.t]]
    assert len(wrapped) == 1 and wrapped[0].next_t == "t8"


@pytest.mark.parametrize("kind", ["string", "double", "date"])
def test_ids_of_any_type(spark, documents, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 30)
    name = {"string": "concat('doc-', doc_id, '-é')", "double": "doc_id + 0.5", "date": "date_add(date'2020-01-01', cast(doc_id as int))"}[kind]
    df = documents.selectExpr(f"{name} doc_id", "text")
    rows = fingerprints.with_next(df, "doc_id", ["text"]).collect()
    order = sorted(((str(r.doc_id).encode(), r.text) for r in df.collect()), reverse=True)
    follows = {k: order[(i + 1) % len(order)][1] for i, (k, _) in enumerate(order)}
    assert all(r.next_text == follows[str(r.doc_id).encode()] for r in rows) and len(rows) == len(order)


def test_rows_of_one_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 50)
    df = spark.range(1000).selectExpr("if(id % 3 = 0, null, 7L) k", "concat('t', id) t")
    out = fingerprints.with_next(df, "k", ["t"])
    rows = out.collect()
    follows = {r.t: r.next_t for r in rows}
    seen, at = set(), "t0"
    while at not in seen:
        seen.add(at)
        at = follows[at]
    assert len(seen) == 1000  # one circle of all rows
    assert max(r["n"] for r in df.withColumn("p", F.lit(1)).groupBy("k").agg(F.count("*").alias("n")).collect()) > 300
    assert sum((a < 0) != (b < 0) for a, b in ((1 if r.k else -1, 1 if follows_key(rows, r) else -1) for r in rows)) == 2


def follows_key(rows, row):
    return next(r.k for r in rows if r.t == row.next_t)


def test_packing_of_bins(spark, documents):
    df = fingerprints.with_bins(documents.select("doc_id", "text"), "text", "bins")
    got = df.select("bins", fingerprints.packed(F.col("bins")).alias("f")).withColumn("again", fingerprints.unpacked(F.col("f"))).collect()
    assert all(r.bins == r.again and len(r.f) in (0, 2 * fingerprints.BINS) for r in got)


def test_densified_bins_estimate_short_texts(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, a, a + " thirteen")], "i int, a string, b string")
    r = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb").select(fingerprints.likeness(fingerprints.unpacked(F.col("fa")), fingerprints.unpacked(F.col("fb"))).alias("x")).first()
    assert abs(r.x - 8 / 9) < 0.15


# -- sharding


def test_sharding_law(spark, documents):
    rows = sharding.place(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == len(texts) and {r.shard for r in rows} == set(range(24))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 24)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_by_id_alone(spark, documents):
    moved = documents.withColumn("text", F.lit("other"))
    a = {r.doc_id: r.shard for r in sharding.place(documents).collect()}
    assert a == {r.doc_id: r.shard for r in sharding.place(moved.repartition(5)).collect()}


def test_weights_confine_movement(spark):
    ids = spark.range(4000).selectExpr("cast(id as string) k")
    tree = sharding.topology()
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier["region1"]["rack2"][12] = 3.0
    got = ids.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).collect()
    inside = set(tree["region1"]["rack2"])
    region = {s for rack in tree["region1"].values() for s in rack}
    for r in got:
        if r.a != r.b:  # rows move only into the subtrees above the heavier shard
            assert r.b in region
            if r.a in region:
                assert r.b in inside and (r.a not in inside or r.b == 12)
    share = sum(r.b == 12 for r in got) / len(got)
    assert abs(share - 3 / 26) < 0.03
    sizes = [sum(r.a == s for r in got) for s in range(24)]
    assert min(sizes) > 100 and max(sizes) < 240


def test_sharding_awkward_rows(spark, awkward):
    rows = sharding.place(awkward.withColumnRenamed("score", "shard")).collect()
    assert len(rows) == 10
    null = [r for r in rows if r.doc_id == 2][0]
    assert null["size"] == 8 and null.text_crc32 == 0
    assert sharding.place(awkward.limit(0)).count() == 0
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.place(awkward.repartition(3)).collect()}
    assert again == {(r.doc_id, r.text_crc32): r.shard for r in rows}


def test_sharding_spreads_hot_rows(spark, monkeypatch):
    """A row that a third of all rows repeat, and an id that another third has with different texts."""
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(1, "same")] * 300 + [(2, f"text {i}") for i in range(300)] + [(i, "other") for i in range(3, 303)]
    out = sharding.place(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((k, len(t) + 8, zlib.crc32(t.encode())) for k, t in rows)
    for shard in range(24):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    hot = sorted(r.slot for r in out if r.doc_id == 1)
    assert hot == list(range(hot[0], hot[0] + 300))
    assert len({r.shard for r in out if r.doc_id == 2}) == 1


@pytest.mark.parametrize("regions", [1, 2])
def test_trees_grow(regions):
    tree = sharding.grown(sharding.topology(regions, 2, 2))
    assert max(s for racks in tree.values() for shards in racks.values() for s in shards) == regions * 4


def test_whole_licences_and_spdx_ids(spark):
    texts = {n: open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read() for n, f in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"))}
    rows = [(n, t) for n, t in texts.items()] + [(n + " wrapped", t.upper().replace("\n", "\n\n * ")) for n, t in texts.items() if n == "MPL-2.0"]
    rows += [(f"id {n}", f"# SPDX-License-Identifier: {n}\ncode") for n in ("LGPL-2.1-or-later", "MPL-2.0", "AGPL-3.0-only", "BSD-2-Clause", "GPL-2.0+")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(got[n].license == n for n in texts) and got["MPL-2.0 wrapped"].license == "MPL-2.0"
    assert {k[3:]: r.notices for k, r in got.items() if k.startswith("id ")} == {
        "LGPL-2.1-or-later": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "AGPL-3.0-only": "AGPL-3.0", "BSD-2-Clause": "BSD-2-Clause", "GPL-2.0+": "GPL-2.0",
    }
