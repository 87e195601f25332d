"""Corridors, the index that follows its documents, archives."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gridhaul.functions import geo
from gridhaul.operators import corridor, fulltext
from gridhaul.operators.text_index import TextIndex
from gridhaul.sources import files
from gridhaul.sources.archive import ZippedTables
from tests.test_operators import plain_paths, road_grid


def test_corridors_reach_or_go_on(spark):
    """Near goals are reached inside the corridor by the paths that its tiles hold; a request with a goal out of reach, or too wide, has no row."""
    nodes, rows = road_grid(30, 9)
    table = spark.createDataFrame(nodes, "id long, lat double, lon double")
    at = {n: (lat, lon) for n, lat, lon in nodes} | {9999: (40.1, -99.9)}
    edges = spark.createDataFrame(rows, "u long, v long, seconds double, metres double").join(table.withColumnRenamed("id", "u"), "u").withColumns({"u_tx": geo.tile_x(F.col("lon")), "u_ty": geo.tile_y(F.col("lat"))})
    legs = [(1, 0, 0, 31), (1, 1, 0, 62), (2, 0, 400, 400), (3, 0, 5, 9999), (3, 1, 5, 6), (4, 0, 0, 899), (5, 0, 100, 130), (6, 0, 100, None)]
    legs += [(100 + k, 0, 200 + k, 203 + k) for k in range(25)]
    asked = spark.createDataFrame([(r, d, o, g, *at[o], *at.get(g, (None, None))) for r, d, o, g in legs], "request long, dest long, origin_node long, dest_node long, origin_lat double, origin_lon double, dest_lat double, dest_lon double")
    found = {(r.request, r.dest): (r.seconds, r.metres) for r in corridor.route_within(asked, edges, most=12).collect()}
    tile = lambda n: (int((at[n][1] + 180) // 0.25), int((at[n][0] + 90) // 0.25))
    want = {}
    for request in {r for r, *_ in legs}:
        mine = [(d, o, g) for r, d, o, g in legs if r == request and g is not None]
        if not mine:
            continue
        tiles = [tile(n) for _, o, g in mine for n in (o, g)]
        x0, x1, y0, y1 = min(x for x, _ in tiles) - 1, max(x for x, _ in tiles) + 1, min(y for _, y in tiles) - 1, max(y for _, y in tiles) + 1
        best = plain_paths([e for e in rows if x0 <= tile(e[0])[0] <= x1 and y0 <= tile(e[0])[1] <= y1], mine[0][1])
        if (x1 - x0 + 1) * (y1 - y0 + 1) <= 12 and all(g in best for _, _, g in mine):
            want |= {(request, d): best[g] for d, _, g in mine}
    assert (1, 0) in want and (2, 0) in want and not any(r in (3, 4, 6) for r, _ in want)
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    assert corridor.route_within(asked.limit(0), edges).count() == 0


def docs_of(spark, texts):
    return spark.createDataFrame([(s, i, t) for (s, i), t in texts.items()], "shard string, id long, text string")


def test_index_follows_its_documents(spark, tmp_path):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(30)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8)))
    texts = {(s, i): line() for s in "ab" for i in range(60)}
    index = TextIndex(spark, str(tmp_path / "index"))
    assert index.frequencies().count() == 0 and index.live().count() == 0
    index.apply(1, docs_of(spark, texts))
    for batch in (2, 3):
        gone = rng.sample(sorted(texts), 9)
        fresh = {k: line() for k in gone[:4]} | {("a", 1000 * batch + k): line() for k in range(3)}
        texts = {k: t for k, t in texts.items() if k not in gone} | fresh
        deleted = spark.createDataFrame([*gone, ("a", -1), (None, 5)], "shard string, id long")
        index.apply(batch, docs_of(spark, fresh), deleted)
        index.apply(batch, docs_of(spark, fresh), deleted)
    built = fulltext.postings(docs_of(spark, texts))
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.collect())))
    assert rows(index.live().select("shard", "token", "id", "len", "tf")) == rows(built.select("shard", "token", "id", "len", "tf"))
    assert rows(index.frequencies()) == rows(fulltext.frequencies(built))
    near = {r.shard: (r.n_docs, pytest.approx(r.mean_len)) for r in fulltext.sizes(built).collect()}
    assert {r.shard: (r.n_docs, r.mean_len) for r in index.sizes().collect()} == near
    assert index._table("postings", [3]).select("shard", "id").distinct().count() == 7 and index._table("gone", [3]).count() == 9
    asked = spark.createDataFrame([(k, s, f"w{k} w{k + 1}") for k in range(12) for s in "ab"], "q long, shard string, text string")
    tiers = docs_of(spark, texts).select("shard", "id", F.lit("rooftop").alias("tier"))
    small = index.compact(str(tmp_path / "small"))
    want = rows(fulltext.ranked(asked, built, tiers))
    assert want == rows(index.ranked(asked, tiers)) == rows(small.ranked(asked, tiers)) and small.batches() == [3] and want
    with pytest.raises(ValueError):
        index.apply(4, docs_of(spark, {next(iter(texts)): "again"}))
    with pytest.raises(ValueError):
        index.apply(0, docs_of(spark, {("a", 77777): "late"}))


def test_a_cut_off_batch_is_written_anew(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    index.apply(1, docs_of(spark, {("a", 1): "one two"}))
    docs_of(spark, {("a", 9): "x"}).select("shard", F.lit("junk").alias("token"), "id", F.lit(1).alias("len"), F.lit(1).cast("long").alias("tf")).write.parquet(f"{index.path}/postings/batch=2")
    assert {r.token for r in index.live().collect()} == {"one", "two"}
    index.apply(2, docs_of(spark, {("a", 2): "two"}))
    assert {(r.token, r.df) for r in index.frequencies().collect()} == {("one", 1), ("two", 2)} and index.batches() == [1, 2]


def test_archives_by_header(spark, tmp_path):
    spark.dataSource.register(ZippedTables)
    folder = tmp_path / "zips"
    folder.mkdir()
    with zipfile.ZipFile(folder / "one.zip", "w") as z:
        z.writestr("x/A.CSV", "﻿State, Number ,Street\r\nMI,7,\"Birch, North\"\r\nMI\r\n\r\nMI,8,x,beyond\r\n".encode())
        z.writestr("notes.txt", "no table")
    with zipfile.ZipFile(folder / "two.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b.csv", b"street,state\nL\xe9on,OH\n")
        z.writestr("empty.csv", b"")
        z.writestr("more.csv", "State\n" + "WA\n" * 12_000)
    (folder / "_unfinished.zip").write_bytes(b"PK")
    found = spark.read.format("zipped_tables").load(str(folder))
    assert found.columns == ["State", "Number", "Street"] and found.rdd.getNumPartitions() == 4
    rows = sorted(str(tuple(r)) for r in found.filter("State <> 'WA'").collect())
    assert rows == sorted(map(str, [("MI", "7", "Birch, North"), ("MI", None, None), ("MI", "8", "x"), ("OH", None, "L�on")])) and found.filter("State = 'WA'").count() == 12_000
    one = spark.read.format("zipped_tables").option("members", "b.*").load(str(folder))
    assert [tuple(r) for r in one.collect()] == [("L�on", "OH")]
    assert [r.street for r in files.authority_addresses(spark.read.format("zipped_tables").load(str(folder)).withColumnRenamed("Street", "StNam_Full")).filter("state = 'OH'").collect()] == ["L�on"]


def test_archives_are_written_a_task_each(spark, tmp_path):
    spark.dataSource.register(ZippedTables)
    path = str(tmp_path / "out")
    rows = [(str(k), "a,\"b\"\nc" if k % 3 else None, "é") for k in range(200)]
    df = spark.createDataFrame(rows, "k string, t string, u string").repartition(3)
    for _ in range(2):
        df.write.format("zipped_tables").mode("append").option("path", path).save()
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 6 and all(n.endswith(".zip") and not n.startswith("_") for n in names)
    with zipfile.ZipFile(tmp_path / "out" / names[0]) as z:
        assert io.TextIOWrapper(z.open("rows.csv"), encoding="utf-8-sig").readline() == "k,t,u\n"
    got = sorted((r.k, r.t or None, r.u) for r in spark.read.format("zipped_tables").load(path).collect())
    assert got == sorted(rows * 2, key=lambda r: (r[0], r[1] or "", r[2]))
    broken = df.withColumn("k", F.when(F.col("k") == "7", F.raise_error(F.lit("no"))).otherwise(F.col("k")))
    with pytest.raises(Exception):  # noqa: B017
        broken.write.format("zipped_tables").mode("append").option("path", str(tmp_path / "none")).save()
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())
