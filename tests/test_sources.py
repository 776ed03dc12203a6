import json

import pytest
from pyspark.sql import functions as F

from slateworks import canonicalize
from slateworks.sources import adapters, datasets
from slateworks.streaming.popularity import windowed_popularity


def test_rating_files_to_canonical_tables(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "users.dat").write_text("1::F::1::10::48067\n2::M::56::16::70072\n", encoding="latin-1")
    (raw / "movies.dat").write_text("10::Café (1995)::Drama|War\n20::Toy::Comedy\n", encoding="latin-1")
    (raw / "ratings.dat").write_text("1::10::5::978300760\n1::20::2::978300761\n2::10::4::978300762\n")
    (tmp_path / "s.csv").write_text('x,item_id,summary\n1, 10 ,"A ""long"" story,\nover lines"\n2,20,short\n')
    manifest = canonicalize.main(["ratings", str(raw), str(out), "--summaries", str(tmp_path / "s.csv")], spark)
    data = datasets.CanonicalDataset("ratings", "1", str(out))
    assert manifest["tables"] == {"users": 2, "items": 2, "interactions": 3} and data.manifest() == json.loads((out / "manifest.json").read_text())
    assert {s["bytes"] for s in manifest["sources"]} and all(len(s["sha256"]) == 64 for s in manifest["sources"])
    items = {r.item_id: r for r in data.items(spark).collect()}
    assert items["10"].title == "Café (1995)" and items["10"].genres == ["Drama", "War"] and items["10"].summary == 'A "long" story,\nover lines'
    assert [r.target_like_ge4 for r in data.interactions(spark, ["user_id", "item_id", "target_like_ge4"]).orderBy("user_id", "item_id").collect()] == [1, 0, 1]


@pytest.mark.parametrize("text", ["item_id,summary\n10,a\n", "item_id,summary\n10,a\n20,b\n30,c\n", "item_id,summary\n10,a\n20,b\n20,c\n", "item_id,summary\n10,a\n20,\n"])
def test_summaries_must_agree(spark, tmp_path, text):
    (tmp_path / "s.csv").write_text(text)
    items = spark.createDataFrame([("10",), ("20",)], "item_id string")
    with pytest.raises(ValueError):
        adapters.with_summaries(spark, items, str(tmp_path / "s.csv"))


def test_libraries_keep_the_fullest_snapshot(spark, tmp_path):
    game = lambda i, t, n="g": {"item_id": i, "item_name": n, "playtime_forever": t, "playtime_2weeks": 0}
    lines = [{"user_id": "a", "items_count": 1, "items": [game("1", 10)]}, {"user_id": "a", "items_count": 2, "items": [game("1", 100, ""), game("2", 120, "two")]}, {"user_id": "b", "items_count": 1, "items": [game("1", 7, "first")]}, {"user_id": "b", "items_count": 1, "items": [game("3", 7)]}, {"user_id": "c", "items_count": 0, "items": []}]
    (tmp_path / "l.txt").write_text("\n".join(map(repr, lines)) + "\n")
    tables = adapters.libraries(spark, str(tmp_path / "l.txt"))
    got = sorted((r.user_id, r.item_id, r.playtime, r.target_played_ge120) for r in tables["interactions"].collect())
    assert got == [("a", "1", 100, 0), ("a", "2", 120, 1), ("b", "1", 7, 0)]
    assert {r.user_id: r.playtime for r in tables["users"].collect()} == {"a": 220, "b": 7, "c": 0}
    assert {r.item_id: r.title for r in tables["items"].collect()} == {"1": "first", "2": "two"}


def test_metadata_cache_metrics_and_errors(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "m.gz", "wt") as f:
        for row in ({"id": "1", "title": "T", "genres": ["a", "b"], "price": 4.99}, {"id": "1", "title": "later"}, {"title": "no id"}, {"id": "2", "app_name": "N", "price": "Free"}):
            f.write(repr(row) + "\n")
    meta = {r.item_id: r for r in adapters.item_metadata(spark, str(tmp_path / "m.gz")).collect()}
    assert meta["1"].title == "T" and json.loads(meta["1"].genres_json) == ["a", "b"] and meta["1"].price == 4.99 and meta["2"].title == "N" and meta["2"].price is None
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("k", "v"), ("l", "w")], "key string, value string")
    datasets.append_cache(rows, spark.createDataFrame([], "key string"), path)
    datasets.append_cache(rows.union(spark.createDataFrame([("m", "x")], "key string, value string")), datasets.read_cache(spark, path).cache(), path)
    assert sorted(map(tuple, datasets.read_cache(spark, path).collect())) == [("k", "v"), ("l", "w"), ("m", "x")]
    for run in ("20240101T0000Z_a", "20240102T0000Z_a"):
        datasets.write_json({"task": "t", "method": "m", "metrics": {"f1": float("nan")}}, str(tmp_path / "runs" / run / "metrics.json"))
    assert datasets.run_metrics(spark, str(tmp_path / "runs")).count() == 2
    assert datasets.run_metrics(spark, str(tmp_path / "runs"), latest_only=True).first().run == "20240102T0000Z_a"
    with pytest.raises(ValueError):
        datasets.make_manifest("n", "1", [], {}, tables_=1, name_="x", **{"caveats": [], "targets": {}, "schema_version": 2})


def test_streaming_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, f"2024-01-01 0{i % 5}:00:00") for i in range(40)], "item_id long, t string").select("item_id", F.to_timestamp("t").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_popularity(stream).writeStream.format("memory").queryName("pop").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("pop").collect())) == sorted(map(tuple, windowed_popularity(events).collect()))
