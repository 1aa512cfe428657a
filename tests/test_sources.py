"""Readers that split files, and the loader's jobs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from freightlens.sources import seed_script as S
from freightlens.sources import split_files as R

SCRIPT = """-- a remark; it's no statement
BEGIN;
INSERT INTO districts (id, name, short_name) VALUES (1, 'North; INSERT INTO districts (id) VALUES (9);
still the name', 'N'); INSERT INTO districts (id, name) VALUES (2, 'O''Neil'),
  (3, /* it's ; a remark */ 'x -- y'), -- and; another
  (4, 'z');
/* INSERT INTO districts (id) VALUES (77);
*/
INSERT INTO road_segments (id, name, lanes) VALUES (1, 'a', 'many');
INSERT INTO road_segments (id, name) VALUES (2, 'b', 3);
INSERT INTO "public"."road_segments" ("id", "name") VALUES (3, 'c;''d')
"""
FOUND = [("districts", "1", "North; INSERT INTO districts (id) VALUES (9);\nstill the name"), ("districts", "2", "O'Neil"), ("districts", "3", "x -- y"), ("districts", "4", "z"), ("road_segments", "1", "a"), ("road_segments", None, None), ("road_segments", "3", "c;'d")]


@pytest.mark.parametrize("size", [60, 333, 100_000])
def test_statements_over_any_ranges(spark, tmp_path, size):
    (tmp_path / "seed.sql").write_text(SCRIPT)
    rows = R.split_frame(spark, str(tmp_path / "seed.sql"), split_bytes=size)
    assert rows.rdd.getNumPartitions() == -(-len(SCRIPT.encode()) // size)
    found = [(r.table, (r.fields or {}).get("id"), (r.fields or {}).get("name")) for r in rows.orderBy("line", "nth").collect()]
    assert found == FOUND
    spark.dataSource.register(R.SqlScript)
    plain = spark.read.format("sql_script").option("split_bytes", size).load(str(tmp_path / "seed.sql"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, rows.collect()))


def test_random_scripts(tmp_path):
    """Whatever the ranges are, each statement is read once; the reader without Spark."""
    r = random.Random(3)
    for n in range(60):
        pieces = ["'", "''", ";", "\n", "--", "/*", "*/", "a", '"', " ", "INSERT", "(1)", "é"]
        text = "".join(r.choice(pieces) for _ in range(r.randrange(120)))
        path = tmp_path / f"{n}.sql"
        path.write_text(text)
        def read(size):
            found = R.ranges_of(str(path), size)
            parts = R.composed(found, [R.reduced(f, a, b, "sql") for f, _, a, b in found], "sql")
            return [x for p in parts for x in R.statements(p)]
        assert read(1) == read(5) == read(13) == read(10_000), text


def test_folders_and_typed_tables(spark, tmp_path):
    folder = tmp_path / "scripts"
    folder.mkdir()
    (folder / "a.sql").write_text("INSERT INTO districts (name) VALUES ('a1');\nINSERT INTO districts (name) VALUES ('a2');\n")
    (folder / "b.sql").write_text("INSERT INTO districts (name) VALUES ('b1'), ('b2');")
    rows = S.read_statements(spark, str(folder), split_bytes=30)
    assert [(x.id, x.name) for x in S.typed_table(rows, "districts").orderBy("id").collect()] == [(1, "a1"), (2, "a2"), (3, "b1"), (4, "b2")]


def test_both_readers_load_alike(spark, tmp_path):
    lines = [f"INSERT INTO districts (id, name, area_sq_km) VALUES ({i}, 'd{i}', {'NULL' if i % 5 else 'oops'});" for i in range(40)]
    (tmp_path / "s.sql").write_text("\n".join(lines))
    loads = [S.load(spark, str(tmp_path / "s.sql"), str(tmp_path / name), read=read) for name, read in (("a", S.read_rows), ("b", lambda s, p: S.read_statements(s, p, 300)))]
    assert [list(map(tuple, x.collect())) for x in loads] == [[("districts", 32, 8, "partial")]] * 2
    tables = [sorted(map(tuple, spark.read.parquet(str(tmp_path / name / "districts.parquet")).collect())) for name in "ab"]
    assert tables[0] == tables[1] and len(tables[0]) == 32


def test_unpaired_quotes_are_errors():
    assert S.parse_rows("a, b", "(1, 5')") == [(None, "unpaired quote")]
    assert S.parse_statement("INSERT INTO t (a) VALUES ('x'");


def test_jobs_of_a_load(spark, tmp_path):
    """One job for the script, one for each table that it names, one for each empty one, and the journal's."""
    lines = [f"INSERT INTO districts (id, name) VALUES ({i}, 'd{i}');" for i in range(50)] + [f"INSERT INTO cargo_categories (id, code, name) VALUES ({i}, 'c', 'n');" for i in range(50)]
    (tmp_path / "s.sql").write_text("\n".join(lines))
    spark.sparkContext.setJobGroup("load", "load")
    found = S.load(spark, str(tmp_path / "s.sql"), str(tmp_path / "out"))
    spark.sparkContext.setJobGroup("other", "other")
    assert [tuple(r) for r in found.collect()] == [("districts", 50, 0, "success"), ("cargo_categories", 50, 0, "success")]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("load")) <= 1 + 2 + 9 + 2
    assert not (tmp_path / "out/_staged").exists()


def test_a_load_drops_its_own_caches_only(spark, tmp_path):
    (tmp_path / "s.sql").write_text("INSERT INTO districts (id, name) VALUES (1, 'a');")
    S.load(spark, str(tmp_path / "s.sql"), str(tmp_path / "out"))
    mine = spark.read.parquet(str(tmp_path / "out/districts.parquet")).cache()
    other = spark.range(10).cache()
    assert (mine.count(), other.count()) == (1, 10)
    (tmp_path / "s.sql").write_text("INSERT INTO districts (id, name) VALUES (1, 'a'), (2, 'b');")
    S.load(spark, str(tmp_path / "s.sql"), str(tmp_path / "out"))
    assert other.storageLevel.useMemory and mine.count() == 2
    other.unpersist()


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [300, 4000])
def test_geojson_features(spark, tmp_path, size, indent):
    features = [{"type": "Feature", "geometry": None if i == 3 else {"type": "Point", "coordinates": [37.5 + i, 55.5]}, "properties": {"name": f'n{i} {{"[', "n": i, "list": [{"type": "Feature"}]}} for i in range(9)]
    whole = {"type": "FeatureCollection", "metadata": {"list": [{"a": 1}]}, "others": [{"type": "x"}], "features": features}
    (tmp_path / "x.geojson").write_text(json.dumps(whole, indent=indent))
    rows = R.geometries(R.split_frame(spark, str(tmp_path / "x.geojson"), R.GeoJson, size)).orderBy("line").collect()
    assert [r.properties["name"] for r in rows] == [f["properties"]["name"] for f in features]
    assert [r.geom for r in rows][:4] == ["POINT (37.5 55.5)", "POINT (38.5 55.5)", "POINT (39.5 55.5)", None]
    assert rows[2].properties["n"] == "2" and json.loads(rows[2].properties["list"]) == [{"type": "Feature"}]


def test_defaults(spark, tmp_path):
    """Columns that can't be null take their defaults for NULL and where they aren't named; others stay null."""
    (tmp_path / "s.sql").write_text("INSERT INTO traffic_incidents (id, severity, affects_cargo, description) VALUES (1, NULL, NULL, NULL);\nINSERT INTO cargo_categories (id, name) VALUES (1, NULL);\nINSERT INTO infrastructure_objects (id, created_at) VALUES (1, '2025-01-01 12:00:00');")
    S.load(spark, str(tmp_path / "s.sql"), str(tmp_path / "out"))
    read = lambda t: spark.read.parquet(str(tmp_path / f"out/{t}.parquet")).first()
    r = read("traffic_incidents")
    assert (r.severity, r.affects_cargo, r.incident_type, r.description, r.road_id) == (1, False, "", None, None)
    assert tuple(read("cargo_categories")) == (1, "", "", 0)
    assert str(read("infrastructure_objects").created_at) == "2025-01-01 09:00:00" and read("infrastructure_objects").updated_at is not None
