"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from wakeline.operators import cases as K
from wakeline.operators import reports as R
from wakeline.operators import scenes as S
from wakeline.sources import ais_csv, archive_index
from wakeline.sources.case_store import CaseStore

HEAD = ",".join(R.RAW_COLUMNS)
ROW = "367777550,2022-06-01T00:00:02,28.1,-96.9,0.0,360.0,511.0,HARRY LEE,,WDJ4420,{},0,0,0,0.0,{},A"


def test_codes_beyond_integers_are_null(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join([HEAD, ROW.format("99999999999", "52"), ROW.format("1e300", "-99999999999"), ROW.format("70.9", "x")]) + "\n")
    got = R.parse(ais_csv.read(spark, str(tmp_path / "in.csv"))).orderBy("pos").collect()
    assert [(r.type_code, r.cargo_code) for r in got] == [(None, 52), (None, None), (70, None)]


def test_every_file_of_a_folder_has_its_header_checked(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.csv").write_text("\n".join([HEAD, ROW.format("52", "52")]) + "\n")
    (tmp_path / "d/b.csv").write_text("\n".join([",".join(R.RAW_COLUMNS[::-1]), ROW.format("52", "52")]) + "\n")
    with pytest.raises(ValueError, match="order"):
        ais_csv.read(spark, str(tmp_path / "d"))


def test_limit_bounds_the_rows_examined(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join([HEAD, *[ROW.format(i, i) for i in range(1, 9)]]) + "\n")
    assert [r.VesselType for r in ais_csv.read(spark, str(tmp_path / "in.csv"), limit=3).orderBy("pos").collect()] == ["1", "2", "3"]


def test_archive_index_skips_the_comment_block(spark, tmp_path):
    head = "Subset\tJPG file name\tXmin of the object [px]\tYmin\tXmax\tYmax"
    lines = ["/* DATA DESCRIPTION:", "Citation:\tSomeone (2021): A title", "\tand more\t*", "*/", "", head, "train\ta.jpg\t1\t2\t5\t9", "train\ta.jpg\t3\t3\t3\t8", "test\tb.jpg\t1\t1"]
    (tmp_path / "i.tab").write_text("\n".join(lines) + "\n")
    cols = {"subset": "Subset", "jpg": "JPG", "x0": "Xmin", "y0": "Ymin", "x1": "Xmax", "y1": "Ymax"}
    rows = archive_index.read(spark, str(tmp_path / "i.tab"), cols)
    assert sorted((r.subset, r.jpg, r.x1) for r in rows.collect()) == [("test", "b.jpg", None), ("train", "a.jpg", "3"), ("train", "a.jpg", "5")]
    images = {r.jpg: (len(r.boxes), r.objects) for r in archive_index.by_image(rows, "jpg", ["x0", "y0", "x1", "y1"]).collect()}
    assert images == {"a.jpg": (1, 2), "b.jpg": (0, 1)}
    (tmp_path / "plain.tab").write_text("\n".join(lines[5:7]) + "\n")
    assert archive_index.read(spark, str(tmp_path / "plain.tab"), cols).count() == 1
    with pytest.raises(ValueError, match="title"):
        archive_index.read(spark, str(tmp_path / "plain.tab"), {"x": "nothing like it"})


def test_documents_and_tiles_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", [1.0, 2.0]), (2, "val", None)], "id int, split string, values array<double>")
    K.write_documents(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == sorted(map(tuple, df.collect()))
    S.write_by_split(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter(F.col("split") == "val").first().id == 2


def test_csv_cells_quote_only_where_needed(spark):
    df = spark.createDataFrame([("a,b", 'say "x"', None, "plain")], "a string, b string, c string, d string")
    assert df.select(K.line(*[F.col(c) for c in df.columns]).alias("l")).first().l == '"a,b","say ""x""",,plain'


def _extract(path, n=40):
    path.mkdir()
    for i in range(4):
        lines = [f"36777755{j % 10},2022-06-{1 + j % 9:02d}T00:00:02,{20 + j}.1,{-90 - j % 7}.5,0.0,360.0,511.0,A,,C,52,0,0,0,0.0,{j},A" for j in range(i * n // 4, (i + 1) * n // 4)]
        (path / f"{i}.csv").write_text("\n".join([HEAD, *lines, "367777550,2022-06-03T00:00:00,north,-91.0,,,,,,,,,,,,bad,A"]) + "\n")
    return str(path)


def test_bounds_are_filters_of_the_scan(spark, tmp_path):
    path = _extract(tmp_path / "d")
    box, span = (-93.0, 25.0, -91.0, 50.0), ("2022-06-02T00:00:00", "2022-06-06T00:00:00")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    got = ais_csv.scan(spark, path, box, *span)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all(f"{f}({c}" in plan.split("PushedFilters")[1].split("ReadSchema")[0] for f, c in (("GreaterThanOrEqual", "LAT"), ("LessThanOrEqual", "LON"), ("LessThan", "BaseDateTime")))
    raw = ais_csv.read(spark, path).filter(F.col("LON").try_cast("double").between(-93, -91) & F.col("LAT").try_cast("double").between(25, 50) & (F.col("BaseDateTime") >= span[0]) & (F.col("BaseDateTime") < span[1]))
    want = sorted(r.Cargo for r in raw.collect())
    assert sorted(r.Cargo for r in got.collect()) == want and len(want) == 2
    stream = ais_csv.stream(spark, path, 1, box, *span)
    q = stream.writeStream.format("memory").queryName("bounded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted(r.Cargo for r in spark.table("bounded").collect()) == want and len(q.recentProgress) >= 4


def test_funnel_while_streaming(spark, tmp_path):
    path = _extract(tmp_path / "d")
    bounds = (-93.0, 25.0, -91.0, 50.0), (1_654_128_000_000_000, 1_654_473_600_000_000)
    counts = R.funnel(R.parse(ais_csv.stream(spark, path, 2)), *bounds)
    counts.writeStream.format("memory").queryName("funnel").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination(120)
    batch = R.funnel(R.parse(ais_csv.read(spark, path)), *bounds).first()
    assert spark.table("funnel").first() == batch and batch.rows_examined == 44 and batch.unusable == 4


def test_only_first_bytes_are_read(spark, tmp_path):
    import gzip

    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.csv").write_text("one\ntwo\n")
    (tmp_path / "h/_b.csv").write_text("hidden\n")
    (tmp_path / "h/c.csv").write_text("")
    (tmp_path / "h/d.csv.gz").write_bytes(gzip.compress(b"packed\nx\n"))
    assert sorted(ais_csv.first_lines(spark, str(tmp_path / "h"))) == [["one"], ["packed"]]


def test_a_case_is_replaced_at_once_or_not_at_all(spark, tmp_path):
    store = CaseStore(spark, str(tmp_path / "cases"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert store.versions().count() == 0
    one = store.put("a", {"t": rows(1, 2)})
    store.put("b", {"t": rows(7)})
    old = store.table("t", "a")

    def dies():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        store.put("a", {"t": rows(3)}, before_commit=dies)
    assert {r["case"]: r.version for r in store.versions().collect()}["a"] == one
    assert sorted(r.v for r in store.table("t").collect()) == [1, 2, 7]
    two = store.put("a", {"t": rows(5)})
    assert sorted(r.v for r in old.collect()) == [1, 2]  # a reader that began before
    assert sorted((r["case"], r.v) for r in store.table("t").collect()) == [("a", 5), ("b", 7)]
    assert store.versions().count() == 2 and store.clean() == 1 and one != two
    with pytest.raises(KeyError):
        store.table("t", "c")
    with pytest.raises(ValueError):
        store.put("../a", {"t": rows(1)})
