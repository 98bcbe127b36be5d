import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from furrow.sources import catalog as K
from furrow.sources import csv as C
from furrow.sources import sinks


def test_weather_headers_in_either_encoding(spark, tmp_path):
    path = tmp_path / "Metos1" / "CSV"
    path.mkdir(parents=True)
    head = "Data;Precipitação (mm);" + C.mojibake("Temp. Média (°C)")
    (path / "w.csv").write_text("﻿" + head + "\n01/11/2025 - 10:00 / GMT -3;1.234,5;20,5\nbad;-;x\n", encoding="utf-8")
    found = C.find_source(spark, str(tmp_path), "weather_hourly")
    rows = C.load_weather(spark, found).collect()
    assert (rows[0].date, rows[0].precipitation_mm, rows[0].temp_avg_c) == (dt.date(2025, 11, 1), 1234.5, 20.5)
    assert (rows[1].timestamp, rows[1].precipitation_mm) == (None, None)


def test_sources_found_or_not(spark, tmp_path):
    assert C.find_source(spark, str(tmp_path), "pest_list") is None
    with pytest.raises(FileNotFoundError):
        C.find_source(spark, str(tmp_path), "soil_analysis")


def test_scenes_layers_and_traps(spark, tmp_path):
    (tmp_path / "n.csv").write_text("season_id,filename,b1_mean\ns,a_2025-11-01.tiff,\"0.61\"\ns,b.tiff,\n")
    a, b = C.load_scenes(spark, str(tmp_path / "n.csv")).collect()
    assert (a.date, a.image_path, a.b1_mean, b.date, b.b1_mean) == (dt.date(2025, 11, 1), "a_2025-11-01.jpg", 0.61, None, None)
    (tmp_path / "l.csv").write_text("Date Time;Speed - km/h;geometry\n01/02/2026 10:11:12;7,5;POINT (1 2)\n;;\n")
    a, b = C.load_layer(spark, str(tmp_path / "l.csv"), ["Speed - km/h"]).collect()
    assert (a["Speed - km/h"], a.date, a.centroid_lat, b.date, b.centroid_lat) == (7.5, dt.date(2026, 2, 1), 2.0, None, None)
    (tmp_path / "t.csv").write_text("code;type;plot;latitude;longitude;id;radius;installationDate\nc;E;nan;1,5;2;first;3;2025-01-01\nc;E;;1,5;2;second;3;\n")
    (t,) = C.load_traps(spark, str(tmp_path / "t.csv")).collect()
    assert (t.id, t.plot, t.latitude) == ("first", None, 1.5)


def test_save_and_load(spark, tmp_path):
    df = spark.sql("select 1 as a, array('x', 'y') as b")
    sinks.save_tables({"t": df}, str(tmp_path), "csv")
    assert sinks.load_tables(spark, str(tmp_path), ["t"], "csv")["t"].first().b == '["x","y"]'
    sinks.save_tables({"t": df}, str(tmp_path / "p"))
    assert sinks.load_tables(spark, str(tmp_path / "p"), ["t"])["t"].count() == 1


def test_inventory_counts_and_spans(spark, tmp_path):
    from furrow.sources import catalog as K

    (tmp_path / "EKOS").mkdir()
    (tmp_path / "EKOS" / "traps.csv").write_text("createdAt;x\n2025-01-02T03:04:05;1\n1735689600;2\n1899-01-01;3\n")
    (tmp_path / "ndvi_raw_s1_2025-11-01.jpg").write_bytes(b"x")
    files = K.list_files(spark, f"file://{tmp_path}")
    assert {(r.name, r.category, len(r.file_id)) for r in files.collect()} == {("traps.csv", "other", 16), ("ndvi_raw_s1_2025-11-01.jpg", "image", 16)}
    assert [(r.season_id, str(r.date)) for r in K.image_dates(files).collect()] == [("s1", "2025-11-01")]
    path = str(tmp_path / "EKOS" / "traps.csv")
    assert K.file_catalog(spark, str(tmp_path)).first().rows == 3
    assert K.time_span(K.preview(spark, path)) == ("2025-01-01", "2025-01-02")
    assert K.time_span(spark.range(1), "a_2025-01-01_2025-02-01.csv") == ("2025-01-01", "2025-02-01")
    assert K.separator("x", "a|b|c") == "|" and K.separator("EKOS/x") == ";" and K.separator("y") == ","


def plain_rows(data, above, sample):
    if len(data) > above:
        lines = int(len(data) / max(sample / max(data[:sample].count(b"\n"), 1), 1))
        return max(lines - 1, 0), "estimado_por_tamanho"
    return max(data.count(b"\n") - 1, 0), "exato"


def test_file_catalog_of_a_drop(spark, tmp_path):
    from furrow.sources import catalog as K

    big = b"date,x\n" + b"".join(b"2025-01-%02d,%s\n" % (i % 28 + 1, b"y" * (i % 50)) for i in range(9000))
    late = ("a,b\n" + "plain,1\n" * 30_000).encode() + "é,2\n".encode("latin-1")
    drop = {
        "EKOS1/t.csv": "\ufeffcode;createdAt;Nome\nc;05/11/2025 10:00:00;é\nc;06/11/2025 10:00:00;x".encode(),
        "other/us.csv": b"when_date,n\n" + b"2025-03-01,1\n" * 25 + b"04/09/2025,1\n",
        "other/names.csv": b'filename,date\n"a_2024-05-06, x.tif",2001-01-01\nb_2024-07-08.tif,2030-01-01\n',
        "other/epoch.CSV": b"timestamp|pixels_date|count\n1735689600|2020-01-01|2021-01-01\n1|x|y\n",
        "other/late e.csv": late, "big.csv": big, "empty.csv": b"", "head.csv": b"a;b\r\n", "no.txt": b"x",
    }
    for name, data in drop.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    above, sample = 100_000, 20_000
    out = {r.path.rsplit("/", 1)[1].replace("%20", " "): r for r in K.file_catalog(spark, str(tmp_path), above, sample).collect()}
    drop = {n: data for n, data in drop.items() if data and not n.endswith(".txt")}
    assert out.keys() == {n.rsplit("/", 1)[-1] for n in drop}
    for name, data in drop.items():
        r = out[name.rsplit("/", 1)[-1]]
        assert (r.rows, r.row_count_method) == plain_rows(data, above, sample) and r.size_bytes == len(data), name
    span = lambda n: (str(out[n].temporal_min), str(out[n].temporal_max))
    assert (out["t.csv"].separator, out["t.csv"].column_names, out["t.csv"].encoding) == (";", ["code", "createdAt", "Nome"], "UTF-8")
    assert span("t.csv") == ("2025-11-05 10:00:00", "2025-11-06 10:00:00") and span("us.csv") == ("2025-03-01 00:00:00", "2025-04-09 00:00:00")
    assert span("names.csv") == ("2024-05-06 00:00:00", "2024-07-08 00:00:00") and span("epoch.CSV") == ("2025-01-01 00:00:00",) * 2 and out["epoch.CSV"].separator == "|"
    assert (out["late e.csv"].encoding, out["head.csv"].column_names, out["head.csv"].rows) == ("ISO-8859-1", ["a", "b"], 0)


def test_rows_of_large_files_are_counted(spark, tmp_path):
    from furrow.sources import catalog as K

    # short lines first: an estimate from the file's begin tells far more rows
    (tmp_path / "large.csv").write_bytes(b"a;b\n" + b"x;1\n" * 1_200_000 + (b"y" * 998 + b";\n") * 30_000)
    (r,) = K.file_catalog(spark, str(tmp_path)).collect()
    assert r.size_bytes > 30 << 20 and (r.rows, r.row_count_method) == (1_230_000, "exato")


def test_a_late_letter_decides_the_encoding_of_its_file_alone(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes(("a;b\n" + "x;1\n" * 40_000).encode() + "é;2\n".encode("latin-1"))
    (tmp_path / "two.csv").write_bytes("b;a\n3;ç\n".encode())
    assert C.encoding(spark, str(tmp_path / "one.csv")) == "ISO-8859-1" and C.encoding(spark, str(tmp_path / "two.csv")) == "UTF-8"
    rows = C.read_text_columns(spark, str(tmp_path)).where("a <> 'x'").collect()
    assert sorted((r.a, r.b) for r in rows) == [("ç", "3"), ("é", "2")]


def test_a_failed_publication_leaves_the_last_one(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    one, two = spark.sql("select 1 as v, array('x') as xs"), spark.sql("select date'2025-01-02' as d, cast(null as double) as n")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, folder)
    sinks.publish(spark, {"a": one, "b": two}, folder, "csv")
    bad = spark.sql("select cast(raise_error('stop') as int) as v from range(3)")
    with pytest.raises(Exception, match="stop"):
        sinks.publish(spark, {"a": one.withColumn("v", one.v + 1), "b": bad}, folder, "csv")
    assert len(list((tmp_path / "out").iterdir())) == 1
    back = sinks.published(spark, folder)
    assert (back["a"].first().v, back["a"].first().xs, back["b"].first().d, back["b"].first().n) == (1, '["x"]', dt.date(2025, 1, 2), None)
    for i in (2, 3, 4):
        sinks.publish(spark, {"a": one.withColumn("v", one.v * i)}, folder)
    assert len(sinks.versions(spark, folder)) == 2 and sinks.published(spark, folder)["a"].first().v == 4
    (tmp_path / "out" / "99990101T000000000000-unfinished" / "a").mkdir(parents=True)
    assert sinks.published(spark, folder, ["a"])["a"].first().v == 4


def test_manifest_is_five_tables_and_one_json(spark, tmp_path):
    import json

    tables = {n: spark.sql(f"select '{n}' as name, explode(array('é\"', null, 'z')) as v") for n in sinks.MANIFEST_TABLES}
    tables["lineage_summary"] = tables["lineage_summary"].limit(0)
    path = sinks.export_manifest(spark, tables, f"file://{tmp_path}/m")
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/lineage_manifest_json", wholetext=True).collect())
    got = json.loads(text)
    assert list(got) == list(sinks.MANIFEST_TABLES) and got["lineage_summary"] == []
    assert sorted(map(str, got["lineage_coverage"])) == sorted(str({"name": "lineage_coverage", "v": v}) for v in ('é"', None, "z"))
    assert {n: df.count() for n, df in sinks.published(spark, f"file://{tmp_path}/m").items()} == {n: 0 if n == "lineage_summary" else 3 for n in sinks.MANIFEST_TABLES}
    with pytest.raises(ValueError):
        sinks.export_manifest(spark, {}, str(tmp_path))


def test_a_time_is_tried_by_the_one_format_of_its_shape(spark):
    texts = ["2024-03-05 10:11:12", "2024-03-05T10:11:12.123Z", "2024-03-05t10:11:12.5-03", "2024-03-05T10:11:12", "2024-03-05", "05/03/2024 10:11:12", "05/03/2024 - 10:11", "05/03/2024", "13/03/2024", "+02024-03-05", "-2024-03-05", "2024-02-30", " 2024-03-05"]
    texts += ["1709633472", " 1.709633472e9 ", "1709633472000", "+1709633472", "1899-01-01", "2024-3-5", "٢٠٢٤-٠٣-٠٥", "05.03.2024", "word", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    tried = [F.try_to_timestamp("x", F.lit(f)) for f in K.FORMATS]
    number = F.col("x").try_cast("double")
    seconds = [F.when(number.between(9e8, 2.1e9), F.timestamp_seconds(number)), F.when(number.between(9e11, 2.1e12), F.timestamp_seconds(number / 1000))]
    at = F.coalesce(*tried, *seconds)
    shapes = F.array(*[F.col("x").rlike(K._shape(f)) for f in K.FORMATS])
    for r in df.select("x", F.when(F.year(at).between(*K.YEARS), at).alias("all"), K.moment(F.col("x")).alias("one"), F.array(*[t.isNotNull() for t in tried]).alias("parsed"), shapes.alias("shapes")).collect():
        assert r["all"] == r["one"], r["x"]
        assert r["x"] is None or sum(r["shapes"]) <= 1 and all(s or not p for p, s in zip(r["parsed"], r["shapes"], strict=True)), r["x"]


def test_later_formats_and_epochs_take_no_multiple_of_the_first_ones_time(spark):
    def seconds(text):
        df, times = spark.range(100_000, numPartitions=4).select(F.concat(F.lit(text), F.lpad(F.col("id") % 60, 2, "0")).alias("x")), []
        for _ in range(3):
            began = time.perf_counter()
            df.select(K.moment(F.col("x"))).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        return min(times)

    first = seconds("2024-03-05 10:11:")
    assert seconds("05/03/2024 - 10:") < 4 * first and seconds("17096334") < 4 * first  # by failed parses epochs took 4.7 times as long
