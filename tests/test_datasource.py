"""Logs and gridded text through ``spark.read.format``: the same rows as the readers of whole files give, at any range of bytes."""

import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from profilion.sources import datasource, formats, gridded, messages

START = 1_767_225_600_000_000


@pytest.fixture(scope="module")
def profiles(spark):
    rows = spark.range(60).select((F.lit(START) + F.col("id") * 30_000_000).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(24)), lambda g: (g * 7 + F.col("id")) % 50 * 1e-7 - 1e-6).alias("beta"))
    datasource.register(spark)
    return rows.withColumn("r", F.transform("beta", lambda _b, i: i * 10.0 + 5.0)).repartition(3)


@pytest.fixture(scope="module")
def log(profiles, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("log") / "messages")
    messages.write(profiles, folder, unit=1e-8)
    first = next(p for p in sorted(Path(folder).iterdir()) if p.suffix == ".txt")
    text = first.read_bytes()
    (first.parent / f".{first.name}.crc").unlink()
    # a message without a stamp, one that is cut off, one without digits, and one whose checksum is wrong
    stamp = text.split(b"\r\n", 1)[0]
    first.write_bytes(text.replace(stamp + b"\r\n", b"", 1) + b"\x01CL010112\r\nnothing\r\n" + text[text.index(b"\x01") :][:120] + b"\r\n" + b"-2026-01-02 00:00:00\r\n" + text[text.index(b"\x01") :].split(b"\x03")[0] + b"\x03ffff\r\n")
    return folder


@pytest.mark.parametrize("width", [1, 97, 1000, 1 << 26])
def test_messages(spark, log, width):
    if width == 1:
        width = 13  # a task for every few bytes
    found = spark.read.format("profilion_messages").option("unit", "1e-8").option("range_bytes", width).load(log)
    wanted = messages.parse(messages.split_messages(messages.records(spark, log)), 1e-8)
    columns = ["t", "beta", "r", "quality", "window", "mode", "background", "cloud_base_reported", "vertical_visibility", "alarm", "crc_ok"]
    rounded = F.transform("beta", lambda b: F.round(b * 1e8))
    a, b = (sorted(x.withColumn("beta", rounded).select(*columns).collect(), key=str) for x in (found, wanted))
    assert a == b and len(a) == 61 and sum(x.t is None for x in a) == 1


def test_filters_are_pushed(spark, log):
    found = spark.read.format("profilion_messages").schema("t long, beta array<double>").option("unit", "1e-8").load(log)
    some = found.where((F.col("t") >= START + 60_000_000) & (F.col("t") < START + 150_000_000))
    assert sorted(r.t for r in some.collect()) == [START + k * 30_000_000 for k in (2, 3, 4)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan profilion_messages" in plan and "isnotnull(t" in plan and ">=" not in plan and "<" not in plan  # the source sees to the bounds
    path = spark.read.format("profilion_messages").load(log).select("path").first().path
    one = spark.read.format("profilion_messages").load(log).where(F.col("path") == path)
    assert one.select("path").distinct().collect() == [(path,)]


def test_sql(spark, log):
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW logged USING profilion_messages OPTIONS (path '{log}', unit '1e-8')")
    assert spark.sql(f"SELECT count(*) FROM logged WHERE t >= {START} AND crc_ok").first()[0] == 59


@pytest.mark.parametrize("width", [7, 500, 1 << 26])
def test_gridded(spark, profiles, tmp_path, width):
    folder = str(tmp_path / "grid")
    gridded.write(profiles, folder, [g * 10.0 + 5.0 for g in range(25)], range_corrected=True)
    (Path(folder) / "short.csv").write_text("# note : 1\n\ntime,1,2,3\n2026-01-01T00:00:00,1,bad\n10.5,nan,,7,8\nnever,1,2,3\n2026-01-01T01:00:00+01:00,1,2,3")
    with gzip.open(f"{folder}/more.csv.gz", "wt") as file:
        file.write("time,1,2\n5,1,2\n6,3,4\n")
    found = spark.read.format("profilion_grid").option("range_bytes", width).load(folder)
    wanted = gridded.read(spark, folder)
    columns = ["t", "beta", "r", "range_corrected", "background_subtracted"]
    a, b = (sorted(x.select(*columns).collect(), key=str) for x in (found, wanted))
    assert a == b and len(a) == 65
    assert found.where("t = 5000000").select("beta").collect() == [([1.0, 2.0],)]


def test_errors(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("time,high\n1,2\n")
    for name, path in (("profilion_grid", str(tmp_path)), ("profilion_messages", str(tmp_path / "nowhere"))):
        with pytest.raises(Exception, match="no header|no such file"):
            spark.read.format(name).load(path).collect()


def test_large_files_are_looked_at_by_their_heads(spark, log, tmp_path):
    """A sparse log of three gigabytes: more than one value of Spark could hold."""
    folder = tmp_path / "large"
    folder.mkdir()
    head = next(p for p in sorted(Path(log).iterdir()) if p.suffix == ".txt").read_bytes()
    with (folder / "large.dat").open("wb") as file:
        file.write(head)
        file.truncate(3 << 30)
    (folder / "grid.csv").write_text("# note\ntime,1,2\n1,2,3\n")
    found = {r.path.rsplit("/", 1)[-1]: (r.length, r.form) for r in formats.looked_at(spark, [str(folder)]).collect()}
    assert found == {"large.dat": (3 << 30, "messages"), "grid.csv": ((folder / "grid.csv").stat().st_size, "gridded")}
    assert formats.by_format(spark, [str(folder)]) == {"gridded": [f"file:{folder}/grid.csv"], "messages": [f"file:{folder}/large.dat"]}
    assert formats.by_format(spark, [log]) == {"messages": [log]}
