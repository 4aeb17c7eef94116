"""Whole log records out of files that are cut into splits anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events
from tidemark.sinks import archive as sink
from tidemark.sources import records
from tidemark.streaming import log_stream


def slow_records(text):
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith(" " * 8) or not line.strip():
            if not out:
                out.append("")
            out[-1] += "\n" + line
        else:
            out.append(line)
    found = [("\n".join(x[8:] if x.startswith(" " * 8) else x for x in r.rstrip().split("\n"))) for r in out]
    return [f.removeprefix("\n") for f in found if f.strip()]


def random_log(rng, n, ending="\n"):
    lines = ["        left over from before", ""] if rng.random() < 0.5 else []
    for k in range(n):
        lines.append(f"archive INFO     MSG: number {k} " + "é" * rng.randint(0, 30))
        for _ in range(rng.choice([0, 1, 3, 3, 60])):
            lines.append(" " * 8 + rng.choice(["DETAIL: d", "HINT: h  ", "more text", "    deeper", ""]))
        if rng.random() < 0.1:
            lines.append("")
    return ending.join(lines) + (ending if rng.random() < 0.5 else "")


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_records_over_splits(spark, tmp_path, split, ending):
    rng = random.Random(split)
    want = []
    (tmp_path / "deep").mkdir()
    for k in range(4):
        text = random_log(rng, [0, 1, 40, 25][k], ending)
        (tmp_path / ("deep" if k % 2 else ".") / f"{k}.log").write_bytes(text.encode())
        want += [(f"{k}.log", r) for r in slow_records(text)]
    with log_stream.settings(spark, {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "16", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}):
        got = records.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.file.split("/")[-1], r.record) for r in got) == sorted(want)


def test_no_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("")
    (tmp_path / "b.log").write_text("\n\n   \n")
    assert records.read_records(spark, str(tmp_path)).count() == 0


def test_a_record_of_four_lines_is_one_event(spark, tmp_path):
    data = [
        (1, "The message", "The detail", "The hint", {"state": "begin", "prefix": "db/"}),
        (2, "Two\nlines: HINT: inside", "a\nb", None, {"rate": "2.5"}),
        (3, "bare", None, None, {}),
    ]
    df = spark.createDataFrame(data, "pid bigint, msg string, detail string, hint string, pairs map<string,string>").withColumn("time", F.timestamp_seconds(F.lit(0)))
    sink.write_records(df, str(tmp_path / "log"))
    with log_stream.settings(spark, {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "4"}):
        found = records.read_records(spark, str(tmp_path / "log"))
    got = events.typed_records(found, fields=("pid", "state", "prefix", "rate")).drop("file")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("The message", "The detail", "The hint", 1, "begin", "db/", None),
        ("Two\nlines: HINT: inside", "a\nb", None, 2, None, None, 2.5),
        ("bare", None, None, 3, None, None, None),
    ]
    text = "".join(p.read_text() for p in (tmp_path / "log").glob("part-*"))
    assert "\n        DETAIL: The detail\n        HINT: The hint\n        STRUCTURED: time=1970" in text
