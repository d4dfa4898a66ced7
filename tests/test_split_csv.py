"""CSV files with line breaks within quotes, cut into ranges at every place."""

from __future__ import annotations

import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from quittance.sources.csv_files import read_csv

SCHEMA = T.StructType().add("n", "integer").add("a", "string").add("b", "string")


@pytest.fixture
def ranges(spark):
    """Cut files into ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[1], "1")
    yield lambda n: spark.conf.set(keys[0], str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


def _text(rng, rows, end):
    def field():
        words = [rng.choice(["x", "", "two words", 'say ""so""', "a,b", "é€😀"]) for _ in range(rng.randint(1, 3))]
        text = rng.choice([" ", "\n", "\n\n", ","]).join(words)
        return f'"{text}"' if rng.random() < 0.6 or set(text) & set(',\n"') else text

    body = "".join(f"{n},{field()},{field()}{end}" for n in range(rows))
    # A whole file's line ends are taken from the first one in it, quoted or not.
    return f'n,"a{end}head",b{end}{body}'


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, end, size", [(1, "\n", 16), (2, "\n", 61), (3, "\r\n", 37), (4, "\n", 10**6)])
def test_ranges_of_any_size_give_what_whole_files_give(spark, tmp_path, ranges, seed, end, size):
    rng, folder = random.Random(seed), tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        (folder / f"{part}.csv").write_bytes(_text(rng, 12 * part, end).encode())
    ranges(size)
    got = read_csv(spark, str(folder), SCHEMA, line_breaks=True)
    assert got.schema == SCHEMA
    assert _rows(got) == _rows(read_csv(spark, str(folder), SCHEMA, line_breaks="whole"))
    assert got.count() == 36


def test_a_record_longer_than_many_ranges(spark, tmp_path, ranges):
    long = "\n".join(["line"] * 200)
    (tmp_path / "in.csv").write_text(f'n,a,b\n1,"{long}",x\n2,y,"{long}"\n3,"",\n')
    ranges(64)
    got = read_csv(spark, str(tmp_path / "in.csv"), SCHEMA, line_breaks=True)
    assert _rows(got) == _rows(read_csv(spark, str(tmp_path / "in.csv"), SCHEMA, line_breaks="whole"))
    assert {len(r["a"] or "") for r in got.collect()} == {len(long), 1, 0}


def test_a_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, ranges):
    (tmp_path / "in.csv").write_text("n,a,b\n" + '1,"x\ny",z\n' * 2000)
    ranges(2000)
    got = read_csv(spark, str(tmp_path / "in.csv"), SCHEMA, line_breaks=True)
    assert got.rdd.getNumPartitions() > 4 and got.count() == 2000


@pytest.mark.parametrize("line", ['1,5" pipe,x', '1,"a" b,x', "1,a", "one,a,b", '1,"never closed,x'])
def test_a_record_that_does_not_fit_fails(spark, tmp_path, line):
    (tmp_path / "in.csv").write_text(f'n,a,b\n{line}\n2,"y",z\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_csv(spark, str(tmp_path / "in.csv"), SCHEMA, line_breaks=True).collect()


@pytest.mark.parametrize("text", ["", "n,a,b", "n,a,b\n", "n,a,b\n\n\n"])
def test_files_without_rows(spark, tmp_path, text):
    (tmp_path / "in.csv").write_text(text)
    assert read_csv(spark, str(tmp_path / "in.csv"), SCHEMA, line_breaks=True).collect() == []


def test_records_over_batches_and_ranges_are_put_together_without_naming_files_per_line(spark, tmp_path, ranges):
    """What a task hands to Python is a line and a number; batches end anywhere in a record."""
    name, body = "spark.sql.execution.arrow.maxRecordsPerBatch", "".join(
        f'{n},"{"é\n" * (n % 5)}",{n}\n' + '9,"a ""b""\n\n,c",\n' * (n % 3) for n in range(60)
    )
    (tmp_path / "in.csv").write_text(f'"n\n",a,b\n{body}')
    whole = _rows(read_csv(spark, str(tmp_path / "in.csv"), SCHEMA, line_breaks="whole"))
    before = spark.conf.get(name)
    try:
        for batch in ("1", "2", "7", "1000"):
            spark.conf.set(name, batch)
            for size in (40, 333, 10**6):
                ranges(size)
                got = read_csv(spark, str(tmp_path / "in.csv"), SCHEMA, line_breaks=True)
                assert _rows(got) == whole
    finally:
        spark.conf.set(name, before)
    handed = [x for x in got._jdf.queryExecution().toString().splitlines() if "MapInArrow" in x and "(" in x]
    assert handed and not any("file#" in x for x in handed)
