import os

import pytest
from pyspark.sql import functions as F

from portolan.schemas import CSV, PARTITIONS, TABLES
from portolan.sinks import publish
from portolan.sinks.publish import Publication
from portolan.sinks.tables import save_flat, save_partitioned, write_flat, write_partitioned
from portolan.sources.tables import read_table
from proxies.queries import fact
from tests.helpers import plan

BY = PARTITIONS["fact_i94"]


def per_month(df):
    return {(r.i94yr, r.i94mon): (r.n, r.keys) for r in df.groupBy(*BY).agg(
        F.count("*").alias("n"), F.sum("i94_key").alias("keys")).collect()}


def test_partitioned_write_reads_back(spark, sf_dir, tmp_path):
    path, entries = str(tmp_path / "f"), fact(spark, sf_dir)
    write_partitioned(entries, path, BY)
    back = read_table(spark, "fact_i94", path)
    assert back.schema.simpleString() == TABLES["fact_i94"].simpleString()
    assert per_month(back) == per_month(entries)
    month = back.where("i94yr = 1998 and i94mon = 5").select("i94_key")
    text = plan(month)
    assert "PartitionFilters: [isnotnull(i94yr" in text
    assert "ReadSchema: struct<i94_key:int>" in text
    assert all("i94yr=1998/i94mon=5/" in f for f in
               month.select("i94_key", F.input_file_name().alias("f")).toPandas().f)


def test_reload_replaces_only_its_months(spark, sf_dir, tmp_path):
    path, entries = str(tmp_path / "f"), fact(spark, sf_dir)
    write_partitioned(entries, path, BY)
    before = per_month(read_table(spark, "fact_i94", path))
    month = entries.where("i94yr = 1998 and i94mon = 5").limit(3)
    write_partitioned(month, path, BY, reload=True)
    after = per_month(read_table(spark, "fact_i94", path))
    assert after.pop((1998, 5))[0] == 3
    before.pop((1998, 5))
    assert after == before
    write_partitioned(month, path, BY)  # a plain overwrite drops the rest
    assert len(per_month(read_table(spark, "fact_i94", path))) == 1


def test_missing_month_is_kept(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.createDataFrame([(1, None, None), (2, 2016, 4)],
                                 "i94_key int, i94yr int, i94mon int")
    write_partitioned(rows, path, BY)
    back = read_table(spark, "fact_i94", path).select("i94_key", *BY)
    assert sorted(map(tuple, back.collect())) == [(1, None, None), (2, 2016, 4)]


def test_hot_month_is_split_and_small_ones_are_not(spark, tmp_path):
    """Two months, one with nearly all rows: the big folder gets many files."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        rows = spark.range(0, 400000, 1, 16).select(
            F.col("id").cast("int").alias("i94_key"), F.lit(2016).alias("i94yr"),
            F.when(F.col("id") % 1000 == 0, 2).otherwise(1).alias("i94mon"))
        path = str(tmp_path / "f")
        write_partitioned(rows, path, BY)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = lambda month: [f for f in os.listdir(f"{path}/i94yr=2016/i94mon={month}")
                           if f.endswith(".parquet")]
    assert len(files(1)) > 4 and len(files(2)) == 1
    assert spark.read.parquet(path).count() == 400000


def test_ungathered_write_does_not_shuffle(spark, tmp_path):
    group = f"write-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, group)
    rows = spark.range(0, 100, 1, 4).select(
        F.col("id").alias("i94_key"), F.lit(2016).alias("i94yr"), F.lit(1).alias("i94mon"))
    write_partitioned(rows, str(tmp_path / "f"), BY, gather=False)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(group)
              for s in tracker.getJobInfo(job).stageIds]
    spark.sparkContext._jsc.clearJobGroup()
    assert len(stages) == 1


RAISES = "if(i94_key = 7, cast(raise_error('bad row') as int), i94_key)"


@pytest.mark.parametrize("gather", [True, False])
@pytest.mark.parametrize("reload", [True, False])
def test_a_failed_write_leaves_the_table(spark, tmp_path, gather, reload):
    path = str(tmp_path / "f")
    rows = spark.range(20).select(F.col("id").cast("int").alias("i94_key"),
                                  F.lit(2016).alias("i94yr"), (F.col("id") % 3).alias("i94mon"))
    write_partitioned(rows, path, BY)
    with pytest.raises(Exception, match="bad row"):
        write_partitioned(rows.withColumn("i94_key", F.expr(RAISES)), path, BY, reload, gather)
    with pytest.raises(Exception):  # the last stage fails: a folder name too long
        write_partitioned(rows.withColumn("i94mon", F.lit("x" * 300)), path, BY, reload, gather)
    assert spark.read.parquet(path).count() == 20
    assert os.listdir(tmp_path) == ["f"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failed_flat_write_leaves_the_table(spark, tmp_path, fmt):
    path = str(tmp_path / "f")
    rows = spark.range(20).select(F.col("id").cast("int").alias("i94_key"))
    write_flat(rows, path, fmt)
    with pytest.raises(Exception, match="bad row"):
        write_flat(rows.withColumn("i94_key", F.expr(RAISES)), path, fmt)
    assert spark.read.schema("i94_key int").options(**CSV).load(path, format=fmt).count() == 20
    assert os.listdir(tmp_path) == ["f"]


class Killed(BaseException):
    """A driver that is gone: nothing runs after it."""


def swap_two(spark, folders, rows):
    """Publish the numbers below `rows` to a flat table in the first folder and, where
    they are odd or even, to partitions of one in the second."""
    with Publication(spark) as publication:
        numbers = spark.range(rows)
        save_flat(numbers, publication.stage(f"{folders[0]}/flat"))
        save_partitioned(numbers.select("id", (F.col("id") % 2).alias("odd")),
                         publication.stage(f"{folders[1]}/parts", parts_only=True), ["odd"])
        publication.commit()


def contents(spark, folders):
    return [sorted(r.id for r in spark.read.schema("id bigint").parquet(f"{folder}/{name}").collect())
            for folder, name in zip(folders, ("flat", "parts"))]


def failing_moves(monkeypatch, fails):
    """Moves of table folders that raise what `fails` gives for their number, from 1."""
    moves = []

    def move(spark, source, target, really=publish._move):
        if "journal" not in source and "home" not in source:
            moves.append(target)
            if fails(len(moves)):
                raise fails(len(moves))
        really(spark, source, target)

    monkeypatch.setattr(publish, "_move", move)
    return moves


@pytest.mark.parametrize("together", [True, False])
@pytest.mark.parametrize("killed_at", range(1, 7))
def test_a_killed_commit_is_finished_by_whoever_comes_next(spark, tmp_path, monkeypatch, killed_at, together):
    """Six moves: two folders in and out of each table's place. The driver dies at each."""
    folders = [str(tmp_path / name) for name in ("lake", "lake" if together else "other")]
    swap_two(spark, folders, 4)
    with monkeypatch.context() as dying:
        failing_moves(dying, lambda n: Killed() if n == killed_at else None)
        dying.setattr(Publication, "_give_up", lambda *_: None)
        with pytest.raises(Killed):
            swap_two(spark, folders, 6)
    assert any(name.startswith(".publish-") for name in os.listdir(folders[0]))
    folder = folders[killed_at % 2]
    assert publish.recover(spark, folder) == 1  # from either folder
    assert contents(spark, folders) == [list(range(6))] * 2
    assert sorted(os.listdir(folders[0]) + os.listdir(folders[1])) == sorted(
        ["flat", "parts"] * 2 if together else ["flat", "parts"])
    assert publish.recover(spark, folder) == 0


def test_a_commit_killed_before_its_journal_published_nothing(spark, tmp_path, monkeypatch):
    folders = [str(tmp_path)] * 2
    swap_two(spark, folders, 4)
    with monkeypatch.context() as dying:
        dying.setattr(publish, "_write", lambda *_: (_ for _ in ()).throw(Killed()))
        dying.setattr(Publication, "__exit__", lambda *_: None)
        with pytest.raises(Killed):
            swap_two(spark, folders, 6)
    assert publish.recover(spark, str(tmp_path)) == 0
    assert contents(spark, folders) == [list(range(4))] * 2
    assert publish.remove_abandoned(spark, str(tmp_path)) == 0  # too young
    assert publish.remove_abandoned(spark, str(tmp_path), hours=-1) == 1
    assert sorted(os.listdir(tmp_path)) == ["flat", "parts"]


@pytest.mark.parametrize("failed_at", range(1, 7))
def test_a_move_that_fails_moves_everything_back(spark, tmp_path, monkeypatch, failed_at):
    folders = [str(tmp_path)] * 2
    swap_two(spark, folders, 4)
    with monkeypatch.context() as failing:
        failing_moves(failing, lambda n: OSError("no") if n == failed_at else None)
        with pytest.raises(OSError):
            swap_two(spark, folders, 6)
    assert contents(spark, folders) == [list(range(4))] * 2
    assert sorted(os.listdir(tmp_path)) == ["flat", "parts"]


@pytest.mark.parametrize("undone", [0, 1, 2])
@pytest.mark.parametrize("failed_at", [2, 4, 6])
def test_a_rollback_that_fails_loses_nothing(spark, tmp_path, monkeypatch, failed_at, undone):
    """The move and, after some are undone, a move back: the old tables are still there."""
    folders = [str(tmp_path)] * 2
    swap_two(spark, folders, 4)
    with monkeypatch.context() as failing:
        moves = failing_moves(failing, lambda n: OSError("no") if n == failed_at or n > failed_at + undone
                              else None)
        with pytest.raises(OSError):
            swap_two(spark, folders, 6)
        assert len(moves) > failed_at
    swapped = publish.recover(spark, str(tmp_path))
    assert contents(spark, folders) == [list(range(4))] * 2
    assert sorted(os.listdir(tmp_path)) == ["flat", "parts"]
    assert swapped == 1 or undone


def test_the_next_write_recovers_first(spark, tmp_path, monkeypatch):
    folders = [str(tmp_path)] * 2
    swap_two(spark, folders, 4)
    with monkeypatch.context() as dying:
        failing_moves(dying, lambda n: Killed() if n == 2 else None)
        dying.setattr(Publication, "_give_up", lambda *_: None)
        with pytest.raises(Killed):
            swap_two(spark, folders, 6)
    assert not os.path.exists(tmp_path / "flat")
    write_flat(spark.range(1), str(tmp_path / "another"))
    assert contents(spark, folders) == [list(range(6))] * 2


def test_flat_csv_has_no_index_column(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame(
        [("A", "NY", 'X, "Y"'), ("B", "NY", " \\ "), ("C", "NY", ""), ("D", None, None)],
        TABLES["dim_port"])
    write_flat(rows, path, "csv")
    text = "".join(open(f"{path}/{f}").read() for f in os.listdir(path) if f.endswith(".csv"))
    assert text.splitlines()[0] == "port_key,state,address"
    back = {r.port_key: (r.state, r.address)
            for r in read_table(spark, "dim_port", path, "csv").collect()}
    # CSV cannot tell an empty text from a missing one.
    assert back == {"A": ("NY", 'X, "Y"'), "B": ("NY", " \\ "), "C": ("NY", None),
                    "D": (None, None)}
    assert 'A,NY,"X, ""Y"""' in text
