"""Tables that prove themselves: lost, cut, changed and unfinished ones fail on read."""
import glob
import os
import shutil

import pytest

from edgeloom.sources import tables as T
from edgeloom.sources.proof import BrokenTable, read_proved, write_proved


def _splits(spark, n=40):
    rows = [(("edge_random", "node_disjoint")[i % 2], i % 3, "test" if i % 5 else "train", i, i + 1) for i in range(n)]
    return spark.createDataFrame(rows, "protocol string, seed int, split string, a bigint, b bigint")


def test_splits_replay_only_whole(spark, tmp_path):
    split, path = _splits(spark), str(tmp_path / "s")
    T.write_splits(split, path)
    cols = sorted(split.columns)
    assert sorted(map(tuple, T.read_splits(spark, path).select(cols).collect())) == sorted(map(tuple, split.select(cols).collect()))
    assert T.read_splits(spark, path).filter("protocol = 'edge_random' AND seed = 0").count() == 7
    part = sorted(glob.glob(f"{path}/protocol=*/seed=*/*.parquet"))[0]
    os.rename(part, tmp_path / "away")
    with pytest.raises(BrokenTable, match="rows"):
        T.read_splits(spark, path)


def test_changed_cut_and_unfinished_tables_fail(spark, tmp_path):
    one, other = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string"), spark.createDataFrame([(1, "a"), (2, "")], "k int, t string")
    path, second = str(tmp_path / "one"), str(tmp_path / "other")
    write_proved(one.coalesce(1), path)
    write_proved(other.coalesce(1), second)
    assert read_proved(spark, path).count() == 2
    (mine,), (theirs,) = glob.glob(f"{path}/*.parquet"), glob.glob(f"{second}/*.parquet")
    for hidden in glob.glob(f"{path}/.*.crc"):
        os.remove(hidden)
    shutil.copy(theirs, mine)                                          # as many rows, one null became an empty text
    with pytest.raises(BrokenTable):
        read_proved(spark, path)
    with open(mine, "r+b") as file:
        file.truncate(os.path.getsize(mine) // 2)
    with pytest.raises(Exception):
        read_proved(spark, path)
    one.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(BrokenTable, match="end"):
        read_proved(spark, str(tmp_path / "plain"))


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "k int, t string")
    write_proved(empty, str(tmp_path / "e"))
    assert read_proved(spark, str(tmp_path / "e"), "k int, t string").count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "k int, t string")
    write_proved(twice, str(tmp_path / "t"))
    assert read_proved(spark, str(tmp_path / "t")).count() == 2
