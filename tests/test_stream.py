import os

from rows import rows_of
from pyspark.sql import functions as F
from steward.fixtures import ANY_ID
from steward.sources import tables
from steward.streaming.changes import in_turn, stream_changes


def test_each_patch_is_applied_once_and_in_turn(spark, catalog, tmp_path):
    patches, root = tmp_path / "patches", str(tmp_path / "catalog")
    patches.mkdir()
    tables.write_catalog(catalog(("a", "x", 9, "local", 2), ("a", "y", 9, "local", 2), ("b", "y", 9, "local", 2)), root)

    def arrive(name, text, at):
        path = patches / name
        path.write_text(text)
        os.utime(path, (at, at))

    def run(progress="progress"):
        query = stream_changes(
            spark, str(patches), str(tmp_path / progress), root,
            as_of=lambda batch: f"2024-03-{batch + 1:02d} 00:00:00", id_pattern=ANY_ID,
            assign=lambda changes: changes.withColumn("node_id", F.lit("a")),
        )
        query.awaitTermination()
        return tables.last_commit(spark, root, "patches").version

    # The second patch, by age, takes back what the first adds; folded together with
    # it they would leave the old row of "x" in place. Both come in one batch and one change.
    arrive("b.patch", "+x again\n+new one\n", 1_700_000_000)
    arrive("a.patch", "-x again\n context line\n", 1_700_000_100)
    arrive("ignored.txt", "-y y\n", 1_700_000_000)
    assert run() == 2
    other = ("b", "y")  # a node that does not follow these patches
    now = tables.read_catalog(spark, root)
    assert rows_of(now, "node_id", "id", "name", "status") == [
        ("a", "new", "one", "remote"), ("a", "y", "y.png", "local"), (*other, "y.png", "local"),
    ]

    # Nothing new: no batch, no snapshot.
    assert run() == 2

    arrive("c.patch", "-y y\n", 1_700_000_200)
    assert run() == 3
    assert rows_of(tables.read_catalog(spark, root), "id", "modified")[0][1].day == 1

    # With its progress lost the stream hands the files over again, in other batches; they are skipped.
    assert run("fresh") == 3
    assert rows_of(tables.read_catalog(spark, root), "node_id", "id") == [("a", "new"), other]

    # A patch far older than those seen is read, and so is a new one beside files that were handed over before.
    arrive("late.patch", "+late one\n", 1_600_000_000)
    assert run() == 4
    arrive("d.patch", "+other one\n", 1_700_000_300)
    assert run("third") == 5
    assert rows_of(tables.read_catalog(spark, root), "node_id", "id") == [
        ("a", "late"), ("a", "new"), ("a", "other"), other,
    ]


def test_patches_of_one_age_go_by_path(spark, catalog, tmp_path):
    patches, root = tmp_path / "patches", str(tmp_path / "catalog")
    patches.mkdir()
    tables.write_catalog(catalog(("a", "x", 9, "local", 2)), root)
    for name, text in (("2.patch", "+x second\n"), ("1.patch", "-x first\n"), ("3.patch", "+y y\n")):
        (patches / name).write_text(text)
        os.utime(patches / name, (1_700_000_000, 1_700_000_000))
    stream_changes(
        spark, str(patches), str(tmp_path / "progress"), root, as_of=lambda batch: "2024-03-01 00:00:00", id_pattern=ANY_ID,
        assign=lambda changes: changes.withColumn("node_id", F.lit("a")),
    ).awaitTermination()
    assert rows_of(tables.read_catalog(spark, root), "id", "name") == [("x", "second"), ("y", "y")]


def test_numbered_patches_wait_for_their_turn(spark, catalog, tmp_path):
    patches, root, rejects = tmp_path / "patches", str(tmp_path / "catalog"), str(tmp_path / "rejects")
    patches.mkdir()
    tables.write_catalog(catalog(("a", "x", 9, "local", 2)), root)
    age = iter(range(1_700_000_000, 1_700_000_100))

    def arrive(n, text, name="{}.patch"):
        path = patches / name.format(n)
        path.write_text(text)
        at = next(age)
        os.utime(path, (at, at))

    def run():
        stream_changes(
            spark, str(patches), str(tmp_path / "progress"), root, as_of=lambda batch: "2024-03-01 00:00:00", id_pattern=ANY_ID,
            assign=lambda changes: changes.withColumn("node_id", F.lit("a")), number=r"(\d+)\.patch$", first=1, rejects=rejects,
        ).awaitTermination()
        return rows_of(tables.read_catalog(spark, root), "id", "name")

    def refused():
        found = spark.read.parquet(rejects).select("number", "reason", "value").collect()
        return sorted((r.number, r.reason, r.value) for r in found)

    arrive(3, "-y y\n")  # the oldest file is the last patch
    assert run() == [("x", "x.png")] and refused() == [(3, "waits for 1", None)]
    arrive(1, "+y one\n+?? bad\n")
    assert run() == [("x", "x.png"), ("y", "one")]
    assert ("waits for 2" in {r[1] for r in refused()}) and (1, "invalid_id", "+?? bad") in refused()
    arrive(2, "+y two\n-x x\n")
    assert run() == []  # the second patch, and then the third, which had been waiting
    arrive(2, "+z z\n", "again-{}.patch")
    assert run() == [] and (2, "late", None) in refused()
    arrive(4, "+z four\n")
    assert run() == [("z", "four")]


def test_turns():
    import pandas as pd

    def files(*numbers):
        return pd.DataFrame([{"number": n, "path": f"p{n}"} for n in numbers], columns=["number", "path"])

    rows, following, held = in_turn(files(5, 2, 1, 1), 1, [])
    assert [(r["number"], r["turn"], r["missing"]) for r in rows] == [(1, "late", None), (1, "ready", None), (2, "ready", None), (5, "held", 3)]
    rows, following, held = in_turn(files(4, 3, 0), following, held)
    assert [(r["number"], r["turn"]) for r in rows] == [(0, "late"), (3, "ready"), (4, "ready"), (5, "ready")]
    assert following == 6 and held == []
