import base64
import random

import pytest

from rows import rows_of
from steward.operators.diff import latest_line
from steward.operators.fold import fold_changes
from steward.sources import text

QM = "Qm" + "a" * 44
B32 = "b" + base64.b32encode(b"\x01\x55\x12\x20" + b"a" * 32).decode().lower().rstrip("=")


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())


def test_scan_and_quarantine(spark, tmp_path):
    write(tmp_path, {
        "a.ks": "1 one\n\n  2\ttwo extra fields\nlonely\n3 three\r\n",
        "a/x.ks": "4 four\n", "deep/er/y.ks": "5 five",
        "README.md": "8 eight\n", "_README.md": "9 nine\n",
    })
    good, rejected = text.scan_manifest(spark, str(tmp_path), "m")
    assert rows_of(good, "manifest", "id", "name") == [
        ("m", "1", "one"), ("m", "2", "two"), ("m", "3", "three"), ("m", "4", "four"), ("m", "5", "five"),
    ]
    assert rows_of(rejected, "value", "reason") == [("", "blank"), ("lonely", "one_field")]


@pytest.mark.parametrize("name", ["_u.ks", ".hid/z.ks", "sub/_d/x.ks"])
def test_manifests_that_spark_would_skip_fail_the_scan(spark, tmp_path, name):
    write(tmp_path, {"a.ks": "1 one\n", name: "7 seven\n"})
    with pytest.raises(ValueError, match="does not list"):
        text.scan_manifest(spark, str(tmp_path))


def test_ids_are_checked_on_request_only(spark, tmp_path):
    write(tmp_path, {"a.ks": f"{QM} one\nnope two\n{B32} three\n"})
    assert text.scan_manifest(spark, str(tmp_path)).good.count() == 3
    good, rejected = text.scan_manifest(spark, str(tmp_path), id_pattern=text.ID_PATTERN)
    assert rows_of(good, "name") == [("one",), ("three",)]
    assert rows_of(rejected, "reason") == [("invalid_id",)]


def test_last_line_wins_in_walk_order(spark, tmp_path):
    # The walk enters directory "a" before it reads file "a.ks", and "a b" sorts before "a+b".
    write(tmp_path, {
        "a.ks": "x from-file\n", "a/x.ks": "x from-folder\n",
        "p q/1.ks": "y space\n", "p+q/1.ks": "y plus\n",
        "z.ks": "z first\nz second\nz third\n",
    })
    lines = text.scan_manifest(spark, str(tmp_path)).good
    assert rows_of(latest_line(lines, text.ORDER)) == [
        ("x", "from-file"), ("y", "plus"), ("z", "third"),
    ]


def test_order_holds_across_splits(spark, tmp_path):
    rng = random.Random(3)
    names = {}
    content = []
    for n in range(4000):
        id_ = f"id{rng.randrange(50)}"
        names[id_] = f"line{n}" + "x" * rng.randrange(30)
        content.append(f"{id_} {names[id_]}\n")
    write(tmp_path, {"m.ks": "".join(content)})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = text.scan_manifest(spark, str(tmp_path)).good
        assert lines.rdd.getNumPartitions() > 5
        assert dict(rows_of(latest_line(lines, text.ORDER))) == names
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_patch(spark, tmp_path):
    write(tmp_path, {"p.patch": "\n".join([
        "diff --git a/m.ks b/m.ks", "index 12..34", "--- a/m.ks", "+++ b/m.ks", "@@ -1 +1 @@",
        f" {QM} context", f"+{QM} added", f"-{B32} removed", f"+ {QM} spaced", "+nope name",
        f"+{QM}", f"-{QM} old", f"+{QM} new",
    ])})
    rows = text.scan_patch(spark, str(tmp_path))
    assert rows_of(rows, "op", "id", "name") == sorted([
        ("add", QM, "added"), ("remove", B32, "removed"), ("remove", QM, "old"), ("add", QM, "new"),
    ])
    assert rows_of(fold_changes(rows, text.ORDER), "id", "change", "name") == [
        (QM, "add", "new"), (B32, "remove", "removed"),
    ]
