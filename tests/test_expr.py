import hashlib

from pyspark.sql import functions as F

from steward.functions import (
    activation_energy, change_of, draw, effective_limit, field, has_suffix, parse_bytes,
    strip_op, valid_id,
)


SIZES = {
    "50GB": 50 * 10**9, "50 GiB": 50 * 2**30, "1.5 kb": 1500, "1,024 MB": 1024 * 10**6,
    "2TB": 2 * 10**12, "7": 7, "7 b": 7, "3 KI": 3072, "4\tmib ": 4 * 2**20, "0.3b": 0, "x": None,
    "": None, " 5GB": None, "1.2.3 GB": None, "5 furlongs": None, "7 EB": 7 * 10**18,
    "9999 EB": None, ".": None, None: None,
}


def test_parse_bytes(spark):
    df = spark.createDataFrame([(t,) for t in SIZES], "t string")
    assert dict(df.select("t", parse_bytes(F.col("t"))).collect()) == SIZES


def test_fields_split_on_unicode_space(spark):
    rows = {
        "a b": ("a", "b"), "  a\t\tb c ": ("a", "b"), "a b\r": ("a", "b"), "a b c d": ("a", "b"),
        "\u00a0a\u3000b": ("a", "b"), "one": ("one", ""), "one \u2003": ("one", ""), "   ": ("", ""),
        "": ("", ""), "a\u200bb": ("a\u200bb", ""), "a\u0085b\u2028c": ("a", "b"),
    }
    df = spark.createDataFrame([(k,) for k in rows], "v string")
    got = df.select("v", field(F.col("v"), 0).alias("a"), field(F.col("v"), 1).alias("b")).collect()
    assert {r.v: (r.a, r.b) for r in got} == rows


def test_op_and_suffix(spark):
    df = spark.createDataFrame([("+x",), ("-x",), ("+-x",), ("-+x",), ("++x",), ("x",)], "v string")
    got = [tuple(r) for r in df.select(strip_op(F.col("v")), change_of(F.col("v"))).collect()]
    assert got == [
        ("x", "add"), ("x", "remove"), ("x", "add"), ("+x", "remove"), ("+x", "add"), ("x", None),
    ]
    assert df.filter(has_suffix(F.col("v"), "+x")).count() == 3


def test_valid_id(spark):
    good = ["Qm" + "a" * 44, "b" + "a" * 58]
    bad = ["Qm" + "a" * 43, "Qm" + "0" * 44, "b" + "1" * 58, "b" + "a" * 57, "", "x" + good[0]]
    df = spark.createDataFrame([(i,) for i in good + bad], "id string")
    assert [r.id for r in df.filter(valid_id(F.col("id"))).collect()] == good


def test_draw_and_energy(spark):
    df = spark.range(2000).select(F.col("id").cast("string"), F.lit("n1").alias("node_id"))
    got = df.select("id", draw(7, 0, F.col("node_id"), F.col("id")).alias("d")).collect()
    for row in got[:20]:
        digest = hashlib.md5(f"7|0|n1|{row.id}".encode()).hexdigest()
        assert row.d == int(digest[:6], 16) / 2**24
    assert 0.45 < sum(r.d for r in got) / len(got) < 0.55
    assert {r.d for r in got} != {
        r.d for r in df.select(draw(7, 1, F.col("node_id"), F.col("id")).alias("d")).collect()
    }
    energy = spark.range(1).select(activation_energy(F.lit(1), F.lit(3)).alias("e"))
    assert energy.schema["e"].dataType.typeName() == "float"


def test_effective_limit(spark):
    df = spark.createDataFrame(
        [(10, 5, False), (10, 5, True), (5, 10, False), (None, 5, False)],
        "l bigint, f bigint, i boolean",
    )
    got = df.select(effective_limit(F.col("l"), F.col("f"), F.col("i")).alias("m")).collect()
    assert [r.m for r in got] == [5, 10, 5, None]
