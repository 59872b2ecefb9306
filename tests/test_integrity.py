import datetime
import hashlib
import os

from pyspark.sql import functions as F
from rows import rows_of
from steward.operators import integrity

LINK, PIN = "parent string, child string", "cid string, pin_type string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sweep_follows_recursive_pins_to_any_depth_and_through_cycles(table):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(12)]
    links = table(LINK, *chain, ("c12", "c3"), ("d", "d1"), ("hub", "c12"), ("hub", "d1"))
    blocks = table("cid string", *[(f"c{i}",) for i in range(13)], ("d",), ("d1",), ("hub",))
    pins = table(PIN, ("c4", "recursive"), ("d", "direct"))
    got = {r.cid for r in integrity.sweep(blocks, links, pins).collect()}
    assert got == {"c0", "c1", "c2", "d1", "hub"}
    everything = integrity.sweep(blocks, links, table(PIN))
    assert everything.count() == 16


def test_bad_blocks(table):
    expected = table(
        "cid string, digest string",
        ("ok", sha("ok")), ("bad", sha("ok")), ("void", None), ("lost", sha("x")), ("free", sha("y")),
    )
    stored = table("cid string, content string", ("ok", "ok"), ("bad", "no"), ("void", "v"), ("free", "n"))
    assert rows_of(integrity.verify_blocks(stored, expected)) == [("bad",), ("free",), ("lost",), ("void",)]
    links = table(LINK, ("p", "bad"), ("q", "bad"), ("q", "ok"), ("r", "void"))
    pins = table(PIN, ("p", "recursive"), ("q", "recursive"), ("r", "direct"), ("lost", "direct"))
    # One id per bad block under a pin, though two pins share it; never that of a pin.
    assert rows_of(integrity.verify_blocks(stored, expected, pins, links)) == [("bad",), ("lost",)]


def test_bad_nodes_of_several_pins_count_once(table):
    verdicts = table("pin string, bad_nodes array<string>", ("p", ["x", "y"]), ("q", ["y"]), ("r", []))
    assert rows_of(integrity.distinct_bad(verdicts)) == [("x",), ("y",)]


def test_repair(table):
    bad = table("cid string", ("x",), ("y",))
    seen = table("id string, peer_id string, ok boolean", ("x", "p", True), ("x", "q", True), ("y", "p", False))
    assert rows_of(integrity.repair_plan(bad, seen), "cid", "step", "action", "repairable") == [
        ("x", 1, "unpin", True), ("x", 2, "pin", True), ("y", 1, "unpin", False), ("y", 2, "pin", False),
    ]
    assert {r.repairable for r in integrity.repair_plan(bad).collect()} == {None}


def test_unpin(catalog, table):
    files = catalog(("a", "x", 1, "local", 1), ("a", "y", 1, "remote", 1), ("b", "x", 1, "remote", 1), ("a", "z", 1, "local", 1))
    removed = table("id string", ("x",), ("y",), ("z",))
    assert rows_of(integrity.unpin_plan(removed, files)) == [("a", "x"), ("a", "z")]
    pins = table(PIN, ("x", "recursive"), ("q", "direct"))
    assert rows_of(integrity.unpin_plan(removed, files, pins)) == [("a", "x")]
    assert rows_of(integrity.scan_pins(pins)) == [("q",)]
    assert rows_of(integrity.scan_pins(pins, "recursive")) == [("x",)]


def walk(links, roots):
    below = {}
    for a, b in links:
        below.setdefault(a, set()).add(b)
    seen, todo = set(roots), list(roots)
    while todo:
        for child in below.get(todo.pop(), ()):
            if child not in seen:
                seen.add(child)
                todo.append(child)
    return seen


def reached(table, links, roots, rounds=None):
    found = integrity.reachable(table("parent string, child string", *links), table("cid string", *[(r,) for r in roots]), rounds)
    rows = [r.cid for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_a_chain_of_a_thousand_takes_twelve_rounds(table):
    links, rounds = [(f"c{k}", f"c{k + 1}") for k in range(999)], []
    assert reached(table, links, ["c0"], rounds) == {f"c{k}" for k in range(1000)}
    assert len(rounds) <= 12


def test_reachable_on_random_graphs(table, monkeypatch):
    import random

    for seed, deep, growth in ((1, 0, 4), (2, 32, 4), (3, 32, 0), (4, 1, 1)):
        draw = random.Random(seed)
        monkeypatch.setattr(integrity, "DEEP", deep or 1_000_000)
        monkeypatch.setattr(integrity, "GROWTH", growth)
        n = 120
        links = [(f"v{draw.randint(0, n)}", f"v{draw.randint(0, n)}") for _ in range(130)]
        links += [(f"p{k}", f"p{k + 1}") for k in range(60)] + [("v3", "p0"), ("p60", "v7"), ("p30", "p10")] + links[:5]
        roots = ["v3", "p5", "nowhere"]
        assert reached(table, links, roots) == walk(links, roots)


def test_deep_chains_on_nodes_of_their_own(table):
    links = [(f"c{k}", f"c{k + 1}") for k in range(150)]
    roots = table("node_id string, cid string", ("a", "c0"), ("b", "c100"))
    found = integrity.reachable(table("parent string, child string", *links), roots)
    assert sorted(map(tuple, found.select("node_id", "cid").collect())) == sorted(
        [("a", f"c{k}") for k in range(151)] + [("b", f"c{k}") for k in range(100, 151)]
    )


def test_links_are_laid_out_once(table, spark):
    from pyspark.sql import functions as F

    from steward.session import laid_out

    links = laid_out(table("parent string, child string", *[(f"{k}", f"{k + 1}") for k in range(50)]), "parent", 4)
    found = table("parent string", ("3",)).withColumn("parent", F.concat("parent", F.lit("")))
    joined = links.join(found.hint("shuffle_merge"), "parent", "left_semi")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan  # of what was found alone


def test_contents_are_read_once(table, spark, tmp_path):
    """Files of a node: a second run reads none, a new or changed one is read, others stay unopened."""
    folder, root = tmp_path / "files", str(tmp_path / "ledger")
    folder.mkdir()

    def put(name, content, time):
        (folder / name).write_bytes(content)
        os.utime(folder / name, (time, time))

    def run():
        files = spark.read.format("binaryFile").load(str(folder))
        stored = files.select(
            F.lit("n").alias("node_id"), F.element_at(F.split("path", "/"), -1).alias("cid"), F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"), "content",
        )
        return dict(rows_of(integrity.kept_digests(stored, root), "cid", "digest"))

    def digest(content):
        return hashlib.sha256(content).hexdigest()

    put("a", b"one", 1_000_000)
    put("b", b"two", 1_000_000)
    want = {"a": digest(b"one"), "b": digest(b"two")}
    assert run() == want
    os.chmod(folder / "a", 0)
    before = spark.read.parquet(root).count()
    assert run() == want and spark.read.parquet(root).count() == before == 2
    # The bytes of "a" change, not its size or time: had it been opened, its digest would tell.
    os.chmod(folder / "a", 0o600)
    put("a", b"ONE", 1_000_000)
    put("c", b"three", 2_000_000)
    assert run() == {**want, "c": digest(b"three")}
    put("a", b"ONE", 3_000_000)
    now = run()
    assert now == {"a": digest(b"ONE"), "b": digest(b"two"), "c": digest(b"three")}
    # What a job wrote twice before it failed counts once; a file that is gone is not listed.
    spark.read.parquet(root).write.mode("append").parquet(root + "-copy")
    spark.read.parquet(root + "-copy").write.mode("append").parquet(root)
    (folder / "b").unlink()
    del now["b"]
    assert run() == now


def test_kept_digests_without_nodes_and_with_nulls(table, tmp_path):
    schema = "cid string, size bigint, modified timestamp, content binary"
    then = datetime.datetime(2024, 1, 1)
    rows = [("x", 1, then, b"x"), ("x", 1, then, b"x"), ("void", 0, then, None), ("late", 1, None, b"l")]
    stored, root = table(schema, *rows), str(tmp_path / "ledger")
    assert integrity.kept_digests(stored.filter("false"), root).isEmpty()
    for _ in range(2):
        got = dict(rows_of(integrity.kept_digests(stored, root), "cid", "digest"))
        assert got == {"x": hashlib.sha256(b"x").hexdigest(), "void": None, "late": hashlib.sha256(b"l").hexdigest()}
    expected = table("cid string, digest string", ("x", hashlib.sha256(b"x").hexdigest()), ("gone", "00"))
    assert rows_of(integrity.verify_blocks(integrity.kept_digests(stored, root), expected)) == [("gone",)]
