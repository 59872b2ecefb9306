import base64
import hashlib
import random

from pyspark.sql import functions as F

from steward.functions import ID_DECODED, cid, valid_id

BITCOIN = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def number(data, digits):
    value, out = int.from_bytes(data, "big"), ""
    while value:
        value, digit = divmod(value, len(digits))
        out = digits[digit] + out
    return out


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def v1(digest, codec=0x55, code=0x12, size=None):
    return b"\x01" + varint(codec) + varint(code) + varint(len(digest) if size is None else size) + digest


def forms(data):
    b32, b32hex, b64 = (f(data).decode() for f in (base64.b32encode, base64.b32hexencode, base64.b64encode))
    url = base64.urlsafe_b64encode(data).decode()
    swapped = "123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    d36 = "0123456789abcdefghijklmnopqrstuvwxyz"
    return [
        "f" + data.hex(), "F" + data.hex().upper(), "b" + b32.lower().rstrip("="), "B" + b32.rstrip("="), "c" + b32.lower(), "C" + b32,
        "v" + b32hex.lower().rstrip("="), "V" + b32hex.rstrip("="), "t" + b32hex.lower(), "T" + b32hex,
        "k" + number(data, d36), "K" + number(data, d36).upper(), "z" + number(data, BITCOIN), "Z" + number(data, swapped),
        "m" + b64.rstrip("="), "M" + b64, "u" + url.rstrip("="), "U" + url,
    ]


def decode(spark, ids):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "n int, id string")
    found = rows.select("n", "id", cid.decoded(F.col("id")).alias("d"), valid_id(F.col("id"), ID_DECODED).alias("ok"))
    out = []
    for r in sorted(found.collect(), key=lambda r: r.n):
        assert r.ok == (r.d is not None), r.id
        out.append(None if r.d is None else tuple(r.d))
    return out


def test_every_base(spark):
    rng = random.Random(1)
    datas = [
        v1(hashlib.sha256(bytes([i])).digest(), rng.choice([0x55, 0x70, 0x71, 0x0129, 0x300539]), rng.choice([0x12, 0xB220]))
        for i in range(8)
    ] + [v1(rng.randbytes(n), 0x55, 0x00) for n in (0, 1, 2, 3, 5, 64, 127, 128, 300)]
    ids = [(t, d) for d in datas for t in forms(d)]
    for (text, data), got in zip(ids, decode(spark, [t for t, _ in ids]), strict=True):
        assert got is not None, text
        version, codec, code, digest = got
        head = bytes.fromhex(codec) + bytes.fromhex(code) + varint(len(digest) // 2)
        assert (version, b"\x01" + head + bytes.fromhex(digest)) == (1, data), text


def test_version_0(spark):
    digest = hashlib.sha256(b"x").digest()
    old = number(b"\x12\x20" + digest, BITCOIN)
    assert len(old) == 46 and old.startswith("Qm")
    assert decode(spark, [old, "z" + old]) == [(0, "70", "12", digest.hex())] * 2
    # The same letters spell a digest of another length, or are one short, one long, or not of the base.
    assert decode(spark, ["Qm" + "z" * 44, old[:-1], old + "1", old[:-1] + "0", old.lower()]) == [None] * 5


BAD = [
    None, "", "b", "f", "Qm", "f0", "f01", "fzz", "é", "12345", "some name", "f0155122000", "b" + "a" * 58,
    "x" + v1(b"a" * 32).hex(),                     # no such base
    "f" + v1(b"a" * 32).hex()[:-2],                # a byte short
    "f" + v1(b"a" * 32).hex() + "00",              # a byte long
    "f" + v1(b"a" * 32).hex()[:-1],                # half a byte
    "f" + (b"\x02" + v1(b"a" * 32)[1:]).hex(),     # no such version
    "f0155128020" + "aa" * 32,                     # a length that never ends as stated
    "f015512a000" + "aa" * 32,                     # a length in more bytes than it needs
    "f01d5001220" + "aa" * 32,                     # so the codec
    "f" + v1(b"a" * 32, size=2**30).hex(),
    "b" + base64.b32encode(v1(b"a" * 32)).decode().lower(),                  # padding without its prefix
    "c" + base64.b32encode(v1(b"a" * 33)).decode().lower().rstrip("="),      # none where it belongs
    "u" + base64.b64encode(v1(b"\xff" * 32)).decode().rstrip("="),           # digits of the other alphabet
    "z" + "1" + number(v1(b"a" * 32), BITCOIN),                              # a zero byte first
    "f" + v1(b"a" * 600).hex(),                                              # longer than any id may be
    "k" + "9" * 100_000,
]


def test_no_ids(spark):
    assert decode(spark, BAD) == [None] * len(BAD)
