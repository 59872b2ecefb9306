"""Table schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("modified", T.TimestampType()),
        T.StructField("replications", T.IntegerType()),
    ]
)

PROVIDERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("peer_id", T.StringType()),
        T.StructField("seen_at", T.TimestampType()),
        T.StructField("ok", T.BooleanType()),
    ]
)

# What is kept of lookups: per id and peer when it was last seen and last looked up, by period.
SEEN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("peer_id", T.StringType()),
        T.StructField("ok_at", T.TimestampType()),
        T.StructField("last_at", T.TimestampType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("period", T.IntegerType()),
    ]
)

PINS = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("cid", T.StringType(), False),
        T.StructField("pin_type", T.StringType()),
    ]
)

MANIFESTS = T.StructType(
    [
        T.StructField("manifest", T.StringType(), False),
        T.StructField("threshold", T.IntegerType(), False),
    ]
)

NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False),
        T.StructField("email", T.StringType()),
        T.StructField("limit", T.StringType()),
        T.StructField("disk_total", T.LongType()),
        T.StructField("disk_free", T.LongType()),
        T.StructField("initialised", T.BooleanType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("email", T.StringType()),
        T.StructField("total_space", T.DoubleType()),
        T.StructField("used_space", T.DoubleType()),
    ]
)

# A folder of rows, and the buckets for which it still counts.
FOLDERS = T.ArrayType(
    T.StructType([T.StructField("folder", T.StringType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))])
)

COMMIT = T.StructType(
    [
        T.StructField("version", T.LongType(), False),
        T.StructField("batch", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("files", T.ArrayType(T.LongType())),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("bases", FOLDERS),
        T.StructField("deltas", FOLDERS),
        T.StructField("lists", T.StringType()),
        T.StructField("digests", T.ArrayType(T.StringType())),
    ]
)

# Digests of blocks by node, id, size and time.
DIGESTS = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("cid", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("digest", T.StringType()),
    ]
)

# What the rows of a leaf of a catalog come to.
DIGEST = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("leaf", T.IntegerType()),
        T.StructField("held", T.LongType()),
        T.StructField("one", T.LongType()),
        T.StructField("other", T.LongType()),
    ]
)

CATALOG_COLUMNS = CATALOG.fieldNames()

# The two states a catalog row can have, and the two change tags.
REMOTE, LOCAL = "remote", "local"
ADD, REMOVE = "add", "remove"
