"""The same questions in SQL, as an independent check of the queries.

Each statement reads the benchmark tables as views of the same names.
"""

from __future__ import annotations

NODE_COUNT = "(SELECT count(*) FROM supplier)"
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
ROW = "node_id, id, name, size, status, modified, replications"

# Fixed value: the characters of Unicode white space.
SPACE = (
    r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Named parts, each of which may use the ones before it.
PARTS: dict[str, str] = {
    "catalog": f"""
        SELECT CAST(p_partkey % {NODE_COUNT} AS VARCHAR) AS node_id,
               CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
               CAST(p_size AS BIGINT) * 20000000 AS size,
               CASE WHEN (p_partkey // 10) % 4 = 0 THEN 'local' ELSE 'remote' END AS status,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (p_partkey % 30) AS modified,
               CAST(p_partkey % 8 AS INT) AS replications
        FROM part WHERE p_partkey % 10 <> 0""",
    "manifest": f"""
        SELECT CAST(p_partkey AS VARCHAR) AS id,
               CASE WHEN p_partkey % 7 = 0 THEN p_name || '.v2' ELSE p_name END AS name,
               CAST(p_partkey % {NODE_COUNT} AS VARCHAR) AS node_id
        FROM part WHERE p_partkey % 10 <> 1""",
    "providers": """
        SELECT CAST(l_partkey AS VARCHAR) AS id, CAST(l_suppkey AS VARCHAR) AS peer_id,
               l_shipdate AS seen_at, l_orderkey % 997 <> 0 AS ok
        FROM lineitem""",
    "objects": """
        SELECT CAST(p_partkey AS VARCHAR) AS id,
               CASE WHEN p_partkey % 13 = 0 THEN NULL
                    ELSE CAST(p_size AS BIGINT) * 20000000 END AS size
        FROM part""",
    "nodes": """
        SELECT CAST(s_suppkey AS VARCHAR) AS node_id,
               'node' || s_suppkey || '@example.org' AS email,
               CAST(5000000000 AS BIGINT) AS disk_total,
               CAST(1000000000 * (s_suppkey % 6) AS BIGINT) AS disk_free,
               s_suppkey % 3 = 0 AS initialised,
               CAST((s_suppkey % 9 + 1)
                    * CASE WHEN s_suppkey % 2 = 0 THEN 1000000000 ELSE 1073741824 END
                    AS BIGINT) AS limit_bytes
        FROM supplier""",
    "changes": """
        SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id,
               CASE WHEN event_type IN ('purchase', 'error')
                      OR (event_type = 'click' AND event_id % 2 = 0)
                    THEN '-' ELSE '+' END AS op,
               event_type || '-' || event_id AS name
        FROM events""",
    "snapshot": """
        SELECT sha256(text) AS id, 'doc-' || doc_id AS name,
               source || '.ks' AS path, doc_id AS line_no
        FROM documents""",
    "blocks": """
        SELECT 'doc-' || doc_id AS cid, text AS content,
               sha256(CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END) AS digest,
               source, lang
        FROM documents""",
    "pins": """
        SELECT CAST(o_orderkey AS VARCHAR) AS cid,
               CASE WHEN o_orderstatus = 'F' THEN 'direct' ELSE 'recursive' END AS pin_type
        FROM orders WHERE o_orderstatus <> 'P'""",
    "links": """
        SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS parent,
               l_orderkey || '-' || l_linenumber AS child
        FROM lineitem""",
    "bad": "SELECT DISTINCT cid FROM blocks WHERE digest <> sha256(content)",
    "edits": f"""
        SELECT CAST(p_partkey % {NODE_COUNT} AS VARCHAR) AS node_id,
               CAST(p_partkey AS VARCHAR) AS id,
               'edit-' || seq || '-' || p_partkey AS name,
               CAST(p_partkey * 1000 + seq AS BIGINT) AS size, 'remote' AS status,
               CAST(p_partkey % 4 AS INT) AS replications
        FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS seq
              FROM part WHERE p_partkey % 3 = 0)""",
    "asked": "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 5 = 0",
    "counts": """
        SELECT id, count(DISTINCT peer_id) FILTER (ok) AS providers,
               max(struct_pack(t := seen_at, failed := NOT ok)).failed AS failed
        FROM providers WHERE seen_at >= TIMESTAMP '2000-11-14 00:00:00' GROUP BY id""",
    "counted": """
        SELECT c.node_id, c.id, c.name, c.size, c.status, c.modified,
               CAST(CASE WHEN coalesce(p.failed, false) THEN -1
                         ELSE coalesce(p.providers, 0) END AS INT) AS replications
        FROM catalog c LEFT JOIN counts p ON c.id = p.id""",
    "used": """
        SELECT node_id, CAST(coalesce(sum(CASE WHEN status = 'local' THEN size END), 0) AS BIGINT) AS used
        FROM catalog GROUP BY node_id""",
    "rooms": """
        SELECT n.node_id, CAST(n.limit_bytes - coalesce(u.used, 0) AS BIGINT) AS room
        FROM nodes n LEFT JOIN used u ON n.node_id = u.node_id""",
    "wanted": """
        SELECT c.node_id, c.id, c.replications, o.size
        FROM counted c JOIN objects o ON c.id = o.id
        WHERE c.status = 'remote' AND c.replications BETWEEN 1 AND 4 AND o.size IS NOT NULL""",
    "gone": "SELECT * FROM catalog WHERE id NOT IN (SELECT id FROM manifest)",
    "listed": f"""
        SELECT coalesce(c.node_id, m.node_id) AS node_id, coalesce(c.id, m.id) AS id,
               coalesce(m.name, c.name) AS name,
               CASE WHEN c.id IS NULL THEN 0 ELSE c.size END AS size,
               coalesce(c.status, 'remote') AS status,
               CASE WHEN m.id IS NULL THEN c.modified ELSE {AS_OF} END AS modified,
               CAST(coalesce(c.replications, 0) AS INT) AS replications,
               CASE WHEN c.id IS NULL THEN 'add' WHEN m.id IS NULL THEN 'remove'
                    ELSE 'touch' END AS change
        FROM catalog c FULL JOIN manifest m ON c.id = m.id AND c.node_id = m.node_id""",
    "events_in_order": """
        SELECT id, list({'move': CASE WHEN op = '+' THEN 1 ELSE -1 END, 'name': name} ORDER BY seq) AS moves
        FROM changes GROUP BY id""",
    "walked": """
        SELECT id, list_reduce(moves, lambda s, x: {
                 'move': greatest(-1, least(1, s.move + x.move)),
                 'name': CASE WHEN s.move = 0 THEN x.name
                              WHEN s.move + x.move = 0 THEN NULL ELSE s.name END
               }, {'move': 0, 'name': CAST(NULL AS VARCHAR)}) AS e
        FROM events_in_order""",
    "net": """
        SELECT id, e.name AS name,
               CASE e.move WHEN 1 THEN 'add' WHEN -1 THEN 'remove' ELSE 'none' END AS change
        FROM walked""",
    "moved": f"""
        SELECT CAST(CAST(id AS BIGINT) % {NODE_COUNT} AS VARCHAR) AS node_id, id, name, change
        FROM net WHERE change <> 'none'""",
}

# The adder over a part named ``todo``: every file judged, then those in question walked
# node by node, one file at a time.
ADDER: dict[str, str] = {
    "judged": """
        SELECT *, CASE WHEN r < 0 THEN 'lookup_failed'
                       WHEN r = 0 OR r >= FACTOR THEN 'no_action'
                       WHEN CAST(draw AS FLOAT) <= CAST(r AS FLOAT) / CAST(FACTOR AS FLOAT) THEN 'not_drawn'
                       WHEN object_size IS NULL THEN 'size_unknown' END AS early
        FROM (SELECT t.*, o.size AS object_size,
                     CAST(CASE WHEN coalesce(p.failed, false) THEN -1
                               ELSE coalesce(p.providers, 0) END AS INT) AS r,
                     CAST(('0x' || substr(md5('7|0|' || t.node_id || '|' || t.id), 1, 6)) AS INT)
                       / 16777216.0 AS draw
              FROM todo t LEFT JOIN counts p ON t.id = p.id LEFT JOIN objects o ON t.id = o.id)""",
    "queue": """
        SELECT node_id, id, object_size AS size,
               row_number() OVER (PARTITION BY node_id ORDER BY r, id) AS n
        FROM judged WHERE early IS NULL""",
}
WALK = """
    walk(node_id, id, n, room, fits) AS (
        SELECT node_id, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), room, false FROM rooms
        UNION ALL
        SELECT q.node_id, q.id, q.n,
               CASE WHEN q.size < w.room THEN w.room - q.size ELSE w.room END, q.size < w.room
        FROM walk w JOIN queue q ON q.node_id = w.node_id AND q.n = w.n + 1)"""
DECIDED = """
    SELECT j.node_id, j.id, j.name,
           CASE WHEN w.fits THEN j.object_size ELSE j.size END AS size,
           CASE WHEN w.fits THEN 'local' ELSE j.status END AS status,
           j.r AS replications,
           CASE WHEN early IS NOT NULL THEN early
                WHEN w.fits THEN 'pull' ELSE 'no_room' END AS outcome
    FROM judged j LEFT JOIN walk w ON j.node_id = w.node_id AND j.id = w.id"""


def _sql(body: str, *own: tuple[str, str], recursive: str = "", after: dict[str, str] | None = None) -> str:
    """``body`` behind all named parts it needs, directly or through others."""
    named = {**PARTS, **dict(own)}
    late = after or {}
    text = " ".join([body, recursive, *late.values(), *(sql for _, sql in own)])
    needed: set[str] = {name for name, _ in own}
    for name in reversed(list(PARTS)):
        used = " ".join([text, *(PARTS[n] for n in needed if n in PARTS)])
        if any(word == name for word in _words(used)):
            needed.add(name)
    ctes = [f"{name} AS ({sql})" for name, sql in named.items() if name in needed]
    ctes += [recursive] if recursive else []
    ctes += [f"{name} AS ({sql})" for name, sql in late.items()]
    if not ctes:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}"


def _words(sql: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in sql).split()


def _adder(body: str, todo: str, *own: tuple[str, str], factor: str = "5") -> str:
    return _sql(
        body,
        *own,
        ("todo", todo),
        *[(name, sql.replace("FACTOR", factor)) for name, sql in ADDER.items()],
        recursive=WALK,
        after={"decided": DECIDED},
    )


def _after(base: str) -> str:
    """``base`` after the outcomes that count are written to it."""
    return f"""
        SELECT b.node_id, b.id, coalesce(d.name, b.name) AS name,
               CASE WHEN d.id IS NULL THEN b.size ELSE d.size END AS size,
               coalesce(d.status, b.status) AS status,
               CASE WHEN d.id IS NULL THEN b.modified ELSE {AS_OF} END AS modified,
               CAST(coalesce(d.replications, b.replications) AS INT) AS replications
        FROM {base} b LEFT JOIN decided d
          ON b.node_id = d.node_id AND b.id = d.id
             AND d.outcome IN ('no_action', 'not_drawn', 'pull')"""


_FITTED = "SELECT q.node_id, q.id, q.replications, q.size, w.fits FROM queue q JOIN walk w ON q.node_id = w.node_id AND q.id = w.id"
_QUEUE = (
    "queue",
    "SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY replications, id) AS n FROM wanted",
)
_UPSERTED = f"""
    SELECT {ROW} FROM catalog WHERE id NOT IN (SELECT id FROM edits)
    UNION ALL
    SELECT node_id, id, name, size, status, {AS_OF} AS modified, replications FROM edits"""
_REPORT = """
    SELECT {key} email,
           CAST(least(limit_bytes, disk_total) AS DOUBLE) / 1e9 AS total_space,
           CAST(coalesce(used, 0) AS DOUBLE) / 1e9 AS used_space
    FROM nodes n LEFT JOIN used u ON n.node_id = u.node_id"""
_FIRST_IMPORT = f"""
    SELECT node_id, id, name, CAST(0 AS BIGINT) AS size, 'remote' AS status,
           {AS_OF} AS modified, CAST(0 AS INT) AS replications FROM manifest"""
_KEPT = ("kept", "SELECT * FROM listed WHERE change <> 'remove'")
_REBASED = (
    "rebased",
    f"""
    SELECT {ROW} FROM catalog WHERE id NOT IN (SELECT id FROM moved)
    UNION ALL
    SELECT node_id, id, name, 0, 'remote', {AS_OF}, 0 FROM moved WHERE change = 'add'""",
)
_VERSIONS = (
    "moved",
    f"""SELECT CAST(p_partkey % {NODE_COUNT} AS VARCHAR) AS node_id, CAST(p_partkey AS VARCHAR) AS id,
               p_name AS name, CASE p_partkey % 10 WHEN 2 THEN 'add' ELSE 'remove' END AS change
        FROM part WHERE p_partkey % 10 IN (2, 3)""",
)
_READDED = "SELECT b.* FROM rebased b JOIN moved m ON b.id = m.id WHERE m.change = 'add'"
_EMPTY_ROOMS = ("rooms", "SELECT node_id, limit_bytes AS room FROM nodes")
_LIMITED_ROOMS = (
    "rooms",
    """SELECT n.node_id, CAST(CASE WHEN NOT initialised AND limit_bytes > disk_free THEN disk_free ELSE limit_bytes END
               - coalesce(u.used, 0) AS BIGINT) AS room
       FROM nodes n LEFT JOIN used u ON n.node_id = u.node_id""",
)
_SWEPT = f"""
    SELECT node_id, id || tail AS cid
    FROM (SELECT CAST((p_partkey + shift) % {NODE_COUNT} AS VARCHAR) AS node_id, CAST(p_partkey AS VARCHAR) AS id
          FROM part, (VALUES (0), (1)) AS s(shift)) b, (VALUES (''), ('-0')) AS t(tail)
    WHERE (node_id, id) NOT IN (SELECT (node_id, id) FROM decided WHERE outcome = 'pull')
      AND (node_id, id) NOT IN (
        SELECT (node_id, id) FROM (
          SELECT node_id, id FROM catalog WHERE status = 'local'
          UNION ALL
          SELECT CAST((p_partkey + 1) % {NODE_COUNT} AS VARCHAR), CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 3 = 0)
        WHERE (node_id, id) NOT IN (SELECT (node_id, id) FROM UNPINNED))"""
_PATCHED = (
    "changes",
    """
        SELECT event_id AS seq,
               user_id || '|' || CAST(floor(event_id * 5 / ((SELECT max(event_id) FROM events) + 1)) AS INT) AS id,
               CASE WHEN event_type IN ('purchase', 'error')
                      OR (event_type = 'click' AND event_id % 2 = 0)
                    THEN '-' ELSE '+' END AS op,
               event_type || '-' || event_id AS name
        FROM events WHERE event_type <> 'view'""",
)
# Late: it rests on the net change of each id in each patch.
_LAST_PATCH = """
    SELECT split_part(id, '|', 1) AS id, arg_max(name, CAST(split_part(id, '|', 2) AS INT)) AS name,
           arg_max(change, CAST(split_part(id, '|', 2) AS INT)) AS change
    FROM net WHERE change <> 'none' GROUP BY 1"""
_EVICTABLE = (
    "evictable",
    f"""SELECT node_id, id, size, replications FROM counted
        WHERE status = 'local' AND replications > 0.05 * {NODE_COUNT}""",
)
_BEST = (
    "best",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY replications DESC, id) AS k"
    " FROM evictable) WHERE k = 1",
)
_SHELF_LINKS = (
    "shelf_links",
    "SELECT 'src-' || source AS parent, 'doc-' || doc_id AS child FROM documents"
    " UNION ALL SELECT 'lang-' || lang, 'doc-' || doc_id FROM documents",
)
_TREE_LINKS = (
    "tree_links",
    "SELECT 'n' || c_nationkey AS parent, 'c' || c_custkey AS child FROM customer"
    " UNION ALL SELECT 'c' || o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders"
    " UNION ALL SELECT parent, child FROM links",
)
_TREE_PINS = (
    "tree_pins",
    "SELECT 'n' || n_nationkey AS cid,"
    " CASE WHEN n_nationkey % 3 = 0 THEN 'recursive' ELSE 'direct' END AS pin_type FROM nation"
    " UNION ALL SELECT 'c' || c_custkey, 'recursive' FROM customer WHERE c_custkey % 3 = 0",
)
_LINES = (
    "doc_lines",
    "SELECT doc_id, CAST(u.i - 1 AS INT) AS line_no, u.l AS value FROM"
    " (SELECT doc_id, unnest(list_zip(range(1, len(a) + 1), a)) AS z FROM"
    "   (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),"
    " LATERAL (SELECT z[1] AS i, z[2] AS l) u",
)
_BARE = f"regexp_replace(value, '^{SPACE}+|{SPACE}+$', '', 'g')"
_FIELDS = (
    "doc_fields",
    f"SELECT doc_id, line_no, string_split_regex({_BARE}, '{SPACE}+') AS f FROM doc_lines",
)
_FEED_LINES = (
    "feed_lines",
    "SELECT *, CASE WHEN name LIKE 'view%' THEN ' ' ELSE op END AS mark FROM changes",
)
_MARKED = (
    "changes",
    """
        SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id,
               CASE WHEN event_type IN ('purchase', 'error')
                      OR (event_type = 'click' AND event_id % 2 = 0)
                    THEN '-' ELSE '+' END AS op,
               event_type || '-' || event_id AS name
        FROM events WHERE event_type <> 'view'""",
)
_UNITS = """CASE lower(trim(regexp_extract(text, '^[0-9.,]+(.*)$', 1)))
    WHEN '' THEN 1 WHEN 'kb' THEN 1000 WHEN 'mb' THEN 1000000 WHEN 'mib' THEN 1048576
    WHEN 'gb' THEN 1000000000 WHEN 'gib' THEN 1073741824 WHEN 'tb' THEN 1000000000000 END"""

ORACLE: dict[str, str] = {
    "scan_manifest": _sql("SELECT 'docs' AS manifest, id, name FROM snapshot"),
    "quarantine_lines": _sql(
        "SELECT doc_id, line_no, CASE WHEN f[1] = '' THEN 'blank' ELSE 'one_field' END AS reason"
        " FROM doc_fields WHERE len(f) < 2",
        _LINES, _FIELDS,
    ),
    "manifest_fields": _sql(
        "SELECT doc_id, line_no, f[1] AS id, f[2] AS name FROM doc_fields WHERE len(f) >= 2",
        _LINES, _FIELDS,
    ),
    "scan_patch": _sql(
        "SELECT CASE mark WHEN '+' THEN 'add' ELSE 'remove' END AS op, id, name"
        " FROM feed_lines WHERE mark <> ' '",
        _FEED_LINES,
    ),
    "patch_net": _sql("SELECT id, name, change FROM net WHERE change <> 'none'", _MARKED),
    "catalog_snapshot": _sql(_UPSERTED),
    "scan_providers": _sql("SELECT id, peer_id, seen_at, ok FROM providers"),
    "scan_pins": _sql("SELECT cid FROM pins WHERE pin_type = 'direct'"),
    "write_reports": _sql(_REPORT.format(key="")),
    "valid_ids": """
        SELECT doc_id, id,
               regexp_matches(id, '^(Qm[1-9A-HJ-NP-Za-km-z]{44}|b[a-z2-7]{58,})$') AS valid
        FROM (SELECT doc_id,
                CASE doc_id % 4 WHEN 0 THEN d WHEN 1 THEN 'b' || translate(d, '0189', 'ghij')
                  WHEN 2 THEN 'Qm' || replace(substr(d, 1, 44), '0', 'G')
                  ELSE substr('Qm' || replace(d, '0', 'G'), 1, 20) END AS id
              FROM (SELECT doc_id, sha256(text) AS d FROM documents))""",
    "decoded_ids": """
        SELECT doc_id, id, CASE WHEN whole THEN 1 END AS version, CASE WHEN whole THEN '55' END AS codec,
               CASE WHEN whole THEN '12' END AS hash, CASE WHEN whole THEN d END AS digest
        FROM (SELECT doc_id, d, doc_id % 6 < 4 AS whole,
                CASE doc_id % 6 WHEN 0 THEN 'f' || raw WHEN 1 THEN 'F' || upper(raw) WHEN 2 THEN 'm' || b64
                  WHEN 3 THEN 'u' || translate(b64, '+/', '-_') WHEN 4 THEN 'f' || substr(raw, 1, 70)
                  ELSE 'f' || raw || '00' END AS id
              FROM (SELECT *, rtrim(to_base64(unhex(raw)), '=') AS b64
                    FROM (SELECT doc_id, d, '01551220' || d AS raw FROM (SELECT doc_id, sha256(text) AS d FROM documents))))""",
    "catalog_lookup": _sql(
        "SELECT c.node_id, a.id, c.name, c.size, c.status, c.modified, c.replications,"
        " c.id IS NOT NULL AS found FROM asked a LEFT JOIN catalog c ON a.id = c.id"
    ),
    "by_status": _sql("SELECT * FROM catalog WHERE status = 'local'"),
    "older_than": _sql("SELECT * FROM catalog WHERE modified < TIMESTAMP '2024-01-11 00:00:00'"),
    "under_replicated": _sql(
        "SELECT node_id, id, replications FROM counted WHERE replications BETWEEN 1 AND 4"
    ),
    "change_class": _sql(
        "SELECT id, CASE change WHEN 'add' THEN 'remote' ELSE 'gone' END AS becomes"
        " FROM net WHERE change <> 'none'"
    ),
    "find_added": _sql(
        f"SELECT node_id, id, name, CAST(0 AS BIGINT) AS size, 'remote' AS status, {AS_OF} AS modified,"
        " CAST(0 AS INT) AS replications, 'add' AS change"
        " FROM manifest WHERE id NOT IN (SELECT id FROM catalog)"
    ),
    "find_touched": _sql(
        f"SELECT c.node_id, c.id, m.name, c.size, c.status, {AS_OF} AS modified, c.replications,"
        " 'touch' AS change FROM catalog c JOIN manifest m ON c.id = m.id"
    ),
    "find_removed": _sql("SELECT *, 'remove' AS change FROM gone"),
    "reconcile": _sql("SELECT * FROM listed"),
    "reconcile_kept": _sql(
        "SELECT l.* FROM listed l LEFT JOIN catalog c ON c.id = l.id AND c.node_id = l.node_id"
        " WHERE l.change <> 'touch' OR l.name IS DISTINCT FROM c.name"
    ),
    "snapshot_diff": _sql(
        "SELECT id, max_by(name, path || lpad(CAST(line_no AS VARCHAR), 12, '0')) AS name, 'add' AS change"
        " FROM snapshot WHERE line_no % 10 <> 1"
        " AND id NOT IN (SELECT id FROM snapshot WHERE line_no % 10 <> 0) GROUP BY id"
        " UNION ALL"
        " SELECT id, max_by(name, path || lpad(CAST(line_no AS VARCHAR), 12, '0')), 'remove'"
        " FROM snapshot WHERE line_no % 10 <> 0"
        " AND id NOT IN (SELECT id FROM snapshot WHERE line_no % 10 <> 1) GROUP BY id"
    ),
    "unpin_plan": _sql("SELECT node_id, id FROM gone WHERE status = 'local'"),
    "unpin_pinned": _sql(
        "SELECT node_id, id FROM gone WHERE status = 'local' AND id IN (SELECT cid FROM pins)"
    ),
    "attach_sizes": _sql(
        "SELECT c.node_id, c.id, o.size AS object_size,"
        " CASE WHEN o.size IS NULL THEN 'size_unknown' ELSE 'known' END AS size_state"
        " FROM catalog c LEFT JOIN objects o ON c.id = o.id"
    ),
    "attach_threshold": _sql(
        "SELECT node_id, id, manifest, threshold, replications FROM"
        " (SELECT c.node_id, c.id, p_brand AS manifest, c.replications,"
        "         CAST(ascii(right(p_brand, 1)) % 4 + 3 AS INT) AS threshold"
        "  FROM counted c JOIN part ON c.id = CAST(p_partkey AS VARCHAR))"
        " WHERE replications >= 1 AND replications < threshold"
    ),
    "provider_counts": _sql("SELECT id, providers, failed FROM counts"),
    "provider_counts_kept": _sql("SELECT id, providers, failed FROM counts"),
    "count_providers": _sql("SELECT node_id, id, replications FROM counted"),
    "count_providers_kept": _sql("SELECT node_id, id, replications FROM counted"),
    "fold_changes": _sql("SELECT id, name, change FROM net"),
    "fold_changes_chunked": _sql("SELECT id, name, change FROM net WHERE change <> 'none'"),
    "used_bytes": _sql("SELECT node_id, used FROM used"),
    "usage_report": _sql(_REPORT.format(key="n.node_id,")),
    "page": _sql("SELECT * FROM catalog WHERE status = 'remote' ORDER BY id LIMIT 100 OFFSET 300"),
    "page_deep": (
        "SELECT o_orderdate, o_orderkey, o_orderstatus FROM orders"
        " ORDER BY o_orderdate, o_orderkey LIMIT 1000 OFFSET 9000"
    ),
    "latest_line": _sql(
        "SELECT id, name FROM (SELECT *, row_number() OVER"
        " (PARTITION BY id ORDER BY path DESC, line_no DESC) AS k FROM snapshot) WHERE k = 1"
    ),
    "under_replicated_ranked": _sql(
        "SELECT node_id, id, name, status, replications,"
        " row_number() OVER (PARTITION BY node_id ORDER BY replications, id) AS need_rank"
        " FROM counted WHERE replications BETWEEN 1 AND 4"
    ),
    "neediest": _sql(
        "SELECT node_id, id, replications FROM counted WHERE replications BETWEEN 1 AND 4"
        " ORDER BY replications, id LIMIT 50"
    ),
    "fit_capacity": _sql(_FITTED, _QUEUE, recursive=WALK),
    "fit_capacity_rounds": _sql(_FITTED, _QUEUE, recursive=WALK),
    "fit_capacity_prefix": _sql(
        "SELECT node_id, id, replications, size,"
        " size < room AND sum(CASE WHEN size < room THEN size ELSE 0 END) OVER"
        " (PARTITION BY node_id ORDER BY replications, id) < room AS fits"
        " FROM (SELECT w.*, r.room FROM wanted w JOIN rooms r ON w.node_id = r.node_id)"
    ),
    "merge_feed": _sql(
        "SELECT id, name, 'add' AS change FROM manifest WHERE id NOT IN (SELECT id FROM catalog)"
        " UNION ALL SELECT id, name, 'remove' FROM gone"
    ),
    "distinct_bad": _sql("SELECT cid FROM bad"),
    "upsert": _sql(_UPSERTED),
    "upsert_preserving": _sql(
        f"SELECT {ROW} FROM catalog WHERE id NOT IN (SELECT id FROM edits) UNION ALL"
        f" SELECT e.node_id, e.id, e.name, coalesce(c.size, e.size), coalesce(c.status, e.status),"
        f" {AS_OF}, coalesce(c.replications, e.replications)"
        " FROM edits e LEFT JOIN catalog c ON e.id = c.id"
    ),
    "update_existing": _sql(
        "SELECT c.node_id, c.id, coalesce(e.name, c.name) AS name, c.size, c.status,"
        f" CASE WHEN e.id IS NULL THEN c.modified ELSE {AS_OF} END AS modified,"
        " coalesce(e.replications, c.replications) AS replications"
        " FROM catalog c LEFT JOIN edits e ON c.id = e.id"
    ),
    "update_old": _sql("SELECT * FROM catalog WHERE id IN (SELECT id FROM edits)"),
    "update_missing": _sql("SELECT id FROM edits WHERE id NOT IN (SELECT id FROM catalog)"),
    "remove": _sql("SELECT * FROM catalog WHERE id NOT IN (SELECT id FROM asked)"),
    "remove_returned": _sql("SELECT * FROM catalog WHERE id IN (SELECT id FROM asked)"),
    "remove_missing": _sql("SELECT id FROM asked WHERE id NOT IN (SELECT id FROM catalog)"),
    "energy_draw": _sql(
        "SELECT node_id, id, energy, draw, draw > energy AS kept FROM (SELECT node_id, id,"
        " CAST(CAST(replications AS FLOAT) / CAST(5 AS FLOAT) AS DOUBLE) AS energy,"
        " CAST(CAST(('0x' || substr(md5('7|0|' || node_id || '|' || id), 1, 6)) AS INT) AS DOUBLE)"
        "   / CAST(16777216 AS DOUBLE) AS draw FROM catalog)"
    ),
    "parse_sizes": f"""
        SELECT s_suppkey, text,
               CAST(trunc(TRY_CAST(replace(regexp_extract(text, '^([0-9.,]+)', 1), ',', '') AS DOUBLE)
                    * CAST({_UNITS} AS DOUBLE)) AS BIGINT) AS bytes
        FROM (SELECT s_suppkey, s_suppkey || CASE s_suppkey % 8 WHEN 0 THEN 'GB' WHEN 1 THEN ' GiB'
                WHEN 2 THEN ' kb' WHEN 3 THEN ',024 MB' WHEN 4 THEN 'TB' WHEN 5 THEN 'x'
                WHEN 6 THEN '' ELSE '.37 mib' END AS text FROM supplier)""",
    "effective_limit": _sql(
        "SELECT node_id, limit_bytes, CASE WHEN NOT initialised AND limit_bytes > disk_free"
        " THEN disk_free ELSE limit_bytes END AS max_bytes FROM nodes"
    ),
    "line_ops": _sql("SELECT line_no, id, path LIKE '%1.ks' AS in_scope FROM snapshot"),
    "adder_outcomes": _adder(
        "SELECT node_id, id, size, status, replications, outcome FROM decided",
        "SELECT * FROM catalog WHERE status = 'remote'",
    ),
    "adder_by_manifest": _adder(
        "SELECT node_id, id, size, status, replications, outcome FROM decided",
        "SELECT c.*, CAST(ascii(right(p_brand, 1)) % 4 + 3 AS INT) AS factor"
        " FROM catalog c JOIN part ON c.id = CAST(p_partkey AS VARCHAR) WHERE status = 'remote'",
        factor="factor",
    ),
    "rebalance": _adder(_after("catalog"), "SELECT * FROM catalog WHERE status = 'remote'"),
    "sync_full": _adder(
        _after("imported"), "SELECT * FROM imported", _EMPTY_ROOMS, ("imported", _FIRST_IMPORT)
    ),
    "verify_catalog": _adder(_after("kept"), "SELECT * FROM kept WHERE change = 'add'", _KEPT),
    "verify_kept": _adder(
        f"SELECT * REPLACE (replace(name, ' ', '_') AS name) FROM ({_after('renamed')})",
        "SELECT * FROM kept WHERE change = 'add'",
        _KEPT,
        _LIMITED_ROOMS,
        (
            "renamed",
            """SELECT k.* REPLACE (CASE WHEN k.change = 'touch' AND k.name IS NOT DISTINCT FROM c.name
                                       THEN c.modified ELSE k.modified END AS modified)
               FROM kept k LEFT JOIN catalog c ON c.id = k.id AND c.node_id = k.node_id""",
        ),
    ),
    "verify_unpin": _sql("SELECT node_id, id FROM gone WHERE status = 'local'"),
    "verify_sweep": _adder(
        f"""
        SELECT node_id, id || tail AS cid
        FROM (SELECT CAST((p_partkey + shift) % {NODE_COUNT} AS VARCHAR) AS node_id,
                     CAST(p_partkey AS VARCHAR) AS id
              FROM part, (VALUES (0), (1)) AS s(shift)) b, (VALUES (''), ('-0')) AS t(tail)
        WHERE (node_id, id) NOT IN (SELECT (node_id, id) FROM decided WHERE outcome = 'pull')
          AND (node_id, id) NOT IN (
            SELECT (node_id, id) FROM (
              SELECT node_id, id FROM catalog WHERE status = 'local'
              UNION ALL
              SELECT CAST((p_partkey + 1) % {NODE_COUNT} AS VARCHAR), CAST(p_partkey AS VARCHAR)
              FROM part WHERE p_partkey % 3 = 0)
            WHERE (node_id, id) NOT IN (SELECT (node_id, id) FROM gone WHERE status = 'local'))""",
        "SELECT * FROM kept WHERE change = 'add'",
        _KEPT,
    ),
    "sync_incremental": _adder(_after("rebased"), _READDED, _REBASED),
    "sync_snapshots": _adder(_after("rebased"), _READDED, _VERSIONS, _REBASED),
    "sync_unpin": _sql(
        "SELECT c.node_id, c.id FROM catalog c JOIN moved m ON c.id = m.id"
        " WHERE m.change = 'remove' AND c.status = 'local'"
    ),
    "evict_candidates": _sql("SELECT * FROM evictable", _EVICTABLE),
    "swap_plan": _sql(
        "SELECT node_id, id, size, replications, 'evict' AS action FROM best"
        " WHERE node_id IN (SELECT node_id FROM walk WHERE fits)"
        " UNION ALL SELECT q.node_id, q.id, q.size, q.replications, 'pull'"
        " FROM queue q JOIN walk w ON q.node_id = w.node_id AND q.id = w.id WHERE w.fits",
        _EVICTABLE,
        _BEST,
        (
            "queue",
            "SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY replications, id) AS n"
            " FROM wanted WHERE node_id IN (SELECT node_id FROM best)",
        ),
        (
            "widened",
            "SELECT r.node_id, CAST(r.room + b.size AS BIGINT) AS room"
            " FROM rooms r JOIN best b ON r.node_id = b.node_id",
        ),
        recursive=WALK.replace("FROM rooms", "FROM widened"),
    ),
    "verify_blocks": _sql("SELECT cid FROM bad"),
    "verify_twice": _sql("SELECT cid FROM bad"),
    "verify_pinned": _sql(
        "SELECT cid FROM bad WHERE cid IN (SELECT child FROM shelf_links"
        " WHERE parent LIKE 'src-src1%' OR parent IN ('lang-fr', 'lang-es'))",
        _SHELF_LINKS,
    ),
    "sweep": _sql(
        "SELECT child AS cid FROM links"
        " WHERE parent NOT IN (SELECT cid FROM pins WHERE pin_type = 'recursive')"
    ),
    "sweep_tree": _sql(
        "SELECT DISTINCT child AS cid FROM tree_links"
        " WHERE child NOT IN (SELECT cid FROM reached) AND child NOT IN (SELECT cid FROM tree_pins)",
        _TREE_LINKS,
        _TREE_PINS,
        recursive="""
            reached(cid) AS (
                SELECT cid FROM tree_pins WHERE pin_type = 'recursive'
                UNION
                SELECT l.child FROM tree_links l JOIN reached r ON l.parent = r.cid)""",
    ),
    "repair_plan": _sql(
        "SELECT cid, cid IN (SELECT 'doc-' || id FROM providers WHERE ok) AS repairable, step, action"
        " FROM bad, (VALUES (CAST(1 AS INT), 'unpin'), (CAST(2 AS INT), 'pin')) AS s(step, action)"
    ),
    "sweep_nodes": _sql(
        "SELECT 'n0' AS node_id, child AS cid FROM links WHERE parent NOT IN"
        " (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O')"
        " UNION ALL SELECT 'n1', child FROM links WHERE parent NOT IN"
        " (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')"
    ),
    "repair_nodes": """
        SELECT node_id, 'doc-' || doc_id AS cid,
               CASE node_id WHEN 'n0' THEN doc_id % 3 = 0 ELSE doc_id % 20 = 0 END AS repairable, step, action
        FROM documents, (VALUES ('n0', 70), ('n1', 50)) AS n(node_id, every),
             (VALUES (CAST(1 AS INT), 'unpin'), (CAST(2 AS INT), 'pin')) AS s(step, action)
        WHERE doc_id % every = 0 AND text <> ''""",
    "patch_rejects": _sql(
        "SELECT CASE op WHEN '+' THEN 'add' ELSE 'remove' END AS op, op || id || '  ' || name || ' more' AS value,"
        " 'invalid_id' AS reason FROM changes WHERE name NOT LIKE 'view%'"
    ),
    "stream_sync": _sql(
        f"SELECT {ROW} FROM catalog WHERE id NOT IN (SELECT id FROM last_patch)"
        f" UNION ALL SELECT CAST(CAST(id AS BIGINT) % {NODE_COUNT} AS VARCHAR), id, name, 0, 'remote', {AS_OF}, 0"
        " FROM last_patch WHERE change = 'add'",
        _PATCHED,
        after={"last_patch": _LAST_PATCH},
    ),
    "sync_sweep": _adder(
        _SWEPT.replace("UNPINNED", "gone WHERE status = 'local'"), "SELECT * FROM kept WHERE change = 'add'", _KEPT, _LIMITED_ROOMS
    ),
    "patch_sweep": _adder(
        _SWEPT.replace("UNPINNED", "unpinned"), _READDED, _MARKED, _REBASED, _LIMITED_ROOMS,
        (
            "unpinned",
            "SELECT c.node_id, c.id FROM catalog c JOIN moved m ON c.id = m.id WHERE m.change = 'remove' AND c.status = 'local'",
        ),
    ),
    "patch_catalog": _adder(_after("rebased"), _READDED, _MARKED, _REBASED, _LIMITED_ROOMS),
}
