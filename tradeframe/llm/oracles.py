"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

#: The polynomial of crc32, its bits reversed; a fixed value.
POLYNOMIAL = 3988292384


def crc32(text: str) -> str:
    """The unsigned crc32 of a text of ASCII characters."""
    byte = "lambda x, y: xor(x >> 1, {} * (x & 1))".format(POLYNOMIAL)
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),"
        f" lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {byte})), 4294967295)"
    )


TRIE = f""", turn_rows AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
, keyed AS (SELECT c, turn, md5(strlen(role) || ':' || role || text) AS k, length(text) AS chars FROM turn_rows)
, orig AS (SELECT c, list({{'k': k, 'chars': chars}} ORDER BY turn NULLS FIRST, k[:24], chars) AS own, {crc32("c::VARCHAR")} % 6 AS h FROM keyed GROUP BY c)
, made AS (SELECT a.c, list_concat(list_slice(coalesce(b.own, []), 1, a.h), list_slice(a.own, a.h + 1, len(a.own))) AS path FROM orig a LEFT JOIN orig b ON b.c = a.c - a.c % 100)
, pre AS (SELECT c, d, array_to_string(list_transform(list_slice(path, 1, d), lambda t: t.k || t.chars), ' ') AS p, array_to_string(list_transform(list_slice(path, 1, d - 1), lambda t: t.k || t.chars), ' ') AS up,
    coalesce(path[d].chars, 0) AS chars, d = len(path) AS ends FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM made))
, nodes AS (SELECT d, p, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM pre GROUP BY d, p)
, kids AS (SELECT d - 1 AS d, up AS p, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL)
, whole AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (d, p))
, lines AS (SELECT DISTINCT a.d, a.p, u.d AS ud, u.p AS upath FROM whole u JOIN pre e ON e.d = u.d AND e.p = u.p AND e.c = u.conv_id JOIN pre a ON a.c = e.c AND a.d <= u.d)
, sums AS (SELECT lines.d, lines.p, sum((u.n - 1) * u.chars) AS saved, sum(CASE WHEN u.kids = 0 THEN 1 ELSE 0 END) AS leaves FROM lines JOIN whole u ON u.d = ud AND u.p = upath GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, r.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM whole v JOIN sums USING (d, p) LEFT JOIN whole r ON v.d > 0 AND r.d = v.d - 1 AND r.p = v.up"""

#: Levels that the SQL of the manifest has for a source's documents, and for sources: up to 16 to these powers.
LEVELS, TOP_LEVELS = 5, 3


def _levels(base: str, group: str, n: int) -> str:
    """Nodes of each level over base (group, i, node), and what stands before and behind each in its run."""
    out = [f", {base}0 AS (SELECT {group}, i, node, count(*) OVER (PARTITION BY {group}) AS n FROM {base})"]
    for k in range(n):
        run = f"PARTITION BY {group}, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(
            f", {base}s{k} AS (SELECT *, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {base}{k})"
            f", {base}{k + 1} AS (SELECT {group}, i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE min(node) END AS node, (max(n) + 15) // 16 AS n FROM {base}{k} GROUP BY {group}, i // 16)"
        )
    return "\n".join(out)


def _fold(levels: int, group: str, base: str, rows: str, i: str) -> str:
    """Rows with their proof and folded node taken up through all levels."""
    out = []
    for k in range(levels):
        out.append(
            f", {rows}{k + 1} AS (SELECT {rows}{k}.* EXCLUDE (proof, fold), proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || fold || s.r) ELSE fold END AS fold"
            f" FROM {rows}{k} JOIN {base}s{k} s ON s.{group} IS NOT DISTINCT FROM {rows}{k}.{group} AND s.i = {rows}{k}.{i} // {16**k})"
        )
    return "\n".join(out)


def _leaf(text: str) -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(part(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MANIFEST = f"""WITH leaves AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(LOWER)} ELSE {_leaf("text")} END AS changed FROM documents)
, docs AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves)
, d AS (SELECT source, spot AS i, leaf AS node FROM docs)
{_levels("d", "source", LEVELS)}
, tops AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, 0 AS everything FROM d{LEVELS})
, t AS (SELECT everything, place AS i, subroot AS node FROM tops)
{_levels("t", "everything", TOP_LEVELS)}
, f0 AS (SELECT *, '' AS proof, changed AS fold FROM docs)
{_fold(LEVELS, "source", "d", "f", "spot")}
, g0 AS (SELECT f{LEVELS}.*, subroot, place, everything FROM f{LEVELS} JOIN tops ON tops.source IS NOT DISTINCT FROM f{LEVELS}.source)
{_fold(TOP_LEVELS, "everything", "t", "g", "place")}
SELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.node AS verified FROM g{TOP_LEVELS}, t{TOP_LEVELS} root"""

ORACLE_SQL = {"op12_conversation_trie": "WITH " + TRIE[2:], "op13_merkle_manifest": MANIFEST}
