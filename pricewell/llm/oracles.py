"""DuckDB SQL of operators 11 to 13."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "lambda c, i: CASE WHEN i = 0 THEN c ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    byte = f"lambda c, b: list_reduce([0, 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], {step}, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(_LOWER)} END AS tampered
    FROM documents),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM leaves),
low AS (
    SELECT 0 AS level, tree, pos, n, leaf AS node FROM placed
    UNION ALL
    SELECT level + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY level, tree, pos // 16, n),
subroots AS (SELECT tree AS pos, node, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, pos, n, node FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
runs AS (
    SELECT 0 AS part, level, tree, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS digests FROM low WHERE n > 1 GROUP BY level, tree, pos // 16
    UNION ALL SELECT 1, level, 0, pos // 16, string_agg(node, '' ORDER BY pos) FROM high WHERE n > 1 GROUP BY level, pos // 16),
steps AS (
    SELECT p.tree, p.pos, r.part, r.level, r.digests, CASE r.part WHEN 0 THEN p.pos ELSE p.tree END // (16 ** r.level)::BIGINT % 16 AS own
    FROM placed p JOIN runs r ON CASE r.part WHEN 0 THEN r.tree = p.tree AND r.run = p.pos // (16 ** (r.level + 1))::BIGINT ELSE r.run = p.tree // (16 ** (r.level + 1))::BIGINT END),
numbered AS (
    SELECT *, substr(digests, 1, 64 * own) AS before, substr(digests, 64 * own + 65) AS after,
        row_number() OVER (PARTITION BY tree, pos ORDER BY part, level) AS k FROM steps),
proofs AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY k) AS siblings FROM numbered GROUP BY tree, pos),
folds AS (
    SELECT tree, pos, 0::BIGINT AS k, coalesce(tampered, leaf) AS node FROM placed
    UNION ALL
    SELECT f.tree, f.pos, f.k + 1, sha256(s.before || f.node || s.after) FROM folds f JOIN numbered s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k + 1),
folded AS (SELECT tree, pos, arg_max(node, k) AS node FROM folds GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM placed p JOIN subroots s ON s.pos = p.tree CROSS JOIN (SELECT node FROM high WHERE n = 1) r
JOIN folded f ON f.tree = p.tree AND f.pos = p.pos LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos"""


# Labels of the grammar's states (o: nothing yet, s, u, a) are structs of cost, edits and repaired turns; the least is the cheapest, then ASCII-least.
def _more(label: str, cost: str, edit: str, turn: str = "''", when: str = "true") -> str:
    return f"CASE WHEN {label} IS NOT NULL AND {when} THEN struct_pack(c := {label}.c + {cost}, e := {label}.e || '{edit}', t := {label}.t || {turn}) END"


def _turn(role: str, text: str = "''") -> str:
    return f"{role} || ':' || {text} || chr(10)"


def _given(role: str, sources: str, keep: str) -> str:
    """Least label of the state that a turn with this role leads to."""
    ways = [_more(x, "3 + more", "R", _turn(f"'{role}'", "text"), "free") for x in sources]
    return ", ".join([*ways, *(_more(x, "more", "K", _turn("role", "text"), f"free AND role[1] = '{keep}'") for x in sources)])


OP12_SQL = f"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
    FROM conversations),
damaged AS (
    SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM given WHERE kind <> 0),
bodies AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM bodies),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM ranked),
turns AS (
    SELECT *, CASE WHEN body = '' THEN 0 WHEN again THEN 1 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 2 ELSE 3 END AS fault,
        lag(role) OVER (PARTITION BY conv ORDER BY i) AS before FROM marked),
rows_in AS (SELECT conv, i, role, text, fault > 1 AS free, CASE WHEN fault = 2 THEN 3 ELSE 0 END AS more FROM turns),
labels AS (
    SELECT conv, 0 AS i, struct_pack(c := 0, e := '', t := '') AS o, NULL::STRUCT(c INTEGER, e VARCHAR, t VARCHAR) AS s,
        struct_pack(c := 3, e := 'I', t := 'user:' || chr(10)) AS u, struct_pack(c := 6, e := 'II', t := 'user:' || chr(10) || 'assistant:' || chr(10)) AS a
    FROM (SELECT DISTINCT conv FROM given) g
    UNION ALL
    SELECT conv, i + 1, o, s, u, least(a, {_more("u", "3", "I", _turn("'assistant'"))}) FROM (
        SELECT conv, i, o, s, least(u, {", ".join(_more(x, "3", "I", _turn("'user'")) for x in "osa")}) AS u, a FROM (
            SELECT l.conv, l.i, {_more("o", "4", "D")} AS o,
                least({_more("s", "4", "D")}, {_more("o", "more", "K", _turn("role", "text"), "free AND role[1] = 's'")}) AS s,
                least({_more("u", "4", "D")}, {_given("user", "osa", "u")}) AS u,
                least({_more("a", "4", "D")}, {_given("assistant", "u", "a")}) AS a
            FROM labels l JOIN rows_in r ON r.conv = l.conv AND r.i = l.i) x) y),
best AS (SELECT conv, arg_max(least(o, a), i) AS label FROM labels GROUP BY conv),
facts AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate,
        count(*) FILTER (fault = 2) AS truncated, count(*) FILTER (i > 0 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY conv)
SELECT g.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
    coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, b.label.c::BIGINT AS cost, b.label.e AS audit,
    sha256(CASE WHEN b.label.t = '' THEN '' ELSE left(b.label.t, -1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM given) g JOIN best b USING (conv) LEFT JOIN facts f USING (conv)"""

# Base32 of a hexadecimal digest: five digits give four signs.
_BASE32 = """(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * p::INTEGER + 1, 5))::BIGINT >> (15 - 5 * q::INTEGER)) & 31), 1), '' ORDER BY p, q)
    FROM range(8) a(p), range(4) b(q))"""

OP13_SQL = f"""
WITH ranked AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
        row_number() OVER w AS r, first_value(page_id) OVER w AS first_id
    FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST)),
digests AS (SELECT hex, {_BASE32} AS payload_digest FROM (SELECT DISTINCT hex FROM ranked) d)
SELECT page_id, strlen(payload) AS payload_bytes, payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first_id END AS refers_to
FROM ranked JOIN digests USING (hex)"""
