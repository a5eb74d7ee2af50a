"""DuckDB SQL for queries whose SQL is made of repeated steps."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, which DuckDB has no function for."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bit = "lambda x, i: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"lambda x, c: list_reduce([xor(x, c)] || CAST(range(8) AS BIGINT[]), {bit})"
    return f"xor(list_reduce([4294967295] || {codes}, {byte}), 4294967295)"


def _tree(name: str, nodes: str, levels: int) -> str:
    """CTEs ``{name}0`` to ``{name}{levels}``: nodes ``(tree, pos, digest)`` with the size
    ``n`` of their tree and the siblings left and right of each. A tree of one node stays
    as it is."""
    run = "PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
    ctes = []
    for level in range(levels + 1):
        if level == 0:
            made = nodes
        else:
            made = f"""
            SELECT tree, pos // 8 AS pos,
                   CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
            FROM {name}{level - 1} GROUP BY tree, pos // 8"""
        ctes.append(
            f"""{name}{level} AS MATERIALIZED (
            SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS n,
                   coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM ({made}))"""
        )
    return ", ".join(ctes)


def merkle(levels: int = 7, top_levels: int = 3) -> str:
    """The manifest of ``documents``, for up to ``8 ** levels`` documents in a language
    and ``8 ** top_levels`` languages."""

    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"""leaves AS (
        SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS digest,
               CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claim
        FROM documents)""",
        """placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM leaves)""",
        _tree("n", "SELECT tree, pos, digest FROM placed", levels),
        _tree("t", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest FROM n{levels}", top_levels),
        f"tops AS (SELECT tree AS top, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS slot FROM n{levels})",
        "f0 AS (SELECT doc_id, tree, pos, digest AS leaf, subroot, slot, claim AS fold, '' AS proof FROM placed JOIN tops ON tree = top)",
    ]
    steps = [(f"n{k}", f"x.pos // {8**k} = y.pos AND x.tree = y.tree") for k in range(levels)]
    steps += [(f"t{k}", f"x.slot // {8**k} = y.pos") for k in range(top_levels)]
    for k, (nodes, on) in enumerate(steps):
        ctes.append(
            f"""f{k + 1} AS MATERIALIZED (
            SELECT doc_id, x.tree, x.pos, leaf, subroot, slot,
                   CASE WHEN y.n = 1 THEN fold ELSE sha256(l || fold || r) END AS fold,
                   CASE WHEN y.n = 1 THEN proof ELSE proof || l || r END AS proof
            FROM f{k} x JOIN {nodes} y ON {on})"""
        )
    return f"""
    WITH {", ".join(ctes)}
    SELECT doc_id, leaf, subroot, y.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = y.digest AS verified
    FROM f{len(steps)} CROSS JOIN t{top_levels} y"""


def codebooks(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Vector codes of ``embeddings``, all distances of vectors to entries compared."""
    nearest = """
        SELECT vec_id, part, v, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d
        FROM (SELECT p.vec_id, p.part, p.v, e.entry,
                     list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
              FROM pieces p JOIN book{0} e ON p.part = e.part)
        GROUP BY vec_id, part, v"""
    ctes = [
        f"""kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        f"""pieces AS MATERIALIZED (
        SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v
        FROM (SELECT vec_id, v, unnest(range({parts})) AS part FROM kept))""",
        f"""book0 AS MATERIALIZED (
        SELECT part, entry, v FROM pieces
        JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}) USING (vec_id))""",
    ]
    for k in range(rounds):
        ctes.append(f"near{k} AS MATERIALIZED ({nearest.format(k)})")
        ctes.append(
            f"""book{k + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
            FROM book{k} b LEFT JOIN (
              SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v
              FROM (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n
                    FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM near{k})
                    GROUP BY part, entry, place)
              GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""
        )
    ctes.append(f"last AS MATERIALIZED ({nearest.format(rounds)})")
    return f"""
    WITH {", ".join(ctes)},
    coded AS (
      SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
      FROM last GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""
