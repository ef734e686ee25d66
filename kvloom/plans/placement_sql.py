"""DuckDB SQL of the placement queries: MurmurHash3, ring, rendezvous and jump hash, written from their definitions."""

from __future__ import annotations

from .views import KEYS

NODES = ("alpha", "beta", "gamma")
MORE = (*NODES, "delta")
ALGORITHMS = ("modulo", "ring", "rendezvous", "jump")
SECOND_SEED = 0x9747B28C
_M = "4294967295::UBIGINT"


def murmur(source: str, out: str) -> str:
    """CTEs: source(txt, seed, ...) -> out with hash, MurmurHash3 x86-32 of an ASCII text. One step a CTE, so that no expression is written twice."""
    times = lambda x, c: f"(({x}) * {c}::UBIGINT) & {_M}"
    turn = lambda x, r: f"((({x}) << {r}) | (({x}) >> {32 - r})) & {_M}"
    c1, c2 = 0xCC9E2D51, 0x1B873593
    return f"""{out}_a AS (SELECT *, list_transform(string_split(txt, ''), lambda x: ascii(x)::UBIGINT) AS b, length(txt)::UBIGINT AS n FROM {source}),
{out}_b AS (SELECT *, list_transform(range(0, (n // 4)::BIGINT), lambda i: {times("b[4 * i + 1] | (b[4 * i + 2] << 8) | (b[4 * i + 3] << 16) | (b[4 * i + 4] << 24)", c1)}) AS w,
  {times("coalesce(b[(n // 4 * 4)::BIGINT + 1], 0) | (coalesce(b[(n // 4 * 4)::BIGINT + 2], 0) << 8) | (coalesce(b[(n // 4 * 4)::BIGINT + 3], 0) << 16)", c1)} AS t FROM {out}_a),
{out}_c AS (SELECT * REPLACE (list_transform(w, lambda x: {times(turn("x", 15), c2)}) AS w, {times(turn("t", 15), c2)} AS t) FROM {out}_b),
{out}_d AS (SELECT *, list_reduce(list_prepend(seed::UBIGINT, w), lambda h, k: (({turn("xor(h, k)", 13)}) * 5::UBIGINT + 3864292196::UBIGINT) & {_M}) AS h FROM {out}_c),
{out}_e AS (SELECT * REPLACE (xor(xor(h, t), n) AS h) FROM {out}_d),
{out}_f AS (SELECT * REPLACE ({times("xor(h, h >> 16)", 0x85EBCA6B)} AS h) FROM {out}_e),
{out}_g AS (SELECT * REPLACE ({times("xor(h, h >> 13)", 0xC2B2AE35)} AS h) FROM {out}_f),
{out} AS (SELECT * EXCLUDE (b, w, t, n, h), xor(h, h >> 16) AS hash FROM {out}_g)"""


HASHED = f"""RECURSIVE {KEYS}, plain AS (SELECT key_idx, key, key AS txt, 0::UBIGINT AS seed FROM keys), {murmur("plain", "hashed")}"""


def _nodes(nodes: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(nodes)) + ") v(i, node)"


def placed(algorithm: str, nodes: tuple[str, ...], out: str) -> str:
    """CTEs: hashed -> out(key_idx, key, node)."""
    name = "[" + ", ".join(f"'{n}'" for n in nodes) + "]"
    if algorithm == "modulo":
        return f"{out} AS (SELECT key_idx, key, {name}[(hash % {len(nodes)})::BIGINT + 1] AS node FROM hashed)"
    if algorithm == "ring":
        return f"""{out}_s AS (SELECT i, node, node || '#' || CAST(r AS VARCHAR) AS txt, 0::UBIGINT AS seed FROM {_nodes(nodes)}, range(160) t(r)), {murmur(f"{out}_s", f"{out}_m")},
{out}_p AS (SELECT hash AS h, arg_min(node, i) AS node FROM {out}_m GROUP BY hash),
{out} AS (SELECT key_idx, key, coalesce(p.node, (SELECT arg_min(node, h) FROM {out}_p)) AS node FROM hashed k ASOF LEFT JOIN {out}_p p ON k.hash <= p.h)"""
    if algorithm == "rendezvous":
        return f"""{out}_s AS (SELECT node, node AS txt, 0::UBIGINT AS seed FROM {_nodes(nodes)}), {murmur(f"{out}_s", f"{out}_m")},
{out}_t AS (SELECT key_idx, key, key AS txt, m.hash AS seed, node FROM keys, {out}_m m), {murmur(f"{out}_t", f"{out}_u")},
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY key_idx ORDER BY hash DESC, node) AS place FROM {out}_u),
{out} AS (SELECT key_idx, key, node FROM {out}_r WHERE place = 1)"""
    return f"""{out}_s AS (SELECT key_idx, key, txt, {SECOND_SEED}::UBIGINT AS seed, hash AS high FROM hashed), {murmur(f"{out}_s", f"{out}_m")},
{out}_j(key_idx, key, k, b, j) AS (SELECT key_idx, key, high::HUGEINT * 4294967296 + hash::HUGEINT, -1::BIGINT, 0::BIGINT FROM {out}_m
  UNION ALL SELECT key_idx, key, (k * 2862933555777941757 + 1) % 18446744073709551616, j,
    CAST(floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE)) AS BIGINT) FROM {out}_j WHERE j < {len(nodes)}),
{out} AS (SELECT key_idx, key, {name}[b + 1] AS node FROM {out}_j WHERE j >= {len(nodes)})"""


def _moves(algorithm: str) -> str:
    before, after = f"{algorithm}_3", f"{algorithm}_4"
    return f"""SELECT '{algorithm}' AS algorithm, count(*) AS keys, count_if(a.node <> b.node) AS moved, count_if(a.node <> b.node AND b.node <> 'delta') AS needless
FROM {before} a JOIN {after} b USING (key_idx)"""


_all = ", ".join(placed(a, nodes, f"{a}_{len(nodes)}") for a in ALGORITHMS for nodes in (NODES, MORE))
ORACLES = {
    "fn_04_murmur3": f"WITH {HASHED} SELECT key_idx, CAST(hash AS BIGINT) AS hash FROM hashed",
    **{query: f"WITH {HASHED}, {placed(a, NODES, 'placed')} SELECT key_idx, key, node FROM placed" for query, a in (("fn_07_modulo", "modulo"), ("fn_07_ring", "ring"), ("fn_07_rendezvous", "rendezvous"), ("fn_05_jump", "jump"))},
    "agg_07_load_stats": f"""WITH {HASHED}, {placed("ring", NODES, "placed")}, c AS (SELECT node, count(p.key_idx) AS n FROM {_nodes(NODES)} LEFT JOIN placed p USING (node) GROUP BY node)
SELECT CAST(sum(n) AS BIGINT) AS keys, avg(n) AS mean, min(n) AS least, max(n) AS most, max(n) / avg(n) AS most_to_mean, stddev_pop(n) AS deviation FROM c""",
    "joi_11_movement": f"WITH {HASHED}, {_all} " + " UNION ALL ".join(map(_moves, ALGORITHMS)),
}
