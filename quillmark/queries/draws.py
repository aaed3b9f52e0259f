"""SQL for what depends on seeded generators and sequential passes, so that DuckDB can follow it.

A generator's state after its seeding holds no data, so SQL may start from it: steps of the
128-bit congruential generator are arithmetic on two halves, and leaps of 2^j steps make all
draws in as many rounds. The order of a seeded shuffle and the greedy matching are recursive
queries of one step a row.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np

from quillmark import schema as S

# Fixed value: the multiplier of the 128-bit generator.
_MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645
_MASK = (1 << 128) - 1
_LEAPS = 24
#: Outputs of the other generator that a shuffle's SQL has at hand.
_SHUFFLE_DRAWS = 4096

ERF = """2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln({x}) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2) - {x} * {x})))"""


def p_of(z: str) -> str:
    """Two-sided p of a normal z: its series has positive terms only."""
    x = f"(abs({z}) / sqrt(2))"
    return f"CASE WHEN {z} = 0 THEN 1 WHEN abs({z}) > 9 THEN 0 ELSE 1 - {ERF.format(x=x)} END"


def _halves(x: int) -> str:
    return f"{x >> 64}::UHUGEINT, {x & ((1 << 64) - 1)}::UHUGEINT"


def draws(name: str, seed: int | Sequence[int], needed: str) -> str:
    """Recursive CTE ``name`` (i from 0, u): the generator's first 64-bit outputs, at least so
    many as the scalar query ``needed`` says."""
    state = np.random.PCG64(seed if isinstance(seed, int) else list(seed)).state["state"]
    inc = state["inc"]
    first = (state["state"] * _MULTIPLIER + inc) & _MASK
    a, c, leaps = _MULTIPLIER, inc, []
    for j in range(_LEAPS):
        leaps.append(f"({j}, {_halves(a)}, {_halves(c)})")
        a, c = a * a & _MASK, c * (a + 1) & _MASK
    low, size = f"{(1 << 64) - 1}::UHUGEINT", f"{1 << 64}::UHUGEINT"
    return f"""
{name}_leaps(j, ah, al, ch, cl) AS (VALUES {", ".join(leaps)}),
{name}_all(j, i, hi, lo) AS (
    SELECT 0, 0::BIGINT, {_halves(first)}
    UNION ALL
    SELECT j + 1, i + CASE WHEN b THEN 1::BIGINT << j ELSE 0 END,
        CASE WHEN b THEN ((p // {size}) + ((hi * al) & {low}) + ((lo * ah) & {low}) + ch + s // {size}) & {low} ELSE hi END, CASE WHEN b THEN s & {low} ELSE lo END
    FROM (SELECT *, (p & {low}) + cl AS s FROM (SELECT x.*, ah, al, ch, cl, lo * al AS p, b FROM {name}_all x JOIN {name}_leaps USING (j) CROSS JOIN (VALUES (false), (true)) t(b)
        WHERE 1::BIGINT << j < ({needed})))
),
{name} AS (SELECT i, (((x * {size} + x) // (1::UHUGEINT << (hi // {1 << 58}::UHUGEINT))) & {low})::UBIGINT AS u FROM (SELECT i, hi, xor(hi, lo) AS x FROM {name}_all WHERE j = (SELECT max(j) FROM {name}_all)))
""".strip()


def bounded(name: str, source: str, n: str) -> str:
    """CTE ``name`` (i from 0, k): whole numbers below the scalar query ``n``, from the halves
    of ``source``'s outputs, low half first; halves that would favour some numbers are skipped."""
    return f"""
{name} AS (SELECT row_number() OVER (ORDER BY i) - 1 AS i, m >> 32 AS k FROM (
    SELECT i, n, v * n AS m FROM (SELECT i * 2 + h AS i, CASE h WHEN 0 THEN (u & 4294967295) ELSE u >> 32 END::BIGINT AS v, ({n})::BIGINT AS n FROM {source} CROSS JOIN (VALUES (0), (1)) t(h)))
    WHERE (m & 4294967295) >= (4294967296 - n) % n)
""".strip()


def matching(accounts: str = "acc", seed: int = S.MATCH_SEED, caliper: float = S.CALIPER) -> str:
    """CTEs up to ``greedy`` (place, bot, human, gap) from ``accounts`` (uid, label, logn)."""
    rng = random.Random(seed)
    outputs = ", ".join(f"({k}, {rng.getrandbits(32)})" for k in range(_SHUFFLE_DRAWS))
    return f"""
outputs(k, v) AS (VALUES {outputs}),
shuffling(i, taken, o) AS (
    SELECT (count(*) - 1)::BIGINT, 0::BIGINT, list(uid ORDER BY uid) FROM {accounts} WHERE label = 'bot'
    UNION ALL
    SELECT CASE WHEN r <= i THEN i - 1 ELSE i END, taken + 1, CASE WHEN r < i THEN list_transform(o, lambda x, k: CASE WHEN k = i + 1 THEN o[r + 1] WHEN k = r + 1 THEN o[i + 1] ELSE x END) ELSE o END
    FROM (SELECT s.*, v::BIGINT >> (32 - length(bin(i + 1))) AS r FROM shuffling s JOIN outputs ON k = taken WHERE i >= 1)
),
shuffled AS (SELECT unnest(o) AS uid, unnest(range(0, len(o))) AS place FROM shuffling WHERE i < 1),
ordered AS (SELECT place, uid, logn FROM shuffled JOIN {accounts} USING (uid)),
passing(place, used, bot, best) AS (
    SELECT -1::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::STRUCT(gap DOUBLE, uid VARCHAR)
    UNION ALL
    SELECT b.place, list_append(any_value(used), min(struct_pack(gap := abs(h.logn - b.logn), uid := h.uid)).uid), b.uid, min(struct_pack(gap := abs(h.logn - b.logn), uid := h.uid)) FILTER (WHERE h.uid IS NOT NULL)
    FROM passing g JOIN ordered b ON b.place = g.place + 1 LEFT JOIN {accounts} h ON h.label = 'human' AND abs(h.logn - b.logn) <= {caliper} AND NOT list_contains(g.used, h.uid)
    GROUP BY b.place, b.uid
),
greedy AS (SELECT place, bot, best.uid AS human, best.gap AS gap FROM passing WHERE place >= 0)
""".strip()


def newton(rows: str, names: Sequence[str], steps: int = 14) -> str:
    """CTEs up to ``fitted`` (model, b0, b1, ...) from ``rows`` (model, y, and a column for each of
    ``names``): Newton's steps of a logistic fit with half the squared weights as penalty. The
    equations of a step are solved by elimination, one select for each row."""
    d = len(names) + 1
    x = ["1", *names]
    z = " + ".join(f"s.b{i} * {c}" for i, c in enumerate(x))
    sums = [f"sum((p - y) * {x[i]}) + any_value(b{i}) * {int(i > 0)} AS g{i}" for i in range(d)]
    sums += [f"sum(p * (1 - p) * {x[i]} * {x[j]}) + {int(i == j > 0)} AS a{i}{j}" for i in range(d) for j in range(d)]
    state = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(d))
    solved = f"SELECT model, any_value(step) AS step, {state}, {', '.join(sums)} FROM (SELECT r.*, s.step, {', '.join(f's.b{i}' for i in range(d))}, 1 / (1 + exp(-({z}))) AS p FROM steps s JOIN {rows} r ON r.model = s.model WHERE s.step < {steps}) GROUP BY model"
    for k in range(d - 1):
        changed = [f"g{i} - a{i}{k} / a{k}{k} * g{k} AS g{i}" for i in range(k + 1, d)] + [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in range(k + 1, d) for j in range(k + 1, d)]
        solved = f"SELECT * REPLACE ({', '.join(changed)}) FROM ({solved})"
    for k in range(d - 1, -1, -1):
        known = "".join(f" - a{k}{j} * s{j}" for j in range(k + 1, d))
        solved = f"SELECT *, (g{k}{known}) / a{k}{k} AS s{k} FROM ({solved})"
    return f"""
steps AS (
    SELECT DISTINCT model, 0 AS step, {", ".join(f"0::DOUBLE AS b{i}" for i in range(d))} FROM {rows}
    UNION ALL
    SELECT model, step + 1, {", ".join(f"b{i} - s{i}" for i in range(d))} FROM ({solved})
),
fitted AS (SELECT * FROM steps WHERE step = {steps})
""".strip()
