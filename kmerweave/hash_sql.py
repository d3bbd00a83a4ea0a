"""SQL, for DuckDB, of what the queries over hashes, candidates and sticky minimizers return; registry puts it together."""

from __future__ import annotations

# The published ntHash seeds of A, C, G, T, and the primes of XXH64.
SEEDS = (0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456)
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
ALL = 1 << 64


def _rotated(x: int, r: int) -> int:
    r %= 64
    return (x << r | x >> (64 - r)) % ALL if r else x


def _chosen(values: list[int], digit: str) -> str:
    return f"list_extract([{', '.join(f'{v}::ubigint' for v in values)}], ({digit} + 1)::int)"


def nthash(v: str, l: int) -> str:
    """The canonical ntHash of an l-mer's value, as ubigint."""
    digit = lambda i: f"(({v} >> {2 * (l - 1 - i)}) & 3)"
    fwd = back = "0::ubigint"
    for i in range(l):
        fwd = f"xor({fwd}, {_chosen([_rotated(s, l - 1 - i) for s in SEEDS], digit(i))})"
        back = f"xor({back}, {_chosen([_rotated(s, i) for s in reversed(SEEDS)], digit(i))})"
    return f"least({fwd}, {back})"


def candidate(v: str, l: int) -> str:
    """Whether some 2-mer of smallest canonical ntHash stands at either end of the l-mer."""
    two = lambda a, b: min(_rotated(SEEDS[a], 1) ^ SEEDS[b], SEEDS[3 - a] ^ _rotated(SEEDS[3 - b], 1))
    hashes = [two(x >> 2, x & 3) for x in range(16)]
    at = lambda i: _chosen(hashes, f"(({v} >> {2 * (l - 2 - i)}) & 15)")
    return f"list_min([{', '.join(at(i) for i in range(l - 1))}]) in ({at(0)}, {at(l - 2)})"


def _times(a: str, b: int | str) -> str:
    return f"((({a})::uhugeint * ({b})::uhugeint) % {ALL}::uhugeint)"


def _plus(a: str, b: int) -> str:
    return f"((({a})::uhugeint + {b}::uhugeint) % {ALL}::uhugeint)"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::uhugeint, ({b})::uhugeint)"


def _right(a: str, n: int) -> str:
    return f"(({a})::uhugeint // {1 << n}::uhugeint)"


def _rol(a: str, n: int) -> str:
    return f"({_times(a, 1 << n)} + {_right(a, 64 - n)})"


def schemes(canon: str, n: int) -> str:
    """A table of canon and s0, s1, ...: n scramblings of the canonical l-mers in ``canon`` (a table of canon)."""
    h = ", ".join(f"{_times(f'canon + {j + 1}', 0x9E3779B97F4A7C15 ^ (j * 0x1000003))} as h{j}" for j in range(n))
    g = ", ".join(f"{_times(_xor(f'h{j}', _right(f'h{j}', 29)), 0xBF58476D1CE4E5B9)} as g{j}" for j in range(n))
    s = ", ".join(f"{_xor(f'g{j}', _right(f'g{j}', 32))}::hugeint as s{j}" for j in range(n))
    return f"(select canon, {s} from (select canon, {g} from (select canon, {h} from {canon})))"


def xxh64(texts: str, length: int) -> str:
    """CTEs up to hashed: ``texts`` (with a column kmer of ``length`` bytes, under 32) and h, the XXH64 with seed 42."""
    byte = lambda i: f"ascii(substr(kmer, {i + 1}, 1))::uhugeint"
    word = lambda i, n: "(" + " + ".join(f"{byte(i + j)} * {256**j}::uhugeint" for j in range(n)) + ")"
    p1, p2, p3, p4, p5 = PRIMES
    steps, i = [f"{(42 + p5 + length) % ALL}::uhugeint"], 0
    while i + 8 <= length:
        lane = _times(_rol(_times(word(i, 8), p2), 31), p1)
        steps.append(_plus(_times(_rol(_xor("h", lane), 27), p1), p4))
        i += 8
    if i + 4 <= length:
        steps.append(_plus(_times(_rol(_xor("h", _times(word(i, 4), p1)), 23), p2), p3))
        i += 4
    for j in range(i, length):
        steps.append(_times(_rol(_xor("h", _times(byte(j), p5)), 11), p1))
    steps += [_times(_xor("h", _right("h", 33)), p2), _times(_xor("h", _right("h", 29)), p3), _xor("h", _right("h", 32))]
    out = [f"x0 as (select *, {steps[0]} as h from {texts})"]
    out += [f"x{n} as (select * exclude (h), {s} as h from x{n - 1})" for n, s in enumerate(steps[1:], 1)]
    return ", ".join([*out, f"hashed as (select * from x{len(steps) - 1})"])


def walk(start: str, step: str) -> str:
    """Recursive CTE walked(seq_id, i, p): from the rows of start on, each followed by the row of step (seq_id, at, i, p) whose
    ``at`` is the row's p."""
    return f"walked(seq_id, i, p) as ({start} union all select s.seq_id, s.ni, s.np from walked w join {step} s on s.seq_id = w.seq_id and s.at = w.p)"


def sticky(scored: str, w: int, k: int) -> str:
    """CTEs up to walked(seq_id, i, p): sticky minimizers' places p of (seq_id, n, pos, score), from k-mer i on."""
    return (
        f"ahead as materialized (select seq_id, n, pos, score, 2147483647 - cast(min(score::hugeint * 2147483648 + 2147483647 - pos) over (partition by seq_id order by pos rows between current row and {w - 1} following) % 2147483648 as bigint) as best, "
        f"list(score) over (partition by seq_id order by pos rows between 1 following and {w - 1} following) as next from {scored}), "
        f"jumps as (select seq_id, n, pos, best, lead(best) over (partition by seq_id order by pos) as after, list_position(list_transform(next, lambda x: x < score), true) as j from ahead), "
        f"steps as materialized (select * from (select seq_id, n, pos as at, case when j is null then pos + 1 else pos + j - {w - 1} end as ni, case when j is null then after else pos + j end as np from jumps) where ni <= n - {k}), "
        + walk(f"select seq_id, 0::bigint, best from ahead where pos = 0 and n >= {k}", "steps")
    )


def oriented(l: int, text: str = "text") -> tuple[str, str]:
    """(mpos, flipped) of rows (mpos, size, text) on the strand where the minimizer is nearer the start."""
    right = f"(size - mpos - {l})"
    back = f"reverse(translate({text}, 'ACGT', 'TGCA'))"
    return f"least(mpos, {right})", f"({right} < mpos or ({right} = mpos and {back} < {text}))"
