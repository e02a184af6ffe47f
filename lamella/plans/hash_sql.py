"""SQL for the hashes: bytes as lists of integers, folded with 64-bit and wider integers."""

from __future__ import annotations

_TWO_64 = "18446744073709551616"
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: cast('0x' || x as ubigint))"


def fnv16(mutations: str) -> str:
    return f"""with {mutations}, bytes as (select distinct key, {_BYTES.format("key")} as b from ml),
     fold as (select key, list_reduce(b, lambda h, x: xor(h, x) * 16777619 % 4294967296, cast(2166136261 as ubigint)) as h from bytes)
     select key, cast(xor(h >> 16, h) & 65535 as integer) as hash from fold"""


def crc32() -> str:
    return f"""with crcs as (select list(list_reduce(range(8), lambda h, k: case when h & 1 = 1 then xor(h >> 1, cast(3988292384 as ubigint)) else h >> 1 end, cast(i as ubigint)) order by i) as t from range(256) r(i)),
     bytes as (select doc_id, {_BYTES.format("text")} as b from documents)
     select doc_id, cast(case when b is not null then xor(list_reduce(b, lambda h, x: xor(t[cast(xor(h, x) & 255 as bigint) + 1], h >> 8), cast(4294967295 as ubigint)), cast(4294967295 as ubigint)) end as bigint) as crc from bytes, crcs"""


def _low(x: str) -> str:
    return f"cast(({x}) % {_TWO_64}::uhugeint as ubigint)"


def _times(a: str, b: int) -> str:
    return _low(f"cast({a} as uhugeint) * {b}::uhugeint")


def _plus(a: str, b: str) -> str:
    return _low(f"cast({a} as uhugeint) + cast({b} as uhugeint)")


def _rotated(x: str, n: int) -> str:
    return f"({x} >> {64 - n} | {_times(x, 2**n)})"


def murmur3(mutations: str) -> str:
    """For keys of 1 to 15 bytes, as those of events are: one block that isn't full."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    shifted = "xor(h1, h1 >> 33) as h1, xor(h2, h2 >> 33) as h2"
    steps = [
        f"{_times('k1', c1)} as k1, {_times('k2', c2)} as k2",
        f"{_rotated('k1', 31)} as k1, {_rotated('k2', 33)} as k2",
        f"xor({_times('k1', c2)}, cast(n as ubigint)) as h1, xor({_times('k2', c1)}, cast(n as ubigint)) as h2",
        f"{_plus('h1', 'h2')} as h1, h2",
        f"h1, {_plus('h2', 'h1')} as h2",
        shifted,
        *(x for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53) for x in (f"{_times('h1', f)} as h1, {_times('h2', f)} as h2", shifted)),
    ]
    lane = "list_reduce(list_reverse(b[{0}:{1}]), lambda h, x: h * 256 + x, cast(0 as ubigint))"
    tables = [
        mutations,
        f"bytes as (select distinct key, octet_length(encode(key)) as n, {_BYTES.format('key')} as b from ml)",
        f"m0 as (select key, n, {lane.format(1, 8)} as k1, {lane.format(9, 16)} as k2 from bytes)",
        *(f"m{i + 1} as (select key, n, {x} from m{i})" for i, x in enumerate(steps)),
        f"final as (select key, {_low('2 * cast(h2 as uhugeint) + cast(h1 as uhugeint)')} as h from m{len(steps)})",
    ]
    return f"with {', '.join(tables)} select key, cast(case when h >= 9223372036854775808::ubigint then cast(h as hugeint) - {_TWO_64}::hugeint else cast(h as hugeint) end as bigint) as hash from final"
