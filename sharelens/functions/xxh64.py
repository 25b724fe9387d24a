"""XXH64 with seed 0 as DataFrame expressions: 64-bit lanes in longs, products that wrap around by parts.

Spark's own xxhash64 has another seed that can't be given, and its products of
longs are errors where they overflow. Here a product is put together from parts
of 32 and 16 bits, which fit in a long, and shifts drop what is beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five odd primes of the hash.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
LOW = 0xFFFFFFFF


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >> 63 else x


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _right(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def _times(x: Column, by: int) -> Column:
    """x * by modulo 2^64."""
    a, b, c, d = (by >> (16 * k) & 0xFFFF for k in range(4))
    cut = lambda y: F.shiftleft(y.bitwiseAND(F.lit(0xFFFF)), 16)

    def product(x: Column) -> Column:
        low, high = _low(x), _right(x, 32)
        first = low * a + cut(low * b)
        more = _right(first, 32) + _right(low * b, 16) + low * c + high * a + cut(low * d + high * b)
        return _joined(more, first)

    return bound(x, product)


def _plus(x: Column, y: Column | int) -> Column:
    """x + y modulo 2^64."""

    def total(x: Column, y: Column) -> Column:
        low = _low(x) + _low(y)
        return _joined(_right(x, 32) + _right(y, 32) + _right(low, 32), low)

    if isinstance(y, int):
        return bound(x, lambda x: total(x, F.lit(_signed(y))))
    return bound(x, lambda x: bound(y, lambda y: total(x, y)))


def _turned(x: Column, n: int) -> Column:
    return bound(x, lambda x: F.shiftleft(x, n).bitwiseOR(_right(x, 64 - n)))


def _mixed(x: Column, n: int) -> Column:
    return bound(x, lambda x: x.bitwiseXOR(_right(x, n)))


def _each(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def xxh64(text: Column) -> Column:
    """The hash of a text's UTF-8 bytes as a long of the same 64 bits; null for null."""
    one, two, three, four, five = PRIMES

    def hashed(x: Column) -> Column:
        digits, size = x["digits"], x["size"]

        def lane(at: Column, width: int) -> Column:
            """`width` bytes from `at` on, the first one lowest. The digits are reversed, so that only halves of bytes change places."""
            part = F.conv(F.substring(digits, 2 * (size - at - width) + 1, F.lit(2 * width)), 16, -10).cast("long")
            half = _signed(0x0F0F0F0F0F0F0F0F)
            return bound(part, lambda v: F.shiftleft(v.bitwiseAND(F.lit(half)), 4).bitwiseOR(_right(v, 4).bitwiseAND(F.lit(half))))

        spread = lambda v: _times(_turned(_times(v, two), 31), one)
        stripes = _each(F.floor(size / 32).cast("int"))
        start = (one + two, two, 0, -one)

        def stripe(i: int) -> Callable[[Column, Column], Column]:
            return lambda v, k: _times(_turned(_plus(v, _times(lane(32 * k + 8 * i, 8), two)), 31), one)

        sums = [F.aggregate(stripes, F.lit(_signed(s)).cast("long"), stripe(i)) for i, s in enumerate(start)]

        def merged(v: Column) -> Column:
            each = [v[i] for i in range(4)]
            h = _turned(each[0], 1)
            for y, n in zip(each[1:], (7, 12, 18)):
                h = _plus(h, _turned(y, n))
            for y in each:
                h = _plus(_times(h.bitwiseXOR(spread(y)), one), four)
            return h

        h = F.when(size >= 32, bound(F.array(*sums), merged)).otherwise(F.lit(_signed(five)))
        h = _plus(h, size.cast("long"))
        done = F.floor(size / 32).cast("int") * 32
        eights = F.floor((size - done) / 8).cast("int")
        h = F.aggregate(_each(eights), h, lambda h, k: _plus(_times(_turned(h.bitwiseXOR(spread(lane(done + 8 * k, 8))), 27), one), four))
        done = done + 8 * eights
        fours = F.floor((size - done) / 4).cast("int")
        h = F.aggregate(_each(fours), h, lambda h, k: _plus(_times(_turned(h.bitwiseXOR(_times(lane(done + 4 * k, 4), one)), 23), two), three))
        done = done + 4 * fours
        h = F.aggregate(_each(size - done), h, lambda h, k: _times(_turned(h.bitwiseXOR(_times(lane(done + k, 1), five)), 11), one))
        h = _times(_mixed(h, 33), two)
        return _mixed(_times(_mixed(h, 29), three), 32)

    data = F.encode(text, "UTF-8")
    return bound(F.struct(F.reverse(F.hex(data)).alias("digits"), F.octet_length(text).alias("size")), lambda x: F.when(x["digits"].isNotNull(), hashed(x)))


def unsigned_mod(x: Column, n: int) -> Column:
    """The 64 bits of `x`, as a number without sign, modulo n below 2^31."""
    return bound(x, lambda x: ((_right(x, 32) % n * ((1 << 32) % n) + _low(x)) % n).cast("int"))


def xxh64_sql(text: str) -> str:
    """DuckDB: the same over 128-bit whole numbers, as an expression of UBIGINT."""
    one, two, three, four, five = (f"{p}::UHUGEINT" for p in PRIMES)
    wrap = lambda e: f"(({e}) % 18446744073709551616)"
    times = lambda x, y: wrap(f"({x}) * {y}")
    plus = lambda x, y: wrap(f"({x}) + ({y})")
    big = lambda x: f"({x})::UHUGEINT"
    let = lambda x, name, e: f"list_transform([{x}], lambda {name}: {e})[1]"
    turned = lambda x, n: let(x, "t", f"({wrap(f't * {1 << n}')} + t // {1 << (64 - n)})")
    mixed = lambda x, n: let(x, "m", f"xor(m, m // {1 << n})")
    spread = lambda v: times(turned(times(v, two), 31), one)

    def lane(at: str, width: int) -> str:
        parts = " || ".join(f"substr(hex({text}), (2 * ({at}) + {2 * k + 1})::BIGINT, 2)" for k in reversed(range(width)))
        return big(f"('0x' || {parts})::UBIGINT")

    size = f"octet_length(encode({text}))"
    each = lambda n: f"range(({n})::BIGINT)"
    fold = lambda n, start, e: f"list_reduce(list_transform({each(n)}, lambda q: q::UHUGEINT), lambda h, k: {e}, {start})"
    start = [(PRIMES[0] + PRIMES[1]) % 2**64, PRIMES[1], 0, -PRIMES[0] % 2**64]
    sums = [fold(f"{size} // 32", big(str(s)), times(turned(plus("h", times(lane(f"32 * k + {8 * i}", 8), two)), 31), one)) for i, s in enumerate(start)]
    h = turned("v[1]", 1)
    for i, n in ((2, 7), (3, 12), (4, 18)):
        h = plus(h, turned(f"v[{i}]", n))
    for i in range(1, 5):
        h = plus(times(f"xor({h}, {spread(f'v[{i}]')})", one), four)
    h = plus(f"CASE WHEN {size} >= 32 THEN {let('[' + ', '.join(sums) + ']', 'v', h)} ELSE {five} END", big(size))
    done = f"({size} // 32 * 32)"
    h = fold(f"({size} - {done}) // 8", h, plus(times(turned(f"xor(h, {spread(lane(f'{done} + 8 * k', 8))})", 27), one), four))
    done = f"({size} // 8 * 8)"
    h = fold(f"({size} - {done}) // 4", h, plus(times(turned(f"xor(h, {times(lane(f'{done} + 4 * k', 4), one)})", 23), two), three))
    done = f"({size} // 4 * 4)"
    h = fold(f"{size} - {done}", h, times(turned(f"xor(h, {times(lane(f'{done} + k', 1), five)})", 11), one))
    return mixed(times(mixed(times(mixed(h, 33), two), 29), three), 32)
