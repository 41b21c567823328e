"""Murmur3 and XXH64 as SQL, to check hashed ids and splits independently in DuckDB."""

# 32-bit Murmur3 of ASCII texts with seed 42: whole four-byte words, then single bytes. CTEs
# `steps` and `hashed(txt, {id})`; needs WITH RECURSIVE. Its multipliers.
MURMUR_SQL = """
steps(txt, pos, h) AS (
    SELECT txt, 0, 42::HUGEINT FROM ({keys})
    UNION ALL
    SELECT txt, pos + CASE WHEN length(txt) - pos >= 4 THEN 4 ELSE 1 END,
           (((xor(h, k3) * 8192) % 4294967296 + xor(h, k3) // 524288) * 5 + 3864292196) % 4294967296
    FROM (
        SELECT txt, pos, h, (k2 * 461845907) % 4294967296 AS k3
        FROM (
            SELECT txt, pos, h, (k1 * 32768) % 4294967296 + k1 // 131072 AS k2
            FROM (
                SELECT txt, pos, h, (k0 * 3432918353) % 4294967296 AS k1
                FROM (
                    SELECT txt, pos, h,
                           CASE WHEN length(txt) - pos >= 4
                                THEN ascii(substr(txt, pos + 1, 1)) + ascii(substr(txt, pos + 2, 1)) * 256
                                     + ascii(substr(txt, pos + 3, 1)) * 65536
                                     + ascii(substr(txt, pos + 4, 1)) * 16777216::HUGEINT
                                ELSE ascii(substr(txt, pos + 1, 1)) END::HUGEINT AS k0
                    FROM steps WHERE pos < length(txt)
                )
            )
        )
    )
),
hashed AS (
    SELECT txt, CAST(CASE WHEN f5 >= 2147483648 THEN 4294967296 - f5 ELSE f5 END AS BIGINT) AS {id}
    FROM (SELECT txt, xor(f4, f4 // 65536) AS f5
    FROM (SELECT txt, (f3 * 3266489909) % 4294967296 AS f4
    FROM (SELECT txt, xor(f2, f2 // 8192) AS f3
    FROM (SELECT txt, (f1 * 2246822507) % 4294967296 AS f2
    FROM (SELECT txt, xor(f0, f0 // 65536) AS f1
    FROM (SELECT txt, xor(h, length(txt)::HUGEINT) AS f0 FROM steps WHERE pos >= length(txt)))))))
)"""

# 64-bit XXH64 with seed 42 of a bigint and then an int, over the line items. CTE
# `hashed(l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity, signed)`.
_M = "18446744073709551616"


def _times(value: str, factor: str) -> str:
    return f"(({value})::UHUGEINT * {factor}::UHUGEINT) % {_M}::UHUGEINT"


def _rotated(value: str, bits: int) -> str:
    return f"(({value}) * {2**bits}::UHUGEINT) % {_M}::UHUGEINT + ({value}) // {2 ** (64 - bits)}::UHUGEINT"


# The five primes of XXH64.
_P1 = "11400714785074694791"
_P2 = "14029467366897019727"
_P3 = "1609587929392839161"
_P4 = "9650029242287828579"
_P5 = "2870177450012600261"


def _chain(source: str, steps: list[str]) -> str:
    """Nested selects that rewrite `h` step by step, keeping the other columns."""
    for step in steps:
        source = f"(SELECT * REPLACE ({step} AS h) FROM {source})"
    return source


_FINISH = [
    f"xor(h, h // {2**33}::UHUGEINT)",
    _times("h", _P2),
    f"xor(h, h // {2**29}::UHUGEINT)",
    _times("h", _P3),
    f"xor(h, h // {2**32}::UHUGEINT)",
]


def _xxhash() -> str:
    start = """(SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity, 42::UHUGEINT AS h, 0::UHUGEINT AS k FROM lineitem)"""
    long_key = f"(SELECT * REPLACE ({_times('l_orderkey', _P2)} AS k) FROM {start})"
    long_key = f"(SELECT * REPLACE ({_rotated('k', 31)} AS k) FROM {long_key})"
    long_key = f"(SELECT * REPLACE ({_times('k', _P1)} AS k) FROM {long_key})"
    after_long = _chain(
        long_key,
        [
            f"(h + {_P5}::UHUGEINT + 8) % {_M}::UHUGEINT",
            "xor(h, k)",
            _rotated("h", 27),
            _times("h", _P1),
            f"(h + {_P4}::UHUGEINT) % {_M}::UHUGEINT",
            *_FINISH,
        ],
    )
    int_key = f"(SELECT * REPLACE ({_times('l_linenumber', _P1)} AS k) FROM {after_long})"
    after_int = _chain(
        int_key,
        [
            f"(h + {_P5}::UHUGEINT + 4) % {_M}::UHUGEINT",
            "xor(h, k)",
            _rotated("h", 23),
            _times("h", _P2),
            f"(h + {_P3}::UHUGEINT) % {_M}::UHUGEINT",
            *_FINISH,
        ],
    )
    signed = f"CASE WHEN h >= {2**63}::UHUGEINT THEN h::HUGEINT - {_M}::HUGEINT ELSE h::HUGEINT END"
    return f"hashed AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity, {signed} AS signed FROM {after_int})"


XXHASH_SQL = _xxhash()
