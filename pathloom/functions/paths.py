"""AS paths: cleaning, pieces, edges, edit distance and the valley-free rule, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.net import let

# Private and reserved AS numbers.
PRIVATE_RANGES = ((64512, 65534), (4200000000, 4294967294))
RESERVED = (0, 23456, 65535, 4294967295)

_SET = r"(?<!\S)[^\s{}]*\{[^\s}]*(?:\s+[^\s}]+)*(?:\s*\}\S*|\s*$)|(?<!\S)\S*\}\S*"
_NO_NUMBER = r"(?<!\S)(?![0-9]+(?!\S))\S+"
_TIDY = r"^[1-9][0-9]*(?: [1-9][0-9]*)*\z"  # not $: that also matches before a last line end


def _digits(low: int, high: int) -> list[str]:
    """Patterns that together match just the decimal numbers from low to high (of equal width)."""
    a, b = str(low), str(high)
    if a == b:
        return [a]
    same = next(i for i in range(len(a)) if a[i] != b[i])
    head, left = a[:same], len(a) - same - 1
    if left == 0:
        return [f"{head}[{a[-1]}-{b[-1]}]"]
    below = _digits(low, int(a[: same + 1] + "9" * left))
    above = _digits(int(b[: same + 1] + "0" * left), high)
    if set(a[same + 1 :]) == {"0"} and set(b[same + 1 :]) == {"9"}:
        return [f"{head}[{a[same]}-{b[same]}][0-9]{{{left}}}"]
    if set(a[same + 1 :]) == {"0"}:
        below = [f"{a[: same + 1]}[0-9]{{{left}}}"]
    if set(b[same + 1 :]) == {"9"}:
        above = [f"{b[: same + 1]}[0-9]{{{left}}}"]
    middle = [f"{head}[{int(a[same]) + 1}-{int(b[same]) - 1}][0-9]{{{left}}}"] if int(b[same]) - int(a[same]) > 1 else []
    return below + middle + above


def _by_first_digit(patterns: list[str]) -> str:
    """One pattern that fails at a number's first digit where it can."""
    heads = sorted({p[0] for p in patterns})
    return "|".join(f"{h}(?:{'|'.join(p[1:] for p in patterns if p[0] == h)})" for h in heads)


_RANGES = [p for low, high in PRIVATE_RANGES for p in _digits(low, high)]
# in tidy text after a blank; a pattern that begins with a letter of its own is fast
_UNFIT = " (?:" + _by_first_digit([*map(str, RESERVED), *_RANGES]) + r")(?= |\z)"
_REPEATS = r" ([0-9]++)(?: \1(?= |\z))+"


def is_public_asn(asn: Column) -> Column:
    """Whether a number is a public AS number: neither private nor reserved. Null stays null."""
    bad = asn.isin(*RESERVED)
    for low, high in PRIVATE_RANGES:
        bad = bad | asn.between(low, high)
    return ~bad


def clean_path(raw: Column) -> Column:
    """The cleaned path as text with single blanks.

    AS sets go, even if they run over several tokens or are never closed; so do tokens that are no
    number, private and reserved numbers; then repeats in a row count once, also where only a removed
    token stood between them. Null, empty and fully removed paths give ''.
    """
    text = F.coalesce(raw, F.lit(""))
    sets = F.when(F.contains(text, F.lit("{")) | F.contains(text, F.lit("}")), F.regexp_replace(text, _SET, " ")).otherwise(text)
    numbers = F.regexp_replace(F.regexp_replace(sets, _NO_NUMBER, ""), r"(?<!\S)0+(?=[0-9])", "")
    tidy = F.when(text.rlike(_TIDY), text).otherwise(F.btrim(F.regexp_replace(numbers, r"\s+", " ")))
    fit = F.regexp_replace(F.concat(F.lit(" "), tidy), _UNFIT, "")
    return F.call_function("ltrim", F.regexp_replace(fit, _REPEATS, " $1"))


def path_array(clean: Column) -> Column:
    """The AS numbers of a cleaned path; [] for ''."""
    return F.when(F.coalesce(clean, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(F.split(clean, " ").cast("array<bigint>"))


def parse_path(raw: Column, drop: Column | None = None) -> Column:
    """A raw path as numbers; `drop` is an array of further numbers to remove before repeats are joined."""
    path = path_array(clean_path(raw))
    if drop is None:
        return path
    kept = lambda p: F.filter(p, lambda x: ~F.array_contains(drop, x))
    return let(kept(path), lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, F.greatest(i - 1, F.lit(0))))))


def path_length(path: Column) -> Column:
    return F.size(path)


def origin_as(path: Column) -> Column:
    """The last number as text, '' for an empty path."""
    return F.coalesce(F.get(path, F.size(path) - 1).cast("string"), F.lit(""))


def path_contains(path: Column, asn: Column | int) -> Column:
    return F.array_contains(path, asn)


def path_edges(path: Column) -> Column:
    """Consecutive pairs as structs (u, v) with u < v; repeats are kept, self-loops not."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))),
        lambda i: F.struct(
            F.least(F.get(path, i - 1), F.get(path, i)).alias("u"), F.greatest(F.get(path, i - 1), F.get(path, i)).alias("v")
        ),
    )
    empty = F.array().cast("array<struct<u:bigint,v:bigint>>")
    return F.when(F.size(path) > 1, F.filter(pairs, lambda e: e.u != e.v)).otherwise(empty)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two paths in tokens; 0 if either is empty or null.

    Each number becomes one character, so that the built-in levenshtein can be used.
    """

    def coded(path: Column, alphabet: Column) -> Column:
        # U+0100 on; the surrogates and what follows stay out of reach (a path has far fewer numbers)
        return F.array_join(F.transform(path, lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(alphabet, x) + 256), 4, "0")), "UTF-16BE")), "")

    distance = let(F.array_distinct(F.concat(a, b)), lambda al: F.levenshtein(coded(a, al), coded(b, al)))
    return F.when((F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0), F.lit(0)).otherwise(distance)


def valley_free(hops: Column) -> Column:
    """Checks hop relationships (+1 up, 0 peer, -1 down, null unknown) against up* peer? down*.

    Gives struct(valid, violation, known): the index of the first violating hop or null, and the number
    of known hops up to and including it.
    """
    start = F.struct(
        F.lit(0).alias("phase"), F.lit(0).alias("i"), F.lit(0).alias("known"), F.lit(None).cast("int").alias("violation")
    )

    def step(s: Column, rel: Column) -> Column:
        over = s.violation.isNotNull()
        bad = rel.isNotNull() & (((rel == 1) & (s.phase > 0)) | ((rel == 0) & (s.phase > 0)))
        phase = F.when(rel == 1, s.phase).when(rel == 0, F.lit(1)).when(rel == -1, F.lit(2)).otherwise(s.phase)
        return F.struct(
            F.when(over | bad, s.phase).otherwise(phase).alias("phase"),
            (s.i + 1).alias("i"),
            (s.known + F.when(~over & rel.isNotNull(), 1).otherwise(0)).alias("known"),
            F.when(over, s.violation).when(bad, s.i).alias("violation"),
        )

    done = lambda s: F.struct(s.violation.isNull().alias("valid"), s.violation.alias("violation"), s.known.alias("known"))
    return F.aggregate(hops, start, step, done)
