"""Scalar functions on DNA text and packed bases, as Column expressions that stay in the JVM.

Bases count A=0 C=1 G=2 T=3, case aside; whatever else counts as A, except where a function says otherwise. Each takes
column names or Columns; nulls give null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col
MASK64 = (1 << 64) - 1


def _col(x) -> Column:
    return C(x) if isinstance(x, str) else x


def encode_base(c) -> Column:
    """The code of a one-letter text."""
    return F.when(_col(c).isNull(), None).otherwise(F.coalesce(F.try_element_at(F.create_map(*[x for i, b in enumerate("ACGT") for x in (F.lit(b), F.lit(i))]), F.upper(_col(c))), F.lit(0)))


def base_from_ascii(c) -> Column:
    """The code by bits 1 and 2 of the letter: as encode_base on ACGTacgtNn, but not on other letters."""
    a = F.ascii(_col(c))
    return F.shiftright(a, 1).bitwiseXOR(F.shiftright(a, 2)).bitwiseAND(F.lit(3))


def complement(s) -> Column:
    """Each base's partner, its case kept; whatever is no base, N and n too, stays as it is."""
    return F.translate(_col(s), "ACGTacgt", "TGCAtgca")


def revcomp(s) -> Column:
    return F.reverse(complement(s))


def is_revcomp_min(s) -> Column:
    """True where the text sorts before its reverse complement."""
    return _col(s) < revcomp(s)


def clean(s) -> Column:
    """Upper case, with A for what is no base."""
    return F.regexp_replace(F.upper(_col(s)), "[^ACGT]", "A")


def _digits(s: Column, letters: str, digits: str, base: int) -> Column:
    return F.conv(F.translate(s, letters, digits), base, 10).cast("bigint")


def kmer_value(s, pos=0, length: int = 31) -> Column:
    """The value of length bases from pos (0-based), first base highest."""
    return _digits(clean(F.substring(_col(s), (F.lit(pos) if isinstance(pos, int) else _col(pos)) + 1, F.lit(length))), "ACGT", "0123", 4)


def revcomp_value(s, pos=0, length: int = 31) -> Column:
    """The value of the reverse complement of those bases."""
    return _digits(F.reverse(clean(F.substring(_col(s), (F.lit(pos) if isinstance(pos, int) else _col(pos)) + 1, F.lit(length)))), "ACGT", "3210", 4)


def canonical_value(s, pos=0, length: int = 31) -> tuple[Column, Column]:
    """(the smaller of the two strands' values, whether it is the reverse complement's); a palindrome's is not."""
    fwd, rc = kmer_value(s, pos, length), revcomp_value(s, pos, length)
    return F.least(fwd, rc), rc < fwd


def decode_kmer(value, length: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(value).cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def canonical_kmer(s) -> Column:
    """The text or its reverse complement, whichever sorts first."""
    return F.least(_col(s), revcomp(s))


def lmer_to_ry(s) -> Column:
    """Purine and pyrimidine bits, A and G 0, C and T 1, first base highest."""
    return _digits(clean(s), "ACGT", "0101", 2)


def _joined_bits(value, length: int, bit: Callable[[Column, int], Column]) -> Column:
    parts = [bit(_col(value).cast("bigint"), i) for i in range(length)]
    return reduce(Column.bitwiseOR, parts)


def back_value(value, length: int) -> Column:
    """The value of the reverse complement, from the value of length bases: numbers only, for length up to 31."""
    three = F.lit(3).cast("bigint")
    return _joined_bits(value, length, lambda v, i: F.shiftleft(three - F.shiftright(v, 2 * i).bitwiseAND(three), 2 * (length - 1 - i)))


def value_to_ry(value, length: int) -> Column:
    """lmer_to_ry of the bases that have this value: each code's low bit."""
    return _joined_bits(value, length, lambda v, i: F.shiftleft(F.shiftright(v, 2 * i).bitwiseAND(F.lit(1).cast("bigint")), i))


def ry_revcomp(ry, length: int) -> Column:
    """The bits of the reverse complement's pattern."""
    one = F.lit(1).cast("bigint")
    return _joined_bits(ry, length, lambda v, i: F.shiftleft(one - F.shiftright(v, i).bitwiseAND(one), length - 1 - i))


def canonical_at(fwd, rev, pos, k: int) -> Column:
    """canonical_kmer of the k bases from pos (0-based) of an ASCII text, from the bytes of the text and of its reverse complement,
    which a row has once for all its places."""
    p = _col(pos)
    back = F.substring(_col(rev), F.length(_col(fwd)) - p - (k - 1), F.lit(k))
    return F.least(F.substring(_col(fwd), p + 1, F.lit(k)), back).cast("string")


def places(length: int, seq: str = "seq") -> Column:
    """Generates every place of a text that has ``length`` bases from there; null for a text without. An outer one, as Spark puts a
    filter before others, which would derive the text twice."""
    return F.explode_outer(F.expr(f"case when length({seq}) >= {length} then sequence(0, length({seq}) - {length}) end"))


def is_valid(s) -> Column:
    """True where there are bases only."""
    return _col(s).rlike(r"^[ACGTacgt]*\z")


def _once(text: Column, make: Callable[[Column], Column]) -> Column:
    """make of a text that is computed once: a lambda's body would compute it anew for each element."""
    return F.get(F.transform(F.array(text), make), F.lit(0))


def pack_words(s, strand: str = "forward") -> Column:
    """32 bases to a 64-bit word, first base highest, the last word filled with A. strand "reverse" packs the
    reverse complement, in which what is no base counts as T."""
    digits = F.regexp_replace(F.translate(_col(s), "ACGTacgt123", "01230123000"), "[^0-3]", "0")
    text = digits if strand == "forward" else F.translate(F.reverse(digits), "0123", "3210")
    word = lambda t, i: F.conv(F.substring(t, (i * 32 + 1).cast("int"), F.lit(32)), 4, -10).cast("bigint")
    words = lambda t: F.when(F.length(t) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(t) / 32).cast("int") - 1)), lambda i: word(t, i)))
    return _once(text, lambda t: _once(F.rpad(t, (F.ceil(F.length(t) / 32) * 32).cast("int"), "0"), words))


def pack_bytes(s) -> Column:
    """4 bases to a byte, first base lowest, the last byte filled with A."""
    byte = lambda t, i: F.conv(F.translate(F.reverse(F.substring(t, (i * 4 + 1).cast("int"), F.lit(4))), "ACGT", "0123"), 4, 10).cast("int")
    made = lambda t: F.when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(t) / 4).cast("int") - 1)), lambda i: byte(t, i)))
    return _once(F.rpad(clean(s), (F.ceil(F.length(_col(s)) / 4) * 4).cast("int"), "A"), made)


def get_base(words, pos) -> Column:
    """The base at pos (0-based) of packed words."""
    p = F.lit(pos) if isinstance(pos, int) else _col(pos)
    word = F.get(_col(words), (p / 32).cast("int"))
    return F.call_function("shiftrightunsigned", word, (62 - 2 * (p % 32)).cast("int")).bitwiseAND(F.lit(3).cast("bigint"))


def get_kmer_value(words, pos, length: int) -> Column:
    """The value of length bases from pos of packed words, over word borders."""
    p = F.lit(pos) if isinstance(pos, int) else _col(pos)
    if length < 32:  # at most two words
        word, off = F.get(_col(words), (p / 32).cast("int")), (p % 32 * 2).cast("int")
        rest = F.call_function("shiftrightunsigned", F.get(_col(words), (p / 32).cast("int") + 1), (64 - off).cast("int"))
        both = F.call_function("shiftleft", word, off).bitwiseOR(F.when(p % 32 + length > 32, rest).otherwise(F.lit(0).cast("bigint")))
        return F.call_function("shiftrightunsigned", both, F.lit(64 - 2 * length))
    return F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0).cast("bigint"), lambda acc, i: acc * 4 + get_base(words, p + i))


def compress_score(priority, tie) -> Column:
    return F.shiftleft(_col(priority).cast("bigint"), 31).bitwiseOR(_col(tie).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")))


def fragments(seq: str = "seq", least: int = 1) -> Column:
    """The stretches between N or n of at least that length, as array<struct<offset,fragment>>."""
    return F.expr(
        f"filter(aggregate(split({seq}, '[Nn]', -1), named_struct('at', 0L, 'out', cast(array() as array<struct<offset:bigint,fragment:string>>)), "
        f"(acc, f) -> named_struct('at', acc.at + length(f) + 1, 'out', concat(acc.out, array(named_struct('offset', acc.at, 'fragment', f)))), acc -> acc.out), x -> length(x.fragment) >= {least})"
    )


def register(spark) -> None:
    """The functions of texts for SQL, as temporary SQL functions that the optimizer inlines."""
    for name, body in {
        "dna_revcomp(s string) returns string": "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))",
        "dna_canonical(s string) returns string": "least(s, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')))",
        "dna_is_valid(s string) returns boolean": r"s rlike r'^[ACGTacgt]*\z'",
        "dna_value(s string) returns bigint": "cast(conv(translate(regexp_replace(upper(s), '[^ACGT]', 'A'), 'ACGT', '0123'), 4, 10) as bigint)",
        "dna_decode(v bigint, n int) returns string": "translate(lpad(conv(cast(v as string), 10, 4), n, '0'), '0123', 'ACGT')",
    }.items():
        spark.sql(f"create or replace temporary function {name} return {body}")
