"""Content ids decoded in column expressions: a base, a version, a codec, and a digest of a stated length.

Bases of a power of two are turned into hexadecimal text in blocks. Of base 36 and base 58 the whole number
is worked out, limb by limb, so their cost grows with the square of the length; ids of more than ``LONGEST`` characters
count as no ids. A null is no id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 1024

# Digits of the bases, in order of their value.
HEX_32 = "0123456789abcdefghijklmnopqrstuv"
RFC_32 = "abcdefghijklmnopqrstuvwxyz234567"
DIGITS_36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BITCOIN_58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
FLICKR_58 = "123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"

# Digits taken in one step, and bits of a limb: a limb times 58 to the 5th stays below 2^54.
STEP, LIMB = 5, 24

# A number in seven bits a byte, least first, in no more bytes than it needs.
_VARINT = "((?:[0-7][0-9a-f])|(?:[89a-f][0-9a-f]){1,8}(?!00)[0-7][0-9a-f])"
_VERSION_1 = rf"^01{_VARINT}{_VARINT}{_VARINT}((?:[0-9a-f]{{2}})*)$"
_VERSION_0 = "^1220([0-9a-f]{64})$"


def _hex_of_32(digits: Column) -> Column:
    """Bytes of base 32 text, its digits 0 to 9 and a to v, in blocks of eight digits."""
    count = F.char_length(digits)
    blocks = F.ceil(count / 8).cast("int")
    full = F.rpad(digits, blocks * 8, F.lit("0"))
    parts = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda i: F.lpad(F.lower(F.conv(F.substring(full, i * 8 + 1, F.lit(8)), 32, 16)), 10, "0"),
    )
    return F.substring(F.array_join(parts, ""), F.lit(1), (F.floor(count * 5 / 8) * 2).cast("int"))


def _hex_of_64(digits: Column) -> Column:
    return F.lower(F.hex(F.unbase64(F.translate(digits, "-_", "+/"))))


def _hex_of_number(text: Column, digits: str) -> Column:
    """Bytes of the number a text spells; its first digit is not zero."""
    base = len(digits)
    steps = F.ceil(F.char_length(text) / STEP).cast("int")
    full = F.lpad(text, steps * STEP, F.lit(digits[0]))

    def value(i: Column) -> Column:
        found = F.lit(0).cast("bigint")
        for k in range(STEP):
            digit = F.instr(F.lit(digits), F.substring(full, i * STEP + 1 + k, F.lit(1))) - 1
            found = found * base + digit
        return found

    def times(limbs: Column, more: Column) -> Column:
        """``limbs``, the least first, times a step's digits, plus the value of the step."""
        start = F.struct(more.alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def one(acc: Column, limb: Column) -> Column:
            product = limb * base**STEP + acc["carry"]
            low = product.bitwiseAND((1 << LIMB) - 1)
            return F.struct(F.shiftright(product, LIMB).alias("carry"), F.concat(acc["out"], F.array(low)).alias("out"))

        def close(acc: Column) -> Column:
            left = acc["carry"]
            return F.concat(acc["out"], F.array(left.bitwiseAND((1 << LIMB) - 1), F.shiftright(left, LIMB)))

        return F.aggregate(limbs, start, one, close)

    limbs = F.aggregate(
        F.transform(F.sequence(F.lit(0), steps - 1), value), F.array().cast("array<bigint>"), lambda acc, x: times(acc, x)
    )
    parts = F.transform(F.reverse(limbs), lambda x: F.lpad(F.lower(F.hex(x)), LIMB // 4, "0"))
    return F.regexp_replace(F.array_join(parts, ""), "^(?:00)+", "")


def bytes_of(text: Column) -> Column:
    """The bytes an id spells, as hexadecimal text; null where its base is not known or a digit is not of it."""
    body = F.substring(text, F.lit(2), F.char_length(text))
    lower = F.lower(body)
    plain = F.rtrim(body, F.lit("="))
    rfc = F.translate(F.lower(plain), RFC_32, HEX_32)
    short = F.char_length(text) <= LONGEST
    # Base 32 has 2, 4, 5, 7 or 8 digits in its last block, base 64 has 2, 3 or 4; padding fills the block.
    fits_32, fits_64 = (F.char_length(plain) % 8).isin(0, 2, 4, 5, 7), F.char_length(plain) % 4 != 1
    whole_32, whole_64 = F.char_length(body) % 8 == 0, F.char_length(body) % 4 == 0
    return (
        F.when(~short, None)
        .when(text.rlike("^Qm[1-9A-HJ-NP-Za-km-z]{44}$"), _hex_of_number(text, BITCOIN_58))
        .when(text.rlike("^[fF](?:[0-9a-fA-F]{2})+$"), lower)
        .when(text.rlike("^[bB][a-zA-Z2-7]+$") & fits_32, _hex_of_32(rfc))
        .when(text.rlike("^[cC][a-zA-Z2-7]+={0,6}$") & fits_32 & whole_32, _hex_of_32(rfc))
        .when(text.rlike("^[vV][0-9a-vA-V]+$") & fits_32, _hex_of_32(lower))
        .when(text.rlike("^[tT][0-9a-vA-V]+={0,6}$") & fits_32 & whole_32, _hex_of_32(F.lower(plain)))
        .when(text.rlike("^[kK][1-9a-zA-Z][0-9a-zA-Z]*$"), _hex_of_number(lower, DIGITS_36))
        .when(text.rlike("^z[2-9A-HJ-NP-Za-km-z][1-9A-HJ-NP-Za-km-z]*$"), _hex_of_number(body, BITCOIN_58))
        .when(text.rlike("^Z[2-9A-HJ-NP-Za-km-z][1-9A-HJ-NP-Za-km-z]*$"), _hex_of_number(body, FLICKR_58))
        .when(text.rlike("^[mu][A-Za-z0-9+/_-]+$") & fits_64 & _one_alphabet(text), _hex_of_64(body))
        .when(text.rlike("^[MU][A-Za-z0-9+/_-]+={0,2}$") & fits_64 & whole_64 & _one_alphabet(text), _hex_of_64(plain))
    )


def _one_alphabet(text: Column) -> Column:
    """Base 64 under ``m`` has ``+/`` for its last two digits, under ``u`` it has ``-_``."""
    return text.rlike("^(?:[mM][^_-]*|[uU][^+/]*)$")


def _number(varint: Column) -> Column:
    """The value of a number of up to three bytes; a longer one is longer than any id."""
    sevens = [F.coalesce(F.conv(F.substring(varint, 2 * i + 1, 2), 16, 10).try_cast("bigint"), F.lit(0)) for i in range(3)]
    return sum((F.shiftleft(s.bitwiseAND(127), 7 * i) for i, s in enumerate(sevens)), F.lit(0))


def _parsed(found: Column) -> Column:
    def part(n: int) -> Column:
        return F.regexp_extract(found, _VERSION_1, n)

    size, digest = part(3), part(4)
    whole = (F.char_length(size) <= 6) & (F.char_length(digest) == _number(size) * 2)
    old = F.struct(
        F.lit(0).alias("version"), F.lit("70").alias("codec"), F.lit("12").alias("hash"),
        F.regexp_extract(found, _VERSION_0, 1).alias("digest"),
    )
    new = F.struct(F.lit(1).alias("version"), part(1).alias("codec"), part(2).alias("hash"), digest.alias("digest"))
    return F.when(found.rlike(_VERSION_0), old).when(found.rlike(_VERSION_1) & whole, new)


def decoded(text: Column) -> Column:
    """(version, codec, hash, digest) of an id, null where it is none; ``codec`` and ``hash`` are the codes' bytes.

    Version 0 is the sha2-256 of a file's root in base 58, with no prefix. A digest must have the length
    its id states, and nothing may follow it. Which codes stand for what is not looked up.
    """
    # Through arrays of one, so that the text and its bytes are worked out once however often they are looked at.
    return F.get(F.transform(F.transform(F.array(text), bytes_of), _parsed), F.lit(0))
