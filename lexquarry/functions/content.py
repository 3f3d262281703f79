"""What kind of content bytes are: signatures, control bytes, byte-order marks, entropy. For single values and for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, LEAST_HEAD = 8192, 10
OVERSIZED = 4 << 30
HELD = 1024
DENSE_BYTES = 4096

#: first bytes of file formats, in hexadecimal, by length
SIGNATURES = tuple(
    bytes.fromhex(x)
    for x in """424d 4d5a fffb fff3 1f8b
    425a68 494433 4f5243 ffd8ff
    04224d18 0061736d 1a45dfa3 25504446 28b52ffd 47494638 49492a00 4d4d002a 4f676753 504b0304 50415231 52494646 52617221 53504e47
    00000100 664c6143 7f454c46 89504e47 cafebabe cefaedfe cffaedfe d0cf11e0 feedface feedfacf
    fd377a585a 377abcaf271c 4152524f5731 0000001c66747970 53514c69746520666f726d61742033""".split()
)
UTF8_BOM = b"\xef\xbb\xbf"
DECODING_BOMS = (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff", b"\xff\xfe", b"\xfe\xff")
_CONTROL = bytes(set(range(32)) - {9, 10, 13})
_KEEP = bytes(set(range(256)) - set(_CONTROL))


def has_signature(content: bytes) -> bool:
    return content.startswith(SIGNATURES)


def is_likely_binary(content: bytes) -> bool:
    """Over a tenth of the first 8,192 bytes (10 at least) are control bytes other than tab, feed and return."""
    head = content[:HEAD]
    return len(head) >= LEAST_HEAD and len(head.translate(None, _KEEP)) > len(head) // 10


def has_decoding_bom(content: bytes) -> bool:
    return content.startswith(DECODING_BOMS)


def searchable_prefix(content: bytes) -> bytes:
    """The bytes before the first NUL."""
    at = content.find(0)
    return content if at < 0 else content[:at]


def is_high_entropy(n_bytes: int, n_keys: int) -> bool:
    return n_bytes >= DENSE_BYTES and 2 * n_keys > 3 * n_bytes


# ---------------------------------------------------------------- columns (of binary type)
def _starts(c: Column, b: bytes) -> Column:
    return F.substring(c, 1, len(b)) == F.lit(bytearray(b))


def signature_column(c: Column) -> Column:
    out = F.lit(False)
    for s in SIGNATURES:
        out = out | _starts(c, s)
    return out


def control_bytes_column(c: Column) -> Column:
    """How many of the first 8,192 bytes are control bytes; ISO-8859-1 gives a character a byte."""
    head = F.decode(F.substring(c, 1, HEAD), "ISO-8859-1")
    return F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))


def likely_binary_column(c: Column) -> Column:
    n = F.least(F.octet_length(c), F.lit(HEAD))
    return (n >= LEAST_HEAD) & (control_bytes_column(c) > F.floor(n / 10))


def decoding_bom_column(c: Column) -> Column:
    return _starts(c, b"\xff\xfe") | _starts(c, b"\xfe\xff") | _starts(c, b"\x00\x00\xfe\xff")


def without_bom_column(c: Column) -> Column:
    return F.when(_starts(c, UTF8_BOM), F.substring(c, F.lit(4), F.octet_length(c))).otherwise(c)


def nul_position(c: Column) -> Column:
    """1-based; 0 without a NUL."""
    return F.instr(F.decode(c, "ISO-8859-1"), F.lit("\0"))


def searchable_prefix_column(c: Column) -> Column:
    at = nul_position(c)
    return F.when(at == 0, c).otherwise(F.substring(c, F.lit(1), F.greatest(at - 1, F.lit(0))))


def decoded_column(c: Column, encoding: str | None = None) -> Column:
    """Text of binary content: by the given encoding, else by its byte-order mark, else UTF-8."""
    if encoding:
        return F.decode(c, encoding)
    return (
        F.when(_starts(c, b"\xff\xfe"), F.decode(F.substring(c, F.lit(3), F.octet_length(c)), "UTF-16LE"))
        .when(_starts(c, b"\xfe\xff"), F.decode(F.substring(c, F.lit(3), F.octet_length(c)), "UTF-16BE"))
        .otherwise(F.make_valid_utf8(without_bom_column(c).cast("string")))
    )
