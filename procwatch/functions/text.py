"""Text expressions: words, tokens, hash buckets, ids, prefixes.

Everything works inside one row on the JVM, so a text is never spread over rows
just to be counted.
"""

from pyspark.sql import Column, functions as F

from procwatch import fixed_values as fv

_WS = fv.WHITE_SPACE


def strip(text: Column) -> Column:
    """Text without white space at its ends; one greedy match, which is quick on long texts."""
    return F.regexp_extract(text, f"(?s)^{_WS}*(.*[^{_WS[1:-1]}])", 1)


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(text, f"{_WS}+"), lambda w: w != "")


def tokens_ws(text: Column) -> Column:
    """Lower-case words, the tokens of lexical search."""
    return words(F.lower(text))


def tokens_alnum(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, the tokens of the hashed vectors."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def hash_bucket(token: Column, size: int = fv.VECTOR_SIZE) -> Column:
    """The token's MD5 as a number, modulo `size`.

    The 128-bit value is read in pieces that fit a long (15, 15 and 2 hex digits)
    and reduced piece by piece as in schoolbook division.
    """
    digest = F.md5(token)
    rest = None
    for start, digits in ((1, 15), (16, 15), (31, 2)):
        piece = F.conv(F.substring(digest, start, digits), 16, 10).cast("long") % F.lit(size)
        rest = piece if rest is None else (rest * F.lit(16 ** digits % size) + piece) % F.lit(size)
    return rest.cast("int")


def hash_buckets(text: Column, size: int = fv.VECTOR_SIZE) -> Column:
    """The bucket of every alphanumeric token of a text."""
    return F.transform(tokens_alnum(text), lambda t: hash_bucket(t, size))


def hashed_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by '::'."""
    return F.substring(F.sha1(F.concat_ws("::", *parts)), 1, 16)


def citation(source_id: str = "source_id", title: str = "title") -> Column:
    return F.coalesce(F.nullif(F.col(source_id), F.lit("")), F.col(title))


def snippet(text: Column, chars: int = 600) -> Column:
    return F.substring(text, 1, chars)


def fill_template(template: str, columns: set[str] | list[str]) -> Column:
    """A text template as a concatenation: `{x}` is column x as text, `{x|d}` has a default.

    A value that is missing reads `None`; so does a column the rows do not have,
    unless the template gives a default for it.
    """
    parts = []
    for piece in template.split("{"):
        name, closing, rest = piece.partition("}")
        if not closing:
            parts.append(F.lit(piece))
            continue
        name, _, default = name.partition("|")
        if name in columns:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("None")))
        else:
            parts.append(F.lit(default or "None"))
        parts.append(F.lit(rest))
    return F.concat(*parts)
