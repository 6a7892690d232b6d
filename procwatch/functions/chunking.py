"""Splitting texts into chunks, and reading a document's front matter."""

import pyarrow as pa
from pyspark.sql import Column, functions as F

from procwatch import fixed_values as fv
from procwatch.functions.text import strip

PARAGRAPH_BREAK = f"\n{fv.WHITE_SPACE}*\n"
LINE_BREAK = "\r\n|\n|\r"
_TEXTS = 64  # that are Python strings at a time


def pack_paragraphs(paras: list[str], size: int, overlap: int) -> list[str]:
    """Fill chunks greedily with whole paragraphs.

    A paragraph that would push a chunk over `size` words closes it; the next chunk
    starts with the last `overlap` words of the closed one. The words of a paragraph are
    split once.
    """
    done: list[str] = []
    parts: list[str] = []      # of the open chunk
    held: list[str] = []       # its words
    for para in paras:
        new = para.split()
        if parts and len(held) + len(new) > size:
            done.append("\n\n".join(parts))
            held = held[max(len(held) - overlap, 0):] if overlap > 0 else []
            parts = [" ".join(held)] if held else []
        parts.append(para)
        held += new
    return [*done, "\n\n".join(parts)] if parts else done


def hard_split(chunk: str, size: int, overlap: int) -> list[str]:
    """A chunk of more than 1.5 x `size` words as overlapping slices of `size` words."""
    words = chunk.split()
    if len(words) * 2 <= size * 3:
        return [chunk]
    if overlap >= size:
        raise ValueError(f"an overlap of {overlap} words leaves no step for slices of {size}")
    return [" ".join(words[i:i + size]) for i in range(0, len(words), size - overlap)]


def chunk_text(text: Column, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP,
               separator: str = PARAGRAPH_BREAK) -> Column:
    """The chunks of a text: paragraphs packed to `size` words, oversized ones re-cut.

    Spark splits the text; a fold of column expressions is interpreted step by step, so
    paragraphs are packed in Python on Arrow batches, a few texts at a time. White space is
    the same there: what `str.split` and `str.strip` take away is `WHITE_SPACE`.
    """
    def chunks(pieces: list[str] | None) -> list[str] | None:
        if pieces is None:
            return None
        paras = [p for p in (piece.strip() for piece in pieces) if p]
        return [c for packed in pack_paragraphs(paras, size, overlap) for c in hard_split(packed, size, overlap)]

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array((chunks(pieces) for at in range(0, len(texts), _TEXTS)
                         for pieces in texts.slice(at, _TEXTS).to_pylist()), pa.list_(pa.string()))

    return F.arrow_udf(cut, "array<string>")(F.split(text, separator))


def _meta_lines(text: Column) -> Column:
    parts = F.split(text, "---", 3)
    inside = F.split(strip(F.get(parts, F.lit(1))), LINE_BREAK)
    return F.filter(inside, lambda line: F.contains(line, F.lit(":")))


def has_front_matter(text: Column) -> Column:
    return text.startswith("---") & (F.size(F.split(text, "---", 3)) == 3)


def front_matter(text: Column) -> Column:
    """The `key: value` lines between two `---` as a map; null without such a block.

    The last of repeated keys wins; quotes around a value are dropped.
    """
    pairs = F.transform(_meta_lines(text), lambda line: F.struct(
        strip(F.substring_index(line, ":", 1)).alias("key"),
        F.regexp_replace(strip(F.regexp_replace(line, "(?s)^[^:]*:", "")), "^[\"']+|[\"']+$", "")
        .alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))),
        lambda later: later["key"] == p["key"]))
    return F.when(has_front_matter(text), F.map_from_entries(last))


def body(text: Column) -> Column:
    return F.when(has_front_matter(text), strip(F.get(F.split(text, "---", 3), F.lit(2)))
                  ).otherwise(text)


def infer_source_type(path: Column) -> Column:
    """Document kind from a path: the file name decides before the folders do."""
    name = F.lower(F.substring_index(path, "/", -1))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    folder = F.lower(F.regexp_replace(path, "[^/]*$", ""))
    found = [F.when(F.contains(where, F.lit(kind)), F.lit(kind))
             for where in (stem, folder) for kind in fv.SOURCE_KINDS]
    return F.coalesce(*found, F.lit("document"))
