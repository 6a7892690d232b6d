"""Token ids in Simple-8b files.

Format of a file, all numbers little-endian, all parts multiples of eight bytes: blocks,
each followed by eight zero bytes. A block holds whole documents:

    8 bytes  b"S8BTOK01"
    5 x u64  documents, ids, groups, words, escapes
    i64[]    doc_id of each document (the smallest value stands for null)
    u64[]    ids of each document
    u32[]    for each group of 256 ids its first word, padded to eight bytes
    u64[]    words
    u64[]    escapes

A word's upper four bits select how many ids of how many bits it holds. Selector 15
holds the number of an escape: an id too wide for 60 bits. A group starts with a word of
its own, so that groups decode, and encode, side by side as numpy vectors.

Documents are put in order of their ids by range partitioning; a task turns one range
into one file, a block at a time. Spark's text writer writes the blocks through its
commit protocol on any file system; the eight zero bytes are its line end.
"""

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from procwatch.llm.inputs import kept_in_worker
from procwatch.session import materialize, session_dir

MAGIC, ROW_END = b"S8BTOK01", "\0" * 8
END_ID = 2
GROUP = 256
BLOCK_IDS = 1 << 18
STEP_IDS = 1 << 20  # ids encoded at once, a multiple of GROUP
BATCH_ROWS = 500
FILE_BLOCKS = 128  # blocks of a file at most: some 90 MB, so that a task can hold one
PREFIX_CHARS = 64  # of its text, by which rows that repeat an id are dealt
MEMO_ENTRIES = 1_000_000
_NULL = -(1 << 63)
#: ids per word and their bits, by selector; most ids first.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60], np.int64)
_PACKED, _ESCAPE = range(14), 15


_SHORT_WIDTHS = np.frexp(np.arange(1 << 16).astype(np.float64))[1].astype(np.uint8)


def _widths_of(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 61 for those that need an escape."""
    if ids.max() < 1 << 16:
        return _SHORT_WIDTHS[ids]
    high = ids >> np.uint64(32)
    low = ids & np.uint64(0xFFFFFFFF)
    bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])
    return np.minimum(bits, 61).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each group, escapes. Any unsigned 64-bit ids; none give none."""
    ids = np.ascontiguousarray(ids, np.uint64)
    words, firsts, escapes = [], [], []
    for start in range(0, len(ids), STEP_IDS):
        some, first, wide = _encode(ids[start:start + STEP_IDS], sum(map(len, escapes)))
        firsts.append(first + sum(map(len, words)))
        words.append(some)
        escapes.append(wide)
    joined = [np.concatenate(x) if x else np.zeros(0) for x in (words, firsts, escapes)]
    return joined[0].astype(np.uint64), joined[1].astype(np.uint32), joined[2].astype(np.uint64)


def _encode(ids: np.ndarray, escapes_before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids)
    bits = _widths_of(ids)
    # the selector of a word that would start here: the most ids that all fit and end in the group
    left = np.minimum(GROUP - np.arange(n) % GROUP, n - np.arange(n)).astype(np.uint16)
    chosen = np.full(n, _ESCAPE, np.uint8)
    widest, have = bits.copy(), 1
    for s in reversed(_PACKED):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        if count > n:
            break
        while have < count:
            widest[:n - have] = np.maximum(widest[:n - have], bits[have:])
            have += 1
        fits = (widest <= width) & (left >= count)
        if not fits.any():  # nor do more ids of fewer bits
            break
        chosen[fits] = s
    # all groups step from word to word together
    cursor = np.arange(0, n, GROUP)
    ends = np.minimum(cursor + GROUP, n)
    alive = np.arange(len(cursor))
    starts, owners = [], []
    at = cursor.copy()
    while len(alive):
        starts.append(at)
        owners.append(alive)
        at = at + COUNTS[chosen[at]]
        going = at < ends[alive]
        at, alive = at[going], alive[going]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    selector = chosen[start]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in _PACKED:
        mine = np.flatnonzero(selector == s)
        if len(mine):
            value = np.zeros(len(mine), np.uint64)
            for j in range(int(COUNTS[s])):
                value |= ids[start[mine] + j] << np.uint64(j * int(WIDTHS[s]))
            words[mine] |= value
    escaped = np.flatnonzero(selector == _ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64) + np.uint64(escapes_before)
    firsts = np.searchsorted(owner, np.arange(len(cursor)))
    return words, firsts, ids[start[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of a block, or of some of its groups (their words, all escapes)."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts, payload = ends - counts, words & np.uint64((1 << 60) - 1)
    for s in _PACKED:
        mine = np.flatnonzero(selector == s)
        if len(mine):
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(int(COUNTS[s])):
                ids[starts[mine] + j] = (payload[mine] >> np.uint64(j * int(WIDTHS[s]))) & mask
    escaped = selector == _ESCAPE
    ids[starts[escaped]] = escapes[payload[escaped].astype(np.int64)]
    return ids


def pack_block(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """One block of the file."""
    words, firsts, escapes = encode(ids)
    named = np.array([_NULL if d is None else d for d in doc_ids], np.int64)
    head = MAGIC + struct.pack("<5Q", len(named), len(ids), len(firsts), len(words), len(escapes))
    pad = b"\0" * (4 * (len(firsts) % 2))
    return b"".join([head, named.astype("<i8").tobytes(), np.array(lengths, "<u8").tobytes(),
                     firsts.astype("<u4").tobytes(), pad, words.astype("<u8").tobytes(),
                     escapes.astype("<u8").tobytes()])


def read_blocks(content: memoryview) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, lengths and ids of each block of a file."""
    at = 0
    while at < len(content):
        if bytes(content[at:at + 8]) != MAGIC:
            raise ValueError("no block of token ids")
        docs, n, groups, words, escapes = struct.unpack_from("<5Q", content, at + 8)
        at += 48
        parts = []
        for kind, count in (("<i8", docs), ("<u8", docs), ("<u4", groups + groups % 2),
                            ("<u8", words), ("<u8", escapes)):
            size = count * int(kind[-1])
            parts.append(np.frombuffer(content[at:at + size], kind))
            at += size
        ids = decode(parts[3], parts[4])
        if len(ids) != n:
            raise ValueError("a block's ids are not complete")
        yield parts[0], parts[1], ids
        at += len(ROW_END)


# White space other than blanks and line ends.
_RARE_SPACES = ("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
                + "\u2028\u2029\u202f\u205f\u3000")
# Points and commas after anything but a common letter or digit.
_OTHER_BEFORE_POINT = re.compile("[.,](?<![0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f][.,])")


class Encoder:
    """Ids of texts by a tokenizer file, remembering the ids of pieces between single blanks.

    A blank with a character that is no white space on either side always starts a new
    pre-token of a byte-level tokenizer, so a text's ids are those of its pieces in turn. Pieces
    next to other white space are encoded together with it. The first MEMO_ENTRIES pieces are
    remembered, later ones are encoded each time; that never changes a result.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()  # one character of a token stands for one byte
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _add(self, pieces: set[str]) -> dict[str, int]:
        """Places of new pieces, most of them encoded as one text: a piece that begins with a blank
        before a character that is no white space starts a new pre-token after one that ends
        likewise. Tokens are byte strings of known lengths, which tell where each piece ends."""
        whole = [p for p in pieces if p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace()]
        order = whole + list(pieces.difference(whole))
        texts = ["".join(whole[i:i + 2000]) for i in range(0, len(whole), 2000)] + order[len(whole):]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.array(one, np.uint32) for one in found])
        sizes = np.fromiter((len(p.encode()) for p in order), np.int64, len(order))
        cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
        counts = np.diff(cuts, prepend=0)
        known = len(self.place)
        self.flat = _room(self.flat, self.used + len(ids))
        self.starts, self.counts = (_room(x, known + len(order)) for x in (self.starts, self.counts))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[known:known + len(order)] = self.used + cuts - counts
        self.counts[known:known + len(order)] = counts
        new = dict(zip(order, range(known, known + len(order))))
        if known < MEMO_ENTRIES:  # else the next pieces take their room
            self.place.update(new)
            self.used += len(ids)
        return new

    @staticmethod
    def pieces(text: str) -> list[str]:
        """A text cut before blanks between two characters that are no white space, and, if all
        its points and commas follow letters or digits, before these, which never join them."""
        if not text:
            return []
        if not ("  " in text or "\n " in text or " \n" in text or "\0" in text or text[0].isspace()
                or text[-1].isspace() or any(c in text for c in _RARE_SPACES)):
            text = text.replace(" ", "\0 ")
            if not _OTHER_BEFORE_POINT.search(text):
                text = text.replace(".", "\0.").replace(",", "\0,")
            return text.split("\0")
        parts = text.split(" ")
        out, last = [parts[0]], parts[0]
        for part in parts[1:]:
            if last and part and not last[-1].isspace() and not part[0].isspace():
                out.append(" " + part)
            else:
                out[-1] += " " + part
            last = part
        return [p for p in out if p]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        cut = [self.pieces(t) for t in texts]
        every = [p for pieces in cut for p in pieces]
        place = np.array(list(map(self.place.get, every)), np.float64)  # not a number if new
        unknown = np.flatnonzero(np.isnan(place)).tolist()
        if unknown:
            added = self._add({every[i] for i in unknown})
            place[unknown] = [added[every[i]] for i in unknown]
        order = place.astype(np.int64)
        counts = self.counts[order]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.starts[order] - (ends - counts), counts) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, cut)])]
        return self.flat[source], np.diff(bounds)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """`values` with room for n of them."""
    return values if len(values) >= n else np.concatenate([values, np.zeros(max(n, len(values)), values.dtype)])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id",
                 text: str = "text", end_id: int = END_ID) -> str:
    """Write the ids of all texts, each followed by `end_id`, under `folder` in order of doc_id.

    `tokenizer` is the path of a tokenizer file, the same on all machines. A null or empty text
    has the end id only. Null ids come first; rows that repeat an id are ordered by their text, and
    dealt over tasks by its first `PREFIX_CHARS` characters. A long text is one row of a block. Files
    in order of the numbers in their names hold the documents in order; a task starts a new one
    after `FILE_BLOCKS` blocks. An empty table gives no blocks.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("token encoder", tokenizer), lambda: Encoder(tokenizer))
        names, lengths, ids, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            content = pack_block(names, lengths, np.concatenate(ids))
            return pa.RecordBatch.from_pydict({"block": pa.array([content], pa.binary())})

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found, counts = encoder.encode([t or "" for t in part["text"].to_pylist()])
                ends = np.cumsum(counts)
                ids.append(np.insert(found.astype(np.uint64), ends, end_id))
                names += part["doc_id"].to_pylist()
                lengths += (counts + 1).tolist()
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    names, lengths, ids, held = [], [], [], 0
        if names:
            yield block()

    spark = docs.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
         .repartitionByRange("doc_id", F.substring("text", 1, PREFIX_CHARS)).sortWithinPartitions("doc_id", "text")
         .mapInArrow(pack, "block binary").select(F.col("block").cast("string").alias("value"))
         .write.option("lineSep", ROW_END).option("maxRecordsPerFile", FILE_BLOCKS).mode("overwrite").text(folder))
    finally:
        spark.conf.set(setting, before)
    return folder


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document of the files: file, place in it, doc_id, ids before it, n_tokens, checksum.

    `ids=True` adds the ids themselves. `start` counts the ids of all documents before.
    A task holds one file and the ids of one block.
    """
    schema = "file string, n long, doc_id long, file_start long, n_tokens long, ids_crc32 long" + (
        ", ids array<long>" if ids else "")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                place = start = 0
                for doc_ids, lengths, found in read_blocks(memoryview(content.as_buffer())):
                    ends = np.cumsum(lengths.astype(np.int64))
                    begins = ends - lengths.astype(np.int64)
                    raw = found.astype("<u4")
                    sums = [zlib.crc32(raw[a:b]) for a, b in zip(begins, ends)]
                    n = len(doc_ids)
                    columns = [pa.array([path] * n, pa.string()),
                               pa.array(np.arange(place, place + n)),
                               pa.array(doc_ids.astype(np.int64), mask=doc_ids == _NULL),
                               pa.array(begins + start), pa.array(lengths.astype(np.int64)),
                               pa.array(sums, pa.int64())]
                    names = ["file", "n", "doc_id", "file_start", "n_tokens", "ids_crc32"]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(
                            np.concatenate([[0], ends]).astype(np.int32), pa.array(found.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    place, start = place + n, start + int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(parse, schema)


def with_starts(read: DataFrame) -> DataFrame:
    """Replace the place in a file by `start`, the ids of all documents before."""
    read = materialize(read, "token-rows")
    # a task's files are numbered, and tasks are; numbers of more digits are not in order of their names
    numbers = [F.regexp_extract("file", pattern, 1).cast("long")
               for pattern in (r"part-(\d+)-[^/]*$", r"-c(\d+)[^/-]*$")]
    before = Window.orderBy(*numbers).rowsBetween(Window.unboundedPreceding, -1)
    files = (read.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
             .select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    kept = [c for c in read.columns if c not in ("file", "n", "file_start")]
    # one row per file; written first, so that Spark decides by its size
    return read.join(materialize(files, "token-files"), "file").select(
        kept[0], (F.col("_before") + F.col("file_start")).alias("start"), *kept[1:])


def token_table(docs: DataFrame, tokenizer: str, **names) -> DataFrame:
    """Write the ids of `docs` into the shared folder; return per document what reading gives."""
    spark = docs.sparkSession
    folder = write_tokens(docs, f"{session_dir(spark)}/tokens-{uuid.uuid4().hex}", tokenizer, **names)
    return with_starts(read_tokens(spark, folder))
