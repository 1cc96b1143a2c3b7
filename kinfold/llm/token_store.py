"""Token ids as binary files: canonical length-limited Huffman codes in independently decodable blocks.

1. Documents are dealt out by ranges of doc_id and tokenised once; each group of consecutive documents becomes one row of
   16- or 32-bit ids (the interim table).
2. Global counts of all ids give a canonical Huffman code whose lengths are limited by package-merge; the code book is
   the list of lengths by id.
3. Each group is coded on its own into one block: number of documents, ids of each document, the bit stream, and the bit
   offset of every ``stride``-th id. A block is decoded without any other.
4. Decoding looks ``max_bits`` bits up in one table and steps all checkpoints of a block forward together.

A store is a folder that can be read with nothing but its path. Its tables are Parquet, so that executors need nothing but
Spark's file systems: ``blocks`` (one file for each range, file names and rows in ascending doc_id order), ``codebook``
(id, length), ``ranges`` (range, first id, ids, documents, smallest and largest doc_id) and ``layout`` (limit, stride).

Equal pieces are tokenised once by each worker and kept in a bounded table. Pieces are found by the tokenizer's own pattern,
byte by byte, in texts of characters below U+0200 without unusual controls; any other text goes to the library as a whole.

Defined results: a null text is empty and has only the end id; rows of one doc_id stand next to each other in the order of
their texts' hashes; a null doc_id comes first; a doc_id that is no integer raises TypeError; an empty table gives an empty
store and result; extra columns are ignored; the code of a corpus with one distinct id has length 1; codes get longer than
``limit`` only where there are more than 2 ** limit different ids; a very long text is one group, held as a whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, integer_id, materialise, shuffle_width

_TOKENIZERS: dict[str, "WordTokenizer"] = {}

#: Bytes of texts whose pieces can be found byte by byte: printable ASCII, three blanks, and characters up to U+01FF.
_SAFE = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC2, 0xC8)])
#: But for controls, the no-break space, the soft hyphen and the dotted capital I (which lower-cases to two characters).
_UNSAFE = re.compile(rb"\xc2[\x80-\xa0\xad]|\xc4\xb0|<\|")

BLANK, LETTER, NUMBER, OTHER = range(4)


def _kind(char: str) -> int:
    return BLANK if char in "\t\n\r " else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(char)[0], OTHER)


#: Kinds by byte; of two-byte characters, those of the first byte, which are letters but for some that start with C2 and C3.
_KINDS = np.array([_kind(chr(b)) if b < 128 else LETTER for b in range(256)], np.uint8)
_LATIN = np.array([_kind(chr(c)) for c in range(256)], np.uint8)


def find_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte of a lower-cased safe text, and whether a piece starts there."""
    kinds = _KINDS[data]
    (tail,) = np.nonzero((data & 0xC0) == 0x80)
    if len(tail):
        lead = data[tail - 1]
        latin = lead <= 0xC3
        at = tail[latin]
        kinds[at] = kinds[at - 1] = _LATIN[(data[at - 1] & 3) << 6 | data[at] & 0x3F]
        kinds[tail[~latin]] = LETTER
    new = np.ones(len(data), bool)
    new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    new[tail] = False
    (mark,) = np.nonzero(data == 0x27)
    for q in mark[new[mark]].tolist():  # an apostrophe and the letters that go with it
        after = bytes(data[q + 1 : q + 3])
        n = 1 if after[:1] in (b"s", b"t", b"m", b"d") else 2 if after in (b"re", b"ve", b"ll") else 0
        if n:
            new[q + 1] = False
            kinds[q] = LETTER
            if q + 1 + n < len(data):
                new[q + 1 + n] = True
    return kinds, new


#: The split of a tokenizer whose pieces can be kept one by one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """The library's ids for whole texts, with the ids of each distinct piece kept.

    That holds for tokenizers that lower-case, split by PATTERN and mark the ends of words; of any other one, all texts go
    to the library as a whole.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        layout = json.loads(self.library.to_str())
        steps = (layout["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        folds = [x["type"] for x in (layout["normalizer"] or {}).get("normalizers", [])]
        self.keeps = (
            [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"], steps[1]) == ({"Regex": PATTERN}, "Removed", True, plain)
            and folds == ["NFC", "Replace", "Lowercase"]
            and layout["model"]["end_of_word_suffix"] == "</w>"
        )
        self.tokenize, self.spelling = self.library.model.tokenize, byte_spelling()
        self.forget()

    def forget(self) -> None:
        """known: number of each piece; the ids of piece n are flat[start[n] : start[n + 1]]."""
        self.known: dict[bytes, int] = {}
        self.flat, self.start = array("I"), array("q", [0])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _number(self, piece: bytes) -> int:
        """Enter a piece: the model alone on its bytes, as the byte-level step spells them."""
        spelled = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.spelling)
        self.flat.extend([t.id for t in self.tokenize(spelled)])
        self.start.append(len(self.flat))
        self.known[piece] = n = len(self.known)
        return n

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text."""
        safe = [self.keeps and not t.translate(None, _SAFE) and not _UNSAFE.search(t) for t in texts]
        out: list[np.ndarray | None] = [None if ok else self._whole(t.decode()) for t, ok in zip(texts, safe, strict=True)]
        lows = [t.lower() if t.isascii() else t.decode().lower().encode() for t, ok in zip(texts, safe, strict=True) if ok]
        if not lows:
            return out
        data = np.frombuffer(b"\n".join([*lows, b""]), np.uint8)
        kinds, new = find_pieces(data)
        kept = kinds != BLANK
        (first,) = np.nonzero(new & kept)
        solid = np.cumsum(kept)  # bytes up to here without blanks
        offsets = np.append(solid[first] - 1, solid[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]).dictionary_encode()
        if len(self.known) > self.most:
            self.forget()
        get, own = self.known.get, self._number
        numbers = np.fromiter((n if (n := get(p)) is not None else own(p) for p in pieces.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(pieces.dictionary))
        number = numbers[pieces.indices.to_numpy()]
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.uint32)
        sizes = start[number + 1] - start[number]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start[number] - (ends - sizes), sizes) + np.arange(total)]
        # Pieces of text k stand before the blank that ends it.
        cuts = np.searchsorted(first, np.cumsum([len(t) + 1 for t in lows]))
        each = np.split(ids, np.append(0, ends)[cuts[:-1]])
        found = iter(each)
        return [next(found) if x is None else x for x in out]


def byte_spelling() -> dict[int, str]:
    """By byte: its character in byte-level vocabularies. Printable bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(others)}}


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids need more than {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, weights = [], leaf
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((leaf, pairs))
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(leaf))
        weights = merged[rank]
    take, used = 2 * len(leaf) - 2, np.zeros(len(leaf) + 1, np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        used[0] += 1
        used[n] -= 1
        take = 2 * (take - n)
    used[0] += 1
    used[take] -= 1
    lengths[order] = np.cumsum(used)[:-1]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.searchsorted(lengths[order], 1) :]:
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int) -> tuple[bytes, bytes]:
    """The bit stream (most significant bit first) and the bit offset of every ``stride``-th id."""
    if not len(ids):
        return b"", b""
    size = lengths[ids].astype(np.int64)
    start = np.cumsum(size) - size
    word = start >> 5
    shifted = codes[ids].astype(np.uint64) << (64 - size - (start & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.bitwise_or.reduceat(shifted, first)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] = sums >> np.uint64(32)
    out[word[first] + 1] |= sums & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes(), start[::stride].astype("<u4").tobytes()


def decode_table(lengths: np.ndarray, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """By the next ``limit`` bits: the id and its length."""
    ids, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used].astype(np.uint64) << (limit - lengths[used]).astype(np.uint64))]
    reach = 1 << (limit - lengths[used].astype(np.int64))
    filled = int(reach.sum())
    ids[:filled], sizes[:filled] = np.repeat(used, reach), np.repeat(lengths[used], reach)
    return ids, sizes


def decode_block(stream: bytes, offsets: bytes, n: int, table: tuple[np.ndarray, np.ndarray], limit: int, stride: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(stream + b"\0" * 8, ">u4").astype(np.uint64)
    at = np.frombuffer(offsets, "<u4").astype(np.int64)
    out, (ids, sizes) = np.zeros((stride, len(at)), np.uint32), table
    drop = np.uint64(64 - limit)
    for step in range(min(stride, n)):
        live = len(at) if step < (n - 1) % stride + 1 else len(at) - 1
        pos = at[:live]
        i = pos >> 5
        bits = (((words[i] << np.uint64(32)) | words[i + 1]) << (pos & 31).astype(np.uint64)) >> drop
        out[step, :live] = ids[bits]
        at[:live] += sizes[bits]
    return out.T.reshape(-1)[:n]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, parts: int, group_bytes: int = 1 << 19) -> DataFrame:
    """(part, base, doc_ids, sizes, ids): groups of consecutive documents, parts being ascending ranges of doc_id.

    base is the number of ids before the group within its part.
    """
    rows = docs.select(integer_id(docs).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").withColumn("part", F.spark_partition_id())
    end = np.array([end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = WordTokenizer(tokenizer_path)
        tokenizer, base = _TOKENIZERS[tokenizer_path], 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                read = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, read + group_bytes, "right")))
                part = batch.slice(at, to - at)
                got = tokenizer.encode(part.column("text").cast(pa.binary()).to_pylist())
                counts = [len(x) + 1 for x in got]
                ids = np.concatenate([y for x in got for y in (x, end)]).astype(_width(end_id, tokenizer))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("part").slice(0, 1),
                        pa.array([base], pa.int64()),
                        pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([counts], pa.list_(pa.int64())),
                        pa.array([ids.tobytes()], pa.binary()),
                    ],
                    ["part", "base", "doc_ids", "sizes", "ids"],
                )
                at, base = to, base + sum(counts)


    return ranged.select("part", "doc_id", "text").mapInArrow(encode, "part int, base long, doc_ids array<long>, sizes array<long>, ids binary")


def _width(end_id: int, tokenizer: WordTokenizer) -> str:
    return "<u2" if max(end_id + 1, tokenizer.library.get_vocab_size()) <= 1 << 16 else "<u4"


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, limit: int = 18, stride: int = 128) -> str:
    """Tokenise, code and write all documents as a store at ``path``, which is returned."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size())
    kind = "<u2" if size <= 1 << 16 else "<u4"
    parts = shuffle_width(docs, 2)
    interim = materialise(tokenise(docs, tokenizer_path, end_id, parts), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(ids, kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)  # bounded by the vocabulary
    for r in interim.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    limit = max(limit, int(np.count_nonzero(counts) - 1).bit_length())
    lengths = code_lengths(counts, limit)
    book = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                stream, offsets = encode_block(np.frombuffer(ids, kind), book.value[1], book.value[0], stride)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("part", "base", "doc_ids", "sizes")), pa.array([offsets], pa.binary()), pa.array([stream], pa.binary())],
                    ["part", "base", "doc_ids", "sizes", "offsets", "stream"],
                )

    blocks = interim.mapInArrow(code, "part int, base long, doc_ids array<long>, sizes array<long>, offsets binary, stream binary")
    # Range n is the n-th task and so the n-th file.
    blocks.repartitionById(parts, "part").sortWithinPartitions("part", "base").write.option("compression", "none").parquet(f"{path}/blocks")
    n_block = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    each = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(
        F.sum(n_block).alias("n_ids"), F.sum(F.size("sizes")).alias("n_docs"), F.min(F.array_min("doc_ids")).alias("least"), F.max(F.array_max("doc_ids")).alias("largest")
    )
    ranges, start = [], 0
    for r in each.orderBy("part").collect():  # one row for each range
        ranges.append((r.part, start, r.n_ids, r.n_docs, r.least, r.largest))
        start += r.n_ids
    used = np.flatnonzero(lengths)
    tables = {
        "codebook": ([(int(i), int(lengths[i])) for i in used], "id int, length int"),
        "ranges": (ranges, "part int, start long, n_ids long, n_docs long, least_doc_id long, largest_doc_id long"),
        "layout": ([(limit, stride, size)], "limit int, stride int, n_codes int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")
    discard(interim)
    return path


def read_token_store(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the written files."""
    layout = spark.read.parquet(f"{path}/layout").first()
    limit, stride, lengths = layout.limit, layout.stride, np.zeros(layout.n_codes, np.uint8)
    for r in spark.read.parquet(f"{path}/codebook").collect():  # bounded by the vocabulary
        lengths[r.id] = r.length
    before = {r.part: r.start for r in spark.read.parquet(f"{path}/ranges").collect()}  # one number for each range
    sent, ready = spark.sparkContext.broadcast((lengths, before)), {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                if "table" not in ready:
                    ready["table"] = decode_table(lengths, canonical_codes(lengths), limit)
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                sizes = np.array(row["sizes"], np.int64)
                ids = decode_block(row["stream"], row["offsets"], int(sizes.sum()), ready["table"], limit, stride)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                each = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                base = before[row["part"]] + row["base"]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(base + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ] + ([pa.array([np.frombuffer(x, "<u4").tolist() for x in each], pa.list_(pa.int64()))] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return spark.read.parquet(f"{path}/blocks").mapInArrow(decode, schema)
