"""BPE encoding by a distinct-word table, and decoding by an id-to-piece join.

Each task splits its texts into the tokenizer's words, once, in blocks of bounded
size. A block keeps its texts as codes of its distinct words and sends those words,
each once, to their hash ranges; a range encodes each distinct word of the corpus
once and answers every block that asked; the block puts the ids back by position.
Texts are never shuffled, only codes, and one exchange carries codes and words.
Words are what the pre-tokenizer cuts, so the ids of a text are the ids of its words
in order, as the tokenizers library has them.

Decoding joins ids with the table of pieces, whose size is the vocabulary's and
which every task gets: a lookup of whole columns of ids, in numpy. As built-in
functions (a lookup in a broadcast array of pieces) the same join copies that array
for each row; it took 160 CPU seconds a GB more and 900 MB more of an executor.

The tokenizer's JSON is a bounded file that every task gets (some MB). Truncation
and padding are not applied and no special tokens are added; an added token that
occurs in a text is cut out first and becomes its id, as in the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from corpusguard.llm.blocks import as_stream, with_given
from corpusguard.llm.memory import release, releasing
from corpusguard.llm.packed import pack, ranges, unpack
from corpusguard.llm.store import parts, text_bytes
from corpusguard.llm.words import Words, buffers

#: Text of a block, of which one task holds the words; text for each hash range, of
#: which a task holds the distinct words of every block; and most rows of a block.
BLOCK_BYTES, RANGE_BYTES, BLOCK_ROWS = 8 << 20, 32 << 20, 50_000
#: Blocks that a task may make before their numbers would meet the next task's.
BLOCKS_OF_A_TASK = 1 << 32
#: Words that the library encodes in one call.
ENCODE_WORDS = 4096
#: Words or ids that are looked up at a time, and rows that are decoded at a time.
STRETCH, DECODE_ROWS = 1 << 18, 1000
#: Bytes of text whose words are held as Python strings at once.
CHUNK = 1 << 19
#: Fixed value: how byte-level BPE with a pattern cuts words.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this lead byte (code points under U+0540) the pattern's character classes
#: are the same in every Unicode version; other texts are cut by the library.
_OLD_LEAD = 0xD5


@lru_cache(maxsize=4)
def _splitter(tokenizer: str):
    """A function from a text to its words, added tokens included, and whether
    the text may be cut by the pattern."""
    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    spec = json.loads(tokenizer)
    added = spec.get("added_tokens") or []
    if spec.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("tokenizers with a normalizer, or whose added tokens take in their surroundings, are not supported")
    kind = spec.get("pre_tokenizer") or {}
    plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    find = regex.compile(BYTE_LEVEL_PATTERN).findall
    if kind.get("add_prefix_space"):
        raise ValueError("tokenizers that add a prefix space are not supported")
    contents = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
    cut = regex.compile("(" + "|".join(map(regex.escape, contents)) + ")") if contents else None

    @lru_cache(maxsize=1)
    def library():  # tens of megabytes, so made only if a text needs it
        return Tokenizer.from_str(tokenizer).pre_tokenizer

    def by_library(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in library().pre_tokenize_str(text)]

    def split(text: str, old: bool) -> list[str]:
        one = find if plain and old else by_library
        if cut is None or not cut.search(text):
            return one(text)
        return [w for i, part in enumerate(cut.split(text)) if part for w in ([part] if i % 2 else one(part))]

    return split


def _words(texts: pa.Array, tokenizer: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each stretch of a column: its distinct words; the index of each word of
    its texts, in order; and how many words each text has."""
    split = _splitter(tokenizer)
    data, bounds = buffers(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK, side="right")) - 1)
        found: list[str] = []
        counts = []
        for i in range(row, stop):
            raw = data[bounds[i] : bounds[i + 1]]
            here = split(raw.tobytes().decode(), not len(raw) or int(raw.max()) < _OLD_LEAD) if len(raw) else []
            counts.append(len(here))
            found += here
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.array(counts, dtype=np.int64)
        row = stop


def _distinct(arrays: Iterable[pa.Array]) -> pa.DictionaryArray:
    """Words of several arrays, one after the other, by their distinct ones."""
    return pa.chunked_array([pa.array([], pa.large_string()), *arrays]).combine_chunks().dictionary_encode()


def _by_range(distinct: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by range and then by bytes, and the ranges' bounds."""
    data, bounds = buffers(distinct)
    h, at = np.empty(len(distinct), dtype=np.uint64), 0
    while at < len(distinct):  # in stretches, as the hash's working memory grows with its bytes
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
        own = bounds[at : stop + 1] - bounds[at]
        h[at:stop] = Words(data[bounds[at] : bounds[stop]], own[:-1], own[1:], own[:1], own[:1], own[-1:], 0).hashes()
        at = stop
    number = ranges(h, n)
    order = pc.sort_indices(distinct).to_numpy().astype(np.int64)
    order = order[np.argsort(number[order], kind="stable")]
    return order, np.searchsorted(number[order], np.arange(n + 1))


@lru_cache(maxsize=1)
def _coder(tokenizer: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    coder = Tokenizer.from_str(tokenizer)
    coder.no_truncation()
    coder.no_padding()
    return coder


class _Block:
    """Rows of a task, their words as codes, and their distinct words."""

    def __init__(self, tokenizer: str):
        self.tokenizer, self.kept, self.met, self.codes, self.counts = tokenizer, [], [], [], []
        self.size = self.rows = 0

    def add(self, rows: pa.RecordBatch, size: int) -> None:
        """Rows ``(doc_id, text, given)`` with so many bytes of text."""
        for distinct, index, counts in _words(rows.column(1), self.tokenizer):
            self.met.append(distinct)
            self.codes.append(index.astype(np.uint32))
            self.counts.append(counts)
        self.kept.append(rows.select(["doc_id", "given"]))
        self.size, self.rows = self.size + size, self.rows + rows.num_rows

    def messages(self, block: int, n_ranges: int) -> pa.RecordBatch:
        """A row for each range that has words, and one for the block itself."""
        one = _distinct(self.met)
        distinct = one.dictionary
        order, at = _by_range(distinct, n_ranges)
        place = np.empty(len(order), dtype=np.uint32)  # of each distinct word, in range order
        place[order] = np.arange(len(order), dtype=np.uint32)
        to, starts = place[one.indices.to_numpy(zero_copy_only=False)], np.concatenate([[0], np.cumsum([len(d) for d in self.met])]).astype(np.int64)
        codes = np.concatenate([np.zeros(0, np.uint32), *(to[a + c] for a, c in zip(starts[:-1], self.codes, strict=True))])
        rows = pa.Table.from_batches(self.kept).append_column("n", pa.array(np.concatenate([np.zeros(0, np.int64), *self.counts]), pa.int64())).combine_chunks()
        # Answers are for exactly these words; another attempt at a task whose input
        # comes in no fixed order may have others.
        mark = len(distinct), int(xxhash.xxh64_intdigest("\0".join(distinct.take(pa.array(order)).to_pylist()))) & (1 << 62) - 1
        out = [(r, block, as_stream(pa.table({"word": distinct.take(pa.array(order[lo:hi]))})), None, mark[1]) for r, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
        out.append((n_ranges + block, block, as_stream(rows), _compress(pack(codes)), mark[1]))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["to", "block", "data", "codes", "mark"])


def _compress(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + bytes(pa.Codec("zstd", 3).compress(data))


def _decompress(data: bytes) -> bytes:
    return bytes(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little")))


def bpe_encode(docs: DataFrame, tokenizer: str, carry: list[str] | None = None, decode: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, n_tokens, ids, ids_bytes, carried...)``;
    with ``decode`` also ``decoded``, joined from the ids alone as ``bpe_decode`` does.

    ``tokenizer``: the JSON of a tokenizers file. ``ids``: array of int;
    ``ids_bytes``: the same as little-endian unsigned 32-bit integers. A null or
    empty text has no ids. Repeated rows are returned as often as they occur; null
    doc_ids are kept. Columns that ``carry`` doesn't name are ignored. An empty
    table gives no rows.
    """
    carry = carry or []
    _, total = text_bytes(docs, "text")
    n_ranges = parts(total, RANGE_BYTES, 32)
    given = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", given.alias("given"), F.spark_partition_id().alias("task"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, task = _Block(tokenizer), 0, 0
        for batch in batches:
            _, bounds = buffers(batch.column(1))
            row = 0
            while row < batch.num_rows:
                task = batch.column(3)[row].as_py()
                stop = int(np.searchsorted(bounds, bounds[row] + BLOCK_BYTES - block.size, side="right")) - 1
                stop = min(max(row + 1, stop), row + BLOCK_ROWS - block.rows, batch.num_rows)
                block.add(batch.slice(row, stop - row), int(bounds[stop] - bounds[row]))
                row = stop
                if block.size >= BLOCK_BYTES or block.rows >= BLOCK_ROWS or row < batch.num_rows:
                    yield block.messages(task * BLOCKS_OF_A_TASK + number, n_ranges)
                    block, number = _Block(tokenizer), number + 1
                    release()
        if block.rows:
            yield block.messages(task * BLOCKS_OF_A_TASK + number, n_ranges)

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        names, types = ["to", "range", "ids", "mark"], (pa.int64(), pa.int64(), pa.binary(), pa.int64())
        if key[0].as_py() >= n_ranges:  # a block's codes
            return pa.table([pa.array([], t) for t in types], names=names)
        coder = _coder(tokenizer)
        asked = [pa.ipc.open_stream(x.as_buffer()).read_all().column("word").combine_chunks() for x in table.column("data")]
        one = pa.chunked_array([a.dictionary_encode() for a in asked]).unify_dictionaries()
        distinct = one.chunk(0).dictionary
        sizes, parts_of = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(distinct), ENCODE_WORDS):
            found = [e.ids for e in coder.encode_batch_fast(distinct.slice(lo, ENCODE_WORDS).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts_of.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(parts_of)
        first = np.concatenate([[0], np.cumsum(size)])
        narrow = np.uint16 if int(flat.max(initial=0)) < 1 << 16 else np.uint32
        answers = []
        for chunk in one.chunks:
            at = chunk.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            answers.append(as_stream(pa.table({"ids": pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[at])])), pa.array(_gather(flat, first, at, size).astype(narrow)))})))
        return pa.table([pc.add(table.column("block"), n_ranges), table.column("to"), pa.array(answers, pa.binary()), table.column("mark")], names=names)

    pieces = piece_columns(tokenizer) if decode else None

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        _coder.cache_clear()  # a worker that has encoded words does not need it here
        codes = left.filter(pc.is_valid(left.column("codes")))
        if not codes.num_rows:  # words on their way to a range
            return empty
        if codes.num_rows > 1 or any(m != codes.column("mark")[0] for m in right.column("mark")):
            raise ValueError("a task that ran again had its rows in another order; write the table and encode what was written")
        table = pa.ipc.open_stream(codes.column("data")[0].as_buffer()).read_all()
        order = np.argsort(right.column("range").to_numpy())
        lists = [pa.ipc.open_stream(right.column("ids")[int(i)].as_buffer()).read_all().column("ids").combine_chunks() for i in order]
        size = np.concatenate([np.zeros(0, np.int64), *(np.diff(x.offsets.to_numpy()) for x in lists)])
        flat = np.concatenate([np.zeros(0, "<u4"), *(x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in lists)])
        first = np.concatenate([[0], np.cumsum(size)])
        words = unpack(_decompress(codes.column("codes")[0].as_py()), np.uint32)
        ends = np.concatenate([[0], np.cumsum(size[words])])
        ids = np.empty(int(ends[-1]), "<u4")
        for lo in range(0, len(words), STRETCH):
            hi = min(lo + STRETCH, len(words))
            ids[ends[lo] : ends[hi]] = _gather(flat, first, words[lo:hi], size)
        bounds = ends[np.concatenate([[0], np.cumsum(np.asarray(table.column("n")))])]
        buffer = pa.py_buffer(ids)
        as_bytes = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), buffer])
        as_list = pa.LargeListArray.from_arrays(pa.array(bounds), pa.Array.from_buffers(pa.int32(), len(ids), [None, buffer]))
        out = {"doc_id": table.column("doc_id"), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids": as_list.cast(pa.list_(pa.int32())), "ids_bytes": as_bytes.cast(pa.binary())}
        out["decoded"] = join_pieces(ids, bounds, pieces) if decode else pa.nulls(table.num_rows, pa.string())
        return pa.table(out | {"given": table.column("given")})

    sent = rows.mapInArrow(split, "to long, block long, data binary, codes binary, mark long")
    encoded = sent.groupBy("to").applyInArrow(releasing(encode), "to long, range long, ids binary, mark long")
    schema = with_given(f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, ids_bytes binary, decoded string", rows)
    empty = to_arrow_schema(schema).empty_table()
    out = sent.groupBy("to").cogroup(encoded.groupBy("to")).applyInArrow(releasing(assemble), schema)
    return out.select("doc_id", "n_tokens", "ids", "ids_bytes", *(["decoded"] if decode else []), *[F.col("given")[c].alias(c) for c in carry])


def _gather(flat: np.ndarray, first: np.ndarray, which: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[first[i]:first[i] + size[i]]`` for each i in ``which``, joined."""
    n = size[which]
    ends = np.cumsum(n)
    return flat[np.repeat(first[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def piece_bytes(tokenizer: str) -> dict[int, bytes]:
    """The id-to-piece table of a byte-level tokenizer."""
    spec = json.loads(tokenizer)
    # Bytes that print stand for themselves; the others, in order, for U+0100 on.
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printed]
    byte = {chr(b): b for b in printed} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    pieces = {i: bytes(byte[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if all(c in byte for c in piece)}
    return pieces | {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}


def piece_columns(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table by id: all pieces' bytes, where each begins, and its size; ids
    without a piece have size 0, and so has one more row for ids beyond the table."""
    pieces = piece_bytes(tokenizer)
    listed = [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)] + [b""]
    size = np.array([len(p) for p in listed], dtype=np.int64)
    return np.frombuffer(b"".join(listed), np.uint8), np.cumsum(size) - size, size


def join_pieces(ids: np.ndarray, bounds: np.ndarray, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """Texts of the ids ``ids[bounds[i]:bounds[i + 1]]``: their pieces joined, and what
    is no UTF-8 as U+FFFD."""
    data, first, size = pieces
    known = np.minimum(ids, len(size) - 1)
    ends = np.concatenate([[0], np.cumsum(size[known])])
    out = np.empty(int(ends[-1]), np.uint8)
    for lo in range(0, len(known), STRETCH):
        hi = min(lo + STRETCH, len(known))
        out[ends[lo] : ends[hi]] = _gather(data, first, known[lo:hi], size)
    at = ends[bounds]
    texts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(out)])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        raw = out.tobytes()
        texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.large_string())
    return texts.cast(pa.string())


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with a column ``ids`` (array of int) → the same with ``decoded``:
    the pieces of the ids, special tokens included, joined and read as UTF-8, what
    is no UTF-8 as U+FFFD. Ids without a piece, and nulls among them, are passed
    over; no ids or null: ''. A given column ``decoded`` is replaced."""
    pieces = piece_columns(tokenizer)
    kept = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*kept, F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("_ids"))
    schema = StructType([*encoded.select(*kept).schema, StructField("decoded", StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(row, DECODE_ROWS)
                given = part.column(len(kept))
                flat = given.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = given.offsets.to_numpy().astype(np.int64) - given.offsets[0].as_py()
                flat[flat < 0] = np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], join_pieces(flat, bounds, pieces)], [*kept, "decoded"])

    return rows.mapInArrow(decode, schema)
