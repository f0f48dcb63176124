"""Encoding and decoding of a corpus with a public byte-level BPE tokenizer, over Arrow batches.

The vocabulary's file is a parameter and must be readable at that path on every executor. Texts are encoded as whole texts: no special tokens are
added, and their strings in a text are ordinary text. An empty or null text has the empty list.

Byte-level vocabularies write each byte as one printable character. Decoding reverses that table, joins the tokens' bytes
and only then reads UTF-8, as a token may end inside a character; offsets map bytes to characters in the same way.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Characters given to the tokenizer at once, and tokens returned at once; a longer single text makes a batch of its own.
BATCH_CHARS = 2_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once per Python worker, in one thread (Spark's tasks are the parallelism)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the characters from 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of each token id. Added tokens are plain text."""
    with open(path, encoding="utf-8") as src:
        spec = json.load(src)
    table, vocab = byte_alphabet(), dict(spec["model"]["vocab"])
    added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, k in vocab.items():
        out[k] = added[k] if k in added else bytes(table[c] for c in token)
    for k, content in added.items():
        out[k] = content
    return tuple(out)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most BATCH_CHARS characters, or of one text."""
    start, chars = 0, 0
    for k, text in enumerate(texts):
        if k > start and chars + len(text) > BATCH_CHARS:
            yield start, k
            start, chars = k, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def encodings(texts: list[str], path: str) -> Iterator[tuple[int, int, list]]:
    """The library's encodings of each range of texts: first, end, encodings."""
    model = tokenizer(path)
    for a, b in _chunks(texts):
        yield a, b, model.encode_batch_fast(texts[a:b], add_special_tokens=False)


def encode_batches(texts: list[str], path: str) -> Iterator[tuple[int, int, list[list[int]]]]:
    """The ids of each range of texts: first, end, ids."""
    for a, b, found in encodings(texts, path):
        yield a, b, [e.ids for e in found]


def _text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _lists(rows: list[list[int]]) -> pa.Array:
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _with(batch: pa.RecordBatch, keep: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], values], [*keep, name])


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = TOKENIZER, out: str = "ids") -> DataFrame:
    """``keep`` columns (default: all but the text and any of the result's name) and the ids of each text, one row per row of ``docs``. No shuffle."""
    keep = [c for c in docs.columns if c not in (text, out)] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids in encode_batches(_text_column(batch, text), path):
                yield _with(batch.slice(a, b - a), keep, out, _lists(ids))

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.IntegerType(), True))])
    return docs.select(*keep, text).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of each text; the ids never leave the worker."""
    keep = [c for c in docs.columns if c not in (text, out)] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in encodings(_text_column(batch, text), path):
                yield _with(batch.slice(a, b - a), keep, out, pa.array([len(e) for e in found], pa.int64()))

    return docs.select(*keep, text).mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.LongType())]))


def decode_ids(ids: list[int] | np.ndarray | None, path: str = TOKENIZER) -> str:
    """The text of a list of ids. Bytes that are no whole character (a list cut inside one) become U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[k] for k in (() if ids is None else ids)).decode("utf-8", errors="replace")


def decode(encoded: DataFrame, ids: str = "ids", path: str = TOKENIZER, out: str = "text") -> DataFrame:
    """``encoded`` with ``out``, the text of its ids, in place of ``ids``. A null list gives the empty text; ids outside the vocabulary fail."""
    keep = [c for c in encoded.columns if c not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            yield _with(batch, keep, out, pa.array([decode_ids(r.values.to_numpy(zero_copy_only=False) if r.is_valid else None, path) for r in lists], pa.string()))

    return encoded.select(*keep, ids).mapInArrow(run, T.StructType([*[encoded.schema[c] for c in keep], T.StructField(out, T.StringType())]))


def char_spans(text: str, ids: list[int], path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token in ``text``, by the bytes it covers.

    A character split over several tokens belongs to each of them, so neighbouring spans may share one character.
    """
    table = token_bytes(path)
    ends = np.cumsum([len(table[k]) for k in ids], dtype=np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte is part of
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends
    return char_of[starts], char_of[ends - 1] + 1


def spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and, per row, three parallel lists: ids, first and end character (``begins``, ``ends``)."""
    keep = [c for c in docs.columns if c not in (text, "ids", "begins", "ends")] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text_column(batch, text)
            for a, b, ids in encode_batches(texts, path):
                at = [char_spans(t, r, path) for t, r in zip(texts[a:b], ids)]
                part = batch.slice(a, b - a)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, _lists(ids), _lists([x.tolist() for x, _ in at]), _lists([y.tolist() for _, y in at])], [*keep, "ids", "begins", "ends"])

    ints = T.ArrayType(T.IntegerType(), True)
    return docs.select(*keep, text).mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, ints) for n in ("ids", "begins", "ends")]]))
