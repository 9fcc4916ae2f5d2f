"""Byte-level BPE encoding and decoding by a distinct-word table."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from kinweave.llm.common import give_back, portions

#: Distinct words that a task's table holds before it is started anew: 30 MB or so.
HELD = 150_000
#: The split of byte-level BPE vocabularies of this kind into words.
_words = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
#: The same for texts of characters up to U+024F but a few, where the standard library's classes agree; it is faster.
_latin_words = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""").findall
_beyond_latin = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search
#: Beyond these ranges libraries differ in the version of Unicode, and the tokenizer itself splits.
_beyond_known = re.compile("[^\x00-\u052f\u1e00-\u206f\u20a0-\u20bf\u2100-\u2bff\u3000-\u30ff\u4e00-\u9ffc\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001faff]").search


@functools.lru_cache(2)
def _tokenizer(data: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_str(data)


@functools.lru_cache(2)
def _pieces(data: str) -> tuple[list[bytes], dict[str, int]]:
    """Bytes of each id, and the ids of special texts."""
    t = json.loads(data)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in t["added_tokens"]}
    vocabulary = t["model"]["vocab"]
    out = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
    for piece, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in piece)
    for text, i in special.items():
        out[i] = text.encode()
    return out, special


def _words_of(text: str, data: str) -> list[str]:
    if not _beyond_latin(text):
        return _latin_words(text)
    if not _beyond_known(text):
        return _words(text)
    return [text[a:b] for _, (a, b) in _tokenizer(data).pre_tokenizer.pre_tokenize_str(text)]


def split(text: str, data: str) -> list[str]:
    """The words of a text in order; special texts stand for themselves."""
    _, special = _pieces(data)
    if not any(s in text for s in special):
        return _words_of(text, data)
    parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text)
    return [w for p in parts for w in ([p] if p in special else _words_of(p, data))]


def _ids(words: list[str], data: str) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in _tokenizer(data).encode_batch_fast(words, add_special_tokens=False)]


def encode(docs: DataFrame, tokenizer_path: str, held_words: int = HELD, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ``with_ids`` adds ids (unsigned 32-bit, little-endian) and the decoded text.

    Each task splits its texts into words, keeps a table of the distinct ones, encodes each once as it enters the table
    (anew beyond HELD of them), and joins ids to words by position. No word, text or id is shuffled.
    Decoding joins each id to its piece; the pieces are the vocabulary, which doesn't grow with the data.
    Null texts are empty: no tokens, digests of nothing. Repeated rows are kept; an empty table gives none.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; tasks get the text
        held = spark.sparkContext.broadcast(f.read())
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.binary()), ("decoded", pa.string())] if with_ids else [])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = held.value
        pieces, special = _pieces(data)
        start = {s: array("I", [i]).tobytes() for s, i in special.items()}
        known = dict(start)
        for whole in batches:
            for b in portions(whole, "text"):
                texts = [split(t or "", data) for t in b.column(1).to_pylist()]
                if len(known) > held_words:
                    known = dict(start)
                new = list(set(chain.from_iterable(texts)).difference(known))
                known.update(zip(new, _ids(new, data), strict=True))
                ids = [b"".join(map(known.__getitem__, words)) for words in texts]
                decoded = [b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in ids]
                cols = [b.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.binary()), pa.array(decoded)] if with_ids else [])], schema=schema)
        known = texts = new = ids = decoded = cols = whole = b = None
        give_back()

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, kinds)
