"""Byte-level BPE encoding and decoding over Arrow batches.

Encoding runs the tokenizers library's byte-level model over pieces of text. A long text is cut into pieces only where the split
pattern always begins a new match: before a space that stands between two characters which aren't white space; so the ids are
those of the whole text. Spans of tokens are given in characters (`encode`) and in bytes (`byte_spans`), the byte lengths coming
from the table of tokens, so that a token which ends inside a character still has exact bytes. Decoding turns each id into its token's
bytes by reversing the byte-to-character table, and joins the bytes before it reads UTF-8: characters split over tokens come whole.

Special strings in a text are ordinary text. Defined cases: null and empty text: no ids, and decoded to the empty text. Repeated
rows get equal answers. An id outside the vocabulary raises. Empty table: empty result. `encoded` carries all columns of its
input but `ids` and `n_tokens`, which it replaces.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plus, small_batches, steps

IDS = T.ArrayType(T.IntegerType())
PIECE = 1 << 16
GROUP = 1 << 18
#: A cut is safe before the space.
CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


def pieces(text: str, size: int = PIECE) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


class Codec:
    """One worker's encoder and decoder. `path` is a tokenizer file with a byte-level BPE model."""

    _held: dict[str, Codec] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        table = byte_characters()
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in table for c in token):
                self.tokens[i] = bytes(table[c] for c in token)
        self.numbers = list(map(str, range(len(self.tokens))))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each whole text; texts go to the library in groups of bounded size."""
        out: list[list[int]] = [[] for _ in texts]
        group, owner, held = [], [], 0

        def run():
            for i, e in zip(owner, self.model.encode_batch_fast(group, add_special_tokens=False), strict=True):
                out[i] += e.ids
            group.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for piece in pieces(text) if text else ():
                group.append(piece)
                owner.append(i)
                held += len(piece)
                if held >= GROUP:
                    run()
                    held = 0
        run()
        return out

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Character span of each token of a text; tokens that share a character share its span."""
        out, at = [], 0
        for piece in pieces(text) if text else ():
            out += [(a + at, b + at) for a, b in self.model.encode(piece, add_special_tokens=False).offsets]
            at += len(piece)
        return out

    def byte_spans(self, ids: list[int]) -> list[tuple[int, int]]:
        ends = np.cumsum(self.lengths[np.asarray(ids, np.int64)]) if ids else np.zeros(0, np.int64)
        return [(int(e - n), int(e)) for e, n in zip(ends, self.lengths[np.asarray(ids, np.int64)] if ids else (), strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids and n_tokens."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("ids", "n_tokens")])

    def run(batches):
        codec = Codec.at(path)
        for batch in (part for whole in batches for part in steps(whole)):
            ids = codec.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64())], [*batch.schema.names, "ids", "n_tokens"])

    return docs.mapInArrow(run, plus(docs.schema, ids=IDS, n_tokens="long"))


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (with a column ids) with decoded, the bytes."""
    tokens = tokens.select(*[c for c in tokens.columns if c != "decoded"])

    def run(batches):
        codec = Codec.at(path)
        for batch in batches:
            out = [codec.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, plus(tokens.schema, decoded="binary"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, so ids never leave the worker."""
    small_batches(docs.sparkSession)

    def run(batches):
        codec = Codec.at(path)
        for batch in (part for whole in batches for part in steps(whole)):
            rows = []
            for ids in codec.encode(batch.column("text").to_pylist()):
                rows.append((len(ids), hashlib.sha256(" ".join(map(codec.numbers.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids, n_tokens and decodes, which says whether the ids decode to the text."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("ids", "n_tokens", "decodes")])

    def run(batches):
        codec = Codec.at(path)
        for batch in (part for whole in batches for part in steps(whole)):
            texts = batch.column("text").to_pylist()
            ids = codec.encode(texts)
            same = [codec.decode(x) == (t or "").encode() for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(same, pa.bool_())], [*batch.schema.names, "ids", "n_tokens", "decodes"])

    return docs.mapInArrow(run, plus(docs.schema, ids=IDS, n_tokens="long", decodes="boolean"))
