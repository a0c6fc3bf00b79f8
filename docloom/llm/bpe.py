"""Byte-level BPE through a sentencepiece model written from the vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pre-tokens of at most so many characters are remembered, and so many of them.
CACHED_CHARS, CACHED_TOKENS = 48, 1 << 18
#: Pre-tokens that are held at once of one text.
RUN = 1 << 16
#: Pre-tokens in one call of sentencepiece.
TOGETHER = 256


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank from lines of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def byte_letters() -> np.ndarray:
    """The UTF-8 form of one letter for each byte: letters from U+0100 on, so that none is
    white space, a control character or a sign that sentencepiece gives a meaning."""
    return np.array([list(chr(0x100 + b).encode()) for b in range(256)], dtype=np.uint8)


#: UTF-8 never has this byte; between pre-tokens it stands for a letter outside the vocabulary.
BORDER = b"\xff"
_LETTERS = byte_letters()
_LETTERS_AND_BORDER = _LETTERS.copy()
_LETTERS_AND_BORDER[BORDER[0]] = list(chr(0x200).encode())


def mapped(data: bytes, letters: np.ndarray = _LETTERS) -> str:
    return letters[np.frombuffer(data, dtype=np.uint8)].tobytes().decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE ``ModelProto``: piece i is token i in mapped letters with score
    -i, so that merges come in rank order; the piece after them is the unknown one. The
    normaliser does nothing and adds no prefix."""
    normal, unknown, bpe = 1, 2, 2
    parts = [
        _message(1, _message(1, mapped(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, normal))
        for rank, token in enumerate(tokens)
    ]
    parts.append(_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown)))
    trainer = _number(3, bpe) + _number(40, len(tokens))
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no begin, end, padding: -1
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(parts) + _message(2, trainer) + _message(3, normalizer)


class Codec:
    """Encodes and decodes whole texts; remembers short frequent pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.split = regex.compile(pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.known: dict[str, bytes] = {}

    def _encode(self, missing: list[str]) -> list[bytes]:
        """Each pre-token's ids. Some hundred go to sentencepiece at once, with borders
        that no merge can cross between them."""
        out = []
        for start in range(0, len(missing), TOGETHER):
            some = [x.encode("utf-8", "surrogatepass") for x in missing[start : start + TOGETHER]]
            ids = self.pieces.encode(mapped(BORDER.join(some), _LETTERS_AND_BORDER), out_type=int)
            ids = np.asarray(ids, dtype="<u4")
            borders = np.flatnonzero(ids == len(self.tokens)).tolist()
            out += [ids[a:b].tobytes() for a, b in zip([0, *(x + 1 for x in borders)], [*borders, len(ids)])]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        found = (m.group() for m in self.split.finditer(text))
        runs = iter(lambda: list(islice(found, RUN)), []) if len(text) > RUN else [self.split.findall(text)]
        for run in runs:
            own = self.known
            if missing := [x for x in dict.fromkeys(run) if x not in own]:
                new = dict(zip(missing, self._encode(missing)))
                if len(own) + len(new) > CACHED_TOKENS:
                    own.clear()
                    own |= {x: y for x, y in zip(run, self._lookup(run, new)) if len(x) <= CACHED_CHARS}
                own |= {x: y for x, y in new.items() if len(x) <= CACHED_CHARS}
                if any(len(x) > CACHED_CHARS for x in missing):
                    own = own | new
            out.append(b"".join(map(own.__getitem__, run)))
        return b"".join(out)

    def _lookup(self, run: list[str], new: dict[str, bytes]) -> Iterator[bytes]:
        again = [x for x in dict.fromkeys(run) if x not in new]
        both = new | dict(zip(again, self._encode(again)))
        return map(both.__getitem__, run)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(docs: DataFrame, tokens_path: str, pattern: str, text: str = "text", key: str = "doc_id",
           with_ids: bool = True) -> DataFrame:
    """Token ids and their decoding for every document: ``key``, ``n_tokens``, ``ids``
    (array of ids, if asked for), ``ids_sha256`` and ``decoded_sha256``.

    Texts are encoded whole, one pre-token at a time and without special tokens. A null
    text is an empty one: no ids, digests of nothing. Repeated rows and null keys stay as
    they are; other columns are not carried. Rows stay where they are read: no shuffle.
    The vocabulary (some hundred kB, whatever the input) is sent to the executors.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(tokens_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokens.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            step = 512
            for start in range(0, batch.num_rows, step):
                ids = [codec.encode(x.as_py() or "") for x in texts.slice(start, step)]
                columns = {
                    "key": keys.slice(start, step),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                }
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
