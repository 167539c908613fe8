"""SentencePiece encoding and decoding with a public model file.

An Aho-Corasick automaton over all pieces reports, at every position, the pieces that end there,
longest first along its output links; each relaxes the best score of that position, so that one
pass over a text gives the segmentation of highest total score. Characters in no piece become byte
pieces. A piece holds the word mark only at its start, so no segmentation crosses the place before
a word mark that follows another character: words are segmented apart and their ids are remembered.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose ids a worker remembers before it starts anew, and the bytes of ids in a batch it returns.
REMEMBERED, BATCH_BYTES = 300_000, 8_000_000
#: Below any sum of scores, for characters that no piece covers.
UNKNOWN = -1e12


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: (number, integer or bytes)."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return value, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Pieces:
    """A model: encode and decode."""

    def __init__(self, model: bytes) -> None:
        self.pieces, self.bytes, self.control, self.unk = [], {}, set(), 0
        self.auto, scores = ahocorasick.Automaton(), []
        for number, value in _fields(model):
            if number != 1:
                continue
            f, at = dict(_fields(value)), len(self.pieces)
            piece, score, kind = f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)
            self.pieces.append(piece)
            scores.append(score)
            if kind == 6:  # a byte
                self.bytes[int(piece[1:-1], 16)] = at
            elif kind == 2:
                self.unk = at
            elif kind == 3:
                self.control.add(at)
            elif kind in (1, 4):
                self.auto.add_word(piece, (len(piece), score, at))
        self.auto.make_automaton()
        self.byte_of = {i: v for v, i in self.bytes.items()}
        words = [p for i, p in enumerate(self.pieces) if i not in self.byte_of and i not in self.control]
        alone = "\n" if not any("\n" in p for p in words) else ""
        self.crosses = any(MARK in p.lstrip(MARK) for p in words)
        self.parts = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|{alone}+" if alone else ""))
        self.known: dict[str, bytes] = {}

    def best(self, s: str) -> list[int]:
        """The ids of the segmentation of s with the highest sum of scores; of equal ones, that with the longer last piece."""
        n = len(s)
        score, back = [0.0] + [None] * n, [None] * (n + 1)
        done = 0  # positions up to here are final

        def unknown(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if score[done] is None:
                    score[done], back[done] = score[done - 1] + UNKNOWN, (1, -1)

        for last, (size, gain, piece) in self.auto.iter(s):
            end = last + 1
            if done < last:
                unknown(last)
            total = score[end - size] + gain
            if score[end] is None or total > score[end]:
                score[end], back[end] = total, (size, piece)
        unknown(n)
        out, at = [], n
        while at:
            size, piece = back[at]
            out.extend([piece] if piece >= 0 else [self.bytes.get(b, self.unk) for b in reversed(s[at - 1].encode("utf-8", "surrogatepass"))] if self.bytes else [self.unk])
            at -= size
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; none for an empty one. A word mark goes first and replaces each space."""
        if not text:
            return np.zeros(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        if self.crosses:
            return np.array(self.best(marked), np.int32)
        known, out = self.known, []
        for word in self.parts.findall(marked):
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = np.array(self.best(word), np.int32).tobytes()
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces in turn, byte pieces as UTF-8, word marks as spaces but for the first."""
        pieces = self._decoded
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]

    @property
    def _decoded(self) -> list[bytes]:
        if not hasattr(self, "_out"):
            self._out = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        return self._out


_LOADED: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, built once in a worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encode_texts(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids (array of int), n_ids, n_bytes (byte pieces) and round_trip (decoding gives the text again).

    The model file, of bounded size, is read on the driver and sent to workers. A null or empty text
    has no ids and makes the round trip; a text with the word mark itself doesn't, as it returns as a
    space. Each row is independent; repeated rows repeat.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(model.value)
        is_byte = np.zeros(len(m.pieces), bool)
        is_byte[list(m.byte_of)] = True

        def batch() -> pa.RecordBatch:
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, pa.array(np.diff(sizes).astype(np.int64)), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "n_bytes", "round_trip"])

        keys, ids, same, held = [], [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                x = m.encode(text)
                keys.append(key)
                ids.append(x)
                same.append(m.decode(x) == text)
                held += x.nbytes
                if held > BATCH_BYTES:
                    yield batch()
                    keys, ids, same, held = [], [], [], 0
        if keys:
            yield batch()

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, n_ids long, n_bytes long, round_trip boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
