"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches, with offsets in characters.

Byte-level tokens are runs of the text's UTF-8 bytes, so the table of each token's bytes gives all offsets at once: token ends
are running sums of token lengths, and a count of leading bytes maps bytes to characters. A token that begins or ends inside a character is given the whole character,
as the library does. Decoding gathers the tokens' bytes through the reversed byte table; a character that is split over tokens comes back when
its bytes are together, and bytes that never make a character become U+FFFD.

A pre-token never crosses the begin of a white-space run, so a text is cut there; a piece that came before has its ids already, and the new ones of
a batch go to the library as one text. What is remembered is bounded (of more than REMEMBERED pieces the older half goes) and only saves work: pieces are told apart by a 64-bit hash, and
as each row's tokens are turned back into bytes and compared with the text, a row in which two pieces had one hash is noticed and encoded anew as a whole.

The vocabulary file is read by the driver alone (its path is a parameter) and travels to the workers with the code.

Defined results: a null text has null arrays and 0 tokens; an empty text has empty arrays; special tokens' strings in a text are ordinary text; a null doc_id
stays; repeated rows are encoded each; an empty table gives an empty result; ids without a token decode to nothing.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _shared as S

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED = 500_000
SCHEMA = "doc_id long, n_tokens int, ids array<int>, starts array<int>, ends array<int>, round_trip boolean"


def byte_of() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the other bytes for U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)  # ASCII bytes that are surely no white space
_PLAIN[0x21:0x7F] = True
_WIDE = np.zeros(256, bool)  # first bytes of the characters beyond ASCII among which no white space is
_WIDE[[0xC3, *range(0xC4, 0xE1), *range(0xE4, 0xF5)]] = True


def closed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each of these places (none of them 0) is surely no white space of any kind."""
    a, b, c = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    two, three = b >= 0xC0, (b & 0xC0) == 0x80
    return _PLAIN[a] | ((a & 0xC0) == 0x80) & (two & _WIDE[b] | three & ((c >= 0xC0) & _WIDE[c] | ((c & 0xC0) == 0x80)))


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Begins of the pieces: rows, and ASCII white space after a character that is none."""
    at = np.flatnonzero(_SPACE[data[1:]] & ~_SPACE[data[:-1]]) + 1
    here = np.zeros(len(data), bool)
    here[at[closed(data, at)]] = True
    here[starts[:-1][np.diff(starts) > 0]] = True
    return np.flatnonzero(here)


class Codec:
    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        added = {t["id"]: t["content"].encode() for t in json.loads(spec).get("added_tokens", [])}
        table, size = byte_of(), self.tokenizer.get_vocab_size(with_added_tokens=True)
        pieces = [b""] * (max([size - 1, *self.tokenizer.get_vocab(with_added_tokens=True).values()]) + 1)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            pieces[k] = added[k] if k in added else bytes(table[c] for c in token)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)
        self.forget()

    def forget(self, half: bool = False) -> None:
        """Forget all pieces, or the older half of them."""
        if half:
            cut = int(np.median(self.known_at))
            keep = self.known_at >= cut
            self.known, self.known_at, self.known_size = self.known[keep], self.known_at[keep] - cut, self.known_size[keep]
            self.known_ids = self.known_ids[cut:]
            return
        self.known, self.known_at, self.known_size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows one after another, and where each row's ids begin (one more entry at the end)."""
        ids, edges = self._encode(data, starts)
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        wrong = np.diff(ends[edges]) != np.diff(starts)
        if not wrong.any():
            unlike = np.concatenate([[0], np.cumsum(self.bytes(ids) != data)])
            wrong = unlike[starts[1:]] != unlike[starts[:-1]]
        if not wrong.any():
            return ids, edges
        rows = np.split(ids, edges[1:-1])  # two pieces of one hash
        wrong = wrong if (np.diff(ends[edges]) == np.diff(starts)).all() else np.ones(len(rows), bool)
        for k in np.flatnonzero(wrong):
            rows[k] = self.ids([data[starts[k] : starts[k + 1]].tobytes().decode()])[0]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def _encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        begin = cuts(data, starts)
        end = np.append(begin[1:], len(data))
        h, one, which = np.unique(S.word_hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget(half=True)
        there = np.zeros(len(h), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            there = self.known[at] == h
        if not there.all():
            self.learn(data, h[~there], begin[one[~there]], end[one[~there]])
        at = np.searchsorted(self.known, h)[which]
        size, first = self.known_size[at], self.known_at[at]
        ends = np.cumsum(size)
        ids = self.known_ids[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(begin, starts)]

    def learn(self, data: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode new pieces. Those that begin with white space and end without go to the library side by side, the others one by one."""
        joined = _SPACE[data[begin]] & closed(data, end)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        b, e, n = begin[order], end[order], int(joined.sum())
        size = e - b
        ends = np.cumsum(size)
        text = data[np.repeat(b - (ends - size), size) + np.arange(int(ends[-1]))]
        found = [np.zeros(0, np.int32)]
        if n:
            found += self.ids([text[: ends[n - 1]].tobytes().decode()])
        counts = np.diff(np.searchsorted(np.cumsum(self.size[found[-1]]), ends[:n], side="left") + 1, prepend=0) if n else np.zeros(0, np.int64)
        alone = self.ids([text[x - y : x].tobytes().decode() for x, y in zip(ends[n:].tolist(), size[n:].tolist(), strict=True)]) if n < len(order) else []
        counts = np.concatenate([counts, np.array([len(a) for a in alone], np.int64)]).astype(np.int64)
        first = len(self.known_ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.known_ids = np.concatenate([self.known_ids, *found, *alone])
        known = np.concatenate([self.known, h[order]])
        sort = np.argsort(known, kind="stable")
        self.known, self.known_at, self.known_size = known[sort], np.concatenate([self.known_at, first])[sort], np.concatenate([self.known_size, counts])[sort]

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after another."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.first[ids] - (ends - size), size) + np.arange(int(size.sum()))]

    def texts(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The text of each row; edges: where each row's ids begin (one more entry at the end)."""
        data = self.bytes(ids)
        size = np.where((ids >= 0) & (ids < len(self.size)), self.size[np.clip(ids, 0, len(self.size) - 1)], 0)
        at = np.concatenate([[0], np.cumsum(size)])[edges]
        try:  # rows that end inside a character make no whole text even where all bytes together do
            data.tobytes().decode()
            if not len(data) or not ((data[np.minimum(at[:-1], len(data) - 1)] & 0xC0 == 0x80) & (at[:-1] < len(data))).any():
                return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
        except UnicodeDecodeError:
            pass
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes(ids).tobytes().decode("utf-8", "replace")

    def pieces(self, ids: np.ndarray) -> list[str]:
        """Text token by token: a split character comes with the token that completes it; what is never completed, with the last."""
        step, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        for k, i in enumerate(ids):
            out.append(step.decode(self.bytes(np.array([i])).tobytes(), final=k == len(ids) - 1))
        return out

    def offsets(self, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character begin and end of each token; data, starts: the rows' bytes; edges: where each row's tokens begin."""
        ends = np.cumsum(self.size[ids])
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        if ends[-1] != len(data):
            raise ValueError("the vocabulary doesn't give back every byte of the text; this isn't a plain byte-level BPE")
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        base = np.concatenate([char, [char[-1] + 1]])[np.minimum(starts[:-1], len(data))]
        base = np.repeat(base, np.diff(edges))
        return (char[ends - self.size[ids]] - base).astype(np.int32), (char[ends - 1] + 1 - base).astype(np.int32)


_CODECS: dict[int, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = hash(spec)
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def _encoder(spec: str, back: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec)
        for b in S.slices(batches, "text", 500_000):
            text = b.column(1)
            data, starts = S.bytes_of(text)
            ids, edges = own.encode(data, starts)
            begin, end = own.offsets(ids, data, starts, edges)
            missing = pa.compute.is_null(text)
            decoded = pa.compute.if_else(missing, pa.scalar(None, pa.string()), own.texts(ids, edges))
            same = pa.compute.fill_null(pa.compute.equal(decoded, text.cast(pa.string())), True)
            at = pa.array(edges.astype(np.int32), mask=np.append(missing.to_numpy(zero_copy_only=False), False))
            columns = [b.column(0), pa.array(np.diff(edges).astype(np.int32)), *(pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids, begin, end)), same]
            yield pa.RecordBatch.from_arrays([*columns, decoded] if back else columns, names=["doc_id", "n_tokens", "ids", "starts", "ends", "round_trip", *(["decoded"] if back else [])])

    return encode


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, back: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids, starts and ends (characters), round_trip (the ids decode to the text), and with `back` also that decoded text."""
    S.ship(docs.sparkSession)
    skinny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return skinny.mapInArrow(_encoder(Path(vocabulary).read_text(), back), SCHEMA + ", decoded string" * back)


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text, null entries nothing."""
    S.ship(tokens.sparkSession)
    spec = Path(vocabulary).read_text()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                lists = part.column(1)
                ids = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), own.texts(ids, edges))], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(S.table(spark, sf_dir, "documents"), back=True)
