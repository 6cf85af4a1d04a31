"""Encoding with a byte-level BPE vocabulary (problem 7): pre-tokenisation without regular expressions.

The splitting rule of the vocabulary (contractions; an optional blank before letters, digits or other
signs; white space up to the last one before a text) is a small automaton. All code points of a batch
become symbols of that automaton by one table look-up; each position then holds a transition function
(state -> state), and these are composed pairwise by doubling, which is an associative scan. The
automaton is definite (after a few symbols every start leads to the same state), so the scan stops
when all functions have become constant. Token starts follow from neighbouring states and symbols.

The slices go through a cache of merged pieces; only new ones are merged, by lowest rank first.

Defined results: null text gives null, empty text an empty list; strings that look like special
tokens are ordinary text; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 400_000  # pieces kept; the cache is emptied beyond that, which costs time only
BATCH_CHARS = 1 << 20

# Symbols: what the automaton sees of a code point.
_S, _T, _M, _D, _R, _V, _L, _E, _LETTER, _NUMBER, _QUOTE, _OTHER, _BLANK, _SPACE, _BREAK = range(15)
# States: what it knows after a code point. HALF_RV and HALF_L are contractions that still need a letter.
FRESH, AFTER_BLANK, LETTERS, NUMBERS, OTHERS, APOSTROPHE, HALF_RV, HALF_L, CONTRACTED = range(9)


def _transitions() -> np.ndarray:
    table = np.empty((15, 9), np.uint8)
    for symbol in range(15):
        for state in range(9):
            if symbol == _BREAK or symbol == _SPACE:
                after = FRESH
            elif symbol == _BLANK:
                after = AFTER_BLANK
            elif symbol == _NUMBER:
                after = NUMBERS
            elif symbol == _OTHER:
                after = OTHERS
            elif symbol == _QUOTE:
                after = OTHERS if state in (AFTER_BLANK, OTHERS, APOSTROPHE) else APOSTROPHE
            elif state == APOSTROPHE and symbol in (_S, _T, _M, _D):
                after = CONTRACTED
            elif state == APOSTROPHE and symbol in (_R, _V):
                after = HALF_RV
            elif state == APOSTROPHE and symbol == _L:
                after = HALF_L
            elif (state == HALF_RV and symbol == _E) or (state == HALF_L and symbol == _L):
                after = CONTRACTED
            else:
                after = LETTERS
            table[symbol, state] = after
    return table


TRANSITIONS = _transitions()


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """The automaton's symbol of every code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    # White space by the Unicode property, not by str.isspace, which also counts the separators 1C to 1F.
    for i in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[i] = _SPACE
    table[0x20] = _BLANK
    for char, symbol in (("s", _S), ("t", _T), ("m", _M), ("d", _D), ("r", _R), ("v", _V), ("l", _L), ("e", _E), ("'", _QUOTE)):
        table[ord(char)] = symbol
    return table


def scan_states(symbols: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """The state after every symbol: a scan that composes transition functions by doubling.

    Blocks bound the memory of very long texts; the last state of a block starts the next one.
    """
    states, state = np.empty(len(symbols), np.uint8), FRESH
    for at in range(0, len(symbols), block):
        functions = TRANSITIONS[symbols[at : at + block]]
        reach = 1
        while reach < len(functions) and (functions != functions[:, :1]).any():
            functions[reach:] = np.take_along_axis(functions[reach:], functions[:-reach].copy(), axis=1)
            reach *= 2
        states[at : at + block] = functions[:, state]
        state = states[min(at + block, len(symbols)) - 1]
    return states


def token_starts(symbols: np.ndarray) -> np.ndarray:
    """Marks the first code point of each piece. Texts are parted by the symbol _BREAK."""
    n = len(symbols)
    state = scan_states(symbols)
    before = np.concatenate([[FRESH], state[:-1]]).astype(np.uint8)
    sym_before = np.concatenate([[_BREAK], symbols[:-1]]).astype(np.uint8)
    sym_after = np.concatenate([symbols[1:], [_BREAK]]).astype(np.uint8)
    state_after = np.concatenate([state[1:], [FRESH]]).astype(np.uint8)
    is_space = (symbols == _BLANK) | (symbols == _SPACE)
    space_before = (sym_before == _BLANK) | (sym_before == _SPACE)
    space_after = (sym_after == _BLANK) | (sym_after == _SPACE)
    letter = symbols <= _LETTER
    starts = np.zeros(n, bool)
    starts |= is_space & (~space_before | (~space_after & (sym_after != _BREAK)))
    fresh = before == FRESH
    # A contraction that will be complete at this or the next code point takes the letter after its apostrophe.
    taken = letter & (before == APOSTROPHE) & ((state == CONTRACTED) | (((state == HALF_RV) | (state == HALF_L)) & (state_after == CONTRACTED)))
    inside = (before == LETTERS) | (before == HALF_RV) | (before == HALF_L) | (before == AFTER_BLANK)
    starts |= letter & ~inside & ~taken
    starts |= (symbols == _NUMBER) & ~((before == NUMBERS) | (before == AFTER_BLANK))
    signs = (symbols == _OTHER) | (symbols == _QUOTE)
    starts |= signs & ~((before == OTHERS) | (before == APOSTROPHE) | (before == AFTER_BLANK))
    starts |= fresh & ~is_space
    starts[symbols == _BREAK] = False
    return starts


def piece_bounds(texts: list[str]) -> list[np.ndarray]:
    """For each text the offsets (in code points) of its pieces and, last, its length."""
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    symbols = symbol_table()[points]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    symbols[begins[1:] - 1] = _BREAK
    at = np.flatnonzero(token_starts(symbols))
    cut = np.searchsorted(at, np.concatenate([begins, [len(points) + 1]]))
    return [np.concatenate([at[cut[i] : cut[i + 1]] - begins[i], [lengths[i]]]) for i in range(len(texts))]


class Encoder:
    """Ids of texts under a vocabulary file of lines ``base64 rank``."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pieces: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Joins the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := ranks.get(joined + parts[k])) is not None:
                    heapq.heappush(queue, (r, i, joined + parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + joined)) is not None:
                heapq.heappush(queue, (r, h, parts[h] + joined))
        return [ranks[p] for p in parts if p is not None]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        known, out = self.pieces, []
        for text, bounds in zip(texts, piece_bounds(texts)):
            ids: list[int] = []
            ends = bounds.tolist()
            a = 0
            for b in ends[1:] if ends[0] == 0 else ends:
                piece = text[a:b]
                a = b
                got = known.get(piece)
                if got is None:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    got = known[piece] = self.merge(piece.encode())
                ids += got
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "bytes_of"):
            self.bytes_of = {v: k for k, v in self.ranks.items()}
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def widths(self) -> np.ndarray:
        """Bytes of each token."""
        if not hasattr(self, "bytes_by_id"):
            self.bytes_by_id = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for token, i in self.ranks.items():
                self.bytes_by_id[i] = len(token)
        return self.bytes_by_id

    def begins(self, ids: list[int]) -> np.ndarray:
        """The first byte of each token in the text's UTF-8 form: the slices keep their order and lose nothing, so offsets follow from the ids."""
        sizes = self.widths()[ids] if ids else np.zeros(0, np.int64)
        return np.cumsum(sizes) - sizes

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Begin and end of each token in the text's UTF-8 bytes."""
        ids = self.encode_batch([text])[0]
        begins = self.begins(ids)
        return list(zip(begins.tolist(), (begins + self.widths()[ids]).tolist())) if ids else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker, so that its cache serves all tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(texts: list[str | None], path: str) -> Iterator[list[int] | None]:
    """Ids of each text, worked on in runs of about BATCH_CHARS code points."""
    enc, run, size = encoder(path), [], 0
    for text in texts:
        run.append(text)
        size += len(text or "") + 1
        if size >= BATCH_CHARS:
            yield from _encode_run(enc, run)
            run, size = [], 0
    yield from _encode_run(enc, run)


def _encode_run(enc: Encoder, run: list[str | None]) -> Iterator[list[int] | None]:
    ids = iter(enc.encode_batch([t for t in run if t]))
    for text in run:
        yield None if text is None else next(ids) if text else []


def _ids(path: str, with_offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(encode_texts(batch.column(1).to_pylist(), path))
            columns = {"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}
            if with_offsets:
                columns["begin_bytes"] = pa.array([None if x is None else encoder(path).begins(x) for x in ids], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _counts(path: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x or ()) for x in encode_texts(batch.column(width - 1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def token_ids(documents: DataFrame, path: str = VOCABULARY, with_offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` of every document, and ``begin_bytes`` (the first byte of each token in the UTF-8 text) if asked for."""
    more = ", begin_bytes array<bigint>" if with_offsets else ""
    return documents.select("doc_id", "text").mapInArrow(_ids(path, with_offsets), f"doc_id bigint, ids array<int>{more}")


def token_counts(documents: DataFrame, keys: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keys`` of every document and ``n_tokens``, the number of its tokens (null text: 0)."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_tokens bigint"
    return documents.select(*keys, "text").mapInArrow(_counts(path, len(keys) + 1), schema)
