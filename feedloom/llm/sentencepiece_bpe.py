"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

The encoder is an agenda of adjacent symbol pairs ordered by piece score, ties to the left: the best pair
merges until no adjacent pair forms a piece; symbols that are no piece fall back to their bytes. Texts are
cut where no piece can cross (before a run of blanks), so the agenda works on distinct chunks. Chunks of
one batch go through their agendas in step, in numpy; a long chunk uses a heap. Every chunk an Arrow
batch brings in is also encoded by the sentencepiece library; a difference stops the job.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Symbols of a chunk from which the heap is used in place of the agendas in step.
HEAP_FROM = 48
#: Bytes of encoded chunks a task keeps, then it starts afresh; what one costs beside its letters and ids.
KEPT_BYTES, CHUNK_COST = 64 << 20, 240
#: Characters of text worked on at once.
PIECE_CHARS = 1 << 20


class MergeEncoder:
    """Encoder for one vocabulary file. ``check`` compares every new chunk with the library's ids."""

    def __init__(self, model: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib, n = self.library, self.library.get_piece_size()
        probe = "Aé Ａ\t①  z "
        if lib.normalize(probe) != (BLANK + probe).replace(" ", BLANK):
            raise ValueError("only vocabularies with identity normalisation and a leading blank are handled")
        self.check = check
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.ids: dict[str, int] = {}
        self.score = np.full(n + 1, -np.inf)
        self.bytes: dict[int, int] = {}
        for i in range(n):
            if lib.is_byte(i):
                self.bytes[int(lib.id_to_piece(i)[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[lib.id_to_piece(i)] = i
                self.score[i] = lib.get_score(i)
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece crosses a blank; texts can't be cut into chunks")
        # symbols: piece ids, then characters that are no piece
        self.pieces = n
        self.extra_ids: list[list[int]] = []
        self.symbols = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.by_code = np.full(0x110000, -1, dtype=np.int32)
        self.by_code[list(self.symbols)] = list(self.symbols.values())
        # merges: (left symbol, right symbol) -> piece, as sorted keys for numpy
        left, right, out = [], [], []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                halves = [self.symbol(ord(h)) if len(h) == 1 else self.ids.get(h) for h in (piece[:k], piece[k:])]
                if None not in halves:
                    left.append(halves[0]), right.append(halves[1]), out.append(i)
        key = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        order = np.argsort(key)
        self.key, self.merged = key[order], np.array(out, dtype=np.int32)[order]
        # equal scores share a rank; the last place stands for "no piece"
        self.rank = np.full(n + 1, -1, dtype=np.int32)
        self.rank[:n] = np.unique(self.score[:n], return_inverse=True)[1]
        self.cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def forget(self) -> None:
        self.kept.clear()
        self.kept_bytes = 0

    def symbol(self, code: int) -> int:
        i = self.symbols.get(code)
        if i is None:
            i = self.symbols[code] = self.by_code[code] = self.pieces + len(self.extra_ids)
            raw = chr(code).encode()
            self.extra_ids.append([self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unk])
        return int(i)

    def chunks(self, text: str) -> list[str]:
        """Parts no piece crosses, each without the blank it starts with."""
        if "  " in text or BLANK in text or text[:1] == " " or text[-1:] == " ":
            return [c[1:] for c in self.cut.findall(BLANK + text.replace(" ", BLANK))]
        return text.split(" ") if text else []

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the merged pieces, -1 where two symbols form none."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << 32 | b, -1)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.merged[at], -1)

    def in_step(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Agendas of many short chunks, one merge of each per round: symbols in a row, and their count per chunk."""
        rows = len(chunks)
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=rows)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        flat = self.by_code[codes]
        if (flat < 0).any():
            for code in np.unique(codes[flat < 0]).tolist():
                self.symbol(code)
            flat = self.by_code[codes]
        width = int(lengths.max()) + 1
        # one dead place at either end, so that a neighbour always exists
        symbol = np.full((rows, width + 2), -1, dtype=np.int32)
        symbol[:, 1] = self.by_code[ord(BLANK)]
        inside = np.arange(width + 2) < (lengths + 2)[:, None]
        inside[:, :2] = False
        symbol[inside] = flat
        size = width + 2
        symbol = symbol.ravel()
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), rows) + np.repeat(np.arange(rows, dtype=np.int32) * size, size)
        after.reshape(rows, size)[:, -1] -= 1
        before = after - 2
        before.reshape(rows, size)[:, -1] += 1
        before.reshape(rows, size)[:, 0] += 1
        new = np.full(rows * size, -1, dtype=np.int32)
        there = np.flatnonzero((symbol[:-1] >= 0) & (symbol[1:] >= 0))
        new[there] = self._pair(symbol[there], symbol[there + 1])
        value = self.rank[new].reshape(rows, size)
        live = np.arange(rows)
        while len(live):
            part = value[live] if len(live) < rows else value
            best = part.argmax(axis=1)
            going = part[np.arange(len(live)), best] >= 0
            live, best = live[going], best[going]
            at = live * size + best
            gone = after[at]
            beyond = after[gone]
            symbol[at] = new[at]
            symbol[gone] = -1
            value.ravel()[gone] = -1
            after[at] = beyond
            before[beyond] = at
            new[at] = self._pair(symbol[at], symbol[beyond])
            value.ravel()[at] = self.rank[new[at]]
            front = before[at]
            joined = self._pair(symbol[front], symbol[at])
            new[front] = joined
            value.ravel()[front] = self.rank[joined]
        return symbol[symbol >= 0], (symbol.reshape(rows, size) >= 0).sum(axis=1)

    def by_heap(self, chunk: str) -> list[int]:
        """Agenda of one long chunk."""
        symbols = [self.symbol(ord(c)) for c in BLANK + chunk]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, int, int]] = []
        table = {}

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                a, b = symbols[i], symbols[j]
                if (a, b) not in table:
                    table[a, b] = int(self._pair(np.array([a]), np.array([b]))[0])
                new = table[a, b]
                if new >= 0:
                    heapq.heappush(agenda, (-int(self.rank[new]), i, a, b, new))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b, new = heapq.heappop(agenda)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def _spread(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the ids of their bytes."""
        odd = np.unique(symbols[symbols >= self.pieces])
        if not len(odd):
            return symbols, counts
        widths = np.ones(len(symbols), dtype=np.int64)
        for s in odd.tolist():
            widths[symbols == s] = len(self.extra_ids[s - self.pieces])
        owner = np.repeat(np.arange(len(counts)), counts)
        spread = np.repeat(symbols, widths)
        for s in odd.tolist():
            own, ids = spread == s, self.extra_ids[s - self.pieces]
            spread[own] = np.tile(np.array(ids), int(own.sum()) // len(ids))
        return spread, np.bincount(owner, weights=widths, minlength=len(counts)).astype(np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, compare them with the library, and keep their ids as little-endian bytes."""
        kept, short = self.kept, sorted((c for c in chunks if len(c) < HEAP_FROM), key=len)
        for start in range(0, len(short), 8192):
            part = short[start : start + 8192]
            ids, counts = self._spread(*self.in_step(part))
            raw, stops = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            kept.update(zip(part, (raw[i:j] for i, j in zip([0, *stops], stops))))
        for chunk in chunks:
            if len(chunk) >= HEAP_FROM:
                symbols = np.array(self.by_heap(chunk))
                kept[chunk] = self._spread(symbols, np.array([len(symbols)]))[0].astype("<u4").tobytes()
        if self.check:
            plain = [c for c in chunks if c and BLANK not in c]
            for group in ([" ".join(plain[i : i + 4096])] for i in range(0, len(plain), 4096)):
                self._compare(group[0], b"".join([kept[c] for c in group[0].split(" ")]))
            for chunk in chunks:
                if BLANK in chunk:
                    self._compare(chunk, kept[chunk])

    def _compare(self, text: str, own: bytes) -> None:
        if np.array(self.library.encode(text), dtype="<u4").tobytes() != own:
            raise ValueError(f"agenda and library differ on {text[:200]!r}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        cut = [self.chunks(t) for t in texts]
        if self.kept_bytes > KEPT_BYTES:
            self.forget()
        fresh = list(set().union(*cut).difference(self.kept))
        self.learn(fresh)
        self.kept_bytes += sum(CHUNK_COST + 4 * len(c) + len(self.kept[c]) for c in fresh)
        first, last = np.array([self.bos], dtype="<u4").tobytes(), np.array([self.eos], dtype="<u4").tobytes()
        kept = self.kept.__getitem__
        return [first + b"".join(map(kept, chunks)) + last for chunks in cut]

    def decode(self, packed: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(p, dtype="<u4").tolist() for p in packed], num_threads=1) if packed else []


@lru_cache(maxsize=2)
def encoder(model: str, check: bool = True) -> MergeEncoder:
    return MergeEncoder(model, check)


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit), ``decoded``.

    One row out per row in, in any order; no shuffle. A null text counts as empty and gives begin and end
    only. Repeated rows and null keys stay as they are; other columns are not read. Texts are worked on in
    pieces of bounded size, each whole. ``model`` is a path every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model, check)
        try:
            for batch in batches:
                keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
                start = 0
                while start < len(texts):
                    stop, size = start, 0
                    while stop < len(texts) and (stop == start or size + len(texts[stop]) <= PIECE_CHARS):
                        size += len(texts[stop])
                        stop += 1
                    packed = tool.encode(texts[start:stop])
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.slice(start, stop - start),
                            pa.array([len(p) // 4 for p in packed], pa.int64()),
                            pa.array(packed, pa.binary()),
                            pa.array(tool.decode(packed), pa.string()),
                        ],
                        names=["k", "n_tokens", "ids", "decoded"],
                    )
                    start = stop
        finally:
            tool.forget()  # workers live on between tasks

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
        run, f"k {kind}, n_tokens bigint, ids binary, decoded string"
    )
    return out.withColumnRenamed("k", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of ``encode_decode``'s rows."""
    return encoded.select(
        key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
