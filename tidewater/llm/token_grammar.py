"""Token-ID output with Re-Pair grammar compression and random access.

Documents are encoded and written in ascending doc_id order into shard files.
Within a shard, frequent adjacent id pairs are replaced by new symbols, round
after round: a round counts all pairs (occurrences that do not overlap) and takes
those that are at most ``share`` times rarer than the most frequent; where two of
them overlap, the more frequent pair goes first and the other waits for the next
round.  Rounds end when no pair occurs ``least`` times, twice by default; there
is no other bound on rounds, pairs or symbols.  No symbol crosses the border of a
document, so a document, or any token range of it, is decoded on its own: the
expansion length of every symbol is stored with the rules.

Shard file: magic, a JSON header with the sizes, then little-endian arrays:

=============  =======================  =========================================
array          type                     meaning
=============  =======================  =========================================
doc_id         int64[docs]              ids, ascending (null ids first, flagged)
is_null        uint8[docs]              1 where the doc_id is null
token_start    int64[docs + 1]          prefix sums of token counts
symbol_start   int64[docs + 1]          prefix sums of symbol counts
rules          uint8[2 * rules, width]  left and right symbol of each rule
lengths        uint32[rules]            tokens that each rule expands to
symbols        uint8[..., width]        compressed sequence
=============  =======================  =========================================

A symbol takes ``width`` little-endian bytes, as few as the largest needs.

Defined results: a null text is the empty text; every document ends with
``END`` even if empty; equal doc_ids stay together in one range and are ordered
by text; null doc_ids come first; a document longer than a shard has a shard of
its own; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.shared import filesystem, keep_freed_memory, materialise, scratch

END = 2
MAGIC = b"TWGRAM01"
#: White space besides the two characters at which texts are cut.
_OTHER_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


_BYTES = np.arange(256)
_IS_SPACE = (_BYTES == 32) | (_BYTES == 10)
_IS_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_IS_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_IS_LETTER & ~((_BYTES >= 48) & (_BYTES <= 57))


class ChunkEncoder:
    """Encodes texts with the tokenizers library, remembering what it has seen.

    The pre-tokenizer never joins what lies on both sides of a space or line end
    after other characters, nor an ASCII letter with a mark after it, so texts
    are cut there and each distinct cut is encoded by the library once.  A text
    with any other white space or a special string, or longer than a batch, is
    encoded whole.

    Cuts are found on the bytes of a batch of texts at once; a cut is looked up
    by a 64-bit value of its bytes in an open-addressing table of fixed size that
    is emptied when it is half full, and its bytes are compared with those of the
    entry: where they differ, the library encodes it anew.
    """

    def __init__(self, path: str, batch_bytes: int = 1 << 19, table_bits: int = 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, k in vocab.items():  # one character of a token stands for one byte
            self.token_bytes[k] = len(token)
        self.batch_bytes, self.table_bits = batch_bytes, table_bits
        rng = np.random.default_rng(5)
        self.coefficient = rng.integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        step = 0x9E3779B97F4A7C15
        back = pow(step, -1, 1 << 64)
        self.power, self.inverse = (np.cumprod(np.full(2 * batch_bytes, x, np.uint64)) for x in (step, back))
        self._forget()

    def _forget(self) -> None:
        size = 1 << self.table_bits
        self.keys, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.known = 0
        self.first, self.count = np.zeros(size // 2 + 1, np.int64), np.zeros(size // 2 + 1, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.place, self.size = np.zeros(size // 2 + 1, np.int64), np.zeros(size // 2 + 1, np.int64)
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_cuts(self, cuts: list[bytes]) -> list[bytes]:
        """Ids of cuts, many in one text: what comes out is cut at the cuts' ends
        again by the number of bytes that each token stands for."""
        out: list[bytes | None] = [None] * len(cuts)
        join = [k for k, c in enumerate(cuts) if c[0] in b" \n" and c[-1] not in b" \n"]
        groups = [join[a : a + 64] for a in range(0, len(join), 64)]
        texts = [b"".join([cuts[k] for k in g]).decode("utf-8") for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.cumsum(self.token_bytes[ids])
            ends = np.cumsum([len(cuts[k]) for k in group])
            cut = np.searchsorted(at, ends)
            if cut[-1] < len(at) and (at[cut] == ends).all():
                raw, a = ids.tobytes(), 0
                for k, b in zip(group, ((cut + 1) * 4).tolist()):
                    out[k], a = raw[a:b], b
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(left, self._library([cuts[k].decode("utf-8") for k in left])):
            out[k] = ids
        return out  # type: ignore[return-value]

    def _find(self, value: np.ndarray) -> np.ndarray:
        """Entry of each value, -1 where it is not known."""
        mask = len(self.keys) - 1
        slot = (value >> np.uint64(64 - self.table_bits)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == value, self.entry[slot], -1)
        open_ = np.flatnonzero((there != value) & (there != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & mask
            there = self.keys[slot]
            hit = there == value[open_]
            out[open_[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            open_, slot = open_[on], slot[on]
        return out

    def _remember(self, value: np.ndarray, cuts: list[bytes], ids: list[bytes]) -> np.ndarray:
        """Store new distinct values with their bytes; returns their entries."""
        mask, number = len(self.keys) - 1, self.known + np.arange(len(value))
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        total = self.used + int(counts.sum())
        if total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(total, 2 * len(self.flat)) - len(self.flat), np.uint32)))
        self.flat[self.used : total] = np.frombuffer(b"".join(ids), "<u4")
        self.first[number], self.count[number] = self.used + np.cumsum(counts) - counts, counts
        sizes = np.array([len(c) for c in cuts], np.int64)
        total_raw = self.raw_used + int(sizes.sum())
        if total_raw > len(self.raw):
            self.raw = np.concatenate((self.raw, np.zeros(max(total_raw, 2 * len(self.raw)) - len(self.raw), np.uint8)))
        self.raw[self.raw_used : total_raw] = np.frombuffer(b"".join(cuts), np.uint8)
        self.place[number], self.size[number] = self.raw_used + np.cumsum(sizes) - sizes, sizes
        self.used, self.known, self.raw_used = total, self.known + len(value), total_raw
        slot, rest = (value >> np.uint64(64 - self.table_bits)).astype(np.int64), np.arange(len(value))
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            self.keys[slot[free]] = value[free]
            won = self.keys[slot[rest]] == value[rest]
            self.entry[slot[rest[won]]] = number[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & mask
        return number

    def _batch(self, raws: list[bytes]) -> list[bytes]:
        joined = b"".join(raws)
        if not joined:
            return [b""] * len(raws)
        buf = np.frombuffer(joined, np.uint8)
        edges = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
        space = _IS_SPACE[buf]
        begin = np.empty(len(buf), bool)
        begin[0] = True
        begin[1:] = (space[1:] & ~space[:-1]) | (_IS_MARK[buf[1:]] & _IS_LETTER[buf[:-1]])
        begin[edges[:-1][edges[:-1] < len(buf)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(buf))
        prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.coefficient[buf] * self.power[: len(buf)], out=prefix[1:])
        value = (prefix[end] - prefix[start]) * self.inverse[start]
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        value[value == 0] = 1
        entry = self._find(value)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new, one, back = np.unique(value[miss], return_index=True, return_inverse=True)
            if self.known + len(new) > len(self.keys) // 2:
                self._forget()
                return self._batch(raws)
            at = miss[one]
            cuts = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            entry[miss] = self._remember(new, cuts, self._encode_cuts(cuts))[back]
        at_raw = np.minimum(np.repeat(self.place[entry] - start, end - start) + np.arange(len(buf)), self.raw_used - 1)
        differs = np.flatnonzero(np.add.reduceat(self.raw[at_raw] != buf, start, dtype=np.int64) + (self.size[entry] != end - start))
        count, first, flat = self.count[entry], self.first[entry], self.flat
        if len(differs):
            anew = self._library([joined[a:b].decode("utf-8") for a, b in zip(start[differs].tolist(), end[differs].tolist())])
            count[differs] = [len(x) // 4 for x in anew]
            first[differs] = len(flat) + np.cumsum(count[differs]) - count[differs]
            flat = np.concatenate((flat, np.frombuffer(b"".join(anew), "<u4")))
        ends = np.cumsum(count)
        ids = flat[np.repeat(first - (ends - count), count) + np.arange(ends[-1])].astype("<u4").tobytes()
        cut = np.concatenate(([0], ends))[np.searchsorted(start, edges)] * 4
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        raws, keys, held = [], [], 0

        def flush() -> None:
            nonlocal held
            for k, ids in zip(keys, self._batch(raws)):
                out[k] = ids
            raws.clear(), keys.clear()
            held = 0

        for k, text in enumerate(texts):
            raw = text.encode("utf-8")
            if len(raw) > self.batch_bytes or _OTHER_SPACE.search(text) or any(x in text for x in self.special):
                out[k] = self._library([text])[0]
                continue
            raws.append(raw)
            keys.append(k)
            held += len(raw)
            if held > self.batch_bytes:
                flush()
        flush()
        return out  # type: ignore[return-value]


_loaded: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _loaded:
        keep_freed_memory()
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


_HASH_BITS = 20


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


def _win(spot: np.ndarray, follow: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Which of the pairs at ascending places *spot* are taken: those that no
    overlapping pair of higher priority takes first, in two turns."""
    taken, open_ = np.zeros(len(spot), bool), np.arange(len(spot))
    for _ in range(2):
        if not len(open_):
            break
        near, p = follow[open_][:-1] == spot[open_][1:], priority[open_]
        win = np.ones(len(open_), bool)
        win[1:] &= ~(near & (p[:-1] > p[1:]))
        win[:-1] &= ~(near & (p[1:] > p[:-1]))
        taken[open_[win]] = True
        out = win.copy()
        out[1:] |= near & win[:-1]
        out[:-1] |= near & win[1:]
        open_ = open_[~out]
    return taken


def compress(seq: np.ndarray, starts: np.ndarray, base: int, least: int = 2, share: int = 16):
    """Re-Pair over one shard.

    *seq*: token ids below *base*; *starts*: index of each document's first
    token.  Returns (symbols, symbol starts, rules, lengths).

    Of the pairs chosen in a round the most frequent one gets all its places, so
    every round makes a rule.  A pair that occurs once can only occur again
    beside a new symbol; until then its place is not counted any more.  Symbols
    stay in their places and are linked, so a round costs what it counts.
    """
    seq = np.array(seq, np.uint32)
    n = len(seq)
    last = np.zeros(n, bool)  # the last symbol of each document
    last[np.asarray(starts[1:]) - 1] = True
    last[-1:] = True
    fresh, gone = ~last, np.zeros(n, bool)  # places whose pair may occur again; places without a symbol
    following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    owner = np.zeros(1 << _HASH_BITS, np.int32)
    rules: list[np.ndarray] = []
    lengths = np.empty(0, np.uint32)
    while len(at := np.flatnonzero(fresh)) > 1:
        at = at.astype(np.int32)
        follow = following[at]
        left, right = seq[at], seq[follow]
        twins = np.flatnonzero(left == right)
        if len(twins):  # in a run of one symbol every second pair counts, from the left
            run = np.flatnonzero(np.concatenate(([True], follow[twins[:-1]] != at[twins[1:]])))
            in_run = np.arange(len(twins)) - np.repeat(run, np.diff(np.concatenate((run, [len(twins)]))))
            one = np.ones(len(at), bool)
            one[twins[in_run % 2 == 1]] = False
            at, follow, left, right = at[one], follow[one], left[one], right[one]
        pair = (left.astype(np.uint64) << np.uint64(32)) | right
        ordered = np.sort(pair)
        edge = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
        count = np.diff(edge)
        top = int(count.max())
        if top < least:
            break
        distinct, many = ordered[edge[:-1]], count > 1
        good = count >= max(least, -(-top // share))
        chosen, often = distinct[good], count[good]
        kind = np.zeros(1 << _HASH_BITS, np.uint8)  # by slot: some pair occurs again, some pair is chosen
        kind[_slot(distinct[many])] = 1
        kind[_slot(chosen)] = 2
        kind = kind[_slot(pair)]
        fresh[at[kind == 0]] = False
        likely = np.flatnonzero(kind == 2)
        wanted = pair[likely]
        slot = _slot(wanted)
        owner[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
        rule = owner[slot]
        other = np.flatnonzero(chosen[rule] != wanted)  # of chosen pairs with one slot the last owns it
        rule[other] = np.minimum(np.searchsorted(chosen, wanted[other]), len(chosen) - 1)
        hit = chosen[rule] == wanted
        likely, rule = likely[hit], rule[hit]
        at, follow = at[likely], follow[likely]
        priority = np.empty(len(chosen), np.int64)
        priority[np.argsort(often, kind="stable")] = np.arange(len(chosen))
        taken = _win(at, follow, priority[rule])
        used = np.bincount(rule[taken], minlength=len(chosen)) >= least  # others get no rule and are counted again
        taken &= used[rule]
        at, follow, rule = at[taken], follow[taken], (np.cumsum(used) - 1)[rule[taken]]
        chosen = chosen[used]
        left, right = (chosen >> np.uint64(32)).astype(np.int64), (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
        known = np.concatenate((np.ones(1, np.uint32), lengths))
        seq[at] = base + len(lengths) + rule
        rules.append(np.stack([left, right], axis=1).astype(np.uint32))
        lengths = np.concatenate((lengths, known[np.maximum(left - base + 1, 0)] + known[np.maximum(right - base + 1, 0)]))
        last[at], gone[follow], fresh[follow] = last[follow], True, False
        after = following[follow]
        following[at] = after
        inner = after < n
        before[after[inner]] = at[inner]
        near = before[at]
        near = np.concatenate((at, near[near >= 0]))
        fresh[near] = ~last[near]
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    symbol_starts = np.concatenate(([0], np.flatnonzero(last[~gone]) + 1))
    return seq[~gone], symbol_starts, table, lengths


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """uint32 values as rows of their *width* low bytes."""
    return np.ascontiguousarray(values, "<u4").reshape(-1, 1).view(np.uint8)[:, :width]


def unpack(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 4), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u4").ravel()


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of a run of symbols.  The lengths say where each symbol's tokens
    go; rules are opened level by level, tokens are put down and done with."""
    seq = np.asarray(symbols, np.uint32)
    widths = np.concatenate((np.ones(1, np.int32), lengths.astype(np.int32)))  # by symbol less base and one, tokens at 0

    def width(s: np.ndarray) -> np.ndarray:
        return widths[np.maximum(s, np.uint32(base - 1)) - np.uint32(base - 1)]

    wide = width(seq)
    at = np.cumsum(wide, dtype=np.int64) - wide
    out = np.empty(int(wide.sum(dtype=np.int64)), np.uint32)
    while len(seq):
        token = seq < base
        out[at[token]] = seq[token]
        seq, at = seq[~token], at[~token]
        pair = rules[seq - np.uint32(base)]
        seq, at = np.concatenate((pair[:, 0], pair[:, 1])), np.concatenate((at, at + width(pair[:, 0])))
    return out


class Shard:
    """A shard file, opened for random access."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a grammar shard")
        (n,) = struct.unpack("<I", blob[8:12])
        head = json.loads(blob[12 : 12 + n])
        at = 12 + n
        self.base = head["base"]
        for name, kind, shape in head["arrays"]:
            count = int(np.prod(shape))
            setattr(self, name, np.frombuffer(blob, kind, count, at).reshape(shape))
            at += count * np.dtype(kind).itemsize
        self.rules = unpack(self.rules).reshape(-1, 2)

    def _run(self, k: int) -> np.ndarray:
        return unpack(self.symbols[self.symbol_start[k] : self.symbol_start[k + 1]])

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return expand(self._run(k), self.base, self.rules, self.lengths)

    def tokens(self, k: int, first: int, count: int) -> np.ndarray:
        """*count* ids of the k-th document from its id number *first* on; only
        the symbols that cover them are expanded."""
        run = self._run(k).astype(np.int64)
        width = np.ones(len(run), np.int64)
        width[run >= self.base] = self.lengths[run[run >= self.base] - self.base]
        ends = np.cumsum(width)
        a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, first + count, "left") + 1
        skip = first - (ends[a] - width[a] if a < len(ends) else first)
        return expand(run[a:b], self.base, self.rules, self.lengths)[skip : skip + count]

    def all_tokens(self) -> np.ndarray:
        return expand(unpack(self.symbols), self.base, self.rules, self.lengths)


def shard_bytes(doc_ids: list[int | None], tokens: list[bytes], base: int) -> tuple[bytes, int]:
    """A shard file and its number of tokens."""
    counts = np.array([len(t) // 4 for t in tokens], np.int64)
    token_start = np.concatenate(([0], np.cumsum(counts)))
    seq = np.frombuffer(b"".join(tokens), "<u4")
    symbols, symbol_start, rules, lengths = compress(seq, token_start[:-1], base)
    width = max(1, (int(base + len(rules)).bit_length() + 7) // 8)
    arrays = {
        "doc_id": np.array([0 if d is None else d for d in doc_ids], "<i8"),
        "token_start": token_start.astype("<i8"),
        "symbol_start": symbol_start.astype("<i8"),
        "lengths": lengths.astype("<u4"),
        "rules": pack(rules.ravel(), width),
        "symbols": pack(symbols, width),
        "is_null": np.array([d is None for d in doc_ids], "u1"),
    }
    head = json.dumps({"base": base, "arrays": [[k, a.dtype.str, a.shape] for k, a in arrays.items()]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *[a.tobytes() for a in arrays.values()]]), int(token_start[-1])


def write(docs: DataFrame, tokenizer_path: str, folder: str, shard_tokens: int = 1_500_000) -> DataFrame:
    """Encode *docs* and write grammar shards to *folder*; returns the manifest
    (part, number, file, docs, tokens), a written table.  Only files that the
    manifest names count; those of lost or repeated attempts are ignored."""
    spark = docs.sparkSession

    def one_part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer_path)
        base = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            blob, n = shard_bytes(ids, tokens, base)
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.twg"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(blob)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(ids)]), pa.array([n])]
            ids.clear(), tokens.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_arrays(row, ["part", "number", "file", "docs", "tokens"])

        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                doc_ids, texts = (c.to_pylist() for c in batch.slice(a, 128).columns)
                for d, t in zip(doc_ids, encoder.encode([x or "" for x in texts])):
                    if held and held + len(t) // 4 + 1 > shard_tokens:
                        yield flush()
                    ids.append(d)
                    tokens.append(t + end)
                    held += len(t) // 4 + 1
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = ordered.mapInArrow(one_part, "part int, number int, file string, docs long, tokens long")
    return materialise(written, "grammar-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    The manifest has a row for each shard; start positions come from a running
    sum over those rows."""
    bases = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(bases), F.lit(0)))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        for frame in frames:
            for name, base in zip(frame["file"], frame["base"]):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    shard = Shard(f.read())
                tokens = shard.all_tokens().astype("<u4")
                cuts = shard.token_start.tolist()
                yield pd.DataFrame({
                    "doc_id": pd.array(np.where(shard.is_null == 1, None, shard.doc_id), dtype="Int64"),
                    "start": base + shard.token_start[:-1],
                    "n_tokens": np.diff(shard.token_start),
                    "ids_crc32": [zlib.crc32(tokens[a:b]) for a, b in zip(cuts, cuts[1:])],
                })

    spread = files.select("file", "base").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return spread.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write *docs* and return what :func:`read` finds in the files."""
    folder = scratch(docs.sparkSession, "grammar")
    return read(docs.sparkSession, folder, write(docs, tokenizer_path, folder))
