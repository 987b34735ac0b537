"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold, for each position, the rank of the pair that
starts there (with the position as tie-break); an inner node holds the smaller
child, so the root is the leftmost lowest-rank merge.  A merge changes three
leaves, each updated along its path to the root in logarithmic time, until the
root is empty.

Most words are short and many, so the trees of all words of one length class
are kept as rows of one matrix and advanced together: every round takes each
word's root, merges, and updates the paths.  A long word has a tree of its own,
and a round takes from it, left to right, all merges of the root's rank, where
the merge table allows it: no merge may come before one that makes its parts,
so none of the new pairs can rank lower.  Memory is in proportion to a word's
length.

Texts are cut at spaces and line ends and between Latin letters and an ASCII
mark after them, except letters whose normal form does not end in a letter; what
lies between is encoded once per worker and remembered, so a text costs one
look-up for each of its words.  The memory has two halves of ``cache_limit / 2`` entries each; when the younger is
full it becomes the older, and what was not used meanwhile is forgotten.

Defined results: a null text is encoded as the empty text (no ids); the
tokenizer's special strings inside a text become their ids, as the library does
by default; other texts are encoded whole, however long; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import release_memory

_NONE = np.iinfo(np.int64).max
_NO_RANK = np.iinfo(np.int32).max
_POS_BITS = 32
#: Words of more initial ids than this have a tree of their own.
_LONG = 512


def chunk_pattern(normal=lambda c: c) -> re.Pattern:
    """Cuts that part no piece and no composed character: at spaces and line
    ends, and between Latin letters and an ASCII mark after them.  Letters that
    *normal* makes end in something else, such as a combining mark that a mark
    after it would join, are not cut after."""
    letters = [chr(k) for k in range(0x250) if chr(k).isalpha() and unicodedata.category(normal(chr(k))[-1:] or "0").startswith("L")]
    return re.compile(f"[{''.join(letters)}]++(?![^\\W_]|[^\\x00-\\x7f])|[^ \\n]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in set(plain):
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class PairRanks:
    """Look-up of (left id, right id) -> (rank, merged id) by open addressing."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.size = 1 << max(4, int(2 * len(pairs)).bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        self.out = np.full(self.size, -1, np.int64)
        keys = (pairs[:, 0].astype(np.int64) << 32) | pairs[:, 1].astype(np.int64)
        slots = self._slot(keys)
        self.probes = 1
        made = np.full(int(max(pairs.max(initial=0), merged.max(initial=0))) + 1, -1, np.int64)
        np.maximum.at(made, merged, np.arange(len(merged)))
        #: whether every merge comes after all merges that make its parts
        self.ordered = bool((made[pairs].max(axis=1, initial=-1) < np.arange(len(pairs))).all())
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist())):
            step = 0
            while self.keys[slot] not in (-1, key):
                slot, step = (slot + 1) & (self.size - 1), step + 1
            if self.keys[slot] != key:  # of equal pairs the first has the lower rank
                self.keys[slot], self.rank[slot], self.out[slot] = key, rank, merged[rank]
            self.probes = max(self.probes, step + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; -1 where there is no such merge."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        hit = np.where(self.keys[slot] == keys, slot, -1)
        open_ = np.flatnonzero((hit < 0) & (self.keys[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (self.size - 1)
            here = self.keys[slot[open_]]
            found = here == keys[open_]
            hit[open_[found]] = slot[open_[found]]
            open_ = open_[~found & (here != -1)]
        ok = hit >= 0
        return np.where(ok, self.rank[hit], -1), np.where(ok, self.out[hit], -1)


def merge_words(flat: np.ndarray, lengths: np.ndarray, ranks: PairRanks, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Final ids of words, one after the other, and their numbers of ids.

    *flat* has the initial ids of all words, *lengths* their numbers."""
    start = np.cumsum(lengths) - lengths
    depth = np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
    depth[(1 << depth) < lengths] += 1
    left = lengths.copy()
    ids = flat.copy()  # a word's final ids are put where it began
    for k in np.flatnonzero(lengths > _LONG):
        done = _merge_long(flat[start[k] : start[k] + lengths[k]], ranks)
        left[k] = len(done)
        ids[start[k] : start[k] + len(done)] = done
    many = (lengths > 1) & (lengths <= _LONG)
    for d in np.unique(depth[many]):
        members = np.flatnonzero((depth == d) & many)
        block = max(1, cells >> int(d))
        for a in range(0, len(members), block):
            part = members[a : a + block]
            done, count = _merge_block(flat, start[part], lengths[part], 1 << int(d), ranks)
            left[part] = count
            ids[np.repeat(start[part] - (np.cumsum(count) - count), count) + np.arange(len(done))] = done
    return ids[np.repeat(start - (np.cumsum(left) - left), left) + np.arange(left.sum())], left


def _merge_block(flat, start, lengths, width: int, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Words of at most *width* ids, advanced together: final ids and counts."""
    count = len(lengths)
    ids = np.full((count, width), -1, np.int64)
    filled = np.arange(width)[None, :] < lengths[:, None]
    ids[filled] = flat[np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
    # links between the positions that are still there; width means none
    following = np.where(np.arange(1, width + 1)[None, :] < lengths[:, None], np.arange(1, width + 1)[None, :], width)
    before = np.broadcast_to(np.arange(-1, width - 1), (count, width)).copy()
    tree = np.full((count, 2 * width), _NONE, np.int64)
    has_next = np.zeros_like(filled)
    has_next[:, :-1] = filled[:, 1:]
    row, col = np.nonzero(has_next)
    rank, _ = ranks.find(ids[row, col], ids[row, col + 1])
    tree[row, width + col] = np.where(rank >= 0, (rank << _POS_BITS) | col, _NONE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        at = tree[live, 1] & ((1 << _POS_BITS) - 1)
        nxt = following[live, at]
        _, merged = ranks.find(ids[live, at], ids[live, nxt])
        ids[live, at] = merged
        ids[live, nxt] = -1
        after = following[live, nxt]
        following[live, at] = after
        inner = after < width
        before[live[inner], after[inner]] = at[inner]
        # the pair at the swallowed position goes, the pairs at `at` and before it change
        _update(tree, width, live, nxt, np.full(len(live), _NONE))
        _update(tree, width, live, at, _leaf(ids, live, at, after, width, ranks))
        prev = before[live, at]
        some = prev >= 0
        if some.any():
            _update(tree, width, live[some], prev[some], _leaf(ids, live[some], prev[some], at[some], width, ranks))
        live = live[tree[live, 1] != _NONE]
    there = ids >= 0
    return ids[there], there.sum(axis=1)


def _merge_long(flat: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """Final ids of one word: a round takes every merge of the root's rank, or
    only the leftmost where the merge table is not in order."""
    n = len(flat)
    depth = max(1, int(n - 1).bit_length())
    width = 1 << depth
    ids = flat.astype(np.int32)
    following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    tree = np.full(2 * width, _NO_RANK, np.int32)

    def leaf(at: np.ndarray) -> np.ndarray:
        value = np.full(len(at), _NO_RANK, np.int32)
        has = np.flatnonzero((ids[at] >= 0) & (following[at] < n))
        if len(has):
            rank, _ = ranks.find(ids[at[has]].astype(np.int64), ids[following[at[has]]].astype(np.int64))
            value[has] = np.where(rank >= 0, rank, _NO_RANK)
        return value

    for a in range(0, n, 1 << 16):
        part = np.arange(a, min(n, a + (1 << 16)))
        tree[width + part] = leaf(part)
    level = width
    while level > 1:
        level //= 2
        tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
    while (rank := tree[1]) != _NO_RANK:
        node = np.ones(1, np.int64)
        for _ in range(depth):  # down to the leaves of this rank, from left to right
            node = np.stack((2 * node, 2 * node + 1), axis=1).ravel()
            node = node[tree[node] == rank]
        at = node - width if ranks.ordered else node[:1] - width
        nxt = following[at]
        run = np.flatnonzero(np.concatenate(([True], at[1:] != nxt[:-1])))
        if len(run) < len(at):  # overlapping pairs: every second one, from the left
            in_run = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate((run, [len(at)]))))
            at, nxt = at[in_run % 2 == 0], nxt[in_run % 2 == 0]
        _, merged = ranks.find(ids[at[:1]].astype(np.int64), ids[nxt[:1]].astype(np.int64))
        ids[at], ids[nxt] = merged[0], -1
        after = following[nxt]
        following[at] = after
        inner = after < n
        before[after[inner]] = at[inner]
        prev = before[at]
        changed = np.unique(np.concatenate((nxt, at, prev[prev >= 0])))
        node = changed.astype(np.int64) + width
        tree[node] = leaf(changed)
        for _ in range(depth):
            node >>= 1
            node = node[np.concatenate(([True], node[1:] != node[:-1]))]
            tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
    return ids[ids >= 0]


def _leaf(ids, row, at, nxt, width, ranks) -> np.ndarray:
    value = np.full(len(row), _NONE, np.int64)
    has = np.flatnonzero(nxt < width)
    if len(has):
        rank, _ = ranks.find(ids[row[has], at[has]], ids[row[has], nxt[has]])
        value[has] = np.where(rank >= 0, (rank << _POS_BITS) | at[has], _NONE)
    return value


def _update(tree, width, row, at, value) -> None:
    """Set leaves and renew the minima up to the roots."""
    node = at + width
    tree[row, node] = value
    while node[0] > 1:  # all leaves lie at the same depth
        node = node >> 1
        tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])


class TreeBPE:
    """Encoder and decoder for a tokenizer file of the word-end BPE kind.

    The file's own normalizer is applied by the installed library; cutting,
    merging and decoding are done here.
    """

    def __init__(self, path: str, cache_limit: int = 160_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(k, "") for k in range(max(names) + 1)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(self.vocab[a], self.vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.ranks = PairRanks(pairs, np.array([self.vocab[a + b] for a, b in merges], np.int64))
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.chunks = chunk_pattern(self.normalizer.normalize_str) if self.normalizer else chunk_pattern()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the library's \s is the Unicode property, so U+001C to U+001F are not in it
        self.pieces = regex.compile(split.replace(r"^\s\p", r"^\p{White_Space}\p"))
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        alphabet = byte_alphabet()
        self.plain_id = np.array([self.vocab.get(c, -1) for c in alphabet], np.int64)
        self.end_id = np.array([self.vocab.get(c + self.suffix, -1) for c in alphabet], np.int64)
        self.cache_limit, self.cache, self.older = cache_limit // 2, {}, {}

    def _initial(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the bytes of all pieces, the last of each with the word end."""
        raws = [p.encode("utf-8") for p in pieces]
        size = np.array([len(r) for r in raws], np.int64)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        ids = self.plain_id[raw]
        last = np.cumsum(size) - 1
        ids[last] = self.end_id[raw[last]]
        known = ids >= 0
        return ids[known], np.add.reduceat(known.astype(np.int64), last - size + 1)

    def _cut(self, chunk: str) -> list[str | int]:
        """Pieces of a chunk, and ids of the special strings in it."""
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(chunk) if self.specials else ():
            out += self._cut_plain(chunk[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._cut_plain(chunk[at:])

    def _cut_plain(self, text: str) -> list[str]:
        if not text:
            return []
        return self.pieces.findall(self.normalizer.normalize_str(text) if self.normalizer else text)

    def learn(self, chunks: Iterable[str]) -> None:
        """Encode chunks, all together, and remember them."""
        new = list(chunks)
        cut = [self._cut(c) for c in new]
        pieces = list(dict.fromkeys(p for parts in cut for p in parts if isinstance(p, str)))
        done: dict[str, tuple[str, str]] = {}
        if pieces:
            flat, count = merge_words(*self._initial(pieces), self.ranks)
            decimals, names = list(map(str, flat.tolist())), list(map(self.names.__getitem__, flat.tolist()))
            ends = np.cumsum(count).tolist()
            for p, a, b in zip(pieces, [0, *ends], ends):
                done[p] = (" ".join(decimals[a:b]), " ".join(names[a:b]))
        for c, parts in zip(new, cut):
            if len(parts) == 1 and isinstance(parts[0], str):
                self.cache[c] = done[parts[0]]
                continue
            found = [done[p] if isinstance(p, str) else (str(p), self.names[p]) for p in parts]
            found = [x for x in found if x[0]]
            self.cache[c] = (" ".join([x[0] for x in found]), " ".join([x[1] for x in found]))

    def digest(self, texts: Iterable[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, ids as decimals joined by a space, decoded text."""
        split = [self.chunks.findall(t or "") for t in texts]
        if len(self.cache) > self.cache_limit:  # what is still used comes back from the older half
            self.older, self.cache = self.cache, {}
        new = []
        for c in set().union(*split):
            if c not in self.cache:
                if c in self.older:
                    self.cache[c] = self.older.pop(c)
                else:
                    new.append(c)
        self.learn(new)
        get, out = self.cache.__getitem__, []
        for chunks in split:
            found = [x for x in map(get, chunks) if x[0]]
            ids = " ".join([x[0] for x in found])
            out.append((ids.count(" ") + 1 if found else 0, ids, " ".join([x[1] for x in found])))
        return out

    def encode(self, text: str | None) -> list[int]:
        ids = self.digest([text])[0][1]
        return [int(x) for x in ids.split(" ")] if ids else []

    def decode(self, ids: Iterable[int]) -> str:
        """Names joined by a space: such a file has no decoder of its own."""
        return " ".join([self.names[i] for i in ids])


_loaded: dict[str, TreeBPE] = {}


def loaded(path: str) -> TreeBPE:
    """The worker's encoder for *path*."""
    if path not in _loaded:
        _loaded[path] = TreeBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded text: the operator's full output."""

    @F.pandas_udf("ids array<int>, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = loaded(path).digest(texts)
        return pd.DataFrame({"ids": [[int(i) for i in x[1].split(" ")] if x[1] else [] for x in out], "decoded": [x[2] for x in out]})

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", F.size("r.ids").cast("long").alias("n_tokens"), "r.ids", "r.decoded")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    @F.pandas_udf("n long, ids string, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        encoder, rows = loaded(path), []
        for a in range(0, len(texts), 512):
            for n, ids, decoded in encoder.digest(texts.iloc[a : a + 512]):
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
        release_memory()
        return pd.DataFrame(rows, columns=["n", "ids", "decoded"])

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", F.col("r.n").alias("n_tokens"), F.col("r.ids").alias("ids_sha256"), F.col("r.decoded").alias("decoded_sha256"))
