"""BPE encoding and decoding by speculation and verification.

Every distinct word of a batch is first cut greedily into longest tokens.  A token sequence is the exact
BPE result if each token is the result for its own string and each adjacent pair of tokens is compatible (merging
the pair's joined string gives the pair again).  Pairs are tested together in numpy by unwinding both
tokens' merge trees; only words with a failing token or pair are merged step by step.

The tokenizer file is the JSON of a BPE tokenizer with a Split pattern, byte-level symbols, an
end-of-word suffix, no decoder (tokens are joined by a space) and special tokens found in the raw text, normalised by
NFC, folded white space (which its words never hold) and lower case; any other kind is refused.  Its path is a parameter; the file is read once in each Python worker.

Defined cases: null and empty texts give no tokens; a word of any length is merged in about n log n steps; null ids pass through; repeated rows each get a row;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foldlake.llm.common import map_arrow

_LOADED: dict[str, "WordBpe"] = {}
#: Words remembered in a worker before its table is emptied.
REMEMBERED = 500_000
NONE = np.iinfo(np.int32).max
#: Bits of a place in a word, in the heap of merges.
PLACE = 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class WordBpe:
    """A loaded tokenizer: encode and decode whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec["decoder"]:
            raise ValueError(f"{path}: another kind of tokenizer than this encoder computes")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(self.vocab.values()) + 1
        self.left = np.full(size, -1, np.int32)
        self.right = np.full(size, -1, np.int32)
        self.birth = np.full(size, -1, np.int32)  # rank of the merge that makes a token; -1 for symbols
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x, y] = (r, z)
            if self.birth[z] < 0:
                self.left[z], self.right[z], self.birth[z] = x, y, r
        keys = np.array([(x << 32) | y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(2**62))
        self.pair_rank = np.append(np.array([r for r, _ in self.rank.values()], np.int32)[order], NONE).astype(np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = [b""] * max(size, *(i + 1 for i in self.special.values()))
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = text.encode()
        self.longest = max(map(len, self.vocab))
        self.symbols = byte_symbols()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split, regex.V1)
        self.at_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known = self.fresh()
        self.sound = np.zeros(size, np.int8)  # 1: the token is the result for its own string; 2: it is not
        self.exact_words = self.new_words = 0

    def fresh(self) -> dict[str | int, bytes]:
        return {i: np.array([i], "<u4").tobytes() for i in self.special.values()}

    # ---- text to words
    def normalised(self, text: str) -> str:
        # one character at a time as in the tokenizer: a capital sigma has one lower form
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str | int]:
        """Words in order; the number of a special token where its string stands."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.words.findall(self.normalised(text))
        out: list[str | int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words.findall(self.normalised(part))
        return out

    # ---- words to tokens
    def symbols_of(self, word: str) -> str:
        return "".join(map(self.symbols.__getitem__, word.encode()))

    def greedy(self, s: str) -> list[int]:
        vocab, out, i, n = self.vocab, [], 0, len(s)
        while i < n:
            if n - i <= self.longest and (t := vocab.get(s[i:] + self.suffix)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (t := vocab.get(s[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"no token begins {s[i:]!r}")
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first.

        A heap of rank and place over a linked list, so a word of n symbols takes n log n steps.  An entry whose pair has
        changed since is passed over.
        """
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(step[0] << PLACE) | i for i in range(n - 1) if (step := get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), 1 << PLACE)
            j = after[i]
            if j >= n or (step := get((ids[i], ids[j]))) is None or step[0] != rank:
                continue
            ids[i], ids[j] = step[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if step := get((ids[i], ids[k])):
                    heappush(heap, (step[0] << PLACE) | i)
            if (h := before[i]) >= 0 and (step := get((ids[h], ids[i]))):
                heappush(heap, (step[0] << PLACE) | h)
        return [x for x in ids if x >= 0]

    def symbol_ids(self, s: str) -> list[int]:
        return [self.vocab[c] for c in s[:-1]] + [self.vocab[s[-1] + self.suffix]]

    def token_symbols(self, t: int) -> list[int]:
        stack, out = [t], []
        while stack:
            x = stack.pop()
            if self.left[x] < 0:
                out.append(int(x))
            else:
                stack += [int(self.right[x]), int(self.left[x])]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: does the boundary between the two tokens survive all merges?

        Going back in time, the two tokens at the boundary are replaced by their parts, the younger first.  The
        boundary is lost if the pair at it could merge before the step that just was undone; at equal
        rank the left place goes first, so an undone step of the right token gives way to the pair.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        l, r = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NONE, np.int64)  # a pair of rank below this merges across the boundary
        while len(at):
            key = (l << 32) | r
            i = np.searchsorted(self.pair_keys, key)
            lost = (self.pair_keys[i] == key) & (self.pair_rank[i] < limit)
            good[at[lost]] = False
            bl, br = self.birth[l], self.birth[r]
            left = bl > br
            done = lost | ((bl < 0) & (br < 0))
            same = (bl == br) & ~done  # the same merge made both: the left one was made first, so undo the right one
            left &= ~same
            step = np.where(left, bl, br + 1)
            l, r = np.where(left, self.right[l], l), np.where(left, r, self.left[r])
            limit = step
            at, l, r, limit = at[~done], l[~done], r[~done], limit[~done]
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before and remember their ids."""
        strings = [self.symbols_of(w) for w in words]
        spec = [self.greedy(s) for s in strings]
        lengths = np.fromiter(map(len, spec), np.int64, len(spec))
        ids = np.fromiter((t for x in spec for t in x), np.int64, int(lengths.sum()))
        for t in np.unique(ids[self.sound[ids] == 0]):
            self.sound[t] = 1 if self.merged(self.token_symbols(int(t))) == [t] else 2
        owner = np.repeat(np.arange(len(spec)), lengths)
        bad = np.zeros(len(spec), bool)
        bad[owner[self.sound[ids] == 2]] = True
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique((ids[:-1][inner] << 32) | ids[1:][inner], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        bad[owner[:-1][inner][~fine[back]]] = True
        for k in np.flatnonzero(bad):
            spec[k] = self.merged(self.symbol_ids(strings[k]))
        self.new_words += len(words)
        self.exact_words += int(bad.sum())
        for w, x in zip(words, spec):
            self.known[w] = np.array(x, "<u4").tobytes()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known = self.fresh()
        split = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        new = {w for words in split for w in words} - known.keys()
        if new:
            self.learn(sorted(new))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: token strings joined by a space."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per document: the id and any of ``n_tokens``, ``ids`` (array), ``decoded``, ``ids_sha256``, ``decoded_sha256``."""
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<long>", pa.list_(pa.int64())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    source = docs.select(id_col, text_col)
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, " + ", ".join(f"{o} {kinds[o][0]}" for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = bpe.encode_many(part.column(1).to_pylist())
                decoded = [bpe.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & set(outputs) else None
                made = {
                    "n_tokens": lambda: [len(x) // 4 for x in ids],
                    "ids": lambda: [np.frombuffer(x, "<u4").astype(np.int64) for x in ids],
                    "decoded": lambda: [x.decode() for x in decoded],
                    "ids_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in decoded],
                }
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(made[o](), kinds[o][1]) for o in outputs)], names=[id_col, *outputs])

    return map_arrow(source, run, schema)
