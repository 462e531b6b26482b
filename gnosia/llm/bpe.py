"""Operator 1: byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of every distinct pre-token at once (a walk down a dense trie, all words in
step). A proposal is the exact BPE result if and only if each adjacent token pair is compatible: no merge across their
border comes before the merges that build the two tokens. That check is one vectorised loop over all distinct pairs;
only words with an incompatible pair are merged exactly.

Results: a null text is encoded as the empty text (no tokens, decoded text empty); special tokens written in a text
become their ids, as in the tokenizers library; whole texts of any length; equal texts have equal ids; repeated rows
stay; an empty table gives an empty one; columns named like an output, whatever their case, are replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gnosia.llm.common import map_texts
from gnosia.llm.textvec import gather

#: Unicode white space, as the pattern of byte-level BPE sees it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_COARSE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The published pattern of byte-level BPE (a fixed value).
_FINE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Beyond these blocks, versions of Unicode differ on what is a letter; the library itself splits such chunks.
_ODD = re.compile("[^\\u0000-\\u0557\\u1e00-\\u1eff\\u2010-\\u2070\\u20a0-\\u20af\\u3040-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3]")
#: Letters and digits up to extended Latin, where all versions of Unicode agree.
_LETTER, _NUMBER = ("".join(c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]) if unicodedata.category(c)[0] == kind) for kind in "LN")
#: Distinct pre-tokens remembered by a worker (some 200 bytes each); beyond it, all are forgotten.
CACHE = 400_000
#: Longer pre-tokens are not proposed greedily but merged exactly at once: the same ids.
LONG = 256
#: The rank of a pair that has no merge.
NONE = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """Numbers unseen keys in order and lists them."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        i = self[key] = len(self)
        self.new.append(key)
        return i


class _Rows:
    """Arrays of ids, one after the other, read by number."""

    def __init__(self) -> None:
        self.flat, self.at, self.len = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        n, used = self.n + lens.size, self.used + ids.size
        if n > self.at.size:
            self.at, self.len = np.resize(self.at, 2 * n), np.resize(self.len, 2 * n)
        if used > self.flat.size:
            self.flat = np.resize(self.flat, 2 * used)
        self.flat[self.used : used] = ids
        self.len[self.n : n] = lens
        self.at[self.n : n] = self.used + np.cumsum(lens) - lens
        self.n, self.used = n, used

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.len[numbers]
        return self.flat[gather(self.at[numbers], lens)], lens


class Bpe:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    #: Byte that ends each word (none here); UTF-8 never has 0xFF.
    END = b""
    #: Texts of these characters are split by _SPLIT, the same pattern written out; others chunk by chunk.
    _PLAIN = re.compile("[\0-\x7f\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20af]*")
    _SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\t-\r {_LETTER}{_NUMBER}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

    def check(self, spec: dict) -> None:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or model.get("end_of_word_suffix"):
            raise ValueError("only byte-level BPE without a normalizer, suffix or prefix space is supported")

    def __init__(self, source: str) -> None:
        self.source, self._library, self._merges = source, None, None
        spec = json.loads(source)
        self.check(spec)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for k, v in vocab.items():
            last = suffix and k.endswith(suffix)
            self.bytes[v] = bytes(alphabet[c] for c in (k[: -len(suffix)] if last else k)) + (self.END if last else b"")
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        #: Tokens of a single byte, inside a word and at its end.
        self.base, self.base_end = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for v in vocab.values():
            b = self.bytes[v]
            if len(b) == 1:
                self.base[b[0]] = v
            elif len(b) == 2 and self.END and b[1:] == self.END:
                self.base_end[b[0]] = v
        if not self.END:
            self.base_end = self.base
        if (self.base < 0).any() or (self.base_end < 0).any():
            raise ValueError("the vocabulary lacks some bytes")
        #: How each token is built: its two parts and the rank of that merge (-1: a single byte).
        self.left, self.right, self.rank = np.arange(n), np.arange(n), np.full(n, -1, np.int64)
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.sound = True
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]  # a suffix can only end the right part
            self.sound &= bool(self.rank[z] < 0 and (x, y) not in merges)
            merges.setdefault((x, y), (rank, z))
            self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.array([x * n + y for x, y in merges], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank, self.n = keys[order], np.array([r for r, _ in merges.values()], np.int64)[order], n
        self.made = np.zeros(len(model["merges"]), np.int64)
        self.made[[r for r, _ in merges.values()]] = [z for _, z in merges.values()]
        units = {*self.base.tolist(), *self.base_end.tolist()}
        self._trie([(self.bytes[v], v) for v in vocab.values() if (v in units or self.rank[v] >= 0) and not (self.END and self.END in self.bytes[v][:-1] + self.bytes[v][:1])])
        self.forget()

    def __getstate__(self) -> dict:
        """What a broadcast carries: arrays and the source, without what was remembered."""
        return {k: v for k, v in self.__dict__.items() if k not in ("pres", "pre_ids")} | {"_library": None, "_merges": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    @property
    def library(self):
        """The library's own tokenizer, for characters on which versions of Unicode differ."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source)
        return self._library

    @property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """pair -> (rank, token), for long words only."""
        if self._merges is None:
            self._merges = {(k // self.n, k % self.n): (r, int(self.made[r])) for k, r in zip(self.pair_key.tolist(), self.pair_rank.tolist(), strict=True)}
        return self._merges

    def _trie(self, tokens: list[tuple[bytes, int]]) -> None:
        """The trie's edges (node, byte) -> node in one open hash table, and the token that ends at each node."""
        child: dict[int, int] = {}
        token = [-1]
        for b, v in tokens:
            at = 0
            for x in b:
                if (to := child.get(at << 8 | x)) is None:
                    to = child[at << 8 | x] = len(token)
                    token.append(-1)
                at = to
            token[at] = v
        self.node_token = np.array(token, np.int32)
        bits = max(4, (2 * len(child)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.edge_key, self.edge_to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys = np.array(list(child), np.int64)
        for key, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), child.values(), strict=True):
            while self.edge_key[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.edge_key[slot], self.edge_to[slot] = key, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that each byte leads to, -1 where none."""
        key = node << 8 | byte
        slot = self._slot(key)
        found = self.edge_key[slot]
        out = np.where(found == key, self.edge_to[slot], -1).astype(np.int64)
        live = np.flatnonzero((found != key) & (found >= 0))
        while live.size:
            slot[live] = (slot[live] + 1) & self.mask
            found = self.edge_key[slot[live]]
            hit = found == key[live]
            out[live[hit]] = self.edge_to[slot[live[hit]]]
            live = live[~hit & (found >= 0)]
        return out

    def forget(self) -> None:
        self.pres, self.pre_ids = _Memo(), _Rows()

    # ---- pre-tokens

    def coarse(self, text: str) -> list[str]:
        """Chunks between which no pre-token reaches: a word with the space before it, or white space."""
        if self.split is None or not self.split.search(text):
            return _COARSE.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [*_COARSE.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + _COARSE.findall(text[at:])

    def fine(self, chunk: str) -> list[str]:
        if chunk.isascii() and (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return [chunk]
        if _ODD.search(chunk):
            return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return _FINE.findall(chunk)

    # ---- speculate, verify, repair

    def greedy(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words in step: (tokens in order of word, -1 where none fits; tokens of each word)."""
        pos, end, active = starts.copy(), starts + lens, np.flatnonzero(lens > 0)
        who, what = [], []
        while active.size:
            cur, stop = pos[active], end[active]
            node, best, upto = np.zeros(active.size, np.int64), np.full(active.size, -1, np.int64), cur.copy()
            live = np.arange(active.size)
            while live.size:
                live = live[cur[live] < stop[live]]
                to = self.step(node[live], buf[cur[live]])
                live, to = live[to >= 0], to[to >= 0]
                node[live] = to
                cur[live] += 1
                token = self.node_token[to]
                ok = token >= 0
                best[live[ok]], upto[live[ok]] = token[ok], cur[live[ok]]
            who.append(active)
            what.append(best)
            upto[best < 0] = stop[best < 0]  # nothing matches: the word is merged exactly
            pos[active] = upto
            active = active[upto < stop]
        if not who:
            return np.zeros(0, np.int64), np.zeros(starts.size, np.int64)
        w = np.concatenate(who)
        return np.concatenate(what)[np.argsort(w, kind="stable")], np.bincount(w, minlength=starts.size)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each token a next to token b apart.

        Both tokens are taken apart from their latest merge back; at each moment the two parts at the border must have
        no merge of their own that comes before the next merge on either side. On equal ranks the left pair goes first.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(a.size, bool)
        # the rank before which a merge across the border would come first, on either side
        until_a, until_b = np.full(a.size, NONE), np.full(a.size, NONE - 1)
        live = np.arange(a.size)
        while live.size:
            x, y = a[live], b[live]
            cross = self.ranks(x, y)
            bad = (cross < until_a[live]) & (cross <= until_b[live])
            ok[live[bad]] = False
            ra, rb = self.rank[x], self.rank[y]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, x, y, ra, rb = live[go], x[go], y[go], ra[go], rb[go]
            # of two merges of one rank the left one ran first, so the right one is undone first
            back = ra > rb
            p, q = live[back], live[~back]
            a[p], until_a[p] = self.right[x[back]], ra[back]
            b[q], until_b[q] = self.left[y[~back]], rb[~back]
        return ok

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE if there is none."""
        key = a * self.n + b
        j = np.minimum(np.searchsorted(self.pair_key, key), self.pair_key.size - 1)
        return np.where(self.pair_key[j] == key, self.pair_rank[j], NONE)

    def exact_all(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words in step: each round runs the first of the lowest-ranked merges of every word."""
        n = len(self.END)
        token, word = self.base[buf[gather(starts, lens - n)]], np.repeat(np.arange(starts.size), lens - n)
        token[np.cumsum(lens - n) - 1] = self.base_end[buf[starts + lens - n - 1]]
        rank = np.full(token.size, NONE)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.ranks(token[same], token[same + 1])
        ended_w, ended_t = [], []
        while token.size:
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, token.size)))
            done = least == NONE
            if done.any():
                ended_w.append(word[done])
                ended_t.append(token[done])
                token, word, rank, least = token[~done], word[~done], rank[~done], least[~done]
            at = np.flatnonzero(rank == least)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if at.size else at
            if not at.size:
                break
            token[at] = self.made[least[at]]
            stay = np.ones(token.size, bool)
            stay[at + 1] = False
            token, word, rank = token[stay], word[stay], rank[stay]
            at -= np.arange(at.size)
            for i in (at, at - 1):
                i = i[(i >= 0) & (i + 1 < token.size)]
                rank[i] = np.where(word[i] == word[i + 1], self.ranks(token[i], token[i + 1]), NONE)
            if at[-1] == token.size - 1:
                rank[-1] = NONE
        w = np.concatenate([*ended_w, np.zeros(0, np.int64)])
        return np.concatenate([*ended_t, np.zeros(0, np.int64)])[np.argsort(w, kind="stable")], np.bincount(w, minlength=starts.size)

    def exact(self, word: bytes) -> list[int]:
        """The same for one long word, with a heap over a linked list."""
        body = np.frombuffer(word[: len(word) - len(self.END)], np.uint8)
        ids = [*self.base[body[:-1]].tolist(), int(self.base_end[body[-1]])]
        n, get = len(ids), self.merges.get
        nxt, prv = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = nxt[i] if i < n else n
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if m := get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            if (h := prv[i]) >= 0 and (m := get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one word after the other, ids of each word)."""
        raw = [w.encode() + self.END for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        buf = np.frombuffer(b"".join(raw), np.uint8)
        short = (lens <= LONG) & self.sound
        tokens, counts = self.greedy(buf, np.cumsum(lens) - lens, np.where(short, lens, 0))
        word = np.repeat(np.arange(len(raw)), counts)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, of = np.unique(tokens[inside] * self.n + tokens[inside + 1], return_inverse=True)
        bad = ~short
        bad[word[tokens < 0]] = True
        bad[word[inside[~self.compatible(pairs // self.n, pairs % self.n)[of]]]] = True
        if not bad.any():
            return tokens, counts
        starts = np.cumsum(lens) - lens
        wrong = np.flatnonzero(bad & (lens <= LONG))
        fixed, sizes = self.exact_all(buf, starts[wrong], lens[wrong])
        out_counts = counts.copy()
        out_counts[wrong] = sizes
        long = np.flatnonzero(bad & (lens > LONG))
        merged = [self.exact(raw[i]) for i in long.tolist()]
        out_counts[long] = [len(x) for x in merged]
        out, ends = np.empty(int(out_counts.sum()), np.int64), np.cumsum(out_counts)
        out[np.repeat(~bad, out_counts)] = tokens[~bad[word]]
        out[gather(ends[wrong] - sizes, sizes)] = fixed
        for i, x in zip(long.tolist(), merged, strict=True):
            out[ends[i] - len(x) : ends[i]] = x
        return out, out_counts

    def _plain(self, text: str) -> bool:
        return self._PLAIN.fullmatch(text) is not None and not (self.special and "<|" in text and self.split.search(text))

    def parts(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens are such."""
        if self._plain(text):
            return self._SPLIT.findall(text)
        out: list[str] = []
        for c in self.coarse(text):
            if c in self.special:
                out.append(c)
            else:
                out += self._SPLIT.findall(c) if self._PLAIN.fullmatch(c) else self.fine(c)
        return out

    def _given(self, part: str) -> list[int] | None:
        """Ids of a pre-token that is not merged."""
        return [self.special[part]] if part in self.special else None

    def _learn(self) -> None:
        """Encode the pre-tokens that were seen for the first time."""
        new = self.pres.new
        if not new:
            return
        self.pres.new = []
        given = [self._given(p) for p in new]
        own = np.fromiter((g is None for g in given), bool, len(new))
        ids, lens = self.encode_words(new if own.all() else [p for p, g in zip(new, given, strict=True) if g is None])
        if not own.all():
            sizes = np.empty(len(new), np.int64)
            sizes[own], sizes[~own] = lens, [len(g) for g in given if g is not None]
            out = np.empty(int(sizes.sum()), np.int64)
            out[np.repeat(own, sizes)] = ids
            out[np.repeat(~own, sizes)] = [t for g in given if g is not None for t in g]
            ids, lens = out, sizes
        self.pre_ids.add(ids, lens)

    def encode(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, where each text's ids begin and the last's end)."""
        if len(self.pres) > CACHE:
            self.forget()
        number, parts, counts = self.pres.__getitem__, [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts.to_pylist() if isinstance(texts, pa.Array) else texts):
            got = self.parts(text)
            counts[i] = len(got)
            parts.append(np.fromiter(map(number, got), np.int64, len(got)))
        self._learn()
        ids, lens = self.pre_ids.take(np.concatenate(parts))
        return ids, np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


class WordBpe(Bpe):
    """BPE over lower-cased words with a mark at their end; white space is dropped.

    The normalizer and the split work within runs of non-space. Runs with characters beyond extended Latin, where
    versions of Unicode and context matter, go through the library itself.
    """

    END = b"\xff"
    _RUN = re.compile("[^\t-\r ]+")
    #: The published pattern of this vocabulary (a fixed value).
    _PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    _PLAIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20af]*")
    _SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t-\r {_LETTER}{_NUMBER}]+")
    #: Stands before a run that goes through the library.
    _LIBRARY = "\n"

    def check(self, spec: dict) -> None:
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        ok = spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") and steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        if not ok or pre[0]["pattern"].get("Regex") != self._PART.pattern:
            raise ValueError("only word BPE with this normalizer and split is supported")

    def parts(self, text: str) -> list[str]:
        if "<|" not in text and self._PLAIN.fullmatch(text):
            return self._SPLIT.findall(text.lower())
        out: list[str] = []
        for run in self._RUN.findall(text):
            out += self._SPLIT.findall(run.lower()) if "<|" not in run and self._PLAIN.fullmatch(run) else [self._LIBRARY + run]
        return out

    def _given(self, part: str) -> list[int] | None:
        return self.library.encode(part[1:], add_special_tokens=False).ids if part[0] == self._LIBRARY else None


@lru_cache(2)
def model(source: str) -> Bpe:
    return (WordBpe if json.loads(source)["model"].get("end_of_word_suffix") else Bpe)(source)


def broadcast(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary of a file that only the driver needs to see, built there and sent as arrays of some 10 MB."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(model(f.read()))


#: What encode() can return for a text.
OUTPUTS = {
    "n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def encode(df: DataFrame, tokenizer: str, text: str = "text", outputs: Sequence[str] = ("n_tokens", "ids")) -> DataFrame:
    """Add the outputs asked for to every row.

    tokenizer: path of the vocabulary file, read on the driver. ids: little-endian unsigned 32-bit integers; decoded:
    the text that the ids decode to; the digests are of these two. No shuffle.
    """
    shared = broadcast(df, tokenizer)
    names = list(outputs)

    def make():
        bpe = shared.value

        def fn(texts: pa.Array) -> dict:
            ids, ends = bpe.encode(texts)
            ids = ids.astype("<u4", copy=False)
            mem, ends4 = ids.view(np.uint8).data, (4 * ends).tolist()
            out: dict = {"n_tokens": pa.array(np.diff(ends))}
            spans = list(zip(ends4[:-1], ends4[1:], strict=True))
            if "ids" in names:
                out["ids"] = pa.array([bytes(mem[a:b]) for a, b in spans], pa.binary())
            if "ids_sha256" in names:
                out["ids_sha256"] = [hashlib.sha256(mem[a:b]).hexdigest() for a, b in spans]
            if "decoded" in names or "decoded_sha256" in names:
                back = [bpe.decode(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                out["decoded"] = back
                out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in back]
            return out

        return fn

    return map_texts(df, [T.StructField(x, OUTPUTS[x]) for x in names], make, text)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Replace or add `into`: the text of a binary column of little-endian 32-bit ids (null: the empty text)."""
    shared = broadcast(df, tokenizer)
    rest = [c for c in df.columns if c.lower() != into.lower()]
    at = rest.index(ids)
    schema = T.StructType([*df.select(*[f"`{c}`" for c in rest]).schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        bpe = shared.value
        for batch in batches:
            back = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, into])

    return df.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)
