"""BPE with word ends, by speculation: longest match proposes, pair checks verify, exact merging mends.

A text is cut at special tokens, then at white space; what lies between (a chunk) encodes the same wherever it
stands, so each distinct chunk is encoded once per task and kept in a bounded table.  New chunks are cut into
words by the tokenizer's pattern and encoded together: greedy longest match proposes tokens for every word,
every adjacent pair of every proposal is checked at once with arrays, and only words with a failing pair go
through exact merging.

Why pairs suffice: two adjacent tokens stand in the
result of merging if no merge across their border comes before the border's two sides are complete.  Undo
the tokens' last merges, latest first, and look at the two pieces that touch the border each time: if a rule
joins them earlier than the merge just undone, the pair fails.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np
import regex

from .common import remembered

#: What a worker remembers these tables as.
OWNER = "bpe"
#: White space as Unicode defines it; ``str.split`` also splits at the four separators 1C to 1F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: What the pattern takes as a word of its own after letters.
CLOSING = frozenset(",.;:!?)]}")
#: Chunks kept per process in the newer of two tables; when it is full, it becomes the older one, which is let go.
TABLE = 500_000
BIG = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


def recall(wanted: set[str], newer: dict[str, bytes], older: dict[str, bytes]) -> tuple[dict[str, bytes], dict[str, bytes], set[str]]:
    """The newer and the older table, with what either has of ``wanted`` in the newer, and what neither has."""
    new = wanted.difference(newer)
    if new and len(newer) + len(new) > TABLE:
        newer, older, new = {}, newer, wanted
    back = older.keys() & new if older else set()
    newer.update(zip(back, map(older.__getitem__, back)))
    return newer, older, new - back


class WordBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.letters = byte_letters()
        self.letter_table = {i: c for i, c in enumerate(self.letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(self.vocab.values()) + 1
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        key = np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.key_rank = key[order], order.astype(np.int64)
        letters = [self.vocab[c + e] for c in self.letters for e in ("", self.end)]
        self.square = np.full((max(letters) + 1,) * 2, BIG)  # the ranks of rules that join two letters
        both = (max(letters) >= key >> 20) & (max(letters) >= key & ((1 << 20) - 1))
        self.square[key[both] >> 20, key[both] & ((1 << 20) - 1)] = np.flatnonzero(both)
        self.left, self.right = np.arange(n), np.arange(n)
        self.left[self.made], self.right[self.made] = key >> 20, key & ((1 << 20) - 1)
        self.when = np.full(n, -1, np.int64)  # the rank that makes a token; -1: a letter
        self.when[self.made] = np.arange(len(pairs))
        self.text = [""] * (max(n, *(i + 1 for i in self.special.values())))
        for s, i in chain(self.vocab.items(), self.special.items()):
            self.text[i] = s
        self.sound = self._sound(n)
        good = [(s, i) for s, i in self.vocab.items() if self.sound[i]]
        self.final = {s.removesuffix(self.end): i for s, i in good if s.endswith(self.end)}
        self.inner = {s: i for s, i in good if not s.endswith(self.end)}
        by_start: dict[str, set[int]] = {}
        for s in self.inner:
            by_start.setdefault(s[:4], set()).add(len(s))
        self.sizes = {k: (*sorted(v, reverse=True), 3, 2, 1) for k, v in by_start.items() if len(k) == 4}  # to try, by the first four letters
        self.table: dict[str, bytes] = {}
        self.word_table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def _sound(self, n: int) -> np.ndarray:
        """Tokens that merging makes of their own letters."""
        out = np.ones(n, bool)
        out[self.made] = self.compatible(self.left[self.made], self.right[self.made], self.when[self.made])
        for i in np.argsort(self.when, kind="stable"):  # parts come first
            if self.when[i] >= 0:
                out[i] &= out[self.left[i]] and out[self.right[i]]
        return out

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the rule that joins a and b; BIG if none does."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], BIG)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether no rule acts across the border (before ``limit``, where given)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        late = np.zeros(len(a), bool)  # the present pieces change by a merge of the right side alone
        until = np.full(len(a), BIG) if limit is None else limit.astype(np.int64)
        # from the pieces as they are at the end, back in time; ``until`` is the rank at which the present pieces change
        while len(live):
            x, y, u = a[live], b[live], until[live]
            r, wx, wy = self.joins(x, y), self.when[x], self.when[y]
            # x and y lie side by side until rank u: a rule of a lower rank would have joined them
            # before; of equal ranks the left pair acts first, so the border wins over a merge of the right side only
            bad = (r < u) | ((r == u) & late[live])
            good[live[bad]] = False
            undo_x = wx > wy
            done = (wx < 0) & (wy < 0)
            until[live] = np.where(undo_x, wx, np.where(wy > wx, wy, wx))
            undo_both = (wx == wy) & ~done
            late[live] = wy > wx
            a[live] = np.where(undo_x | undo_both, self.right[x], x)
            b[live] = np.where(~undo_x & ~undo_both & ~done, self.left[y], np.where(undo_both, self.left[y], y))
            live = live[~bad & ~done]
        return good

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each round every word joins its lowest-ranked pair, from the left.

        The ids of all words, one after the other, and how many each has.
        """
        vocab, end = self.vocab, self.end
        ids = np.fromiter(chain.from_iterable([*map(vocab.__getitem__, w[:-1]), vocab[w[-1] + end]] for w in words), np.int64)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.append(np.where(owner[1:] == owner[:-1], self.square[ids[:-1], ids[1:]], BIG), BIG)
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(rank, first)
            per = np.repeat(low, np.diff(np.append(first, len(ids))))
            over = per == BIG
            if over.any():
                done.append((owner[over], ids[over]))
                ids, owner, rank, per = ids[~over], owner[~over], rank[~over], per[~over]
                if not len(ids):
                    break
            hit = rank == per
            # in a run of hits (one pair of equal letters over and over) only every second one joins, from the left
            start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), np.arange(len(hit)), -1))
            hit &= (np.arange(len(hit)) - start) % 2 == 0
            at = np.flatnonzero(hit)
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            touched = np.zeros(len(ids), bool)
            touched[at] = True
            ids, owner, rank, touched = ids[stay], owner[stay], rank[stay], touched[stay]
            touched[:-1] |= touched[1:]
            t = np.flatnonzero(touched)
            nxt = np.minimum(t + 1, len(ids) - 1)
            rank[t] = np.where((t + 1 < len(ids)) & (owner[nxt] == owner[t]), self.joins(ids[t], ids[nxt]), BIG)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, ids = np.concatenate([o for o, _ in done]), np.concatenate([i for _, i in done])
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def greedy(self, word: str) -> list[int] | None:
        """Longest match from the left over the word's letters; the last token ends the word."""
        out, i, n, inner, final, sizes = [], 0, len(word), self.inner, self.final, self.sizes
        while i < n:
            if (t := final.get(word[i:])) is not None:
                out.append(t)
                return out
            for size in sizes.get(word[i : i + 4], (3, 2, 1)):
                if i + size < n and (t := inner.get(word[i : i + size])) is not None:
                    break
            else:
                return None
            out.append(t)
            i += size
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words in the letters that stand for bytes; ids as little-endian unsigned 32-bit numbers."""
        guess = [self.greedy(w) for w in words]
        known = [g if g is not None else [] for g in guess]
        size = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.int64, int(size.sum()))
        failed = np.zeros(len(words), bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), size)
            inner = owner[1:] == owner[:-1]
            bad = ~self.compatible(flat[:-1][inner], flat[1:][inner])
            failed[owner[1:][inner][bad]] = True
        out = self.pieces(flat, size)
        again = [i for i, g in enumerate(guess) if g is None or failed[i]]
        for i, ids in zip(again, self.pieces(*self.merge([words[i] for i in again]))):
            out[i] = ids
        return out

    @staticmethod
    def pieces(ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Runs of ``ids`` of the given sizes, as little-endian unsigned 32-bit numbers."""
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def spell(self, word: str) -> str:
        """In the letters that stand for bytes."""
        return word if word.isascii() and word.isalpha() else word.encode("utf-8").decode("latin-1").translate(self.letter_table)

    def words_of(self, chunk: str) -> tuple[str, ...]:
        if chunk.isascii():
            s = chunk.lower()
        else:
            s = unicodedata.normalize("NFC", chunk)
            s = "".join(map(str.lower, s)) if "Σ" in s else s.lower()  # letter by letter: no final sigma
        if s.isalpha():
            return (self.spell(s),)
        if s[-1] in CLOSING and (body := s[:-1]).isalpha():
            return self.spell(body), s[-1]
        return tuple(map(self.spell, self.words.findall(s)))

    def learn(self, chunks: list[str]) -> None:
        parts = [self.words_of(c) for c in chunks]
        self.word_table, self.older_words, new = recall(set(chain.from_iterable(parts)), self.word_table, self.older_words)
        new = list(new)
        self.word_table.update(zip(new, self.encode_words(new)))
        known = self.word_table.__getitem__
        self.table.update(zip(chunks, [known(ws[0]) if len(ws) == 1 else b"".join(map(known, ws)) for ws in parts]))

    def chunks(self, text: str) -> list[str]:
        """White-space chunks, with special tokens as chunks of their own."""
        if "<|" in text and self.cut.search(text):
            return [c for i, part in enumerate(self.cut.split(text)) for c in ([part] if i % 2 else self.split(part))]
        return self.split(text)

    @staticmethod
    def split(text: str) -> list[str]:
        return [c for c in SPACE.split(text) if c] if ODD_SPACE.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[list[str]]:
        """The chunks of each text, all of them in ``table`` afterwards."""
        out = [self.chunks(t) if t else [] for t in texts]
        self.table, self.older, new = recall(set().union(*out), self.table, self.older)
        if new:
            for s in new & self.special.keys():
                self.table[s] = np.array([self.special[s]], "<u4").tobytes()
            self.learn(list(new - self.special.keys()))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As the file names no decoder: the tokens' own strings, joined by one space."""
        return " ".join([self.text[i] for i in ids])


def bpe(path: str) -> WordBpe:
    """One per worker process, so that its tables serve task after task (see ``remembered``)."""
    models = remembered(OWNER, dict)
    if path not in models:
        models.clear()
        models[path] = WordBpe(path)
    return models[path]
