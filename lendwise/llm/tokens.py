"""Byte-level BPE in tasks: a vocabulary file is read once on the driver and shipped to the tasks.

Encoding gives the ids of the tokenizers library for that file. Where merging by rank is the same thing (each merge of
the file makes the next higher id), the ids are made by the faster rank encoder from the same vocabulary, else by the
library itself. Special strings inside a text become their own id, as the library does by default.
"""

from __future__ import annotations

import json
from itertools import accumulate

import ahocorasick
import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

# Fixed value: how a byte-level vocabulary splits a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = "byte_bpe_50k.json"
BASE = 0x100000001B3F5A6D  # of the polynomial byte hashes
CACHE, CACHE_BYTES = 1 << 19, 1 << 26  # words and bytes a task remembers at once; beyond them the memory starts afresh


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file's content, to be shipped to tasks (a fixed file of a few MB)."""
    with open(path or public_tokenizers.path(DEFAULT), encoding="utf-8") as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks(content: str) -> dict[bytes, int] | None:
    """Token bytes to id, if merging the pair of lowest id is what the file's merge list does; else None."""
    model, letters = json.loads(content)["model"], byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or not all(set(t) <= letters.keys() for t in model["vocab"]):
        return None
    return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}


class Splitter:
    """Texts to segments (ordinary text or special string) and segments to words."""

    def __init__(self, content: str):
        added = {t["content"]: t["id"] for t in json.loads(content).get("added_tokens", [])}
        self.specials = added
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern = regex.compile(WORDS)
        self.library = Tokenizer.from_str(content).pre_tokenizer
        self.same: set[str] = set()  # characters around which the pattern and the library split alike
        self.other: set[str] = set()

    def segments(self, text: str) -> list[str]:
        """Ordinary texts at even places, special strings at odd ones."""
        return self.cut.split(text) if self.cut and any(s in text for s in self.specials) else [text]

    def _by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """The text's words. The two know different versions of the character tables: a text with a character that
        they take differently is left to the library."""
        new = set(text) - self.same
        for c in new - self.other:
            probe = f"a{c}1 {c}.{c} "
            (self.same if self._by_library(probe) == self.pattern.findall(probe) else self.other).add(c)
        return self.pattern.findall(text) if not new & self.other else self._by_library(text)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, content: str):
        self.split = Splitter(content)
        self.tokenizer = Tokenizer.from_str(content)
        by_rank = ranks(content)
        self.by_rank = by_rank and tiktoken.Encoding("by-rank", pat_str=WORDS, mergeable_ranks=by_rank, special_tokens={})
        self.blank = regex.compile(r"\s{1000}")  # runs of white space that are too deep for the rank encoder's pattern

    def _ordinary(self, text: str) -> bytes:
        if self.by_rank and not self.blank.search(text):
            return np.array(self.by_rank.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(np.array([self.split.specials[s]], "<u4").tobytes() if k % 2 else self._ordinary(s)
                        for k, s in enumerate(self.split.segments(text)))


class PrefixCounter:
    """Exact token counts of every prefix (in characters) of a text.

    Within a word a dynamic programme keeps, per prefix, the last token of its encoding: a token t ending at byte i
    continues the prefix before it exactly if BPE leaves (last token before, t) as these two tokens. Prefixes of a
    text are sums of whole words and one word prefix; the three places where cutting a text changes how it splits are
    computed apart: the last character of a run of white space, contractions, and the inside of special strings."""

    def __init__(self, content: str):
        self.split = Splitter(content)
        model = json.loads(content)["model"]
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.vocab = {spell(t): i for t, i in model["vocab"].items() if set(t) <= letters.keys()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(spell(a), spell(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.joins: dict[int, bool] = {}
        self.alone: dict[bytes, bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes of the counts in ``known``
        self.automaton = None  # of all tokens, made when the first long word comes
        self.runs = regex.compile(r"\s{2,}(?=\S)")
        # tokens by number, and their hashes in order, to look up many byte strings at once
        self.tokens = list(self.vocab)
        self.number = {t: k for k, t in enumerate(self.tokens)}
        # (rank, left, right) of the one merge that makes a token; single bytes have none
        made = {self.number[a + b]: (k, self.number[a], self.number[b]) for (a, b), k in self.rank.items()}
        self.made = [made.get(k, (-1, -1, -1)) for k in range(len(self.tokens))] if len(made) == len(self.rank) else []
        self.cross = {self.number[a] << 32 | self.number[b]: k for (a, b), k in self.rank.items()}
        hashes = np.array([self._hash(t) for t in self.tokens], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two tokens share a hash")

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _merge(self, piece: bytes) -> list[bytes]:
        parts = [piece[k:k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):  # every occurrence of the pair, from the left
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _is_token(self, piece: bytes) -> bool:
        """Whether BPE makes this one token of the piece."""
        ok = self.alone.get(piece)
        if ok is None:
            ok = self.alone[piece] = piece in self.vocab and self._merge(piece) == [piece]
        return ok

    def _apart(self, a: int, b: int) -> bool:
        """Whether BPE, having made tokens a and b side by side, never merges across their border. Merges are undone
        from the latest back; a pair across the border that ranks before the merge just undone would have been merged
        first. Of equal merges BPE takes the left one first."""
        cross, made, limit = self.cross, self.made, 1 << 60
        while True:
            rank = cross.get(a << 32 | b)
            if rank is not None and rank < limit:
                return False
            late_a, late_b = made[a][0], made[b][0]
            if late_a < 0 and late_b < 0:
                return True
            if late_a > late_b:
                limit, a = late_a, made[a][2]
            else:
                limit, b = late_b + 1, made[b][1]

    def _joins(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side."""
        key = a << 32 | b
        ok = self.joins.get(key)
        if ok is None:
            x, y = self.tokens[a], self.tokens[b]
            ok = self.joins[key] = self._is_token(y) and (self._apart(a, b) if self.made else self._merge(x + y) == [x, y])
        return ok

    def _ends(self, word: str):
        """(end, token, its length) of every occurrence of a token in a word whose characters are its bytes: by end, the
        longest first."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for k, t in enumerate(self.tokens):
                self.automaton.add_word(t.decode("latin-1"), (k, len(t)))
            self.automaton.make_automaton()
        return self.automaton.iter(word)

    def _bytes(self, word: bytes) -> list[int]:
        """Token count of every byte prefix of one word. Only the tokens that end at a byte are looked at, so the work
        grows with the word's length, whatever its letters."""
        last, count = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        joins = self.joins
        for at, (token, size) in self._ends(word.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                ok = joins.get(before << 32 | token)
                if ok is None:
                    ok = self._joins(before, token)
            else:
                ok = self._is_token(word[:end])
            if ok:
                last[end], count[end] = token, count[start] + 1
        if -1 in last[1:]:
            raise ValueError(f"no token ends at byte {last.index(-1, 1)} of {word[:80]!r}")
        return count[1:]

    def _many(self, raw: list[bytes]) -> np.ndarray:
        """The same for many words at once: rows of counts, of which a word's first ones count. All distinct prefixes
        of one length are solved together, so a beginning that many words share is solved once."""
        sizes = np.array([len(r) for r in raw])
        n = int(sizes.max())
        letters = np.frombuffer(b"".join(r.ljust(n) for r in raw), np.uint8).reshape(len(raw), n)
        prefix = np.zeros((len(raw), n + 1), np.uint64)
        for k in range(n):
            prefix[:, k + 1] = prefix[:, k] * np.uint64(BASE) + letters[:, k] + np.uint64(1)
        power = [1]
        for _ in range(n):
            power.append(power[-1] * BASE & 0xFFFFFFFFFFFFFFFF)
        last, count = np.full((len(raw), n + 1), -1, np.int32), np.zeros((len(raw), n + 1), np.int32)
        for end in range(1, n + 1):
            words = np.flatnonzero(sizes >= end)
            full, first, back = np.unique(prefix[words, end], return_index=True, return_inverse=True)
            rows = words[first]
            token, total, left = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int32), np.arange(len(rows))
            for start in range(max(0, end - self.longest), end):
                h = full[left] - prefix[rows[left], start] * np.uint64(power[end - start])
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[at] == h)
                if not len(hit):
                    continue
                some, new = left[hit], self.order[at[hit]]
                keys, same = np.unique(last[rows[some], start].astype(np.int64) << 32 | new, return_inverse=True)
                if start:
                    ok = [self._joins(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()]
                else:
                    ok = [self._is_token(self.tokens[k & 0xFFFFFFFF]) for k in keys.tolist()]
                good = np.array(ok)[same]
                token[some[good]], total[some[good]] = new[good], count[rows[some[good]], start] + 1
                left = left[token[left] < 0]
                if not len(left):
                    break
            if len(left):
                raise ValueError(f"no token ends at byte {end} of {raw[rows[left[0]]]!r}")
            last[words, end], count[words, end] = token[back], total[back]
        return count[:, 1:].astype("<u4")

    @staticmethod
    def _by_character(word: str, raw: bytes, counts: np.ndarray) -> bytes:
        if len(raw) == len(word):
            return counts[:len(raw)].tobytes()
        return counts[[e - 1 for e in accumulate(len(c.encode("utf-8")) for c in word)]].tobytes()

    def _learn(self, words: list[str]) -> None:
        """Remembers, per word, the token count of every character prefix, as unsigned 32-bit numbers."""
        if len(self.joins) > 4 * CACHE:
            self.joins = {}
        long = [w for w in words if len(w.encode("utf-8")) > 48]
        short = [w for w in words if len(w.encode("utf-8")) <= 48]
        for group in (short[k:k + 65536] for k in range(0, len(short), 65536)):
            raw = [w.encode("utf-8") for w in group]
            rows = self._many(raw) if len(group) >= 16 else [np.array(self._bytes(r), "<u4") for r in raw]
            for w, r, counts in zip(group, raw, rows, strict=True):
                self.known[w] = self._by_character(w, r, counts)
        for w in long:
            raw = w.encode("utf-8")
            self.known[w] = self._by_character(w, raw, np.array(self._bytes(raw), "<u4"))
        self.held += sum(len(self.known[w]) + len(w) for w in words)
        for w in set(words) & {"'re", "'ve", "'ll"}:  # cut after two characters, these split into a quote and a letter
            counts = np.frombuffer(self.known[w], "<u4").copy()
            counts[1] = self._total("'") + self._total(w[1])
            self.known[w] = counts.tobytes()

    def _word(self, word: str) -> bytes:
        if word not in self.known:
            self._learn([word])
        return self.known[word]

    def _total(self, word: str) -> int:
        return int.from_bytes(self._word(word)[-4:], "little")

    def _segment(self, text: str, words: list[str]) -> np.ndarray:
        known = self.known
        if not words:
            return np.zeros(0, np.int64)
        counts = [known[w] for w in words]
        lengths = np.array([len(c) >> 2 for c in counts])
        inside = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
        ends = np.cumsum(lengths)
        base = np.concatenate([[0], np.cumsum(inside[ends - 1])[:-1]])
        out = inside + np.repeat(base, lengths)
        for run in self.runs.finditer(text):
            before = out[run.start() - 1] if run.start() else 0
            out[run.end() - 1] = before + self._total(run.group())
        return out

    def _learned(self, text: str) -> list[str]:
        words = self.split.words(text)
        if missing := set(words).difference(self.known):
            self._learn(list(missing))
        return words

    def counts(self, text: str) -> np.ndarray:
        """counts[k]: tokens of the first k + 1 characters."""
        return next(self.counts_of([text]))

    def counts_of(self, texts: list[str]):
        """The counts of many texts, whose words are learned together."""
        if len(self.known) > CACHE or self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        cut = [self.split.segments(t) for t in texts]
        words = [[self.split.words(s) if k % 2 == 0 else [] for k, s in enumerate(segments)] for segments in cut]
        missing = set()
        for lists in words:
            missing.update(*lists)
        self._learn(list(missing.difference(self.known)))
        for segments, lists in zip(cut, words, strict=True):
            yield self._joined(segments, lists)

    def _joined(self, segments: list[str], words: list[list[str]]) -> np.ndarray:
        parts, base, before = [], 0, ""
        for k, segment in enumerate(segments):
            if k % 2:
                start = parts[-1][0]
                inner = [start + self._segment(before + segment[:n], self._learned(before + segment[:n]))[-1]
                         for n in range(1, len(segment))]
                base += 1
                parts.append((base, np.array([*inner, base], np.int64)))
            else:
                own = self._segment(segment, words[k])
                parts.append((base, own + base))
                base += int(own[-1]) if len(own) else 0
            before = segment
        return np.concatenate([p for _, p in parts])
