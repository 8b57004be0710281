"""Pre-tokens of a word-end BPE tokenizer file, and its merges as an encoder and a decoder.

``Pretokenizer`` gives the pre-tokens that the tokenizers library gives. ``PrefixEncoder`` turns a
pre-token into ids by dynamic programming over its prefixes, without running the merges.
"""

from __future__ import annotations

import codecs
import functools
import json
import re

import ahocorasick

#: Latin-1 lower-case letters, digits and white space as the tokenizer's pattern sorts them.
_LETTER, _DIGIT, _BLANK = r"a-zªµºß-öø-ÿ", r"0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_WORDS = re.compile(rf"[{_LETTER}]+|[{_DIGIT}]|'(?:[stmd]|re|ve|ll)|[^{_LETTER}{_DIGIT}{_BLANK}]+")
#: Seams between two tokens that an encoder remembers.
KNOWN_PAIRS = 200_000
#: Stands for the end of a word inside the automaton; byte-level text never holds it.
_END = "\ue000"


def _byte_chars() -> str:
    """The character that byte-level tokenizers write for each byte: itself if it prints, else the next from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in prints else chr(next(rest)) for b in range(256))


_CHARS = _byte_chars()


def byte_level(word: str) -> str:
    return codecs.charmap_decode(word.encode(), "strict", _CHARS)[0]


class Pretokenizer:
    """Splits a text at special tokens, then into the pre-tokens of the file's normalizer and pattern.

    Texts within Latin-1 take a compiled pattern; others go through the library's own normalizer and
    splitter, because Unicode tables differ between libraries.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._hint = [t[:2] for t in self.special]

    def parts(self, text: str) -> list[str]:
        """Plain parts and special tokens in turn: odd places hold special tokens."""
        if self._split is None or not any(h in text for h in self._hint):
            return [text]
        return self._split.split(text)

    def words(self, part: str) -> list[str]:
        """The pre-tokens of a plain part, before bytes are mapped to characters."""
        try:
            part.encode("latin-1")
        except UnicodeEncodeError:
            plain = self.library.normalizer.normalize_str(part)
            return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return _WORDS.findall(part.lower())


class PrefixEncoder:
    """The ids of a word by dynamic programming over its prefixes.

    An automaton over the vocabulary yields every token that ends at each place. For each prefix
    exactly one of them is the last token of the prefix's encoding: the one that is compatible with
    the last token of the prefix before it. Following these tokens back from the end gives the ids.
    Two tokens are compatible if no merge across their seam would come before the merges that build
    them; walking up both sides of the seam in order of rank decides it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"] or ""
        own = lambda t: t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t
        vocab = {own(t): i for t, i in model["vocab"].items()}
        self.names = {i: t for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[own(a)], vocab[own(b)], vocab[own(a) + own(b)]
            self.rank[x, y] = r
            made.setdefault(z, (r, x, y))
        never = len(model["merges"])
        self.never = never
        #: For each token, the tokens along its left and right edge from a base symbol up to itself, with the rank that makes each next one.
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        for i in vocab.values():
            for edges, side in ((self.left, 1), (self.right, 2)):
                chain, at = [], i
                up = never
                while True:
                    chain.append((at, up))
                    if at not in made:
                        break
                    up, at = made[at][0], made[at][side]
                edges[i] = chain[::-1]
        self.known: dict[tuple[int, int], bool] = {}
        self.find = ahocorasick.Automaton()
        self.longest = max(map(len, vocab))
        for t, i in vocab.items():
            base = i not in made
            if base or self._stands(i, made):
                self.find.add_word(t, (len(t), i))
        self.find.make_automaton()

    def _stands(self, token: int, made: dict) -> bool:
        """Whether the token's own text encodes to it: its two halves stand and meet at the seam only by its own merge."""
        r, x, y = made[token]
        return all(k not in made or self._stands(k, made) for k in (x, y)) and self._first(x, y, r)

    def _first(self, a: int, b: int, allowed: int) -> bool:
        """Whether no merge across the seam of a and b comes before theirs (of rank ``allowed``) or, without one, at all."""
        left, right, rank, never = self.right[a], self.left[b], self.rank, self.never
        i = j = 0
        while True:
            (x, up_x), (y, up_y) = left[i], right[j]
            # the outermost tokens do not grow further
            up_x = up_x if i + 1 < len(left) else never
            up_y = up_y if j + 1 < len(right) else never
            r = rank.get((x, y), never)
            done = i + 1 == len(left) and j + 1 == len(right)
            if done:
                return r == allowed
            if r < up_x and r <= up_y:  # of equal ranks the merge further left comes first
                return False
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        pair = (a, b)
        if (out := self.known.get(pair)) is None:
            if len(self.known) >= KNOWN_PAIRS:
                self.known.clear()
            out = self.known[pair] = self._first(a, b, self.never)
        return out

    def encode(self, word: str) -> list[int]:
        """word: a pre-token in byte-level form."""
        n = len(word)
        if not n:
            return []
        # by place: the last token of the prefix that ends there, and its length; -1 where there is none yet
        last: list[int] = [-1] * (n + 2)
        size: list[int] = [0] * (n + 2)
        fits, known = self.fits, self.known
        for end, (length, token) in self.find.iter(word + _END):
            if last[end + 1] >= 0:
                continue
            if start := end + 1 - length:
                before = last[start]
                if before < 0:
                    continue
                if (fit := known.get((before, token))) is None:
                    fit = fits(before, token)
                if not fit:
                    continue
            last[end + 1], size[end + 1] = token, length
        ids, at = [], n + 1
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]


@functools.lru_cache(maxsize=4)
def pretokenizer(path: str) -> Pretokenizer:
    """One for each worker process and file."""
    return Pretokenizer(path)


@functools.lru_cache(maxsize=4)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)
