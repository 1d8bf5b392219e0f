"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is one token that can be the last of its encoding.  An automaton over the vocabulary
reports the tokens that are suffixes of each prefix; a candidate is right if the last token of the shorter prefix
before it is compatible with it, that is, if no merge would ever cross the border between the two.  Back-pointers from
the whole word give the exact ids without replaying merges.

The vocabulary file must describe a BPE with a word-end suffix, lower case, a splitting pattern of words and byte-level
characters.  Texts are cut at white space; each distinct piece is worked out once and kept in a bounded table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverspark.llm.common import tidy

#: Stands for the word-end suffix inside the automaton; byte-level characters never include it.
END = "\x01"
#: Longer words and pieces are not remembered.
KEPT = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _runs(kind: str) -> list[tuple[int, int]]:
    """Ranges of the code points that the library's own patterns take for a letter (L) or a number (N)."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True)
    plain = [*range(0xD800), *range(0xE000, 0x110000)]
    found = []
    for at in range(0, len(plain), 1 << 16):
        some = plain[at : at + (1 << 16)]
        for _, (a, b) in split.pre_tokenize_str("".join(map(chr, some))):
            cuts = [a, *[i for i in range(a + 1, b) if some[i] != some[i - 1] + 1], b]
            found += [(some[x], some[y - 1]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return found


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """The vocabulary's splitting pattern: contractions, runs of letters, single numbers, runs of anything else.

    Letters and numbers are spelled out as the tokenizers library has them, since Unicode versions differ.
    """
    letters, numbers = ("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _runs(k)) for k in "LN")
    white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")


def has_unknown(text: str) -> bool:
    """Whether a text has characters that this Python's Unicode data has not assigned; the library may know them."""
    return any(c > "\x7f" and unicodedata.category(c) == "Cn" for c in set(text))


class PrefixBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, remember: int = 300_000):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        mark = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.id_of = {mark(t): i for t, i in model["vocab"].items()}
        self.shown = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[str, str, int]] = {}  # a token's two parts and the rank of their merge
        for n, (a, b) in enumerate(model["merges"]):
            a, b = mark(a), mark(b)
            self.rank[a, b] = n
            self.made.setdefault(a + b, (a, b, n))
        self.suffixes = ahocorasick.Automaton()
        for t in self.id_of:
            self.suffixes.add_word(t, (t, len(t)))
        self.suffixes.make_automaton()
        self.words = word_pattern().findall
        self.path = path
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chars = byte_characters()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.pieces: dict[str, tuple[str, str]] = {}
        self.held = 0
        self.empty = False
        self.remember = remember

    def _edge(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The tokens that stand at a token's right or left border while it is built, with the rank that uses each up."""
        out, used = [], float("inf")
        while True:
            out.append((token, used))
            if token not in self.made:
                return out
            a, b, used = self.made[token]
            token = b if right else a

    def compatible(self, left: str, right: str) -> bool:
        """Whether BPE leaves the border between two tokens alone.

        A merge of x, at the border's left, and y, at its right, happens if its rank comes before both are used up; at
        equal ranks the merge further left is first, which is the one inside the left token or the one across.
        """
        ys = self._edge(right, right=False)
        fits = not any(
            (r := self.rank.get((x, y))) is not None and r < x_used and r <= y_used for x, x_used in self._edge(left, right=True) for y, y_used in ys
        )
        if len(self.pairs) >= 2 * self.remember:
            self.pairs.clear()
        self.pairs[left, right] = fits
        return fits

    def encode_word(self, word: str) -> list[str]:
        """Tokens of one word of byte-level characters."""
        size = len(word) + 1
        last: list[str | None] = [None] * (size + 1)
        pairs = self.pairs
        for end, (token, length) in self.suffixes.iter(word + END):
            end += 1
            if last[end] is None:
                before = last[end - length] if length < end else ""
                if before == "":
                    last[end] = token
                elif before is not None:
                    fits = pairs.get((before, token))
                    if fits or fits is None and self.compatible(before, token):
                        last[end] = token
        out = []
        while size:
            out.append(last[size])
            size -= len(out[-1])
        return out[::-1]

    def _word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = [self.id_of[t] for t in self.encode_word("".join([self.chars[b] for b in word.encode()]))]
            self._keep(self.known, word, found)
        return found

    def _learn(self, piece: str) -> tuple[str, str]:
        """The ids and the tokens, each joined by spaces, of a text without white space; kept for the next time."""
        ids = []
        for w in self.words(piece):
            ids += self._word(w)
        self.empty |= not ids
        found = " ".join(map(str, ids)), " ".join([self.shown[i] for i in ids])
        self._keep(self.pieces, piece, found)
        return found

    def _keep(self, into: dict, text: str, found) -> None:
        """Remember what a short text gives; the tables have bounds on their entries and on their characters."""
        if len(text) > KEPT:
            return
        self.held += len(text)
        if len(into) >= self.remember or self.held > KEPT * self.remember // 4:
            self.known.clear()
            self.pieces.clear()
            self.held = len(text)
        into[text] = found

    def _plain(self, text: str) -> tuple[str, str]:
        if not text.isascii() and has_unknown(text):
            text = _normalizer(self.path).normalize_str(text)
        else:
            # one character at a time, so the form of sigma at a word's end is not used
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, but not to the pattern
            pieces = self.words(text)
        else:
            pieces = text.split()
        get, learn = self.pieces.get, self._learn
        found = [get(p) or learn(p) for p in pieces]
        if self.empty:
            found = [x for x in found if x[0]]
        return (" ".join([a for a, _ in found]), " ".join([b for _, b in found])) if found else ("", "")

    def encode(self, text: str) -> tuple[str, str]:
        """The ids and the decoded text: decimal ids and token strings, both joined by single spaces."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = [(str(self.special[p]), p) if p in self.special else self._plain(p) for p in self.specials.split(text)]
        return " ".join([a for a, _ in parts if a]), " ".join([b for _, b in parts if b])

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces, special tokens too, as a file without a decoder asks for."""
        return " ".join(self.shown[i] for i in ids if i in self.shown)


@lru_cache(maxsize=4)
def _normalizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).normalizer


@lru_cache(maxsize=4)
def encoder(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (decimal, joined by spaces) and decoded of every whole text.

    ``path`` is the vocabulary file, readable on every executor.  Null and empty texts, and texts without any word,
    have no ids and decode to the empty string; very long texts are encoded whole.  Rows are independent: repeated rows
    and null ids give a row each, an empty table gives none, and extra columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                pairs = [bpe.encode(t or "") for t in some.column(1).to_pylist()]
                n = pa.array([a.count(" ") + 1 if a else 0 for a, _ in pairs], pa.int64())
                ids, decoded = pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), n, ids, decoded], ["id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids string, decoded string").withColumnRenamed("id", id_col)
