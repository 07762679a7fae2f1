"""Byte-pair encoding with word ends, and its decoding, over whole texts.

The file of the tokenizer (a parameter; read by the driver, shared with the
tasks) gives its vocabulary, merges, special tokens and the pattern of words.
A task splits texts into words, numbers the distinct ones, and encodes those
it hasn't met yet together: the symbols of all these words lie in one flat
array, and each round looks up the ranks of all neighbouring pairs by binary
search over the sorted pair keys, then every word merges its pair of lowest
rank, at all its places at once. Words without a mergeable pair leave the array.

Merging all places at once equals merging them one by one, unless a merge's
product takes part in a pair of lower rank; such merges are found when the
file is read, and are done one place, the leftmost, a round.

Defined cases: a null text counts as empty and gives no tokens; special tokens
written out in a text become their ids; ids outside the vocabulary decode to
nothing; repeated rows are encoded each; other columns are ignored, whatever
their names. A word's number of rounds is at most the number of distinct
merges in it, so single words of millions of different letters are slow, not wrong.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NONE = np.iinfo(np.int64).max
WORD_CACHE = 1 << 19  # distinct words a task keeps encoded; beyond it starts anew

# The normalisation and the word pattern of the format that is read here.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")


def _ranges(points: list[int]) -> str:
    """A character class's inside for sorted code points."""
    out: list[list[int]] = []
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def unicode_gaps() -> tuple[list[int], list[int], dict[int, str]]:
    """Where the tokenizers library's Unicode tables and those of this Python differ.

    Code points that are letters or numbers for the pattern module alone, those
    that NFC places or composes differently, and lower-case forms that Python lacks.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 10]
    known: set[str] = set()
    either = pre_tokenizers.Split(Regex(r"\p{L}|\p{N}"), "removed", invert=True)
    here = regex.compile(r"\p{L}|\p{N}")
    for i in range(0, len(points), 4096):
        known.update(w for w, _ in either.pre_tokenize_str("".join(points[i : i + 4096])))
    gap = [ord(c) for c in points if c not in known and here.match(c)]
    lines = "\n".join(points)
    forms = {ord(c): v for c, v in zip(points, normalizers.Lowercase().normalize_str(lines).split("\n")) if v != c.replace("Σ", "σ").lower()}
    # a mark's class shows in its order beside marks of the lowest and a high class
    moved = [c for c in points if unicodedata.combining(c) or unicodedata.decomposition(c)]
    marks = "\n".join(f"{c}\u0334\u0301{c}" for c in moved)
    odd = [ord(c) for c, x, y in zip(moved, normalizers.NFC().normalize_str(marks).split("\n"), unicodedata.normalize("NFC", marks).split("\n")) if x != y]
    return gap, odd, forms


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others for the code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


def _tokens(spec: dict) -> list[str]:
    """The token of each id."""
    named = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
    token = [""] * (1 + max(i for _, i in named))
    for t, i in named:
        token[i] = t
    return token


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class WordBpe:
    """A tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        spec = _read(path)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (model["type"] != "BPE" or [s["type"] for s in steps] != NORMALIZERS or split["pattern"].get("Regex") != WORDS
                or model["continuing_subword_prefix"] or model["ignore_merges"] or spec["decoder"] is not None):
            raise ValueError(f"{path}: not a lower-case word-end BPE file")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = len(_tokens(spec))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        # the first of equal pairs has the lowest rank
        self.key, self.rank = np.unique(key, return_index=True)
        lowest = np.full(self.size, NONE)
        np.minimum.at(lowest, left[self.rank], self.rank)
        np.minimum.at(lowest, right[self.rank], self.rank)
        self.alone = lowest[self.product] < np.arange(len(pairs))
        self.gap, self.odd, self.lower = unicode_gaps()

    def pair_ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; ``NONE`` where its word ends or no merge is known."""
        rank = np.full(len(sym), NONE)
        if len(sym) > 1 and len(self.key):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = (self.key[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.rank[at[known]]
        return rank

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and the number of ids of each. Words aren't empty."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = self.pair_ranks(sym, word)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.concatenate([start, [len(sym)]]))
            least = np.repeat(least, size)
            open_ = least < NONE
            if not open_.all():
                done.append((sym[~open_], word[~open_]))
                sym, word, rank, least = sym[open_], word[open_], rank[open_], least[open_]
                if not len(sym):
                    break
            place = np.flatnonzero(rank == least)
            # of a run of overlapping places every second one merges; of merges done alone only a word's first
            new_run = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(word[place]) > 0)])
            in_run = np.arange(len(place)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            new_word = np.concatenate([[True], np.diff(word[place]) > 0])
            place = place[(in_run % 2 == 0) & (new_word | ~self.alone[rank[place]])]
            sym[place] = self.product[rank[place]]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate([s for s, _ in done]), np.concatenate([w for _, w in done])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))


class _Numbers(dict):
    """Words to numbers; new ones are numbered and listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Texts to ids, with the ids of the words met so far."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.words = regex.compile(WORDS)
        gap = f"[{_ranges(bpe.gap)}]" if bpe.gap else "(?!)"
        self.rare = {chr(c) for c in (*bpe.gap, *bpe.odd, *bpe.lower)}
        self.rare_words = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?!{gap})\p{{L}})+|(?!{gap})\p{{N}}|(?:{gap}|[^\s\p{{L}}\p{{N}}])+")
        self.specials = re.compile("|".join(re.escape(t) for t in sorted(bpe.special, key=len, reverse=True)))
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if any(t in text for t in self.bpe.special):
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [*self._plain(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        # letters are lowered one by one: a final sigma is no special case
        if not self.rare.isdisjoint(text):  # code points that the library's tables treat otherwise
            from tokenizers import normalizers

            text = normalizers.NFC().normalize_str(text).replace("Σ", "σ")
            return self.rare_words.findall(text.translate(self.bpe.lower).lower())
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        if len(self.numbers) > WORD_CACHE:
            self._forget()
        words = [self.split(t) for t in texts]
        number = self.numbers.__getitem__
        at = [np.fromiter(map(number, w), np.int64, len(w)) for w in words]
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        flat = np.concatenate(at) if at else np.zeros(0, np.int64)
        size = self.size[flat]
        begin = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.start[flat] - begin, size) + np.arange(size.sum())].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, at)])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _learn(self, new: list[str]) -> None:
        # a special token is told by its text: no word of the pattern mixes letters with other signs as it does
        special = {i: self.bpe.special[w] for i, w in enumerate(new) if w in self.bpe.special}
        plain = [w for i, w in enumerate(new) if i not in special]
        ids, size = self.bpe.encode_words(plain) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if special:
            gaps = np.array(sorted(special))
            before = np.concatenate([[0], np.cumsum(size)])[gaps - np.arange(len(gaps))]
            ids = np.insert(ids, before, [special[i] for i in gaps])
            size = np.insert(size, gaps - np.arange(len(gaps)), 1)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every whole text as ids, packed as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in slices(batches, "text"):
            packed = [i.tobytes() for i in encoder(_texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the tokens of packed ids, joined by spaces, special tokens among them."""
    shared = encoded.sparkSession.sparkContext.broadcast(_tokens(_read(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value
        for b in slices(batches, "ids"):
            texts = []
            for packed in b.column(1).to_pylist():
                ids = np.frombuffer(packed or b"", "<u4")
                texts.append(" ".join(map(token.__getitem__, ids[ids < len(token)].tolist())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, text string").withColumnsRenamed({"id": id_col, "ids": ids_col})
