"""BPE encoding and decoding with a ready vocabulary file (never trained here).

Each short word is held as a contiguous array of part boundaries with the rank of each adjacent pair beside it; the
array is scanned for the lowest rank, the boundary between the two parts goes, and the two neighbouring ranks are
refreshed. Words over ``SHORT`` symbols use a heap over linked parts instead, which gives the same merges without the
quadratic scan. Encoded words are cached per worker in a dictionary of bounded size, so a frequent word is merged once.

Defined cases: null text counts as empty; an empty text has no tokens and decodes to the empty string; the strings of
special tokens in a text become those tokens, as the library does by default; very long texts and words are encoded
whole; each row stands alone, so repeated rows, ties and extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 96
CACHE_WORDS = 200_000
#: fixed values: the code points with the White_Space property
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NONE = 1 << 60


def _ranges(kind: str) -> str:
    """A character class of all code points whose general category starts with ``kind``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file in the JSON format of the tokenizers library.

    Supports the parts that the file ``word_bpe_49k.json`` names: NFC, white space runs to one blank, lower case per
    character, a split into words, byte-level symbols, BPE with a suffix on the last symbol of a word, no decoder.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.bytes = byte_alphabet()
        letters, numbers = _ranges("L"), _ranges("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+").findall
        latin = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.latin_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{latin['L']}]+|[{latin['N']}]|[^\\x09-\\x0d\\x20\\x85\\xa0{latin['L']}{latin['N']}]+").findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.cache = _Words(self)

    def symbols(self, word: str) -> list[int]:
        chars = [self.bytes[b] for b in word.encode("utf-8")]
        chars[-1] += self.suffix
        return [self.vocab[c] for c in chars if c in self.vocab]

    def merge(self, word: str) -> list[int]:
        parts = self.symbols(word)
        return self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)

    def merge_short(self, parts: list[int]) -> list[int]:
        """Contiguous rank array: ``ranks[i]`` belongs to the boundary between parts i and i + 1."""
        pairs = self.pairs
        ranks = [pairs.get(p, (NONE,))[0] for p in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) != NONE:
            i = ranks.index(low)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), (NONE,))[0]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), (NONE,))[0]
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges from a heap over linked parts."""
        n, pairs = len(parts), self.pairs
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = pairs[a, b][1], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := (parts[x], parts[after[x]])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], x, *p))
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def split(self, text: str) -> list[str]:
        """The words of a text after NFC and lower case; white space only separates words, so its runs stay as they are."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # per character, so no final sigma
            return self.words(text)
        return self.latin_words(text.lower())  # already NFC, and stays within Latin-1

    def pieces(self, text: str) -> Iterator[tuple[str, int, str]]:
        """(ids as text, number of ids, decoded text) of each word or special token in order."""
        cache = self.cache
        for k, part in enumerate(self.specials(text)):
            if k % 2:
                yield str(self.special[part]), 1, part
            elif part:
                yield from [cache[w] for w in self.split(part)]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, n, _ in self.pieces(text or "") if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the library joins the token strings by a blank."""
        return " ".join(self.token[i] for i in ids if i in self.token)


class _Words(dict):
    """Encoded words; emptied when it is full, so that its size stays bounded."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, int, str]:
        ids = self.bpe.merge(word)
        found = " ".join(map(str, ids)), len(ids), self.bpe.decode(ids)
        if len(word) <= SHORT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``texts`` also the ids and the decoded text."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts

    def run(batches):
        bpe = load(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "i", "d", "ids", "decoded")}
            for text in batch.column(1).to_pylist():
                found = list(bpe.pieces(text or ""))
                found = [p for p in found if p[1]] if any(not p[1] for p in found) else found
                ids, decoded = " ".join([p[0] for p in found]), " ".join([p[2] for p in found])
                out["n"].append(sum([p[1] for p in found]))
                out["i"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["d"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if texts:
                    out["ids"].append([int(i) for i in ids.split()])
                    out["decoded"].append(decoded)
            columns = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string())]
            if texts:
                columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * texts)
        bpe.cache.clear()  # workers outlive their tasks
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
