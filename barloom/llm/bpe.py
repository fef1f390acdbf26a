"""BPE encoding by a dynamic program over prefixes, and decoding.

For every prefix of a word there is exactly one token that ends its encoding.
An Aho-Corasick automaton over the vocabulary names all tokens that end at a
position; the one that is compatible with the last token of the prefix before
it is stored, and following these back-pointers from the end of the word gives
the ids.  No merge is ever replayed.

Two tokens are compatible when encoding their concatenation leaves them apart.
Each token grew from single symbols by merges in rank order, so its outermost
symbol at the border is known for every point of that order; the pair falls
together only if a merge of the two border symbols comes while both exist.

Texts are normalised and cut into words as the tokenizer file says (NFC, lower
case, special tokens first).  Work per distinct word is done once per Python
worker and remembered up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barloom.llm.common import narrow

#: Stands for the end-of-word mark inside a worker; a private-use character no byte symbol maps to.
END = "\ue000"
#: Entries of each of a worker's two generations of remembered words, and the longest word kept.
KEPT_WORDS, KEPT_LENGTH = 200_000, 100

_PLAIN_SPACE = re.compile(r"[\x1c-\x1f]")


def byte_symbols() -> dict[int, str]:
    """Printable stand-in of each byte in byte-level vocabularies (fixed values of the public format)."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remembered(dict):
    """Results of ``make`` by text, in two generations: what was not asked for again since the last change goes."""

    def __init__(self, make: Callable[[str], Any]) -> None:
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixEncoder:
    """Encoder and decoder for a word-end BPE file of the ``tokenizers`` library."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix:
            raise ValueError("a BPE file with an end-of-word suffix is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        inner = {t: (t.removesuffix(suffix) + END if t.endswith(suffix) and t != suffix else t) for t in model["vocab"]}
        ids = {inner[t]: i for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (inner[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            left, right, made = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = rank
            parts.setdefault(made, (left, right, rank))
        # Border symbols of each token from single symbol to the whole token, with the rank that made them.
        self.as_right: dict[int, list[tuple[int, int]]] = {}
        self.as_left: dict[int, list[tuple[int, int]]] = {}
        self.known: dict[int, bool] = {}
        for name, i in sorted(ids.items(), key=lambda x: parts.get(x[1], (0, 0, -1))[2]):
            if i in parts:
                left, right, rank = parts[i]
                self.as_left[i] = [*self.as_left[left], (i, rank)]
                self.as_right[i] = [*self.as_right[right], (i, rank)]
            else:
                self.as_left[i] = self.as_right[i] = [(i, -1)]
        self.automaton = ahocorasick.Automaton()
        for name, i in ids.items():
            # A token that does not survive its own encoding can't occur in any encoding.
            if i not in parts or self.compatible(*parts[i][:2], until=parts[i][2]):
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The word pattern of the tokenizer file.
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.word, self.chunk = Remembered(self._word), Remembered(self._chunk)

    def compatible(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether ``a`` and ``b`` stay apart (up to merge rank ``until``) when ``a + b`` is encoded."""
        never = len(self.rank) if until is None else until
        right, left, i, j, apart = self.as_right[a], self.as_left[b], 0, 0, True
        while True:
            ends_a = right[i + 1][1] if i + 1 < len(right) else never
            ends_b = left[j + 1][1] if j + 1 < len(left) else never
            rank = self.rank.get((right[i][0], left[j][0]))
            # Equal ranks are merged from the left: first inside ``a``, then at the border, then inside ``b``.
            if rank is not None and rank < never and rank < ends_a and rank <= ends_b:
                apart = False
                break
            if i + 1 == len(right) and j + 1 == len(left):
                break
            if ends_a <= ends_b and i + 1 < len(right):
                i += 1
            else:
                j += 1
        if until is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            self.known[a * len(self.token) + b] = apart
        return apart

    def encode_word(self, word: str) -> list[int]:
        text = word.encode("utf-8").decode("latin-1").translate(self.symbols) + END
        last = [-1] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        known, width = self.known, len(self.token)
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                apart = known.get(before * width + token)
                if apart is None:
                    apart = self.compatible(before, token)
                if not apart:
                    continue
            last[end], size[end] = token, length
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: the file has no decoder, so its tokens joined by spaces."""
        return " ".join(map(self.token.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        found = [self.word[w] for w in self.words.findall(chunk)]
        return " ".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found])

    def _word(self, word: str) -> tuple[str, int, str]:
        ids = self.encode_word(word)
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    def _plain(self, text: str) -> Iterable[tuple[str, int, str]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if _PLAIN_SPACE.search(text):  # Python takes these for white space, the tokenizer doesn't
            return [self._chunk(text)]
        return map(self.chunk.__getitem__, text.split())

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """(ids as decimals joined by spaces, their number, the decoded text)."""
        found: list[tuple[str, int, str]] = []
        for part in self.splitter.split(text or "") if self.splitter else [text or ""]:
            if part in self.special:
                found.append((str(self.special[part]), 1, part))
            elif part:
                found += self._plain(part)
        found = [x for x in found if x[1]]
        return " ".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found])


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(spec: bytes) -> PrefixEncoder:
    """One encoder per Python worker and tokenizer file."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(json.loads(spec))
    return _ENCODERS[key]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns ``id_col`` (long), ``n_tokens`` (long), ``ids_sha256`` and
    ``decoded_sha256``; ``with_ids`` adds ``ids`` (array of int), ``with_text``
    adds ``decoded``.  ``tokenizer`` is the path of the vocabulary file; its bytes
    (a few MB whatever the input) are broadcast.

    Null texts count as empty: no ids, digests of the empty string.  Null or
    repeated ids give one row per input row.  Further columns are dropped.
    An empty table gives an empty one.  Long texts are encoded whole.
    """
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            count, digest, back, ids, texts = [], [], [], [], []
            for text in batch.column(1):
                joined, n, decoded = enc.encode(text.as_py())
                count.append(n)
                digest.append(sha(joined))
                back.append(sha(decoded))
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=" "))
                if with_text:
                    texts.append(decoded)
            cols = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return narrow(docs, **{id_col: "long", text_col: "string"}).mapInArrow(run, schema)
