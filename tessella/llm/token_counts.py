"""Token counts with the whole-token shortcut.

Offline, every vocabulary string is encoded alone: those that come back as exactly one
token form the proven set. While counting, a pre-token in the proven set costs one
dictionary lookup; only the others run the merges, and their counts are memoised in a
bounded table. Only the vocabulary (a fixed file) is broadcast.
"""

from __future__ import annotations

import itertools
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import arrow_map, ids_and_text, ship, worker_cache

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

#: Memoised pre-tokens per worker; the table is emptied when it is full.
MEMO = 200_000


def byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies use for each byte: printable Latin-1 stays, the rest moves to U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = itertools.count(256)
    return [chr(b) if b in printable else chr(next(moved)) for b in range(256)]


class Counter:
    """Counts as tokenizers does for a file whose pre-tokenizer keeps the matches of one pattern, byte-level."""

    def __init__(self, data: bytes, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.normalizer, self.model = self.tokenizer.normalizer, self.tokenizer.model
        pattern, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if (pattern["type"], pattern["behavior"], pattern["invert"], byte_level["type"], byte_level["use_regex"]) != ("Split", "Removed", True, "ByteLevel", False):
            raise ValueError("this counter needs a pre-tokenizer that keeps a pattern's matches")
        self.find = regex.compile(pattern["pattern"]["Regex"]).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.symbols = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.vocab = spec["model"]["vocab"]
        self.whole = self.prove() if whole is None else whole
        self.memo: dict[str, int] = dict.fromkeys(self.whole, 1)

    def prove(self) -> frozenset[str]:
        """The strings that the library itself encodes, alone, as one token."""
        back = {s: b for b, s in enumerate(byte_symbols())}
        strings = []
        for token in self.vocab:
            if self.suffix and not token.endswith(self.suffix):
                continue
            try:
                strings.append(bytes(back[c] for c in token.removesuffix(self.suffix)).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        found = self.tokenizer.encode_batch(strings, add_special_tokens=False)
        return frozenset(s for s, e in zip(strings, found, strict=True) if len(e.ids) == 1 and self.find(s) == [s])

    def merge(self, word: str) -> int:
        n = len(self.model.tokenize(word.encode().decode("latin-1").translate(self.symbols)))
        if len(self.memo) > len(self.whole) + MEMO:
            self.memo = dict.fromkeys(self.whole, 1)
        self.memo[word] = n
        return n

    def count(self, text: str) -> int:
        total = 0
        parts = [text]
        if self.special and (hits := self.special.findall(text)):
            total, parts = len(hits), self.special.split(text)
        for part in parts:
            words = self.find(self.normalizer.normalize_str(part)) if part else []
            known = list(map(self.memo.get, words))
            total += sum(n for n in known if n)
            total += sum(self.memo.get(w) or self.merge(w) for w, n in zip(words, known, strict=True) if not n)
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per row of docs.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids give a row each;
    an empty table gives no rows; other columns are not read. Special strings inside a text
    count as the library counts them by default (one token each).
    """
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    shipped = ship(docs.sparkSession, (data, Counter(data).whole))

    def run(rows):
        data, whole = shipped()
        cache = worker_cache()
        if (key := ("token_counts", hash(data))) not in cache:
            cache[key] = Counter(data, whole)
        counter = cache[key]
        for doc_id, text in rows:
            n = counter.count(text.decode("utf-8", "replace"))
            yield doc_id, len(text), n, n > limit

    return arrow_map(ids_and_text(docs, id_col, text_col), run, SCHEMA)
