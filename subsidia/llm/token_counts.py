"""Token counts by a two-tier map-side lookup; no pre-token is ever shuffled.

Tier 1 is a broadcast table of frequent pre-tokens and their lengths in tokens. Merges of a byte-pair vocabulary are
ordered by frequency, so the entries of the vocabulary that are whole pre-tokens are its frequent pre-tokens: the
table's size is bounded by the vocabulary, whatever the corpus. Tier 2 is a cache in each worker, bounded to
CACHE_ENTRIES, filled by encoding a batch's distinct misses. Neither tier changes a count.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, tidy

#: Entries of a worker's cache of pre-tokens outside the broadcast table.
CACHE_ENTRIES = 200_000
#: Pre-tokens longer than this are encoded but not cached.
CACHED_LENGTH = 64
#: Code points that any version of Unicode since 6 classes alike; other texts go whole to the library.
STABLE = r"[\x00-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԓ -‧‪-⁞€　-〩ぁ-ゖァ-ヺ一-龥가-힣]*"
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte-level splitting pattern, with white space spelled out as Unicode's White_Space.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: A worker's counters by the digest of what they are made of: files can change under their paths.
_WORKER: dict[str, "Counter"] = {}


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of texts with a library tokenizer of byte-level pre-tokens."""

    def __init__(self, spec: str, frequent: dict[str, int] | None = None, entries: int = CACHE_ENTRIES):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(PATTERN).findall
        self.stable = regex.compile(STABLE).fullmatch
        parsed = json.loads(spec)
        added = sorted((x["content"] for x in parsed["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, added))).split if added else None
        pre = parsed.get("pre_tokenizer") or {}
        plain = [x for x in parsed["added_tokens"] if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]]
        self.whole = bool(plain) or parsed.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True)
        self.frequent, self.entries = frequent or {}, entries
        self.cache = dict(self.frequent)

    def library(self, texts: list[str]) -> list[int]:
        encode = self.tokenizer.encode_batch_fast
        return [len(x) for i in range(0, len(texts), 4096) for x in encode(texts[i : i + 4096], add_special_tokens=False)]

    def table(self) -> dict[str, int]:
        """Vocabulary entries that are one pre-token each, with their lengths."""
        letters, found = _byte_letters(), []
        for word in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(letters[c] for c in word).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.stable(text) and self.find(text) == [text]:
                found.append(text)
        return dict(zip(found, self.library(found), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        if self.whole:
            return self.library(texts)
        cut: list[tuple[list[str], int] | None] = []
        seen: set[str] = set()
        for text in texts:
            if not (text.isascii() or self.stable(text)):
                cut.append(None)
                continue
            parts = self.split(text) if self.split else [text]
            words = self.find(parts[0]) if len(parts) == 1 else [w for p in parts for w in self.find(p)]
            seen.update(words)
            cut.append((words, len(parts) - 1))
        missing = list(seen.difference(self.cache))
        if len(self.cache) + len(missing) > len(self.frequent) + self.entries:
            self.cache = dict(self.frequent)
            missing = list(seen.difference(self.cache))
        new = dict(zip(missing, self.library(missing), strict=True))
        long = {w: n for w, n in new.items() if len(w) > CACHED_LENGTH}
        self.cache.update(new)
        get = self.cache.__getitem__
        out = [self.library([t])[0] if c is None else sum(map(get, c[0])) + c[1] for t, c in zip(texts, cut, strict=True)]
        for w in long:
            del self.cache[w]
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row's whole text.

    Special strings inside a text count as the library counts them by default; none are added. A null text counts as
    the empty text: 0 bytes, 0 tokens. A null key stays null, repeated rows stay repeated, an empty table gives an
    empty table, and other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    table = Counter(spec).table()
    shared = spark.sparkContext.broadcast((spec, "\x00".join(k for k in table if "\x00" not in k), bytes(min(255, v) for k, v in table.items() if "\x00" not in k)))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, words, lengths = shared.value
        name = hashlib.sha256(spec.encode()).hexdigest()
        worker = _WORKER.get(name)
        if worker is None:
            frequent = {w: n for w, n in zip(words.split("\x00"), lengths, strict=True) if n < 255} if lengths else {}
            worker = _WORKER[name] = Counter(spec, frequent)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            sizes = [len(t.encode()) for t in texts]
            n: list[int] = []
            lo, held = 0, 0
            for i, size in enumerate(sizes):
                held += size
                if held > 2_000_000 or i + 1 == len(sizes):
                    n += worker.counts(texts[lo : i + 1])
                    lo, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(count, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
