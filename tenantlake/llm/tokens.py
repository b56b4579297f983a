"""Token counts and token pieces of whole texts, from a vocabulary's counts of distinct pre-tokens.

A pre-token here is the longest run of a text that the vocabulary's own splitting never crosses: white space with
the word after it, or the word alone where the vocabulary drops white space. The library encodes each distinct
pre-token once per worker (a bounded memory of pre-tokens is kept); a document's count is the sum over its
pre-token frequencies. Texts on which this split could differ from the library's (special strings, control
characters that only one side takes for white space) are given to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.common import HashIndex, as_text, chunks, slice_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Pre-tokens that a worker remembers; the memory starts afresh beyond it.
REMEMBERED = 400_000
REMEMBERED_PARTS = 2_000_000
#: Longer pre-tokens aren't remembered.
LONGEST = 64
_RUN = re.compile(r"\s*\S+|\s+")
#: Texts whose pre-tokens follow from the classes of their characters; the shortened words that are an exception.
_PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_SHORTENED = re.compile(r"'(?:[stmd]|re|ve|ll)", re.IGNORECASE)
_WHITE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.array([_WHITE if c in b"\t\n\x0b\x0c\r " else _DIGIT if 48 <= c < 58 else _LETTER if 97 <= c < 123 or c >= 128
                  else _SIGN for c in range(256)], np.uint8)
_ODD = re.compile(r"[\x1c-\x1f\x85᠎]")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """One tokenizer file with the memory of its pre-tokens."""

    _open: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.counts: dict[str, int] = {}
        self._forget()
        vocabulary = self.library.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def at(cls, path: str) -> "Vocabulary":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def whole(self, text: str) -> bool:
        """Whether the text must go to the library as a whole."""
        return _ODD.search(text) is not None or any(s in text for s in self.special)

    def _encode(self, texts: list[str]):
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; ids aren't kept."""
        bags = [None if self.whole(t) else Counter(_RUN.findall(t)) for t in texts]
        if len(self.counts) > REMEMBERED:
            self.counts = {}
        known = self.counts
        new = [p for p in set().union(*(b.keys() for b in bags if b)) if p not in known]
        extra = {}
        for p, e in zip(new, self._encode(new)):
            (known if len(p) <= LONGEST else extra)[p] = len(e)
        out = []
        for text, bag in zip(texts, bags):
            if bag is None:
                out.append(len(self._encode([text])[0]))
            elif extra:
                out.append(sum(n * (known[p] if p in known else extra[p]) for p, n in bag.items()))
            else:
                out.append(sum(n * known[p] for p, n in bag.items()))
        return out

    def _pieces_of(self, parts: list[str]) -> list[bytes]:
        """Ids of each single pre-token, encoded as one text; the last piece of a pre-token carries the word end."""
        out: list[bytes] = []
        for i in range(0, len(parts), 2000):
            ids = np.array(self.library.encode(" ".join(parts[i:i + 2000]), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.word_end[ids]) + 1) * 4
            raw = ids.tobytes()
            out.extend(raw[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, for the vocabulary that drops white space.

        Texts of Latin letters and signs are split into pre-tokens by character class, whole chunks at once; each
        distinct pre-token's ids are looked up by its hash. All others go to the library.
        """
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t) and not self.whole(t) and not _SHORTENED.search(t)]
        rest = [i for i in range(len(texts)) if i not in set(plain)] if len(plain) < len(texts) else []
        for i, e in zip(rest, self._encode([texts[i] for i in rest])):
            out[i] = array("I", e.ids).tobytes()
        if not plain:
            return out
        raw = [texts[i].lower().encode() + b" " for i in plain]
        data = np.frombuffer(b"".join(raw), np.uint8)
        kind = _KIND[data]
        new = np.ones(len(data) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
        new[:-1] |= kind == _DIGIT
        bounds = np.flatnonzero(new)
        runs = np.flatnonzero(kind[bounds[:-1]] != _WHITE)
        starts, ends = bounds[runs], bounds[runs + 1]
        hashes = slice_hashes(data, starts, ends)
        if len(self.index.keys) > REMEMBERED_PARTS:
            self._forget()
        at = self.index.find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            keys, first = np.unique(hashes[missing], return_index=True)
            words = [data[starts[i]:ends[i]].tobytes().decode() for i in missing[first].tolist()]
            pieces = self._pieces_of(words)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
            self.size = np.concatenate((self.size, sizes))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(pieces), "<u4")))
            self.index.add(keys)
            at[missing] = self.index.find(hashes[missing])
        sizes = self.size[at]
        stops = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.start[at] - stops[:-1], sizes) + np.arange(stops[-1])].tobytes()
        edges = np.searchsorted(starts, np.cumsum([0, *map(len, raw)]))
        cuts = (stops[edges] * 4).tolist()
        for i, s, e in zip(plain, cuts, cuts[1:]):
            out[i] = ids[s:e]
        return out

    def _forget(self) -> None:
        self.index = HashIndex(np.zeros(0, np.uint64))
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; no shuffle, nothing but counts leaves a task.

    ``tokenizer`` is the path of a byte-level tokenizer file. A null or empty text has no bytes and no tokens;
    special strings in a text count as the library counts them by default. Repeated rows are each counted.
    """
    path = tokenizer or public_path(BYTE_BPE)

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary.at(path)
        for batch in batches:
            texts = as_text(batch)
            yield pa.array([n for lo, hi in chunks(texts) for n in vocabulary.count(texts[lo:hi])], pa.int64())

    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        count(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
