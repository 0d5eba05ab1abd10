"""BPE encoding and decoding of texts with a vocabulary whose words end in a mark.

A word's symbols form a doubly linked list; all neighbouring pairs that a merge exists for wait in a priority queue of
(rank, position). The least is merged if the pair still stands there; an entry whose symbols have changed since is
stale and skipped. Decoding joins the vocabulary's strings, as the file names no decoder. Words repeat, so each task
keeps the result of those it has met, up to a bound.

Null and empty texts have no ids and decode to an empty text; repeated rows are encoded each; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lettermill.llm.common import text_batches

#: Words whose ids a task keeps.
KEPT_WORDS = 300_000
#: Characters that Python's normaliser and patterns were compared with the library for; texts with others take the
#: library's normaliser and splitter, whose character tables differ.
PLAIN = regex.compile(r"[\x00-\u024f\u2010-\u205e\u20a0-\u20bf]*")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in parts["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.words = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.bytes = byte_symbols()
        self.byte_of = {symbol: b for b, symbol in enumerate(self.bytes)}
        self.library = Tokenizer.from_file(path)
        self.kept: dict[str, tuple[str, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        symbols = [self.bytes[b] for b in word.encode()]
        symbols[-1] += self.suffix
        ids = [self.ids[s] for s in symbols if s in self.ids]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue  # stale
            ids[i] = self.merges[left, right][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [ids[i] for i in range(n) if alive[i]]

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without special strings."""
        if PLAIN.fullmatch(text):
            return self.words.findall(unicodedata.normalize("NFC", text).lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in pieces]

    def word(self, word: str) -> tuple[str, str]:
        """Ids and vocabulary strings of a word, each joined by a space."""
        ids = self.merge(word)
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        out = self.kept[word] = (" ".join(map(str, ids)), " ".join(self.strings[i] for i in ids))
        return out

    def joined(self, text: str) -> tuple[str, str]:
        """Ids in decimal and decoded text, joined by one space."""
        parts = self.specials.split(text) if "<|" in text else [text]
        found = []
        for part in parts:
            if part in self.special:
                found.append((str(self.special[part]), part))
            else:
                get, make = self.kept.get, self.word
                found += [get(w) or make(w) for w in self.split(part)]
        if not found:
            return "", ""
        ids, strings = zip(*found, strict=True)
        return " ".join(ids), " ".join(strings)

    def encode(self, text: str) -> list[int]:
        ids = self.joined(text)[0]
        return [int(i) for i in ids.split(" ")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, as the library joins them when a file names no decoder; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256 and decoded_sha256 of every text; no shuffle.

    path: a tokenizer file, readable on every executor.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            for start, texts in text_batches(batch):
                found = [bpe.joined(text) for text in texts]
                columns = [
                    batch.column("doc_id").slice(start, len(texts)),
                    pa.array([i.count(" ") + 1 if i else 0 for i, _ in found], pa.int64()),
                    pa.array([sha256(i.encode()).hexdigest() for i, _ in found]),
                    pa.array([sha256(s.encode()).hexdigest() for _, s in found]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([[int(x) for x in i.split(" ")] if i else [] for i, _ in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
