"""Token counts by a two-tier lookup on the map side.

White space never enters a token of the vocabulary, so a text's count is the
sum over its white-space separated pre-tokens. Tier one is a broadcast table of
the lengths of frequent pre-tokens; its rows, the bytes of a row and so its
size are bounded by parameters. Tier two is a cache in each Python worker,
bounded too, which encodes the misses. No pre-token occurrence is shuffled: the
frequent ones come from bounded summaries, one per partition.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_batches, pairs_schema, slices, texts_of, tokenizer

# Split by str.split() but not white space for the tokenizer: such texts are encoded whole.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def frequent_pretokens(docs: DataFrame, text_col: str = "text", keep: int = 32_768, summary: int = 4096, width: int = 64) -> DataFrame:
    """(pretoken, n): the most frequent pre-tokens, at most ``keep``, each of at
    most ``width`` characters. Each partition keeps a summary of at most
    ``summary`` entries that decides only which lookups are fast."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches):
            for t in texts_of(b, 0):
                seen.update(t.split())
                if len(seen) > 32 * summary:
                    seen = Counter(dict(seen.most_common(8 * summary)))
        top = [(w, n) for w, n in seen.most_common(summary) if len(w) <= width and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pretoken", "n"])

    local = map_batches(docs.select(col(text_col).alias("text")), summarise, "pretoken string, n long")
    return local.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(keep)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


LETTERS = byte_letters()
# Words of these characters need no normalisation, are lower-cased letter by
# letter and have one split in every Unicode version; others go to the library.
PLAIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017f]+")


class Worker:
    """Both tiers inside a Python worker; made once per worker and table. The
    second keeps pre-tokens and, below them, their parts (words, digits, marks)."""

    made: dict = {}

    def __init__(self, name: str, words: list[str], lengths: bytes, room: int):
        self.name, self.first, self.second, self.parts, self.room = name, dict(zip(words, lengths, strict=True)), {}, {}, room

    def encode(self, word: str) -> int:
        if "<|" in word or not PLAIN.fullmatch(word):
            return len(tokenizer(self.name).encode(word, add_special_tokens=False).ids)
        total = 0
        for part in PART.findall(word.lower()):
            n = self.parts.get(part)
            if n is None:
                if len(self.parts) >= self.room:
                    self.parts.clear()
                n = self.parts[part] = len(tokenizer(self.name).model.tokenize(part.encode().decode("latin-1").translate(LETTERS)))
            total += n
        return total

    def lookup(self, words: list[str]) -> int:
        first, second, total = self.first, self.second, 0
        for w in words:
            n = first.get(w)
            if n is None:
                n = second.get(w)
                if n is None:
                    if len(second) >= self.room:
                        second.clear()
                    n = second[w] = self.encode(w)
            total += n
        return total

    def count(self, text: str) -> int:
        if any(s in text for s in SEPARATORS):
            return len(tokenizer(self.name).encode(text, add_special_tokens=False).ids)
        return self.lookup(text.split())


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "word_bpe_49k.json", keep: int = 32_768, room: int = 300_000) -> DataFrame:
    """(id, n_bytes, n_tokens) per row; null texts count as empty, rows that
    repeat an id stay rows of their own, an empty table gives none.

    ``name`` must be a vocabulary of word pieces that lower-cases and drops white
    space, by words, single digits and runs of other marks. ``keep`` bounds the
    broadcast table, ``room`` each worker cache (it starts anew when full).
    """
    rows = frequent_pretokens(docs, text_col, keep).collect()  # at most ``keep`` short rows
    words = [r[0] for r in rows]
    lengths = [len(e.ids) for e in tokenizer(name).encode_batch_fast(words, add_special_tokens=False)] if words else []
    short = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 256]
    key = docs.sparkSession.sparkContext.broadcast((name, [w for w, _ in short], bytes(n for _, n in short)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash((key.value[0], key.value[2], tuple(key.value[1][:8])))
        if mark not in Worker.made:
            Worker.made.clear()
            Worker.made[mark] = Worker(*key.value, room)
        worker = Worker.made[mark]
        for b in slices(batches):
            texts = texts_of(b, 1)
            out = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([worker.count(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_bytes", "n_tokens"])

    return map_batches(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), run, pairs_schema(docs, id_col, "id", "n_bytes long, n_tokens long"))
