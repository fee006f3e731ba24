"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts longer than `part_chars` are cut at safe boundaries, that is before a single space
between two characters that are not white space: no token of a byte-level BPE with the usual
word pattern spans one. The parts of a slice of rows go to the encoder in batches balanced by
bytes; only the lengths come back, added up per row.

A `.json` file whose model is a plain byte-level BPE is encoded from its own vocabulary by the
faster of the two libraries that read it (tests hold the counts equal to the other's); special
strings inside a text count as their one token, as is the default of that file's library. Other
`.json` files and `.model` files are given whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from adledger.llm.common import arrow_map, slices

SAFE = re.compile(r"(?<=\S)(?= \S)")
# fixed value: the word pattern of byte-level BPE files that name no other
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def parts(text: str, most: int) -> Iterator[str]:
    """The text in parts of about `most` characters, each cut at a safe boundary."""
    start = 0
    while len(text) - start > most and (cut := SAFE.search(text, start + most)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _bytes_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*((b, b) for b in plain), *((b, 256 + i) for i, b in enumerate(rest))]}


def _plain_byte_bpe(spec: dict) -> bool:
    words, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (spec.get("normalizer") is None and words.get("type") == "ByteLevel" and words.get("use_regex", True)
            and not words.get("add_prefix_space") and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]
                        for t in spec["added_tokens"]))


class Counter:
    """Counts the tokens of texts with one vocabulary file."""

    def __init__(self, path: str, part_chars: int = 1 << 18, batch_bytes: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.part_chars, self.batch_bytes = part_chars, batch_bytes
        self.special = None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.part_chars = None
            self.encode = lambda batch: model.encode(batch, num_threads=1)
            return
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if _plain_byte_bpe(spec):
            import tiktoken

            byte, added = _bytes_of(), [t["content"] for t in spec["added_tokens"]]
            ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
            words = tiktoken.Encoding("counted", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda batch: map(words.encode_ordinary, batch)
            if added:
                self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.part_chars = None
            self.encode = lambda batch: library.encode_batch_fast(batch, add_special_tokens=False)

    def counts(self, texts: list[str]) -> list[int]:
        total, rows, batch, size = [0] * len(texts), [], [], 0

        def flush():
            for row, ids in zip(rows, self.encode(batch)):
                total[row] += len(ids)
            rows.clear()
            batch.clear()

        for row, text in enumerate(texts):
            if self.special and (found := len(self.special.findall(text))):
                total[row] += found
                plain = self.special.split(text)
            else:
                plain = [text]
            for piece in plain:
                for part in parts(piece, self.part_chars) if self.part_chars else [piece]:
                    rows.append(row)
                    batch.append(part)
                    size += len(part)
                    if size >= self.batch_bytes:
                        flush()
                        size = 0
        flush()
        return total


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, slice_bytes: int = 8 << 20) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit per row; null counts as empty, which has no tokens.

    Rows are independent: repeated ids give repeated rows, an empty table none; other
    columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(path)
        for part in slices(batches, 1, slice_bytes):
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(df.select(id_col, text_col), run,
                     f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
