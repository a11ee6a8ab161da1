"""Token counts of whole texts by the libraries of public tokenizers; only lengths leave the tasks.

Each task encodes its own texts (nothing is shuffled) in batches of about ``BATCH_BYTES``, however many texts that is, so a batch
costs about the same everywhere. Texts longer than ``PART_CHARS`` are cut into parts, each at the first place from there on
where the tokenizer's own splitting has a boundary whatever stands around it, and the lengths of the parts are summed. Such places are known for
byte-level pre-tokenizers with the usual pattern (see ``CUT``): a word's end before white space, and where letters or digits stop. No
cut touches one of the tokenizer's special strings. A run without such a place is encoded whole; so is every text for other tokenizers.

``.json`` files are read by ``tokenizers`` and ``.model`` files by ``sentencepiece``, without begin, end or other added tokens, truncation or
padding; special strings inside a text count as the library counts them by default.

Defined cases: a NULL text is the empty text (no bytes, no tokens); very long texts are counted whole; NULL and repeated ids are rows
like others; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.packing import steps

#: Bytes of text that a task encodes in one call, and characters after which a text is cut at the next safe place.
BATCH_BYTES, PART_CHARS = 256 << 10, 32 << 10
#: Cuts that no later token can reach over, in characters whose class no version of Unicode has changed: after anything that is no white
#: space and before white space; after a letter and before a digit or punctuation; after a digit and before a letter or punctuation.
CUT = regex.compile(
    r"(?<=[!-~¡-ÿͰ-ϿЀ-ӿぁ-ゖ一-龥가-힣])(?=[ \n\r\t])"
    r"|(?<=[A-Za-z一-龥])(?=[0-9!-/:-@\[-`{-~、。！，])"
    r"|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~一-龥、。！，])"
)


class Counter:
    """Lengths of texts under one tokenizer file."""

    def __init__(self, path: str):
        self.specials: list[str] = []
        self.cuts = False
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                rules = json.load(f)
            added = rules.get("added_tokens") or []
            self.specials = [t["content"] for t in added]
            before = rules.get("pre_tokenizer") or {}
            plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            exact = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
            self.cuts = bool(plain and exact and rules.get("normalizer") is None)
        elif path.endswith(".model"):
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            raise ValueError(f"{path}: neither a .json nor a .model file")

    def encoded(self, texts: list[str]) -> list[int]:
        if hasattr(self.tokenizer, "encode_batch_fast"):
            return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(x) for x in self.tokenizer.encode(texts, num_threads=1)]

    def in_special(self, text: str, at: int) -> bool:
        """Whether a cut before character ``at`` would go through a special string."""
        return any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in self.specials if len(s) > 1)

    def parts(self, text: str, size: int) -> Iterator[str]:
        start = 0
        while self.cuts and len(text) - start > size:
            found = CUT.search(text, start + size)
            while found and self.in_special(text, found.start()):
                found = CUT.search(text, found.start() + 1)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def __call__(self, texts: pa.Array, part_chars: int, batch_bytes: int) -> np.ndarray:
        total, batch, of, held = np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            np.add.at(total, of, self.encoded(batch))

        for i, text in enumerate(texts.to_pylist()):
            for part in self.parts(text, part_chars) if text else ():
                batch.append(part)
                of.append(i)
                held += len(part) if part.isascii() else len(part.encode())
                if held >= batch_bytes:
                    flush()
                    batch, of, held = [], [], 0
        if batch:
            flush()
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's own; later tasks of the worker find it loaded."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 1024,
    part_chars: int = PART_CHARS,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``."""
    plain = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for ids, texts in steps(batches):
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array(count(texts, part_chars, batch_bytes))
            yield pa.RecordBatch.from_arrays([ids, n_bytes, n_tokens], names=["doc_id", "n_bytes", "n_tokens"])

    counted = plain.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
