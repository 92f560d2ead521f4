"""Harmonic packing of token sequences.

Capacity C = 2048. A document is cut into whole sequences, then its rest into pieces of C/2, C/4 .. C/32, and what is
left (under C/32) keeps its length. Class j holds lengths in (C/(j+1), C/j], and every bin of class j takes exactly j
pieces, so bins fill without looking at any other class or worker. Pieces of the power-of-two classes fill their bins
to the last token. At the end of a partition the pieces of unfilled bins are laid end to end and cut at each C, so only
one sequence per partition is padded. No shuffle: each scan partition packs its own rows.

Defined results: null or empty text is the end token alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from evifuse.llm.common import table

CAPACITY = 2048
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of ``byte_bpe_50k.json``. Its rank file holds the same vocabulary and gives the same ids in a quarter of the time; texts that name the special token, or that the fast encoder refuses, go to the tokenizer itself."""

    def __init__(self, name: str = "byte_bpe_50k"):
        self.slow_path = public_tokenizers.path(f"{name}.json")
        lines = (line.split() for line in open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> list[int]:
        if "<|endoftext|>" not in text and len(text) < 5_000_000:
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # the fast encoder's regex engine gives up on some texts
                pass
        self.slow = self.slow or Tokenizer.from_file(self.slow_path)
        return self.slow.encode(text, add_special_tokens=False).ids


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class HarmonicPacker:
    """Packs one worker's documents; ``rows`` collects the placed pieces."""

    def __init__(self, first_id: int = 0, capacity: int = CAPACITY, smallest_cut: int = 64):
        self.capacity, self.smallest_cut, self.next_id = capacity, smallest_cut, first_id
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), crc(ids), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _put(self, piece: tuple) -> None:
        j = self.capacity // len(piece[2])
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        if len(bin_) == j:
            self._close(self.open.pop(j))

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, total, size = 0, len(ids), self.capacity
        while total - at >= self.smallest_cut:
            while total - at < size:
                size //= 2
            self._put((doc_id, at, ids[at : at + size], total))
            at += size
        if at < total:
            self._put((doc_id, at, ids[at:].copy(), total))

    def finish(self) -> None:
        now, room = [], self.capacity
        for j in sorted(self.open):
            for doc_id, start, ids, total in self.open[j]:
                while len(ids):
                    part = ids[:room]
                    now.append((doc_id, start, part, total))
                    start, ids, room = start + len(part), ids[room:], room - len(part)
                    if not room:
                        self._close(now)
                        now, room = [], self.capacity
        if now:
            self._close(now)
        self.open = {}


def _pack(batches):
    encode = Encoder()
    packer = HarmonicPacker(TaskContext.get().partitionId() << 40)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def drain():
        rows, packer.rows = packer.rows, []
        return pd.DataFrame(rows, columns=columns).astype({c: "int64" for c in columns[1:]} | {"doc_id": "Int64"})

    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            ids = encode(text) if text else []
            ids.append(END)
            packer.add(None if pd.isna(doc_id) else int(doc_id), np.array(ids, dtype=np.uint32))
        yield drain()
    packer.finish()
    yield drain()


def pack(docs: DataFrame) -> DataFrame:
    """One row per piece of every document."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInPandas(_pack, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
