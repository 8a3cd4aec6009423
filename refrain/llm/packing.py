"""Operator 4, best-fit packing in bulk-synchronous rounds.

Documents are tokenised, ended with an id, and cut at the sequence length only if longer. The
pieces are dealt at random into stripes of about STRIPE pieces, as many as the input needs, which are packed
side by side; a stripe's own loss is a sequence or so in each. A gap is the room left in an open sequence.

In a stripe, pieces and gaps are sorted by size. A round sweeps both in one ascending list for successors: every piece
asks for the smallest gap that holds it, and where several ask for one, the largest piece gets it and the others
go on to the next gaps, in the order of their ranks. So a gap takes the largest piece that fits it and no
smaller gap takes. Matched gaps shrink and are sorted again, and the rounds go on until no piece finds a
gap; then sequences are opened with the largest pieces.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.scratch import Scratch, read
from refrain.llm.worker import kept

LENGTH, END = 4096, 1
#: Pieces that one task packs; bytes of texts and ids that a worker's cache holds, characters of texts encoded at once.
STRIPE, CACHE, AT_ONCE = 1 << 20, 200 << 20, 4_000_000


#: ASCII signs after a letter and before a blank are a token or tokens of their own (not ', and not < | > of special tokens).
STOP = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([!-%(-;=?@\[-`{}~]+)(?=[ \n]|$)")
#: One word for the tokenizer, whatever stands around it.
LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
#: What an entry of the cache takes besides its characters and ids.
ENTRY = 220


def cache_parts(text: str) -> list[str]:
    """Blank-separated parts of a text whose ids, joined, are those of the text.

    The tokenizer lower-cases, drops blanks and never joins letters with signs. So the parts may be
    split and, in Latin-1, where no character composes with another, lower-cased beforehand:
    fewer of them differ.
    """
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return STOP.sub(r" \1", text).replace("\n", " ").split(" ")


def at_once(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of batch by at most 500 and, but for a longer single text, AT_ONCE characters."""
    sizes = batch["text"].str.len().fillna(0).to_numpy().astype(np.int64)
    first = 0
    while first < len(batch):
        n = int(np.searchsorted(sizes[first : first + 500].cumsum(), AT_ONCE, "right"))
        yield batch.iloc[first : first + max(1, n)]
        first += max(1, n)


def token_pieces(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32.

    Each part is encoded once per Python worker, as long as it stays in the cache.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        def word_ends() -> np.ndarray:
            vocabulary = encoder.get_vocab()
            out = np.zeros(max(vocabulary.values()) + 1, bool)
            out[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            return out

        encoder = kept("packing", f"tokenizer {tokenizer_file}", lambda: Tokenizer.from_file(tokenizer_file))
        ends = kept("packing", f"ends {tokenizer_file}", word_ends)
        cache: dict[str, bytes] = kept("packing", f"ids {tokenizer_file}", dict)
        held = kept("packing", f"bytes {tokenizer_file}", lambda: [0])
        tail = array("I", [end]).tobytes()
        width = 4 * length
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are taken from memory as little-endian 32-bit integers")

        def put(part: str, ids: bytes) -> None:
            cache[part] = ids
            held[0] += len(part) + len(ids) + ENTRY

        def learn(parts: list[str]) -> None:
            """Words of letters are encoded a thousand at a time as one text, which the ends of words cut again."""
            words = [x for x in parts if LETTERS.fullmatch(x)]
            others = list(set(parts) - set(words))
            for at in range(0, len(words), 1000):
                some = words[at : at + 1000]
                ids = np.array(encoder.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
                if len(cuts) != len(some):
                    others += some
                    continue
                raw = ids.tobytes()
                for part, a, b in zip(some, [0, *cuts], cuts, strict=False):
                    put(part, raw[a:b])
            for at in range(0, len(others), 10_000):
                some = others[at : at + 10_000]
                for part, got in zip(some, encoder.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    put(part, array("I", got.ids).tobytes())

        for batch in batches:
            out = []
            for some in at_once(batch):
                texts = [cache_parts(t or "") for t in some["text"]]
                missing = list(set().union(*texts) - cache.keys())
                if held[0] + sum(map(len, missing)) + ENTRY * len(missing) > CACHE:
                    cache.clear()
                    held[0], missing = 0, list(set().union(*texts))
                learn(missing)
                for doc_id, parts in zip(some["doc_id"], texts, strict=True):
                    ids = b"".join(map(cache.__getitem__, parts)) + tail
                    for k, start in enumerate(range(0, len(ids), width)):
                        own = ids[start : start + width]
                        out.append((doc_id, k, start // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(pieces: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of matched pieces and of their gaps, of sizes in any order; each occurs once.

    In the ascending list of both, pieces before gaps of their size, a gap takes the last piece before it
    that none has taken: pieces open and gaps close brackets, which belong together where they
    follow each other at one depth.
    """
    size = np.concatenate((pieces, gaps))
    closes = np.arange(len(size)) >= len(pieces)
    order = np.lexsort((closes, size))
    step = np.where(closes[order], -1, 1)
    depth = step.cumsum()
    depth -= np.minimum(0, np.minimum.accumulate(depth))  # a gap without a piece closes nothing
    level = np.where(step > 0, depth, depth + 1)
    free = (step < 0) & (np.concatenate(([0], depth[:-1])) == 0)
    level[free] = 0
    by_level = np.argsort(level, kind="stable")
    opened = order[by_level]
    pair = (step[by_level][:-1] > 0) & (step[by_level][1:] < 0) & (level[by_level][:-1] == level[by_level][1:])
    first = np.flatnonzero(pair)
    return opened[first], opened[first + 1] - len(pieces)


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence, from 0, and offset of each piece."""
    sequence, offset = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    left = np.argsort(-sizes, kind="stable")
    gaps, owner, opened = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while len(left):
        if len(gaps):
            got, gap = sweep(sizes[left], gaps)
            if len(got):
                sequence[left[got]], offset[left[got]] = owner[gap], length - gaps[gap]
                gaps[gap] -= sizes[left[got]]
                left = np.delete(left, got)
                if len(left):
                    useful = gaps >= sizes[left[-1]]
                    gaps, owner = gaps[useful], owner[useful]
                continue
        # No piece finds a gap. Those above half a sequence open one each, which no two can share; or a quarter of what
        # the rest needs at least is opened, so that large pieces are not all spread before gaps are known.
        new = max(int(np.count_nonzero(2 * sizes[left] > length)), -(-int(sizes[left].sum()) // (4 * length)))
        sequence[left[:new]] = opened + np.arange(new)
        gaps, owner = np.concatenate((gaps, length - sizes[left[:new]])), np.concatenate((owner, opened + np.arange(new)))
        opened, left = opened + new, left[new:]
    return sequence, offset


def pack(docs: DataFrame, tokenizer_file: str, *, length: int = LENGTH, end: int = END, stripe: int = STRIPE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id. Texts of any length are encoded whole. Rows that repeat a doc_id are packed each.
    An empty table gives no rows. Columns but doc_id and text are not read.
    """
    if length < 1:
        raise ValueError("length must be positive")
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = token_pieces(docs, tokenizer_file, length, end)
    pieces = scratch.table(pieces.withColumn("at", F.monotonically_increasing_id()), "pieces")
    stripes = max(1, -(-pieces.count() // stripe))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_fit(rows["length"].to_numpy(), length)
        return rows[names].assign(sequence_id=sequence + (np.int64(key[0]) << 40), offset=offset)

    # The id is text on the way through pandas, where beside nulls it would become a float.
    dealt = pieces.withColumn("stripe", F.pmod(F.xxhash64("at"), F.lit(stripes)).cast("int")).withColumn("doc_id", F.col("doc_id").cast("string")).drop("at")
    packed = dealt.groupBy("stripe").applyInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())
