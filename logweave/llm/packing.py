"""Best-fit packing with hierarchical residual bins.

Pieces are packed best-fit inside many buckets, and nearly full bins are final.  The underfull ones are
opened, and their pieces are the items of the next level, roomiest bins first and at most half as many
pieces as the level had.  So each level has half the buckets or fewer, and the last is one bucket.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

MAX_TOKENS, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Items that one bucket packs.
BUCKET_ITEMS = 20_000
#: A bin from this share of the capacity on is final.
NEARLY_FULL = 0.99
#: What a Python worker remembers before it starts anew: distinct words, ids of these. Bytes encoded at a time.
CACHED_WORDS, CACHED_IDS, PART_BYTES = 600_000, 4_000_000, 6_000_000
#: Words of printable ASCII and of Latin letters that no normal form changes; once lower-cased they fall into
#: runs by the tokenizer's own rule. Its model takes a character for each byte, printable ones for themselves.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^!-`{-~]+|[0-9]|[!-/:-`{-~]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(0x100)} - {*_SHOWN}))}
_vocabularies: dict[str, _Vocabulary] = {}
_MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,copy:bigint,offset:bigint>>"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Vocabulary:
    """The words that a worker has met: each one's place in one array of ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.runs: dict[str, list[int]] = {}
        self.ids, self.ends = array("I"), array("i", [0])

    def _ids(self, word: str) -> list[int]:
        """Plain words are cut into runs here and the model sees each different run once; others, and
        what may be a special token, go through the whole tokenizer."""
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for run in _RUNS.findall(word.lower()):
            if run not in self.runs:
                shown = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTES)
                self.runs[run] = [t.id for t in self.model.tokenize(shown)]
            out += self.runs[run]
        return out

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word; words not met yet are encoded."""
        index = self.index
        for word in words:
            if word not in index:
                index[word] = len(self.ends) - 1
                self.ids.extend(self._ids(word))
                self.ends.append(len(self.ids))
        return np.array([index[w] for w in words], dtype=np.int32)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all texts one after the other, and where each text ends. The tokenizer
    drops white space and splits there first, so each different word is encoded once."""
    if path not in _vocabularies:
        _vocabularies[path] = _Vocabulary(path)
    known = _vocabularies[path]
    if len(known.index) > CACHED_WORDS or len(known.ids) > CACHED_IDS:
        known.clear()
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    place = known.places(words.dictionary.to_pylist())[np.asarray(words.indices)]
    # A text of an Arrow batch has less than 2**31 bytes, and no more ids.
    ends, ids = np.array(known.ends, dtype=np.int32), np.array(known.ids, dtype=np.uint32)
    first, size = ends[place], ends[place + 1] - ends[place]
    after = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=after[1:])
    taken = ids[np.repeat(first - after[:-1], size) + np.arange(after[-1], dtype=np.int32)]
    bounds = np.asarray(lists.offsets)
    return taken, after[bounds[1:] - bounds[0]].astype(np.int64)


def _parts(texts: pa.Array):
    """Slices of the texts of about PART_BYTES each, one text at least."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + PART_BYTES, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def tokenize(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Pieces of at most max_tokens ids of each document: ids of the text, then the end id.

    Null and empty texts give one piece with the end id alone; repeated rows repeat their pieces.  Texts of
    any length are encoded whole.  An empty table gives an empty result.  Other columns are not read.
    """
    path = path or tokenizer_path()

    def cut(batches):
        for batch in batches:
            for at, texts in _parts(batch.column(1).fill_null("")):
                ids, ends = token_ids(texts, path)
                n = len(texts)
                full = np.full(len(ids) + n, END_ID, dtype="<u4")
                stops = ends + np.arange(1, n + 1)
                body = np.ones(len(full), dtype=bool)
                body[stops - 1] = False
                full[body] = ids
                starts = np.concatenate(([0], stops[:-1]))
                count = -(-(stops - starts) // max_tokens)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * max_tokens
                length = np.minimum(max_tokens, np.repeat(stops - starts, count) - start)
                first, data = np.repeat(starts, count) + start, memoryview(full).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                doc_id = batch.column(0).slice(at, n).take(pa.array(np.repeat(np.arange(n), count)))
                yield pa.RecordBatch.from_arrays(
                    [doc_id.cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item. Items come in decreasing length, each goes to the open bin with the
    least room that takes it; a bit per amount of room finds that bin."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fit = mask >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            b, room, bins = bins, capacity, bins + 1
        out[i] = b
        if left := room - need:
            rooms[left].append(b)
            mask |= 1 << left
    return out


def _goes_on(level: list[tuple[int, int]], capacity: int) -> int:
    """The greatest total of the bins that go on, 0 for none, given how many pieces the bins of each total have.
    Without a bin up to half full no two fit together, so none goes on.  Bins up to half full always do,
    fuller ones while they are not nearly full and have, with those before them, at most half of the pieces."""
    half, all_pieces = capacity // 2, sum(n for _, n in level)
    limit, pieces = 0, 0
    for total, n in sorted(level):
        pieces += n
        if total <= half:
            limit = half
        elif not limit or total >= NEARLY_FULL * capacity or 2 * pieces > all_pieces:
            break
        else:
            limit = total
    return limit


def _copies_numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``copy``, the number of each among rows that repeat it. Rows are counted, then made
    again by thousands, so a piece with many copies is never held at once."""
    counted = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("n"))
    thousands = counted.withColumn("k", F.explode(F.expr("sequence(0L, (n - 1) DIV 1000)")))
    return thousands.select(*pieces.columns, F.explode(F.expr("sequence(1000 * k, least(1000 * k + 999, n - 1))")).alias("copy"))


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """Pieces with ``sequence_id, offset``: bins of at most max_tokens tokens without gaps.

    Rows that repeat a piece are packed one by one.  Buckets are dealt by a hash of the piece and of its
    number among those that repeat it, so no source, length or copy is hot, and hold bucket_items items on
    average; of equally long items the hash decides which comes first.  So the bins are the same however the
    pieces lie in files.  Levels end when one bucket holds all items that are left, or none
    of the bins left fits another.  An empty table gives an empty result.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    pieces = scratch.keep(_copies_numbered(pieces), "pieces")
    one = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", "copy", F.lit(0).cast("long").alias("offset")))
    whole = F.col("length") >= max_tokens
    final = [scratch.keep(pieces.where(whole).select(F.monotonically_increasing_id().alias("sequence_id"), one.alias("members")), "whole")]
    h = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", "copy")
    items = scratch.keep(pieces.where(~whole).select(h.alias("item"), F.col("length").alias("total"), one.alias("members")), "items")
    level, n = 0, items.count()
    buckets = 2 * n
    while n:
        buckets = min(-(-n // bucket_items), -(-buckets // 2))
        level += 1
        dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(buckets)))
        bins = scratch.keep(dealt.groupBy("bucket").applyInPandas(_packer(level, max_tokens), f"sequence_id long, total long, members {_MEMBERS}"), f"level{level}")
        # At most max_tokens totals.
        level_of = bins.groupBy("total").agg(F.sum(F.size("members"))).collect() if buckets > 1 else []
        limit = _goes_on(level_of, max_tokens)
        final.append(bins.where(F.col("total") > limit).select("sequence_id", "members"))
        opened = bins.where(F.col("total") <= limit).select(F.explode("members").alias("m"))
        items = opened.select(F.xxhash64("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "m.copy").alias("item"), F.col("m.length").alias("total"), F.array("m").alias("members"))
        n = items.count() if limit else 0
    scratch.drop("pieces", "items")
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out.select("sequence_id", F.inline("members")).drop("copy")


def _packer(level: int, max_tokens: int):
    """Packs one bucket."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["total", "item"], ascending=[False, True], kind="stable")
        bins: dict[int, list] = {}
        for b, members in zip(best_fit(pdf["total"].tolist(), max_tokens), pdf["members"]):
            bins.setdefault(b, []).extend(members)
        rows = []
        for b, members in bins.items():
            at = 0
            for m in members:
                m["offset"] = at
                at += m["length"]
            rows.append(((level << 56) | (int(key[0]) << 28) | b, at, members))
        return pd.DataFrame(rows, columns=["sequence_id", "total", "members"])

    return run


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(tokenize(table(spark, sf_dir, "documents")))
