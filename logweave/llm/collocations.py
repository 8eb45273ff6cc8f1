"""Phrase collocations by counting quotient filters.

Texts are coded in blocks, each with a dictionary of its own; words that occur often enough get numbers
for the whole corpus.  The word numbers of an n-gram are packed into one key of 64 or 128 bits, and an
invertible permutation spreads the keys evenly.  A block's counter is a sorted filter: the first bits
of a permuted key, its quotient, are kept as the number of keys in each slot, the remainder in full,
so no two n-grams share a counter.  Filters of equal ranges of quotients are merged across
blocks, in a tree where there are many, and the permutation is undone.

Pairs of words are counted first.  A longer phrase occurs no more often than each pair in it, so longer
n-grams are counted only where a bitmap of fixed size says of all their pairs that they may be
frequent; where it errs, there is a counter more, never one less.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: The score of a phrase is floor(SCALE * a / (l + r)); a phrase goes if a longer one has this percentage of it.
SCALE, COVERED = 2_000_000, 80
#: Characters that end a piece, as a class of a regular expression.
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
#: Bytes of text in a block, n-grams that one merge meets, blocks (or filters) that one merge meets.
BLOCK_BYTES, MERGE_GRAMS, FAN_IN = 6_000_000, 500_000, 4_096
#: The bitmap of frequent pairs has 2 ** PAIR_BITS bits, whatever the corpus; words of a bucket that is numbered at once.
PAIR_BITS, BUCKET_WORDS = 26, 1_000
_BLOCK = "lang string, n long, codes binary, words array<string>, counts array<long>"
_FILTER = "lang string, n int, prefix long, group long, filter binary"
_ROUNDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# --- keys -------------------------------------------------------------------------------------------


def word_bits(n: int, wide: bool) -> int:
    """Bits of a word number in the key of an n-gram."""
    return 32 if wide else 64 // n


def _mixed(x: np.ndarray, by: np.uint64, half: int) -> np.ndarray:
    x = x * by
    x ^= x >> np.uint64(29)
    x *= _ROUNDS[0]
    return x >> np.uint64(64 - half) if half < 64 else x ^ (x >> np.uint64(32))


def permuted(columns: list[np.ndarray], wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Keys of n-grams, given a column of word numbers for each place: the first 64 bits and, of wide keys,
    the 64 after them. Rounds that change one half by the other can be undone."""
    n, b = len(columns), np.uint64(word_bits(len(columns), wide))
    if wide:
        zero = np.zeros_like(columns[0])
        a, c, d, e = [*columns, *[zero] * (4 - n)]
        left, right, half = a << b | c, d << b | e, 64
    else:
        key = np.zeros_like(columns[0])
        for x in columns:
            key = key << b | x
        left, right, half = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF), 32
    for by in _ROUNDS:
        left, right = right, left ^ _mixed(right, by, half)
    return (left, right) if wide else (left << np.uint64(32) | right, None)


def unpermuted(hi: np.ndarray, lo: np.ndarray | None, n: int) -> list[np.ndarray]:
    """The columns of word numbers of the keys."""
    wide = lo is not None
    left, right, half = (hi, lo, 64) if wide else (hi >> np.uint64(32), hi & np.uint64(0xFFFFFFFF), 32)
    for by in reversed(_ROUNDS):
        left, right = right ^ _mixed(left, by, half), left
    if wide:
        parts = [left >> np.uint64(32), left & np.uint64(0xFFFFFFFF), right >> np.uint64(32), right & np.uint64(0xFFFFFFFF)]
        return parts[:n]
    key, b = left << np.uint64(32) | right, word_bits(n, False)
    return [key >> np.uint64(b * (n - 1 - i)) & np.uint64((1 << b) - 1) for i in range(n)]


def folded(hi: np.ndarray, lo: np.ndarray | None, counts: np.ndarray):
    """Sorted different keys and the sums of their counts."""
    order = np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))
    hi, counts = hi[order], counts[order]
    new = np.ones(len(hi), dtype=bool)
    new[1:] = hi[1:] != hi[:-1]
    if lo is not None:
        lo = lo[order]
        new[1:] |= lo[1:] != lo[:-1]
    at = np.flatnonzero(new)
    return hi[at], None if lo is None else lo[at], np.add.reduceat(counts, at) if len(at) else counts


# --- filters ----------------------------------------------------------------------------------------


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << (8 * w)))


def to_filter(hi: np.ndarray, lo: np.ndarray | None, counts: np.ndarray, prefix_bits: int) -> bytes:
    """A counting quotient filter of sorted keys that share their first prefix_bits: the numbers of keys in
    each slot, the remainders byte by byte, the counts."""
    n = len(hi)
    q = max(0, min(n.bit_length() - 1, 20, 64 - prefix_bits))
    r = 64 - prefix_bits - q
    slot = (hi >> np.uint64(r) & np.uint64((1 << q) - 1)).astype(np.int64) if q else np.zeros(n, dtype=np.int64)
    slots, kept = _narrow(np.bincount(slot, minlength=1 << q)), _narrow(counts)
    rest = (hi & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-r // 8)].T.tobytes()
    head = struct.pack("<qBBBB", n, q, slots.itemsize, kept.itemsize, lo is not None)
    return b"".join([head, slots.tobytes(), rest, b"" if lo is None else lo.astype("<u8").tobytes(), kept.tobytes()])


def from_filter(data: bytes, prefix: int, prefix_bits: int):
    """The keys and counts of a filter."""
    n, q, slot_size, count_size, wide = struct.unpack_from("<qBBBB", data)
    at, r = struct.calcsize("<qBBBB"), 64 - prefix_bits - q

    def take(kind: str, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=size, offset=at)
        at += out.nbytes
        return out

    slots, width = take(f"<u{slot_size}", 1 << q), -(-r // 8)
    rest = np.zeros((n, 8), dtype=np.uint8)
    rest[:, :width] = take("u1", n * width).reshape(width, n).T
    hi = rest.view("<u8").reshape(n).astype(np.uint64)
    if q:
        hi |= np.repeat(np.arange(1 << q, dtype=np.uint64), slots) << np.uint64(r)
    if prefix_bits:
        hi |= np.uint64(prefix << (64 - prefix_bits))
    lo = take("<u8", n).astype(np.uint64) if wide else None
    return hi, lo, take(f"<u{count_size}", n).astype(np.int64)


def _split(hi, lo, counts, bits: int):
    """(prefix, filter) for each range of sorted keys that has any."""
    if not len(hi):
        return
    if bits == 0:
        yield 0, to_filter(hi, lo, counts, 0)
        return
    prefix = (hi >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))).tolist()
    for a, b in zip(starts, [*starts[1:], len(hi)]):
        yield int(prefix[a]), to_filter(hi[a:b], None if lo is None else lo[a:b], counts[a:b], bits)


# --- blocks -----------------------------------------------------------------------------------------


def _coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, words, counts) of a block: the code of each word, -1 where a piece or a text ends. No word
    has a full stop in it, so it can stand for the ends."""
    ended = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=PIECE_ENDS + "+", replacement=" . ")
    found = pc.ascii_split_whitespace(pc.binary_join_element_wise(ended, " .", "")).flatten().dictionary_encode()
    codes, words = np.array(found.indices, dtype=np.int32), found.dictionary
    codes = codes[np.asarray(pc.not_equal(words, ""))[codes]]
    codes[np.asarray(pc.equal(words, "."))[codes]] = -1
    return codes, words, np.bincount(codes[codes >= 0], minlength=len(words))


def _small(codes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<i4").tobytes())


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<i4")


def _blocks(block_bytes: int):
    """Rows of _BLOCK from (lang, text): texts of one language come together until there are enough."""

    def run(batches):
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def flush(lang):
            codes, words, counts = _coded(pa.concat_arrays(held.pop(lang)))
            sizes.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([int(counts.sum())]), pa.array([_small(codes)], pa.binary()), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64()))],
                ["lang", "n", "codes", "words", "counts"])

        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = texts.filter(pc.equal(langs.indices, code))
                length = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
                at = 0
                while at < len(own):
                    room = block_bytes - sizes.get(lang, 0) + (int(length[at - 1]) if at else 0)
                    end = max(at + 1, int(np.searchsorted(length, room, side="right")))
                    held.setdefault(lang, []).append(own.slice(at, end - at))
                    sizes[lang] = sizes.get(lang, 0) + int(length[end - 1] - (length[at - 1] if at else 0))
                    at = end
                    if at < len(own) or sizes[lang] >= block_bytes:
                        yield flush(lang)
            while sum(sizes.values()) > 2 * block_bytes:  # many languages at once
                yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    return run


def _known(batches):
    """(lang, group, ids) from (lang, group, codes, known): the numbers of a block's words, -1 for the others
    and where a piece ends."""
    for batch in batches:
        out = []
        for codes, known in zip(batch.column(2), batch.column(3)):
            codes, pairs = _large(codes.as_py()), known.values
            code, number = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            numbers = np.full(int(max(codes.max(), code.max())) + 2, -1, dtype=np.int64)
            numbers[code] = number
            out.append(_small(numbers[codes]))  # code -1 meets the last place, which is -1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "group", "ids"])


def _pair_bits(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bit of each pair of words in the bitmap."""
    key, _ = permuted([first.astype(np.uint64), second.astype(np.uint64)], False)
    return ((key ^ np.uint64(zlib.crc32(lang.encode()))) * _ROUNDS[1] >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _bitmap(pairs: DataFrame) -> bytes:
    """The bitmap of the pairs, put together from slices of 32,768 bits: 2 ** (PAIR_BITS - 3) bytes for any corpus."""

    @F.pandas_udf("long")
    def bit_of(langs: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([int(_pair_bits(lang, x[:1], x[1:2])[0]) for lang, x in zip(langs, ids)], dtype="int64")

    bit = pairs.select(bit_of("lang", "ids").alias("bit"))
    slices = bit.groupBy(F.floor(F.col("bit") / 32_768).alias("slice")).agg(F.bitmap_construct_agg(F.col("bit") % 32_768).alias("bits")).collect()
    out = bytearray(1 << (PAIR_BITS - 3))
    for at, bits in slices:
        out[4_096 * at : 4_096 * (at + 1)] = bits
    return bytes(out)


def _filters(bits: int, wide: dict[int, bool], frequent=None):
    """Rows of _FILTER from (lang, group, ids): the n-grams of known words of the lengths in ``wide``. With a
    broadcast bitmap, of those whose pairs all may be frequent."""

    def run(batches):
        for batch in batches:
            for lang, group, ids in zip(*(batch.column(i) for i in range(3))):
                lang, group, ids, rows = lang.as_py(), group.as_py(), _large(ids.as_py()), []
                unsigned = ids.astype(np.uint64)
                pair = (ids[:-1] >= 0) & (ids[1:] >= 0)
                if frequent is not None:
                    at = np.flatnonzero(pair)
                    place = _pair_bits(lang, ids[at], ids[at + 1])
                    pair[at] = np.frombuffer(frequent.value, dtype=np.uint8)[place >> 3] >> (place & 7) & 1
                fine = pair
                for n in range(2, max(wide) + 1):
                    if n > 2:
                        fine = fine[:-1] & pair[n - 2 :]
                    at = np.flatnonzero(fine)
                    if not len(at):
                        break
                    if n in wide:
                        hi, lo = permuted([unsigned[at + i] for i in range(n)], wide[n])
                        got = folded(hi, lo, np.ones(len(hi), dtype=np.int64))
                        rows += [(lang, n, prefix, group, data) for prefix, data in _split(*got, bits)]
                if rows:
                    yield pa.RecordBatch.from_pydict(_filter_rows(rows))

    return run


def _sum(filters: pa.ChunkedArray, prefix: int, bits: int):
    """All filters of one range of quotients as one."""
    parts = [from_filter(data.as_py(), prefix, bits) for data in filters]
    hi, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
    return folded(hi, None if parts[0][1] is None else np.concatenate([p[1] for p in parts]), counts)


def _filter_rows(rows: list[tuple]) -> dict[str, pa.Array]:
    kinds = {"lang": pa.string(), "n": pa.int32(), "prefix": pa.int64(), "group": pa.int64(), "filter": pa.binary()}
    return {name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), zip(*rows))}


def _merged(bits: int, finer: int, groups: int):
    """Merges one group and deals what comes out to finer ranges and fewer groups."""

    def run(key, group):
        lang, n, prefix, number = (k.as_py() for k in key)
        return pa.table(_filter_rows([(lang, n, p, number % groups, data) for p, data in _split(*_sum(group["filter"], prefix, bits), finer)]))

    return run


def _counts(bits: int, min_count: int):
    """Merges what is left of a range and undoes the permutation for the keys that are counted often enough."""

    def run(key, group):
        lang, n, prefix = (k.as_py() for k in key)
        hi, lo, counts = _sum(group["filter"], prefix, bits)
        often = counts >= min_count
        columns = unpermuted(hi[often], None if lo is None else lo[often], n)
        ids = pa.array(np.stack(columns, axis=1).astype(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, n, dtype=np.int32)), ids)
        return pa.table({"lang": pa.array([lang] * len(lists), pa.string()), "ids": lists, "f": pa.array(counts[often])})

    return run


# --- phrases ----------------------------------------------------------------------------------------


def _numbered(vocabulary: DataFrame) -> DataFrame:
    """``lang, word, f, id``: numbers from 0 without gaps in each language. Words are numbered in small
    buckets, and a running sum over the buckets, not over the words, says where each begins."""
    buckets = vocabulary.count() // BUCKET_WORDS + 1
    dealt = vocabulary.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    before = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("lang", "bucket").agg(F.count("*").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("word")) - 1
    return dealt.withColumn("place", place).join(starts.drop("size"), ["lang", "bucket"]).select("lang", "word", "f", (F.col("start") + F.col("place")).alias("id"))


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def phrase_counts(docs: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                  block_bytes: int = BLOCK_BYTES, merge_grams: int = MERGE_GRAMS, fan_in: int = FAN_IN, wide: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, vocabulary, grams): ``lang, n`` words of each language; ``lang, word, f, id`` and ``lang, ids,
    f`` of words and of n-grams up to max_words that occur min_count times. wide: keys of 128 bits
    even where 64 are enough."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = scratch.keep(texts.mapInArrow(_blocks(block_bytes), _BLOCK).select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
    totals = scratch.keep(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).where("w.counts > 0").select("block", "lang", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    often = words.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    vocabulary = scratch.keep(_numbered(scratch.keep(often, "often")), "vocabulary")
    known = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    n_blocks, all_words = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups, bits, step = max(1, -(-n_blocks // fan_in)), max(0, (all_words // merge_grams).bit_length()), max(1, fan_in.bit_length() - 1)
    coded = blocks.join(known, "block").select("lang", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), "codes", "known")
    coded = scratch.keep(coded.mapInArrow(_known, "lang string, group long, ids binary"), "coded")
    scratch.drop("blocks", "often")
    most = vocabulary.groupBy("lang").agg(F.count("*").alias("size")).agg(F.max("size")).first()[0] or 0
    is_wide = {n: bool(wide) or most > 1 << word_bits(n, False) for n in range(2, max_words + 1)}

    def counted(name: str, lengths: dict[int, bool], frequent=None) -> DataFrame:
        left, at, level = groups, min(bits, step), 0
        filters = coded.mapInArrow(_filters(at, lengths, frequent), _FILTER)
        while left > 1:
            left, finer, level = -(-left // fan_in), min(bits, at + step), level + 1
            filters = scratch.keep(filters.groupBy("lang", "n", "prefix", "group").applyInArrow(_merged(at, finer, left), _FILTER), f"{name}{level}")
            at = finer
        return scratch.keep(filters.groupBy("lang", "n", "prefix").applyInArrow(_counts(at, min_count), "lang string, ids array<long>, f long"), name)

    pairs = counted("pairs", {2: is_wide[2]})
    if max_words == 2:
        return totals, vocabulary, pairs
    frequent = spark.sparkContext.broadcast(_bitmap(pairs))
    return totals, vocabulary, pairs.unionByName(counted("longer", {n: w for n, w in is_wide.items() if n > 2}, frequent))


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    A phrase of 2 to 4 words that occurs a >= min_count times within pieces is scored at each cut by
    its count against those of its two parts, and the lowest score counts; phrases that a longer one
    mostly stands for go.  A null language is ``und``, as a language of that name is; null and empty
    texts have no words, texts of any length are read whole, repeated rows count as often as they
    occur.  Ties go by a, then by the bytes of the phrase.  Other columns aren't read.  An empty table
    gives an empty result.  options: see phrase_counts.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    totals, vocabulary, grams = phrase_counts(docs, scratch, min_count=min_count, **options)
    size = F.size("ids")
    parts = grams.unionByName(vocabulary.select("lang", F.array("id").alias("ids"), "f"))
    cuts = grams.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "ids", F.col("f").alias("a"), "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    side = lambda part, count: parts.select("lang", F.col("ids").alias(part), F.col("f").alias(count))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = cuts.groupBy("lang", "ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("lang", "ids", "a", "s.score", "s.l", "s.r")
    # The greatest count of a longer phrase that holds a phrase decides whether it goes.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    longer = grams.where(size > 2).select("lang", F.explode(inner).alias("ids"), "f").groupBy("lang", "ids").agg(F.max("f").alias("longer"))
    covered = F.coalesce(_exact("longer") * 100 >= _exact("a") * COVERED, F.lit(False))
    left = scored.join(longer, ["lang", "ids"], "left").where(~covered).drop("longer")
    # What can be among the first by score and count gets its words, then its place.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    left = scratch.keep(left.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"), "left")
    spelt = left.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(vocabulary.select("lang", "id", "word"), ["lang", "id"])
    spelt = spelt.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = left.join(spelt, ["lang", "ids"]).withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    out = scratch.keep(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")), "top")
    scratch.only("top")
    return out


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m)) t),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, a, phrase, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT lang, phrase, a, m, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c) t),
s AS (SELECT k.*, x.a AS l, y.a AS r, (2000000::HUGEINT * k.a) // (x.a + y.a) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = lp JOIN f y ON y.lang = k.lang AND y.phrase = rp),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS p FROM s) t WHERE p = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + z - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM c, (VALUES (2), (3)) v(z) WHERE z < m) t GROUP BY ALL),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM b JOIN n ON n.lang = b.lang WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * longer::HUGEINT >= 80 * b.a::HUGEINT)) t WHERE rank <= 2000
"""
