"""MinHash near-dedup by an inverted join over signature coordinates.

1. Every text becomes its set of word shingles; rows with equal sets are one class.
2. Each class has a signature of K coordinates and is posted under its coordinate values.
   Values that one class alone has can't be shared and go; a class left with fewer values than
   the matches that a candidate needs can't match any other.
3. Two classes that agree on m of K coordinates share one of the K - m + 1 rarest values of each
   (prefix filter), so only those are posted.
4. Shingles that one class alone has are in no intersection, which bounds a class's similarity to
   any other; a class that can't be linked to any member of a posting leaves it.
5. Short postings give their pairs.  Long postings are skipped in that merge: pivots are compared
   with all members, and the triangle inequality of the Jaccard distance settles most other
   pairs.  Once all but a few members of a posting are one component, the posting is joined with those
   few.  The join counts the collisions of both signatures and compares sizes and parity bitmaps of
   the full sets, and only what may be linked becomes a pair; what is left goes on with more pivots.
6. Pairs whose signatures agree often enough are confirmed on the full shingle sets; links give
   components by alternating large-star and small-star steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, Scratch, numbered, table

#: PERCENT is the limit of op7_near_dedup, STAGE_PERCENT that of a stage without one of its own.
SHINGLE, PERCENT, STAGE_PERCENT = 5, 85, 80
#: Signature length, and the share of pairs of just the similarity asked for that may have too few matches.
K, MISSED = 48, 1e-6
#: Postings up to this length give all their pairs.
SHORT = 8
#: A list with at most so many members outside its main component is settled by joining those with its
#: other members; that looks at up to this many others a member, but makes few pairs. Longer rests take pivots.
FEW = 512
_RNG = np.random.RandomState(1)
_MULT = (_RNG.randint(0, 2**32, K, dtype=np.uint64) << np.uint64(32) | _RNG.randint(0, 2**32, K, dtype=np.uint64)) | np.uint64(1)
_ADD = _RNG.randint(0, 2**32, K, dtype=np.uint64) << np.uint64(32) | _RNG.randint(0, 2**32, K, dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def matches_at(percent: int) -> int:
    """The matches that a candidate needs: of the pairs at this similarity, less than MISSED have fewer
    of K. 27 at 85 percent, 24 at 80, 18 at 70, 13 at 60."""
    p, tail = max(0, percent) / 100, 0.0
    for k in range(K):
        tail += math.comb(K, k) * p**k * (1 - p) ** (K - k)
        if tail >= MISSED:
            return k
    return K


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text (A-Z lower-cased). A text with
    fewer words is one shingle; one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((known.get(w) or known.setdefault(w, digest(w)) for w in words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    code = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        code = (code ^ h[i : i + n]) * _ODD[i % len(_ODD)]
        code ^= code >> np.uint64(29)
    return np.unique(code)


def signature(codes: np.ndarray) -> np.ndarray:
    """The K coordinates, 32 bits each."""
    out = np.empty(K, dtype=np.uint32)
    step = max(1, 200_000 // K)
    least = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(codes), step):
        block = codes[at : at + step, None] * _MULT[None, :] + _ADD[None, :]
        np.minimum(least, block.min(axis=0), out=least)
    out[:] = least >> np.uint64(32)
    return out


def _small(batches, rows: int = 1_000):
    """Slices of the batches, so that a worker holds the sets of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketch(batches):
    for batch in _small(batches):
        rows = []
        for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            codes = shingles(text)
            n = len(codes)
            both = xxhash.xxh3_128_digest(codes.tobytes()) if n else None
            rows.append((uid, doc_id, n, both, signature(codes).tobytes() if n else None))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], ["uid", "doc_id", "n", "same", "sig"])


def _post(batches):
    """(coordinate << 32 | value, uid) of each signature."""
    place = np.arange(K, dtype=np.int64) << 32
    for batch in batches:
        uids = np.asarray(batch.column(0))
        for at in range(0, len(uids), 2_000):
            sigs = np.frombuffer(b"".join(batch.column(1).slice(at, 2_000).to_pylist()), dtype=np.uint32).reshape(-1, K)
            keys = (sigs.astype(np.int64) | place[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(uids[at : at + 2_000], K))], ["key", "uid"])


def _parities(batches):
    """Bitmaps of sets: bit i says whether an odd number of the codes end in i. Two to four bits a code,
    a power of two of words; ``half`` is the bitmap of half as many bits."""
    for batch in _small(batches):
        bits, half = [], []
        for codes in (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in batch.column("set")):
            n = 64
            while n < 2 * len(codes):
                n *= 2
            odd = (np.bincount((codes & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8)
            words = np.packbits(odd, bitorder="little").view(np.int64)
            bits.append(words)
            half.append(words[: len(words) // 2] ^ words[len(words) // 2 :] if len(words) > 1 else words)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(bits, kind), pa.array(half, kind)], ["uid", "bits", "half"])


def _coordinates(batches):
    for batch in _small(batches):
        flat = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.int32)
        coords = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, K, dtype=np.int32), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("uid"), coords], ["uid", "coords"])


def _agree(batches):
    """Matching coordinates of the signatures of both sides."""
    for batch in _small(batches):
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, K) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((a == b).sum(axis=1).astype(np.int32))], ["a", "b", "m"])


def _measure(batches):
    """Sizes of the intersection and the union of the full sets of both sides."""
    for batch in _small(batches):
        inter, union = [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            inter.append(both)
            union.append(len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "inter", "total"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser node and no edge ends where another starts."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").count() == 0


def components(links: DataFrame, scratch: Scratch, name: str = "") -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the least node reachable.

    Large-star and small-star steps in turn; a neighbourhood is only ever reduced to its minimum,
    so a hub is no group in one task.  Stops when all edges lead straight to a root.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"edges{name}0")
    number = 0
    while not _stars(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        number += 1
        large = scratch.keep(large, f"large{name}{number}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"edges{name}{number}")
        scratch.drop(f"large{name}{number}", f"edges{name}{number - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


class _Pairs:
    """Compares pairs of classes: signatures first, then full sets."""

    def __init__(self, scratch: Scratch, sigs: DataFrame, sets: DataFrame, percent: int) -> None:
        self.scratch, self.sigs, self.sets, self.percent, self.number = scratch, sigs, sets, percent, 0
        # Near: within twice the link distance.
        self.matches, self.near_matches = matches_at(percent), matches_at(2 * percent - 100)

    def _both(self, pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
        return pairs.join(side.select(F.col("uid").alias("a"), F.col(value).alias(f"{value}_a")), "a").join(
            side.select(F.col("uid").alias("b"), F.col(value).alias(f"{value}_b")), "b")

    def traits(self, uids: DataFrame) -> DataFrame:
        """What a pair of these classes is judged by before it is made: bitmaps, and the signature's coordinates."""
        bits = self.sets.join(uids, "uid", "left_semi").mapInArrow(_parities, "uid long, bits array<long>, half array<long>")
        return bits.join(self.sigs.mapInArrow(_coordinates, "uid long, coords array<int>"), "uid")

    def compare(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) that are near by their signatures, and those of them that are linked."""
        self.number += 1
        near = self._both(pairs, self.sigs, "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(_agree, "a long, b long, m int").where(F.col("m") >= self.near_matches)
        near = self.scratch.keep(near, f"near{self.number}")
        sized = self._both(near.where(F.col("m") >= self.matches).select("a", "b"), self.sets, "set").select("a", "b", "set_a", "set_b")
        linked = sized.mapInArrow(_measure, "a long, b long, inter long, total long").where(F.col("inter") * 100 >= F.col("total") * self.percent)
        return near, self.scratch.keep(linked.select("a", "b"), f"linked{self.number}")


def _short_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of lists of at most SHORT members."""
    pick = "flatten(transform(l, (x, i) -> transform(filter(l, (y, j) -> j > i), y -> struct(x AS a, y AS b))))"
    return lists.groupBy("key").agg(F.array_sort(F.collect_list("uid")).alias("l")).select(F.expr(f"inline({pick})"))


def _linkable(least, percent: int) -> F.Column:
    """Whether a class of ``size`` shingles, ``common`` of them in other classes too, can be linked to
    one of at least ``least`` shingles: the intersection has at most ``common``."""
    return F.col("common") * 100 >= (F.col("size") + F.greatest(least, F.col("common")) - F.col("common")) * percent


def _differing(percent: int) -> F.Column:
    """Whether the parity bitmaps of two sets allow a link: the sets differ in at least as many codes as
    the bitmaps in bits, and linked ones in at most (100 - percent) / (100 + percent) of both sizes."""
    x, y = "if(size(bits) > size(bits_a), half, bits)", "if(size(bits_a) > size(bits), half_a, bits_a)"
    differ = F.expr(f"coalesce(aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v), 0)")
    return differ * (100 + percent) <= (F.col("size") + F.col("size_a")) * (100 - percent)


def _across(lists: DataFrame, few: DataFrame, pairs: _Pairs, name: str) -> DataFrame:
    """Pairs of the members of the lists ``few`` that aren't in one component, one of the pair at least
    outside the main component of its list.  The join along a list makes a pair only if its sizes, its
    bitmaps and the collisions of its signatures, counted there, allow a link.  A pair that several
    lists share comes from the least of them only.
    """
    members = lists.join(few, "key").select("key", "uid", "size", "common", "label", (F.col("label") != F.col("top.label")).alias("odd"))
    shared = members.groupBy("uid").agg(F.collect_list("key").alias("keys"))
    shared = pairs.scratch.keep(shared, f"{name}-lists")
    members = pairs.scratch.keep(members.join(shared.join(pairs.traits(shared.select("uid")), "uid"), "uid"), name)
    odd = members.where("odd").select("key", *(F.col(c).alias(f"{c}_a") for c in ("uid", "size", "common", "label", "keys", "bits", "half", "coords")))
    least = F.least("common", "common_a")
    linkable = least * 100 >= (F.col("size") + F.col("size_a") - least) * pairs.percent
    wanted = (F.col("label") != F.col("label_a")) & (~F.col("odd") | (F.col("uid_a") < F.col("uid"))) & linkable
    first = F.array_min(F.array_intersect("keys", "keys_a")) == F.col("key")
    collisions = F.expr("aggregate(zip_with(coords, coords_a, (x, y) -> if(x = y, 1, 0)), 0, (s, v) -> s + v)")
    found = members.join(odd, "key").where(wanted & _differing(pairs.percent) & (collisions >= pairs.matches) & first)
    return found.select(F.least("uid_a", "uid").alias("a"), F.greatest("uid_a", "uid").alias("b"))


def _components(postings: DataFrame, pairs: _Pairs, scratch: Scratch) -> DataFrame:
    """(node, root) of the components over all links between members of a posting.

    Postings whose members are one component by the links so far are settled.  Of the others, short
    ones give all their pairs, and those with few members outside their main component the pairs of
    these.  A long one is compared with some pivots, 16 times as many each round:
    members linked to a pivot p can only be linked to members near p (within twice the link
    distance), so p's near members go on as one list, and those linked to no pivot as another.
    A member linked to several pivots is settled by the list of one of them, so a pivot that is
    nobody's choice has no list.  As pivots leave their list and their share grows, every list ends.
    """
    lists, links, number = postings, None, 0
    while True:
        if links is not None:
            roots = components(links, scratch, f"r{number}-")
            large = roots.join(roots.groupBy("root").agg(F.count("*").alias("members")), "root")
            lists = lists.join(large, F.col("uid") == F.col("node"), "left").select(
                "key", "uid", "size", "common", F.coalesce("root", "uid").alias("label"), F.coalesce("members", F.lit(1)).alias("members"))
        else:
            lists = lists.withColumns({"label": F.col("uid"), "members": F.lit(1).cast("long")})
        # The pivot met by all has the fewest shingles of its own: it is the likeliest to be linked to the rest.
        order = F.struct("members", F.col("common") / F.col("size"), F.xxhash64("label"), F.xxhash64("uid"))
        sizes = lists.groupBy("key").agg(
            F.count("*").alias("n"), F.min("size").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("y"),
            F.max_by(F.struct("uid", "label"), order).alias("top"), F.min_by("uid", order).alias("low")).where("lo < hi")
        # Lists with the same members count once.
        sizes = sizes.groupBy("n", "x", "y").agg(F.min_by(F.struct("key", "top", "low", "least"), "key").alias("s")).select("n", "s.*")
        before = lists
        lists = scratch.keep(lists.join(sizes, "key").where(_linkable(F.col("least"), pairs.percent)), f"lists{number}")
        scratch.drop(f"next{number}")
        if lists.isEmpty():
            return roots if links is not None else components(before.select(F.col("uid").alias("a"), F.col("uid").alias("b")).limit(0), scratch)
        number += 1
        long = lists.where(F.col("n") > SHORT)
        every = _short_pairs(lists.where(F.col("n") <= SHORT))
        if links is not None:
            # Lists of which only members of the main component were left have no odd ones and are settled.
            odd = scratch.keep(long.where("label != top.label").groupBy("key").agg(F.count("*").alias("odd")), f"odd{number}")
            every = every.unionByName(_across(long, odd.where(F.col("odd") <= FEW).select("key"), pairs, f"members{number}"))
            long = long.join(odd.where(F.col("odd") > FEW), "key", "left_semi")
        joined = lambda linked: linked if links is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked)
        if long.isEmpty():
            return components(joined(pairs.compare(every.distinct())[1]), scratch, "last-")
        # Pivots: one of the largest component, met by all, and some of the others, met by all but their own.
        share = F.lit(float(16 ** (number - 1))) / F.col("n")
        drawn = (F.col("label") != F.col("top.label")) & (F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
        chosen = drawn | (F.col("uid") == F.col("top.uid")) | (F.col("uid") == F.col("low"))
        pivots = scratch.keep(long.where(chosen).select("key", F.col("uid").alias("pivot"), F.when(F.col("uid") != F.col("top.uid"), F.col("label")).alias("own")), f"pivots{number}")
        met = long.select("key", "uid", "size", "common", "label").join(pivots, "key").where("uid != pivot AND (own IS NULL OR own != label)")
        met = met.select("key", "uid", "size", "common", "pivot", F.col("own").isNotNull().alias("drawn"))
        met = scratch.keep(met, f"met{number}")
        near, linked = pairs.compare(every.unionByName(met.select(F.least("pivot", "uid").alias("a"), F.greatest("pivot", "uid").alias("b"))).distinct())
        links = joined(linked)
        both = lambda d: d.select("a", "b").unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnsRenamed({"a": "pivot", "b": "uid"})
        gone = pivots.select("key", F.col("pivot").alias("uid"))
        left = met.join(gone, ["key", "uid"], "left_anti")  # members that are no pivots
        tied = left.join(both(linked), ["pivot", "uid"], "left_semi").groupBy("key", "uid").agg(F.min(F.struct("drawn", "pivot")).alias("home"))
        tied = scratch.keep(tied.select("key", "uid", "home.pivot"), f"tied{number}")
        around = left.join(tied.select("key", "pivot").distinct(), ["key", "pivot"], "left_semi").join(both(near), ["pivot", "uid"])
        around = around.select(F.xxhash64("key", "pivot").alias("key"), "uid", "size", "common")
        alone = long.select("key", "uid", "size", "common").join(gone.unionByName(tied.select("key", "uid")), ["key", "uid"], "left_anti")
        lists = scratch.keep(around.unionByName(alone), f"next{number}")
        scratch.drop(f"met{number}", f"tied{number}", f"pivots{number}", f"near{number}", f"lists{number - 1}")


def near_dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """One row per input row: ``__row_uid, doc_id, n_shingles, component_id, kept, stays``.

    Documents are linked when ``100 * intersection >= percent * union`` of their shingle sets.
    component_id is the smallest id reachable over links, the row itself included; kept says that
    it is the row's own.  stays holds for exactly one row of a component, also where ids repeat or
    are null (a component of null ids alone has a null component_id).  Texts without words, empty
    and null ones have no shingles and are linked with nothing.  Rows that repeat another are in
    its component.  Sets of texts of any length are whole.  Of rows with the least id of a component the one
    with the least number stays.  An empty table gives an empty result.  Other columns are not read, so they
    can't clash.  uid_col: the column that numbers the rows, if they have numbers; they must be stored ones.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    matches = max(1, matches_at(percent))
    named = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    rows = docs.select(F.col(uid_col).alias(UID), *named) if uid_col else numbered(docs.select(*named), scratch).select(UID, "row.*")
    sketched = rows.select(F.col(UID), "doc_id", "text").mapInArrow(_sketch, "uid long, doc_id long, n long, same binary, sig binary")
    sketched = scratch.keep(sketched, "sketched")
    classes = sketched.where("same IS NOT NULL").groupBy("same").agg(F.min("uid").alias("rep"))
    classes = scratch.keep(classes, "classes")
    sigs = sketched.join(classes.select(F.col("rep").alias("uid")), "uid").select("uid", "sig")
    posted = sigs.mapInArrow(_post, "key long, uid long")
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(posted.join(counts, "key").select("uid", F.struct("n", "key").alias("v")), "shared")
    enough = shared.groupBy("uid").agg(F.array_sort(F.collect_list("v")).alias("l")).where(F.size("l") >= matches)
    # The rarest values: of the K - matches + 1 that a prefix has, those that the class alone has come first and go.
    prefix = enough.select("uid", F.explode(F.expr(f"slice(l, 1, greatest(1, size(l) - {matches} + 1))")).alias("v"))
    prefix = scratch.keep(prefix.select(F.col("v.key").alias("key"), "uid"), "prefix")
    scratch.drop("shared")
    some = prefix.select("uid").distinct()
    sigs = scratch.keep(sigs.join(some, "uid"), "sigs")

    def full_sets(batches):
        for batch in _small(batches):
            sets = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sets, pa.binary())], ["uid", "set"])

    sets = rows.select(F.col(UID).alias("uid"), "text").join(some, "uid", "left_semi").mapInArrow(full_sets, "uid long, set binary")
    sets = scratch.keep(sets, "sets")

    def spread(batches):
        for batch in _small(batches):
            codes = [np.frombuffer(s.as_buffer(), dtype=np.int64) for s in batch.column("set")]
            n = [len(c) for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("uid")), n)), pa.array(np.concatenate([np.zeros(0, np.int64), *codes]))], ["uid", "code"])

    lone = sets.select("uid", "set").mapInArrow(spread, "uid long, code long").groupBy("code").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    lone = lone.where("n = 1").groupBy("uid").agg(F.count("*").alias("lone"))
    sizes = sets.select("uid", (F.octet_length("set") / 8).cast("long").alias("size")).join(lone, "uid", "left")
    sizes = scratch.keep(sizes.select("uid", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("common")).where(_linkable(F.lit(0), percent)), "sizes")
    prefix = scratch.keep(prefix.join(sizes, "uid"), "linkable")
    roots = _components(prefix, _Pairs(scratch, sigs, sets, percent), scratch)
    classes = classes.join(roots, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("root", "rep").alias("root"))
    placed = sketched.join(classes, "same", "left").select("uid", "doc_id", "n", F.coalesce("root", "uid").alias("root"))
    placed = scratch.keep(placed, "placed")
    # Components of several rows alone are joined, as a table, so that the rows of a large one can be split.
    first = placed.groupBy("root").agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("least"), F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("stay")).where("rows > 1")
    first = scratch.keep(first, "components")
    scratch.only("placed", "components")
    component = F.coalesce("least", "doc_id")
    return placed.join(first, "root", "left").select(
        F.col("uid").alias(UID), "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce(F.col("uid") == F.col("stay"), F.lit(True)).alias("stays"))


def drop_near_copies(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """One row of each component, with all columns of ``docs``."""
    rows = numbered(docs, Scratch(docs.sparkSession, "near-rows"))
    stay = near_dedup(rows.select(UID, "row.doc_id", "row.text"), percent, uid_col=UID).where("stays").select(UID)
    return rows.join(stay, UID, "left_semi").select("row.*")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), PERCENT).drop(UID, "stays")
