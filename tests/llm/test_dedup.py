import hashlib
import re
from collections import defaultdict

from logweave.llm.common import UID
from logweave.llm.exact_dedup import drop_exact_copies, exact_dedup
from logweave.llm.near_dedup import drop_near_copies, near_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[norm(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for key, group in groups.items():
        first = min(group, key=lambda g: g[:3])
        digest = hashlib.sha256(key.encode()).hexdigest()
        for k, g in enumerate(sorted(group, key=lambda g: g[:3])):
            out.append((g[3], first[3], len(group), k == 0, digest))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_exact_dedup_is_brute_force(docs, edge):
    for df in (docs, edge):
        assert result(exact_dedup(df)) == brute_exact(pairs_of(df))
    assert result(exact_dedup(docs, first_digit=1, growth=2)) == brute_exact(pairs_of(docs))


def test_exact_dedup_splits_late_differences(spark, tmp_path):
    base = "abc " * 5_000
    rows = [(i, base + "x" * (i % 3)) for i in range(30)] + [(100, base[:-1] + "d"), (101, base * 2)]
    path = str(tmp_path / "late")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    assert result(exact_dedup(spark.read.parquet(path))) == brute_exact(rows)


def test_exact_stage_keeps_columns(edge, empty):
    out = drop_exact_copies(edge)
    assert out.columns == edge.columns
    assert out.count() == len({norm(t) for _, t in pairs_of(edge)})
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).columns == empty.columns


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_near(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(str((doc_id, len(sets[i]), least.get(find(i)), doc_id == least.get(find(i)))) for i, (doc_id, _) in enumerate(rows))


def near_result(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_dedup_is_brute_force(docs, edge):
    for df in (docs, edge):
        assert near_result(near_dedup(df)) == brute_near(pairs_of(df), 85)


def test_near_dedup_long_postings(spark, tmp_path):
    """A large group of near copies at many distances, chains, and texts around a common passage."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(200)] = word()
        rows.append((i, " ".join(t)))
    chain = list(base)
    for i in range(120, 160):
        chain = list(chain)
        chain[rng.randrange(200)] = word()
        rows.append((i, " ".join(chain)))
    for i in range(160, 220):
        rows.append((i, " ".join(base[:60] + [word() for _ in range(140)])))
    path = str(tmp_path / "near")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    assert near_result(near_dedup(spark.read.parquet(path))) == brute_near(rows, 85)


def test_near_stage_keeps_one_of_each(edge, empty):
    out = drop_near_copies(edge)
    assert out.columns == edge.columns
    decided = near_dedup(edge)
    assert out.count() == decided.where("stays").count()
    assert decided.select(UID).distinct().count() == edge.count()
    assert near_dedup(empty).count() == 0 and drop_near_copies(empty).count() == 0
