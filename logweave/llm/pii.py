"""Personal data by weak supervision.

Patterns propose spans.  Labelers (formats, checksums, gazetteers, words around, neighbours) vote on
each span: personal, not personal, or no vote.  Expectation-maximisation over the votes of the whole
corpus estimates how reliable each labeler is and how likely each span is personal.  A logistic
classifier over the look and the context of spans is trained on that, and it has the last word on
spans of the further kinds; spans of the base kinds always stay.
"""

from __future__ import annotations

import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UID, Scratch, table

BASE_KINDS = ("email", "ip", "card", "phone")
#: Further kinds, in the order in which they take precedence over one another.
MORE_KINDS = ("iban", "national_id", "masked_email", "local_phone", "account", "name")
KINDS = BASE_KINDS + MORE_KINDS
#: Spans that the classifier is fitted on at most, taken in the order of a hash; rounds of both fits; hashed weights.
SAMPLE_SPANS, EM_ROUNDS, FIT_ROUNDS, WEIGHT_BITS = 20_000, 60, 300, 12
#: A span of a further kind is taken from this score on.
MIN_SCORE = 0.5
#: Characters on either side in which context words and neighbours are looked for.
NEAR = 60

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MORE = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "masked_email": re.compile(r"(?i)(?<![\w.])[A-Z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Z0-9-]{2,63}){1,4}"),
    "local_phone": re.compile(r"(?<![0-9+.-])\(?[0-9]{3,5}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"),
    "account": re.compile(r"(?<![0-9A-Za-z.,])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z]|[.,][0-9])"),
    "name": re.compile(r"(?<!\w)(?:[A-Z][a-z]{1,20}\.?\x20)?[A-Z][a-z]{1,20}(?:\x20[A-Z]\.)?\x20[A-Z][a-z]{1,20}(?!\w)"),
}

# Gazetteers and context words; fixed values.
GIVEN_NAMES = frozenset("""adam alice amy andrea andrew angela anna anne anthony barbara ben brian carlos carol charles christine claire
daniel david deborah diana donald edward elena elizabeth emily emma eric eva frank george hans helen henry ingrid ivan jack james jane jean
jennifer john jose joseph juan julia karen karl kevin laura linda lisa luis maria mark martin mary michael monica nancy nicole olivia oscar
pablo patricia paul pedro peter philip pierre rachel ralf richard robert rosa ruth sandra sarah simon sofia stefan stephen susan thomas
ursula victor walter wolfgang""".split())
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau monsieur madame mme senor senora don".split())
PROVIDERS = frozenset("gmail yahoo hotmail outlook aol icloud proton gmx web live mail".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
SPEAKS_FOR = {
    "email": "email mail contact write address".split(), "masked_email": "email mail contact write address".split(), "ip": "ip host server address login client".split(),
    "card": "card visa mastercard credit debit payment".split(), "phone": "phone tel telephone call mobile fax cell contact".split(),
    "local_phone": "phone tel telephone call mobile fax cell contact".split(), "iban": "iban account bank transfer".split(),
    "national_id": "ssn social security id number insured".split(), "account": "card account iban bank customer visa passport credit".split(),
    "name": "name mr mrs ms dr patient contact customer signed dear by".split(),
}
SPEAKS_AGAINST = frozenset("version chapter section page figure table isbn order item model part invoice release build example street university".split())
LABELERS = ("format", "checksum", "gazetteer", "words for", "words against", "placeholder", "neighbours", "variety")
_WORD = re.compile(r"[^\W_]+")
_SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean,pattern:int,features:array<int>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))]))


# --- spans ------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Each @ takes the characters before it that no earlier address has, so no stretch is tried twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            yield low, domain.end()
            done = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start. Matches that fail a check use up their text."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    fits = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(fits, m[0].split(".")))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Base spans, then spans of further kinds that meet no base span and none of a kind before theirs."""
    out = base_spans(text)
    taken = sorted((a, b) for _, a, b in out)
    for kind in MORE_KINDS:
        found, i = [], 0
        for m in _MORE[kind].finditer(text):
            a, b = m.span()
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                found.append((a, b))
        out += [(kind, a, b) for a, b in found]
        taken = sorted(taken + found)
    return out


# --- labelers ---------------------------------------------------------------------------------------


def _iban_fits(value: str) -> bool:
    bare = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _format(kind: str, value: str, digits: str) -> int:
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9][\w.%+-]{0,63}@[\w.-]+\.[A-Za-z]{2,24}", value) and ".." not in value else -1
    if kind == "ip":
        return 1 if all(p == "0" or p[0] != "0" for p in value.split(".")) else -1
    if kind in ("card", "account"):
        return 1 if len(digits) in (13, 15, 16) and digits[0] in "3456" else 0 if len(digits) == 16 else -1
    if kind in ("phone", "local_phone"):
        return 1 if 10 <= len(digits) <= 13 else -1
    if kind == "national_id":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    return 1 if kind in ("iban", "masked_email") else 0


def _gazetteer(kind: str, value: str) -> int:
    lower = value.lower()
    if kind in ("email", "masked_email"):
        return 1 if PROVIDERS & {re.sub(r"[0-9]+$", "", w) for w in _WORD.findall(lower.partition("@")[2] or lower)} else 0
    if kind == "phone":
        return 1 if lower[1:].lstrip(" (").startswith(CALLING_CODES) else -1
    if kind == "name":
        words = _WORD.findall(lower)
        return 1 if not GIVEN_NAMES.isdisjoint(words) or not TITLES.isdisjoint(words[:-1]) else -1
    return 0


def votes(kind: str, value: str, before: list[str], after: list[str], neighbours: int) -> list[int]:
    """The vote of each of LABELERS on one span: 1 personal, -1 not, 0 none."""
    digits = _digits(value)
    checksum = 0
    if kind in ("card", "account"):
        checksum = 1 if luhn(digits) else -1
    elif kind == "iban":
        checksum = 1 if _iban_fits(value) else -1
    close = before[-4:]
    against = any(w in SPEAKS_AGAINST for w in before[-2:] + after[:1])
    fake = len(set(digits)) == 1 or digits in "01234567890123456789" if digits else False
    fake = fake or value in ("0.0.0.0", "127.0.0.1", "255.255.255.255") or bool(re.match(r"(?i)(?:user|test|example|name|noreply|no-reply)@", value))
    variety = 0 if kind in ("email", "masked_email", "name", "ip") else 1 if len(set(digits)) >= 5 else -1
    return [_format(kind, value, digits), checksum, _gazetteer(kind, value), int(any(w in SPEAKS_FOR[kind] for w in close)), -int(against), -int(fake), int(neighbours > 0), variety]


def _features(kind: str, value: str, before: list[str], after: list[str]) -> list[int]:
    """Hashed features of the look and the context of a span; the votes are none of them."""
    shape = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", value)))
    short = re.sub(r"(.)\1+", r"\1+", shape)
    named = [f"kind {kind}", f"{kind} shape {short}", f"{kind} length {len(value)}", f"{kind} full {shape if len(shape) < 24 else ''}", f"{kind} begins {value[:1] if value[:1].isdigit() else shape[:1]}",
             f"{kind} before {before[-1] if before else ''}", f"{kind} after {after[0] if after else ''}", f"before {' '.join(before[-2:])}"]
    return [zlib.crc32(x.encode()) & ((1 << WEIGHT_BITS) - 1) for x in named]


def _spans(text: str) -> list[dict]:
    """All proposed spans of a text with their votes, as one number in base 3, and features."""
    found = proposed(text)
    starts = np.sort(np.array([a for kind, a, _ in found if kind != "name"], dtype=np.int64))
    out = []
    for kind, a, b in found:
        before, after = _WORD.findall(text[max(0, a - NEAR) : a].lower()), _WORD.findall(text[b : b + NEAR].lower())
        near = int(np.searchsorted(starts, b + NEAR) - np.searchsorted(starts, a - NEAR)) - (kind != "name")
        value = text[a:b]
        pattern = 0
        for v in votes(kind, value, before, after, near):
            pattern = 3 * pattern + v + 1
        out.append({"kind": kind, "start": a, "end": b, "base": kind in BASE_KINDS, "pattern": pattern, "features": _features(kind, value, before, after)})
    return out


# --- models -----------------------------------------------------------------------------------------


def em(kinds: list[str], patterns: np.ndarray, counts: np.ndarray, labelers: int = len(LABELERS), rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each row, reliability): rows are distinct (kind, pattern of votes) with their counts.
    reliability[l, y, v + 1] is how often labeler l gives the vote v to a span of class y. Labelers
    are taken as independent given the class; each kind has a share of its own. Pseudo-counts say that
    a labeler is better than chance until the votes say otherwise."""
    cast = (patterns[:, None] // 3 ** np.arange(labelers - 1, -1, -1)) % 3
    _, of_kind = np.unique(np.array(kinds), return_inverse=True)
    belief = 1 / (1 + np.exp(-(cast - 1).sum(axis=1).astype(float)))
    prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
    for _ in range(rounds):
        weight = np.stack([counts * (1 - belief), counts * belief])
        tally = np.stack([[np.bincount(cast[:, label], weights=w, minlength=3) for w in weight] for label in range(labelers)]) + prior
        reliability = tally / tally.sum(axis=2, keepdims=True)
        of_class = np.stack([np.bincount(of_kind, weights=w) for w in weight]) + 1.0
        share = of_class[1] / of_class.sum(axis=0)
        odds = np.log(share[of_kind]) - np.log(1 - share[of_kind])
        for label in range(labelers):
            odds = odds + np.log(reliability[label, 1, cast[:, label]]) - np.log(reliability[label, 0, cast[:, label]])
        belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return belief, reliability


def fit(features: np.ndarray, belief: np.ndarray, rounds: int = FIT_ROUNDS, decay: float = 1e-3) -> np.ndarray:
    """Weights of hashed features, by logistic regression against beliefs."""
    size = 1 << WEIGHT_BITS
    weights, seen = np.zeros(size), np.full(size, 1e-8)
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-weights[features].sum(axis=1))) - belief
        slope = np.bincount(features.ravel(), weights=np.repeat(wrong, features.shape[1]), minlength=size) / len(belief) + decay * weights
        seen += slope**2
        weights -= 0.5 * slope / np.sqrt(seen)
    return weights


# --- the operator -----------------------------------------------------------------------------------


def personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_score: float = MIN_SCORE, sample_spans: int = SAMPLE_SPANS) -> DataFrame:
    """One row per input row: ``__row_uid``, the id, and findings, an array of kind, start, end (code points, end
    exclusive), base, score, taken, by kind in the order of KINDS, then start.

    Base spans are taken whatever their score.  Null text counts as empty and has no findings; texts
    of any length are read whole; rows that repeat a text have the same findings.  Other columns
    aren't read, so they can't clash.  A corpus without spans gives rows without findings, an empty
    table an empty result.  Votes are counted over all spans: the table of vote patterns has at most
    3 ** len(LABELERS) rows a kind, whatever the corpus.  The classifier is fitted on at most
    sample_spans spans.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pii")

    def scan(batches):
        for batch in batches:
            spans = [_spans(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_ARROW)], ["id", "spans"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    schema = texts.select("id", F.lit(None).cast(f"array<{_SPAN}>").alias("spans")).schema
    found = scratch.keep(texts.mapInArrow(scan, schema).select(F.monotonically_increasing_id().alias(UID), "*"), "found")
    each = found.select("id", F.inline("spans"))
    table_of = each.groupBy("kind", "pattern").agg(F.count("*").alias("n")).orderBy("kind", "pattern").collect()
    weights = np.zeros(1 << WEIGHT_BITS)
    if table_of:
        belief, _ = em([r.kind for r in table_of], np.array([r.pattern for r in table_of]), np.array([float(r.n) for r in table_of]))
        known = {(r.kind, r.pattern): b for r, b in zip(table_of, belief)}
        # Rows beyond twice the share that is wanted stay where they are; the sample is the first of the others.
        h, share = F.pmod(F.xxhash64("id", "start", "features"), F.lit(1 << 32)), min(1.0, 2 * sample_spans / sum(r.n for r in table_of))
        drawn = each.withColumn("h", h).where(F.col("h") < int(share * (1 << 32))).orderBy("h", "kind", "start", "end", "pattern").limit(sample_spans).select("kind", "pattern", "features").collect()
        weights = fit(np.array([r.features for r in drawn]), np.array([known[r.kind, r.pattern] for r in drawn]))
    model = spark.createDataFrame([(weights.tolist(),)], "weights array<double>")
    place = F.array(*map(F.lit, KINDS))

    def judged(x: Column) -> Column:
        total = F.aggregate(x["features"], F.lit(0.0), lambda acc, f: acc + F.get(F.col("weights"), f))
        score = 1 / (1 + F.exp(-total))
        return F.struct(F.array_position(place, x["kind"]).alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), score.alias("score"), (x["base"] | (score >= min_score)).alias("taken"))

    findings = F.transform(F.array_sort(F.transform("spans", judged)), lambda x: F.struct(x["kind"], x["start"], x["end"], x["base"], x["score"], x["taken"]))
    return found.join(F.broadcast(model)).select(UID, F.col("id").alias(id_col), findings.alias("findings"))


def redacted(docs: DataFrame, findings: Column, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's taken spans replaced by their kinds in brackets; the pieces between spans and
    the names are put together in order of place, and of spans that meet the one that ends later counts."""
    taken = F.array_sort(F.transform(F.filter(findings, lambda x: x["taken"]), lambda x: F.struct(x["start"], x["end"], x["kind"])))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def put(acc, x):
        between = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        name = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], between, name).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate(taken, start, put)
    return docs.withColumn(text_col, F.when(F.size(taken) > 0, F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))).otherwise(F.col(text_col)))


def op13_pii(spark, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    f = F.col("findings")
    count = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(joined(F.filter(f, lambda x: x["base"])), 256).alias("base_sha256"), joined(F.filter(f, lambda x: x["taken"])).alias("spans"))
