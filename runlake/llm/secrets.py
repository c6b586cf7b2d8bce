"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Base spans come from three patterns (kinds assign, access, hex). Beside them, every run of 20 or
more key characters that has letters and digits, or mixes case, is a candidate (kind random). A
``=`` inside a run parts a name from its value, and each part stands for itself (at the end it is
padding). What no one alphabet holds, ``/`` or ``+`` beside ``-`` or ``_``, is parted in each of
three ways, at the first two, at the last two and at all four; every part of 20 or more is a
candidate, so these may overlap, as base spans do. Base spans are cut out of a run first, and what
is left of it on either side is such a run again. Of a candidate:

* its encoding is inferred as the smallest alphabet that holds it: hex, base 32, alphanumeric,
  base 64, base 64 for URLs;
* three statistics ask how uniform it is over that alphabet: chi-squared of the symbol counts, the
  number of runs of characters of one class against what uniform draws would give, and the lag-1
  serial correlation of the symbols' ranks;
* each becomes a p-value under the hypothesis *ordinary text*: names, words and numbers in a row,
  whose counts are uneven, whose classes come in long runs and whose neighbours go together. For
  chi-squared that is the lower tail of a non-central distribution with a text's typical unevenness
  times the length, so the same evenness counts for more the longer the run: short runs can't reach
  small p-values. The three are combined with weights by Stouffer's sum of normal scores;
* candidates of a length class and an encoding are one family. In each, Benjamini-Hochberg at rate
  ``q`` over all documents sets the largest p-value that counts as a discovery. Families are
  histograms of p-values (``BINS`` to a power of ten), so their size doesn't grow with the corpus.

Offsets are code points, ends exclusive. Defined cases: null text is empty and has no spans; rows
that repeat a doc_id are scanned each for itself; null doc_ids stay; an empty table gives no rows;
extra columns, whatever their names, are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import common

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
VALUE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+$)?")
WAYS = tuple(re.compile(f"[A-Za-z0-9{marks}]+(?:=+$)?") for marks in ("_-", "+/", ""))
_KEY_BYTES = bytes(0x78 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" else 0x20 for b in range(256))
_HEX_BYTES = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))

ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
_RANKS = {name: {c: k for k, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
_NORMAL = NormalDist()
BINS, MOST = 20, 40  #: bins to a power of ten, powers of ten

SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<at:int,kind:int,stop:int>>, maybe array<struct<at:int,stop:int,family:string,bin:int>>"


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, by start and then kind."""
    out = []
    if b":" in raw or b"=" in raw:
        lower = raw.lower()
        if any(k in lower for k in KEYWORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token, padding aside."""
    letters = set(token.rstrip("="))
    return next((name for name in ALPHABETS if letters <= _SETS[name]), None)


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def battery(token: str) -> tuple[str, float] | None:
    """(encoding, p-value under *ordinary text*); small means that it looks drawn at random. None: no known encoding."""
    kind = encoding(token)
    body = token.rstrip("=")
    n = len(body)
    if kind is None or n < 16:
        return None
    k, counts = len(ALPHABETS[kind]), Counter(body)
    #: Chi-squared against uniform. Ordinary text adds its unevenness, about 0.9 per character and letter beyond the first, to the mean.
    chi = k / n * sum(c * c for c in counts.values()) - n
    df = k - 1
    uneven = 0.055 * n * (k / 26 if k > 16 else 1.2)
    mean, spread = df + uneven, math.sqrt(2 * df + 4 * uneven)
    z_chi = (chi - mean) / spread
    #: Runs of one character class: uniform draws change class with probability 1 - sum of squared shares; text changes seldom.
    shares = Counter(map(_class, ALPHABETS[kind]))
    turn = 1 - sum((s / k) ** 2 for s in shares.values())
    runs = sum(_class(a) != _class(b) for a, b in zip(body, body[1:], strict=False))
    text_turn = turn / 4
    z_runs = -(runs - (n - 1) * text_turn) / math.sqrt((n - 1) * text_turn * (1 - text_turn)) if turn else 0.0
    #: Lag-1 serial correlation of ranks; words, counters and repeats go together or alternate.
    ranks = np.array([_RANKS[kind][c] for c in body], float)
    centred = ranks - ranks.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    z_serial = (abs(r) - 2.0 / math.sqrt(n)) * math.sqrt(n)
    z = (0.5 * z_chi + 1.0 * z_runs + 0.35 * z_serial) / math.sqrt(0.5**2 + 1.0**2 + 0.35**2)
    return kind, max(_NORMAL.cdf(z), 10.0**-MOST)


def length_class(n: int) -> int:
    """Lengths within a factor of about 1.4 belong together."""
    return min(12, int(2 * math.log2(n / 16)))


def parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run of key characters: parts between inner ``=`` that one alphabet holds, or their parts in each way."""
    out = []
    for value in VALUE.finditer(run):
        if len(value[0]) < LEAST:
            continue
        if encoding(value[0]) is not None:
            out.append(value.span())
        else:
            out += {(value.start() + m.start(), value.start() + m.end()) for way in WAYS for m in way.finditer(value[0]) if len(m[0]) >= LEAST}
    return sorted(out)


def uncovered(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of 20 or more characters that base spans (by start) leave of runs of key characters."""
    k = 0
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while k < len(base) and base[k][0] < m.end():
            a, _, b = base[k]
            if a - at >= LEAST:
                yield at, a
            at = max(at, b)
            if b > m.end():  # goes on beyond this run, so it may reach the next
                break
            k += 1
        if m.end() - at >= LEAST:
            yield at, m.end()


def candidates(text: str, raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, family, bin of its p-value) of the parts of runs of key characters, base spans cut out."""
    if b"x" * 20 not in raw.translate(_KEY_BYTES):
        return []
    out = []
    for start, stop in uncovered(text, base):
        for a, b in parts(text[start:stop]):
            part = text[start + a : start + b]
            classes = {_class(c) for c in part}
            if not (0 in classes and (1 in classes or 2 in classes)) and not (1 in classes and 2 in classes):
                continue
            if tested := battery(part):
                kind, p = tested
                out.append((start + a, start + b, f"{kind}-{length_class(len(part))}", max(0, int(-math.log10(p) * BINS))))
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    maybe = pa.list_(pa.struct([("at", pa.int32()), ("stop", pa.int32()), ("family", pa.string()), ("bin", pa.int32())]))
    for batch in common.slices(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            base = base_spans(text, raw)
            rows.append((base, candidates(text, raw, base)))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0),
            **{f"n_{name}": pa.array([sum(s[1] == k for s in base) for base, _ in rows], pa.int64()) for k, name in enumerate(KINDS[:3])},
            "base_sha256": [hashlib.sha256(_digest(base).encode()).hexdigest() for base, _ in rows],
            "base": pa.array([[{"at": a, "kind": k, "stop": b} for a, k, b in base] for base, _ in rows], span),
            "maybe": pa.array([[dict(zip(("at", "stop", "family", "bin"), c, strict=True)) for c in found] for _, found in rows], maybe),
        })


def discoveries(counts: dict[str, dict[int, int]], q: float) -> dict[str, int]:
    """Per family (bin to count): the smallest bin whose candidates are discoveries, by Benjamini-Hochberg.

    A bin b holds p-values of at most 10 ** (-b / BINS); that bound stands for all of them."""
    out = {}
    for family, bins in counts.items():
        tests, found, least = sum(bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            found += bins[b]
            if 10 ** (-b / BINS) <= q * found / tests:
                least = b
        if least is not None:
            out[family] = least
    return out


def scan(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base counts and digest, and ``found``, all spans as structs (at, kind, stop) by start, then kind."""
    spark = docs.sparkSession
    scanned = common.materialise(spark, common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _scan, SCANNED), "secrets")
    least = limits(scanned.select(F.explode("maybe").alias("c")).select("c.family", "c.bin", F.lit(1).alias("n")), q)
    limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.lit(None).cast("map<string,int>")
    random = F.transform(F.filter("maybe", lambda c: c["bin"] >= F.element_at(limit, c["family"])), lambda c: F.struct(c["at"].alias("at"), F.lit(KINDS.index("random")).alias("kind"), c["stop"].alias("stop")))
    return scanned.withColumn("found", F.array_sort(F.concat("base", random))).drop("base", "maybe")


def spans_text() -> F.Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["at"], s["stop"])), ",")


def limits(histogram: DataFrame, q: float) -> dict[str, int]:
    """From candidates (family, bin, n of them): each family's smallest bin that counts, if any."""
    counts: dict[str, dict[int, int]] = {}
    for row in histogram.groupBy("family", "bin").agg(F.sum("n").alias("n")).collect():  # encodings times length classes times bins at most
        counts.setdefault(row.family, {})[row.bin] = row.n
    return discoveries(counts, q)


def redact(docs: DataFrame, mark: str = "[SECRET]", q: float = 0.01) -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by ``mark``, overlapping ones once; n_chars, if there, follows. All rows and columns stay."""
    names = docs.columns

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    raw = text.encode("utf-8", "surrogatepass")
                    seen.update(c[2:] for c in candidates(text, raw, base_spans(text, raw)))
        yield pa.RecordBatch.from_pydict({"family": pa.array([f for f, _ in seen], pa.string()), "bin": pa.array([b for _, b in seen], pa.int32()), "n": pa.array(seen.values(), pa.int64())})

    least = limits(common.map_arrow(docs.select("text"), histogram, "family string, bin int, n long"), q)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts, changed = batch.column(names.index("text")).to_pylist(), {}
            for k, text in enumerate(texts):
                if not text:
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                base = base_spans(text, raw)
                spans = [(a, b) for a, _, b in base] + [(a, b) for a, b, family, bin_ in candidates(text, raw, base) if bin_ >= least.get(family, 1 << 30)]
                if spans:
                    out, end = [], 0
                    for a, b in sorted(spans):
                        if a >= end:
                            out += [text[end:a], mark]
                        end = max(end, b)
                    changed[k] = "".join(out) + text[end:]
            if changed:
                columns = batch.columns
                columns[names.index("text")] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], batch.schema.field(names.index("text")).type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    columns[at] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(columns[at].to_pylist())], batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return common.map_arrow(docs, replace, docs.schema)


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can express: how many base spans of each kind the texts of all ``documents`` have."""
    return scan(common.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


COUNTS_ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM t
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: base counts and digest, all spans; null, empty, repeated and missing rows as the module states."""
    return scan(common.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text().alias("spans"))
