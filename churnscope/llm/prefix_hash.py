"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds sum((c + 1) * base**t) mod a prime over its first t
code points, for two bases.  Two entries and an inverse power give the hash of
any span, so spans of any texts are compared in constant time, and the longest
common extension of two places is found by binary search.  The array of an
edited text goes on from the prefix that it keeps.

A fingerprint is text of bounded size: the code points, the hash of the whole,
the hashes of prefixes at the multiples of a power of two (up to ``STEPS``), and
the ``SAMPLE`` smallest mixed hashes of the distinct spans of ``SPAN`` code
points.  ``likeness`` of two fingerprints is the larger of two shares: the
longest common prefix, found by binary search on the prefix hashes, of the
longer text; and the distinct spans in common, estimated from the samples, times
the shorter length over the longer.  It is 1 for equal fingerprints.

``compare_edits`` deals whole texts by ranges of descending id, once, and each
task walks its range with one text held back.  Where ranges meet, the last and
the first text are written and joined afterwards, two texts a range.

Edge cases: a null text is empty; bytes that are no UTF-8 are read as U+FFFD.
An empty text is like other empty texts only.  Rows of a null id come after all
others; rows of one id follow in the order of a hash of their text.  A single
row is its own next document.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.session import stash

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_812_433_253 % PRIME)
SPAN, SAMPLE, STEPS = 24, 16, 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hexadecimal digits of a sampled hash and of a prefix hash.
SAMPLE_DIGITS, STEP_DIGITS = 10, 8
OUT_ROWS = 2_000


def _reduced(x: np.ndarray) -> np.ndarray:
    """x mod PRIME, for x below 2**62."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return x - np.uint64(PRIME) * (x >= PRIME)


class Powers:
    """Powers of the bases and of their inverses, grown by doubling to the longest text seen."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def reach(self, n: int) -> None:
        while len(self.up[0]) < n:
            size = len(self.up[0])
            for k, base in enumerate(BASES):
                for table, b in ((self.up, base), (self.down, pow(base, PRIME - 2, PRIME))):
                    step = np.uint64(pow(b, size, PRIME))
                    table[k] = np.concatenate((table[k], _reduced(table[k] * step)))


POWERS = Powers()


def code_points(text: str | bytes | None) -> np.ndarray:
    if isinstance(text, bytes):
        text = text.decode(errors="replace")
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


class PrefixHashes:
    """Prefix arrays of a text's code points."""

    def __init__(self, points: np.ndarray, sums: list[np.ndarray] | None = None):
        self.n = len(points) + (len(sums[0]) - 1 if sums else 0)
        POWERS.reach(self.n + 1)
        kept = self.n - len(points)
        self.sums = []
        for k in range(len(BASES)):
            terms = _reduced((points.astype(np.uint64) + np.uint64(1)) * POWERS.up[k][kept:self.n])
            begin = sums[k] if sums else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate((begin, _reduced(begin[-1] + np.cumsum(terms)))))

    def spliced(self, length: int, points: np.ndarray) -> PrefixHashes:
        """The first ``length`` code points, then ``points``."""
        return PrefixHashes(points, [s[:length + 1] for s in self.sums])

    def span(self, start, end) -> np.ndarray:
        """Hashes (62 bits) of the code points start..end, for numbers or arrays."""
        one, two = (_reduced(_reduced(s[end] + np.uint64(PRIME) - s[start]) * POWERS.down[k][start])
                    for k, s in enumerate(self.sums))
        return (one << np.uint64(31)) | two

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        return bool(self.span(start, start + length) == other.span(at, at + length))

    def common(self, start: int, other: PrefixHashes, at: int) -> int:
        """Longest common extension: how far the text from ``start`` agrees with the other from ``at``."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(start, other, at, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def smallest(self, size: int = SAMPLE, span: int = SPAN) -> np.ndarray:
        """The smallest mixed hashes of the distinct spans (of the whole, if it is shorter)."""
        if not self.n:
            return np.zeros(0, np.uint64)
        start = np.arange(max(self.n - span, 0) + 1)
        mixed = self.span(start, start + min(span, self.n)) * MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= MIX
        take = 4 * size
        while True:
            least = mixed if take >= len(mixed) else np.partition(mixed, take - 1)[:take]
            found = np.unique(least)
            if len(found) >= size or take >= len(mixed):
                return found[:size]
            take *= 4

    def fingerprint(self) -> str:
        step = 1
        while self.n // step > STEPS:
            step *= 2
        ends = np.arange(step, self.n + 1, step)
        steps = (self.span(np.zeros_like(ends), ends) * MIX >> np.uint64(32)).tolist()
        sample = (self.smallest() >> np.uint64(64 - 4 * SAMPLE_DIGITS)).tolist()
        whole = int(self.span(0, self.n))
        return "-".join((f"{self.n:x}", f"{whole:016x}", "".join(f"{x:0{STEP_DIGITS}x}" for x in steps),
                         "".join(f"{x:0{SAMPLE_DIGITS}x}" for x in sample)))


def _parsed(fingerprint: str) -> tuple[int, int, list[str], list[str]]:
    n, _, steps, sample = fingerprint.split("-")
    n, step = int(n, 16), 1
    while n // step > STEPS:
        step *= 2
    return (n, step, [steps[i:i + STEP_DIGITS] for i in range(0, len(steps), STEP_DIGITS)],
            [sample[i:i + SAMPLE_DIGITS] for i in range(0, len(sample), SAMPLE_DIGITS)])


def common_steps(one: tuple, two: tuple) -> int:
    """Code points that two parsed fingerprints share at their beginning, as far as their steps tell."""
    step = max(one[1], two[1])
    a, b = ([*steps[step // own - 1::step // own]] for _, own, steps, _ in (one, two))
    low = bisect_left(range(min(len(a), len(b))), True, key=lambda i: a[i] != b[i])  # equal prefixes come first
    return low * step


def likeness(one: str, two: str) -> float:
    """0 to 1: how much of two texts agrees, from their fingerprints alone."""
    if one == two:
        return 1.0
    a, b = _parsed(one), _parsed(two)
    if not a[0] or not b[0]:
        return 0.0
    size = max(len(a[3]), len(b[3]))
    union = sorted({*a[3], *b[3]})[:size]
    both = {*a[3]} & {*b[3]}
    longer, ratio = max(a[0], b[0]), min(a[0], b[0]) / max(a[0], b[0])
    return max(common_steps(a, b) / longer, ratio * sum(x in both for x in union) / len(union))


class Text:
    """A row's text with its hashes and fingerprint."""

    __slots__ = ("doc_id", "points", "hashes", "print")

    def __init__(self, doc_id, text):
        self.doc_id, self.points = doc_id, code_points(text)
        self.hashes = PrefixHashes(self.points)
        self.print = self.hashes.fingerprint()

    def against(self, after: Text) -> tuple:
        """The row of this text, whose next document is ``after``."""
        n, cut = len(self.points), len(self.points) // 3
        begin = after.points[:cut]
        edited = self.hashes.spliced(n - cut, begin)
        text = np.concatenate((self.points[:n - cut], begin)).tobytes().decode("utf-32-le")
        changed = edited.fingerprint()
        return (self.doc_id, n, hashlib.sha256(text.encode()).hexdigest(), self.print, changed,
                likeness(self.print, changed), likeness(self.print, after.print),
                self.hashes.common(0, edited, 0))


FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
          "common_prefix"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_prefix long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [c.cast(pa.large_binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's rows (doc_id, text) in order: every row but the last against the one after it, and the
    texts at both ends of the range (``edge`` 0 and 1)."""
    part = TaskContext.get().partitionId()
    names, kinds = [*FIELDS, "edge", "part", "text"], [*KINDS, pa.int32(), pa.int32(), pa.binary()]
    held, out, raw = None, [], None
    for doc_id, raw in _rows(batches):
        now = Text(doc_id, raw)
        if held is None:
            out.append((doc_id, *[None] * 7, 0, part, raw))
        else:
            out.append((*held.against(now), None, part, None))
        held = now
        if len(out) >= OUT_ROWS:
            yield _batch(out, names, kinds)
            out = []
    if held is not None:
        out.append((held.doc_id, *[None] * 7, 1, part, raw))
        yield _batch(out, names, kinds)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, after_id, after_text) at the ends of ranges."""
    for row in _rows(batches):
        yield _batch([Text(*row[:2]).against(Text(*row[2:]))], FIELDS, KINDS)


def compare_edits(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_chars, the digest of its edited text, both fingerprints, their
    likeness, that to the next document's, and the code points that text and edited text begin with alike."""
    spark = df.sparkSession
    text = F.col(text_column).cast("string")
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("row")]
    dealt = (rows.withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
             .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    done = stash(dealt.mapInArrow(_walked, f"{SCHEMA}, edge int, part int, text binary"), "edit-rows")
    ends = done.where("edge IS NOT NULL").select("doc_id", "text", "edge", "part")
    parts = sorted(r.part for r in ends.where("edge = 0").select("part").collect())  # one number a range
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follow int")
    first = ends.where("edge = 0").select(F.col("doc_id").alias("after_id"), F.col("text").alias("after_text"),
                                          F.col("part").alias("follow"))
    met = stash(ends.where("edge = 1").join(follow, "part").join(first, "follow")
                .select("doc_id", "text", "after_id", "after_text").mapInArrow(_met, SCHEMA), "edit-ends")
    return done.where("edge IS NULL").select(*FIELDS).unionByName(met)
